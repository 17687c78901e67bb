"""Licence notices by a positional rare-token index, in DataFrame expressions only.

A template is a notice: a label, its words, and the key phrases that must stand
word for word.  One narrow pass over the texts finds, for files that hold all key
words of some template, where the templates' words stand.  Document frequencies of
these words over all files give their IDF.  Of each template the highest-IDF words among
those of its key phrases look up its postings, in every file; where all of them agree
on the start of the notice is an alignment; its key phrases are then verified and its words weighed.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label and phrase, wherever the words stand in a row.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: label, notice, key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction", ("hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("for any purpose with or without fee is hereby granted",)),
    ("public-domain", "free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)
RAREST, COVERAGE = 6, 0.5


def _starts(phrase: str) -> Column:
    """Places of a phrase in ``words``; looked for only where the joined text has it."""
    parts = phrase.split()
    here = F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), lambda i: _all(
        [F.get("words", i + k) == w for k, w in enumerate(parts)]))
    return F.when(F.contains("joined", F.lit(f" {phrase} ")), here).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _template_words(spark, templates) -> DataFrame:
    """``template, label, at, word, must``: one row per template word."""
    rows = []
    for number, (label, notice, phrases) in enumerate(templates):
        words = notice.split()
        must = set()
        for phrase in phrases:
            parts = phrase.split()
            at = next(k for k in range(len(words)) if words[k:k + len(parts)] == parts)
            must |= set(range(at, at + len(parts)))
        rows += [(number, label, k, w, k in must) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "template int, label string, at int, word string, must boolean")


def scan_words(docs: DataFrame, templates=TEMPLATES, base=BASE, id_col="doc_id", text_col="text") -> DataFrame:
    """The narrow pass: word counts, base places, and the template words of files that can match."""
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    words = docs.select(docs[id_col].alias("doc_id"), F.regexp_extract_all(
        F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase),
        F.lit(WORD), F.lit(0)).alias("words"))
    words = words.withColumns({"row": F.monotonically_increasing_id(),
                               "joined": F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))})
    words = words.withColumns({f"base{k}": _starts(phrase) for k, (_, phrase) in enumerate(base)} | {
        "found": F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))})
    needs = [_all([F.array_contains("found", w) for w in sorted({w for p in phrases for w in p.split()})]) for _, _, phrases in templates]
    can = needs[0]
    for n in needs[1:]:
        can = can | n
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.when(w.isin(vocabulary), w).alias("word"))),
                      lambda x: x["word"].isNotNull())
    starts = F.concat(*[f"base{k}" for k in range(len(base))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"base{k}") > 0, label) for k, (label, _) in enumerate(base)]))
    return words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "found", starts.alias("starts"),
                        labels.alias("base_labels"), F.when(can, places).alias("places"))


def notices(scanned: DataFrame, templates=TEMPLATES, rarest: int = RAREST, coverage: float = COVERAGE) -> DataFrame:
    """``row, labels, score``: verified templates of each file and their best weighed coverage."""
    spark = scanned.sparkSession
    index = _template_words(spark, templates)
    files = F.lit(scanned.count())
    counts = scanned.select(F.explode("found").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = counts.select("word", F.log((files + 1) / F.col("df")).alias("idf"))
    weighed = index.join(idf, "word", "left").fillna(0.0, ["idf"])
    hits = scanned.where("places is not null").select("row", F.inline("places"))
    # A notice stands only with all its must words, so the rarest of them, the same for all files, miss none.
    best = W.partitionBy("template").orderBy(F.desc("idf"), "word")
    needed = weighed.where("must").select("template", "word", "idf").distinct()
    rare = needed.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= rarest).select("template", "word")
    lookups = index.where("must").join(rare, ["template", "word"]).withColumn("needs", F.count("*").over(W.partitionBy("template")))
    aligned = hits.join(F.broadcast(lookups), "word") \
        .groupBy("row", "template", (F.col("pos") - F.col("at")).alias("start")).agg(
            F.count("*").alias("votes"), F.first("needs").alias("needs"))
    expected = aligned.where("votes = needs").select("row", "template", "start").join(weighed, "template") \
        .withColumn("pos", F.col("start") + F.col("at"))
    met = expected.join(hits.withColumn("met", F.lit(1)), ["row", "pos", "word"], "left")
    share = F.sum(F.when(F.col("met") == 1, F.col("idf")).otherwise(0.0)) / F.greatest(F.sum("idf"), F.lit(1e-9))
    verified = met.groupBy("row", "template", "label", "start").agg(
        share.alias("score"), F.max(F.col("must") & F.col("met").isNull()).alias("broken"))
    good = verified.where(~F.col("broken") & (F.col("score") >= coverage))
    return good.groupBy("row").agg(F.collect_set("label").alias("found_labels"), F.max("score").alias("score"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    A null text is empty: no words, no places (first and last null), empty labels,
    score 0.  A base label scores 1.  Repeated rows and null ids are rows of their own.
    """
    scanned = materialize(scan_words(docs, templates, base, id_col, text_col), "licences")
    out = scanned.drop("found", "places").join(notices(scanned, templates), "row", "left")
    some = F.size("starts") > 0
    labels = F.array_union("base_labels", F.coalesce("found_labels", F.array().cast("array<string>")))
    score = F.when(some, 1.0).otherwise(F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)))
    return out.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
                      F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
                      F.array_join(F.array_sort(F.array_distinct("base_labels")), ",").alias("base_labels"),
                      F.array_join(F.array_sort(labels), ",").alias("labels"), score.alias("score"))
