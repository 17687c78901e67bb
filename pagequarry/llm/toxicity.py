"""Toxicity: a linear classifier that must not react to identity terms.

Features are the words of a text (ASCII letters and digits lower-cased, everything
beyond ASCII kept) and their first four and five bytes, each once per text.  The
loss is logistic plus two penalties: on the weights, and on the squared change of
the score when every identity term of a labelled text is swapped for another of
its group.  The second keeps neutral mentions of a group from raising the score,
even where the labelled texts mention it mostly in toxic ones.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those with the
smallest hash of their id.  Tasks count features per label; the driver sees the
chosen features and, for each sampled row, which of them it has.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text, materialize
from .words import PUNCTUATION, chunks, find_words, hash_words

#: Most labelled rows to fit on, most features, fewest rows of a feature, least evidence (G squared).
SAMPLE, FEATURES, ROWS, EVIDENCE = 20_000, 4096, 10, 15.0
PREFIXES = (None, 4, 5)
#: Groups of identity terms; a term is swapped for the next one of its group.
IDENTITY = (("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslim", "christian", "jewish", "hindu"),
            ("muslims", "christians", "jews", "hindus"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian"),
            ("immigrants", "natives"), ("foreigners", "locals"), ("transgender", "cisgender"), ("disabled", "healthy"),
            ("old", "young"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"))
_BITS = 20


def _features(words: list[str]) -> np.ndarray:
    """Feature hashes of single words: one row per word, one column per kind."""
    found = find_words(pa.array(words, pa.large_string()), PUNCTUATION)
    return np.stack([hash_words(found, prefix=p) for p in PREFIXES], axis=1)


def identity_swaps() -> tuple[np.ndarray, np.ndarray]:
    """Features of each identity term, and of the term that replaces it."""
    terms = [(t, group[(k + 1) % len(group)]) for group in IDENTITY for k, t in enumerate(group)]
    return _features([t for t, _ in terms]), _features([t for _, t in terms])


class Chosen:
    """Finds chosen features among many: a bit table first, then a search."""

    def __init__(self, features: np.ndarray):
        self.known = np.unique(features)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.known >> np.uint64(64 - _BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the chosen ones, and their numbers."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _BITS)])
        number = np.searchsorted(self.known, hashes[at])
        good = (number < len(self.known)) & (self.known[np.minimum(number, len(self.known) - 1)] == hashes[at]) if len(self.known) \
            else np.zeros(0, bool)
        return at[good], number[good]


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        """Score of each text of a batch with a column ``text``."""
        chosen, out = Chosen(self.features), []
        for part in chunks(batch, "text"):
            rows, numbers = present(part, chosen)
            z = self.bias + np.bincount(rows, self.weights[numbers], part.num_rows) if len(rows) else np.full(part.num_rows, self.bias)
            out.append(1 / (1 + np.exp(-z)))
        return np.concatenate(out) if out else np.zeros(0)


def present(part: pa.RecordBatch, chosen: Chosen, swap=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text and chosen feature, each once; with ``swap``, of the swapped texts."""
    found = find_words(part.column("text"), PUNCTUATION)
    owner, pairs = found.row, []
    columns = [hash_words(found, prefix=p) for p in PREFIXES]
    if swap is not None:
        old, new = swap
        order = np.argsort(old[:, 0])
        at = np.minimum(np.searchsorted(old[order, 0], columns[0]), len(order) - 1)
        hit = np.flatnonzero(old[order[at], 0] == columns[0])
        for k, c in enumerate(columns):
            c[hit] = new[order[at[hit]], k]
    for c in columns:
        at, number = chosen.find(c)
        pairs.append(owner[at].astype(np.int64) << 32 | number)
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> 32, pairs & 0xFFFFFFFF


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, h, text, label`` of at most ``sample`` labelled rows; ``h`` is a hash of the text.

    Repeated rows are one.  The sample is taken of the keys of rows that are there, so it is neither larger nor, with
    enough of them, smaller; only these keys are sent to the tasks.
    """
    labelled = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("label")) \
        .where((crc_mod("doc_id", 5) != 0) & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    keys = rows.select("doc_id", "h").distinct().join(labelled, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample)
    return rows.join(F.broadcast(keys), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "text", "label")


def feature_counts(rows: DataFrame) -> DataFrame:
    """``feature, n, toxic``: rows with each feature, summed inside each task first."""
    def run(batches: Iterator[pa.RecordBatch]):
        known, sums = np.zeros(0, np.uint64), np.zeros((2, 0))
        for batch in batches:
            for part in chunks(batch, "text"):
                found = find_words(part.column("text"), PUNCTUATION)
                label = part.column("label").to_numpy()
                each = [np.stack([hash_words(found, prefix=p), found.row.astype(np.uint64)]) for p in PREFIXES]
                pairs = np.unique(np.concatenate(each, axis=1), axis=1)
                new, at = np.unique(np.concatenate([known, pairs[0]]), return_inverse=True)
                old, at = at[:len(known)], at[len(known):]
                total = np.stack([np.bincount(at, minlength=len(new)), np.bincount(at, label[pairs[1].astype(int)], len(new))]).astype(float)
                total[:, old] += sums
                known, sums = new, total
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(sums[0].astype(np.int64)),
                                          pa.array(sums[1].astype(np.int64))], ["feature", "n", "toxic"])
    return rows.select("text", "label").mapInArrow(run, "feature long, n long, toxic long") \
        .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def choose_features(counts: DataFrame, rows: int, toxic: int) -> np.ndarray:
    """Features that are evidence for either label, the strongest first, and all identity terms'."""
    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    n, t, share = F.col("n").cast("double"), F.col("toxic").cast("double"), toxic / max(1, rows)
    rest = F.lit(float(rows)) - n
    g2 = 2 * (term(t, n * share) + term(n - t, n * (1 - share)) + term(toxic - t, rest * share) + term(rest - (toxic - t), rest * (1 - share)))
    best = counts.where(n >= ROWS).withColumn("g2", g2).where(F.col("g2") >= EVIDENCE).orderBy(F.desc("g2"), "feature").limit(FEATURES)
    found = np.array([r.feature for r in best.select("feature").collect()], np.int64).view(np.uint64)
    return np.unique(np.concatenate([found, identity_swaps()[0].ravel()]))


def fit(rows, y: np.ndarray, size: int, swapped=None, strength: float = 1.0, decay: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic loss by gradient steps of adapted length.

    ``rows`` and ``swapped`` are pairs of row and feature numbers of the texts and of
    their counterfactuals; ``strength`` weighs the squared score changes.
    """
    n = len(y)
    w, b, seen, seen_b = np.zeros(size), np.log((y.sum() + 0.5) / (n - y.sum() + 1.5)), np.full(size, 1e-8), 1e-8
    at, of = rows
    for _ in range(steps if n else 0):
        z = b + np.bincount(at, w[of], n)
        g = (1 / (1 + np.exp(-z)) - y) / n
        gw = np.bincount(of, g[at], size) + decay * w
        if swapped is not None:
            change = np.bincount(at, w[of], n) - np.bincount(swapped[0], w[swapped[1]], n)
            d = 2 * strength * change / max(1, np.count_nonzero(change))
            gw += np.bincount(of, d[at], size) - np.bincount(swapped[1], d[swapped[0]], size)
        seen, seen_b = seen + gw * gw, seen_b + g.sum() ** 2
        w, b = w - 0.3 * gw / np.sqrt(seen), b - 0.1 * g.sum() / np.sqrt(seen_b)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, strength: float = 1.0) -> Model:
    """A model from the labelled rows whose crc32(doc_id) mod 5 is not 0.  Without any it knows no feature."""
    rows = materialize(training_rows(docs, labels, sample), "labelled")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).head()
    features = choose_features(feature_counts(rows), total.n, total.toxic)

    def run(batches: Iterator[pa.RecordBatch]):
        chosen, swap = Chosen(features), identity_swaps()
        for batch in batches:
            for part in chunks(batch, "text"):
                sides = []
                for pairs in (present(part, chosen), present(part, chosen, swap)):
                    ends = np.searchsorted(pairs[0], np.arange(part.num_rows + 1))
                    sides.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs[1], pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), part.column("label"), *sides],
                                                 ["doc_id", "h", "label", "own", "other"])
    table = rows.mapInArrow(run, "doc_id long, h long, label int, own array<int>, other array<int>").toArrow()
    order = pc.sort_indices(table, [("doc_id", "ascending"), ("h", "ascending")])
    table = table.take(order)  # so that a fit does not depend on task order
    y = np.array(table["label"].to_pylist(), float)

    def pairs(column):
        lists = table[column].to_pylist()
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([v for x in lists for v in x], int)
    weights, bias = fit(pairs("own"), y, len(features), pairs("other"), strength)
    return Model(features, weights, bias)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row in one narrow pass; a text without known features has the score of the bias."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b))], ["doc_id", "score"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null texts are empty.  A row without an id is scored and is not held out.
    Repeated rows are scored alike; labels of a repeated id count as toxic if one is.
    """
    scored = score_documents(docs, train(docs, labels, **options))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not call toxic, in one narrow pass: columns as they came."""
    kind = docs.schema["text"].dataType.simpleString()
    if kind != "string":
        raise TypeError(f"the text must be a string, not {kind}")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(model.scores(b) < 0.5))
    return docs.mapInArrow(run, docs.schema)
