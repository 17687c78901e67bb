"""Personal data: spans proposed by patterns, judged by gradient-boosted trees, in DataFrame expressions only.

Generators propose spans, some of them loosely and overlapping.  Those that pass the
format rules of their kind are the base and always stay.  Every proposal becomes a
short vector of format and context features.  The trees are boosted on the proposals
of the patterns with format rules, labelled by whether they pass (weak labels); the
rows are summed per distinct vector first, so the driver boosts a table whose size
the features bound, whatever the corpus.  Per kind, a threshold is set where the
labelled share above it reaches a wanted precision.  The model then is a column
expression again, and loose proposals above it that overlap nothing better are added.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: Patterns (possessive, so linear in the text) by name: kind, what a text must contain, pattern.  The first
#: four are the base patterns; a match may start where the last one ended or where no such run is under way.
GENERATORS = {
    "email": (0, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"),
    "ip": (1, r"\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (2, r"[0-9](?:[ -]?+[0-9]){15}", r"[0-9](?:[ -]?+[0-9])++"),
    "phone": (3, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "email_spelled": (0, r"[\[(]at[\])]", rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(]at[\])] ?{_HOST}++(?: ?[\[(]dot[\])] ?{_HOST}++|\.{_HOST}++)++"),
    "phone_local": (3, r"[0-9][ .-][0-9]", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
    "card_short": (2, r"[0-9](?:[ -]?+[0-9]){12}", r"(?<![0-9A-Za-z.-])3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z-])"),
}
BASE = KINDS
CONTEXT = r"(?i)(mail|e-?mail|contact|kontakt|correo|courriel|phone|call|tel|fon|mobile|card|visa|credit|karte|carte|tarjeta|address|ip|host|server)[^0-9A-Za-z]{0,3}\w{0,8}[^0-9A-Za-z]{0,3}$"
NEAR = 24
TREES, RATE, PRECISION = 30, 0.3, 0.9


def _matches(text: Column, needs: str, pattern: str) -> Column:
    """All matches with the length of the gap before, the end of that gap, and the character after.

    The end of the text counts as a last, empty match; else the search for one more
    would begin anew at every character after the last.
    """
    whole = F.lit(rf"(?s)(.*?)({pattern}|\z)(?=(.?))")
    gap, hit, after = (F.regexp_extract_all(text, whole, F.lit(k)) for k in (1, 2, 3))
    full = F.filter(F.arrays_zip(gap.alias("g"), hit.alias("h"), after.alias("a")), lambda x: x["h"] != "")
    found = F.transform(full, lambda x: F.struct(
        F.char_length(x["g"]).alias("gap"), F.substr(x["g"], F.greatest(F.char_length(x["g"]) - NEAR + 1, F.lit(1))).alias("before"),
        x["h"].alias("hit"), x["a"].alias("after")))
    none = F.array().cast("array<struct<gap:int,before:string,hit:string,after:string>>")
    return F.when(text.rlike(needs), found).otherwise(none)


def propose(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The narrow pass over whole texts: a row number and the matches of each generator."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.select("row", "doc_id", *[_matches(F.col("text"), needs, p).alias(g) for g, (_, needs, p) in GENERATORS.items()])


def _luhn(digits: Column) -> Column:
    """Whether at most 19 digits have a valid check digit."""
    def value(d, i):
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(n)
    values = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def spans(proposed: DataFrame) -> DataFrame:
    """One row per proposal: ``row, generator, kind, start, end, passes`` and its features ``f0..``."""
    rows = None
    for number, (name, (kind, _, _)) in enumerate(GENERATORS.items()):
        part = proposed.where(F.size(name) > 0).select("row", F.lit(number).alias("generator"), F.lit(kind).alias("kind"),
                                                      F.posexplode(name).alias("at", "m")).select("row", "generator", "kind", "at", "m.*")
        rows = part if rows is None else rows.unionByName(part)
    order = W.partitionBy("row", "generator").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    length = F.char_length("hit")
    rows = rows.withColumn("end", F.sum(F.col("gap") + length).over(order).cast("int")).withColumn("start", F.col("end") - length)
    digits = F.regexp_replace("hit", "[^0-9]", "")
    rows = rows.withColumn("digits", digits).withColumn("n", F.char_length(digits))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    check = F.when(F.col("n").between(13, 19), _luhn(F.col("digits"))).otherwise(F.lit(False))
    rows = rows.withColumns({
        "small": F.col("hit").rlike(rf"^{part}(?:\.{part}){{3}}$"), "luhn": check})
    passes = F.when(F.col("generator") == 0, F.lit(True)).when(F.col("generator") == 1, F.col("small")) \
        .when(F.col("generator") == 2, F.col("n").between(16, 19) & F.col("luhn")) \
        .when(F.col("generator") == 3, F.col("n").between(8, 15))
    features = [
        F.col("kind"),
        F.least(F.col("n"), F.lit(20)),
        F.least(F.char_length(F.regexp_replace("hit", r"[^ ().-]", "")), F.lit(6)),
        F.col("luhn").cast("int"),
        F.col("small").cast("int"),
        F.col("before").rlike(r"(?:^|[\s(\[<:,;\"'|])$").cast("int"),
        F.col("after").rlike(r"^(?:[\s)\]>,;:.\"'!?|])?$").cast("int"),
        F.col("before").rlike(CONTEXT).cast("int"),
        F.col("hit").startswith("+").cast("int"),
        F.col("hit").rlike(r"(?i)\b(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$").cast("int"),
    ]
    return rows.select("row", "generator", "kind", "start", "end", passes.alias("passes"),
                       *[f.cast("int").alias(f"f{k}") for k, f in enumerate(features)])


N_FEATURES = 10


@dataclass
class Trees:
    """Boosted trees of depth two as plain numbers: (feature, limit, left, right), a leaf is a value."""
    bias: float
    trees: list
    limits: dict  # kind -> least probability

    def score(self) -> Column:
        """Probability, over columns ``f0..``."""
        def column(node):
            if isinstance(node, float):
                return F.lit(node)
            feature, limit, low, high = node
            return F.when(F.col(f"f{feature}") <= limit, column(low)).otherwise(column(high))
        total = F.lit(self.bias)
        for t in self.trees:
            total = total + column(t)
        return 1 / (1 + F.exp(-total))

    def value(self, x: np.ndarray) -> np.ndarray:
        def of(node):
            if isinstance(node, float):
                return np.full(len(x), node)
            feature, limit, low, high = node
            return np.where(x[:, feature] <= limit, of(low), of(high))
        return 1 / (1 + np.exp(-(self.bias + sum((of(t) for t in self.trees), np.zeros(len(x))))))


def boost(x: np.ndarray, n: np.ndarray, positive: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Trees for weighted rows: ``n`` proposals of each vector, ``positive`` of them passing.  Second-order logistic boosting."""
    total, good = n.sum(), positive.sum()
    bias = float(np.log((good + 1) / (total - good + 1)))
    z, made = np.full(len(x), bias), []
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-z))
        g, h = positive - n * p, n * p * (1 - p)

        def leaf(rows):
            return float(rate * g[rows].sum() / (h[rows].sum() + 1))

        def grow(rows, depth):
            best = (1e-6, None)
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for f in range(x.shape[1]) if depth else ():
                for limit in np.unique(x[rows, f])[:-1]:
                    low = rows & (x[:, f] <= limit)
                    high = rows & ~low
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - whole
                    if gain > best[0]:
                        best = (gain, (f, int(limit), low, high))
            if best[1] is None:
                return leaf(rows)
            f, limit, low, high = best[1]
            return (f, limit, grow(low, depth - 1), grow(high, depth - 1))
        tree = grow(np.ones(len(x), bool), 2)
        made.append(tree)
        z = bias + np.log(np.maximum(1e-12, (q := Trees(0.0, made, {}).value(x)))) - np.log(np.maximum(1e-12, 1 - q))
    return Trees(bias, made, {})


def calibrate(model: Trees, x: np.ndarray, n: np.ndarray, positive: np.ndarray, precision: float = PRECISION) -> None:
    """Per kind, the least score from which on the passing share is ``precision``; 0.5 at least."""
    score = model.value(x)
    for kind in range(len(KINDS)):
        own = np.flatnonzero(x[:, 0] == kind)
        own = own[np.argsort(-score[own], kind="stable")]
        share = np.cumsum(positive[own]) / np.maximum(1, np.cumsum(n[own]))
        good = np.flatnonzero(share >= precision)
        model.limits[kind] = max(0.5, float(score[own[good[-1]]])) if good.size else (0.5 if not own.size else 1.1)


def train(proposals: DataFrame) -> Trees:
    """Boosts on all proposals of the base patterns, summed per distinct feature vector."""
    names = [f"f{k}" for k in range(N_FEATURES)]
    table = proposals.where("passes is not null").groupBy(*names).agg(
        F.count("*").alias("n"), F.sum(F.col("passes").cast("long")).alias("positive")).orderBy(*names).collect()
    x = np.array([[r[k] for k in names] for r in table], int).reshape(-1, N_FEATURES)
    n, positive = np.array([r.n for r in table], float), np.array([r.positive for r in table], float)
    model = boost(x, n, positive)
    calibrate(model, x, n, positive)
    return model


def select_spans(proposals: DataFrame, model: Trees) -> DataFrame:
    """``row, kind, start, end, base``: the base, and added spans above their kind's limit
    that overlap no base span and no added one before them (of one start, the longest)."""
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in model.limits.items() for x in (k, float(v))]), F.col("kind"))
    scored = proposals.withColumn("score", model.score())
    base = (F.col("generator") < len(BASE)) & F.col("passes")
    chosen = scored.withColumn("base", base).where(F.col("base") | (~F.coalesce("passes", F.lit(False)) & (F.col("score") >= limit)))
    before = W.partitionBy("row").orderBy("start", F.desc("end"), "kind", "generator").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("row").orderBy("start", F.desc("end"), "kind", "generator").rowsBetween(1, W.unboundedFollowing)
    marked = chosen.withColumns({
        "base_end": F.max(F.when(F.col("base"), F.col("end"))).over(before), "any_end": F.max("end").over(before),
        "base_start": F.min(F.when(F.col("base"), F.col("start"))).over(after)})
    free = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce("any_end", F.lit(0)) <= F.col("start")) \
        & (F.coalesce("base_start", F.col("end")) >= F.col("end"))
    return marked.where(F.col("base") | free).select("row", "kind", "start", "end", "base")


def _text(found: Column) -> Column:
    """``kind:start:end`` in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """Rows ``row, doc_id`` of all documents, and their selected spans."""
    proposed = materialize(propose(docs, id_col, text_col), "proposals")
    proposals = materialize(spans(proposed), "spans")
    return proposed.select("row", "doc_id"), select_spans(proposals, train(proposals))


def personal_data(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and digest are of the base spans; ``spans`` has the added ones too, each
    once.  Null texts are empty: no spans, the digest of nothing.  Repeated rows and
    rows without an id are rows of their own.
    """
    rows, selected = find_spans(docs, id_col, text_col)
    span = F.struct("kind", "start", "end")
    per = selected.groupBy("row").agg(F.collect_set(F.when(F.col("base"), span)).alias("base"), F.collect_set(span).alias("all"))
    out = rows.join(per, "row", "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    base, every = F.coalesce("base", none), F.coalesce("all", none)

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_text(base), 256).alias("base_sha256"), _text(every).alias("spans"))
