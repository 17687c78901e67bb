"""Balanced label propagation: linked documents gather in few shards of equal row counts.

Labels are shards.  A round counts, for each group of linked documents, its rows
per shard; the fullest shards become its homes (one, or as many as its rows need
at the capacity of a shard), and rows elsewhere ask to move there.  Requests are
granted under quotas: the free places of the target, and exchanges with rows that
ask to go the other way.  Documents without links fill what is left, so that row
counts differ by one at most whatever the links.

Only linked rows take part in the rounds, as (row, group, shard).  The driver sees
the flows between shards, at most the square of their number.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, skew_join

SHARDS, ROUNDS = 24, 12
_ROW_BITS = 33  # of monotonically_increasing_id


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a gapless number from 0 in the order of partitions and rows.

    The rows are written once with their place; the running total over
    partitions has one row per partition.
    """
    placed = materialize(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy(F.shiftright("_at", _ROW_BITS).alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("_part", F.shiftright("_at", _ROW_BITS)).join(offsets, "_part") \
        .withColumn(name, F.col("_before") + inside).drop("_part", "_at", "_before")


def ranked_within(df: DataFrame, keys: list[str], sizes: dict, name: str) -> DataFrame:
    """Adds a gapless number from 0 within each of a few keys with known sizes.

    Rows are range-partitioned by key and row, so a key of any size spreads over tasks.
    """
    ordered = df.repartitionByRange(*keys, "row").sortWithinPartitions(*keys, "row")
    start, total = {}, 0
    for k in sorted(sizes):
        start[k], total = total, total + sizes[k]
    key = F.concat_ws(":", *keys)
    entries = [F.lit(x) for k, v in start.items() for x in (":".join(map(str, k)), v)]
    return numbered(ordered, name).withColumn(name, F.col(name) - F.element_at(F.create_map(*entries), key)) \
        if start else df.withColumn(name, F.lit(0).cast("long"))


def quotas(flows: dict, free: dict) -> dict:
    """Granted moves per (from, to): exchanges first, then the free places of each target in equal parts.

    Places that a round frees are given away in the next one, so no shard ever
    holds more linked rows than its capacity.
    """
    granted = {(i, j): min(n, flows.get((j, i), 0)) for (i, j), n in flows.items()}
    for j in {j for _, j in flows}:
        asks = sorted((n - granted[i, j], i) for (i, k), n in flows.items() if k == j)
        left = free.get(j, 0)
        for at, (n, i) in enumerate(asks):
            part = min(n, left // (len(asks) - at))
            granted[i, j] += part
            left -= part
    return {k: n for k, n in granted.items() if n}


def propagate(state: DataFrame, capacity: dict, rounds: int = ROUNDS) -> DataFrame:
    """Final ``row, group, shard`` of linked rows.  Stops when nothing can move."""
    least = max(1, min(capacity.values()))
    for turn in range(rounds):
        counts = state.groupBy("group", "shard").agg(F.count("*").alias("n"))
        order = F.sort_array(F.collect_list(F.struct(
            (-F.col("n")).alias("n"), F.xxhash64("group", "shard").alias("tie"), F.col("shard").alias("shard"))))
        # Once the fullest shards are full of the group itself, further homes open.
        need = F.least(F.size("by"), F.ceil(F.col("rows") / least).cast("int"))
        homes = counts.groupBy("group").agg(order.alias("by"), F.sum("n").alias("rows")) \
            .select("group", F.slice(F.transform("by", lambda x: x["shard"]), F.lit(1), need).alias("homes"))
        pick = F.pmod(F.xxhash64(F.lit(turn), "row"), F.size("homes").cast("long")).cast("int") + 1
        target = F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(F.element_at("homes", pick))
        asked = materialize(skew_join(state, homes, "group", ["row"], "inner").select(
            "row", "group", "shard", target.alias("target")), "asked")
        held = {r.shard: r.n for r in asked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        flows = {(r.shard, r.target): r.n for r in asked.where("shard != target").groupBy("shard", "target")
                 .agg(F.count("*").alias("n")).collect()}
        granted = quotas(flows, {s: n - held.get(s, 0) for s, n in capacity.items()})
        if not granted:
            return state
        moves = ranked_within(asked.where("shard != target"), ["shard", "target"], flows, "turn")
        entries = [F.lit(x) for (i, j), n in granted.items() for x in (f"{i}:{j}", n)]
        most = F.coalesce(F.element_at(F.create_map(*entries), F.concat_ws(":", "shard", "target")), F.lit(0))
        moved = moves.select("row", "group", F.when(F.col("turn") < most, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        state = materialize(asked.where("shard = target").select("row", "group", "shard").unionByName(moved), "labels")
    return state


def capacities(rows: int, shards: int) -> dict:
    return {s: rows // shards + (s < rows % shards) for s in range(shards)}


def assign_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``shard int, slot long`` to rows with a column ``group`` (null: no links).

    Counts per shard differ by one at most; slots are gapless from 0.  Rows are
    told apart by their place, so repeated rows and null ids are fine.
    """
    placed = materialize(numbered(rows, "row"), "rows")
    n = placed.count()
    capacity = capacities(n, shards)
    sizes = placed.where("group is not null").groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    start = placed.select("row", "group", F.pmod("row", F.lit(shards)).cast("int").alias("shard"))
    linked = materialize(skew_join(start, sizes, "group", ["row"], "left_semi"), "linked")
    state = propagate(linked, capacity, rounds)
    held = {(r.shard,): r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    done = ranked_within(state.select("row", "shard"), ["shard"], held, "slot").select("row", "shard", "slot")
    # Rows without links fill the shards up, in order.
    rest = numbered(placed.select("row").join(linked.select("row"), "row", "left_anti"), "at")
    ends, total, pieces = [], 0, []
    for s in range(shards):
        taken = held.get((s,), 0)
        pieces.append((total, s, taken))
        total += capacity[s] - taken
        ends.append(total)
    chosen = F.struct(*[F.lit(x).cast("long").alias(k) for x, k in zip(pieces[-1], "bst")])
    for end, piece in reversed(list(zip(ends, pieces))[:-1]):
        chosen = F.when(F.col("at") < end, F.struct(*[F.lit(x).cast("long").alias(k) for x, k in zip(piece, "bst")])).otherwise(chosen)
    filled = rest.withColumn("_c", chosen).select("row", F.col("_c.s").cast("int").alias("shard"), (F.col("at") - F.col("_c.b") + F.col("_c.t")).alias("slot"))
    return placed.join(done.unionByName(filled), "row").drop("row")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Documents with equal texts are linked (null and empty texts are equal).
    ``size`` is the UTF-8 length plus 8.  The law is ``rows``: counts differ by one
    at most.  Fewer documents than shards leave shards empty.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    return assign_shards(rows, shards, rounds).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
