"""Near-duplicate texts and names, exactly."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import words
from . import overlaps
from .automaton import containing_pairs
from .shared import components, lookup_join, materialize, skew_join, union_all


#: Tokens of a word that one task pairs with each other.
BLOCK = 5_000


def copy_groups(texts: DataFrame, id_col: str, text_col: str):
    """Split texts into one representative per distinct word set, and links from
    every copy to its representative.  A group of copies stays linear.

    The word sets are written once; the copies, mostly few, are taken out whenever they are read."""
    sets = texts.select(F.col(id_col).alias("id"), words(F.lower(text_col)).alias("words")).where(F.size("words") > 0)
    keyed = materialize(sets.withColumn("key", F.unhex(F.sha2(F.array_join(F.sort_array("words"), " "), 256))), "wordsets", compression="zstd")
    reps = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    links = materialize(skew_join(keyed.select("id", "key"), reps.where("copies > 1").drop("copies"), "key", ["id"], how="inner")
                        .where("id != rep"), "copies")
    copies = links.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    member = F.struct("id", "key").alias("member")
    distinct = lookup_join(keyed.where("id IS NOT NULL").select("*", member), links.select(member).distinct(), "member", ["id"], "left_anti", kept="distinct")
    return distinct.select("id", "words"), copies


def meetings(tokens: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``tokens`` (``id, word, ...``) twice, as both sides of a join on ``place`` where all pairs with the same word meet once.

    Each side has a row per token, so what is shuffled grows with the tokens.  Only a word of more than ``block``
    tokens is cut into blocks, and each block of one side goes to each of the other, so that no task has all its pairs.
    """
    counts = tokens.groupBy("word").agg(F.count("*").alias("n_tokens"))
    hot = counts.where(F.col("n_tokens") > block).select("word", F.ceil(F.col("n_tokens") / block).cast("int").alias("blocks"))
    cut = lookup_join(tokens, hot, "word", ["id"]).withColumn("_blocks", F.coalesce("blocks", F.lit(1))).drop("blocks")
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (cut.withColumn("_other", every).withColumn("place", F.struct("word", own.alias("i"), F.col("_other").alias("j"))).drop("_blocks", "_other"),
            cut.withColumn("_other", every).withColumn("place", F.struct("word", F.col("_other").alias("i"), own.alias("j"))).drop("_blocks", "_other"))


def jaccard_pairs(sets: DataFrame, threshold: float = rules.SERVICE_SIMILARITY, block: int = BLOCK) -> DataFrame:
    """All pairs ``a < b`` of distinct word sets (``id, words``) above a Jaccard threshold, exactly.

    Words are ordered by the number of sets that hold them, so the prefixes hold
    each set's rarest words; they travel as hashes (an equal hash of two words
    only adds a candidate).

    Two sets above the threshold share a word among the first
    ``n - ceil(t n) + 1`` of each; sizes and positions bound the overlap that is
    still possible, and sketches bound the difference.  Sets that may be a pair are
    only tied together, a link each, however often they meet.  The full word sets
    travel once, to the family that they hang together in, whose pairs are compared
    there: what is shuffled does not grow with the pairs.  ``sets`` is read three times.
    """
    # Different sets this small cannot exceed the threshold: n/(n+1) is too low.
    smallest = threshold / (1 - threshold)
    sets = sets.where(F.size("words") > smallest - 1e-9).select("id", "words", F.xxhash64("id", "words").alias("node"))
    hashed = sets.select("node", overlaps.hashes("words").alias("hashes"))
    levels, sizes = overlaps.word_levels(hashed)
    parts = overlaps.shares(sizes, threshold, 2 * sets.sparkSession.sparkContext.defaultParallelism)
    links = overlaps.prefixes(hashed, levels, threshold, block, parts).repartitionById(int(parts.sum()), "part") \
        .mapInArrow(overlaps.linked(threshold), "a long, b long")
    families = components(links).withColumnRenamed("component", "word")
    tied = materialize(lookup_join(sets, families, "node", ["id"], "inner"), "families", compression="zstd")
    left, right = meetings(tied, min(block, overlaps.FAMILY))
    at = [F.col("place")[c].alias(c) for c in ("word", "i", "j")]
    # A family of one block meets itself.
    both = left.withColumn("side", F.lit(0)).unionByName(right.where("place.i != place.j").withColumn("side", F.lit(1))) \
        .select(*at, "side", "id", "node", "words")
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = sets.schema["id"].dataType.simpleString()
    return both.repartition(tasks, "word", "i", "j").sortWithinPartitions("word", "i", "j") \
        .mapInArrow(overlaps.overlapping(threshold), f"a {kind}, b {kind}, similarity double")


def near_duplicates(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Near-duplicate texts as ``kind, a, b, similarity``: ``near`` pairs of
    representatives, and a ``copy`` link from each exact copy to its representative."""
    distinct, copies = copy_groups(texts, id_col, text_col)
    return union_all(jaccard_pairs(distinct).withColumn("kind", F.lit("near")),
                     copies.withColumn("kind", F.lit("copy")))


def similar_names(names: DataFrame, col: str) -> DataFrame:
    """Pairs of distinct short strings that contain one another (0.9) or exceed
    the Jaccard threshold; ``a < b``."""
    distinct = materialize(names.select(F.lower(col).alias("s")).where("s != ''").distinct(), "names")
    other = distinct.select(F.col("s").alias("part"))
    contained = containing_pairs(other, distinct, "part", "s").where("part != s").select(
        F.least("s", "part").alias("a"), F.greatest("s", "part").alias("b"),
        F.lit(rules.CONTAINMENT_SIMILARITY).alias("similarity"))
    sets = distinct.select(F.col("s").alias("id"), words("s").alias("words")).where(F.size("words") > 0)
    # Names with the same words in another order: each is linked to the first of its group.
    groups = sets.withColumn("key", F.array_join(F.sort_array("words"), " "))
    firsts = groups.groupBy("key").agg(F.min("id").alias("first"))
    same = groups.join(firsts, "key").where("id != first").select(
        F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    near = jaccard_pairs(materialize(groups.join(firsts.select(F.col("first").alias("id")), "id", "left_semi").select("id", "words"), "sets"))
    rest = union_all(same, near).join(contained.select("a", "b"), ["a", "b"], "left_anti")
    return contained.unionByName(rest)
