"""Three-letter grams of strings, and the rarest of each: what a string that contains another must share with it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import skew_join

GRAM = 3


def grams(df: DataFrame, col: str, shorter: bool) -> DataFrame:
    """One row per distinct gram of a string: of ``GRAM`` letters, and with ``shorter``
    also of fewer; else a string of fewer letters is its own gram."""
    n = F.char_length(col)

    def of(size):
        at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substr(F.col(col), i, F.lit(size)))
    listed = F.concat(*[of(k) for k in range(1, GRAM + 1)]) if shorter else \
        F.when(n < GRAM, F.array(F.col(col))).otherwise(of(GRAM))
    return df.withColumn("gram", F.explode(F.array_distinct(listed)))


def rarest_grams(short: DataFrame, long: DataFrame, s: str, t: str) -> DataFrame:
    """``s, gram`` for each distinct ``s`` all of whose grams occur in some ``t``: the gram in the fewest."""
    counts = grams(long.select(t).distinct(), t, True).groupBy("gram").agg(F.count("*").alias("n"))
    own = grams(short.select(s).where(f"{s} != ''").distinct(), s, False)
    known = skew_join(own, counts, "gram", [s], "left")
    best = known.groupBy(s).agg(F.min(F.struct("n", "gram")).alias("best"), F.count_if(F.col("n").isNull()).alias("missing"))
    return best.where("missing = 0").select(s, F.col("best.gram").alias("gram"))
