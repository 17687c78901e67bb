"""Joins, ranks, matching and folder names against brute force, with hot keys and small ranges."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import automaton, greedy, maintain, matching
from pagequarry.operators.shared import lookup_join, measured, ranked, running_total, shared_folder, skew_join


def test_skew_join_equals_plain_join(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, None)
                                    .otherwise((F.col("id") % 100).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("7", 2), ("none", 3)], "k string, v int")
    for how in ("left", "inner", "left_anti", "left_semi"):
        for spread_by in (["id"], None):
            a, b = skew_join(left, right, "k", spread_by, how), left.join(right, "k", how)
            assert sorted(map(repr, a.select(b.columns).collect())) == sorted(map(repr, b.collect()))


def test_a_hot_key_reaches_all_partitions(spark):
    left = spark.range(80_000).select("id", F.lit("hot").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew_join(left, spark.createDataFrame([("hot",)], "k string"), "k", ["id"], "inner")
        rows = plan.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) > 3 and max(r["count"] for r in rows) < 50_000


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:  # what shared_folder asks of a session
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_total_and_rank_over_ranges(spark, width):
    rows = [(i * 3 - 50, "a" if i % 3 else "b", i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "o long, k string, v int")
    want, sums = {}, {"a": 0, "b": 0}
    for o, k, v in rows:
        sums[k] += v
        want[o] = sums[k]
    assert {r.o: r.total for r in running_total(df, "o", F.col("v"), ["k"], width=width).collect()} == want
    assert {r.o: r["rank"] for r in ranked(df, "o", width=width).collect()} == {o: i + 1 for i, (o, _, _) in enumerate(rows)}


def test_rank_counts_rows_without_a_key(spark):
    rows = [(i, None if i % 2 else "a") for i in range(10)]
    df = spark.createDataFrame(rows, "o long, k string")
    assert {r.o: r["rank"] for r in ranked(df, "o", ["k"], width=3).collect()} == {i: i // 2 + 1 for i in range(10)}


def sequential(names):
    used, out = set(), []
    for n in names:
        f, i = n, 1
        while f in used:
            f, i = f"{n}_{i}", i + 1
        used.add(f)
        out.append(f)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_folders_equal_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    pool = ["X", "X_1", "X_2", "X_3", "X_5", "X_1_1", "X_1_2", "X_01", "Y", "Y_1", "Z_9", "X_2_1", "X_1_1_1", "_1", "X_"]
    weights = [rng.random() ** 2 + 0.02 for _ in pool]
    names = rng.choices(pool, weights, k=rng.randint(20, 120))
    if seed % 2:
        names += [f"X_{rng.randint(1, 60)}" for _ in range(40)]
        rng.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, name string")
    got = [r.folder for r in maintain.unique_folders(df, width=[3, 1000][seed // 3]).orderBy("row_idx").collect()]
    assert got == sequential(names)


def test_a_long_chain_of_numbered_names(spark):
    rng = random.Random(2)
    names = ["name"] * 3000 + [f"name_{k}" for k in range(1, 10_001)]
    rng.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, name string")
    got = maintain.unique_folders(df, width=700).orderBy("row_idx").collect()
    assert [r.folder for r in got] == sequential(names)


@pytest.mark.parametrize("width", [1, 4, 50, 1000])
def test_taken_before_equals_the_loop(spark, width):
    rng = random.Random(width)
    rows = [(g, o * 7 - 100, rng.randint(-3, n // 2 + 2)) for g, n in (("a", 200), ("b", 3), ("c", 90)) for o in range(n)]
    want, counts = {}, {}
    for g, o, room in rows:
        want[g, o] = counts.setdefault(g, 0)
        counts[g] += want[g, o] < room
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, o long, room long")
    got = greedy.taken_before(df, "g", "o", "room", width).collect()
    assert {(r.g, r.o): r.taken for r in got} == want and len(got) == len(rows)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_duplicates_equal_brute_force_with_a_hot_copy_group(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(150)]
    for _ in range(100):
        words = rng.choice(docs).split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append(" ".join(words))
    docs += ["the hot copy of all things we know"] * 120 + ["", "  "]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = matching.near_duplicates(df, "doc_id", "text").collect()
    sets = {i: frozenset(t.lower().split()) for i, t in enumerate(docs) if t.split()}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    reps = sorted(first.values())
    near = {(a, b) for a in reps for b in reps if a < b and jaccard(sets[a], sets[b]) > 0.8}
    copies = {(first[s], i) for i, s in sets.items() if first[s] != i}
    assert {(r.a, r.b) for r in got if r.kind == "near"} == near and near
    assert {(r.a, r.b) for r in got if r.kind == "copy"} == copies


@pytest.mark.parametrize("block, share", [(10_000, 10_000), (40, 50), (200, 30)])
def test_first_overlap_equals_brute_force(spark, block, share):
    rng = random.Random(9)
    strings = lambda n: ["".join(rng.choices("ab.ü", k=rng.randint(0, 6))) for _ in range(n)]
    left, right = strings(150), strings(80)
    a = spark.createDataFrame([(s,) for s in left], "a string")
    b = spark.createDataFrame(list(enumerate(right)), "o long, b string")
    want = {}
    for s in set(left) - {""}:
        hits = [i for i, t in enumerate(right) if t and (s in t or t in s)]
        if hits:
            want[s] = min(hits)
    assert {r.a: r.o for r in automaton.first_overlap(a, b, "a", "b", "o", block, share).collect()} == want


def test_a_family_that_shares_every_gram(spark):
    rng = random.Random(4)
    names = ["biz haus " + "".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(1500)]
    a = spark.createDataFrame([(n,) for n in names] + [("",), (None,)], "a string")
    b = spark.createDataFrame(list(enumerate(names)) + [(5000, ""), (5001, None)], "o long, b string")
    distinct = set(names)
    want = {(s, t) for s in distinct for t in distinct if s in t}
    got = automaton.containing_pairs(a, b, "a", "b", block=2000, share=3000).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_automaton_strings_too_long_for_a_trie(spark):
    long = "x" * (automaton.LONG + 1)
    a = automaton.Automaton([long, "x", "ü😀"])
    assert set(a.pairs(["yx", "😀", "aü😀", long + "y"])) == {("x", "yx"), ("ü😀", "aü😀"), ("x", long + "y"), (long, long + "y")}
    assert dict(a.first_inside([7, 8, 9], [long, "ü😀x", "none"])) == {long: 7, "ü😀x": 8}
    assert dict(a.first_holder(["ax", long, "x"], [3, 2, 5])) == {"x": 2, long: 2}


def test_subdomains_keep_place_and_last_entry(spark):
    old = spark.createDataFrame([("a", 1, "p", "old", True, "d", "r", "u"), ("b", 2, "p", "old", True, "d", "r", "u")],
                                "subdomain string, position long, website_path string, style string, active boolean, date_added string, document_root string, url string")
    new = spark.createDataFrame([(1, "c", "p1", "s1", True, "d"), (2, "b", "p2", "s2", False, "d"), (3, "c", "p3", "s3", True, "d"), (4, "", "p", "s", True, "d")],
                                "seq long, subdomain string, website_path string, style string, active boolean, date_added string")
    got = {r.subdomain: (r.position, r.style, r.active) for r in maintain.upsert_subdomains(old, new).collect()}
    assert got == {"a": (1, "old", True), "b": (2, "s2", False), "c": (3, "s3", True)}


def test_a_lookup_is_sent_or_salted_by_its_size(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, None)
                                    .otherwise((F.col("id") % 100).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("7", None), ("none", 3)], "k string, v int")
    empty = right.where("k = 'absent'")
    for how in ("left", "inner", "left_anti", "left_semi"):
        for table in (right, empty):
            expected = left.join(table, "k", how)
            for limit in (None, 0):
                got = lookup_join(left, table, "k", ["id"], how, limit)
                assert sorted(map(repr, got.select(expected.columns).collect())) == sorted(map(repr, expected.collect()))
    small, size = measured(right)
    assert small.count() == 3 and 0 < size < 1000 and measured(empty)[1] == 0
    assert "BroadcastHashJoin" in lookup_join(left, right, "k")._jdf.queryExecution().toString()
