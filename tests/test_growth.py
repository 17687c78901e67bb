"""Work that must grow with the rows: tables in folders, splits of each input, expressions computed once."""

import glob
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import automaton, matching, overlaps, records
from pagequarry.plans import extraction, maintenance
from pagequarry.sources import files, sinks
from pagequarry.streaming import streams


def page(k):
    return k, f"https://a{k}.example.com/", f"<title>A{k}</title>"


def customers(spark, folder, n):
    rows = spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{folder}/customer.parquet")


def test_a_table_in_a_folder_is_a_stream(spark, tmp_path):
    rows = [page(k) for k in range(20)] + [(20, "http://known.example.com/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    arriving = streams.table_stream(spark, str(tmp_path), "pages")
    known = spark.createDataFrame([("http://known.example.com/",)], "url string")
    assert sorted(r.url for r in streams.new_urls(arriving, known).collect()) == sorted(page(k)[1] for k in range(20))


def test_a_table_in_one_file_is_a_stream(spark, tmp_path):
    import pandas as pd
    pd.DataFrame([page(1), page(2)], columns=["page_id", "url", "html"]).to_parquet(f"{tmp_path}/pages.parquet")
    pd.DataFrame({"n": [1]}).to_parquet(f"{tmp_path}/other.parquet")
    found = streams.new_urls(streams.table_stream(spark, str(tmp_path), "pages"), spark.createDataFrame([], "url string"))
    assert sorted(r.url for r in found.collect()) == [page(1)[1], page(2)[1]]


def test_names_spread_each_input(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.createDataFrame([page(k) for k in range(40)], "page_id long, url string, html string").repartition(2 * cores) \
        .write.parquet(f"{tmp_path}/pages.parquet")
    customers(spark, tmp_path, 10)
    assert extraction.name_best(spark, str(tmp_path)).rdd.getNumPartitions() >= 2 * cores


def test_contact_pages_are_spread(spark, tmp_path, monkeypatch):
    customers(spark, tmp_path, 10)
    seen = []
    monkeypatch.setattr(records, "scrape_records", lambda pages, corpus: seen.append(corpus) or pages)
    extraction.scrape_record_sites(spark, str(tmp_path))
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_services_are_computed_once(spark, tmp_path):
    customers(spark, tmp_path, 10)
    found = extraction.services_dedup(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "aggregate(" in line]
    assert {(r.page_id, r.service, r.pos) for r in found.where("page_id = 2").collect()} == {(2, "Roofing 1", 1), (2, "Tiling 1", 2)}


def test_frequent_words_are_cut_into_blocks_and_all_pairs_are_found(spark):
    texts = {k: " ".join(f"w{(k + i) % 60}" for i in range(24 + k % 3)) for k in range(120)}
    sets = matching.copy_groups(spark.createDataFrame(texts.items(), "id long, text string"), "id", "text")[0]
    rows = {r.id: set(r.words) for r in sets.select("id", "words").collect()}
    wanted = {(a, b) for a in rows for b in rows if a < b and len(rows[a] & rows[b]) / len(rows[a] | rows[b]) > 0.8}
    assert wanted
    for block in (3, 10_000):
        assert {(r.a, r.b) for r in matching.jaccard_pairs(sets, 0.8, block).collect()} == wanted


def test_pairs_shuffle_each_token_once_a_side(spark):
    tokens = spark.range(400).select("id", F.pmod("id", F.lit(2)).alias("word"))
    for block, times in ((500, 1), (100, 2)):
        left, right = matching.meetings(tokens, block)
        assert left.count() == right.count() == 400 * times
        pairs = left.select("place", F.col("id").alias("a")).join(right.select("place", F.col("id").alias("b")), "place")
        assert pairs.count() == pairs.distinct().count() == 2 * 200 * 200


def family(n, words=60, seed=3):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    return [" ".join(f"x{k}-{w}" if i in gone else w for i, w in enumerate(base)) for k in range(n) for gone in [set(rng.sample(range(words), 3))]]


def near(texts):
    """Pairs of representatives by brute force, each once."""
    first = {}
    for i, t in sorted(texts):
        if t.split():
            first[frozenset(t.lower().split())] = min(i, first.get(frozenset(t.lower().split()), i))
    return sorted((min(a, b), max(a, b), round(len(x & y) / len(x | y), 9)) for (x, a), (y, b) in itertools.combinations(first.items(), 2)
                  if a != b and len(x & y) / len(x | y) > 0.8)


def found(spark, texts):
    rows = matching.near_duplicates(spark.createDataFrame(texts, "id long, text string"), "id", "text").collect()
    return sorted((r.a, r.b, round(r.similarity, 9)) for r in rows if r.kind == "near")


def test_pairs_of_a_family_are_not_written(spark, monkeypatch):
    texts, written, write = list(enumerate(family(150))), {}, matching.materialize

    def counted(df, name, **options):
        out = write(df, name, **options)
        written[name] = out.count()
        return out
    monkeypatch.setattr(matching, "materialize", counted)
    got = found(spark, texts)
    assert got == near(texts) and len(got) == 150 * 149 // 2
    assert max(written.values()) <= 150


def test_texts_that_come_twice_are_paired_once(spark):
    rng = random.Random(8)
    texts = list(enumerate(family(12) + family(6, seed=5)))
    texts += rng.sample(texts, 9) + [(None, texts[0][1]), (None, "only here " + texts[0][1]), (30, None), (31, ""), (40, texts[3][1].upper())]
    assert found(spark, texts) == near([(i, t) for i, t in texts if i is not None and t]) != []


@pytest.mark.parametrize("pairs, rows, block", [(7, 3, 4), (500_000, 2_000, 5_000)])
def test_pairs_across_chunks_blocks_and_sizes_equal_brute_force(spark, monkeypatch, pairs, rows, block):
    monkeypatch.setattr(overlaps, "PAIRS", pairs)
    monkeypatch.setattr(overlaps, "ROWS", rows)
    monkeypatch.setattr(overlaps, "TOKENS", pairs)
    monkeypatch.setattr(overlaps, "STEPS", np.array([10, 20, *(40 << k for k in range(12))]))
    rng = random.Random(pairs)
    sets = []
    for _ in range(40):
        words = rng.sample(range(150), rng.randint(4, 60))
        sets += [frozenset(words)] + [frozenset(words[:-rng.randint(1, 4)]) | {rng.randrange(150)} for _ in range(rng.randrange(5))]
    texts = {f"s{i:03}": " ".join(f"w{w}" for w in s) for i, s in enumerate(set(sets))}
    df = spark.createDataFrame([(i, t.split()) for i, t in texts.items()], "id string, words array<string>")
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in matching.jaccard_pairs(df, 0.8, block).collect())
    assert got == near(texts.items()) and len(got) > 20


def test_sketches_never_differ_by_more_than_the_words():
    rng = np.random.default_rng(4)
    words, sets = rng.integers(0, 1 << 63, 3000).astype(np.uint64), []
    for n in (60, 75, 85, 100, 170, 200, 400, 450, 890, 950, 1900):
        sets += [rng.permutation(3000)[:n], np.arange(n)]
    n = np.array([len(x) for x in sets])
    known = overlaps.Sketches(*overlaps.sketches(words[np.concatenate(sets)], np.repeat(np.arange(len(n)), n), n))
    for a, b in itertools.combinations(range(len(n)), 2):
        apart = len(set(sets[a]) ^ set(sets[b]))
        assert known.differing(np.array([a]), np.array([b]))[0] <= apart
    same, other = np.arange(1, len(n), 2), np.arange(0, len(n), 2)
    assert (known.differing(same[:-1], same[1:]) <= np.diff(n[same])).all() and (known.differing(same, other) > 0.25 * n[same]).all()


def test_a_deployment_log_is_written_in_ranges_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintenance, "LOG_KEYS", 100)
    paths = []
    scan = files.deploy_log_scan
    monkeypatch.setattr(files, "deploy_log_scan", lambda spark, path: paths.append(path) or scan(spark, path))
    spark.sql("SELECT id AS o_orderkey, DATE'2024-02-01' AS o_orderdate, 'F' AS o_orderstatus FROM range(950, 1350)") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    log = maintenance._deploy_log(spark, str(tmp_path))
    assert [r.target_directory for r in log.collect()] == ['/srv/{["}'] * 400
    ids = [int(r.id) for r in log.orderBy("pos").select(F.regexp_extract("result", "site([0-9]+)", 1).alias("id")).collect()]
    assert ids == list(range(950, 1350))
    assert len(glob.glob(f"{paths[0]}/**/*.txt", recursive=True)) == 5


def test_pages_are_rendered_by_many_tasks_without_a_sort(spark, tmp_path, monkeypatch):
    customers(spark, tmp_path, 50)
    paths = []
    write = sinks.write_pages
    monkeypatch.setattr(sinks, "write_pages", lambda pages, path: paths.append(path) or write(pages, path))
    assert maintenance.rendered_pages(spark, str(tmp_path)).groupBy("style").count().select("count").distinct().collect() == [(50,)]
    assert len(glob.glob(f"{paths[0]}/style=modern/*.parquet")) > 1


def test_contained_names_are_dealt_to_all_cores(spark):
    names = spark.createDataFrame([(f"name {k}", k) for k in range(100)], "s string, k long").coalesce(1)
    for once in (automaton._distinct(names, "s"), automaton._distinct(names, "s", "k")):
        assert once.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert automaton.first_contained(names.select(F.concat("s", F.lit(" x")).alias("t")), names, "t", "s", "k").count() == 100
