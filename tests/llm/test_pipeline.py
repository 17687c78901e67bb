"""The pipeline's stages one by one, and the registered queries with SQL answers."""

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "row")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = set(texts)
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        if name == "exact_dedup":
            kept = [texts[i] for i in ids]
            assert len(set(kept)) == len(kept) and set(kept) == {texts[i] for i in seen}
        if name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(item in texts[i] for i in ids for item in items)
            assert all(i in ids or any(item.split()[3] in texts[i] for item in items) for i in seen)
        docs, seen = out, set(ids)
    encoded = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in encoded} == seen
    import hashlib
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in encoded)


def test_stages_keep_awkward_rows_as_they_came(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns named like every helper's."""
    import corpus_pipeline as pipeline
    names = ["_sha256", "__SHA256", "_row", "row", "digest", "prints", "root", "keep", "shard", "n", "word", "score"]
    long = " ".join(f"plainword{k}" for k in range(80_000))
    rows = [(None, "a text without an id"), (None, None), (1, None), (2, ""), (3, long), (4, "three four five six seven eight nine"),
            (4, "three four five six seven eight nine"), (4, "another text under the same id as before"), (5, "İ Kelvin K ſ \x00 end")]
    docs = spark.createDataFrame([(i, t, "en", "src", 1, *[f"{k}:{c}" for c in names]) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    given = {tuple(r) for r in docs.collect()}
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        kept = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and set(kept) <= given, name
        texts = {t for _, t, *_ in kept}
        assert {long, "another text under the same id as before", "a text without an id"} <= texts, name
        assert stage(spark, empty, SF).count() == 0, name
    encoded = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(encoded) == len(rows) and pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_queries_equal_their_oracles(spark):
    import check

    from pagequarry.llm import queries
    con = check.oracle(SF)
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and check.rows(got) == check.rows(want), name


@pytest.mark.parametrize("number", range(1, 14))
def test_one_query_per_operator(number):
    from pagequarry.llm import queries
    assert len([q for q in queries.QUERIES if q.startswith(f"op{number}_")]) == 1
