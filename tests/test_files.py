"""Sources and sinks on real files."""

import json

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import report
from pagequarry.operators.shared import ranked
from pagequarry.sources import files


def test_lead_csv_null_tokens_and_rejects(spark, tmp_path):
    (tmp_path / "l.csv").write_text('url,email,services,more\n x.example.com ,NA,"a; ""b"", c",1\n,x@example.com,none,NULL\nhttp://y.example.com,null,,-\n')
    good, bad = files.split_rejects(files.lead_scan(spark, str(tmp_path / "l.csv")))
    rows = good.orderBy("row_idx").collect()
    assert [(r.url, r.email, r.services, r.more, r.logo) for r in rows] == [
        ("https://x.example.com", None, 'a; "b", c', "1", None), ("http://y.example.com", None, None, "-", None)]
    assert [(r.email, r.services, r.more) for r in bad.collect()] == [("x@example.com", "none", None)]


def test_lead_csv_needs_a_url_column(spark, tmp_path):
    (tmp_path / "l.csv").write_text("site\nx\n")
    with pytest.raises(ValueError):
        files.lead_scan(spark, str(tmp_path / "l.csv"))


def test_upload_without_header(spark, tmp_path):
    (tmp_path / "l.csv").write_text("a.example.com,x\nb.example.com,y\n")
    rows = files.lead_upload(spark, str(tmp_path / "l.csv")).orderBy("row_idx").collect()
    assert [r.url for r in rows] == ["https://a.example.com", "https://b.example.com"]


def test_row_order_over_many_splits_and_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p {i} ü%20.txt").write_text("".join(f"{i}-{j}\n" for j in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = files.text_log_scan(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        rows = ranked(df, "pos", name="n").orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == [f"{i}-{j}" for i in range(3) for j in range(2000)]
    assert [r.n for r in rows] == list(range(1, 6001))


def test_json_maps(spark, tmp_path):
    value = "struct<main_folder:string,inner_folder:string,domain:string>"
    (tmp_path / "m.json").write_text(json.dumps({"a": {"main_folder": "1", "domain": "d"}, "b": {"inner_folder": "2"}}, indent=2))
    (tmp_path / "bad.json").write_text("{oops")
    got = files.json_map_scan(spark, str(tmp_path / "m.json"), value, whole_file=True).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("a", "1", None, "d"), ("b", None, "2", None)]
    assert files.json_map_scan(spark, str(tmp_path / "bad.json"), value, whole_file=True).count() == 0
    assert files.json_map_scan(spark, str(tmp_path / "absent.json"), value).count() == 0


def test_deploy_log_array_file_with_three_result_shapes(spark, tmp_path):
    log = [{"timestamp": "2024-01-02 03:04:05", "success": True, "result": {"s": "https://a.example.com"}, "server": "h"},
           {"timestamp": "2024-01-02 03:04:06", "success": True, "result": "{'s': {'modern': 'https://b.example.com'}}"},
           {"timestamp": "bad", "success": False, "result": "login failed"}]
    (tmp_path / "log.json").write_text(json.dumps(log))
    rows = files.deploy_results(files.deploy_log_scan(spark, str(tmp_path / "log.json"))).orderBy("pos").collect()
    assert [(r.site, r.style, r.url) for r in rows] == [
        ("s", None, "https://a.example.com"), ("s", "modern", "https://b.example.com"), (None, None, None)]
    assert rows[2].timestamp is None and rows[2].success is False


def test_artifact_tree(spark, tmp_path):
    for path in ["website_templates_20240101-000000/A/modern/index.html", "website_templates_20240101-000000/A/elegant/index.html",
                 "website_templates_20240101-000000/__pycache__/modern/x.pyc", "other/file.txt"]:
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    found = files.artifact_scan(files.artifact_listing(spark, str(tmp_path)))
    assert [tuple(r) for r in report.styles_per_site(found).collect()] == [
        ("website_templates_20240101-000000", "A", ["elegant", "modern"])]


def test_decoded_body(spark):
    from pagequarry.sources.pages import decoded_body
    df = spark.createDataFrame([(bytearray("ü".encode()), "text/html"), (bytearray("ü".encode("latin-1")), "text/html; charset=ISO-8859-1")],
                               "b binary, t string")
    assert [r[0] for r in df.select(decoded_body(F.col("b"), F.col("t"))).collect()] == ["ü", "ü"]
