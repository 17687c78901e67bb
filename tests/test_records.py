"""Records longer than a line, cut from files in many ranges, against whole-file readers."""

import csv
import io
import json
import random
from contextlib import contextmanager

import pytest

from pagequarry.sources import files


@contextmanager
def ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def cell(rnd):
    return "".join(rnd.choice(['a', 'é', ',', '"', '""', '\n', '\r\n', ' ', ';', '{', '\\']) for _ in range(rnd.randrange(0, 9)))


@pytest.mark.parametrize("size", [17, 400, 100_000])
def test_csv_equals_the_csv_module(spark, tmp_path, size):
    rnd = random.Random(size)
    (tmp_path / "in").mkdir()
    want = []
    for f in range(3):
        rows = [["url", "note", "Größe"]] + [["http://x.example.com", cell(rnd), cell(rnd) + "."] for _ in range(60)]
        out = io.StringIO(newline="")
        csv.writer(out, quoting=rnd.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]), lineterminator=rnd.choice(["\n", "\r\n"])).writerows(rows)
        text = out.getvalue()
        if f == 1:
            text = "\ufeff" + "\n\n" + text.replace('\nhttp', '\n  \nhttp') + "\n\n"
        (tmp_path / "in" / f"part {f}.csv").write_text(text, newline="", encoding="utf-8")
        read = list(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")))
        want += [r for r in read if any(c.strip() for c in r)][1:]
    with ranges(spark, size):
        got = files.lead_scan(spark, str(tmp_path / "in")).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(len(want)))
    none = {"", "N/A", "n/a", "NA", "null", "NULL", "None", "nan", "NaN"}
    assert [(r.note or "", r["Größe"]) for r in got] == [("" if r[1] in none else r[1], r[2]) for r in want]


def test_one_long_cell_over_many_ranges(spark, tmp_path):
    long = "line, \"quoted\"\n" * 5000
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["url", "note"], ["a.example.com", "x"], ["b.example.com", long + "."], ["c.example.com", "y"]])
    (tmp_path / "l.csv").write_text(out.getvalue(), newline="")
    with ranges(spark, 5000):
        got = files.lead_scan(spark, str(tmp_path / "l.csv")).orderBy("row_idx").collect()
    assert [(r.url, r.note) for r in got] == [("https://a.example.com", "x"), ("https://b.example.com", long + "."), ("https://c.example.com", "y")]


def test_stray_quotes_and_an_open_last_cell(spark, tmp_path):
    (tmp_path / "l.csv").write_text('url,note\na.example.com,5" pipe\nb.example.com,x"y"z\nc.example.com,"open\nto the end')
    for size in (8, 1000):
        with ranges(spark, size):
            got = files.lead_scan(spark, str(tmp_path / "l.csv")).orderBy("row_idx").collect()
        assert [r.note for r in got][:2] == ['5" pipe', 'x"y"z'] and len(got) == 3 and "to the end" in got[2].note


def test_empty_and_ragged_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert files.lead_scan_headerless(spark, str(tmp_path / "empty.csv")).count() == 0
    with pytest.raises(ValueError):
        files.lead_scan(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "r.csv").write_text('id,url,url\n1\n2,"b.example.com",x,more\n\n3,"c\n.example.com"\n')
    assert files.header_names(files.csv_records(spark, str(tmp_path / "r.csv"))) == ["id", "url1", "url2"]
    (tmp_path / "q.csv").write_text('id,"url"\n1\n2,"b.example.com",x,more\n\n3,c.example.com\n')
    got = files.lead_scan_lenient(spark, str(tmp_path / "q.csv")).orderBy("row_idx").collect()
    assert [r.url for r in got] == ["https://b.example.com", "https://c.example.com"]


def value(rnd, deep=0):
    kinds = [lambda: rnd.choice(['}', '{"', '\\', '"', '\\"}', "[", "]", "é", "\n"]) * rnd.randrange(1, 4), lambda: rnd.randrange(9), lambda: None]
    if deep < 3:
        kinds += [lambda: {value(rnd, 9) or "k": value(rnd, deep + 1) for _ in range(rnd.randrange(3))}, lambda: [value(rnd, deep + 1) for _ in range(rnd.randrange(3))]]
    got = rnd.choice(kinds)()
    return str(got) if deep == 9 else got


@pytest.mark.parametrize("size", [13, 300, 100_000])
def test_json_arrays_and_objects_equal_the_json_module(spark, tmp_path, size):
    rnd = random.Random(size)
    logs = [[{"timestamp": f"2024-01-02 03:04:{k % 60:02d}", "success": True, "result": value(rnd), "server": str(value(rnd, 9))} for k in range(n)] for n in (70, 0, 1, 40)]
    forms = [lambda x: json.dumps(x), lambda x: " \n" + json.dumps(x, indent=2), lambda x: json.dumps(x, ensure_ascii=False),
             lambda x: "\n".join(json.dumps(r) for r in x) + "\n"]
    (tmp_path / "in").mkdir()
    for k, (log, form) in enumerate(zip(logs, forms, strict=True)):
        (tmp_path / "in" / f"{k}.json").write_text(form(log), encoding="utf-8")
    with ranges(spark, size):
        got = files.deploy_log_scan(spark, str(tmp_path / "in")).orderBy("pos").collect()
    want = [r for log in logs for r in log]
    assert [r.pos for r in got] == list(range(len(want)))

    def plain(x):
        return x if x is None or isinstance(x, str) else json.dumps(x)

    def same(text, x):
        return text == x if x is None or isinstance(x, str) else json.loads(text) == json.loads(plain(x))
    assert all(same(g.result, w["result"]) and g.server == w["server"] for g, w in zip(got, want, strict=True))


def test_truncated_array(spark, tmp_path):
    (tmp_path / "log.json").write_text('[{"success": true, "server": "a"}, {"success": false, "ser')
    got = files.deploy_log_scan(spark, str(tmp_path / "log.json")).collect()
    assert [(r.success, r.server) for r in got] == [(True, "a")]


@pytest.mark.parametrize("size", [40, 3000])
def test_log_records_with_continuation_lines(spark, tmp_path, size):
    rnd = random.Random(size)
    (tmp_path / "in").mkdir()
    want = []
    for f in range(3):
        lead = ["no time", "", "still none"] if f == 1 else []
        found = ["\n".join(lead)] if lead else []
        for k in range(80):
            more = [rnd.choice(["", " * Running", "Traceback:", "2024-13-01 odd", "\tat x"]) for _ in range(rnd.choice([0, 0, 1, 3, 12]))]
            found.append("\n".join([f"2024-01-02 03:04:{k % 60:02d},{k:03d} - INFO - message {f} {k}", *more]))
        (tmp_path / "in" / f"{f}.log").write_text("\n".join(found).replace("\n", "\r\n" if f == 2 else "\n") + ("\n" if f else ""), newline="")
        want += found
    with ranges(spark, size):
        got = files.log_fields(files.log_records(spark, str(tmp_path / "in"))).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(len(want))) and [r.value for r in got] == want
    assert [r.message for r in got][0] == want[0].split(" - ", 2)[2] and sum(r.level is None for r in got) == 1

