"""Front ends, file sources and the change journal."""

import json

from terrace.sources import documents, files, python_code
from terrace.streaming import journal

PY = '''import os
from a.b import c as d

K = 3


class A(Base):
    @wraps("x")
    def m(self, p, q=1):
        return call(p, "text")
'''


def test_python_rows(spark):
    df = spark.createDataFrame([("a.py", PY), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    rows = [r.asDict() for r in python_code.facts(df).collect()]
    of = lambda t: [(r["name"], r["qualname"], r["detail"]) for r in rows if r["tbl"] == t]
    assert of("imports") == [("os", "os", "os"), ("d", "d", "a.b:c")]
    assert of("functions") == [("m", "A.m", "")] and of("classes") == [("A", "A", "Base")]
    assert of("parameters")[2] == ("q", "A.m", "1") and of("decorators") == [("wraps", "A.m", "'x'")]
    assert [c[:2] for c in of("calls")][:2] == [("wraps", "A"), ("call", "A.m")] and ("K", "K", "3") in of("consts")
    assert {r["path"]: r["detail"] for r in rows if r["tbl"] == "files"}["bad.py"] == "error: SyntaxError"
    assert {r["path"]: r["n_lines"] for r in python_code.source_lines(df.filter("content is not null")).collect()}["a.py"] == 7


def test_markdown(spark):
    text = "intro\n# One\na\n## Two\n```\n# not a heading\n```\nb [x](../y.md#z) [w](http://q)\n# Three\nc"
    df = spark.createDataFrame([("d/a.md", text)], "path string, content string")
    got = [(r["level"], r["section"], r["text"]) for r in documents.sections(df).orderBy("line").collect()]
    assert got[0] == (0, "", "intro") and (2, "One > Two", "# not a heading") in got and got[-1] == (1, "Three", "c")
    status = documents.link_status(documents.links(df), spark.createDataFrame([("x.md",)], "path string")).collect()
    assert [tuple(r) for r in status] == [("d/a.md", "y.md", "missing")]


def test_sql_text(spark):
    rows = documents.sql_operators(spark, [("ok", "SELECT a FROM t WHERE b = 1"), ("bad", "SELECT TOP 5 FROM x y z")]).collect()
    assert {r["operator"] for r in rows if r["id"] == "ok"} >= {"Project", "Filter"} and {r["operator"] for r in rows if r["id"] == "bad"} == {"unparsed"}


def test_record_lines(spark):
    df = spark.createDataFrame([("MAP-STEP|a|b",), ("noise",), ("MAP-FINDING|x|1|2|3|4|5",)], "value string")
    got = files.record_lines(df)
    assert {(r["kind"], r["f1"], r["f5"]) for r in got.collect()} == {("STEP", "a", None), ("FINDING", "x", "4|5")}
    assert files.unfinished(got).count() == 1


def test_trace(spark):
    span = lambda i, p, a, b: {"traceId": "t", "spanId": i, "parentSpanId": p, "name": i, "startTimeUnixNano": str(a), "endTimeUnixNano": str(b)}
    line = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span("r", "", 0, 10_000_000), span("c", "r", 0, 4_000_000)]}]}]})
    df = spark.createDataFrame([(line,), (line[:40],), ("",)], "value string")
    assert {r["name"]: r["untraced_ms"] for r in files.untraced(files.spans(df)).collect()} == {"r": 6.0}
    assert tuple(files.torn_lines(df).first()) == (1, 1)


def test_tree_and_slices(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.py").write_text("1")
    (root / "y.log").write_text("2")
    got = files.tree(spark, str(root), ("*.log",))
    assert [r["path"] for r in got.collect()] == ["a/x.py"]
    assert [r["glob"] for r in files.unmatched(spark, got, ("**/*.py", "*.zip")).collect()] == ["*.zip"]
    assert files.sliced({"t": got}, spark.createDataFrame([("a/x.py",)], "path string"), "path")["t"].count() == 1


def test_journal_refresh(spark, tmp_path):
    folder = tmp_path / "journal"
    folder.mkdir()
    seen = []

    def run():
        stream = journal.read_journal(spark, str(folder), 1)
        journal.refresh(stream, str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, n: seen.append(sorted(r["path"] for r in df.collect()))).trigger(availableNow=True).start().awaitTermination()

    entry = lambda s, p, h: json.dumps({"seq": s, "path": p, "hash": h})
    (folder / "1.json").write_text("\n".join([entry(1, "a", "x"), entry(2, "b", "y"), entry(3, "b", "z")]))
    run()
    (folder / "2.json").write_text("\n".join([entry(4, "a", "x"), entry(5, "b", None), entry(6, "c", "w")]))
    run()
    assert seen == [["a", "b"], ["b", "c"]]
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "state" / "v1")).collect()} == {("a", "x"), ("c", "w")}
