"""Operators on small hand-made inputs, edge cases included."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrace.catalog import Catalog
from terrace.functions import semantics
from terrace.operators import code, folds, fulltext, gate, graph, lenses, nodes, overlap, routes, snapshot
from terrace.operators.components import connected_components

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


@given(VALUES)
@settings(max_examples=150, deadline=None)
def test_node_rows_round_trip_and_ranges(value):
    rows = nodes.walk("o", value)
    assert nodes.rebuild(rows) == value
    for _, n, parent, _, _, kind, _, last, depth in rows:
        inside = {n}
        for r in rows:
            if r[2] in inside:
                inside.add(r[1])
        assert inside == set(range(n, last + 1))
        assert (parent is None) == (depth == 0)
        assert (last == n) == (not any(r[2] == n for r in rows))


def test_flatten_nested_null_and_broken(spark):
    df = spark.createDataFrame([(1, '{"a": [1, true], "b": {}}'), (2, None), (3, "{broken")], "id int, j string")
    rows = {(r.owner, r.n): r for r in nodes.flatten(df, "id", "j").collect()}
    assert len(rows) == 6 and rows["1", 0]["last"] == 4 and rows["1", 2]["role"] == "a" and rows["1", 3]["value"] == "1" and rows["3", 0]["node"] == "string"


def test_path_text(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 5}]}')], "id int, j string")
    tree = nodes.flatten(df, "id", "j")
    ends = spark.createDataFrame([("1", 0, 3)], "owner string, f int, t int")
    assert nodes.path_to(tree, ends).first()["path"] == "a[0].b"


def test_semantics(spark):
    df = spark.createDataFrame([("042", "a.b.c", "it's"), ("42.0", "a", None)], "n string, d string, q string")
    keys = [r[0] for r in df.select(semantics.number_key("n")).collect()]
    assert keys[0] == keys[1]
    assert [tuple(r) for r in df.select(semantics.head("d"), semantics.tail("d"), semantics.quoted("q"), semantics.clip("d", 2), semantics.lenient_double("d")).collect()][0] == ("a", "c", "'it''s'", "a....[+3 chars]", 0.0)
    for glob, path, hit in (("**/*.py", "a/b/c.py", True), ("*.py", "a/b.py", False), ("a/?.txt", "A/x.TXT", True), ("**/x", "x", True)):
        assert spark.createDataFrame([(path,)], "p string").select(semantics.glob_match("p", glob)).first()[0] is hit
    halves = spark.createDataFrame([(v,) for v in (4, 1, 3, 2)], "v int").agg(semantics.upper_median(F.collect_list("v"))).first()[0]
    assert halves == 3


def test_graphs_end_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {tuple(r) for r in graph.cycles(e).collect()} == {(1, 1), (2, 1), (3, 1)}
    one = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.hops(e, one, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {r["node"]: len(r["hops"]) for r in graph.simple_paths(e, one).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["node"]: len(r["hops"]) for r in graph.simple_paths(e, one, most=2).collect()} == {1: 1, 2: 2}
    assert graph.closure(e.filter("src > 9")).count() == 0
    got = {r["target"] for r in graph.dirty(spark.createDataFrame([(4,)], "target long"), e).collect()}
    assert got == {1, 2, 3, 4}


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=6, deadline=None)
def test_components_match_union_find(spark, edges):
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


def test_routes(spark):
    calls = spark.createDataFrame([(1, "GET", ["en", "5"]), (2, "GET", ["xx"]), (3, "ANY", ["en", "list"])], "call_id int, verb string, segs array<string>")
    ends = [("item", "GET", "/en/{id}"), ("list", "GET", "/en/list"), ("all", "ANY", "/{x?}")]
    got = {(r["call_id"], r["endpoint"], r["how"]) for r in routes.match(calls, ends).collect()}
    assert got == {(1, "item", "exact"), (3, "list", "exact")}
    assert routes.variants("/a/{b?}/C") == [["a", "{}", "c"], ["a", "c"]]


def test_no_form_of_an_endpoint_is_lost(spark):
    assert routes.variants("/x" + "/{o?}" * 8) == [["x"] + ["{}"] * k for k in range(8, -1, -1)]
    apart = "".join(f"/s{i}/{{o{i}?}}" for i in range(7))
    assert len(routes.variants(apart)) == 128
    calls = spark.createDataFrame([(1, "GET", ["x"]), (2, "GET", [f"s{i}" for i in range(7)])], "call_id int, verb string, segs array<string>")
    got = {(r["call_id"], r["endpoint"]) for r in routes.match(calls, [("run", "GET", "/x" + "/{o?}" * 8), ("apart", "GET", apart)]).collect()}
    assert got == {(1, "run"), (2, "apart")}


def test_fulltext_queries(spark):
    df = spark.createDataFrame([(1, "the quick fox"), (2, "Quick the brown"), (3, None)], "id int, t string")
    p = fulltext.postings(df, "id", "t")
    ids = lambda q: {r["doc"] for r in fulltext.search(p, q).collect()}
    assert ids("the quick") == {1, 2} and ids('"the quick"') == {1} and ids("bro*") == {2} and ids("the NOT fox") == {2} and ids("fox OR brown") == {1, 2} and ids("the-quick") == {1}
    assert fulltext.snippet(df, "id", "t", "fox").first()["snippet"] == "the quick >>fox<<"


def test_folds(spark):
    rows = spark.createDataFrame([("k", "in", ["a", "b"]), ("k", "not_in", ["b"]), ("u", "unknown", []), ("n", "not_in", [])], "k string, op string, members array<string>")
    got = {r["k"]: (r["side"], r["members"]) for r in folds.collapse(rows, ["a", "b", "c"], "k").collect()}
    assert got == {"k": ("in", "a"), "u": ("unknown", "")}


def test_ratchet_and_worst(spark):
    counts = spark.createDataFrame([("a", 12), ("b", 9), ("c", 12), ("d", 3)], "item string, n long")
    base = spark.createDataFrame([("c", 11), ("d", 12), ("e", 12)], "item string, n long")
    assert {r["item"]: r["verdict"] for r in gate.ratchet(counts, base, 10).collect()} == {"a": "NEW", "b": "NEAR", "c": "GREW", "d": "REMOVE", "e": "REMOVE"}


def test_rename_pairs_are_used_once(spark):
    s = "path string, kind string, hash string, size long"
    old = spark.createDataFrame([("a", "file", "h", 1), ("b", "file", "h", 1)], s)
    new = spark.createDataFrame([("x", "file", "h", 1), ("y", "file", "h", 1), ("z", "file", "h", 1)], s)
    assert {tuple(r) for r in snapshot.renames(old, new).collect()} == {("a", "x"), ("b", "y")}


def test_findings_levels(spark):
    df = spark.createDataFrame([("x",)], "s string")
    assert lenses.findings({"r": ("warn", df), "q": ("note", df)}, {"q": "off"}).count() == 1
    with pytest.raises(ValueError):
        lenses.findings({"r": ("warn", df)}, {"zz": "off"})


def test_raw_sql_is_read_only(spark):
    cat = Catalog(spark, "/root/testdata/sf0.001")
    assert cat.sql("SELECT count(*) AS n FROM nation").first()["n"] == 25
    with pytest.raises(ValueError):
        cat.sql("DROP TABLE nation")


def test_entity_keys(spark):
    df = spark.createDataFrame([("k", "p", 1), ("k", "p", 2), ("k", "q", 3), ("file:x", "p", 4), ("file:x", "q", 5)], "k string, p string, i int")
    assert {r["i"]: r["entity_key"] for r in code.entity_keys(df, "k", "p", ["p", "i"]).collect()} == {1: "k@p~1", 2: "k@p~2", 3: "k@q", 4: "file:x~1", 5: "file:x~2"}


def test_overlap_of_empty_sets(spark):
    empty = spark.createDataFrame([], "v int")
    assert overlap.overlaps(overlap.value_sets([(empty, "v", "a"), (empty, "v", "b")])).count() == 0


def test_json_is_byte_stable(spark):
    from terrace.sources.files import sorted_json

    df = spark.createDataFrame([(2, "b"), (1, "a")], "z int, a string")
    assert [json.loads(r["value"]) for r in sorted_json(df, ["z"]).collect()] == [{"a": "a", "z": 1}, {"a": "b", "z": 2}]


def test_upper_median_equals_sorting(spark):
    from terrace.operators import stats

    dice = __import__("random").Random(8)
    rows = [(dice.choice("abc"), dice.choice([dice.random() * 100, float(dice.randrange(4)), None])) for _ in range(700)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in {g for g, v in rows if v is not None}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = values[len(values) // 2]
    for bins in (1, 7, 1024):
        assert {r["g"]: r["median"] for r in stats.upper_median(df, "g", "v", bins).collect()} == want
    assert stats.upper_median(df.filter("false"), "g", "v").count() == 0


def test_best_match_levels(spark):
    rows = spark.createDataFrame([(1, "a/b/c.py"), (2, "x/c.py"), (3, "c.pyx"), (4, "d")], "_n long, path string")
    pick = lambda wanted: [tuple(r) for r in lenses.best_match(rows, "path", wanted).collect()]
    assert pick("d") == [(4, "d")] and pick("b/c.py") == [(1, "a/b/c.py")] and pick("c.py") == [] and pick("pyx") == [(3, "c.pyx")] and pick("nowhere") == []
