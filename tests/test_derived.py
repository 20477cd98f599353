"""Paths, gates, declared types, routes, refresh and binding on small hand-made inputs, edge cases included."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrace.functions import semantics
from terrace.operators import appgraph, binding, correlated, declared, folds, graph, indexes, paths, refresh, restrictions, routes, snapshot, sqlshape
from terrace.sources import documents, files, python_code


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def test_not_test(spark):
    df = spark.createDataFrame([("a/Tests/x.cs",), ("tests/x.py",), ("a/b_test.go",), ("A.Tests/x.cs",), ("x/MyTests.cs",), ("a/latest/x.py",), ("a/x.test.ts",), (None,)], "path string")
    assert got(df.filter(paths.not_test("path"))) == [("a/latest/x.py",)]


def test_under_root(spark):
    df = spark.createDataFrame([("src/a.py",), ("lib/src/a.py",), (None,)], "path string")
    roots = [("", "C:\\work\\app\\")]
    assert got(paths.under_root(df, "path", "app/src", roots)) == [("lib/src/a.py", "src"), ("src/a.py", "src")]
    assert got(paths.under_root(df, "path", "lib/src", roots)) == [("lib/src/a.py", "lib/src")]
    assert got(paths.under_root(df, "path", "nowhere", roots)) == []


def test_either_way_and_waivers(spark):
    a, b = spark.createDataFrame([("r/a/x.py",), ("x.py",), ("y.py",)], "path string"), spark.createDataFrame([("a/x.py",), ("zy.py",)], "path string")
    assert got(paths.either_way(a, b)) == [("r/a/x.py", "a/x.py"), ("x.py", "a/x.py")]
    lines = spark.createDataFrame([("f", 1, "x # ok"), ("f", 2, "y"), ("f", 3, "z")], "path string, line int, text string")
    assert got(paths.unwaived(lines.select("path", "line"), lines, "# ok")) == [("f", 3)]


def test_ordered_cuts(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "name string, n int")
    assert [r.name for r in correlated.biggest_first(df, "n", "name").collect()] == ["c", "a", "b"]
    assert [tuple(r) for r in correlated.limited(df, ["name"], 2).collect()] == [("a", 2, 1), ("b", 2, 1)]
    assert [r.more for r in correlated.limited(df, ["name"], 0).collect()] == [0, 0, 0]
    assert [r.name for r in correlated.heaviest(df, "n", 2, ["name"]).collect()] == ["a", "c"]


def test_top_level_args_and_members(spark):
    df = spark.createDataFrame([("A.I<X<Y, Z>, R>", '{"a.b": 1}'), ("I<(a,b),[c,d]>", "[1]"), ("Plain", "{broken"), (None, None)], "t string, j string")
    assert [r[0] for r in df.select(semantics.top_level_args("t")).collect()] == [["X<Y, Z>", "R"], ["(a,b)", "[c,d]"], None, None]
    assert [r[0] for r in df.select(semantics.member_of("j", "a.b")).collect()] == ["1", None, None, None]


NODE = "owner long, n long, parent long, ord long, depth long, kind string, value string, last long, line long"


def test_fingerprints_fold_literals(spark):
    def statement(owner, ids, status, extra=()):
        rows = [(owner, 0, None, 0, 0, "query", None, 99, 1), (owner, 1, 0, 0, 1, "eq", "Status", 2, 1), (owner, 2, 1, 0, 2, "literal", status, 2, 1), (owner, 3, 0, 1, 1, "in", None, 50, 1), (owner, 4, 3, 0, 2, "column", "Id", 4, 1)]
        return [*rows, *((owner, 5 + i, 3, 1 + i, 2, "literal", x, 5 + i, 1) for i, x in enumerate(ids)), *((owner, 40, 3, 9, 2, k, "p", 40, 1) for k in extra)]

    rows = statement(1, ["10", "11"], "1") + statement(2, ["42"], "7") + statement(3, ["10", "11"], "1", ["param"]) + statement(4, ["10"], "1", ["param"])
    prints = {r.owner: r.fingerprint for r in sqlshape.fingerprints(spark.createDataFrame(rows, NODE)).collect()}
    assert prints[1] == prints[2] and len({prints[1], prints[3], prints[4]}) == 3


def test_columns_of_nested_queries(spark):
    """The inner query's alias hides the outer one of the same name; an outer alias is seen from inside; nothing is guessed."""
    rows = [
        (1, 0, None, 0, 0, "query", None, 20, 1), (1, 1, 0, 0, 1, "table", "Outer", 2, 1), (1, 2, 1, 0, 2, "alias", "t", 2, 1), (1, 3, 0, 1, 1, "where", None, 20, 1),
        (1, 4, 3, 0, 2, "subquery", None, 20, 1), (1, 5, 4, 0, 3, "table", "Inner", 6, 1), (1, 6, 5, 0, 4, "alias", "T", 6, 1), (1, 7, 4, 1, 3, "table", "Other", 7, 1),
        (1, 8, 4, 2, 3, "column", "a", 9, 1), (1, 9, 8, 0, 4, "qualifier", "t", 9, 1), (1, 10, 4, 3, 3, "column", "b", 11, 1), (1, 11, 10, 0, 4, "qualifier", "OUTER", 11, 1),
        (1, 12, 4, 4, 3, "column", "c", 12, 1), (1, 13, 4, 5, 3, "column", "d", 14, 1), (1, 14, 13, 0, 4, "qualifier", "zz", 14, 1),
    ]
    assert got(sqlshape.column_refs(spark.createDataFrame(rows, NODE)), "column", "name", "role") == [("a", "Inner", "where"), ("b", "Outer", "where"), ("c", "", "where"), ("d", "", "where")]


def test_columns_broadcast_nothing(spark):
    """Parts of the nodes look small to the planner at any size, so none may be joined; a statement's rows meet in one shuffle."""
    rows = [(owner, 0, None, 0, 0, "select", None, 2, 1) for owner in (1, 1, None)] + [(owner, 1, 0, 0, 1, "column", "a", 2, 1) for owner in (1, 1, 2, None)]
    df = sqlshape.column_refs(spark.createDataFrame(rows, NODE))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert got(df, "owner", "role") == [(1, "select"), (1, "select"), (2, ""), (None, "select")]


@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["query", "subquery", "table", "alias", "qualifier", "column", "where", "on", "over"]), st.sampled_from(["a", "A", "b", None])), min_size=8, max_size=24))
@settings(max_examples=8, deadline=None)
def test_columns_against_walking_up(spark, picks):
    """Any tree in preorder, each node under the last one or one of its ancestors."""
    tree, path = [["query", None, None, 0]], [0]
    for up, kind, value in picks:
        del path[max(1, len(path) - up % 4) :]
        tree.append([kind, value, path[-1], len(tree)])
        path.append(len(tree) - 1)
        for n in path:
            tree[n][3] = len(tree) - 1

    def above(n):
        while (n := tree[n][2]) is not None:
            yield n

    def first(n, kind):
        return next(((v or "").lower() or None for k, v, p, _ in tree if p == n and k == kind), None)

    def query(n):
        return next((x for x in above(n) if tree[x][0] in ("query", "subquery")), None)

    want, sources = [], [(query(n), v, first(n, "alias")) for n, (k, v, *_) in enumerate(tree) if k == "table"]
    for n, (kind, value, *_) in enumerate(tree):
        if kind == "column":
            key, own = first(n, "qualifier"), [v for q, v, _ in sources if q == query(n)]
            named = [(-q, v) for q, v, a in sources if v and q in above(n) and key in (a, v.lower())]
            name = (own[0] or "" if len(own) == 1 else "") if key is None else min(named)[1] if named else ""
            clauses = [tree[x][0] for x in above(n) if tree[x][0] in ("where", "on", "over")]
            role = "window" if "over" in clauses else {"on": "join"}.get(clauses[0], clauses[0]) if clauses else ""
            want.append((n, value, name, role))
    df = spark.createDataFrame([(7, n, p, 0, 0, k, v, last, 1) for n, (k, v, p, last) in enumerate(tree)], NODE)
    assert got(sqlshape.column_refs(df), "n", "column", "name", "role") == sorted(want, key=str)


def test_comparisons(spark):
    rows = [("g1", "E", "d", "===", "A", False, False), ("g2", "E", "d", "!==", "A", False, False), ("g3", "E", "d", "!==", "A", False, True), ("g4", "E", "d", "<", "A", False, False), ("g5", "E", "d", "===", None, True, False), ("g6", "E", "d", "===", None, False, False)]
    df = spark.createDataFrame(rows, "gate string, enum string, dim string, op string, member string, is_null boolean, negated boolean")
    assert got(restrictions.comparisons(df), "gate", "op", "member") == [("g1", "in", "A"), ("g2", "not_in", "A"), ("g3", "in", "A"), ("g4", "unknown", None), ("g6", "unknown", None)]


@pytest.mark.parametrize(
    ("tree", "proved"),
    [
        (("and", "a", "b"), ["a", "b"]),
        (("or", "a", "b"), []),
        (("not", ("or", "a", ("not", "b"))), ["b"]),
        (("not", ("and", ("not", "a"), "b")), []),
        (("not", ("not", ("and", "a", "b"))), ["a", "b"]),
        (("and", ("or", "a", "b"), "c"), ["c"]),
        ("a", ["a"]),
        (("not", "a"), []),
    ],
)
def test_necessary(spark, tree, proved):
    rows = []

    def add(x, parent):
        n = len(rows)
        rows.append((1, n, parent, x[0], None) if isinstance(x, tuple) else (1, n, parent, "leaf", x))
        for y in x[1:] if isinstance(x, tuple) else ():
            add(y, n)

    add(tree, None)
    assert got(restrictions.necessary(spark.createDataFrame(rows, "owner long, n long, parent long, kind string, value string")), "feature") == [(x,) for x in proved]


def test_key_reach_against_listed_ways(spark):
    refs = [("k", 1, "c1"), ("k", 2, "c2"), ("q", 3, "c1"), ("gone", 4, "c9")]
    own, ways = {1: {"own", "g"}, 2: {"g"}, 3: set()}, {"c1": {"p1": {"x", "y"}, "p2": {"x"}}, "c2": {"p3": {"x", "own"}}}
    df = restrictions.key_reach(
        spark.createDataFrame(refs, "key string, ref int, component string"),
        spark.createDataFrame([(r, g) for r, gs in own.items() for g in gs], "ref int, gate string"),
        spark.createDataFrame([(c, p) for c, ps in ways.items() for p in ps], "component string, path string"),
        spark.createDataFrame([(p, g) for ps in ways.values() for p, gs in ps.items() for g in gs], "path string, gate string"),
    )
    want = []
    for key in ("k", "q"):
        sets = [(own[r] | gs, gs) for k, r, c in refs if k == key for gs in ways[c].values()]
        want.append((key, len(sets), *(",".join(sorted(x)) for x in (set.intersection(*(a for a, _ in sets)), set.union(*(a for a, _ in sets)), set.intersection(*(b for _, b in sets))))))
    assert got(df, "key", "n_paths", "always", "maybe", "path_always") == sorted(want)


def test_source_trace_ignores_comments(spark):
    sources = [("f1", True, "use('a.b.c') // x.y.z\nhttp://h.i"), ("f2", False, "p.q.r <!-- d.e\n d.e.f --> s.t"), ("f3", True, "/* m.n */ only")]
    keys = spark.createDataFrame([(k,) for k in ("a.b.c", "x.y.z", "p.q.r", "s.t.u", "v.only", "m.n", "h.i")], "key string")
    want = {"a.b.c": "full_literal", "x.y.z": "absent", "p.q.r": "unparsed_file", "s.t.u": "prefix", "v.only": "leaf", "m.n": "absent", "h.i": "full_literal"}
    assert {r.key: r.how for r in restrictions.source_trace(keys, spark.createDataFrame(sources, "file string, parsed boolean, text string")).collect()} == want


def test_generic_bases_end_on_a_cycle(spark):
    classes = spark.createDataFrame([("A", ["T", "U"], ["B<U, T>"]), ("B", ["T", "U"], ["A<U, T>"]), ("S", [], ["A<int, TU>"])], "cls string, params array<string>, bases array<string>")
    rows = {(r["cls"], r["base"]): r["args"] for r in declared.bound_bases(classes).collect()}
    assert rows["S", "A"] == ["int", "TU"] and rows["S", "B"] == ["TU", "int"]


def test_types_used_ends_on_a_cycle(spark):
    e = spark.createDataFrame([("e", "Task<A<string>>")], "endpoint string, type string")
    p = spark.createDataFrame([("A", "List<B>"), ("B", "A"), ("C", "A")], "cls string, type string")
    assert got(declared.types_used(e, p), "endpoint", "type") == [("e", "A"), ("e", "B")]


@pytest.mark.parametrize(
    ("route", "fact", "same"),
    [
        ("GET /api/{id:int}/x", "get /API/42/x", True), ("GET /api/{id?}", "/api", True), ("GET /api/{id?}", "GET /api/{other}?q=1", True), ("POST /api", "GET /api", False),
        ("ANY /api", "GET /api", True), ("/api/:id", "/api/7", True), ("/api/7", "/api/{id}", False), ("/{a?}/{b?}/c", "/x/c", True), ("/{a}", "/b/c", False),
    ],
)
def test_same_endpoints(spark, route, fact, same):
    df = routes.same_endpoints(spark.createDataFrame([("e", route)], "endpoint string, route string"), spark.createDataFrame([("f", fact)], "fact string, route string"))
    assert got(df) == ([("e", "f")] if same else [])


def test_folded_urls_with_cycle_and_missing_name(spark):
    parts = [("a", 0, "name", "b"), ("a", 1, "literal", "/x"), ("b", 0, "literal", "/api"), ("c", 0, "name", "d"), ("c", 1, "param", None), ("d", 0, "name", "c"), ("e", 0, "name", "none"), ("e", 1, "unknown", None)]
    df = routes.fold_urls(spark.createDataFrame(parts, "owner string, ord int, kind string, value string"))
    assert got(df, "owner", "url") == [("a", "/api/x"), ("b", "/api"), ("c", "*{}"), ("d", "*"), ("e", "**")]


def test_render_scope_without_module(spark):
    pair = lambda rows, names: spark.createDataFrame(rows, names)
    df = appgraph.render_scope(pair([("u", "c"), ("v", "c")], "user string, candidate string"), pair([("u", "M"), ("c", "N")], "component string, module string"), pair([("N", "N"), ("N", "c")], "module string, item string"), pair([("M", "N")], "module string, imported string"))
    assert got(df, "user", "candidate", "scope") == [("u", "c", "imported"), ("v", "c", "unknown")]


def test_checked_reads_again_then_refuses(spark):
    tree, reads = spark.createDataFrame([("f", "1")], "path string, hash string"), []

    def read(hashes):
        reads.append(1)
        return spark.createDataFrame([("f", hashes[min(len(reads), len(hashes)) - 1])], "path string, hash string")

    assert refresh.checked(lambda: read(["0", "1"]), tree).count() == 1 and len(reads) == 2
    with pytest.raises(RuntimeError):
        refresh.checked(lambda: read(["0"]), tree)


TREE = {
    "pkg/__init__.py": "from .jobs import run\n",
    "pkg/jobs.py": "def run(a, b=1, *, c=2):\n    return a\nclass K:\n    def __init__(self, x): self.go(x)\n    def go(self, y): return run(y, c=3)\n",
    "main.py": "from pkg import run\nimport pkg.jobs as j\nimport pkg\nfrom pkg.jobs import K as Kay\ndef main(run2):\n    def inner(z): return z\n    run(1, b=2)\n    j.run(*[1], 2)\n    pkg.jobs.run(5)\n    run2()\n    inner(3)\n    Kay(9)\n    Kay.go(1, 2)\n    nope()\n    run = 3\n",
    "legacy.py": "def run(): pass\nclass L:\n    def go(this): this.stop()\n    def stop(self): self.inherited()\n",
    "loop.py": "from loop2 import f\nf()\n",
    "loop2.py": "from loop import f\n",
    "broken.py": "def (",
}


def test_binding(spark):
    rows = python_code.facts(spark.createDataFrame(list(TREE.items()), "path string, content string"))
    calls = binding.bound_calls(rows)
    found = {(r.path, r.name): r.target for r in calls.collect()}
    assert found == {
        ("main.py", "run"): "", ("main.py", "j.run"): "pkg/jobs.py::run", ("main.py", "pkg.jobs.run"): "pkg/jobs.py::run", ("main.py", "run2"): "", ("main.py", "inner"): "main.py::main.inner",
        ("main.py", "Kay"): "pkg/jobs.py::K", ("main.py", "Kay.go"): "pkg/jobs.py::K.go", ("main.py", "nope"): "", ("pkg/jobs.py", "self.go"): "pkg/jobs.py::K.go", ("pkg/jobs.py", "run"): "pkg/jobs.py::run",
        ("legacy.py", "this.stop"): "", ("legacy.py", "self.inherited"): "", ("loop.py", "f"): "",
    }
    args = {(r["path"], r["name"], r["position"]): r["param"] for r in binding.bound_arguments(rows, calls).collect()}
    assert args["main.py", "Kay", 0] == "x" and args["main.py", "Kay.go", 0] == "self" and args["pkg/jobs.py", "self.go", 0] == "y"
    assert args["pkg/jobs.py", "run", 1] == "c" and args["main.py", "j.run", 0] == args["main.py", "j.run", 1] == ""
    assert ("main.py", "pkg/jobs.py") in got(binding.bound_through(rows))


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=16))
@settings(max_examples=6, deadline=None)
def test_cycles_and_levels_against_reach(spark, edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        reach = {n: r | {y for x in r for y in reach[x]} for n, r in reach.items()}
    cycle = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.cycles(df).collect()} == cycle
    comp = {n: cycle.get(n, n) for n in nodes}

    def level(c):
        below = {comp[b] for a, b in edges if comp[a] == c and comp[b] != c}
        return 1 + max(map(level, below)) if below else 0

    assert {r["node"]: r["level"] for r in indexes.topological_level(df).collect()} == {n: level(comp[n]) for n in nodes}


CALLS = [("/api/x/1", {"a"}, "exact"), ("*api/x/1", {"a"}, "exact"), ("*/x/1", {"a", "b"}, "ambiguous"), ("https://h/v2/x/9", {"b"}, "exact"), ("*", set(), None), ("/{}/{}/{}", set(), None), ("/api/x*/1", {"a"}, "exact"), ("/api/x", {"a"}, "exact"), ("/api/y", set(), None), ("/w/any/q", {"c"}, "exact")]


@pytest.mark.parametrize("as_list", [True, False])
def test_match_with_base_prefix(spark, as_list):
    ends = [("a", "GET", "/Api/X/{id?}"), ("b", "ANY", "v2/x/{id:int}"), ("c", "GET", "/w/*/q"), ("d", "PUT", "/api/x/1")]
    calls = spark.createDataFrame([(i, "GET", url) for i, (url, _, _) in enumerate(CALLS)], "call_id int, verb string, url string")
    calls = calls.select("call_id", "verb", routes.call_segments("url").alias("segs"))
    found = routes.match(calls, ends if as_list else spark.createDataFrame(ends, "endpoint string, verb string, pattern string")).collect()
    assert {(r["call_id"], r["endpoint"], r["how"]) for r in found} == {(i, e, how) for i, (_, es, how) in enumerate(CALLS) for e in es}


def test_forms_agree(spark):
    for pattern in ("/a/{b?}/C", "/x/{o?}/{p?}", "/{a?}/s/{b}/{c?}/{d?}", "/"):
        row = spark.createDataFrame([(pattern,)], "p string").select(routes.all_forms(routes.pattern_segments("p")).alias("f")).first()
        assert sorted(row["f"]) == sorted(routes.variants(pattern))


@given(st.text("a./", max_size=12))
@settings(max_examples=40, deadline=None)
def test_normal_path(spark, text):
    import posixpath

    want = posixpath.normpath(text)
    want = want[1:] if want.startswith("//") else want
    assert spark.range(1).select(semantics.normal_path(F.lit(text))).first()[0] == want


def test_statements(spark):
    texts = ["a; b", "select ';' ; -- c; d\n e;", "/* x; y */ f;;", "[a;b] \"c;d\"; 'it''s;'", "", None, ";"]
    df = documents.statements(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t")
    assert got(df, "k", "statement") == sorted([(0, "a"), (0, "b"), (1, "select ';'"), (1, "-- c; d\n e"), (2, "/* x; y */ f"), (3, '[a;b] "c;d"'), (3, "'it''s;'")], key=str)


def test_statement_shapes_and_launchers(spark):
    sources = [("a.py", "def f(x):\n    y = x + 1\n    return g(y, k=2)\n"), ("b.py", "async def h(q):\n    z = q + 5\n    return q\n"), ("bad.py", "def ("), ("pyproject.toml", '[project.gui-scripts]\nw = "m:w"'), ("x/pyproject.toml", "broken ="), ("none", None)]
    df = spark.createDataFrame(sources, "path string, content string")
    shapes = {(r["path"], r["line"]): r["shape"] for r in python_code.statement_shapes(df).collect()}
    assert shapes["a.py", 2] == shapes["b.py", 2] and shapes["a.py", 3] != shapes["b.py", 3] and len(shapes) == 4
    assert got(python_code.launch_targets(df)) == [("pyproject.toml", "w", "m:w")]


def test_module_files(spark):
    files_ = spark.createDataFrame([("src/lib.rs",), ("src/a/mod.rs",), ("src/a/b.rs",), ("tests/a.rs",)], "path string")
    uses = spark.createDataFrame([("src/lib.rs", "self::a::X"), ("src/a/mod.rs", "self::b"), ("src/a/b.rs", "super::b::c"), ("src/a/b.rs", "crate::zz"), ("src/a/b.rs", "std::fs"), ("src/a/b.rs", "super::super::x")], "file string, used string")
    want = {"self::a::X": "src/a/mod.rs", "self::b": "src/a/b.rs", "super::b::c": "src/a/b.rs", "crate::zz": None, "std::fs": None}
    found = {r["used"]: r["target"] for r in paths.module_files(uses, files_).collect()}
    assert {k: found[k] for k in want} == want


def test_write_runs_and_source_state(spark, tmp_path):
    line = lambda x: spark.createDataFrame([(x,)], "value string")
    for value, mode in (("1", "append"), ("2", "append")):
        files.write_runs(line(value), str(tmp_path / "t"), mode)
    assert got(spark.read.text(str(tmp_path / "t"))) == [("1",), ("2",)]
    files.write_runs(line("3"), str(tmp_path / "t"), "replace")
    assert got(spark.read.text(str(tmp_path / "t"))) == [("3",)]
    state = lambda rows: got(files.source_state(spark.createDataFrame(rows, "path string, text string")), "branch", "commit")
    assert state([(".git/HEAD", "abc\n")]) == [(None, "abc")] and state([(".git/HEAD", "ref: refs/heads/x/y\n"), (".git/refs/heads/x/y", "d\n")]) == [("x/y", "d")]


def test_merkle_at_several_depths(spark):
    tree = lambda rows: {r["path"]: r["hash"] for r in snapshot.merkle(spark.createDataFrame(rows, "path string, hash string")).collect()}
    a = tree([("top.md", "1"), ("a/x", "2"), ("a/b/c/y", "3"), ("d/z", "4")])
    b = tree([("top.md", "1"), ("a/x", "2"), ("a/b/c/y", "changed"), ("d/z", "4")])
    assert set(a) == {"", "a", "a/b", "a/b/c", "d"} and {k for k in a if a[k] != b[k]} == {"", "a", "a/b", "a/b/c"}
    assert tree([]) == {}


def test_either_side(spark):
    side = lambda rows: spark.createDataFrame(rows, "k string, m string")
    assert got(folds.either(side([("x", "b"), ("x", "a"), ("y", "a")]), side([("x", "c"), ("x", "a"), ("z", "q")]), "k", "m"), "k", "members") == [("x", "a,b,c")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], NODE)
    for df in (sqlshape.fingerprints(empty), sqlshape.column_refs(empty), sqlshape.joins(empty), restrictions.necessary(empty)):
        assert df.count() == 0
    assert binding.bound_calls(python_code.facts(spark.createDataFrame([], "path string, content string"))).count() == 0
    assert refresh.set_hash(spark.createDataFrame([], "path string")).first()["key"] == "0-0-0"
