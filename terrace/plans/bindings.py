"""The operators bound to the driver's tables: one function per query key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.catalog import TABLES, Catalog
from terrace.functions.semantics import clip, content_hash, glob_match, head, lenient_double, number_key, quoted, tail
from terrace.operators import code, folds, fulltext, gate, graph, indexes, lenses, links, nodes, overlap, paths, routes, similar, snapshot, stats

Query = Callable[[Catalog], DataFrame]
_registry: dict[str, Query] = {}


def query(f: Query) -> Query:
    _registry[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from terrace.plans import derived  # noqa: F401  registers its own

    return {name: (lambda spark, folder, f=f: f(Catalog(spark, folder))) for name, f in _registry.items()}


# --- lenses ------------------------------------------------------------------------------------


@query
def table_inventory(t: Catalog) -> DataFrame:
    return lenses.inventory(t, TABLES)


@query
def column_fill_profile(t: Catalog) -> DataFrame:
    return lenses.fill_profile(t["orders"], "orders").unionByName(lenses.fill_profile(t["events"], "events"))


@query
def find_names(t: Catalog) -> DataFrame:
    places = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")]
    return lenses.search_cells(t, places, "01")


@query
def grep_rows(t: Catalog) -> DataFrame:
    places = [("events", "event_id", "event_type"), ("part", "p_partkey", "p_type"), ("orders", "o_orderkey", "o_orderpriority"), ("conversations", "conv_id", "role"), ("pages", "page_id", "url"), ("pages", "page_id", "no_such_column")]
    return lenses.search_cells(t, places, "er")


@query
def cat_lines(t: Catalog) -> DataFrame:
    return lenses.line_range(t["documents"], "doc_id", "text", 2, 4)


@query
def literal_stats(t: Catalog) -> DataFrame:
    return lenses.literal_stats(t["documents"], "doc_id", "text", 8, 3)


@query
def separator_stats(t: Catalog) -> DataFrame:
    return lenses.separator_stats(t["documents"], "doc_id", "text")


@query
def repeat_flag(t: Catalog) -> DataFrame:
    return lenses.repeat_flag(t["events"].select("event_id", "user_id", "event_type"), ["user_id", "event_type"])


@query
def rule_findings(t: Catalog) -> DataFrame:
    li, orders = t["lineitem"], t["orders"]
    rules = {
        "no-discount": ("warn", li.filter("l_discount = 0 AND l_quantity > 45").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("s"))),
        "late-ship": ("error", li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate > o_orderdate + INTERVAL 115 DAYS").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("s"))),
        "no-label": ("note", t["documents"].join(t["labels"], "doc_id", "left_anti").select("doc_id")),
    }
    return lenses.findings(rules)


@query
def slowest_topk(t: Catalog) -> DataFrame:
    li = t["lineitem"].select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("k"), "l_extendedprice")
    return lenses.top_with_rest(li, "l_extendedprice", "k", 15)


@query
def folder_counts(t: Catalog) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    return t["pages"].select(folder.alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


# --- node rows ---------------------------------------------------------------------------------


def trade_tree(t: Catalog) -> DataFrame:
    """region -> nation -> customer -> kind as node rows, numbered by their keys; one owner per region."""
    r, n, c = t["region"], t["nation"], t["customer"]
    no = F.lit(None).cast("long")
    key = lambda name: F.col(name).cast("long")
    rows = (
        r.select(key("r_regionkey").alias("owner"), no.alias("a"), no.alias("b"), no.alias("c"), F.lit("region").alias("role"), F.lit("object").alias("node"), F.col("r_name").alias("value"), F.lit(0).alias("depth"))
        .unionByName(n.select(key("n_regionkey").alias("owner"), key("n_nationkey").alias("a"), no.alias("b"), no.alias("c"), F.lit("nation").alias("role"), F.lit("object").alias("node"), F.col("n_name").alias("value"), F.lit(1).alias("depth")))
    )
    cn = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.unionByName(cn.select(key("n_regionkey").alias("owner"), key("n_nationkey").alias("a"), key("c_custkey").alias("b"), no.alias("c"), F.lit("customer").alias("role"), F.lit("object").alias("node"), F.col("c_name").alias("value"), F.lit(2).alias("depth")))
    rows = rows.unionByName(cn.select(key("n_regionkey").alias("owner"), key("n_nationkey").alias("a"), key("c_custkey").alias("b"), F.lit(0).cast("long").alias("c"), F.lit("kind").alias("role"), F.lit("string").alias("node"), F.col("c_mktsegment").alias("value"), F.lit(3).alias("depth")))
    rows = nodes.number(rows, ["a", "b", "c"]).withColumn("n", F.col("n").cast("long"))
    return rows.withColumns({
        "last": F.when(F.col("depth") == 0, F.max("n").over(Window.partitionBy("owner"))).when(F.col("depth") == 1, F.max("n").over(Window.partitionBy("owner", "a"))).when(F.col("depth") == 2, F.col("n") + 1).otherwise(F.col("n")),
        "parent": F.when(F.col("depth") == 1, F.lit(0).cast("long")).when(F.col("depth") == 2, F.min("n").over(Window.partitionBy("owner", "a"))).when(F.col("depth") == 3, F.col("n") - 1),
        "depth": F.col("depth").cast("long"),
    }).select("owner", "n", "parent", "role", F.lit(None).cast("long").alias("ord"), "node", "value", "last", "depth")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("owner", "n", "parent", "role", "value", "last", "depth")


def _at(t: Catalog, n: int) -> DataFrame:
    return t["region"].select(F.col("r_regionkey").cast("long").alias("owner"), F.lit(n).cast("long").alias("n"))


@query
def props_nodes(t: Catalog) -> DataFrame:
    return nodes.flatten(t["events"], "event_id", "props")


@query
def node_subtree(t: Catalog) -> DataFrame:
    return _shown(nodes.subtree(trade_tree(t), _at(t, 1)))


@query
def node_ancestors(t: Catalog) -> DataFrame:
    return _shown(nodes.ancestors(trade_tree(t), _at(t, 3)))


@query
def node_children(t: Catalog) -> DataFrame:
    return _shown(nodes.children(trade_tree(t), _at(t, 0)))


@query
def node_siblings(t: Catalog) -> DataFrame:
    return _shown(nodes.siblings(trade_tree(t), _at(t, 1)))


@query
def node_leaves(t: Catalog) -> DataFrame:
    return _shown(nodes.leaves(trade_tree(t), _at(t, 1)))


@query
def node_depth_range(t: Catalog) -> DataFrame:
    return _shown(nodes.depth_range(trade_tree(t), _at(t, 0), 1, 2))


@query
def node_of_kind(t: Catalog) -> DataFrame:
    return _shown(nodes.of_kind(trade_tree(t), _at(t, 1), "BUILDING"))


@query
def node_path_to(t: Catalog) -> DataFrame:
    return nodes.path_to(trade_tree(t), _at(t, 3).select("owner", F.lit(0).alias("f"), F.col("n").alias("t")))


@query
def node_lca(t: Catalog) -> DataFrame:
    return _shown(nodes.lca(trade_tree(t), _at(t, 2).select("owner", F.col("n").alias("a"), F.lit(5).alias("b"))))


@query
def node_nth_child(t: Catalog) -> DataFrame:
    tree = trade_tree(t)
    return _shown(nodes.nth_child(tree, _at(t, 0), 1).unionByName(nodes.nth_child(tree, _at(t, 0), -1)))


@query
def innermost_interval(t: Catalog) -> DataFrame:
    o = t["orders"]
    o = o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    spans = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("span"), F.col("o_orderdate").alias("lo"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 400 + 1 AS int))").alias("hi"))
    points = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("point"), F.col("o_orderdate").alias("at"))
    return nodes.innermost(points, spans, "k", "at", "lo", "hi", "span").select(F.col("k").alias("custkey"), "point", "innermost")


@query
def list_items_join(t: Catalog) -> DataFrame:
    items = t["embeddings"].select("vec_id", F.posexplode(F.slice("embedding", 1, 5)).alias("ord", "x"))
    later = items.select("vec_id", (F.col("ord") - 1).alias("ord"), F.col("x").alias("y"))
    return items.join(later, ["vec_id", "ord"]).select("vec_id", F.col("ord").cast("long").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


# --- joins -------------------------------------------------------------------------------------


def _urgent(t: Catalog) -> DataFrame:
    return t["orders"].filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))


@query
def semi_customers(t: Catalog) -> DataFrame:
    return t["customer"].select("c_custkey", "c_name").join(_urgent(t), "c_custkey", "left_semi")


@query
def anti_customers(t: Catalog) -> DataFrame:
    return t["customer"].select("c_custkey", "c_name").join(_urgent(t), "c_custkey", "left_anti")


# --- graphs ------------------------------------------------------------------------------------


def trade_graph(t: Catalog) -> DataFrame:
    """src, dst: each customer nation's two largest supplier nations by line count, ties by the lower key."""
    li = t["lineitem"].select("l_orderkey", "l_suppkey").join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    counted = li.filter("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return counted.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("src", "dst")


def _cut_graph(t: Catalog) -> DataFrame:
    return graph.cut(trade_graph(t))


@query
def ancestor_closure(t: Catalog) -> DataFrame:
    return graph.closure(_cut_graph(t))


@query
def k_hop(t: Catalog) -> DataFrame:
    g, zero = _cut_graph(t), t["nation"].filter("n_nationkey = 0").select(F.col("n_nationkey").cast("long").alias("node"))
    return lenses.union_all([graph.hops(g, zero, 2, d).select(F.lit(d).alias("direction"), "node", "dist") for d in ("out", "in", "both")])


@query
def cycle_members(t: Catalog) -> DataFrame:
    return graph.cycles(_cut_graph(t))


@query
def unreached(t: Catalog) -> DataFrame:
    n = graph.unreached(t["nation"].select(F.col("n_nationkey").cast("long").alias("node")), trade_graph(t)).select(F.lit("nation").alias("kind"), "node")
    d = t["documents"].select(F.col("doc_id").alias("node")).join(t["labels"].select(F.col("doc_id").alias("node")), "node", "left_anti")
    return n.unionByName(d.select(F.lit("document").alias("kind"), "node"))


@query
def root_reach(t: Catalog) -> DataFrame:
    roots = t["nation"].groupBy("n_regionkey").agg(F.min("n_nationkey").cast("long").alias("node"))
    reach = graph.reach_from(_cut_graph(t), roots)
    return reach.groupBy("node").agg(F.count(F.lit(1)).alias("n_roots"), F.min("depth").alias("min_depth"), F.array_join(F.transform(F.sort_array(F.collect_list("root")), lambda x: x.cast("string")), ",").alias("roots")).withColumn("exclusive", F.col("n_roots") == 1)


@query
def simple_paths(t: Catalog) -> DataFrame:
    start = t["nation"].select(F.col("n_nationkey").cast("long").alias("node"))
    paths = graph.simple_paths(_cut_graph(t), start, most=4)
    return paths.select("node", F.array_join(F.transform("hops", lambda x: x.cast("string")), ">").alias("hops"))


@query
def reverse_edges(t: Catalog) -> DataFrame:
    rev = graph.reverse_edges(trade_graph(t))
    return rev.select("dst", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query
def folder_rollup(t: Catalog) -> DataFrame:
    group = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("node"), F.col("r_name").alias("folder"))
    return graph.rollup(trade_graph(t), group)


@query
def weighted_edges(t: Catalog) -> DataFrame:
    li = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("src"), F.col("l_linestatus").alias("dst"), F.col("l_returnflag").alias("kind"))
    return graph.weighted(li, "kind", ["A", "N", "R"])


@query
def connected_groups(t: Catalog) -> DataFrame:
    from terrace.operators.components import connected_components

    return connected_components(trade_graph(t), "src", "dst")


@query
def dirty_targets(t: Catalog) -> DataFrame:
    p = t["part"]
    start = p.filter(glob_match("p_brand", "*#2?")).select(F.col("p_brand").alias("target"))
    brands = p.select("p_brand").distinct()
    digits = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    deps = brands.select(F.col("p_brand").alias("src"), digits.alias("k")).join(brands.select(F.col("p_brand").alias("dst"), (digits + 10).alias("k")), "k").select("src", "dst")
    return graph.dirty(start, deps)


# --- duplication -------------------------------------------------------------------------------


@query
def identical_docs(t: Catalog) -> DataFrame:
    return similar.identical(t["documents"], "doc_id", "text")


@query
def near_copies(t: Catalog) -> DataFrame:
    return similar.near_copies(t["documents"], "doc_id", "text")


@query
def copied_lines(t: Catalog) -> DataFrame:
    return similar.copied_lines(t["documents"], "doc_id", "text")


# --- full text ---------------------------------------------------------------------------------


def _docs(t: Catalog) -> DataFrame:
    return fulltext.postings(t["documents"], "doc_id", "text")


@query
def fulltext_and(t: Catalog) -> DataFrame:
    return fulltext.match_all(_docs(t), ["the", "license"])


@query
def fulltext_or(t: Catalog) -> DataFrame:
    return fulltext.search(_docs(t), "license OR token")


@query
def fulltext_not(t: Catalog) -> DataFrame:
    return fulltext.search(_docs(t), "the NOT and")


@query
def fulltext_phrase(t: Catalog) -> DataFrame:
    return fulltext.match_phrase(_docs(t), ["all", "rights", "reserved"])


@query
def fulltext_prefix(t: Catalog) -> DataFrame:
    return fulltext.match_prefix(_docs(t), "lic")


@query
def fulltext_snippet(t: Catalog) -> DataFrame:
    return fulltext.snippet(t["documents"], "doc_id", "text", "license")


@query
def row_index_lookup(t: Catalog) -> DataFrame:
    return lenses.word_hits(t, [("pages", "page_id", "url"), ("conversations", "conv_id", "text"), ("benchmark", "item_id", "text")], ("the", "en"))


# --- routes and overlaps -----------------------------------------------------------------------

ENDPOINTS = [("en-item", "GET", "/en/{id}"), ("de-item", "ANY", "/de/{id}"), ("de-only", "POST", "/de/{id}"), ("fr-all", "ANY", "/fr/{id}"), ("fr-opt", "GET", "/fr/{id?}"), ("by-lang", "GET", "/{lang}/{id?}")]


@query
def routes_in_text(t: Catalog) -> DataFrame:
    return routes.routes_in_text(t["pages"], "html")


@query
def route_match(t: Catalog) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract(F.lower("url"), "^[^?#]*", 0), "^https?://[^/]*", "")
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    calls = t["pages"].select(F.col("page_id").alias("call_id"), F.lit("GET").alias("verb"), segs.alias("segs"))
    return routes.match(calls, ENDPOINTS)


SETS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("supplier", "s_suppkey"), ("part", "p_size"), ("lineitem", "l_linenumber"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("orders", "o_custkey"), ("customer", "c_custkey")]


@query
def value_overlap(t: Catalog) -> DataFrame:
    return overlap.overlaps(overlap.value_sets([(t[x], c, c) for x, c in SETS]))


@query
def chance_hits(t: Catalog) -> DataFrame:
    pairs = [("customer", "c_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "supplier", "s_suppkey"), ("lineitem", "l_linenumber", "part", "p_size")]
    return lenses.union_all([overlap.chance(t[a], x, t[b], y, f"{x}~{y}") for a, x, b, y in pairs])


@query
def row_agreement(t: Catalog) -> DataFrame:
    s = t["supplier"].select("s_nationkey", (F.col("s_suppkey") % 5).alias("s_mod"), F.lit(1).alias("s_one"))
    return overlap.agreement(s, t["nation"], F.col("s_nationkey") == F.col("n_nationkey"), [("s_mod", "n_regionkey"), ("s_one", "n_regionkey"), ("s_mod", "n_nationkey"), ("s_nationkey", "n_nationkey")])


@query
def best_sets(t: Catalog) -> DataFrame:
    pairs = value_overlap(t).select(F.col("a").alias("group_name"), F.col("b").alias("set_name"), F.col("hits").alias("score"))
    return overlap.best_both_ways(pairs)


# --- traces ------------------------------------------------------------------------------------


@query
def stage_stats(t: Catalog) -> DataFrame:
    return stats.stage_stats(t["events"], "event_type", "value")


@query
def untraced_time(t: Catalog) -> DataFrame:
    children = t["lineitem"].groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    return t["orders"].join(children, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.round(F.greatest(F.col("o_totalprice") - F.col("s"), F.lit(0.0)), 2).alias("untraced"))


@query
def metrics_tally(t: Catalog) -> DataFrame:
    return stats.tally(t["lineitem"], "l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber")


# --- snapshots ---------------------------------------------------------------------------------


def _entries(t: Catalog, shift: int) -> DataFrame:
    """Customers as entries; the states differ by balance, some are renamed, changed or of another kind."""
    c, k = t["customer"], F.col("c_custkey")
    old = shift == 0
    c = c.filter("c_acctbal < 9000") if old else c.filter("c_acctbal > -500")
    name = F.col("c_name") if old else F.when(k % 17 == 0, F.concat("c_name", F.lit("-moved"))).otherwise(F.col("c_name"))
    whole = F.concat("c_mktsegment", F.lit("#"), k.cast("string"))
    body = whole if old else F.when(k % 50 == 0, F.lit("X")).otherwise(whole)
    kind = F.lit("file") if old else F.when(k % 33 == 0, "dir").otherwise("file")
    return c.select(name.alias("path"), kind.alias("kind"), F.md5(body).alias("hash"), F.char_length(body).cast("long").alias("size"))


@query
def snapshot_diff(t: Catalog) -> DataFrame:
    return snapshot.diff(_entries(t, 0), _entries(t, 1))


@query
def rename_pairs(t: Catalog) -> DataFrame:
    return snapshot.renames(_entries(t, 0), _entries(t, 1))


@query
def changed_paths(t: Catalog) -> DataFrame:
    a, b = _entries(t, 0), _entries(t, 1)
    return snapshot.changed_paths(snapshot.diff(a, b), snapshot.renames(a, b))


@query
def merkle_rollup(t: Catalog) -> DataFrame:
    held = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    folders = snapshot.merkle(held.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.sha2(F.col("c_mktsegment"), 256).alias("hash")))
    return folders.select(F.when(F.col("path") == "", "/").otherwise(F.substring_index("path", "/", -1)).alias("path"), "hash")


@query
def prune_snapshots(t: Catalog) -> DataFrame:
    return snapshot.keep_newest(t["orders"].select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query
def state_diff(t: Catalog) -> DataFrame:
    d = t["documents"]
    stored = d.filter("n_chars < 6000").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    now = d.filter("n_chars > 200").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return snapshot.state_diff(stored, now)


@query
def delta_rows(t: Catalog) -> DataFrame:
    e = t["events"].select("user_id", "event_type")
    return snapshot.delta(e.filter("event_type <> 'click'"), e.filter("event_type <> 'view'"))


@query
def replaced_files(t: Catalog) -> DataFrame:
    d = t["documents"].select("doc_id", "source", "n_chars")
    fresh = d.withColumn("n_chars", F.col("n_chars") + 1)
    return snapshot.replace_files(d, fresh, d.filter("lang = 'de'").select("doc_id"), "doc_id")


@query
def pass_key(t: Catalog) -> DataFrame:
    return lenses.union_all([snapshot.pass_key(t[n], c).select(F.lit(n).alias("table_name"), "n_rows", "key") for n, c in (("nation", ["n_nationkey", "n_name"]), ("customer", ["c_custkey", "c_name", "c_mktsegment"]), ("labels", ["doc_id", "quality"]))])


# --- gate --------------------------------------------------------------------------------------


def _lines(t: Catalog) -> DataFrame:
    return gate.line_counts(t["documents"], "doc_id", "text")


@query
def line_limits(t: Catalog) -> DataFrame:
    return gate.over_ceiling(_lines(t), 20)


@query
def worst15(t: Catalog) -> DataFrame:
    return gate.worst(_lines(t), 20)


@query
def ratchet(t: Catalog) -> DataFrame:
    counts = t["documents"].groupBy(F.concat_ws("/", "source", "lang").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    base = counts.filter("n % 3 <> 0").select("item", (F.col("n") + F.when(F.col("n") % 2 == 0, 2).otherwise(-1)).alias("n"))
    return gate.ratchet(counts, base, 10)


# --- folds and code ----------------------------------------------------------------------------


@query
def fold_always_maybe(t: Catalog) -> DataFrame:
    li = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return folds.always_maybe(li.select("o_custkey", "o_orderkey", "p_brand"), "o_custkey", "o_orderkey", "p_brand")


@query
def restrict_domain(t: Catalog) -> DataFrame:
    op = F.when(F.col("o_orderkey") % 97 == 0, "unknown").when(F.col("o_orderkey") % 2 == 0, "in").otherwise("not_in")
    rows = t["orders"].groupBy(F.col("o_custkey").alias("k"), op.alias("op")).agg(F.collect_set("o_orderpriority").alias("members"))
    return folds.collapse(rows, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "k")


@query
def entity_keys(t: Catalog) -> DataFrame:
    p = t["part"].select("p_partkey", F.col("p_type").alias("name"), F.col("p_brand").alias("path"))
    return code.entity_keys(p, "name", "path", ["path", "p_partkey"]).select("p_partkey", "entity_key")


@query
def duplicate_names(t: Catalog) -> DataFrame:
    return code.duplicate_names(t["part"], "p_type", "p_brand", "p_size")


@query
def decorator_args(t: Catalog) -> DataFrame:
    return code.joined_args(t["lineitem"], "l_orderkey", "l_linenumber", "l_partkey")


CODE = {
    "functions": "('a.py','f','f','',0,0,0),('a.py','g','g','',0,0,0),('a.py','C.m','m','C',0,0,0),('b.py','D.m','m','D',0,0,0),('b.py','E.x','x','E',0,0,0),('b.py','__h__','__h__','',0,0,0),('b.py','k','k','',1,0,0),('c.py','w','w','',0,0,1)",
    "imports": "('a.py','x','b.py','x',1,0,0),('b.py','x','c.py','x',0,0,0),('c.py','x','d.py','x',0,0,0),('c.py','y','','',0,0,0),('d.py','z','','',0,1,0),('e.py','q','','',CAST(NULL AS INT),0,0)",
    "params": "('f','a',0,0,0),('f','b',1,0,0),('g','c',0,0,0),('h','d',0,1,0),('k','e',2,0,0)",
}


def _values(t: Catalog, name: str, columns: str) -> DataFrame:
    return t.spark.sql(f"SELECT * FROM VALUES {CODE[name]} AS v({columns})")


@query
def dead_candidates(t: Catalog) -> DataFrame:
    f = _values(t, "functions", "path, qualname, name, cls, launched, decorated, wild")
    sql = t.spark.sql
    return code.dead_candidates(f, sql("SELECT 'g' AS qualname"), sql("SELECT 'zzz' AS name"), sql("SELECT * FROM VALUES ('D','C'),('E','Outside') AS v(src, dst)"), sql("SELECT * FROM VALUES ('C'),('D'),('E') AS v(name)"))


@query
def unused_imports(t: Catalog) -> DataFrame:
    return code.unused_imports(_values(t, "imports", "path, local, from_path, name, used, guarded, wild"))


@query
def defaults(t: Catalog) -> DataFrame:
    calls = t.spark.sql("SELECT * FROM VALUES ('f',1,array('b'),0),('f',1,array(),0),('g',0,array(),0),('g',0,array(),1) AS v(fn, n_args, names, splat)")
    return code.default_verdicts(_values(t, "params", "fn, param, position, launched, wild"), calls)


@query
def doc_sections(t: Catalog) -> DataFrame:
    block = F.expr(r"regexp_extract_all(html, '<(h1|p)[^>]*>([^<]*)</', 0)")
    rows = t["pages"].select("page_id", F.posexplode(block).alias("p", "b"))
    kind, text = F.regexp_extract("b", "^<(h1|p)", 1), F.regexp_extract("b", "^<[^>]*>([^<]*)</", 1)
    heading = F.last(F.when(kind == "h1", text), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("p"))
    got = rows.select("page_id", kind.alias("kind"), F.coalesce(heading, F.lit("")).alias("path"), F.char_length(text).alias("n"))
    return got.filter("kind = 'p'").groupBy("page_id", "path").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("chars"))


@query
def sql_surface(t: Catalog) -> DataFrame:
    return t.sql("SELECT n_regionkey, count(*) AS nations, sum(count(*)) OVER (ORDER BY n_regionkey) AS running FROM nation GROUP BY n_regionkey HAVING count(*) > 1")


# --- links -------------------------------------------------------------------------------------


@query
def name_links(t: Catalog) -> DataFrame:
    uses = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), F.when(F.col("l_partkey") % 7 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("name"))
    return links.resolve(uses, t["part"].select(F.col("p_name").alias("name"), F.col("p_partkey").alias("target")))


@query
def suffix_links(t: Catalog) -> DataFrame:
    tail = F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1)
    paths = t["pages"].select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return links.resolve_suffix(t["pages"].select(F.col("page_id").alias("src"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("x"), tail)).otherwise(tail).alias("suffix")), paths)


@query
def dispatch_links(t: Catalog) -> DataFrame:
    sends = t["events"].select(F.col("event_id").alias("site"), F.lit("event").alias("kind"), F.col("event_type").alias("message"))
    handlers = t.spark.sql("SELECT * FROM VALUES ('event','error','Alert'),('event','view','Count'),('event','view','Log'),('other','click','No') AS v(kind, message, handler)")
    return links.dispatch(sends, handlers)


@query
def doc_code_names(t: Catalog) -> DataFrame:
    return links.both_sides(t["part"].filter("p_size < 20").select(F.col("p_name").alias("name")), t["part"].filter("p_size > 40").select(F.col("p_name").alias("name")))


@query
def dangling_refs(t: Catalog) -> DataFrame:
    return links.dangling(t["lineitem"].select(F.col("l_partkey").alias("id")), t["part"].filter("p_size <= 45").select(F.col("p_partkey").alias("id")))


@query
def orphan_nodes(t: Catalog) -> DataFrame:
    every = t["nation"].select(F.col("n_nationkey").cast("long").alias("node"))
    return links.orphans(every, _cut_graph(t), every.filter("node < 2"))


@query
def route_tree(t: Catalog) -> DataFrame:
    r = t["region"].select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lower("r_name").alias("name"))
    n = t["nation"].select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.lower("n_name").alias("name"))
    s = t["supplier"].select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.lower("s_name").alias("name"))
    return links.absolute_paths(graph.cut(r.unionByName(n).unionByName(s)))


@query
def alias_classes(t: Catalog) -> DataFrame:
    pairs = t["nation"].filter("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    sets = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).filter("c_custkey % 6 <> c_nationkey % 6").select(F.col("n_nationkey").alias("key"), F.substring("c_mktsegment", 1, 4).alias("member"))
    return links.unify_aliases(pairs, sets)


@query
def key_builds(t: Catalog) -> DataFrame:
    return links.key_builds(t["region"].select(F.concat(F.lower("r_name"), F.lit(".{}.label")).alias("template")), ["red", "green"])


@query
def package_prefix(t: Catalog) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), "^[a-z]+://", "")
    paths = t["pages"].select(path.alias("path")).distinct()
    return links.nearest_prefix(paths, paths.filter("path LIKE '%/en/%' OR path LIKE '%/de/%'").select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("prefix")))


@query
def carried_ids(t: Catalog) -> DataFrame:
    n = t["nation"]
    old = n.filter("n_nationkey < 15").select("n_name", "n_regionkey", F.concat(F.lit("o:"), F.col("n_nationkey").cast("string")).alias("id"))
    new = n.filter("n_nationkey > 5").select("n_name", "n_regionkey", F.col("n_nationkey").alias("pos"))
    return links.carry_ids(old, new, ["n_name", "n_regionkey"])


@query
def shape_groups(t: Catalog) -> DataFrame:
    shapes = links.shape_hash(nodes.flatten(t["events"], "event_id", "props"))
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query
def gate_chain(t: Catalog) -> DataFrame:
    return links.chain_above(trade_tree(t), _at(t, 3))


@query
def unclaimed_paths(t: Catalog) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), "^[a-z]+://[^/]+", "")
    return paths.unclaimed(t["pages"].select("page_id", path.alias("path")), "path", ("/en/**", "/de/*.html", "/f?/*"))


@query
def reused_hashes(t: Catalog) -> DataFrame:
    e = t["events"].select(F.col("event_id").alias("path"), (F.col("event_id") % 9).alias("size"), F.col("user_id").alias("mtime"))
    s = e.filter("path % 3 <> 0").select("path", F.when(F.col("path") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", F.md5(F.col("path").cast("string")).alias("hash"), F.lit(60).cast("long").alias("created"))
    return snapshot.reuse_hash(e, s)


@query
def file_table_counts(t: Catalog) -> DataFrame:
    return lenses.rows_per_file({"customer": (t["customer"], "c_nationkey"), "supplier": (t["supplier"], "s_nationkey"), "nation": (t["nation"], "n_nationkey")})


@query
def id_lookup(t: Catalog) -> DataFrame:
    return lenses.filled_cells(t["orders"], F.col("o_orderkey") == 7, ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query
def rebased_baseline(t: Catalog) -> DataFrame:
    return gate.rebased(t["documents"].groupBy(F.concat_ws("/", "source", "lang").alias("item")).agg(F.count(F.lit(1)).alias("n")), 20)


@query
def run_totals(t: Catalog) -> DataFrame:
    files = t["documents"].join(t["labels"], "doc_id", "left")
    return lenses.run_totals(files, F.col("quality").isNotNull(), F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1))


@query
def freshness(t: Catalog) -> DataFrame:
    return snapshot.freshness(state_diff(t))


@query
def dependents_reread(t: Catalog) -> DataFrame:
    moved = t["nation"].filter("n_nationkey IN (1, 2, 3)").select(F.col("n_nationkey").cast("long").alias("node"))
    return snapshot.to_reread(moved, trade_graph(t))


@query
def disjunction(t: Catalog) -> DataFrame:
    side = lambda k: t["orders"].filter(f"o_orderkey % 3 = {k}")
    return folds.either(side(0), side(1), "o_custkey", "o_orderpriority")


# --- indexes -----------------------------------------------------------------------------------


@query
def magic_numbers(t: Catalog) -> DataFrame:
    use = F.when(F.col("l_linenumber") == 1, "declared").when(F.col("l_linenumber") == 2, "format").otherwise("compare")
    return indexes.magic_numbers(t["lineitem"].select(F.col("l_quantity").cast("long").alias("v"), use.alias("u")), "v", "u")


@query
def list_readers(t: Catalog) -> DataFrame:
    o = t["orders"].groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("items"))
    p = t["part"].select("p_partkey", F.split("p_name", " ").alias("items"))
    return indexes.readers([("orders", o, "o_custkey", "items"), ("part", p, "p_partkey", "items")], "UR")


@query
def key_sections(t: Catalog) -> DataFrame:
    rows = t["events"].select(
        F.col("event_id").alias("place"), F.concat(F.lit("n"), F.col("user_id") % 7).alias("name"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(F.col("event_id") % 4 == 1, F.concat("event_type", F.lit(".x"))).alias("value"),
        F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("n"), F.col("user_id") % 9)).alias("reads"),
    )
    return indexes.key_sections(rows, "view")


@query
def inverted_index(t: Catalog) -> DataFrame:
    return indexes.inverted(t["part"], "p_name", "p_brand")


@query
def topological_levels(t: Catalog) -> DataFrame:
    return indexes.topological_level(_cut_graph(t))


@query
def atlas(t: Catalog) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    rows = t["pages"].select(F.substring_index(host, ".", -2).alias("project"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^/]*)", 1).alias("route"), host.alias("boundary"))
    return indexes.atlas(rows, "project", "route", "boundary")


@query
def longest_sections(t: Catalog) -> DataFrame:
    rows = t["documents"].groupBy("source", "lang").agg(F.sum("n_chars").alias("chars"))
    return indexes.longest_sections(rows, "source", "lang", "chars", 2)


@query
def inherited_properties(t: Catalog) -> DataFrame:
    base = t["supplier"].select(F.col("s_nationkey").cast("long").alias("node"), F.concat(F.lit("p"), F.col("s_suppkey") % 5).alias("property"))
    return indexes.spread(base, _cut_graph(t))


# --- value semantics ---------------------------------------------------------------------------


@query
def clipped_texts(t: Catalog) -> DataFrame:
    return t["documents"].select("doc_id", clip("text", 40).alias("cell"))


@query
def number_keys(t: Catalog) -> DataFrame:
    """Sizes spelled with and without leading zeros meet under one key; brands stay texts."""
    p = t["part"]
    spelled = p.select(F.lpad(F.col("p_size").cast("string"), 4, "0").alias("v")).union(p.select(F.col("p_size").cast("string"))).union(p.select("p_brand"))
    return spelled.groupBy(number_key("v").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("spellings"))


@query
def content_hashes(t: Catalog) -> DataFrame:
    return t["documents"].select("doc_id", content_hash("text").alias("hash"))


@query
def lenient_numbers(t: Catalog) -> DataFrame:
    cells = t["part"].select("p_brand", tail("p_brand", "#").alias("after")).union(t["part"].select("p_brand", "p_type"))
    return cells.groupBy("p_brand").agg(F.sum(lenient_double("after")).alias("total"))


@query
def name_parts(t: Catalog) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return t["pages"].select("page_id", head(host).alias("first"), tail(host).alias("last"), quoted(host).alias("literal"))


@query
def best_path(t: Catalog) -> DataFrame:
    return lenses.best_match(t["nation"].select("n_nationkey", "n_name"), "n_name", "N_7")
