"""Paths, lookups, statement shapes, gates, declared types, application tables, routes and Python binding, bound to the test tables.

Rows that stand for code are made from whole tables by SQL text that both engines read the same way; `SQL` holds each
question's answer for the independent engine, from the way the rows were made wherever that says it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.catalog import Catalog
from terrace.functions.semantics import format_holes, indented, member_of, normal_path, top_level_args
from terrace.operators import appgraph, binding, correlated, declared, lenses, paths, refresh, restrictions, routes, sqlshape
from terrace.plans.bindings import query, trade_tree
from terrace.sources import documents, files, python_code

SQL: dict[str, str] = {}


def rows(t: Catalog, table: str, columns: str, where: str = "true") -> DataFrame:
    """`name = expression` pairs, one to a line, over a table."""
    pairs = [line.split(" = ", 1) for line in columns.strip().splitlines()]
    return t[table].filter(where).select(*(F.expr(e).alias(name.strip()) for name, e in pairs))


def sql_rows(table: str, columns: str, where: str = "true") -> str:
    pairs = [line.split(" = ", 1) for line in columns.strip().splitlines()]
    return f"SELECT {', '.join(f'{e} AS {name.strip()}' for name, e in pairs)} FROM {table} WHERE {where}"


def spec_rows(t: Catalog, table: str, owner: str, spec: str) -> DataFrame:
    """Node rows from a specification: n | parent | ord | depth | role | kind | value | last | when, value and when in SQL."""
    nodes = [[x.strip() for x in line.split("|")] for line in spec.strip().splitlines()]
    structs = [f"named_struct('n', {n}L, 'parent', bigint({p}), 'ord', bigint({o}), 'depth', bigint({d}), 'role', '{r}', 'kind', {k}, 'value', string({v}), 'last', bigint({last}), 'line', {n}L, 'held', {w})" for n, p, o, d, r, k, v, last, w in nodes]
    return t[table].select(F.col(owner).cast("long").alias("owner"), F.expr(f"inline(array({', '.join(structs)}))")).filter("held").drop("held")


def spec_sql(table: str, owner: str, spec: str) -> str:
    nodes = [[x.strip() for x in line.split("|")] for line in spec.strip().splitlines()]
    return " UNION ALL ".join(f"SELECT {owner}::BIGINT AS owner, {n}::BIGINT AS n, {p}::BIGINT AS parent, {o} AS ord, {d} AS depth, '{r}' AS role, {k} AS kind, ({v})::VARCHAR AS value, {last} AS last FROM {table} WHERE {w}" for n, p, o, d, r, k, v, last, w in nodes)


# --- paths -------------------------------------------------------------------------------------

CODE_PATH = "lower(c_mktsegment) || '/' || CASE WHEN c_custkey % 5 = 0 THEN 'tests/' WHEN c_custkey % 5 = 1 THEN 'src/' ELSE 'lib/' END || 'c' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '.spec.ts' WHEN c_custkey % 11 = 0 THEN '_test.py' ELSE '.ts' END"
FILES = f"id = c_custkey\npath = {CODE_PATH}"
OTHER = f"path = CASE WHEN c_custkey % 2 = 0 THEN 'root/' || {CODE_PATH} ELSE 'c' || c_custkey || '.ts' END"
_LINES = "SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"
CLAIMS = "id = n_nationkey\ntext = 'see `src/' || n_nationkey || '.py`, `lib/x.md` and `plain`'"


def _lines(t: Catalog) -> DataFrame:
    return t["documents"].select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


@query
def product_paths(t: Catalog) -> DataFrame:
    return rows(t, "customer", FILES).filter(paths.not_test("path"))


SQL["product_paths"] = f"SELECT id, path FROM ({sql_rows('customer', FILES)}) WHERE NOT (id % 5 = 0 OR id % 7 = 0 OR id % 11 = 0)"


@query
def path_under_root(t: Catalog) -> DataFrame:
    return paths.under_root(rows(t, "customer", FILES), "path", "work/furniture/src", [("", "/home/me/work"), ("", "/srv")])


SQL["path_under_root"] = f"SELECT id, path, 'furniture/src' AS read_as FROM ({sql_rows('customer', FILES)}) WHERE path ILIKE '%furniture/src%'"


@query
def paths_either_way(t: Catalog) -> DataFrame:
    return paths.either_way(rows(t, "customer", FILES), rows(t, "customer", OTHER))


SQL["paths_either_way"] = f"""WITH a AS ({sql_rows('customer', FILES)}), b AS ({sql_rows('customer', OTHER)})
  SELECT DISTINCT a.path AS left_path, b.path AS right_path FROM a JOIN b ON a.path = b.path OR ends_with(a.path, '/' || b.path) OR ends_with(b.path, '/' || a.path)"""


@query
def unwaived_findings(t: Catalog) -> DataFrame:
    lines = _lines(t)
    return paths.unwaived(lines.filter("text LIKE '%the%'").select("path", "line"), lines, "an").select("path", F.col("line").cast("long").alias("line"))


SQL["unwaived_findings"] = f"""WITH l AS ({_LINES}), m AS (SELECT path, line FROM l WHERE contains(text, 'an'))
  SELECT path, line::BIGINT AS line FROM l WHERE contains(text, 'the') AND (path, line) NOT IN (SELECT (path, line) FROM m) AND (path, line - 1) NOT IN (SELECT (path, line) FROM m)"""


@query
def tracked_files(t: Catalog) -> DataFrame:
    known = rows(t, "customer", FILES)
    return paths.tracked(known.filter("id % 9 <> 0"), known.filter("id % 4 <> 0"))


SQL["tracked_files"] = f"""SELECT path, CASE WHEN id % 4 = 0 THEN 'deleted' WHEN id % 9 = 0 THEN 'untracked' ELSE 'tracked' END AS state
  FROM ({sql_rows('customer', FILES)}) WHERE id % 9 <> 0 OR id % 4 <> 0"""


@query
def doc_path_claims(t: Catalog) -> DataFrame:
    there = rows(t, "nation", "path = 'root/src/' || n_nationkey || '.py'", "n_nationkey % 2 = 0")
    return paths.path_claims(rows(t, "nation", CLAIMS), "id", "text", there)


SQL["doc_path_claims"] = """SELECT n_nationkey AS id, 'src/' || n_nationkey || '.py' AS claim, n_nationkey % 2 = 0 AS exists FROM nation
  UNION ALL SELECT n_nationkey, 'lib/x.md', false FROM nation"""


# --- lookups and ordered cuts ------------------------------------------------------------------


@query
def row_limit(t: Catalog) -> DataFrame:
    return correlated.limited(t["part"].select("p_partkey", "p_name"), ["p_partkey"], 5)


SQL["row_limit"] = "SELECT p_partkey, p_name, (SELECT count(*) FROM part) - 5 AS more FROM part ORDER BY p_partkey LIMIT 5"


@query
def biggest_first(t: Catalog) -> DataFrame:
    return correlated.biggest_first(t["events"].groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "n", "event_type")


SQL["biggest_first"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1"


@query
def groups_order(t: Catalog) -> DataFrame:
    groups = t["documents"].groupBy(F.md5("text").alias("text")).agg(F.count(F.lit(1)).alias("places"), F.max("n_chars").alias("size"))
    return correlated.groups_order(groups.filter("places >= 2"))


SQL["groups_order"] = "SELECT md5(text) AS text, count(*) AS places, max(n_chars) AS size FROM documents GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 3 DESC, 1"


@query
def pairs_order(t: Catalog) -> DataFrame:
    return correlated.pairs_order(rows(t, "part", "score = p_size\nshared = p_size % 7\nsize = p_retailprice\nat = p_partkey"))


SQL["pairs_order"] = "SELECT p_size AS score, p_size % 7 AS shared, p_retailprice AS size, p_partkey AS at FROM part ORDER BY 1 DESC, 2 DESC, 3 DESC, 4"


@query
def heaviest_edges(t: Catalog) -> DataFrame:
    edges = t["orders"].groupBy(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return correlated.heaviest(edges, "weight", 20, ["src", "dst"])


SQL["heaviest_edges"] = "SELECT o_custkey AS src, o_orderpriority AS dst, count(*) AS weight FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20"


@query
def first_child_value(t: Catalog) -> DataFrame:
    return correlated.first_child(trade_tree(t), "customer", "customer")


@query
def few_joined(t: Catalog) -> DataFrame:
    return correlated.few_joined(t["orders"], "o_custkey", ["o_orderkey"], "o_orderpriority", 4, "sites")


SQL["few_joined"] = """SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY o_orderkey) AS sites
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 4 GROUP BY 1"""


@query
def node_outline(t: Catalog) -> DataFrame:
    return trade_tree(t).select("owner", "n", indented("depth", "value").alias("line"))


@query
def json_member(t: Catalog) -> DataFrame:
    return t["events"].select("event_id", member_of("props", "k").alias("k"), member_of("props", "none").alias("absent"))


SQL["json_member"] = "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS absent FROM events"


@query
def generic_args(t: Catalog) -> DataFrame:
    text = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'Plain' ELSE 'A.Base<List<' || p_brand || ',' || p_type || '>, ' || p_size || '>' END")
    return t["part"].select("p_partkey", F.array_join(top_level_args(text), "|").alias("args"))


SQL["generic_args"] = "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'List<' || p_brand || ',' || p_type || '>|' || p_size END AS args FROM part"

# --- statement shapes --------------------------------------------------------------------------

STATEMENT = """
0 | NULL | 0 | 0 | | 'query' | NULL | 23 | true
1 | 0 | 0 | 1 | | 'select' | NULL | 6 | true
2 | 1 | 0 | 2 | | 'column' | 'o_totalprice' | 3 | true
3 | 2 | 0 | 3 | | 'qualifier' | 'O' | 3 | o_orderkey % 2 = 0
4 | 1 | 1 | 2 | | 'func' | 'count' | 6 | true
5 | 4 | 0 | 3 | | 'over' | NULL | 6 | o_orderkey % 5 = 0
6 | 5 | 0 | 4 | | 'orderby' | NULL | 6 | o_orderkey % 5 = 0
7 | 0 | 1 | 1 | | 'join' | CASE WHEN o_orderkey % 2 = 0 THEN 'inner' ELSE 'left' END | 13 | true
8 | 7 | 0 | 2 | | 'table' | 'orders' | 9 | true
9 | 8 | 0 | 3 | | 'alias' | 'o' | 9 | true
10 | 7 | 1 | 2 | | 'table' | CASE WHEN o_orderkey % 3 = 0 THEN '#tmp' WHEN o_orderkey % 7 = 0 THEN 'Recent' ELSE 'customer' END | 12 | true
11 | 10 | 0 | 3 | | 'alias' | 'c' | 11 | o_orderkey % 4 <> 0
12 | 10 | 1 | 3 | | 'schema' | 'sales' | 12 | o_orderkey % 5 = 1
13 | 7 | 2 | 2 | | 'on' | NULL | 13 | true
14 | 0 | 2 | 1 | | 'where' | NULL | 21 | true
15 | 14 | 0 | 2 | | 'in' | NULL | 18 | true
16 | 15 | 0 | 3 | | 'column' | 'o_custkey' | 16 | true
17 | 15 | 1 | 3 | | 'literal' | o_custkey | 17 | true
18 | 15 | 2 | 3 | | 'literal' | o_orderkey | 18 | o_orderkey % 3 <> 0
19 | 14 | 1 | 2 | | 'subquery' | NULL | 21 | o_orderkey % 6 = 0
20 | 19 | 0 | 3 | | 'table' | 'lineitem' | 20 | o_orderkey % 6 = 0
21 | 19 | 1 | 3 | | 'column' | 'l_tax' | 21 | o_orderkey % 6 = 0
22 | 0 | 3 | 1 | | 'orderby' | NULL | 22 | true
23 | 0 | 4 | 1 | | 'cte' | 'recent' | 23 | o_orderkey % 7 = 0
"""


def _statements(t: Catalog) -> DataFrame:
    return spec_rows(t, "orders", "o_orderkey", STATEMENT)


@query
def sql_fingerprints(t: Catalog) -> DataFrame:
    return sqlshape.fingerprints(_statements(t))


SQL["sql_fingerprints"] = f"""SELECT owner, sha256(string_agg(depth || ':' || kind || ':' || CASE WHEN kind = 'literal' THEN '' ELSE coalesce(value, '') END, ';' ORDER BY n)) AS fingerprint
  FROM ({spec_sql('orders', 'o_orderkey', STATEMENT)}) WHERE n <> 18 GROUP BY 1"""


@query
def sql_clauses(t: Catalog) -> DataFrame:
    return sqlshape.clauses(_statements(t))


SQL["sql_clauses"] = """SELECT o_orderkey::BIGINT AS owner, CASE WHEN o_orderkey % 2 = 0 THEN 'join' ELSE 'leftjoin' END AS kind, 7::BIGINT AS line FROM orders
  UNION ALL SELECT o_orderkey, 'where', 14 FROM orders UNION ALL SELECT o_orderkey, 'orderby', 22 FROM orders
  UNION ALL SELECT o_orderkey, 'window', 5 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'subquery', 19 FROM orders WHERE o_orderkey % 6 = 0
  UNION ALL SELECT o_orderkey, 'cte', 23 FROM orders WHERE o_orderkey % 7 = 0"""


@query
def sql_joins(t: Catalog) -> DataFrame:
    return sqlshape.joins(_statements(t))


SQL["sql_joins"] = """SELECT o_orderkey::BIGINT AS owner, CASE WHEN o_orderkey % 2 = 0 THEN 'inner' ELSE 'left' END AS type, 'table' AS joined,
    CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'sales' ELSE 'dbo' END AS schema,
    CASE WHEN o_orderkey % 3 = 0 THEN '#tmp' WHEN o_orderkey % 7 = 0 THEN 'Recent' ELSE 'customer' END AS name,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'c' ELSE '' END AS alias, 13::BIGINT AS on_line, 7::BIGINT AS line FROM orders"""


@query
def sql_functions(t: Catalog) -> DataFrame:
    return sqlshape.functions(_statements(t))


SQL["sql_functions"] = "SELECT o_orderkey::BIGINT AS owner, 'count' AS name, o_orderkey % 5 = 0 AS windowed, 4::BIGINT AS line FROM orders"


@query
def sql_ctes(t: Catalog) -> DataFrame:
    return sqlshape.ctes(_statements(t))


SQL["sql_ctes"] = "SELECT o_orderkey::BIGINT AS owner, 'recent' AS name, 23::BIGINT AS line FROM orders WHERE o_orderkey % 7 = 0"


@query
def sql_columns(t: Catalog) -> DataFrame:
    return sqlshape.column_refs(_statements(t))


SQL["sql_columns"] = """SELECT o_orderkey::BIGINT AS owner, 2::BIGINT AS n, 'o_totalprice' AS "column", CASE WHEN o_orderkey % 2 = 0 THEN 'orders' ELSE '' END AS name, 'select' AS role FROM orders
  UNION ALL SELECT o_orderkey, 16, 'o_custkey', '', 'where' FROM orders UNION ALL SELECT o_orderkey, 21, 'l_tax', 'lineitem', 'where' FROM orders WHERE o_orderkey % 6 = 0"""

OBJECTS = "schema = 'dbo'\nname = 'T' || (p_partkey % 6)\ndatabase = CASE p_partkey % 12 WHEN 0 THEN '' WHEN 6 THEN '' WHEN 1 THEN 'A' WHEN 7 THEN 'A' WHEN 2 THEN 'A' WHEN 8 THEN 'B' WHEN 3 THEN 'B' WHEN 9 THEN 'C' WHEN 4 THEN '' WHEN 10 THEN 'C' ELSE 'B' END"
NAMES = "site = o_orderkey\nschema = CASE WHEN o_orderkey % 10 = 0 THEN 'SYS' ELSE 'dbo' END\nname = CASE WHEN o_orderkey % 11 <> 0 THEN 't' || (o_custkey % 8) END"


@query
def sql_objects(t: Catalog) -> DataFrame:
    allowed = rows(t, "orders", "site = o_orderkey\ndatabase = 'B'", "o_orderkey % 13 = 0")
    return sqlshape.resolve_objects(rows(t, "orders", NAMES), rows(t, "part", OBJECTS), allowed, "A")


SQL["sql_objects"] = f"""WITH v(k, narrow, status, database, detail) AS (VALUES (0, false, 'bound', '', ''), (1, false, 'bound', 'A', ''), (2, false, 'bound', 'A', 'default of A, B'), (3, false, 'ambiguous', '', 'B, C'),
    (4, false, 'bound', 'C', ''), (5, false, 'bound', 'B', ''), (2, true, 'bound', 'B', ''), (3, true, 'bound', 'B', ''), (5, true, 'bound', 'B', ''))
  SELECT site, name, CASE WHEN name IS NULL THEN 'dynamic' WHEN schema = 'SYS' THEN 'system' ELSE coalesce(status, 'missing') END AS status,
    CASE WHEN name IS NULL OR schema = 'SYS' THEN '' ELSE coalesce(database, '') END AS database, CASE WHEN name IS NULL OR schema = 'SYS' THEN '' ELSE coalesce(detail, '') END AS detail
  FROM ({sql_rows('orders', NAMES)}) LEFT JOIN v ON name = 't' || k AND narrow = (site % 13 = 0)"""

# --- gates -------------------------------------------------------------------------------------

COMPARISONS = """gate = o_orderkey
enum = 'Priority'
dim = o_orderstatus
op = CASE o_orderkey % 5 WHEN 0 THEN '===' WHEN 1 THEN '!==' WHEN 2 THEN '<' WHEN 3 THEN '==' ELSE '!=' END
member = CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END
is_null = o_orderkey % 11 = 0
negated = o_orderkey % 2 = 0"""


@query
def comparison_restrictions(t: Catalog) -> DataFrame:
    return restrictions.comparisons(rows(t, "orders", COMPARISONS))


SQL["comparison_restrictions"] = f"""SELECT gate, enum, dim, op, CASE WHEN op <> 'unknown' THEN member END AS member FROM (SELECT gate, enum, dim, member,
    CASE WHEN op = '<' OR member IS NULL THEN 'unknown' WHEN op IN ('===', '==') THEN CASE WHEN negated THEN 'not_in' ELSE 'in' END WHEN negated THEN 'in' ELSE 'not_in' END AS op
  FROM ({sql_rows('orders', COMPARISONS)}) WHERE NOT is_null)"""

CONDITION = """
0 | NULL | 0 | 0 | | CASE WHEN p_size % 2 = 0 THEN 'and' ELSE 'or' END | NULL | 6 | true
1 | 0 | 0 | 1 | | CASE WHEN p_size % 3 = 0 THEN 'not' ELSE 'leaf' END | p_type | 5 | true
2 | 1 | 0 | 2 | | CASE WHEN p_size % 4 < 2 THEN 'or' ELSE 'and' END | NULL | 5 | p_size % 3 = 0
3 | 2 | 0 | 3 | | 'leaf' | p_brand | 3 | p_size % 3 = 0
4 | 2 | 1 | 3 | | 'not' | NULL | 5 | p_size % 3 = 0
5 | 4 | 0 | 4 | | 'leaf' | p_name | 5 | p_size % 3 = 0
6 | 0 | 1 | 1 | | 'leaf' | 'last' | 6 | true
"""


@query
def necessary_features(t: Catalog) -> DataFrame:
    return restrictions.necessary(spec_rows(t, "part", "p_partkey", CONDITION))


SQL["necessary_features"] = """SELECT p_partkey::BIGINT AS owner, 'last' AS feature FROM part WHERE p_size % 2 = 0 UNION SELECT p_partkey, p_type FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0
  UNION SELECT p_partkey, p_name FROM part WHERE p_size % 6 = 0 AND p_size % 4 < 2"""

REFS, PATHS = "key = p_brand\nref = p_partkey\ncomponent = p_partkey % 100", "component = s_suppkey % 100\npath = s_suppkey"


def _own(t: Catalog) -> DataFrame:
    gate = "ref = p_partkey\ngate = CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE 'n1' END"
    return rows(t, "part", "ref = p_partkey\ngate = 't:' || p_type", "p_size % 2 = 0").unionByName(rows(t, "part", gate))


_OWN = "SELECT p_partkey AS ref, 't:' || p_type AS gate FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE 'n1' END FROM part"


@query
def key_reach(t: Catalog) -> DataFrame:
    gates = rows(t, "supplier", "path = s_suppkey\ngate = 'n' || s_nationkey % 3").unionByName(rows(t, "supplier", "path = s_suppkey\ngate = 'all'"))
    return restrictions.key_reach(rows(t, "part", REFS), _own(t), rows(t, "supplier", PATHS), gates)


SQL["key_reach"] = f"""WITH own AS ({_OWN}), ways AS (SELECT key, ref, path FROM ({sql_rows('part', REFS)}) JOIN ({sql_rows('supplier', PATHS)}) USING (component)),
  p AS (SELECT s_suppkey AS path, 'n' || s_nationkey % 3 AS gate FROM supplier UNION ALL SELECT s_suppkey, 'all' FROM supplier),
  held AS (SELECT key, ref, path, gate, false AS of_path FROM ways JOIN own USING (ref) UNION ALL SELECT key, ref, path, gate, true FROM ways JOIN p USING (path)),
  c AS (SELECT key, gate, count(DISTINCT (ref, path)) AS n, count(DISTINCT CASE WHEN of_path THEN (ref, path) END) AS m FROM held GROUP BY 1, 2), w AS (SELECT key, count(*) AS n_paths FROM ways GROUP BY 1)
  SELECT key, n_paths, coalesce(string_agg(CASE WHEN n = n_paths THEN gate END, ',' ORDER BY gate), '') AS always, string_agg(gate, ',' ORDER BY gate) AS maybe,
    coalesce(string_agg(CASE WHEN m = n_paths THEN gate END, ',' ORDER BY gate), '') AS path_always FROM w JOIN c USING (key) GROUP BY 1, 2"""


@query
def key_ways(t: Catalog) -> DataFrame:
    return restrictions.key_ways(rows(t, "part", REFS), _own(t), rows(t, "supplier", PATHS))


SQL["key_ways"] = f"""WITH c AS (SELECT ref, 'ch:' || substr(sha256(string_agg(length(gate) || ':' || gate, '' ORDER BY gate)), 1, 16) AS chain FROM ({_OWN}) GROUP BY 1)
  SELECT key, ref, path, chain FROM ({sql_rows('part', REFS)}) JOIN ({sql_rows('supplier', PATHS)}) USING (component) JOIN c USING (ref)"""


@query
def key_source_trace(t: Catalog) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    keys = t["pages"].select(F.explode(F.array(host, F.concat(host, F.lit(".zz")), F.concat(F.lit("qq."), F.substring_index(host, ".", -1)), F.lit("qq.none"))).alias("key"))
    return restrictions.source_trace(keys, t["pages"].select(F.col("page_id").alias("file"), (F.col("page_id") % 2 == 0).alias("parsed"), F.col("html").alias("text")))


SQL["key_source_trace"] = r"""WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages), k AS (SELECT h AS key FROM h UNION SELECT h || '.zz' FROM h UNION SELECT 'qq.' || string_split(h, '.')[-1] FROM h UNION SELECT 'qq.none'),
  s AS (SELECT page_id AS file, page_id % 2 = 0 AS parsed, regexp_replace(regexp_replace(html, '(?s)/\*.*?\*/|<!--.*?-->', ' ', 'g'), '(?m)(^|[^:])//.*$', '\1', 'g') AS t FROM pages),
  d AS (SELECT w, min(CASE WHEN parsed THEN file END) AS f0, min(file) AS f1 FROM (SELECT file, parsed, unnest(regexp_extract_all(t, '[A-Za-z_][\w-]*(?:\.[\w-]+)*')) AS w FROM s) GROUP BY 1),
  l AS (SELECT w, min(file) AS f3 FROM (SELECT file, unnest(regexp_extract_all(t, '[\w-]+')) AS w FROM s) GROUP BY 1)
  SELECT key, CASE WHEN a.f0 IS NOT NULL THEN 'full_literal' WHEN a.f1 IS NOT NULL THEN 'unparsed_file' WHEN b.f1 IS NOT NULL THEN 'prefix' WHEN f3 IS NOT NULL THEN 'leaf' ELSE 'absent' END AS how, coalesce(a.f0, a.f1, b.f1, f3) AS file
  FROM k LEFT JOIN d a ON a.w = key LEFT JOIN d b ON b.w = regexp_extract(key, '^(.*)\.[^.]*$', 1) LEFT JOIN l ON l.w = string_split(key, '.')[-1]"""

# --- declared types ----------------------------------------------------------------------------

CLASSES = """cls = 'C:' || s_name
name = CASE WHEN s_suppkey % 4 = 0 THEN lower(s_name) ELSE s_name END
namespace = CASE WHEN s_suppkey % 3 = 0 THEN 'app.beta' ELSE 'app.core' END
bases = array(CASE WHEN s_suppkey % 7 = 0 THEN 'Other' ELSE 'Mid<X>' END)"""


def _classes(t: Catalog) -> DataFrame:
    mid = t["region"].filter("r_regionkey = 0").select(F.lit("Mid").alias("cls"), F.lit("Mid").alias("name"), F.lit("lib").alias("namespace"), F.array(F.lit("Root<T>")).alias("bases"))
    return rows(t, "supplier", CLASSES).unionByName(mid)


def _conventions(t: Catalog) -> DataFrame:
    each = "convention = 'E' || r_regionkey\nbase = CASE WHEN r_regionkey < 3 THEN 'Root' ELSE 'Nope' END\nnamespace = 'app'\nprefixes = array('beta')\nignore_case = r_regionkey = 0"
    return rows(t, "region", each, "r_regionkey < 4")


_FOUND = "s_suppkey % 7 <> 0 AND {c} < 3 AND ({c} = 0 OR s_suppkey % 4 <> 0)"
_KIND = "CASE WHEN NOT ({found}) THEN 'none' WHEN s_suppkey % 3 = 0 THEN 'override' ELSE 'default' END"


@query
def enum_type_links(t: Catalog) -> DataFrame:
    return declared.enum_type_links(rows(t, "supplier", "enum = 'E' || s_suppkey % 5\nname = s_name"), _classes(t), _conventions(t))


_BY_ENUM = _FOUND.format(c="s_suppkey % 5")
SQL["enum_type_links"] = f"SELECT 'E' || s_suppkey % 5 AS enum, s_name AS name, CASE WHEN {_BY_ENUM} THEN 'C:' || s_name END AS type, {_KIND.format(found=_BY_ENUM)} AS kind FROM supplier"


@query
def name_type_links(t: Catalog) -> DataFrame:
    calls = rows(t, "supplier", "site = s_suppkey\nconvention = 'E1'\nliteral = CASE WHEN s_suppkey % 3 = 0 THEN s_name END\nproperty = CASE WHEN s_suppkey % 3 = 1 THEN 'P' || s_suppkey % 4 END")
    written = rows(t, "supplier", "property = 'P' || s_suppkey % 4\nvalue = s_name", "s_suppkey % 6 = 5")
    return declared.name_type_links(calls, written, _classes(t), _conventions(t))


_BY_NAME = _FOUND.format(c="1")
SQL["name_type_links"] = f"""WITH named AS (SELECT s_suppkey AS site, 'literal' AS via, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT a.s_suppkey, 'property', b.s_name FROM supplier a JOIN supplier b ON a.s_suppkey % 4 = b.s_suppkey % 4 WHERE a.s_suppkey % 3 = 1 AND b.s_suppkey % 6 = 5
    UNION ALL SELECT s_suppkey, 'unresolved', NULL FROM supplier a WHERE s_suppkey % 3 = 2 OR s_suppkey % 3 = 1 AND NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_suppkey % 4 = a.s_suppkey % 4 AND b.s_suppkey % 6 = 5))
  SELECT site, via, name, CASE WHEN {_BY_NAME} THEN 'C:' || s_name END AS type, CASE WHEN s_name IS NULL THEN 'none' ELSE {_KIND.format(found=_BY_NAME)} END AS kind FROM named LEFT JOIN supplier ON s_name = name"""


@query
def endpoint_types(t: Catalog) -> DataFrame:
    endpoints = rows(t, "supplier", "endpoint = s_suppkey\ntype = 'Task<List<T' || s_suppkey || '>>'", "s_suppkey % 10 = 0")
    return declared.types_used(endpoints, rows(t, "supplier", "cls = 'T' || s_suppkey\ntype = 'Map<string,T' || cast(floor(s_suppkey / 2) AS bigint) || '>'"))


SQL["endpoint_types"] = """WITH RECURSIVE u AS (SELECT s_suppkey AS endpoint, s_suppkey AS k FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT endpoint, k // 2 FROM u)
  SELECT endpoint, 'T' || k AS type FROM u"""


def _generic(t: Catalog) -> DataFrame:
    serving = rows(t, "supplier", "cls = 'S' || s_suppkey\nparams = cast(array() AS array<string>)\nbases = array('G1<Int' || s_suppkey || ', Str>')")
    two = "cls = 'G' || r_regionkey\nparams = CASE WHEN r_regionkey = 0 THEN array('A', 'B') ELSE array('X', 'Y') END\nbases = CASE WHEN r_regionkey = 1 THEN array('G0<Y, List<X>>') ELSE cast(array() AS array<string>) END"
    return serving.unionByName(rows(t, "region", two, "r_regionkey < 2"))


@query
def generic_bases(t: Catalog) -> DataFrame:
    return declared.bound_bases(_generic(t)).select("cls", "base", F.array_join("args", "|").alias("args"))


SQL["generic_bases"] = """SELECT 'S' || s_suppkey AS cls, 'G1' AS base, 'Int' || s_suppkey || '|Str' AS args FROM supplier
  UNION ALL SELECT 'S' || s_suppkey, 'G0', 'Str|List<Int' || s_suppkey || '>' FROM supplier UNION ALL SELECT 'G1', 'G0', 'Y|List<X>'"""


@query
def served_types(t: Catalog) -> DataFrame:
    return declared.served_types(rows(t, "region", "owner = 'G0'\naction = 'get'\ntype = 'Task<B>'", "r_regionkey = 0"), _generic(t))


SQL["served_types"] = """SELECT 'S' || s_suppkey AS cls, 'get' AS action, 'Task<List<Int' || s_suppkey || '>>' AS type FROM supplier
  UNION ALL SELECT 'G1', 'get', 'Task<List<X>>' UNION ALL SELECT 'G0', 'get', 'Task<B>'"""

# --- application tables ------------------------------------------------------------------------


@query
def state_graph(t: Catalog) -> DataFrame:
    handlers = rows(t, "events", "action = event_type\nreducer = 'r:' || event_type\nstate = 's' || length(event_type) % 3").distinct()
    effects = rows(t, "events", "effect = 'fx:' || event_type\naction = event_type", "event_type LIKE 'e%'")
    return appgraph.state_graph(rows(t, "events", "site = 'u' || user_id\naction = event_type"), handlers, rows(t, "nation", "selector = n_name\nstate = 's' || n_nationkey % 3"), effects)


SQL["state_graph"] = """SELECT 'u' || user_id AS src, event_type AS dst, 'dispatches' AS kind FROM events UNION SELECT event_type, 'r:' || event_type, 'handled by' FROM events
  UNION SELECT 'r:' || event_type, n_name, 'read by' FROM (SELECT DISTINCT event_type FROM events) JOIN nation ON length(event_type) % 3 = n_nationkey % 3
  UNION SELECT event_type, 'fx:' || event_type, 'starts' FROM events WHERE event_type LIKE 'e%'"""


@query
def input_usage(t: Catalog) -> DataFrame:
    bindings = rows(t, "part", "component = p_brand\nname = p_type\nscope = CASE WHEN p_partkey % 5 = 0 THEN 'out_of_scope' ELSE 'imported' END")
    return appgraph.input_usage(rows(t, "part", "component = p_brand\nname = p_type", "p_size < 10"), bindings)


SQL["input_usage"] = """SELECT p_brand AS component, p_type AS name, count(*) FILTER (p_partkey % 5 <> 0) AS n_bindings, bool_or(p_size < 10) AS declared FROM part GROUP BY 1, 2
  HAVING bool_or(p_size < 10) OR count(*) FILTER (p_partkey % 5 <> 0) > 0"""


@query
def federation_routes(t: Catalog) -> DataFrame:
    routes_ = rows(t, "supplier", "route = s_suppkey\nremote = 'r' || s_suppkey % 5\nmodule = './M' || s_suppkey % 4\npicked = 'K' || s_suppkey % 3")
    exposes = rows(t, "nation", "config = CASE WHEN n_nationkey % 4 = 1 THEN 'c' || n_nationkey % 8 ELSE 'c' || n_nationkey % 4 END\nremote = 'r' || n_nationkey % 4\nmodule = './M' || n_nationkey % 3\nfile = 'f' || n_nationkey % 12")
    return appgraph.federation_routes(routes_, exposes, rows(t, "nation", "cls = 'id' || n_nationkey\nname = 'K' || n_nationkey % 3\nfile = 'f' || n_nationkey", "n_nationkey < 12"))


SQL["federation_routes"] = """SELECT s_suppkey AS route, 'r' || s_suppkey % 5 || '/M' || s_suppkey % 4 AS request,
    (SELECT 'id' || n_nationkey FROM nation WHERE n_nationkey < 12 AND n_nationkey % 4 <> 1 AND n_nationkey % 4 = s_suppkey % 5 AND n_nationkey % 3 = s_suppkey % 4 AND n_nationkey % 3 = s_suppkey % 3) AS cls FROM supplier"""


@query
def translation_keys(t: Catalog) -> DataFrame:
    return appgraph.translations(rows(t, "documents", "locale = lang\nkey = 'k' || n_chars % 50", "doc_id % 2 = 0"), rows(t, "documents", "key = 'k' || n_chars % 70", "doc_id % 2 = 1"))


SQL["translation_keys"] = """WITH d AS (SELECT 'k' || n_chars % 50 AS key, count(DISTINCT lang) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), r AS (SELECT 'k' || n_chars % 70 AS key, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
  SELECT key, CASE WHEN r.n IS NULL THEN 'defined' WHEN d.n IS NULL THEN 'referenced' ELSE 'both' END AS status, coalesce(d.n, 0) AS n_locales, coalesce(r.n, 0) AS n_refs FROM d FULL JOIN r USING (key)"""


@query
def hiding_classes(t: Catalog) -> DataFrame:
    rules = rows(t, "nation", "file = 'f' || n_nationkey\nselector = CASE WHEN n_nationkey % 2 = 0 THEN '.h' || n_nationkey % 10 ELSE '.h' || n_nationkey % 10 || ':hover' END\ncls = 'h' || n_nationkey % 10\nlive = n_nationkey % 3 <> 0")
    own = rows(t, "nation", "component = n_nationkey\nfile = 'f' || n_nationkey", "n_nationkey < 15")
    return appgraph.hiding_classes(rows(t, "customer", "gate = c_custkey\ncomponent = c_nationkey\ncls = 'h' || c_custkey % 10"), rules, own)


SQL["hiding_classes"] = """SELECT c_custkey AS gate, 'f' || n_nationkey AS file, '.h' || n_nationkey % 10 || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ':hover' END AS selector,
    CASE WHEN n_nationkey >= 15 THEN 'shared' WHEN c_nationkey = n_nationkey THEN 'own' ELSE 'other' END AS scope, n_nationkey % 2 = 0 AS bare FROM customer JOIN nation ON c_custkey % 10 = n_nationkey % 10 WHERE n_nationkey % 3 <> 0"""

READ = """
0 | NULL | 0 | 0 | | 'Call' | NULL | 5 | true
1 | 0 | 0 | 1 | expr | CASE WHEN o_orderkey % 2 = 0 THEN 'Read' ELSE 'Write' END | NULL | 5 | true
2 | 1 | 0 | 2 | target | 'object' | NULL | 5 | o_orderkey % 9 <> 0
3 | 2 | 0 | 3 | name | 'string' | concat('m', o_custkey % 9) | 3 | o_orderkey % 9 <> 0
4 | 2 | 1 | 3 | file | 'string' | concat('f', o_custkey % 4) | 4 | o_orderkey % 9 <> 0
5 | 2 | 2 | 3 | line | 'number' | o_custkey % 5 | 5 | o_orderkey % 9 <> 0
"""


@query
def flat_reads(t: Catalog) -> DataFrame:
    return appgraph.flat_reads(spec_rows(t, "orders", "o_orderkey", READ))


SQL["flat_reads"] = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Read' ELSE 'Write' END AS kind, 'm' || o_custkey % 9 AS name, 'f' || o_custkey % 4 AS file, (o_custkey % 5)::VARCHAR AS line,
  count(*) AS n_expressions, min(o_orderkey)::BIGINT AS expression FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1, 2, 3, 4"""


@query
def render_scope(t: Catalog) -> DataFrame:
    seven = "n_nationkey < 7"
    modules = rows(t, "customer", "component = 'u' || c_custkey\nmodule = 'M' || c_custkey % 5", "c_custkey % 11 <> 0").unionByName(rows(t, "nation", "component = 'd' || n_nationkey\nmodule = 'M' || n_nationkey", seven))
    exports = rows(t, "nation", "module = 'M' || n_nationkey\nitem = 'd' || n_nationkey", seven).unionByName(rows(t, "nation", "module = 'M' || n_nationkey\nitem = 'M' || (n_nationkey + 1)", seven + " AND n_nationkey % 2 = 0"))
    return appgraph.render_scope(rows(t, "customer", "user = 'u' || c_custkey\ncandidate = 'd' || c_custkey % 7"), modules, exports, rows(t, "nation", "module = 'M' || n_nationkey\nimported = 'M' || (n_nationkey + 2)", seven))


SQL["render_scope"] = """SELECT 'u' || c_custkey AS user, 'd' || c_custkey % 7 AS candidate, CASE WHEN c_custkey % 11 = 0 THEN 'unknown' WHEN c_custkey % 5 = c_custkey % 7 THEN 'declared'
  WHEN c_custkey % 7 = c_custkey % 5 + 2 OR c_custkey % 5 % 2 = 0 AND c_custkey % 7 = c_custkey % 5 + 3 THEN 'imported' ELSE 'out_of_scope' END AS scope FROM customer"""

# --- refresh -----------------------------------------------------------------------------------


@query
def replaced_half(t: Catalog) -> DataFrame:
    stored = rows(t, "customer", "id = c_custkey\nv = c_name\nhalf = CASE c_custkey % 3 WHEN 0 THEN 'ts' WHEN 1 THEN 'cs' END")
    return refresh.replace_half(stored, rows(t, "supplier", "id = s_suppkey\nv = s_name"), "ts")


SQL["replaced_half"] = """SELECT c_custkey AS id, c_name AS v, CASE WHEN c_custkey % 3 = 1 THEN 'cs' END AS half FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_name, 'ts' FROM supplier"""


@query
def broken_files(t: Catalog) -> DataFrame:
    stored = rows(t, "customer", f"path = {CODE_PATH}\nhash = md5(c_name)")
    tree = rows(t, "customer", f"path = {CODE_PATH}\nhash = CASE WHEN c_custkey % 20 = 0 THEN 'x' ELSE md5(c_name) END", "c_custkey % 30 <> 1")
    return refresh.broken_files(stored, tree)


SQL["broken_files"] = f"SELECT {CODE_PATH} AS path, md5(c_name) AS stored_hash, CASE WHEN c_custkey % 20 = 0 THEN 'x' END AS tree_hash FROM customer WHERE c_custkey % 20 = 0 OR c_custkey % 30 = 1"


@query
def stale_maps(t: Catalog) -> DataFrame:
    now = rows(t, "nation", "map = n_regionkey\npath = n_name\nmtime = n_nationkey")
    then = now.filter("mtime < 22").groupBy("map").agg(F.collect_list("path").alias("p"))
    part = lambda at: F.expr(f"string(aggregate(p, cast(0 AS decimal(38,0)), (a, x) -> cast(a + cast(conv(substring(md5(x), {at}, 15), 16, 10) AS decimal(28,0)) AS decimal(38,0))))")
    recorded = then.select("map", F.concat_ws("-", F.size("p").cast("string"), part(1), part(16)).alias("file_set")).withColumn("built", F.lit(23))
    return refresh.stale(recorded, now, rows(t, "region", "map = r_regionkey\ntool_mtime = r_regionkey * 10\nbaseline_mtime = 27 - r_regionkey"))


SQL["stale_maps"] = """SELECT r_regionkey AS map, concat_ws(',', CASE WHEN max(n_nationkey) > 23 THEN 'source' END, CASE WHEN max(n_nationkey) >= 22 THEN 'files' END,
  CASE WHEN r_regionkey * 10 > 23 THEN 'tool' END, CASE WHEN 27 - r_regionkey > 23 THEN 'baseline' END) AS reasons FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey"""

# --- routes ------------------------------------------------------------------------------------


@query
def same_endpoints(t: Catalog) -> DataFrame:
    endpoints = rows(t, "nation", "endpoint = n_nationkey\nroute = 'GET /Api/' || n_name || '/{id?}'")
    verb = "CASE c_custkey % 4 WHEN 0 THEN 'POST ' WHEN 1 THEN '' WHEN 2 THEN 'any ' ELSE 'get ' END"
    facts = rows(t, "customer", f"fact = c_custkey\nroute = {verb} || '/api/nation_' || c_nationkey || CASE c_custkey % 3 WHEN 0 THEN '?q=1' WHEN 1 THEN '/' || c_custkey ELSE '/a/b' END")
    return routes.same_endpoints(endpoints, facts)


SQL["same_endpoints"] = "SELECT c_nationkey AS endpoint, c_custkey AS fact FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 2 AND c_custkey % 4 <> 0"


@query
def folded_urls(t: Catalog) -> DataFrame:
    first = rows(t, "supplier", "owner = 'u' || s_suppkey\nord = 0\nkind = CASE WHEN s_suppkey % 4 = 0 THEN 'literal' ELSE 'name' END\nvalue = CASE WHEN s_suppkey % 4 = 0 THEN '/api' WHEN s_suppkey % 10 = 9 THEN 'zz' ELSE 'u' || (s_suppkey - 1) END")
    then = rows(t, "supplier", "owner = 'u' || s_suppkey\nord = 1\nkind = 'literal'\nvalue = '/s' || s_suppkey").unionByName(rows(t, "supplier", "owner = 'u' || s_suppkey\nord = 2\nkind = CASE WHEN s_suppkey % 2 = 0 THEN 'param' ELSE 'unknown' END\nvalue = 'id'", "s_suppkey % 3 = 0"))
    return routes.fold_urls(first.unionByName(then))


SQL["folded_urls"] = """WITH RECURSIVE tail AS (SELECT s_suppkey AS s, '/s' || s_suppkey || CASE WHEN s_suppkey % 3 <> 0 THEN '' WHEN s_suppkey % 2 = 0 THEN '{}' ELSE '*' END AS x FROM supplier),
  u AS (SELECT s, CASE WHEN s % 4 = 0 THEN '/api' ELSE '*' END || x AS url FROM tail WHERE s % 4 = 0 OR s % 10 = 9 UNION ALL SELECT tail.s, url || x FROM u JOIN tail ON tail.s = u.s + 1 WHERE tail.s % 4 <> 0 AND tail.s % 10 <> 9)
  SELECT 'u' || s AS owner, url FROM u"""


@query
def derived_endpoints(t: Catalog) -> DataFrame:
    base = rows(t, "region", "cls = 'Base'\nbase = cast(NULL AS string)\nroute = 'Api/[controller]'\nabstract = true", "r_regionkey = 0")
    classes = base.unionByName(rows(t, "supplier", "cls = 'S' || s_suppkey || 'Controller'\nbase = 'Base'\nroute = CASE WHEN s_suppkey % 2 = 1 THEN 'v2/x' END\nabstract = false"))
    actions = rows(t, "region", "owner = 'Base'\naction = 'List'\nverb = 'GET'\ntemplate = ''", "r_regionkey = 0")
    one = "owner = 'S' || s_suppkey || 'Controller'\naction = 'One'\nverb = 'PUT'\ntemplate = CASE WHEN s_suppkey % 5 = 0 THEN '/root/{id}' ELSE '{id}' END"
    return routes.derive_endpoints(classes, actions.unionByName(rows(t, "supplier", one)))


SQL["derived_endpoints"] = """WITH c AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 2 = 1 THEN 'v2/x' ELSE 'api/s' || s_suppkey END AS r FROM supplier)
  SELECT 'S' || s || 'Controller' AS cls, 'List' AS action, 'GET' AS verb, r AS route FROM c
  UNION ALL SELECT 'S' || s || 'Controller', 'One', 'PUT', CASE WHEN s % 5 = 0 THEN 'root/{id}' ELSE r || '/{id}' END FROM c"""

# --- Python binding ----------------------------------------------------------------------------

SOURCE = """from pkg.m{n} import run{n} as nxt
from .hub{h} import run{h} as hub
import pkg.m{n} as two
class C:
    def go(self, x):
        return self.step(x, y=2)
    def step(self, x, y=1):
        return nxt(x)
def run{s}(a, b=2, *, c=3):
    two.run{n}(a, c=b)
    a(1)
    hub(*a, 2)
    return missing(a)
"""


def _tree(t: Catalog) -> DataFrame:
    """pkg/m<key>.py per supplier and pkg/hub<0-2>.py, which hand on what the first three declare."""
    text = F.lit(SOURCE)
    for hole, value in (("{n}", F.expr("string(s_suppkey + 1)")), ("{h}", F.expr("string(s_suppkey % 3)")), ("{s}", F.expr("string(s_suppkey)"))):
        text = F.replace(text, F.lit(hole), value)
    own = t["supplier"].select(F.expr("'pkg/m' || s_suppkey || '.py'").alias("path"), text.alias("content"))
    hubs = rows(t, "supplier", "path = 'pkg/hub' || s_suppkey || '.py'\ncontent = 'from pkg.m' || s_suppkey || ' import run' || s_suppkey", "s_suppkey < 3")
    return python_code.facts(own.unionByName(hubs))


_SITES = """WITH n AS (SELECT s_suppkey AS s, 'pkg/m' || s_suppkey || '.py' AS path, CASE WHEN s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) THEN 'pkg/m' || (s_suppkey + 1) || '.py::run' || (s_suppkey + 1) ELSE '' END AS nxt,
    'pkg/m' || s_suppkey % 3 || '.py::run' || s_suppkey % 3 AS hub FROM supplier)"""


@query
def py_bound_calls(t: Catalog) -> DataFrame:
    return binding.bound_calls(_tree(t))


SQL["py_bound_calls"] = f"""{_SITES} SELECT path, '6:15' AS site, 'C.go' AS caller, 'self.step' AS name, path || '::C.step' AS target FROM n UNION ALL SELECT path, '8:15', 'C.step', 'nxt', nxt FROM n
  UNION ALL SELECT path, '10:4', 'run' || s, 'two.run' || (s + 1), nxt FROM n UNION ALL SELECT path, '11:4', 'run' || s, 'a', '' FROM n
  UNION ALL SELECT path, '12:4', 'run' || s, 'hub', hub FROM n UNION ALL SELECT path, '13:11', 'run' || s, 'missing', '' FROM n"""


@query
def py_bound_arguments(t: Catalog) -> DataFrame:
    facts = binding.cut(_tree(t))
    return binding.bound_arguments(facts, binding.bound_calls(facts))


SQL["py_bound_arguments"] = f"""{_SITES} SELECT path, '6:15' AS site, 'self.step' AS name, 0::BIGINT AS position, 'x' AS value, 'x' AS param FROM n UNION ALL SELECT path, '6:15', 'self.step', 1, '2', 'y' FROM n
  UNION ALL SELECT path, '8:15', 'nxt', 0, 'x', CASE WHEN nxt = '' THEN '' ELSE 'a' END FROM n UNION ALL SELECT path, '10:4', 'two.run' || (s + 1), 0, 'a', CASE WHEN nxt = '' THEN '' ELSE 'a' END FROM n
  UNION ALL SELECT path, '10:4', 'two.run' || (s + 1), 1, 'b', CASE WHEN nxt = '' THEN '' ELSE 'c' END FROM n UNION ALL SELECT path, '11:4', 'a', 0, '1', '' FROM n
  UNION ALL SELECT path, '12:4', 'hub', 0, '*a', '' FROM n UNION ALL SELECT path, '12:4', 'hub', 1, '2', '' FROM n UNION ALL SELECT path, '13:11', 'missing', 0, 'a', '' FROM n"""


@query
def py_bound_through(t: Catalog) -> DataFrame:
    return binding.bound_through(_tree(t))


SQL["py_bound_through"] = """SELECT 'pkg/m' || a.s_suppkey || '.py' AS path, 'pkg/m' || b.s_suppkey || '.py' AS file FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
  UNION SELECT 'pkg/m' || s_suppkey || '.py', 'pkg/hub' || s_suppkey % 3 || '.py' FROM supplier UNION SELECT 'pkg/m' || s_suppkey || '.py', 'pkg/m' || s_suppkey % 3 || '.py' FROM supplier
  UNION SELECT 'pkg/hub' || s_suppkey || '.py', 'pkg/m' || s_suppkey || '.py' FROM supplier WHERE s_suppkey < 3"""

# --- sources -----------------------------------------------------------------------------------

CALLS = "call_id = c_custkey\nverb = CASE WHEN c_custkey % 5 = 0 THEN 'PUT' ELSE 'GET' END\nurl = CASE c_custkey % 3 WHEN 0 THEN 'https://h.example/' WHEN 1 THEN '*' ELSE '/' END || 'Api/nation_' || c_nationkey || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '/{}' END"


@query
def route_base_match(t: Catalog) -> DataFrame:
    calls = rows(t, "customer", CALLS)
    endpoints = rows(t, "nation", "endpoint = 'short' || n_nationkey\nverb = 'GET'\npattern = '/api/' || n_name || '/{id?}'").unionByName(rows(t, "nation", "endpoint = 'long' || n_nationkey\nverb = 'ANY'\npattern = 'v1/{area}/api/' || n_name || '/{id}'"))
    return routes.match(calls.select("call_id", "verb", routes.call_segments("url").alias("segs")), endpoints)


SQL["route_base_match"] = """WITH m AS (SELECT c_custkey AS call_id, unnest(CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['short'] END || CASE WHEN c_custkey % 3 = 1 AND c_custkey % 4 <> 0 THEN ['long'] ELSE [] END) || c_nationkey AS endpoint FROM customer)
  SELECT call_id, endpoint, 2::BIGINT AS literal_hits, CASE WHEN count(*) OVER (PARTITION BY call_id) = 1 THEN 'exact' ELSE 'ambiguous' END AS how FROM m"""

RECORD = "value = CASE o_orderkey % 4 WHEN 0 THEN 'MAP-STEP|s' || o_orderkey || '|' || o_orderstatus WHEN 1 THEN 'MAP-FINDING|f|' || o_custkey || '|a|b|c|d' WHEN 2 THEN 'MAP-NONE|x' ELSE 'other' END"


@query
def plugin_records(t: Catalog) -> DataFrame:
    return files.record_lines(rows(t, "orders", RECORD))


SQL["plugin_records"] = """SELECT 'STEP' AS kind, 's' || o_orderkey AS f1, o_orderstatus AS f2, NULL::VARCHAR AS f3, NULL::VARCHAR AS f4, NULL::VARCHAR AS f5 FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT 'FINDING', 'f', o_custkey::VARCHAR, 'a', 'b', 'c|d' FROM orders WHERE o_orderkey % 4 = 1"""


@query
def plugin_unfinished(t: Catalog) -> DataFrame:
    return files.unfinished(files.record_lines(rows(t, "orders", RECORD)))


SQL["plugin_unfinished"] = "SELECT 'half-finished output' AS finding"

TRACE_LINE = """value = CASE WHEN o_orderkey % 10 = 0 THEN '{"resourceSpans": [' ELSE '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"t' || o_orderkey || '","spanId":"r' || o_orderkey || '","name":"run","startTimeUnixNano":"1700000000000000000","endTimeUnixNano":"17000000' || (10 + o_orderkey % 9) || '000000000"},{"traceId":"t' || o_orderkey || '","spanId":"c' || o_orderkey || '","parentSpanId":"r' || o_orderkey || '","name":"step","startTimeUnixNano":"1700000000000000001","endTimeUnixNano":"1700000001000000001"}]}]}]}' END"""
_SPANS = """SELECT 't' || o_orderkey AS trace_id, 'r' || o_orderkey AS span_id, NULL::VARCHAR AS parent_id, 'run' AS name, 1000.0 * (10 + o_orderkey % 9) AS ms FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT 't' || o_orderkey, 'c' || o_orderkey, 'r' || o_orderkey, 'step', 1000.0 FROM orders WHERE o_orderkey % 10 <> 0"""


@query
def trace_spans(t: Catalog) -> DataFrame:
    return files.spans(rows(t, "orders", TRACE_LINE))


SQL["trace_spans"] = f"SELECT trace_id, span_id, parent_id, name, ms::DOUBLE AS ms FROM ({_SPANS})"


@query
def trace_counts(t: Catalog) -> DataFrame:
    return files.torn_lines(rows(t, "orders", TRACE_LINE))


SQL["trace_counts"] = "SELECT count(*) FILTER (o_orderkey % 10 <> 0) AS runs, count(*) FILTER (o_orderkey % 10 = 0) AS skipped FROM orders"


@query
def span_untraced(t: Catalog) -> DataFrame:
    return files.untraced(files.spans(rows(t, "orders", TRACE_LINE)))


SQL["span_untraced"] = "SELECT 'r' || o_orderkey AS span_id, 'run' AS name, (1000.0 * (9 + o_orderkey % 9))::DOUBLE AS untraced_ms FROM orders WHERE o_orderkey % 10 <> 0"


@query
def sorted_json_rows(t: Catalog) -> DataFrame:
    return files.sorted_json(t["nation"], ["n_nationkey"])


SQL["sorted_json_rows"] = """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation"""


@query
def slim_tables(t: Catalog) -> DataFrame:
    kept = files.slim({n: t[n] for n in ("orders", "part", "nation")}, {"orders": "o_orderstatus = 'F'", "nation": None})
    return kept["orders"].select(F.lit("orders").alias("tbl"), F.col("o_orderkey").cast("long").alias("key")).unionByName(kept["nation"].select(F.lit("nation").alias("tbl"), F.col("n_nationkey").cast("long").alias("key")))


SQL["slim_tables"] = "SELECT 'orders' AS tbl, o_orderkey::BIGINT AS key FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'nation', n_nationkey FROM nation"


@query
def sliced_tables(t: Catalog) -> DataFrame:
    tables = {"customer": rows(t, "customer", "file = c_nationkey\nkey = c_custkey"), "supplier": rows(t, "supplier", "file = s_nationkey\nkey = s_suppkey"), "region": rows(t, "region", "key = r_regionkey")}
    cut = files.sliced(tables, rows(t, "nation", "file = n_nationkey", "n_regionkey = 2"))
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("tbl"), F.col("key").cast("long").alias("key")) for n, df in cut.items()])


SQL["sliced_tables"] = """SELECT 'customer' AS tbl, c_custkey::BIGINT AS key FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2
  UNION ALL SELECT 'supplier', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'region', r_regionkey FROM region"""


@query
def anonymous_holes(t: Catalog) -> DataFrame:
    return rows(t, "part", "p_partkey = p_partkey\ntext = '/api/{' || p_size || '}/{0:N2}/{name}/' || p_brand").select("p_partkey", format_holes("text").alias("text"))


SQL["anonymous_holes"] = "SELECT p_partkey, '/api/{}/{}/{name}/' || p_brand AS text FROM part"

C_SOURCE = "path = 's' || s_suppkey\ncontent = 'int a; // x\n\n/* one */\n  /* two\n three */ int b;\nint c; /* four\n five */' || CASE WHEN s_suppkey % 2 = 0 THEN 'int d;\n' ELSE '\n' END || CASE WHEN s_suppkey % 3 = 0 THEN 'int e; /* open\n int f;' ELSE '' END"


def _texts(t: Catalog, columns: str) -> DataFrame:
    """As rows(), with real line breaks in the text: they are written as such in the expression."""
    path, content = columns.split("\ncontent = ", 1)
    return t["supplier"].select(F.expr(path.split(" = ", 1)[1]).alias("path"), F.expr(content).alias("content"))


@query
def c_source_lines(t: Catalog) -> DataFrame:
    return documents.code_lines(_texts(t, C_SOURCE))


SQL["c_source_lines"] = "SELECT 's' || s_suppkey AS path, (3 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_lines FROM supplier"


@query
def py_source_lines(t: Catalog) -> DataFrame:
    return python_code.source_lines(_texts(t, "path = 's' || s_suppkey\ncontent = 'a = 1\n\n  # note\nb = 2  # kept\n' || repeat('c()\n', cast(s_suppkey % 4 AS int))"))


SQL["py_source_lines"] = "SELECT 's' || s_suppkey AS path, (2 + s_suppkey % 4)::BIGINT AS n_lines FROM supplier"

MARKDOWN = "path = 'docs/d' || s_suppkey || '.md'\ncontent = '# Top\nsee [a](../docs/./d' || (s_suppkey + 1) || '.md#x)\n## Sub ' || s_suppkey || '\n[b](http://x.y) [c](img/no.png)\n'"


@query
def md_sections(t: Catalog) -> DataFrame:
    return documents.sections(_texts(t, MARKDOWN)).drop("text")


SQL["md_sections"] = """SELECT 'docs/d' || s_suppkey || '.md' AS path, 2::BIGINT AS line, 1::BIGINT AS level, 'Top' AS section FROM supplier
  UNION ALL SELECT 'docs/d' || s_suppkey || '.md', 4, 2, 'Top > Sub ' || s_suppkey FROM supplier"""


@query
def md_links(t: Catalog) -> DataFrame:
    docs = _texts(t, MARKDOWN)
    return documents.link_status(documents.links(docs), docs)


SQL["md_links"] = """SELECT 'docs/d' || s_suppkey || '.md' AS path, 'docs/d' || (s_suppkey + 1) || '.md' AS target, CASE WHEN s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) THEN 'bound' ELSE 'missing' END AS status FROM supplier
  UNION ALL SELECT 'docs/d' || s_suppkey || '.md', 'docs/img/no.png', 'missing' FROM supplier"""


@query
def md_broken_links(t: Catalog) -> DataFrame:
    docs = _texts(t, MARKDOWN)
    return documents.broken_links(docs, docs)


SQL["md_broken_links"] = f"SELECT path, target FROM ({SQL['md_links']}) WHERE status = 'missing'"


@query
def unmatched_globs(t: Catalog) -> DataFrame:
    return files.unmatched(t.spark, rows(t, "customer", FILES), ("**/*.spec.ts", "Furniture/**", "*.ts", "**/src/c?.ts", "none/**"))


SQL["unmatched_globs"] = "SELECT unnest(['*.ts', 'none/**']) AS glob"


@query
def normal_paths(t: Catalog) -> DataFrame:
    return rows(t, "supplier", "s_suppkey = s_suppkey\np = CASE WHEN s_suppkey % 2 = 0 THEN '/' ELSE '' END || 'a/./' || s_suppkey || '//../../../b'").select("s_suppkey", normal_path("p").alias("path"))


SQL["normal_paths"] = "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/b' ELSE '../b' END AS path FROM supplier"


@query
def py_rows(t: Catalog) -> DataFrame:
    return _tree(t).groupBy("path", "tbl").agg(F.count(F.lit(1)).alias("n"))


SQL["py_rows"] = """SELECT 'pkg/m' || s_suppkey || '.py' AS path, tbl, n::BIGINT AS n FROM supplier, (VALUES ('files', 1), ('imports', 3), ('classes', 1), ('functions', 3), ('parameters', 8), ('calls', 6), ('arguments', 9), ('returns', 3), ('number_literals', 6)) v(tbl, n)
  UNION ALL SELECT 'pkg/hub' || s_suppkey || '.py', unnest(['files', 'imports']), 1 FROM supplier WHERE s_suppkey < 3"""


@query
def py_statement_shapes(t: Catalog) -> DataFrame:
    text = "path = 's' || s_suppkey\ncontent = 'def f' || s_suppkey || '(a, b=1):\n    x' || s_suppkey || ' = a.go(' || s_suppkey || ')\n    return [b]\n'"
    return python_code.statement_shapes(_texts(t, text)).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shape").alias("shapes"))


SQL["py_statement_shapes"] = "SELECT unnest([2, 3])::BIGINT AS line, count(*) AS n, 1::BIGINT AS shapes FROM supplier"


@query
def py_launch_targets(t: Catalog) -> DataFrame:
    text = "path = 'p' || s_suppkey || '/pyproject.toml'\ncontent = CASE WHEN s_suppkey % 3 = 0 THEN '[project' ELSE '[project]\nname = \"x\"\n[project.scripts]\nrun' || s_suppkey || ' = \"pkg.m' || s_suppkey || ':main\"\n' END"
    return python_code.launch_targets(_texts(t, text))


SQL["py_launch_targets"] = "SELECT 'p' || s_suppkey || '/pyproject.toml' AS path, 'run' || s_suppkey AS name, 'pkg.m' || s_suppkey || ':main' AS target FROM supplier WHERE s_suppkey % 3 <> 0"


@query
def sql_statements(t: Catalog) -> DataFrame:
    texts = rows(t, "part", "p_partkey = p_partkey\nbody = 'select '';'' as a -- x; y' || chr(10) || 'from t; ;' || p_name || ' /* ; */ ;'")
    return documents.statements(texts, "p_partkey", "body")


SQL["sql_statements"] = "SELECT p_partkey, 0::BIGINT AS ord, 'select '';'' as a -- x; y' || chr(10) || 'from t' AS statement FROM part UNION ALL SELECT p_partkey, 1, p_name || ' /* ; */' FROM part"


@query
def view_edges(t: Catalog) -> DataFrame:
    edges = t["orders"].groupBy(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return files.view_model(edges, "n", 50)


SQL["view_edges"] = """SELECT '{"dst":"' || dst || '","src":' || src || ',"weight":' || n || '}' AS value FROM (SELECT o_custkey AS src, o_orderpriority AS dst, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50)"""


@query
def source_state(t: Catalog) -> DataFrame:
    refs = rows(t, "nation", "path = '.git/refs/heads/' || lower(n_name)\ntext = md5(n_name) || chr(10)")
    return files.source_state(refs.unionByName(rows(t, "region", "path = '.git/HEAD'\ntext = 'ref: refs/heads/nation_7' || chr(10)", "r_regionkey = 0")))


SQL["source_state"] = "SELECT lower(n_name) AS branch, md5(n_name) AS commit FROM nation WHERE n_name = 'NATION_7'"


@query
def plugin_findings(t: Catalog) -> DataFrame:
    def broken(cat: Catalog) -> DataFrame:
        raise ValueError(f"no settings for {cat.folder}")

    return lenses.plugin_findings({"small": lambda cat: cat["part"].filter("p_size < 3").select("p_partkey"), "broken": broken}, t)


SQL["plugin_findings"] = "SELECT 'small' AS plugin, p_partkey::VARCHAR AS subject FROM part WHERE p_size < 3 UNION ALL SELECT 'broken', 'failed: ValueError'"


@query
def module_files(t: Catalog) -> DataFrame:
    known = rows(t, "supplier", "path = CASE WHEN s_suppkey % 2 = 0 THEN 'src/a/m' || s_suppkey || '.rs' ELSE 'src/a/m' || s_suppkey || '/mod.rs' END")
    uses = rows(t, "supplier", "file = 'src/a/m' || s_suppkey || '.rs'\nused = CASE s_suppkey % 4 WHEN 0 THEN 'crate::a::m' || (s_suppkey + 1) || '::Item' WHEN 1 THEN 'super::m' || (s_suppkey + 1) WHEN 2 THEN 'self::X' ELSE 'other::m1' END")
    return paths.module_files(uses, known)


SQL["module_files"] = """SELECT 'src/a/m' || s_suppkey || '.rs' AS file, CASE s_suppkey % 4 WHEN 0 THEN 'crate::a::m' || (s_suppkey + 1) || '::Item' WHEN 1 THEN 'super::m' || (s_suppkey + 1) WHEN 2 THEN 'self::X' ELSE 'other::m1' END AS used,
    CASE WHEN s_suppkey % 4 = 2 THEN 'src/a/m' || s_suppkey || '.rs' WHEN s_suppkey % 4 < 2 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) THEN CASE WHEN s_suppkey % 2 = 1 THEN 'src/a/m' || (s_suppkey + 1) || '.rs' ELSE 'src/a/m' || (s_suppkey + 1) || '/mod.rs' END END AS target FROM supplier"""
