"""The same questions as plain SQL for an independent engine."""

from __future__ import annotations

from terrace.catalog import TABLES
from terrace.plans.bindings import CODE, SETS
from terrace.plans.derived import SQL

_TREE = """tree0 AS (
  SELECT r_regionkey::BIGINT AS owner, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, 'region' AS role, r_name AS value, 0 AS depth FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, NULL, NULL, 'nation', n_name, 1 FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, NULL, 'customer', c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 0, 'kind', c_mktsegment, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey
), tree1 AS (
  SELECT *, row_number() OVER (PARTITION BY owner ORDER BY a NULLS FIRST, b NULLS FIRST, c NULLS FIRST) - 1 AS n FROM tree0
), tree AS (
  SELECT t.owner, t.n, p.n AS parent, t.role, t.value,
    (SELECT max(d.n) FROM tree1 d WHERE d.owner = t.owner AND (t.a IS NULL OR d.a = t.a) AND (t.b IS NULL OR d.b = t.b) AND (t.c IS NULL OR d.c = t.c)) AS last,
    t.depth::BIGINT AS depth
  FROM tree1 t LEFT JOIN tree1 p ON p.owner = t.owner AND p.depth = t.depth - 1
    AND (p.a IS NULL OR p.a = t.a) AND (p.b IS NULL OR p.b = t.b)
)"""
_SHOWN = "t.owner, t.n, t.parent, t.role, t.value, t.last, t.depth"


def _tree(where: str, start: str = "") -> str:
    return f"WITH {_TREE} SELECT {_SHOWN} FROM tree t {start} WHERE {where}"


def _s(n: int) -> str:
    return f"JOIN tree s ON s.owner = t.owner AND s.n = {n}"


_GRAPH = """counted AS (
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
), g AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM counted) WHERE r <= 2)"""
_CLOSURE = f"WITH RECURSIVE {_GRAPH}, reach AS (SELECT src, dst FROM g UNION SELECT reach.src, g.dst FROM reach JOIN g ON reach.dst = g.src)"

_POSTED = """posted AS (
  SELECT doc, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT doc_id AS doc, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM documents))"""


def _entries(old: bool) -> str:
    if old:
        return "SELECT c_name AS path, 'file' AS kind, md5(c_mktsegment || '#' || c_custkey) AS hash, length(c_mktsegment || '#' || c_custkey) AS size FROM customer WHERE c_acctbal < 9000"
    body = "CASE WHEN c_custkey % 50 = 0 THEN 'X' ELSE c_mktsegment || '#' || c_custkey END"
    return f"""SELECT CASE WHEN c_custkey % 17 = 0 THEN c_name || '-moved' ELSE c_name END AS path, CASE WHEN c_custkey % 33 = 0 THEN 'dir' ELSE 'file' END AS kind,
      md5({body}) AS hash, length({body}) AS size FROM customer WHERE c_acctbal > -500"""


_STATES = f"WITH o AS ({_entries(True)}), n AS ({_entries(False)})"
_DIFF = """d AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
  WHEN o.kind <> n.kind THEN 'type-changed' WHEN o.hash <> n.hash THEN 'modified' END AS change, o.hash AS old_hash, n.hash AS new_hash
  FROM o FULL JOIN n ON o.path = n.path)"""
_PAIRS = """gone AS (SELECT *, row_number() OVER (PARTITION BY kind, hash, size ORDER BY path) AS r FROM o WHERE path NOT IN (SELECT path FROM n)),
  came AS (SELECT *, row_number() OVER (PARTITION BY kind, hash, size ORDER BY path) AS r FROM n WHERE path NOT IN (SELECT path FROM o)),
  p AS (SELECT gone.path AS old_path, came.path AS new_path FROM gone JOIN came USING (kind, hash, size, r))"""

_COLUMNS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}
_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_EVENTS = ("event_id", "ts", "user_id", "event_type", "value", "props")
_SETS = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS set_name, {c}::VARCHAR AS value FROM {t} WHERE {c} IS NOT NULL" for t, c in SETS)
_OVERLAP = f"""WITH sets AS ({_SETS}), sizes AS (SELECT set_name, count(*) AS size FROM sets GROUP BY 1),
  hits AS (SELECT x.set_name AS a, y.set_name AS b, count(*) AS hits FROM sets x JOIN sets y ON x.value = y.value AND x.set_name < y.set_name GROUP BY 1, 2),
  overlap AS (SELECT a, b, hits, p.size AS size_a, q.size AS size_b FROM hits JOIN sizes p ON p.set_name = a JOIN sizes q ON q.set_name = b WHERE hits >= 2 AND hits * 5 >= least(p.size, q.size))"""


def _fill(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} IS NOT NULL AND {c}::VARCHAR <> '') AS filled, count(*) AS n_rows, round(100.0 * count(*) FILTER ({c} IS NOT NULL AND {c}::VARCHAR <> '') / count(*), 1)::DOUBLE AS rate FROM {table}"
        for c in columns
    )


def _cells(places: tuple[tuple[str, str, str], ...], text: str) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {k}::VARCHAR AS row_key, {c} AS cell FROM {t} WHERE {c} ILIKE '%{text}%'" for t, k, c in places)


def _chance(doc: str, x: str, codes: str, y: str) -> str:
    return f"""SELECT '{x}~{y}' AS pair, n_doc, n_code, CASE WHEN n_doc = 0 THEN 0.0 ELSE round(n_doc * n_code / (hi - lo + 1)::DOUBLE, 4) END AS chance_hits
      FROM (SELECT count(DISTINCT {x}) AS n_doc, min({x}) AS lo, max({x}) AS hi FROM {doc}) d,
      LATERAL (SELECT count(DISTINCT {y}) AS n_code FROM {codes} WHERE {y} BETWEEN d.lo AND d.hi) c"""


def _key(table: str, columns: tuple[str, ...]) -> str:
    cells = ", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in columns)
    part = lambda at: f"coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), {cells})), {at}, 15))::BIGINT), 0)::VARCHAR"
    return f"SELECT '{table}' AS table_name, count(*) AS n_rows, {part(1)} || '-' || {part(16)} AS key FROM {table}"


_CEILING = 18
_LINES = "lines AS (SELECT doc_id AS item, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''))::BIGINT AS n_lines FROM documents)"
_DOMAIN = "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']"
_ROUTES = (
    ("en-item", "GET", "^/en/[^/]+$", 1), ("de-item", "ANY", "^/de/[^/]+$", 1), ("de-only", "POST", "^/de/[^/]+$", 1), ("fr-all", "ANY", "^/fr/[^/]+$", 1), ("fr-opt", "GET", "^/fr(/[^/]+)?$", 1),
)


def oracle_sql() -> dict[str, str]:
    nodes = {
        "node_subtree": _tree("t.n BETWEEN s.n AND s.last", _s(1)),
        "node_ancestors": _tree("t.n <= s.n AND t.last >= s.n", _s(3)),
        "node_children": _tree("t.n BETWEEN s.n + 1 AND s.last AND t.parent = s.n", _s(0)),
        "node_siblings": _tree("t.parent = s.parent", _s(1)),
        "node_leaves": _tree("t.n BETWEEN s.n AND s.last AND t.last = t.n", _s(1)),
        "node_depth_range": _tree("t.n BETWEEN s.n AND s.last AND t.depth BETWEEN s.depth + 1 AND s.depth + 2", _s(0)),
        "node_of_kind": _tree("EXISTS (SELECT 1 FROM tree k WHERE k.owner = t.owner AND k.parent = t.n AND k.role IN ('k', 'kind') AND k.value = 'BUILDING' AND k.n BETWEEN s.n + 1 AND s.last) AND t.n > s.n", _s(1)),
        "node_path_to": f"WITH {_TREE} SELECT t.owner, string_agg(t.role, '.' ORDER BY t.n) AS path FROM tree t WHERE t.n > 0 AND t.n <= 3 AND t.last >= 3 GROUP BY t.owner",
        "node_lca": _tree("t.n = (SELECT max(x.n) FROM tree x WHERE x.owner = t.owner AND x.n <= 2 AND x.last >= 5)"),
        "node_nth_child": _tree("t.parent = 0 AND (t.n = (SELECT max(x.n) FROM tree x WHERE x.owner = t.owner AND x.parent = 0) OR t.n = (SELECT x.n FROM tree x WHERE x.owner = t.owner AND x.parent = 0 ORDER BY x.n LIMIT 1 OFFSET 1))"),
        "props_nodes": """SELECT owner, n, CASE WHEN parent IS NULL THEN NULL ELSE 0 END::BIGINT AS parent, role, NULL::BIGINT AS ord, node, value,
            CASE WHEN parent IS NULL THEN max(n) OVER (PARTITION BY owner) ELSE n END AS last, CASE WHEN parent IS NULL THEN 0 ELSE 1 END::BIGINT AS depth
          FROM (SELECT event_id::VARCHAR AS owner, row_number() OVER (PARTITION BY event_id ORDER BY j.id) - 1 AS n, j.parent, j.key AS role,
            CASE WHEN j.type = 'OBJECT' THEN 'object' WHEN j.type = 'VARCHAR' THEN 'string' WHEN j.type = 'BOOLEAN' THEN 'bool' ELSE 'number' END AS node, j.atom ->> '$' AS value
          FROM events, json_tree(props) j)""",
    }
    hop = lambda way: f"SELECT '{way}' AS direction, node, min(dist)::BIGINT AS dist FROM (SELECT 0 AS node, 0 AS dist UNION ALL SELECT dst, 1 FROM {way}_e WHERE src = 0 UNION ALL SELECT y.dst, 2 FROM {way}_e x JOIN {way}_e y ON x.dst = y.src WHERE x.src = 0) GROUP BY node"
    graphs = {
        "ancestor_closure": f"{_CLOSURE} SELECT src, dst FROM reach",
        "k_hop": f"""WITH {_GRAPH}, out_e AS (SELECT src, dst FROM g), in_e AS (SELECT dst AS src, src AS dst FROM g), both_e AS (SELECT * FROM out_e UNION SELECT * FROM in_e)
          {hop('out')} UNION ALL {hop('in')} UNION ALL {hop('both')}""",
        "cycle_members": f"{_CLOSURE} SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src",
        "unreached": f"""WITH {_GRAPH} SELECT 'nation' AS kind, n_nationkey::BIGINT AS node FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM g)
          UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "root_reach": f"""WITH RECURSIVE {_GRAPH}, walk AS (SELECT min(n_nationkey)::BIGINT AS root, min(n_nationkey)::BIGINT AS node, 0::BIGINT AS depth FROM nation GROUP BY n_regionkey
            UNION SELECT root, g.dst, depth + 1 FROM walk JOIN g ON walk.node = g.src WHERE depth < 25),
          r AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY 1, 2)
          SELECT node, count(*) AS n_roots, min(depth) AS min_depth, string_agg(root::VARCHAR, ',' ORDER BY root) AS roots, count(*) = 1 AS exclusive FROM r GROUP BY node""",
        "simple_paths": f"""WITH RECURSIVE {_GRAPH}, walk AS (SELECT n_nationkey::BIGINT AS node, [n_nationkey::BIGINT] AS hops FROM nation
            UNION ALL SELECT g.dst, list_append(hops, g.dst) FROM walk JOIN g ON walk.node = g.src WHERE NOT list_contains(hops, g.dst) AND len(hops) < 4)
          SELECT node, array_to_string(hops, '>') AS hops FROM walk""",
        "reverse_edges": f"WITH {_GRAPH} SELECT dst, string_agg(src::VARCHAR, ',' ORDER BY src) AS sources FROM g GROUP BY dst",
        "folder_rollup": f"""WITH {_GRAPH}, f AS (SELECT n_nationkey AS node, r_name AS folder FROM nation JOIN region ON n_regionkey = r_regionkey)
          SELECT a.folder AS from_folder, b.folder AS to_folder, count(*) AS weight FROM g JOIN f a ON src = a.node JOIN f b ON dst = b.node WHERE a.folder <> b.folder GROUP BY 1, 2""",
        "weighted_edges": """SELECT p_brand AS src, l_linestatus AS dst, count(*) FILTER (l_returnflag = 'A') AS "n_A", count(*) FILTER (l_returnflag = 'N') AS "n_N", count(*) FILTER (l_returnflag = 'R') AS "n_R"
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
        "connected_groups": f"""WITH RECURSIVE {_GRAPH}, e AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), reach AS (SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON reach.dst = e.src)
          SELECT src AS node, least(src, min(dst)) AS component FROM reach GROUP BY src""",
        "dirty_targets": """WITH RECURSIVE b AS (SELECT DISTINCT p_brand, regexp_extract(p_brand, '(\\d+)$', 1)::BIGINT AS k FROM part),
          deps AS (SELECT x.p_brand AS src, y.p_brand AS dst FROM b x JOIN b y ON x.k = y.k + 10),
          w AS (SELECT target FROM (SELECT DISTINCT p_brand AS target FROM part WHERE p_brand GLOB '*#2?') UNION SELECT deps.src FROM w JOIN deps ON deps.dst = w.target)
          SELECT target FROM w""",
    }
    lenses = {
        "table_inventory": "WITH t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, {_COLUMNS[n]}::BIGINT AS n_columns FROM {n}" for n in TABLES) + ") SELECT * FROM t UNION ALL SELECT 'TOTAL', sum(n_rows)::BIGINT, sum(n_columns)::BIGINT FROM t",
        "column_fill_profile": _fill("orders", _ORDERS) + " UNION ALL " + _fill("events", _EVENTS),
        "find_names": _cells((("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")), "01"),
        "grep_rows": _cells((("events", "event_id", "event_type"), ("part", "p_partkey", "p_type"), ("orders", "o_orderkey", "o_orderpriority"), ("conversations", "conv_id", "role"), ("pages", "page_id", "url")), "er"),
        "cat_lines": "SELECT doc_id, i AS line_no, l AS line FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE i BETWEEN 2 AND 4",
        "literal_stats": """SELECT literal, count(*) AS uses, count(DISTINCT doc_id) AS places, min(doc_id::VARCHAR || ':' || (i - 1)::VARCHAR) AS first_place
          FROM (SELECT doc_id, unnest(s) AS literal, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents))
          WHERE length(literal) BETWEEN 1 AND 8 AND NOT contains(literal, chr(10)) AND NOT contains(literal, chr(9)) GROUP BY literal HAVING count(*) >= 3""",
        "separator_stats": """SELECT separator, count(*) AS uses, count(DISTINCT doc_id) AS places
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]([^A-Za-z0-9]{1,4})[A-Za-z0-9]', 1)) AS separator FROM documents) GROUP BY separator""",
        "repeat_flag": "SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS n, count(*) OVER (PARTITION BY user_id, event_type) > 1 AS repeated FROM events",
        "rule_findings": """SELECT 'no-discount' AS rule_id, 'warn' AS level, l_orderkey || ':' || l_linenumber AS subject FROM lineitem WHERE l_discount = 0 AND l_quantity > 45
          UNION ALL SELECT 'late-ship', 'error', l_orderkey || ':' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 115 DAYS
          UNION ALL SELECT 'no-label', 'note', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "slowest_topk": """WITH li AS (SELECT l_orderkey || ':' || l_linenumber AS k, l_extendedprice AS v FROM lineitem), top AS (SELECT k AS item, v AS amount, 1::BIGINT AS n FROM li ORDER BY v DESC, k LIMIT 15)
          SELECT item, amount, n FROM top UNION ALL SELECT 'rest', round((SELECT sum(v) FROM li) - (SELECT sum(amount) FROM top), 2), (SELECT count(*) FROM li) - 15""",
        "folder_counts": """SELECT coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '^(.*)/[^/]*$', 1), ''), '.') AS folder, count(*) AS n FROM pages GROUP BY 1""",
        "sql_surface": "SELECT n_regionkey, count(*) AS nations, (sum(count(*)) OVER (ORDER BY n_regionkey))::BIGINT AS running FROM nation GROUP BY n_regionkey HAVING count(*) > 1",
    }
    joins = {
        "innermost_interval": """WITH s AS (SELECT o_custkey AS k, o_orderkey AS span, o_orderdate AS lo, o_orderdate + to_days((o_orderkey % 400 + 1)::INT) AS hi FROM orders)
          SELECT custkey, point, span AS innermost FROM (SELECT p.o_custkey AS custkey, p.o_orderkey AS point, s.span, row_number() OVER (PARTITION BY p.o_orderkey ORDER BY s.hi - s.lo, s.span) AS r
            FROM orders p JOIN s ON s.k = p.o_custkey AND s.lo <= p.o_orderdate AND p.o_orderdate <= s.hi) WHERE r = 1""",
        "list_items_join": """WITH i AS (SELECT vec_id, unnest(embedding[1:5]) AS x, generate_subscripts(embedding[1:5], 1) - 1 AS ord FROM embeddings)
          SELECT i.vec_id, i.ord::BIGINT AS ord, i.x::DOUBLE AS x, j.x::DOUBLE AS y FROM i JOIN i j ON i.vec_id = j.vec_id AND i.ord = j.ord - 1""",
        "semi_customers": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
        "anti_customers": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    }
    copies = {
        "identical_docs": "SELECT digest, n, size, place FROM (SELECT md5(text) AS digest, count(*) OVER (PARTITION BY md5(text)) AS n, length(text) AS size, doc_id AS place FROM documents WHERE text IS NOT NULL) WHERE n >= 2",
        "near_copies": """WITH w AS (SELECT doc_id AS doc, md5(text) AS digest, string_split(lower(text), ' ') AS w FROM documents),
          sh AS (SELECT DISTINCT doc, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) >= 5),
          size AS (SELECT doc, count(*) AS n FROM sh GROUP BY doc), ok AS (SELECT s FROM sh GROUP BY s HAVING count(*) BETWEEN 2 AND 50),
          pair AS (SELECT x.doc AS a, y.doc AS b, count(*) AS shared FROM sh x JOIN ok USING (s) JOIN sh y ON y.s = x.s AND x.doc < y.doc GROUP BY 1, 2 HAVING count(*) >= 3)
          SELECT a, b, shared, shared * 100 // (p.n + q.n - shared) AS score FROM pair JOIN size p ON p.doc = a JOIN size q ON q.doc = b
          JOIN w u ON u.doc = a JOIN w v ON v.doc = b WHERE u.digest <> v.digest AND shared * 100 // (p.n + q.n - shared) >= 75""",
        "copied_lines": """WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
          g AS (SELECT line, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS places, count(*) AS n_places FROM l WHERE length(trim(line, ' ')) >= 20 GROUP BY line HAVING count(*) >= 2)
          SELECT line, n_places, doc_id AS place FROM (SELECT *, row_number() OVER (PARTITION BY places ORDER BY length(line) DESC, line) AS r FROM g) JOIN l USING (line) WHERE r = 1""",
    }
    text = {
        "fulltext_and": f"WITH {_POSTED} SELECT doc FROM posted WHERE token IN ('the', 'license') GROUP BY doc HAVING count(DISTINCT token) = 2",
        "fulltext_or": f"WITH {_POSTED} SELECT DISTINCT doc FROM posted WHERE token IN ('license', 'token')",
        "fulltext_not": f"WITH {_POSTED} SELECT doc FROM posted WHERE token = 'the' EXCEPT SELECT doc FROM posted WHERE token = 'and'",
        "fulltext_phrase": f"WITH {_POSTED} SELECT a.doc, count(*) AS hits FROM posted a JOIN posted b ON a.doc = b.doc AND b.pos = a.pos + 1 AND b.token = 'rights' JOIN posted c ON a.doc = c.doc AND c.pos = a.pos + 2 AND c.token = 'reserved' WHERE a.token = 'all' GROUP BY a.doc",
        "fulltext_prefix": f"WITH {_POSTED} SELECT doc, count(*) AS hits FROM posted WHERE starts_with(token, 'lic') GROUP BY doc",
        "fulltext_snippet": f"""WITH {_POSTED}, first AS (SELECT doc, min(pos) AS hit FROM posted WHERE token = 'license' GROUP BY doc)
          SELECT doc, string_agg(CASE WHEN pos = hit THEN '>>' || token || '<<' ELSE token END, ' ' ORDER BY pos) AS snippet FROM posted JOIN first USING (doc)
          WHERE pos >= greatest(0, hit - 6) AND pos < greatest(0, hit - 6) + 12 GROUP BY doc""",
        "row_index_lookup": "SELECT table_name, row_key, count(*) AS hits FROM ("
        + " UNION ALL ".join(f"SELECT '{n}' AS table_name, {k} AS row_key, unnest(regexp_extract_all(lower({c}), '([a-z0-9]+)', 1)) AS token FROM {n}" for n, k, c in (("pages", "page_id", "url"), ("conversations", "conv_id", "text"), ("benchmark", "item_id", "text")))
        + ") WHERE token IN ('the', 'en') GROUP BY 1, 2",
        "routes_in_text": """SELECT regexp_extract(h, '^[^?#]*', 0) AS route, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS h FROM pages) GROUP BY 1""",
        "doc_sections": r"""WITH b AS (SELECT page_id, unnest(s) AS b, generate_subscripts(s, 1) AS p FROM (SELECT page_id, regexp_extract_all(html, '<(?:h1|p)[^>]*>[^<]*</', 0) AS s FROM pages)),
          k AS (SELECT page_id, p, regexp_extract(b, '^<(h1|p)', 1) AS kind, regexp_extract(b, '^<[^>]*>([^<]*)</', 1) AS t FROM b),
          h AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'h1' THEN t END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY p ROWS UNBOUNDED PRECEDING), '') AS path FROM k)
          SELECT page_id, path, count(*) AS blocks, sum(length(t))::BIGINT AS chars FROM h WHERE kind = 'p' GROUP BY 1, 2""",
        "route_match": """WITH c AS (SELECT page_id AS call_id, rtrim(regexp_replace(regexp_extract(lower(url), '^[^?#]*', 0), '^https?://[^/]*', ''), '/') AS path FROM pages), h AS ("""
        + " UNION ALL ".join(f"SELECT call_id, '{e}' AS endpoint, {lit}::BIGINT AS literal_hits FROM c WHERE regexp_matches(path, '{rx}')" for e, v, rx, lit in _ROUTES if v != "POST")
        + ") SELECT call_id, endpoint, literal_hits, CASE WHEN count(*) OVER (PARTITION BY call_id) = 1 THEN 'exact' ELSE 'ambiguous' END AS how FROM h",
    }
    sets = {
        "value_overlap": f"{_OVERLAP} SELECT * FROM overlap",
        "best_sets": f"""{_OVERLAP} SELECT group_name, set_name, score FROM (SELECT a AS group_name, b AS set_name, hits AS score, row_number() OVER (PARTITION BY a ORDER BY hits DESC, b) AS x, row_number() OVER (PARTITION BY b ORDER BY hits DESC, a) AS y FROM overlap) WHERE x = 1 OR y = 1""",
        "chance_hits": " UNION ALL ".join(_chance(*x) for x in (("customer", "c_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "supplier", "s_suppkey"), ("lineitem", "l_linenumber", "part", "p_size"))),
        "row_agreement": "WITH j AS (SELECT s_suppkey % 5 AS s_mod, 1 AS s_one, s_nationkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) "
        + " UNION ALL ".join(f"SELECT '{a}' AS doc_col, '{b}' AS code_col, count(*) FILTER ({a} = {b}) AS agree FROM j" for a, b in (("s_mod", "n_regionkey"), ("s_one", "n_regionkey"), ("s_mod", "n_nationkey"), ("s_nationkey", "n_nationkey"))),
        "stage_stats": "SELECT event_type, count(*) AS runs, list_sort(list(value))[count(*) // 2 + 1] AS median, max(value) AS max, round(sum(value), 4) AS total FROM events GROUP BY event_type",
        "untraced_time": "SELECT o_orderkey, round(greatest(o_totalprice - s, 0.0), 2) AS untraced FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
        "metrics_tally": "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, max(l_extendedprice) AS most, (list(l_orderkey || ':' || l_linenumber ORDER BY l_extendedprice DESC, l_orderkey || ':' || l_linenumber DESC))[1] AS slowest FROM lineitem GROUP BY 1",
    }
    states = {
        "snapshot_diff": f"{_STATES}, {_DIFF} SELECT * FROM d WHERE change IS NOT NULL",
        "rename_pairs": f"{_STATES}, {_PAIRS} SELECT old_path, new_path FROM p",
        "changed_paths": f"{_STATES}, {_DIFF}, {_PAIRS} SELECT path FROM d WHERE change IS NOT NULL UNION SELECT old_path FROM p UNION SELECT new_path FROM p",
        "merkle_rollup": """WITH na AS (SELECT n_name AS path, n_regionkey, sha256('dir:' || string_agg(c_name || '=' || sha256(c_mktsegment), ';' ORDER BY c_name)) AS hash FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey),
          re AS (SELECT r_name AS path, sha256('dir:' || string_agg(path || '=' || hash, ';' ORDER BY path)) AS hash FROM na JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
          SELECT path, hash FROM na UNION ALL SELECT path, hash FROM re UNION ALL SELECT '/', sha256('dir:' || string_agg(path || '=' || hash, ';' ORDER BY path)) FROM re""",
        "prune_snapshots": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 2",
        "state_diff": """WITH s AS (SELECT doc_id AS path, md5(text) AS h FROM documents WHERE n_chars < 6000), n AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE n_chars > 200)
          SELECT * FROM (SELECT coalesce(s.path, n.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' WHEN s.h <> n.h THEN 'changed' END AS state FROM s FULL JOIN n ON s.path = n.path) WHERE state IS NOT NULL""",
        "delta_rows": """WITH a AS (SELECT user_id, event_type FROM events WHERE event_type <> 'click'), b AS (SELECT user_id, event_type FROM events WHERE event_type <> 'view')
          SELECT *, 'delete' AS op FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'insert' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
        "replaced_files": "SELECT doc_id, source, CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents",
        "pass_key": " UNION ALL ".join(_key(*x) for x in (("nation", ("n_nationkey", "n_name")), ("customer", ("c_custkey", "c_name", "c_mktsegment")), ("labels", ("doc_id", "quality")))),
        "line_limits": f"WITH {_LINES} SELECT item, n_lines, CASE WHEN n_lines > 20 THEN 'over' ELSE 'near' END AS verdict FROM lines WHERE n_lines >= {_CEILING}",
        "worst15": f"WITH {_LINES} SELECT item, n_lines, round(n_lines / 20.0::DOUBLE, 4) AS ratio FROM lines ORDER BY ratio DESC, item LIMIT 15",
        "ratchet": """WITH c AS (SELECT source || '/' || lang AS item, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT item, n + CASE WHEN n % 2 = 0 THEN 2 ELSE -1 END AS n FROM c WHERE n % 3 <> 0)
          SELECT * FROM (SELECT coalesce(c.item, b.item) AS item, coalesce(c.n, 0) AS now, b.n AS was,
            CASE WHEN b.n IS NULL AND coalesce(c.n, 0) > 10 THEN 'NEW' WHEN b.n IS NOT NULL AND coalesce(c.n, 0) < 9 THEN 'REMOVE' WHEN b.n IS NOT NULL AND c.n > b.n THEN 'GREW' WHEN b.n IS NULL AND c.n >= 9 THEN 'NEAR' END AS verdict
            FROM c FULL JOIN b ON c.item = b.item) WHERE verdict IS NOT NULL""",
    }
    code = {
        "fold_always_maybe": """WITH w AS (SELECT o_custkey, o_orderkey, list(DISTINCT p_brand) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
          g AS (SELECT o_custkey, list(s) AS ways FROM w GROUP BY 1)
          SELECT o_custkey, array_to_string(list_sort(list_reduce(ways, lambda x, y: list_intersect(x, y))), ',') AS always, array_to_string(list_sort(list_distinct(flatten(ways))), ',') AS maybe FROM g""",
        "restrict_domain": f"""WITH r AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'not_in' END AS op, list(DISTINCT o_orderpriority) AS m FROM orders GROUP BY 1, 2),
          x AS (SELECT k, bool_or(op = 'unknown') AS u, any_value(m) FILTER (op = 'in') AS i, coalesce(any_value(m) FILTER (op = 'not_in'), []) AS o FROM r GROUP BY k),
          y AS (SELECT k, u, list_filter({_DOMAIN}, lambda v: (i IS NULL OR list_contains(i, v)) AND NOT list_contains(o, v)) AS a FROM x),
          z AS (SELECT k, u, a, list_filter({_DOMAIN}, lambda v: NOT list_contains(a, v)) AS e FROM y)
          SELECT k, CASE WHEN u THEN 'unknown' WHEN len(a) <= len(e) THEN 'in' ELSE 'not_in' END AS side, CASE WHEN u THEN '' WHEN len(a) <= len(e) THEN array_to_string(a, ',') ELSE array_to_string(e, ',') END AS members FROM z WHERE u OR len(e) > 0""",
        "entity_keys": """WITH a AS (SELECT p_partkey, p_brand AS path, CASE WHEN count(*) OVER (PARTITION BY p_type) > 1 THEN p_type || '@' || p_brand ELSE p_type END AS k FROM part)
          SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN k || '~' || row_number() OVER (PARTITION BY k ORDER BY path, p_partkey) ELSE k END AS entity_key FROM a""",
        "duplicate_names": """WITH s AS (SELECT p_type, p_brand, string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) AS m FROM part GROUP BY 1, 2) SELECT p_type, count(*) AS n_places, count(DISTINCT m) > 1 AS members_differ FROM s GROUP BY 1 HAVING count(*) >= 2""",
        "decorator_args": "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ', ' ORDER BY l_linenumber, l_partkey::VARCHAR) AS args FROM lineitem GROUP BY 1",
        "dead_candidates": f"""WITH f(path, qualname, name, cls, launched, decorated, wild) AS (VALUES {CODE['functions']}), up(src, dst) AS (VALUES ('D', 'C'), ('E', 'Outside'))
          SELECT path, qualname FROM f WHERE launched = 0 AND decorated = 0 AND wild = 0 AND NOT starts_with(name, '__') AND qualname <> 'g' AND name <> 'zzz'
          AND cls NOT IN (SELECT src FROM up WHERE dst NOT IN ('C', 'D', 'E')) AND NOT EXISTS (SELECT 1 FROM up JOIN f x ON x.cls = up.dst AND x.name = f.name WHERE up.src = f.cls)""",
        "unused_imports": f"""WITH RECURSIVE i(path, local, from_path, name, used, guarded, wild) AS (VALUES {CODE['imports']}),
          live AS (SELECT path, local, from_path, name FROM i WHERE used = 1 OR guarded = 1 OR wild = 1 UNION SELECT i.path, i.local, i.from_path, i.name FROM live JOIN i ON live.from_path = i.path AND live.name = i.local)
          SELECT path, local FROM i WHERE used IS NOT NULL AND (path, local) NOT IN (SELECT path, local FROM live)""",
        "defaults": f"""WITH p(fn, param, position, launched, wild) AS (VALUES {CODE['params']}), c(fn, n_args, names, splat) AS (VALUES ('f', 1, 'b', 0), ('f', 1, '', 0), ('g', 0, '', 0), ('g', 0, '', 1)),
          j AS (SELECT p.fn, param, count(c.fn) AS calls, coalesce(bool_or(n_args > position OR names = param), FALSE) AS passed, coalesce(bool_or(splat = 1), FALSE) OR max(launched) = 1 OR max(wild) = 1 AS unseen FROM p LEFT JOIN c ON p.fn = c.fn GROUP BY 1, 2)
          SELECT fn, param, CASE WHEN passed THEN 'passed' WHEN unseen THEN 'cannot tell' WHEN calls = 0 THEN 'no caller' ELSE 'never passed' END AS verdict FROM j""",
    }
    path = "regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-z]+://', '')"
    bound = "CASE WHEN m = 1 THEN 'bound' WHEN m > 1 THEN 'ambiguous' ELSE 'missing' END"
    links = {
        "name_links": f"""WITH u AS (SELECT DISTINCT l_orderkey AS src, CASE WHEN l_partkey % 7 = 0 THEN p_name || '?' ELSE p_name END AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
          j AS (SELECT src, u.name, count(DISTINCT p_partkey) AS m, min(p_partkey) AS t FROM u LEFT JOIN part ON u.name = p_name GROUP BY 1, 2)
          SELECT src, name, CASE WHEN m = 1 THEN t END AS target, m AS matches, {bound} AS status FROM j""",
        "suffix_links": f"""WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
          u AS (SELECT page_id AS src, CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '' END || regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS suffix FROM pages),
          j AS (SELECT src, suffix, count(path) AS m FROM u LEFT JOIN p ON path = suffix OR ends_with(path, '/' || suffix) GROUP BY 1, 2)
          SELECT src, suffix, m AS matches, {bound} AS status FROM j""",
        "dispatch_links": """SELECT event_id AS site, 'event' AS kind, event_type AS message, handler FROM events LEFT JOIN (VALUES ('error', 'Alert'), ('view', 'Count'), ('view', 'Log')) v(message, handler) ON message = event_type""",
        "doc_code_names": """WITH d AS (SELECT DISTINCT p_name FROM part WHERE p_size < 20), c AS (SELECT DISTINCT p_name FROM part WHERE p_size > 40)
          SELECT coalesce(d.p_name, c.p_name) AS name, CASE WHEN c.p_name IS NULL THEN 'missing in code' WHEN d.p_name IS NULL THEN 'missing in doc' ELSE 'bound' END AS status FROM d FULL JOIN c ON d.p_name = c.p_name""",
        "dangling_refs": "SELECT l_partkey AS id, count(*) AS uses FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY 1",
        "orphan_nodes": f"WITH RECURSIVE {_GRAPH}, w AS (SELECT n_nationkey::BIGINT AS node FROM nation WHERE n_nationkey < 2 UNION SELECT dst FROM w JOIN g ON node = src) SELECT n_nationkey::BIGINT AS node FROM nation WHERE n_nationkey NOT IN (SELECT node FROM w)",
        "route_tree": """WITH r AS (SELECT 'r' || r_regionkey AS node, '/' || lower(r_name) AS path FROM region), n AS (SELECT 'n' || n_nationkey AS node, path || '/' || lower(n_name) AS path FROM nation JOIN r ON r.node = 'r' || n_regionkey)
          SELECT * FROM r UNION ALL SELECT * FROM n UNION ALL SELECT 's' || s_suppkey, path || '/' || lower(s_name) FROM supplier JOIN n ON n.node = 'n' || s_nationkey""",
        "alias_classes": """WITH s AS (SELECT DISTINCT n_nationkey AS key, CASE WHEN n_nationkey % 4 = 2 THEN n_nationkey - 1 ELSE n_nationkey END AS cls, substr(c_mktsegment, 1, 4) AS member FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 6 <> c_nationkey % 6),
          n AS (SELECT cls, count(DISTINCT key) AS n FROM s GROUP BY 1), h AS (SELECT cls, member, count(*) AS k FROM s GROUP BY 1, 2)
          SELECT cls, coalesce(string_agg(member, ',' ORDER BY member) FILTER (WHERE k = n), '') AS members FROM h JOIN n USING (cls) GROUP BY cls""",
        "key_builds": "SELECT lower(r_name) || '.{}.label' AS template, lower(r_name) || '.' || m || '.label' AS key FROM region, (VALUES ('red'), ('green')) v(m)",
        "package_prefix": f"""WITH p AS (SELECT DISTINCT {path} AS path FROM pages), x AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS prefix FROM p WHERE path LIKE '%/en/%' OR path LIKE '%/de/%')
          SELECT path, max(prefix) AS prefix FROM p JOIN x ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path""",
        "carried_ids": "SELECT n_name, n_regionkey, n_nationkey AS pos, CASE WHEN n_nationkey < 15 THEN 'o:' || n_nationkey ELSE 'n:' || substr(md5(n_name || '|' || n_regionkey || '|1'), 1, 8) END AS id FROM nation WHERE n_nationkey > 5",
        "shape_groups": "SELECT sha256('0:object:;1:number:k') AS shape, count(*) AS n FROM events",
        "gate_chain": f"WITH {_TREE} SELECT t.owner, 3::BIGINT AS n, string_agg(t.value, ' > ' ORDER BY t.n) AS chain FROM tree t WHERE t.n < 3 AND t.last >= 3 GROUP BY t.owner",
        "unclaimed_paths": """SELECT page_id, path FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-z]+://[^/]+', '') AS path FROM pages)
          WHERE NOT regexp_matches(lower(path), '^/en/.*$') AND NOT regexp_matches(lower(path), '^/de/[^/]*\\.html$') AND NOT regexp_matches(lower(path), '^/f[^/]/[^/]*$')""",
        "reused_hashes": "SELECT event_id AS path, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 AND user_id < 60 THEN md5(event_id::VARCHAR) END AS hash FROM events",
        "file_table_counts": "SELECT file, tbl, count(*) AS n FROM (SELECT c_nationkey::BIGINT AS file, 'customer' AS tbl FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier UNION ALL SELECT n_nationkey, 'nation' FROM nation) GROUP BY 1, 2",
        "id_lookup": " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS cell FROM orders WHERE o_orderkey = 7 AND {c}::VARCHAR <> ''" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")),
        "rebased_baseline": "SELECT source || '/' || lang AS item, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 18",
        "run_totals": "SELECT count(*) AS files, count(quality) AS mapped, count(*) FILTER (quality IS NULL) AS unmapped, coalesce(max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS exit_code FROM documents LEFT JOIN labels USING (doc_id)",
        "dependents_reread": f"WITH {_GRAPH} SELECT src AS node FROM g WHERE dst IN (1, 2, 3) UNION SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 2, 3)",
        "disjunction": """WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority AS p, o_orderkey % 3 AS k FROM orders WHERE o_orderkey % 3 < 2), b AS (SELECT o_custkey FROM a GROUP BY 1 HAVING count(DISTINCT k) = 2)
          SELECT o_custkey, string_agg(DISTINCT p, ',' ORDER BY p) AS members FROM a WHERE o_custkey IN (SELECT o_custkey FROM b) GROUP BY 1""",
    }
    indexes = {
        "magic_numbers": """SELECT l_quantity::BIGINT AS number, count(*) AS uses FROM lineitem WHERE l_quantity::BIGINT NOT IN (0, 1, -1, 2) AND l_linenumber NOT IN (1, 2) GROUP BY 1""",
        "list_readers": """SELECT DISTINCT 'orders' AS table_name, o_custkey::VARCHAR AS row_key FROM orders WHERE o_orderpriority ILIKE '%UR%'
          UNION ALL SELECT 'part', p_partkey::VARCHAR FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x ILIKE '%UR%')) > 0""",
        "key_sections": """WITH r AS (SELECT event_id AS place, 'n' || (user_id % 7) AS name, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN event_type || '.x' END AS value, CASE WHEN event_id % 4 = 2 THEN 'n' || (user_id % 9) END AS reads FROM events),
          a AS (SELECT 'spelled' AS section, place, name FROM r WHERE value = 'view' UNION ALL SELECT 'built', place, name FROM r WHERE starts_with(value, 'view.'))
          SELECT * FROM a UNION ALL SELECT 'read', place, reads FROM r WHERE reads IN (SELECT name FROM a)""",
        "inverted_index": "SELECT p_name, count(*) AS n, string_agg(p_brand, ',' ORDER BY p_brand) AS holders FROM (SELECT DISTINCT p_name, p_brand FROM part) GROUP BY 1",
        "topological_levels": f"""{_CLOSURE}, nodes AS (SELECT src AS node FROM g UNION SELECT dst FROM g),
          comp AS (SELECT node, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node), node) AS c FROM nodes),
          between_ AS (SELECT DISTINCT p.c AS a, q.c AS b FROM g JOIN comp p ON p.node = src JOIN comp q ON q.node = dst WHERE p.c <> q.c),
          lv AS (SELECT DISTINCT c AS comp, 0 AS level FROM comp UNION SELECT a, level + 1 FROM lv JOIN between_ ON comp = b)
          SELECT node, max(level)::BIGINT AS level FROM comp JOIN lv ON lv.comp = comp.c GROUP BY node""",
        "atlas": r"""WITH r AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS boundary, regexp_extract(url, '^[a-z]+://[^/]+(/[^/]*)', 1) AS route FROM pages)
          SELECT regexp_extract(boundary, '([^.]*\.[^.]*)$', 1) AS project, count(*) AS rows, count(DISTINCT route) AS routes, count(DISTINCT boundary) AS boundaries FROM r GROUP BY 1""".replace("\\\\", "\\"),
        "longest_sections": "SELECT source, lang, chars, rank FROM (SELECT source, lang, sum(n_chars)::BIGINT AS chars, row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, lang) AS rank FROM documents GROUP BY 1, 2) WHERE rank <= 2",
        "inherited_properties": f"{_CLOSURE}, base AS (SELECT s_nationkey AS node, 'p' || (s_suppkey % 5) AS property FROM supplier) SELECT node, property FROM base UNION SELECT src, property FROM reach JOIN base ON dst = node",
    }
    links["freshness"] = f"SELECT state, count(*) AS n, min(path) AS first FROM ({states['state_diff']}) GROUP BY 1"
    values = {
        "clipped_texts": "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...[+' || (length(text) - 40) || ' chars]' ELSE text END AS cell FROM documents",
        "number_keys": """WITH v AS (SELECT lpad(p_size::VARCHAR, 4, '0') AS v FROM part UNION ALL SELECT p_size::VARCHAR FROM part UNION ALL SELECT p_brand FROM part)
          SELECT coalesce('#' || TRY_CAST(v AS DOUBLE)::VARCHAR, v) AS key, count(*) AS n, count(DISTINCT v) AS spellings FROM v GROUP BY 1""",
        "content_hashes": "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents",
        "lenient_numbers": """SELECT p_brand, sum(coalesce(TRY_CAST(c AS DOUBLE), 0.0)) AS total FROM (SELECT p_brand, regexp_extract(p_brand, '([^#]*)$', 1) AS c FROM part UNION ALL SELECT p_brand, p_type FROM part) GROUP BY 1""",
        "name_parts": """WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)
          SELECT page_id, split_part(h, '.', 1) AS first, split_part(h, '.', -1) AS last, chr(39) || replace(h, chr(39), chr(39) || chr(39)) || chr(39) AS literal FROM h""",
        "best_path": """WITH l AS (SELECT n_nationkey, n_name, CASE WHEN n_name = 'N_7' THEN 0 WHEN ends_with(n_name, '/N_7') THEN 1 WHEN contains(n_name, 'N_7') THEN 2 END AS level FROM nation)
          SELECT n_nationkey, n_name FROM l WHERE level = (SELECT min(level) FROM l) AND (SELECT count(*) FROM l WHERE level = (SELECT min(level) FROM l)) = 1""",
    }
    tree = {
        "first_child_value": f"WITH {_TREE}, k AS (SELECT owner, parent, arg_min(value, n) AS customer FROM tree WHERE role = 'customer' GROUP BY 1, 2) SELECT t.owner, t.n, customer FROM tree t LEFT JOIN k ON k.owner = t.owner AND k.parent = t.n",
        "node_outline": f"WITH {_TREE} SELECT owner, n, repeat('  ', depth) || coalesce(value, '') AS line FROM tree",
    }
    return {**SQL, **tree, **values, **indexes, **links, **lenses, **nodes, **joins, **graphs, **copies, **text, **sets, **states, **code}
