"""The shape of SQL statements over their node rows (owner, n, parent, ord, depth, kind, value, last, line).

An owner is one statement; a clause, table, column, function, literal, alias or schema is a node of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The node kinds that are clauses of a statement.
CLAUSES = ("cte", "where", "groupby", "having", "orderby", "join", "top", "limit", "offset", "distinct", "union", "except", "intersect", "subquery", "values", "output", "over")
#: The node kinds that hold sources of their own.
QUERIES = ("query", "subquery")
#: The clauses a column's role is named by.
ROLES = ("select", "where", "on", "groupby", "having", "orderby", "set", "insert", "output", "over")


def _children(nodes: DataFrame, kind: str, *columns: Column) -> DataFrame:
    """owner, n of the parent, and the columns of its first child of the kind."""
    rows = nodes.filter(F.col("kind") == kind)
    return rows.groupBy("owner", F.col("parent").alias("n")).agg(*columns)


def fingerprints(nodes: DataFrame) -> DataFrame:
    """owner, fingerprint: hash of depth, kind and value in preorder, literals blank and an IN list of literals counted as one.

    Gathers one statement's nodes at a time, nothing larger.
    """
    lists = nodes.filter("kind = 'in'").select("owner", F.col("n").alias("parent"), F.lit(1).alias("_in"))
    siblings = Window.partitionBy("owner", "parent")
    rows = nodes.withColumn("_other", F.count_if((F.col("kind") != "literal") & (F.col("ord") >= 1)).over(siblings)).join(lists, ["owner", "parent"], "left")
    folded = F.coalesce((F.col("_in") == 1) & (F.col("kind") == "literal") & (F.col("ord") > 1) & (F.col("_other") == 0), F.lit(False))
    text = F.concat_ws(":", F.col("depth").cast("string"), "kind", F.when(F.col("kind") == "literal", "").otherwise(F.coalesce("value", F.lit(""))))
    row = F.sort_array(F.collect_list(F.struct("n", text.alias("t"))))
    return rows.filter(~folded).groupBy("owner").agg(F.sha2(F.array_join(F.transform(row, lambda x: x["t"]), ";"), 256).alias("fingerprint"))


def clauses(nodes: DataFrame) -> DataFrame:
    """owner, kind, line of each clause: joins by type, unions by kind, OVER as window; an ORDER BY inside OVER is none."""
    over = nodes.filter("kind = 'over'").select("owner", F.col("n").alias("parent"), F.lit("orderby").alias("kind"))
    value = F.coalesce("value", F.lit(""))
    join = F.when(value == "inner", "join").when(value == "cross apply", "crossapply").when(value == "outer apply", "outerapply").otherwise(F.concat(value, F.lit("join")))
    kind = F.when(F.col("kind") == "join", join).when(F.col("kind") == "union", F.concat(F.lit("union"), value)).when(F.col("kind") == "over", "window").otherwise(F.col("kind"))
    return nodes.filter(F.col("kind").isin(*CLAUSES)).join(over, ["owner", "parent", "kind"], "left_anti").select("owner", kind.alias("kind"), "line")


def joins(nodes: DataFrame, default_schema: str = "dbo") -> DataFrame:
    """owner, type, joined, schema, name, alias, on_line, line: what each join brings in as its second side.

    A common table expression, a # or @ table and a subquery are in no schema.
    """
    j = nodes.filter("kind = 'join'").select("owner", F.col("n").alias("_j"), F.col("value").alias("type"), "line")
    side = nodes.filter("ord = 1").select("owner", F.col("parent").alias("_j"), F.col("n").alias("_t"), F.col("kind").alias("joined"), F.col("value").alias("_v"))
    on = _children(nodes, "on", F.min("line").alias("on_line")).withColumnRenamed("n", "_j")
    schema = _children(nodes, "schema", F.min_by("value", "n").alias("_s")).withColumnRenamed("n", "_t")
    alias = _children(nodes, "alias", F.min_by("value", "n").alias("_a")).withColumnRenamed("n", "_t")
    cte = nodes.filter("kind = 'cte'").select("owner", F.lower("value").alias("_l"), F.lit(1).alias("_c")).distinct()
    rows = j.join(side, ["owner", "_j"]).withColumn("_l", F.lower("_v"))
    rows = rows.join(on, ["owner", "_j"], "left").join(schema, ["owner", "_t"], "left").join(alias, ["owner", "_t"], "left").join(cte, ["owner", "_l"], "left")
    table = F.col("joined") == "table"
    free = ~table | F.substring("_v", 1, 1).isin("#", "@") | F.col("_c").isNotNull()
    return rows.select(
        "owner", "type", "joined", F.when(free, "").otherwise(F.coalesce("_s", F.lit(default_schema))).alias("schema"),
        F.when(table, F.col("_v")).otherwise("").alias("name"), F.coalesce("_a", F.lit("")).alias("alias"), "on_line", "line",
    )


def functions(nodes: DataFrame) -> DataFrame:
    """owner, name, windowed, line of each function call; windowed where it has an OVER."""
    over = _children(nodes, "over", F.lit(True).alias("_w"))
    return nodes.filter("kind = 'func'").join(over, ["owner", "n"], "left").select("owner", F.col("value").alias("name"), F.coalesce("_w", F.lit(False)).alias("windowed"), "line")


def ctes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'cte'").select("owner", F.col("value").alias("name"), "line")


def column_refs(nodes: DataFrame) -> DataFrame:
    """owner, n, column, name, role: the table each column belongs to.

    A qualifier is an alias or table name of the nearest query around the column that has one; a
    column without one belongs to its query's only source, and to none ('') where there are several.
    The role is the nearest clause above, `window` anywhere in an OVER. Gathers one statement's nodes
    at a time, nothing larger, in one shuffle (those without an owner count as one statement). Nothing is
    joined: the planner takes a statement's nodes for one row and would broadcast large sides.
    """
    gathered = {"_q": (QUERIES, ("n", "last")), "_t": (("table",), ("n", "value")), "_a": (("alias",), ("parent", "n", "value")), "_k": (("qualifier",), ("parent", "n", "value")), "_r": (ROLES, ("n", "last", "kind"))}
    sets = [F.collect_set(F.when(F.col("kind").isin(*kinds), F.struct(*columns))).alias(name) for name, (kinds, columns) in gathered.items()]
    columns = F.collect_list(F.when(F.col("kind") == "column", F.struct("n", "value"))).alias("_c")
    used = {"column", *(kind for kinds, _ in gathered.values() for kind in kinds)}
    rows = nodes.filter(F.col("kind").isin(*sorted(used))).groupBy("owner").agg(*sets, columns)

    def around(name: str, n: Column) -> Column:
        return F.filter(name, lambda x: (x["n"] < n) & (n <= x["last"]))

    def child(name: str, n: Column) -> Column:
        """Lower-cased value of the first child."""
        return F.lower(F.array_min(F.transform(F.filter(name, lambda x: x["parent"] == n), lambda x: F.struct(x["n"].alias("n"), x["value"].alias("value"))))["value"])

    def placed(t: Column) -> Column:
        return F.struct(t["n"].alias("n"), t["value"].alias("name"), child("_a", t["n"]).alias("alias"), F.array_max(around("_q", t["n"])).alias("q"))

    def seen(c: Column) -> Column:
        return F.struct(c["n"].alias("n"), c["value"].alias("column"), child("_k", c["n"]).alias("k"), F.array_max(around("_q", c["n"]))["n"].alias("q"), around("_r", c["n"]).alias("r"))

    def resolved(c: Column) -> Column:
        own = F.transform(F.filter("_s", lambda s: s["q"]["n"] == c["q"]), lambda s: s["n"])
        only = F.when(F.size(F.array_distinct(own)) == 1, F.array_min(F.transform(F.filter("_s", lambda s: s["q"]["n"] == c["q"]), lambda s: s["name"])))
        spelled = F.filter("_s", lambda s: s["name"].isNotNull() & ((s["alias"] == c["k"]) | (F.lower(s["name"]) == c["k"])) & (s["q"]["n"] < c["n"]) & (c["n"] <= s["q"]["last"]))
        named = F.array_min(F.transform(spelled, lambda s: F.struct((-s["q"]["n"]).alias("q"), s["name"].alias("name"))))["name"]
        nearest = F.array_max(c["r"])["kind"]
        role = F.when(F.exists(c["r"], lambda r: r["kind"] == "over"), "window").when(nearest == "on", "join").otherwise(F.coalesce(nearest, F.lit("")))
        name = F.coalesce(F.when(c["k"].isNull(), only).otherwise(named), F.lit(""))
        return F.struct(c["n"].alias("n"), c["column"].alias("column"), name.alias("name"), role.alias("role"))

    rows = rows.withColumn("_s", F.filter(F.transform("_t", placed), lambda s: s["q"].isNotNull()))
    return rows.select("owner", F.inline(F.transform(F.transform("_c", seen), resolved)))


def resolve_objects(names: DataFrame, objects: DataFrame, allowed: DataFrame | None = None, default: str = "") -> DataFrame:
    """site, name, status, database, detail: the one database that has each object (site, schema, name).

    objects (schema, name, database); allowed (site, database) narrows where a site has any. Several
    databases: the default if it is one of them, else ambiguous. A script outside every database
    ('') counts only where no database has the name. Catalog schemas are `system`, a null name `dynamic`.
    """
    held = objects.groupBy(F.lower("schema").alias("_s"), F.lower("name").alias("_n")).agg(F.sort_array(F.collect_set("database")).alias("_d"))
    rows = names.withColumns({"_s": F.lower("schema"), "_n": F.lower("name")}).join(held, ["_s", "_n"], "left")
    found = F.coalesce("_d", F.array().cast("array<string>"))
    if allowed is not None:
        rows = rows.join(allowed.groupBy("site").agg(F.collect_set("database").alias("_a")), "site", "left")
        found = F.when(F.col("_a").isNull(), found).otherwise(F.array_intersect(found, F.col("_a")))
    real = F.filter(found, lambda x: x != "")
    rows = rows.withColumn("_f", F.when(F.size(real) > 0, real).otherwise(found))
    several = F.size("_f") > 1
    chosen = F.array_contains("_f", default)
    status = (
        F.when(F.col("name").isNull(), "dynamic").when(F.col("_s").isin("sys", "information_schema"), "system")
        .when(F.size("_f") == 0, "missing").when(several & ~chosen, "ambiguous").otherwise("bound")
    )
    rows = rows.withColumn("status", status)
    bound = F.col("status") == "bound"
    database = F.when(bound & several, F.lit(default)).when(bound, F.get("_f", F.lit(0))).otherwise("")
    listed = F.array_join("_f", ", ")
    detail = F.when(bound & several, F.concat(F.lit("default of "), listed)).when(F.col("status") == "ambiguous", listed).otherwise("")
    return rows.select("site", "name", "status", database.alias("database"), detail.alias("detail"))
