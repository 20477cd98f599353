"""Derived tables of an application: state graph, inputs, remotes, translations, hiding classes, reads, render scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_graph(dispatches: DataFrame, handlers: DataFrame, selectors: DataFrame, effects: DataFrame) -> DataFrame:
    """src, dst, kind: site -> action, action -> reducer, reducer -> selector of the state key it writes, action -> effect.

    dispatches (site, action); handlers (action, reducer, state); selectors (selector, state); effects (effect, action).
    """
    read = handlers.select("reducer", "state").distinct().join(selectors.select("selector", "state").distinct(), "state")
    edge = lambda df, src, dst, kind: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"))
    edges = edge(dispatches, "site", "action", "dispatches").unionByName(edge(handlers, "action", "reducer", "handled by"))
    return edges.unionByName(edge(read, "reducer", "selector", "read by")).unionByName(edge(effects, "action", "effect", "starts")).distinct()


def input_usage(inputs: DataFrame, bindings: DataFrame) -> DataFrame:
    """component, name, n_bindings, declared: bindings of each input, those out of scope left out; bindings of no input too.

    inputs (component, name); bindings (component, name, scope).
    """
    n = bindings.filter(F.coalesce("scope", F.lit("")) != "out_of_scope").groupBy("component", "name").agg(F.count(F.lit(1)).alias("n"))
    rows = inputs.select("component", "name").distinct().withColumn("_d", F.lit(True)).join(n, ["component", "name"], "full")
    return rows.select("component", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n_bindings"), F.coalesce("_d", F.lit(False)).alias("declared"))


def federation_routes(routes: DataFrame, exposes: DataFrame, classes: DataFrame) -> DataFrame:
    """route, request, cls: the class a route (route, remote, module, picked) loads from a remote.

    exposes (config, remote, module, file) are what each configuration lists; classes (cls, name, file).
    A remote of two configurations, a module none lists or a file without the class leaves cls null;
    no class is found by its name alone.
    """
    one = exposes.groupBy("remote", "module").agg(F.min("file").alias("file"), F.countDistinct("file").alias("_f"))
    sure = exposes.groupBy("remote").agg(F.countDistinct("config").alias("_c")).filter("_c = 1").select("remote")
    target = one.filter("_f = 1").join(sure, "remote", "left_semi").select("remote", "module", "file")
    held = classes.groupBy(F.col("name").alias("picked"), "file").agg(F.min("cls").alias("cls"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    rows = routes.join(target, ["remote", "module"], "left").join(held, ["picked", "file"], "left")
    return rows.select("route", F.concat("remote", F.lit("/"), F.regexp_replace("module", r"^\./", "")).alias("request"), "cls")


def translations(defined: DataFrame, refs: DataFrame) -> DataFrame:
    """key, status, n_locales, n_refs: defined (locale, key), referenced (key), or both."""
    d = defined.groupBy("key").agg(F.countDistinct("locale").alias("d"))
    r = refs.groupBy("key").agg(F.count(F.lit(1)).alias("r"))
    status = F.when(F.col("r").isNull(), "defined").when(F.col("d").isNull(), "referenced").otherwise("both")
    zero = F.lit(0).cast("long")
    return d.join(r, "key", "full").select("key", status.alias("status"), F.coalesce("d", zero).alias("n_locales"), F.coalesce("r", zero).alias("n_refs"))


def hiding_classes(gates: DataFrame, rules: DataFrame, own: DataFrame) -> DataFrame:
    """gate, file, selector, scope, bare: class gates (gate, component, cls) with the live rules that hide the class.

    rules (file, selector, cls, live); own (component, file). scope is `own` for the component's own
    stylesheet, `other` for another component's, `shared` for one no component names; bare, where the selector
    asks for the class alone.
    """
    live = rules.filter("live").select("file", "selector", "cls")
    mine = own.select("component", "file", F.lit(1).alias("_m")).distinct()
    any_ = own.select("file", F.lit(1).alias("_a")).distinct()
    rows = gates.join(live, "cls").join(mine, ["component", "file"], "left").join(any_, "file", "left")
    scope = F.when(F.col("_m") == 1, "own").when(F.col("_a") == 1, "other").otherwise("shared")
    return rows.select("gate", "file", "selector", scope.alias("scope"), (F.col("selector") == F.concat(F.lit("."), F.col("cls"))).alias("bare")).distinct()


#: The node kinds that read or write a declaration.
READS = ("Read", "SafeRead", "Write")


def flat_reads(nodes: DataFrame) -> DataFrame:
    """kind, name, file, line, n_expressions, expression: one row per bound read.

    A read node has a child of role target whose members name the declaration (name, file, line). The
    members of all targets are pivoted in one aggregation instead of a join per member.
    """
    member = lambda role: F.max(F.when(F.col("role") == role, F.col("value"))).alias(role)
    members = nodes.filter(F.col("role").isin("name", "file", "line")).groupBy("owner", F.col("parent").alias("_t")).agg(member("name"), member("file"), member("line"))
    targets = nodes.filter("role = 'target'").select("owner", F.col("n").alias("_t"), F.col("parent").alias("_r"))
    reads = nodes.filter(F.col("kind").isin(*READS)).select("owner", F.col("n").alias("_r"), "kind")
    rows = reads.join(targets, ["owner", "_r"]).join(members, ["owner", "_t"]).filter("name IS NOT NULL")
    return rows.groupBy("kind", "name", "file", "line").agg(F.countDistinct("owner").alias("n_expressions"), F.min("owner").alias("expression"))


def render_scope(renders: DataFrame, modules: DataFrame, exports: DataFrame, imports: DataFrame) -> DataFrame:
    """user, candidate, scope: which of the candidates (user, candidate) a user's module can see.

    modules (component, module) declares; exports (module, item) are components or modules handed on;
    imports (module, imported). `declared` in the user's own module, `imported` through what an imported
    module exports, modules re-exported followed to the end, `unknown` where the user has no module.
    """
    from terrace.operators.graph import fixpoint

    reexport = exports.select(F.col("module").alias("_m"), F.col("item").alias("_i"))
    seen = imports.select("module", F.col("imported").alias("via")).distinct()
    step = lambda new: new.join(reexport, F.col("via") == F.col("_m")).select("module", F.col("_i").alias("via"))
    visible = fixpoint(seen, step, ["module", "via"]).select(F.col("module").alias("_um"), F.col("via").alias("candidate"), F.lit(1).alias("_v"))
    home = lambda name, col: modules.select(F.col("component").alias(name), F.col("module").alias(col)).distinct()
    rows = renders.join(home("user", "_um"), "user", "left").join(home("candidate", "_cm"), "candidate", "left").join(visible, ["_um", "candidate"], "left")
    best = rows.groupBy("user", "candidate").agg(F.max(F.col("_um").isNotNull()).alias("k"), F.max(F.coalesce(F.col("_um") == F.col("_cm"), F.lit(False))).alias("d"), F.max(F.col("_v").isNotNull()).alias("v"))
    scope = F.when(~F.col("k"), "unknown").when(F.col("d"), "declared").when(F.col("v"), "imported").otherwise("out_of_scope")
    return best.select("user", "candidate", scope.alias("scope"))
