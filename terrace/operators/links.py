"""Links between rows: names, suffixes, types, documents; each link says bound, ambiguous or missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.components import connected_components
from terrace.operators.graph import fixpoint


def status(matches: Column) -> Column:
    return F.when(matches == 1, "bound").when(matches > 1, "ambiguous").otherwise("missing")


def resolve(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """src, name, target, matches, status; target only where exactly one declaration has the name.

    Declarations are counted per name before the join, so a name declared very often adds no rows.
    """
    d = declared.groupBy("name").agg(F.countDistinct("target").alias("m"), F.min("target").alias("t"))
    j = uses.select("src", "name").distinct().join(d, "name", "left").withColumn("matches", F.coalesce("m", F.lit(0).cast("long")))
    return j.select("src", "name", F.when(F.col("matches") == 1, F.col("t")).alias("target"), "matches", status(F.col("matches")).alias("status"))


def resolve_suffix(uses: DataFrame, paths: DataFrame, sep: str = "/") -> DataFrame:
    """src, suffix, matches, status: paths equal to the suffix or ending in it at a separator.

    The join is on the last segment, the suffix test on what that leaves.
    """
    u = uses.select("src", "suffix").distinct().withColumn("_l", F.substring_index("suffix", sep, -1))
    p = paths.select("path").distinct().withColumn("_l", F.substring_index("path", sep, -1))
    hit = (F.col("path") == F.col("suffix")) | F.endswith("path", F.concat(F.lit(sep), F.col("suffix")))
    n = u.join(p, "_l").filter(hit).groupBy("src", "suffix").agg(F.count(F.lit(1)).alias("m"))
    j = u.drop("_l").join(n, ["src", "suffix"], "left").withColumn("matches", F.coalesce("m", F.lit(0).cast("long")))
    return j.select("src", "suffix", "matches", status(F.col("matches")).alias("status"))


def dispatch(sends: DataFrame, handlers: DataFrame) -> DataFrame:
    """Sent messages to the handlers of the same kind and message type; unhandled ones keep a null handler."""
    return sends.join(handlers.select("kind", "message", "handler"), ["kind", "message"], "left").select("site", "kind", "message", "handler")


def both_sides(doc: DataFrame, in_code: DataFrame) -> DataFrame:
    """name, status: bound, missing in code, missing in doc."""
    d, c = doc.select("name").distinct().withColumn("_d", F.lit(1)), in_code.select("name").distinct().withColumn("_c", F.lit(1))
    s = F.when(F.col("_c").isNull(), "missing in code").when(F.col("_d").isNull(), "missing in doc").otherwise("bound")
    return d.join(c, "name", "full").select("name", s.alias("status"))


def dangling(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References whose id is not known, with how often each is named."""
    return refs.join(known.select("id"), "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("uses"))


def orphans(nodes: DataFrame, mentions: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that no chain of mentions (src, dst) reaches from a root."""
    step = lambda new: new.join(mentions, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
    return nodes.join(fixpoint(roots.select("node"), step, ["node"]), "node", "left_anti")


def absolute_paths(tree: DataFrame) -> DataFrame:
    """node, path: each node's name behind those of its parents (node, parent, name); one round per level."""
    seed = tree.filter("parent IS NULL").select("node", F.concat(F.lit("/"), F.col("name")).alias("path"))
    below = tree.filter("parent IS NOT NULL").select(F.col("node").alias("_n"), F.col("parent").alias("_p"), F.col("name").alias("_x"))
    step = lambda new: new.join(below, F.col("node") == F.col("_p")).select(F.col("_n").alias("node"), F.concat("path", F.lit("/"), F.col("_x")).alias("path"))
    return fixpoint(seed, step, ["node"])


def unify_aliases(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """cls, members: keys joined through binding pairs (a, b) are one class; its members are those all of its keys with a set allow."""
    comps = connected_components(pairs)
    named = sets.join(comps, F.col("key") == F.col("node"), "left").withColumn("cls", F.coalesce("component", "key"))
    n = named.groupBy("cls").agg(F.countDistinct("key").alias("n"))
    hits = named.select("cls", "key", "member").distinct().groupBy("cls", "member").agg(F.count(F.lit(1)).alias("k")).join(n, "cls")
    return hits.groupBy("cls").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") == F.col("n"), F.col("member")))), ",").alias("members"))


def key_builds(templates: DataFrame, domain: list[str]) -> DataFrame:
    """Templates with one hole {} filled with each member of a finite domain."""
    filled = templates.select("template", F.explode(F.array(*(F.lit(x) for x in domain))).alias("member"))
    return filled.select("template", F.replace("template", F.lit("{}"), F.col("member")).alias("key"))


def nearest_prefix(paths: DataFrame, prefixes: DataFrame, sep: str = "/") -> DataFrame:
    """path, prefix: the longest known folder prefix of each path; candidates are the path's own folders, so the join is on equality."""
    parts = F.split("path", sep)
    n = F.size(parts)
    up = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))
    cand = paths.select("path", F.explode(up).alias("prefix"))
    best = cand.join(prefixes.select("prefix").distinct(), "prefix").groupBy("path").agg(F.max(F.struct(F.char_length("prefix").alias("l"), F.col("prefix").alias("p"))).alias("b"))
    return best.select("path", F.col("b.p").alias("prefix"))


def carry_ids(old: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """New rows with the id of the old row of equal identity, else a fresh one from the identity's hash."""
    w = Window.partitionBy(*identity).orderBy("id")
    kept = old.withColumn("_r", F.row_number().over(w)).select(*identity, "_r", F.col("id").alias("_old"))
    ranked = new.withColumn("_r", F.row_number().over(Window.partitionBy(*identity).orderBy("pos")))
    fresh = F.concat(F.lit("n:"), F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in identity), F.col("_r").cast("string"))), 1, 8))
    return ranked.join(kept, [*identity, "_r"], "left").select(*new.columns, F.coalesce("_old", fresh).alias("id"))


def shape_hash(nodes: DataFrame) -> DataFrame:
    """owner, shape: hash of depth and kind in preorder, scalar values blanked."""
    row = F.struct("n", F.concat_ws(":", F.col("depth").cast("string"), "node", F.coalesce("role", F.lit(""))).alias("t"))
    return nodes.groupBy("owner").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["t"]), ";"), 256).alias("shape"))


def chain_above(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """owner, n, chain: the values of all nodes over each given one (owner, n), outermost first."""
    over = at.select("owner", F.col("n").alias("x")).join(nodes, "owner").filter("n < x AND last >= x")
    row = F.struct("n", F.coalesce("value", F.lit("")).alias("v"))
    return over.groupBy("owner", "x").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda y: y["v"]), " > ").alias("chain")).withColumnRenamed("x", "n")
