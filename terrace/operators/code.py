"""Code-health questions over code rows, and keys for entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.graph import closure, fixpoint


def dead_candidates(functions: DataFrame, bound: DataFrame, named: DataFrame, bases: DataFrame, classes: DataFrame) -> DataFrame:
    """Functions that nothing is seen to reach.

    functions (path, qualname, name, cls, launched, decorated, wild); bound (qualname);
    named (name); bases (src class, dst base); classes (name) are those in the map. A method is
    spared when its class has a base outside the map, or an ancestor with the same method.
    """
    free = functions.filter("launched = 0 AND decorated = 0 AND wild = 0").filter(~F.col("name").rlike("(?s)^__.*__$"))
    free = free.join(bound, "qualname", "left_anti").join(named, "name", "left_anti")
    up = closure(bases)
    outside = up.join(classes.select(F.col("name").alias("dst")), "dst", "left_anti").select(F.col("src").alias("cls")).distinct()
    shadowed = up.join(functions.select(F.col("cls").alias("dst"), "name"), "dst").select(F.col("src").alias("cls"), "name").distinct()
    return free.join(outside, "cls", "left_anti").join(shadowed, ["cls", "name"], "left_anti").select("path", "qualname")


def unused_imports(imports: DataFrame) -> DataFrame:
    """Imports (path, local, from_path, name, used, guarded, wild) that no live import needs; used null is never listed.

    Live are used, guarded and star-importing files' imports, and what a live import takes
    through another file.
    """
    live = imports.filter("used = 1 OR guarded = 1 OR wild = 1").select("path", "local", "from_path", "name")
    rows = imports.select(F.col("path").alias("p"), F.col("local").alias("l"), F.col("from_path").alias("fp"), F.col("name").alias("nm"))
    step = lambda new: new.join(rows, (F.col("from_path") == F.col("p")) & (F.col("name") == F.col("l"))).select(F.col("p").alias("path"), F.col("l").alias("local"), F.col("fp").alias("from_path"), F.col("nm").alias("name"))
    alive = fixpoint(live, step, ["path", "local"])
    return imports.filter("used IS NOT NULL").join(alive.select("path", "local"), ["path", "local"], "left_anti").select("path", "local")


def default_verdicts(params: DataFrame, calls: DataFrame) -> DataFrame:
    """fn, param, verdict: passed, cannot tell, no caller or never passed.

    params (fn, param, position, launched, wild); calls (fn, n_args, names, splat).
    """
    joined = params.join(calls.withColumnRenamed("fn", "_f"), F.col("fn") == F.col("_f"), "left")
    passes = (F.col("n_args") > F.col("position")) | F.array_contains("names", F.col("param"))
    g = joined.groupBy("fn", "param").agg(
        F.count("_f").alias("calls"), F.max(F.coalesce(passes, F.lit(False))).alias("passed"),
        F.max(F.coalesce(F.col("splat") == 1, F.lit(False)) | (F.col("launched") == 1) | (F.col("wild") == 1)).alias("unseen"),
    )
    verdict = F.when(F.col("passed"), "passed").when(F.col("unseen"), "cannot tell").when(F.col("calls") == 0, "no caller").otherwise("never passed")
    return g.select("fn", "param", verdict.alias("verdict"))


def entity_keys(rows: DataFrame, key: str, path: str, order: list[str]) -> DataFrame:
    """rows with entity_key: equal keys get @path, or ~n where they hold a path already; what is still equal gets ~n."""
    same, number = Window.partitionBy("_k"), Window.partitionBy("_k").orderBy(*order)
    first = rows.withColumn("_k", F.col(key))
    pathless = F.col("_k").contains("#") | F.col("_k").startswith("file:") | (F.coalesce(F.col(path), F.lit("")) == "")
    suffix = F.when(pathless, F.concat(F.lit("~"), F.row_number().over(number).cast("string"))).otherwise(F.concat(F.lit("@"), F.col(path)))
    first = first.withColumn("_k", F.when(F.count(F.lit(1)).over(same) > 1, F.concat("_k", suffix)).otherwise(F.col("_k")))
    again = F.when(F.count(F.lit(1)).over(same) > 1, F.concat("_k", F.lit("~"), F.row_number().over(number).cast("string"))).otherwise(F.col("_k"))
    return first.withColumn("entity_key", again).drop("_k")


def duplicate_names(rows: DataFrame, name: str, place: str, member: str) -> DataFrame:
    """name, n_places, members_differ: names in two places or more and whether their member sets differ."""
    sets = rows.groupBy(name, place).agg(F.array_join(F.sort_array(F.collect_set(F.col(member).cast("string"))), ",").alias("s"))
    return sets.groupBy(name).agg(F.count(F.lit(1)).alias("n_places"), (F.countDistinct("s") > 1).alias("members_differ")).filter("n_places >= 2")


def joined_args(args: DataFrame, owner: str, position: str, value: str) -> DataFrame:
    """owner, args: values joined in position order."""
    row = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).cast("string").alias("v"))))
    return args.groupBy(owner).agg(F.array_join(F.transform(row, lambda x: x["v"]), ", ").alias("args"))
