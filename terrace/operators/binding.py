"""Binding Python calls to the definitions they run, and their arguments to parameters, over the rows of sources.python_code.

A call is bound through its file's own scopes and imports, never by its bare name; what stays open is
bound to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.graph import fixpoint
from terrace.session import cut
from terrace.sources.python_code import table

#: The names a method reaches its own class through.
RECEIVERS = ("self", "cls")


def above(column: str) -> Column:
    """A dotted name without its last segment, '' for one segment."""
    return F.regexp_extract(column, r"^(.*)\.[^.]*$", 1)


def module_of(path: str) -> Column:
    return F.replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def prefixes(column: str) -> Column:
    """(d, prefix) of a dotted name for its first d segments, all d."""
    parts = F.split(column, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("d"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("prefix")))


def definitions(rows: DataFrame) -> DataFrame:
    """path, qual: every function and class by its qualified name."""
    return table(rows, "functions").unionByName(table(rows, "classes")).select("path", F.col("qualname").alias("qual")).distinct()


def imports(rows: DataFrame) -> DataFrame:
    """path, local, module, item of module-level imports; item is null for a whole module. Relative modules are made absolute."""
    r = table(rows, "imports").filter("NOT contains(qualname, '.')")
    whole = ~F.col("detail").contains(":")
    folders = F.split(F.regexp_replace("path", r"\.py$", ""), "/")
    kept = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - F.col("position").cast("int"), F.lit(0)))
    named = F.regexp_extract("detail", r"^\.*([^:]*):", 1)
    relative = F.concat_ws(".", F.nullif(F.array_join(kept, "."), F.lit("")), F.nullif(named, F.lit("")))
    plain = F.when(F.col("name") == F.substring_index("detail", ".", 1), F.col("name")).otherwise(F.col("detail"))
    module = F.when(whole, plain).when(F.col("position") > 0, relative).otherwise(named)
    return r.select("path", F.col("name").alias("local"), module.alias("module"), F.when(~whole, F.substring_index("detail", ":", -1)).alias("item"))


def import_chains(rows: DataFrame) -> DataFrame:
    """path, local, file, item: each file that a from-import is looked for in, re-exports followed to the end."""
    files = table(rows, "files").select(module_of("path").alias("module"), F.col("path").alias("file"))
    froms = imports(rows).filter("item IS NOT NULL").join(files, "module").select("path", "local", "file", "item")
    own = definitions(rows).select(F.col("path").alias("file"), F.col("qual").alias("item"))
    onward = froms.select(F.col("path").alias("_f"), F.col("local").alias("_l"), F.col("file").alias("_file"), F.col("item").alias("_item"))
    step = lambda new: new.join(own, ["file", "item"], "left_anti").join(onward, (F.col("file") == F.col("_f")) & (F.col("item") == F.col("_l"))).select("path", "local", F.col("_file").alias("file"), F.col("_item").alias("item"))
    return fixpoint(froms, step, ["path", "local", "file", "item"])


def names(rows: DataFrame) -> DataFrame:
    """path, local, file, qual, module: what each module-level name is, a definition (file, qual) or a module.

    A file's own definitions come first; a name that reaches two definitions is none.
    """
    own = definitions(rows)
    top = own.filter("NOT contains(qual, '.')").select("path", F.col("qual").alias("local"), F.col("path").alias("file"), "qual")
    reached = import_chains(rows).join(own.select(F.col("path").alias("file"), F.col("qual").alias("item")), ["file", "item"])
    once = reached.groupBy("path", "local").agg(F.min(F.struct("file", "item")).alias("t"), F.countDistinct("file", "item").alias("n")).filter("n = 1")
    taken = once.select("path", "local", F.col("t.file").alias("file"), F.col("t.item").alias("qual")).join(top, ["path", "local"], "left_anti")
    known = table(rows, "files").select(module_of("path").alias("module"))
    modules = imports(rows).select("path", "local", F.concat_ws(".", "module", "item").alias("module"))
    packages = known.select(F.explode(prefixes("module")).alias("p")).select(F.col("p.prefix").alias("module")).distinct()
    modules = modules.join(packages, "module", "left_semi").join(top.unionByName(taken), ["path", "local"], "left_anti")
    modules = modules.groupBy("path", "local").agg(F.min("module").alias("module"), F.countDistinct("module").alias("n")).filter("n = 1").drop("n")
    return top.unionByName(taken).withColumn("module", F.lit(None).cast("string")).unionByName(modules, allowMissingColumns=True)


def bound_calls(rows: DataFrame) -> DataFrame:
    """path, site, caller, name, target of every call; target is file::qualname, '' where the call stays open.

    In this order: a method of the caller's own class through self, a definition nested in an
    enclosing function, nothing if the name is a parameter or local there, the file's own
    names, what it imports, a module's member.
    """
    rows = cut(rows)
    named, own = cut(names(rows)), cut(definitions(rows))
    calls = table(rows, "calls").select("path", "site", F.col("qualname").alias("caller"), "name")
    plain = F.col("name").rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$")
    parts = F.split("name", r"\.")
    calls = cut(calls.withColumns({"head": F.when(plain, parts[0]), "rest": F.when(plain, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "."))}).distinct())
    target = F.concat("file", F.lit("::"), F.col("qual"))

    # Scopes around a call, nearest first: the caller's name cut after each of its segments.
    scopes = calls.filter("caller <> ''").select("path", "site", "name", "head", "rest", F.explode(prefixes("caller")).alias("s")).select("path", "site", "name", "head", "rest", "s.d", F.col("s.prefix").alias("scope"))
    classes = table(rows, "classes").select("path", F.col("qualname").alias("scope")).distinct()
    functions = table(rows, "functions").select("path", F.col("qualname").alias("scope")).distinct()
    best = lambda df: df.groupBy("path", "site", "name").agg(F.max_by("target", "d").alias("target"))
    through_self = scopes.filter(F.col("head").isin(*RECEIVERS) & (F.col("rest") != "")).join(classes, ["path", "scope"])
    through_self = through_self.groupBy("path", "site", "name", "rest").agg(F.max_by("scope", "d").alias("scope")).select("path", "site", "name", F.col("path").alias("file"), F.concat_ws(".", "scope", "rest").alias("qual"))
    through_self = through_self.join(own.withColumnRenamed("path", "file"), ["file", "qual"]).select("path", "site", "name", target.alias("target"))
    inside = scopes.join(functions, ["path", "scope"])
    nested = best(inside.select("path", "site", "name", "d", F.concat_ws(".", "scope", "head", F.nullif("rest", F.lit(""))).alias("qual")).join(own, ["path", "qual"]).withColumn("target", F.concat("path", F.lit("::"), F.col("qual"))))
    params = table(rows, "parameters").select("path", F.col("qualname").alias("scope"), F.col("name").alias("head"))
    locals_ = table(rows, "assignments").select("path", above("qualname").alias("scope"), F.col("name").alias("head"))
    shadowed = inside.join(params.unionByName(locals_).distinct(), ["path", "scope", "head"], "left_semi").select("path", "site", "name", F.lit("").alias("target"))

    at = calls.select("path", "site", "name", F.col("head").alias("local"), "rest").join(named, ["path", "local"])
    direct = at.filter("module IS NULL").select("path", "site", "name", "file", F.concat_ws(".", "qual", F.nullif("rest", F.lit(""))).alias("qual"))
    direct = direct.join(own.withColumnRenamed("path", "file"), ["file", "qual"]).select("path", "site", "name", target.alias("target"))
    files = table(rows, "files").select(module_of("path").alias("module"), F.col("path").alias("_file"))
    way = at.filter("module IS NOT NULL AND rest <> ''").select("path", "site", "name", "module", "rest", F.size(F.split("rest", r"\.")).alias("_n"))
    # The module is what the import bound and any number of the next segments; the first segment after it is a name there.
    cuts = way.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_p", F.split("rest", r"\."))
    cuts = cuts.select("path", "site", "name", "i", F.concat_ws(".", "module", F.nullif(F.array_join(F.slice("_p", F.lit(1), F.col("i")), "."), F.lit(""))).alias("module"), F.get("_p", F.col("i")).alias("_local"), F.array_join(F.slice("_p", F.col("i") + 2, F.col("_n")), ".").alias("_rest"))
    members = named.filter("module IS NULL").select(F.col("path").alias("_file"), F.col("local").alias("_local"), "file", "qual")
    via = cuts.join(files, "module").join(members, ["_file", "_local"]).select("path", "site", "name", F.col("i").alias("d"), "file", F.concat_ws(".", "qual", F.nullif("_rest", F.lit(""))).alias("qual"))
    via = best(via.join(own.withColumnRenamed("path", "file"), ["file", "qual"]).withColumn("target", target))

    ranked = [df.select("path", "site", "name", "target", F.lit(i).alias("rank")) for i, df in enumerate((through_self, nested, shadowed, direct, via))]
    found = ranked[0]
    for df in ranked[1:]:
        found = found.unionByName(df)
    first = found.groupBy("path", "site", "name").agg(F.min_by("target", "rank").alias("target"))
    return calls.join(first, ["path", "site", "name"], "left").select("path", "site", "caller", "name", F.coalesce("target", F.lit("")).alias("target"))


def bound_arguments(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """path, site, name, position, value, param of every argument of the calls; param is '' where it is not known.

    By keyword the parameter of that name; by position the callee's, one further where the receiver
    fills the first, until a splat makes later positions unknown. A class is called through its __init__.
    """
    args = table(rows, "arguments").select("path", "site", "name", "position", F.col("detail").alias("value"), "mode")
    splat = args.filter("mode = '*'").groupBy("path", "site", "name").agg(F.min("position").alias("_splat"))
    own = table(rows, "classes").select(F.concat("path", F.lit("::"), F.col("qualname")).alias("target"), F.lit(1).alias("_class")).distinct()
    bound = calls.filter("target <> ''").select("path", "site", "name", "target").join(own, "target", "left")
    through = F.col("_class").isNotNull() | F.substring_index("name", ".", 1).isin(*RECEIVERS)
    bound = bound.select("path", "site", "name", F.when(F.col("_class") == 1, F.concat("target", F.lit(".__init__"))).otherwise(F.col("target")).alias("target"), F.when(through, 1).otherwise(0).alias("_shift"))
    params = table(rows, "parameters").select(F.concat("path", F.lit("::"), F.col("qualname")).alias("target"), F.col("name").alias("param"), F.col("position").alias("_at"), F.col("mode").alias("_mode"))
    a = args.join(bound, ["path", "site", "name"]).join(splat, ["path", "site", "name"], "left")
    by_name = a.filter("mode LIKE '=%'").withColumn("param", F.substring("mode", 2, 1000000)).join(params.filter("_mode IN ('', 'kwonly')").select("target", "param"), ["target", "param"], "left_semi")
    by_place = a.filter("mode = '' AND (_splat IS NULL OR position < _splat)").withColumn("_at", F.col("position") + F.col("_shift")).join(params.filter("_mode = ''").select("target", "_at", "param"), ["target", "_at"])
    filled = by_name.select("path", "site", "name", "position", "param").unionByName(by_place.select("path", "site", "name", "position", "param"))
    return args.join(filled, ["path", "site", "name", "position"], "left").select("path", "site", "name", "position", "value", F.coalesce("param", F.lit("")).alias("param"))


def bound_through(rows: DataFrame) -> DataFrame:
    """path, file: the files whose change can change what a file's names are bound to."""
    files = table(rows, "files").select(module_of("path").alias("module"), F.col("path").alias("file"))
    whole = imports(rows).filter("item IS NULL").join(files, "module").select("path", "file")
    return import_chains(rows).select("path", "file").unionByName(whole).distinct()
