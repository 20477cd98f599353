"""Routes: hrefs in text, endpoint patterns and the calls that reach them."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def routes_in_text(df: DataFrame, text: str) -> DataFrame:
    """route, uses: href values that start with /, query and fragment cut."""
    hrefs = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit('href="(/[^"]*)"'), F.lit(1))).alias("h"))
    return hrefs.select(F.regexp_extract("h", "^[^?#]*", 0).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("uses"))


def variants(pattern: str) -> list[list[str]]:
    """Segment lists of an endpoint: each optional segment present or absent, every distinct list once.

    Optional segments side by side are alike, so a run of m of them gives m + 1 lists, and an
    endpoint the product over its runs.
    """
    segments = [("{}?" if s.endswith("?}") else "{}") if "{" in s else s for s in pattern.lower().split("/") if s]
    choices = []
    for optional, run in itertools.groupby(segments, lambda s: s == "{}?"):
        run = tuple(run)
        choices.append([("{}",) * k for k in range(len(run), -1, -1)] if optional else [run])
    lists = (tuple(x for part in c for x in part) for c in itertools.product(*choices))
    return [list(x) for x in dict.fromkeys(lists)]


def all_forms(segments: Column | str) -> Column:
    """Every segment list that a pattern stands for: each {}? present as {} or absent, equal lists once."""
    add = lambda lists, s: F.transform(lists, lambda v: F.array_append(v, s))
    grow = lambda acc, s: F.when(s == "{}?", F.array_distinct(F.concat(add(acc, F.lit("{}")), acc))).otherwise(add(acc, s))
    return F.aggregate(segments, F.array(F.array().cast("array<string>")), grow)


def pattern_segments(pattern: Column | str) -> Column:
    """Lower-cased segments without empty ones; {} for a parameter, {}? for an optional one."""
    hole = lambda s: F.when(s.contains("{") & s.endswith("?}"), "{}?").when(s.contains("{"), "{}").otherwise(s)
    return F.transform(F.filter(F.split(F.lower(pattern), "/"), lambda s: s != ""), hole)


def call_segments(url: Column | str) -> Column:
    """Lower-cased segments of a call: scheme and host cut, a leading `*x` read as `*` and `x`."""
    path = F.regexp_replace(F.lower(url), "^https?://[^/]*", "")
    return F.filter(F.split(F.regexp_replace(path, r"^\*(?=[^/])", "*/"), "/"), lambda s: s != "")


def match(calls: DataFrame, endpoints: DataFrame | list[tuple[str, str, str]]) -> DataFrame:
    """call_id, endpoint, literal_hits, how: the best endpoints (endpoint, verb, pattern) of each call (call_id, verb, segs).

    A call meets an endpoint of as many segments, each equal or {} on either side, * in the endpoint or in
    the call's segment, with the same verb or ANY on either side; a leading * stands for any base path, or
    none. Only the hits with most literal, then most parameter, segments stay; none without a literal one.
    A hit shares a literal at some place from the end, so candidates come from an equality join on
    (place, literal) and any number of endpoints is one plan.
    """
    if isinstance(endpoints, list):
        forms = [(name, verb, i, form) for name, verb, pattern in endpoints for i, form in enumerate(variants(pattern))]
        form = calls.sparkSession.createDataFrame(forms, "endpoint string, _ev string, _form int, _v array<string>")
    else:
        form = endpoints.select("endpoint", F.col("verb").alias("_ev"), F.posexplode(all_forms(pattern_segments("pattern"))).alias("_form", "_v"))
    starred = (F.get("segs", F.lit(0)) == "*") & (F.size("segs") > 1)
    call = calls.select("call_id", F.col("verb").alias("_cv"), starred.alias("_star"), F.when(starred, F.slice("segs", F.lit(2), F.size("segs"))).otherwise(F.col("segs")).alias("_b"))
    literal = lambda s: ~s.contains("{") & ~s.contains("*")

    def keyed(df: DataFrame, segs: str) -> DataFrame:
        """A row per literal segment with its place from the end."""
        placed = F.transform(F.reverse(segs), lambda s, i: F.struct(i.alias("_place"), s.alias("_literal")))
        return df.withColumn("_k", F.explode(F.filter(placed, lambda x: literal(x["_literal"])))).select("*", "_k.*").drop("_k")

    long_enough = (F.size("_b") == F.size("_v")) | (F.col("_star") & (F.size("_b") < F.size("_v")))
    verbs = (F.col("_ev") == F.col("_cv")) | (F.col("_ev") == "ANY") | (F.col("_cv") == "ANY")
    near = keyed(call, "_b").join(keyed(form, "_v"), ["_place", "_literal"]).filter(long_enough & verbs).dropDuplicates(["call_id", "_cv", "endpoint", "_form"])
    tail = F.slice("_v", F.size("_v") - F.size("_b") + 1, F.size("_b"))
    meets = F.forall(F.zip_with("_b", tail, lambda c, e: (c == e) | (c == "{}") | (e == "{}") | (e == "*") | c.contains("*")), lambda x: x)
    count = lambda test: F.size(F.filter(F.zip_with("_b", tail, test), lambda x: x)).cast("long")
    scored = near.filter(meets).select("call_id", "endpoint", F.struct(count(lambda c, e: (c == e) & literal(c)).alias("l"), count(lambda c, e: (c == "{}") & (e == "{}")).alias("p")).alias("s"))
    found = scored.groupBy("call_id", "endpoint").agg(F.max("s").alias("s")).filter("s.l > 0")
    w = Window.partitionBy("call_id")
    best = found.withColumn("m", F.max("s").over(w)).filter("s = m")
    return best.select("call_id", "endpoint", F.col("s.l").alias("literal_hits"), F.when(F.count(F.lit(1)).over(w) == 1, "exact").otherwise("ambiguous").alias("how"))


#: The verbs a documented route may start with.
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


def route_parts(df: DataFrame, route: str) -> DataFrame:
    """df with verb (null for none or ANY) and segs: lower-cased, {} for a parameter, {}? for an optional one, no query."""
    text = F.trim(route)
    first = F.upper(F.substring_index(text, " ", 1))
    spoken = text.contains(" ") & first.isin(*VERBS, "ANY")
    rest = F.lower(F.regexp_extract(F.when(spoken, F.trim(F.regexp_replace(text, r"^\S+", ""))).otherwise(text), r"^([^?]*(?:\?\}[^?]*)*)", 1))
    segment = lambda s: F.when(s.contains("{") & s.endswith("?}"), "{}?").when(s.contains("{") | s.startswith(":"), "{}").otherwise(s)
    segs = F.transform(F.filter(F.split(rest, "/"), lambda s: (s != "") & (s != "~")), segment)
    return df.withColumn("verb", F.when(spoken & (first != "ANY"), first)).withColumn("segs", segs)


def same_endpoints(endpoints: DataFrame, documented: DataFrame) -> DataFrame:
    """endpoint, fact: documented routes (fact, route) that are an endpoint's (endpoint, route).

    An optional segment may be there or not, an endpoint's parameter takes any one segment, verbs agree where
    both have one. Optional segments are expanded by a fold over the segments, and the join is on the
    number of segments and the first literal one, the rest a residual.
    """
    code = route_parts(endpoints, "route").select("endpoint", F.col("verb").alias("_cv"), F.explode(all_forms("segs")).alias("_c"))
    head = F.when(F.get("_c", F.lit(0)) == "{}", F.lit(None)).otherwise(F.get("_c", F.lit(0)))
    code = code.withColumns({"_n": F.size("_c"), "_h": head})
    fact = route_parts(documented, "route").select("fact", F.col("verb").alias("_fv"), F.transform("segs", lambda s: F.when(s == "{}?", "{}").otherwise(s)).alias("_f"))
    fact = fact.withColumns({"_n": F.size("_f"), "_h": F.get("_f", F.lit(0))})
    same = F.forall(F.zip_with("_c", "_f", lambda c, f: (c == "{}") | (c == f)), lambda x: x) & (F.col("_cv").isNull() | F.col("_fv").isNull() | (F.col("_cv") == F.col("_fv")))
    by_head = code.filter("_h IS NOT NULL").join(fact, ["_n", "_h"])
    by_size = code.filter("_h IS NULL").drop("_h").join(fact.drop("_h"), "_n")
    pairs = lambda df: df.filter(same).select("endpoint", "fact")
    return pairs(by_head).unionByName(pairs(by_size)).distinct()


def fold_urls(parts: DataFrame) -> DataFrame:
    """owner, url: url expressions folded to patterns, from parts (owner, ord, kind, value).

    kind is `literal`, `param` ({}), `unknown` (*), or `name`, which stands for the url of the owner
    called value. Owners are settled in rounds, those first whose names all are; owners that wait for
    each other, or for a name nobody has, read as * there.
    """
    from terrace.session import cut

    own = F.when(F.col("kind") == "literal", F.col("value")).when(F.col("kind") == "param", "{}").when(F.col("kind") == "unknown", "*")
    rows = cut(parts.select("owner", "ord", "value", own.alias("text")))
    known = rows.select(F.col("owner").alias("value")).distinct()
    lost = rows.filter("text IS NULL").join(known, "value", "left_anti").select("owner", "ord").withColumn("_lost", F.lit("*"))
    rows = rows.join(lost, ["owner", "ord"], "left").select("owner", "ord", "value", F.coalesce("text", "_lost").alias("text"))
    whole = lambda df: df.groupBy("owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("url"))
    done = None
    while True:
        open_ = rows.filter("text IS NULL").select("owner").distinct()
        settled = cut(whole(rows.join(open_, "owner", "left_anti")))
        done = settled if done is None else cut(done.unionByName(settled))
        if settled.isEmpty() or open_.isEmpty():
            break
        urls = settled.select(F.col("owner").alias("value"), "url")
        rows = rows.join(open_, "owner").join(urls, "value", "left").select("owner", "ord", "value", F.coalesce("text", "url").alias("text"))
        rows = cut(rows)
    stuck = rows.join(done.select("owner"), "owner", "left_anti").withColumn("text", F.coalesce("text", F.lit("*")))
    return done.unionByName(whole(stuck))


def derive_endpoints(classes: DataFrame, actions: DataFrame) -> DataFrame:
    """cls, action, verb, route: what each concrete class serves by attribute.

    classes (cls, base, route, abstract): a class without a route takes its nearest base's. actions
    (owner, action, verb, template) are served by their owner and by every class below it. `[controller]`
    is the class name without Controller, lower-cased; a template from the root replaces the class route.
    """
    from terrace.operators.graph import fixpoint

    up = classes.select(F.col("cls").alias("_m"), F.col("base").alias("_b")).filter("_b IS NOT NULL")
    seed = classes.select("cls", F.col("cls").alias("anc"), F.lit(0).alias("d"))
    step = lambda new: new.join(up, F.col("anc") == F.col("_m")).select("cls", F.col("_b").alias("anc"), (F.col("d") + 1).alias("d"))
    line = fixpoint(seed, step, ["cls", "anc"])
    routed = classes.filter("route IS NOT NULL").select(F.col("cls").alias("anc"), F.col("route").alias("_r"))
    nearest = line.join(routed, "anc").groupBy("cls").agg(F.min_by("_r", "d").alias("_route"))
    serving = line.join(classes.filter("NOT abstract").select("cls"), "cls", "left_semi").join(actions.withColumnRenamed("owner", "anc"), "anc").join(nearest, "cls", "left")
    name = F.lower(F.regexp_replace("cls", "Controller$", ""))
    rooted = F.col("template").startswith("/") | F.col("template").startswith("~/")
    text = F.when(rooted, F.regexp_replace("template", "^~?/", "")).otherwise(F.concat_ws("/", F.col("_route"), F.when(F.col("template") != "", F.col("template"))))
    return serving.select("cls", "action", "verb", F.lower(F.replace(F.lower(text), F.lit("[controller]"), name)).alias("route"))
