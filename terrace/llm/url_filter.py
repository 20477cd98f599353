"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

The main path is DataFrame expressions and the JVM's tree learner: no Python on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.session import cut

#: The rules of the production query, verdict and host/path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class UrlParams:
    """rules: up to few_rules of them become one expression, more are joined by host. folds: a labelled
    row's suffix statistics come from the hosts of the other folds. prior_rows: weight of the overall
    share in them. sample_rows: bound of the labelled rows that the trees are fitted on, taken by
    hash of the URL."""

    rules: tuple[tuple[str, str], ...] = RULES
    few_rules: int = 100
    folds: int = 5
    prior_rows: int = 10
    sample_rows: int = 20_000
    trees: int = 12
    depth: int = 4
    seed: int = 7


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where :// is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule (host then path) whose host is the host or a parent domain and whose path starts the path."""
    picks = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        under = (host == h) | host.endswith(f".{h}")
        picks.append(F.when(under & path.startswith(slash + p), F.lit(rule)))
    return F.coalesce(*picks, F.lit(None).cast("string"))


def with_rules(d: DataFrame, rules: tuple[tuple[str, str], ...], few: int) -> DataFrame:
    """d with rule and _says (its verdict): the longest rule that fits host and path, else nulls."""
    if len(rules) <= few:
        d = d.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
        says = F.lit(None).cast("string")
        for verdict, rule in rules:
            says = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(says)
        return d.withColumn("_says", says)
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for v, r in rules]
    table = d.sparkSession.createDataFrame(rows, "_domain string, _start string, _rule string, _verdict string")
    # rules are as many as the caller lists; hosts meet theirs by their parent domains, paths only within a host's rules
    above = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    parents = d.select("host").distinct().withColumn("_domain", F.explode(above))
    fits = parents.join(table, "_domain").select(F.col("host").alias("_host"), F.struct(F.length("_rule").alias("n"), F.col("_rule").alias("rule"), F.col("_verdict").alias("says"), F.col("_start").alias("start")).alias("_fit"))
    pages = d.select("host", "path").distinct()
    best = pages.join(fits, F.col("host") == F.col("_host")).filter(F.startswith("path", F.col("_fit.start"))).groupBy(F.col("host").alias("_h1"), F.col("path").alias("_p1")).agg(F.max("_fit").alias("_best"))
    return d.join(best, (F.col("host") == F.col("_h1")) & (F.col("path") == F.col("_p1")), "left").withColumn("rule", F.col("_best.rule")).withColumn("_says", F.col("_best.says")).drop("_h1", "_p1", "_best")


def _entropy(s: Column) -> Column:
    """Shannon entropy in bits of the characters of s."""
    n = F.char_length(s)
    share = lambda c: (n - F.char_length(F.replace(s, c, F.lit("")))) / F.greatest(n, F.lit(1))
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(pages: DataFrame, *carry: str) -> DataFrame:
    """page_id, carried columns, host, path, suffixes and the lexical features of each url."""
    url = F.coalesce("url", F.lit(""))
    host, path = parts(F.col("url"))
    d = pages.select("page_id", *carry, url.alias("_u"), host.alias("host"), path.alias("path"))
    n = F.char_length("_u")
    kept = lambda pattern: F.char_length(F.regexp_replace("_u", pattern, ""))
    query = F.regexp_extract("_u", r"(?s)^[^?#]*\?([^#]*)", 1)
    return d.select(
        "page_id", *carry, "host", "path",
        _suffix(F.col("host"), 1).alias("_s1"), _suffix(F.col("host"), 2).alias("_s2"),
        F.regexp_extract("path", r"^/[^/]*", 0).alias("_head"),
        F.xxhash64("_u").alias("_h"),
        n.cast("double").alias("x_length"),
        F.char_length("host").cast("double").alias("x_host_length"),
        (F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("x_depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("x_labels"),
        (kept("[^0-9]") / F.greatest(n, F.lit(1))).alias("x_digits"),
        (kept(r"[\p{L}\p{N}]") / F.greatest(n, F.lit(1))).alias("x_marks"),
        _entropy(F.col("_u")).alias("x_entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("x_params"),
    )


FEATURES = ("x_length", "x_host_length", "x_depth", "x_labels", "x_digits", "x_marks", "x_entropy", "x_params")
SUFFIXES = ("_s1", "_s2", "_head")


def suffix_rates(d: DataFrame, key: str, prior: float, p: UrlParams) -> DataFrame:
    """d with x<key>: the smoothed share of block among the labelled rows of the key.

    A labelled row (label not null) reads the share without the hosts of its own fold, so the
    trees never see a row's own answer; the others read the share over all.
    """
    fold = F.pmod(F.xxhash64("host"), F.lit(p.folds))
    of = F.struct(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
    by_fold = d.filter(F.col("label").isNotNull()).groupBy(F.col(key).alias("_key"), fold.alias("_fold")).agg(of.alias("_of"))
    rates = by_fold.groupBy("_key").agg(F.sum("_of.s").alias("_s"), F.sum("_of.n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_fold", "_of"))).alias("_by"))  # at most one entry a fold
    rates = cut(rates)
    rates = F.broadcast(rates) if rates.count() <= 100_000 else rates
    own = F.when(F.col("label").isNotNull(), F.col("_by")[fold])
    s = F.coalesce("_s", F.lit(0.0)) - F.coalesce(own["s"], F.lit(0.0))
    n = F.coalesce("_n", F.lit(0)) - F.coalesce(own["n"], F.lit(0))
    return d.join(rates, F.col(key) == F.col("_key"), "left").withColumn(f"x{key}", (s + p.prior_rows * prior) / (n + p.prior_rows)).drop("_key", "_s", "_n", "_by")


def judge(pages: DataFrame, params: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict and score (estimated chance of block), a row per input row.

    The URLs that a rule settles are the labelled ones. Suffix statistics (smoothed share of
    block per last label, last two labels and first path segment) come from all of them, for a
    labelled row from the hosts of other folds; the trees are fitted on at most about sample_rows. Where the labels show one verdict only,
    that verdict holds for the rest; where there are none, allow does. An empty table gives no
    rows; a null url has empty host and path and is judged by the trees.
    """
    d = cut(with_rules(lexical(pages), params.rules, params.few_rules))
    labelled = d.filter(F.col("_says").isNotNull()).withColumn("label", (F.col("_says") == "block").cast("double"))
    seen = labelled.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, blocked = int(seen[0]), float(seen[1] or 0.0)
    columns = ("page_id", "host", "path", "rule")
    if n == 0 or blocked in (0.0, float(n)):
        other, score = ("allow", 0.0) if blocked == 0.0 else ("block", 1.0)
        return d.select(*columns, F.coalesce("_says", F.lit(other)).alias("verdict"), F.lit(score).alias("score"))
    prior = blocked / n
    d = d.withColumn("label", (F.col("_says") == "block").cast("double"))
    for key in SUFFIXES:
        d = suffix_rates(d, key, prior, params)
    d = cut(VectorAssembler(inputCols=[*FEATURES, *(f"x{k}" for k in SUFFIXES)], outputCol="_v").transform(d).select(*columns, "_says", "_h", "label", "_v"))
    train = d.filter(F.col("label").isNotNull())
    if n > params.sample_rows:
        train = train.filter(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * params.sample_rows / n))
    one = train.agg(F.countDistinct("label")).first()[0] < 2
    trees = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=params.trees, maxDepth=params.depth, seed=params.seed, predictionCol="_p")
    model = trees.fit((d.filter(F.col("label").isNotNull()) if one else train).select("_v", "label").repartition(4, "_v").sortWithinPartitions("label"))
    out = model.transform(d)
    return out.select(
        *columns, F.coalesce("_says", F.when(F.col("_p") == 1.0, "block").otherwise("allow")).alias("verdict"), vector_to_array("probability")[1].alias("score")
    )
