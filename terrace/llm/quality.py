"""Quality rules with thresholds that adapt to each language and source.

Everything here is a DataFrame expression: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.session import cut, stored

#: What separates words, and what counts as a symbol.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    """min_words, max_repeat_percent: the fixed base rules. limits: ratio, quantile, spread; a ratio may lie
    spread times as far above its group's median as that quantile does. step: limits are rounded
    up to it, and lie between one step and one step below 1. least_group: smaller groups of language and
    source take the language's merged sketch, smaller languages the merged sketch of all.
    sketch_k: size of a KLL sketch."""

    min_words: int = 50
    max_repeat_percent: int = 50
    limits: tuple[tuple[str, float, float], ...] = (
        ("noise", 0.75, 8.0), ("upper", 0.75, 12.0), ("dup_lines", 0.99, 2.0), ("repeats", 0.95, 6.0),
    )
    step: float = 0.01
    least_group: int = 200
    sketch_k: int = 2048

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_noise", "n_upper", "n_repeat_words")


def _removed(text: Column, chars: str) -> Column:
    """Code points of text that are not among chars."""
    return F.char_length(F.translate(text, chars, ""))


def features(docs: DataFrame, *carry: str) -> DataFrame:
    """One row per input row: doc_id, the carried columns and the counts of the base rules.

    A word is a run without space characters, a null text has none. n_repeat_words counts the
    words that lie in a three-word window found twice or more in the text. Windows are first
    compared by hash, the hash and the position packed into one long so that sorting stays
    on primitives; windows that agree by hash are then compared word by word, so the count
    is exact.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", *carry, text.alias("_t"), F.btrim(text, F.lit(SPACE)).alias("_b"))
    d = d.select(
        "doc_id", *carry, "_t",
        F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", SPACES)).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_l"),
    )
    d = d.select(
        "doc_id", *carry, "_w",
        F.size("_w").cast("long").alias("n_words"),
        _removed(F.col("_t"), SPACE).cast("long").alias("word_chars"),
        (F.char_length("_t") - _removed(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.char_length(F.regexp_replace("_t", r"[\p{L}\p{N}\s.,;:'’()\-]+", "")).cast("long").alias("n_noise"),
        F.char_length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.greatest(F.lit(1), F.ceil(F.log2(F.size("_w") + F.lit(1.0)))).cast("int").alias("_bits"),
    )
    d = d.withColumn(
        "_s",
        F.expr("""CASE WHEN n_words < 4 THEN array() ELSE sort_array(transform(sequence(0L, n_words - 3),
            i -> shiftleft(xxhash64(_w[int(i)], _w[int(i) + 1], _w[int(i) + 2]), _bits) | i)) END"""),
    )
    d = d.withColumn(
        "_p",
        F.expr("""transform(filter(_s, (x, i) -> (i > 0 AND shiftright(get(_s, i - 1), _bits) = shiftright(x, _bits))
            OR (i + 1 < size(_s) AND shiftright(get(_s, i + 1), _bits) = shiftright(x, _bits))),
            x -> int(x & (shiftleft(1L, _bits) - 1)))"""),
    )
    d = d.withColumn(
        "_g", F.expr("sort_array(transform(_p, i -> struct(_w[i] AS a, _w[i + 1] AS b, _w[i + 2] AS c, i AS at)))")
    )
    same = "get(_g, {0}).a = x.a AND get(_g, {0}).b = x.b AND get(_g, {0}).c = x.c"
    d = d.withColumn(
        "n_repeat_words",
        F.expr(f"""bigint(size(array_distinct(flatten(transform(filter(_g, (x, i) ->
            (i > 0 AND {same.format("i - 1")}) OR (i + 1 < size(_g) AND {same.format("i + 1")})),
            x -> array(x.at, x.at + 1, x.at + 2))))))"""),
    )
    # The generator is a fence: predicates on the counts stay above it, else the optimizer would
    # repeat the array expressions inside every filter that reads a count.
    counts = F.struct(*(F.col(c) for c in COUNTS))
    return d.select("doc_id", *carry, F.explode(F.array(counts)).alias("_f")).select("doc_id", *carry, *(F.col(f"_f.{c}").alias(c) for c in COUNTS))


def _ratios() -> dict[str, Column]:
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return {
        "noise": share("n_noise", "word_chars"),
        "upper": share("n_upper", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }


def thresholds(feats: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """lang, source, and for each ratio its largest accepted value t_<ratio>.

    A KLL sketch per language and source is built map-side and merged; the same sketches are
    merged again by language and over all, for groups too small to stand alone. A limit is
    median + spread * (quantile - median), rounded up to a step; no fixed value but the step bounds it.
    """
    names = [n for n, _, _ in p.limits]
    by_group = feats.filter(~F.col("base_failed")).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("_n"), *(F.kll_sketch_agg_double(_ratios()[n], p.sketch_k).alias(n) for n in names)
    )
    by_group = cut(by_group)
    merged = lambda *keys: by_group.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), *(F.kll_merge_agg_double(n, p.sketch_k).alias(n) for n in names)
    )
    by_lang = merged("lang").select(F.col("lang").alias("_lang"), F.col("_n").alias("_nl"), *(F.col(n).alias(f"_l_{n}") for n in names))
    over_all = merged(F.lit(1).alias("_one")).select("_one", *(F.col(n).alias(f"_a_{n}") for n in names))
    joined = by_group.withColumn("_one", F.lit(1)).join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(over_all, "_one", "left")

    def limit(n: str, high: float, spread: float) -> Column:
        pick = F.when(F.col("_n") >= p.least_group, F.col(n)).when(F.col("_nl") >= p.least_group, F.col(f"_l_{n}")).otherwise(F.col(f"_a_{n}"))
        at = lambda q: F.kll_sketch_get_quantile_double(pick, F.lit(q))
        steps = F.ceil((at(0.5) + spread * (at(high) - at(0.5))) / p.step - 1e-9)
        return F.greatest(F.lit(p.step), F.least(F.lit(1 - p.step), steps * p.step)).alias(f"t_{n}")

    return joined.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(limit(*x) for x in p.limits))


def judge(docs: DataFrame, *carry: str, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, lang, source, carried columns, the counts, base_failed and kept, a row per input row.

    The counts are made once and cut, as the limits and the verdicts both read them. Null
    lang or source forms a group of its own. An empty table gives no rows. Repeated rows are
    judged alike. Only doc_id, text, lang, source and the carried columns are read, so other
    columns may have any name.
    """
    carry = tuple(dict.fromkeys(("lang", "source", *carry)))
    feats = cut(_based(docs, carry, params))
    return _verdict(feats, thresholds(feats, params), params)


def kept_rows(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns.

    The counts are made once and stored beside the row: the limits read only the counts, the
    verdict joins them back, shipped while they are few, so no text is shuffled. The row travels as
    one struct, so its columns may have any names.
    """
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("_row"))
    counted = stored(_based(rows, ("lang", "source", "_row"), params))
    limits = cut(thresholds(counted, params))
    if limits.count() <= 100_000:
        limits = F.broadcast(limits)
    kept = _verdict(counted, limits, params).filter("kept")
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def _based(docs: DataFrame, carry, params: QualityParams) -> DataFrame:
    few = F.col("n_words") < params.min_words
    return features(docs, *carry).withColumn("base_failed", few | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words")))


def _verdict(feats: DataFrame, limits: DataFrame, params: QualityParams) -> DataFrame:
    out = feats.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fine = ~F.col("base_failed")
    for n, _, _ in params.limits:
        fine = fine & (_ratios()[n] <= F.coalesce(F.col(f"t_{n}"), F.lit(float("inf"))))
    return out.withColumn("kept", fine).drop("_lang", "_source", *(f"t_{n}" for n, _, _ in params.limits))
