import re
from collections import Counter

import pytest

from terrace.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"
WORDS = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORDS, text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    at = {p for i, x in enumerate(windows) if x in twice for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORDS, x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)


CASES = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "a b c a b c", "x y z\nx y z\n\n \nx y z ", "é# $%&|<> *\n" * 30, "w " * 5000, " ".join(f"t{i}" for i in range(20_000)), "a\x0bb\x0cc\rd \xa0 e", "one two three four " * 40, "😀 b c 😀 b c"]


def test_counts_equal_brute_force(spark):
    rows = [(i, t, "en", None if i % 2 else "s", "x") for i, t in enumerate(CASES)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(CASES)
    for r in got:
        want = brute(CASES[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, CASES[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])


def clean(i):
    return "\n".join(" ".join(f"word{(i * 31 + j * 17 + k * 7) % 997}" for k in range(12)) + "." for j in range(8))


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, clean(i), "en", f"s{i % 3}", "") for i in range(300)]
    rows += [(1000 + i, re.sub(r" ", "### ", clean(i)), "en", f"s{i % 3}", "") for i in range(30)]
    rows += [(2000 + i, clean(i).upper(), "en", None, "") for i in range(30)]
    return rows, {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_junk_goes_and_clean_stays(judged):
    _, kept = judged
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(30))


def test_thresholds_adapt_to_the_group(spark):
    loud = [(i, clean(i).upper(), "en", "loud", "") for i in range(300)]
    calm = [(1000 + i, clean(i), "en", "calm", "") for i in range(300)]
    odd = [(5000, clean(1).upper(), "en", "calm", "")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(loud + calm + odd, SCHEMA)).collect()}
    assert kept[0] and kept[1000] and not kept[5000]


def test_group_quantiles_set_the_limits(spark):
    """Nothing fixed lets an outlier of its group through, and no group's limit reaches 1."""
    noisy = lambda i, n: clean(i) + "§" * n
    calm = [(i, noisy(i, 0), "en", "calm", "") for i in range(300)]
    loud = [(1000 + i, noisy(i, i % 60), "en", "loud", "") for i in range(300)]
    odd = [(5000, noisy(1, 25), "en", "calm", ""), (5001, noisy(1, 25), "en", "loud", "")]
    docs = spark.createDataFrame(calm + loud + odd, SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert all(kept[i] for i in range(300)) and not kept[5000] and kept[5001]
    p = quality.QualityParams()
    limits = {r["_source"]: r for r in quality.thresholds(quality._based(docs, ("lang", "source"), p), p).collect()}
    assert limits["calm"]["t_noise"] < limits["loud"]["t_noise"] and all(r[f"t_{n}"] < 1 for r in limits.values() for n, _, _ in p.limits)


def test_kept_rows_agree_with_judge(spark, judged):
    rows, kept = judged
    got = quality.kept_rows(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_words"]
    assert {r["doc_id"] for r in got.collect()} == {d for d, k in kept.items() if k}


def test_empty_and_repeated(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality.kept_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(1, clean(3), None, None, "")] * 3
    assert {r["kept"] for r in quality.judge(spark.createDataFrame(same, SCHEMA)).collect()} == {True}
