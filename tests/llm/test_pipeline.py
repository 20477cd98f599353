"""Each stage of the pipeline on its own input against brute force, then the whole run."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as cp  # noqa: E402
from terrace.llm import mixing, quality  # noqa: E402
from test_line_dedup import brute as brute_lines  # noqa: E402
from test_ngram_join import brute as brute_join  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    dice = random.Random(4)
    line = lambda: " ".join(f"w{dice.randrange(3000)}" for _ in range(14))
    shared = [line() for _ in range(4)]
    texts = ["\n".join([line() for _ in range(6)] + ([dice.choice(shared)] if i % 3 else [])) for i in range(90)]
    texts += [t.replace("w1 ", "w2 ") for t in texts[:20]] + texts[:5]
    texts += [t.replace(" ", "### ") for t in texts[20:26]] + ["too short", "", None]
    return [(i, t, "en", None if i % 13 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.createDataFrame(corpus(), SCHEMA), []
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.stored(stage(spark, docs, ""))
        out.append((name, before, docs))
    return out


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in quality.judge(before).filter("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept and set(range(90)) <= kept and not kept & {120, 121, 122}


def test_line_stage(stages):
    _, before, after = stages[1]
    import hashlib

    want = brute_lines({r["doc_id"]: r["text"] for r in before.collect()})
    got = {r["doc_id"]: r for r in after.collect()}
    assert set(got) == set(want)
    for d, r in got.items():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[d][2] and r["n_chars"] == len(r["text"])


def test_join_stage(stages):
    _, before, after = stages[2]
    want = brute_join([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_mix_stage(stages):
    _, before, after = stages[3]
    size = {r["doc_id"]: (len(r["text"].split()), r["source"]) for r in before.collect()}
    copies = Counter(r["doc_id"] for r in after.collect())
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    goal = {r["source"]: r["target"] for r in mixing.mix(before).select("source", "target").distinct().collect()}
    taken = Counter()
    for d, n in copies.items():
        taken[size[d][1]] += size[d][0] * n
    assert set(goal) == {s for _, s in size.values()} and all(abs(taken[s] - t) < 0.03 * t + 60 for s, t in goal.items())


def test_repeated_ids_are_documents_of_their_own(spark):
    """Unrelated texts under one id both stay, their copies and copies of others go; so do the mix's copies."""
    t = [x[1] for x in corpus()[:4]]
    rows = [(7, t[0], "en", "a", 1), (7, t[1], "en", "a", 1), (7, t[1], "en", "b", 1), (3, t[2], "en", "a", 1), (9, t[0], "en", "a", 1), (None, t[3], "en", "a", 1)]
    kept = cp.ngram_jaccard_join(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(7, t[0]), (7, t[1]), (3, t[2]), (None, t[3])])
    docs = spark.createDataFrame([(1, "one two three", "en", "a", 3)] * 4 + [(1, "four five", "en", "b", 3), (2, "six", "en", "c", 1)] + [(i, f"w{i} x", "en", "a", 4) for i in range(40, 60)], SCHEMA).coalesce(1)
    plan = Counter()
    for r in mixing.mix(docs, "text").collect():
        plan[r["doc_id"], r["source"], r["text"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in cp.mix_sources(spark, docs, "").collect()) == +plan


def test_extra_columns_and_clashing_names_stay(spark):
    names = ["_id", "_key", "_k", "_copies", "_n", "_row", "kept", "n_lines", "_text", "_lost", "copies", "_r", "c0"]
    docs = spark.createDataFrame([(*r, *([r[0]] * len(names))) for r in corpus()[:60]] + [(999, "word " * 60_000, "en", "s1", 1, *([999] * len(names)))], SCHEMA + "".join(f", `{n}` long" for n in names))
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns and all(r["c0"] == r["doc_id"] == r["_key"] for r in after.collect())
    assert cp.STAGES[-1][1](spark, docs, "").filter("doc_id = 999").count() > 20


def test_null_ids_get_all_copies_of_the_mix(spark):
    same = [(None, "one two three four five", "en", source, 23) for source in ("a", "b", "c", None) for _ in range(5)]
    docs = spark.createDataFrame(same + [(i, f"w{i} x", "en", "a", 4) for i in range(40)] + [(None, None, "en", "a", 0)], SCHEMA).coalesce(1)
    plan = Counter()
    for r in mixing.mix(docs, "text").collect():
        plan[r["doc_id"], r["source"], r["text"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], r["text"]) for r in cp.mix_sources(spark, docs, "").collect())
    assert got == +plan and any(0 < plan[None, s, same[0][1]] % 5 for s in ("a", "b", "c", None))


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert Counter(r["doc_id"] for r in before.collect()) == Counter(r["doc_id"] for r in after.filter("piece = 0").collect())


def test_repeated_rows_and_empty_table(spark):
    rows = corpus()[:3] * 2 + [(None, corpus()[5][1], "en", "a", 3)]
    kept = cp.ngram_jaccard_join(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([0, 1, 2, None])
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 50
