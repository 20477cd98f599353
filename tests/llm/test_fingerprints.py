import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint int, bucket string"


def words(n, seed):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 100003}" for i in range(n))


def test_edit_probe_equals_brute_force(spark):
    texts = {i: words(20 + 13 * (i % 9), i) for i in range(40)} | {50: None, 51: "", 52: "ab", 53: "é😀" * 3, 54: words(4000, 3), -3: "x"}
    rows = [(i, t, 1, "b") for i, t in texts.items()] + [(None, "null id", 1, "b")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in fp.edit_probe(df, fp.SketchParams(bucket_rows=6)).collect()}
    assert len(got) == len(rows)
    order = sorted(texts, reverse=True) + [None]
    every = texts | {None: "null id"}
    for at, i in enumerate(order):
        text, after = every[i] or "", every[order[(at + 1) % len(order)]] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.sketch(text).text() and r["edited_fingerprint"] == fp.sketch(edited).text()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert got[54]["near_edited"] > 0.35 > 0.05 > got[54]["near_next"]


def test_single_row_and_empty_table(spark):
    one = fp.edit_probe(spark.createDataFrame([(1, "abcdef", 0, "")], SCHEMA)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert fp.edit_probe(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_are_chained(spark):
    rows = fp.edit_probe(spark.createDataFrame([(1, "aaaaaa", 0, ""), (1, "aaaaaa", 0, ""), (2, "bbbbbb", 0, "")], SCHEMA)).collect()
    assert sorted(r["edited_sha256"] for r in rows) == sorted(hashlib.sha256(x).hexdigest() for x in (b"bbbbaa", b"aaaaaa", b"aaaabb"))


def test_containment_between_unequal_documents():
    small, large = words(300, 1), words(300, 1) + " " + words(6000, 2)
    _, inside, outside = fp.compare(fp.sketch(small), fp.sketch(large))
    assert inside > 0.9 and outside < 0.15


@given(st.text(max_size=400), st.text(max_size=400))
@settings(max_examples=80, deadline=None)
def test_sketches_merge_and_survive_text(a, b):
    x, y = fp.sketch(a), fp.sketch(b)
    assert fp.Sketch.of(x.text()).text() == x.text()
    m = fp.merge(x, y)
    assert set(m.hashes.tolist()) == {h for h in (*x.hashes.tolist(), *y.hashes.tolist()) if h <= m.bound}
    assert fp.compare(x, x)[0] == pytest.approx(1.0)


def test_every_hash_below_the_fraction_is_kept():
    p = fp.SketchParams(least=4)
    s = fp.sketch(words(3000, 5), p)
    assert s.bound == int(fp._ALL) // p.scale and len(s.hashes) > 100


def _exact(a, b):
    """Jaccard similarity of the sets of 16-character shingles; a shorter text is its own shingle."""
    sets = [{t[i : i + 16] for i in range(len(t) - 15)} if len(t) >= 16 else {t} if t else set() for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_likeness_is_exact_for_short_texts_and_near_for_long_ones():
    off = []
    for seed in range(60):
        a, b = words(4 + seed % 5, seed)[:63], words(4 + seed % 7, seed)[:60]
        assert fp.compare(fp.sketch(a), fp.sketch(b))[0] == pytest.approx(_exact(a, b))
        long = words(2000, seed)
        third = len(long) // 3
        edited = long[: len(long) - third] + words(2000, seed + 500)[:third]
        off.append(fp.compare(fp.sketch(long), fp.sketch(edited))[0] - _exact(long, edited))
    assert (sum(x * x for x in off) / len(off)) ** 0.5 < 0.08 and abs(sum(off) / len(off)) < 0.03
