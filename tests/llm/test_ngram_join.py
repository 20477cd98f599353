import random
import re

import numpy as np
import pytest

from terrace.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, n int, rep string"


def brute(rows):
    """doc_id -> (size, component) by comparing all pairs of shingle sets."""
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {d: (len(s), top(d)) for d, s in sets.items()}


def corpus(seed, families=4, copies=24, singles=30):
    dice = random.Random(seed)
    word = lambda: f"w{dice.randrange(4000)}"
    rows, n = [], 0
    license_line = " ".join(f"lic{i}" for i in range(40))
    for f in range(families):
        base = [word() for _ in range(dice.choice([15, 40, 90, 300, 700]))]
        for c in range(copies):
            w, rate = list(base), c * 0.0045
            for i in range(len(w)):
                if dice.random() < rate:
                    w[i] = word()
            if c % 5 == 0:
                del w[: c // 4]
            rows.append((n, " ".join(w).upper() if c % 7 == 3 else "\n".join(w)))
            n += 1
    for s in range(singles):
        rows.append((n, " ".join([word() for _ in range(dice.randrange(0, 60))]) + (" " + license_line if s % 2 else "")))
        n += 1
    for text in (None, "", " \n ", "one two", "ONE  two", "one two three four five", license_line, license_line + " x"):
        rows.append((n, text))
        n += 1
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 12), (2, 2), (3, 3), (4, 2)])
def test_components_equal_brute_force(spark, seed, hot):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.components(df, nj.JoinParams(hot=hot, batch_signatures=900, bucket_signatures=2000)).collect()}
    assert got == brute(rows)


def test_families_over_many_blocks(spark):
    """Families of edited copies whose members are dealt to several blocks, with chains that lead away from the leader."""
    rows = corpus(9, families=3, copies=30)
    base = [f"z{i}" for i in range(400)]
    rows += [(len(rows) + i, " ".join(base[3 * i : 3 * i + 150])) for i in range(80)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.components(df, nj.JoinParams(hot=2, block_sets=7)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 12, 13, 40, 200, 600, 1500])
def test_linked_sets_share_what_their_differences_leave(n):
    """A pair at the edge of 3/4 shares at least t - changed(K) of t signatures, in the band of the larger."""
    dice, p = np.random.default_rng(n), nj.JoinParams()
    for _ in range(20):
        a = np.unique(dice.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        while True:
            x = np.delete(b, dice.integers(len(b))) if dice.random() < 0.5 and len(b) > 1 else np.unique(np.r_[b, dice.integers(0, 2**63, 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
            common = len(np.intersect1d(a, x))
            if 100 * common < 75 * (len(a) + len(x) - common):
                break
            b = x
        level = nj.band(max(len(a), len(b)))
        assert level in nj.bands(len(a)) and level in nj.bands(len(b))
        lost = nj.changed((len(a) + len(b)) // 7, nj.partitions_of(level, p))
        x, y = nj.signatures(a, level), nj.signatures(b, level)
        assert len(np.intersect1d(x, y)) >= max(len(x), len(y)) - lost


def test_signatures_are_fewer_than_subsets_and_name_their_band():
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    for level in (10, 11):
        got = nj.signatures(s, level)
        assert len(got) <= 3 * nj.partitions_of(level, nj.JoinParams()) and set((got & np.uint64(1)).tolist()) == {level & 1}
    assert len(nj.signatures(s, 10)) < 1.1 * len(s)


def test_block_links_equal_pairwise():
    dice = np.random.default_rng(3)
    base = dice.integers(0, 2**62, 300)
    sets = [np.unique(np.r_[dice.choice(base, 300 - int(dice.integers(0, 90)), replace=False), dice.integers(0, 2**62, int(dice.integers(0, 40)))]) for _ in range(40)]
    label = list(range(40))
    for i in range(40):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert nj.linked(sets).tolist() == label


def test_blobs_round_trip():
    ids, sizes, counts = np.array([-5, 3, 9]), np.array([4, 70_000, 1]), np.array([2, 0, 1])
    sig = np.array([1, 2**32 - 1, 77], np.uint64)
    doc, size, back = nj._unpack(nj._pack(ids, sizes, counts, sig))
    assert doc.tolist() == [-5, -5, 9] and size.tolist() == [4, 4, 1] and back.tolist() == sig.tolist()


def test_edge_rows(spark):
    text = "a b c d e f g"
    rows = [(1, text, 0, ""), (1, text, 0, ""), (None, text, 0, ""), (2, text, 0, ""), (3, None, 0, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, None), (2, 3, 1), (3, 0, 3)], key=str)
    assert nj.components(spark.createDataFrame([], SCHEMA)).count() == 0
