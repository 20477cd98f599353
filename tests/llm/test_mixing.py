from collections import defaultdict

from terrace.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def filled(sizes, weights, cap):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, left = sum(sizes.values()), {}, set(names)
    while True:
        level = (total - sum(full.values())) / sum(w[s] for s in left) if left else 0
        over = {s for s in left if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: full.get(s, level * w[s]) for s in names}
        full |= {s: cap * sizes[s] for s in over}
        left -= over


def rows(n=600):
    out = []
    for i in range(n):
        source = None if i % 11 == 0 else ("a" if i % 3 == 0 else f"s{i % 5}")
        words = 7 if source == "a" else 1 + (i * 37) % 60
        out.append((i, " ".join(["w"] * words), source, "x"))
    return out + [(9001, None, "a", "x"), (9002, "\n \t", "s1", "x"), (1, out[1][1], out[1][2], "x"), (9003, "w", "tiny", "x"), (9004, None, "void", "x")]


def test_mix_reaches_targets(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    p = mixing.MixParams(cell_rows=50)
    got = mixing.mix(df, params=p).collect()
    assert len(got) == len(rows())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = filled(sizes, p.weights, p.cap)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(8, 0.01 * want[s]), (s, taken[s], want[s])
    again = mixing.mix(df.repartition(7), params=p).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in got) == sorted((r["doc_id"], r["size"], r["taken"]) for r in again)


def test_rates_tilt_with_size(spark):
    data = [(i, " ".join(["w"] * (5 if i % 2 else 50)), s, "") for i in range(400) for s in ("a", "b")]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    mean = lambda s, n: sum(r["copies"] for r in got if r["source"] == s and r["size"] == n) / 200
    assert mean("a", 50) > mean("a", 5) > 1 > mean("b", 5) > mean("b", 50)


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, "")], SCHEMA)).first()
    assert (got["size"], got["target"], got["taken"]) == (0, 0.0, 0)
