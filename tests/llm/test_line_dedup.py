import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from terrace.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, kept int, k1 string"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))


def brute(docs, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def corpus(n=80, seed=3):
    dice = random.Random(seed)
    pool = [f"A common line number {i} with Ünïcode é" for i in range(12)] + ["short", "é" * 20, "x" * 19, "  Padded \t line of text here\x0b", "padded \t line of text here"]
    docs = {i: "\n".join(dice.choice(pool) if dice.random() < 0.6 else f"own line {i} {j} padded out to length" for j in range(dice.randrange(0, 9))) for i in range(n)}
    return docs | {900: None, 901: "", 902: "\n\n", 903: "\n".join(["A common line number 1 with Ünïcode é"] * 500), 904: "own " * 50_000}


def result(spark, index, docs):
    rows = index.apply(spark.createDataFrame([(d, t, 0, "") for d, t in docs.items()], SCHEMA)).collect()
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in rows}


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 0, "") for d, t in docs.items()], SCHEMA)


def test_dedup_equals_brute_force(spark):
    docs = corpus()
    assert result(spark, ld.LineIndex.build(frame(spark, docs)), docs) == brute(docs)


def test_filters_too_large_to_ship(spark):
    docs = corpus(30)
    for shard_keys, rows in ((50_000, 10), (3, 4_000_000), (2, 7)):
        p = ld.LineParams(broadcast_bytes=0, shard_keys=shard_keys, dealt_rows=rows)
        assert result(spark, ld.LineIndex.build(frame(spark, docs), p), docs) == brute(docs)


def test_full_filters_are_built_anew(spark):
    few = {i: "\n".join(f"shared line number {j} of the first lot" for j in range(8)) for i in range(4)}
    more = {10 + i: "\n".join(f"shared line number {j} of the second lot" for j in range(900)) for i in range(4)}
    index = ld.LineIndex.build(frame(spark, few), ld.LineParams(shard_keys=100))
    both = index.insert(frame(spark, more))
    filters = [ld.CuckooFilter.load(bytes(r["seats"])) for r in both.filters.collect()]
    assert both.shards == 10 and len(filters) == 10 and not any(f.full for f in filters)
    assert result(spark, both, few | more) == brute(few | more)
    back = both.delete(frame(spark, more))
    assert result(spark, back, few) == brute(few)


def test_insert_and_delete_are_reversible(spark):
    docs = corpus()
    first = {d: t for d, t in docs.items() if d % 2 == 0}
    more = {d: t for d, t in docs.items() if d % 2}
    index = ld.LineIndex.build(frame(spark, first), ld.LineParams(shard_keys=5))
    both = index.insert(frame(spark, more))
    assert result(spark, both, docs) == brute(docs)
    back = both.delete(frame(spark, more))
    assert result(spark, back, first) == brute(first)
    state = lambda i: sorted(tuple(r) for r in i.counts.collect())
    assert state(back) == state(index)
    held = lambda i: sum(int((ld.CuckooFilter.load(bytes(r["seats"])).table > 0).sum()) for r in i.filters.collect())
    assert held(back) == held(index)


def test_cuckoo_filter():
    dice = np.random.default_rng(1)
    k = dice.integers(-(2**62), 2**62, (5000, 2))
    f = ld.CuckooFilter(len(k))
    f.add(k[:, 0], k[:, 1])
    assert f.contains(k[:, 0], k[:, 1]).all()
    other = dice.integers(-(2**62), 2**62, (20_000, 2))
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.005
    g = ld.CuckooFilter.load(f.dump())
    g.remove(k[:2500, 0], k[:2500, 1])
    assert g.contains(k[2500:, 0], k[2500:, 1]).all() and g.contains(k[:2500, 0], k[:2500, 1]).mean() < 0.01
    same = np.repeat(k[:1], 40, 0)  # more equal marks than two buckets seat
    h = ld.CuckooFilter(10)
    h.add(same[:, 0], same[:, 1])
    assert h.stash and h.contains(same[:1, 0], same[:1, 1]).all()


def test_repeated_rows_null_ids_and_empty(spark):
    line = "this line is long enough to count"
    rows = [(1, line, 0, ""), (1, line, 0, ""), (2, line, 0, ""), (None, line, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r["doc_id"]), r["n_dropped"]) for r in ld.LineIndex.build(df).apply(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 0), ("None", 1)]
    empty = spark.createDataFrame([], SCHEMA)
    assert ld.LineIndex.build(empty).apply(empty).count() == 0
