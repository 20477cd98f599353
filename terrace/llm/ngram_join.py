"""Exact Jaccard self-join on word shingles by PartEnum signatures.

A set of size n lies in the band of sizes up to a power of two. Two sets with Jaccard similarity
>= 3/4 and sizes n, m differ in at most K = floor((n + m) / 7) shingles. The shingle domain of a
band is partitioned twice: into first-level partitions, and each of these into three parts. In
every partition the subsets of two of its three parts are enumerated, and what the set holds in a
subset is one signature. A difference lies in one part and so in two of three subsets: it changes
at most two signatures of its partition, a second one there at most one more. Of t signatures a
linked pair therefore shares at least t - min(2 K, partitions + K). A set gives the signatures of
its own band, and those of the next band where a larger partner may lie there.

Signatures that more than a few sets share are hot: they are counted, not paired. A set with
h hot ones still meets each partner in an ordinary one while t - h exceeds what K differences can
change, and so does the partner if only its own count does. Pairs that may be missed are those
between two sets that both fall short, in the main families of edited copies and texts made of
common passages. These sets, and no others, are joined among each other by their rarest quarter of
shingles; where even these are common, all that share one meet in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.components import connected_components
from terrace.session import Scratch, cut, shuffle_partitions

#: Odd multipliers of the rolling and the finishing hash.
_BASE = 0x9E3779B97F4A7C15
_BAND_ENDS = 1 << np.arange(2, 62)  # largest sizes of the bands from band 2 on
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class JoinParams:
    """words: shingle length. surplus: first-level partitions, as a multiple of the least number that
    keeps one signature unchanged. hot: larger signature groups are hot. bucket_signatures: signatures
    a bucket, about. batch_signatures: signatures gathered before they are dealt. broadcast_ids: longest
    list of ids that is shipped instead of joined by a shuffle. block_sets, block_shingles: most sets
    and shingles, about, that one task compares with each other at once."""

    words: int = 5
    surplus: float = 1.5
    hot: int = 12
    bucket_signatures: int = 400_000
    batch_signatures: int = 600_000
    broadcast_ids: int = 1_000_000
    block_sets: int = 1024
    block_shingles: int = 1_500_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles; fewer words make one shingle, none make none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII space only
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    out = np.full(len(parts) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(_BASE) + h[i : len(h) - width + 1 + i]
    return np.unique(_mix(out))


def band(n: int) -> int:
    """The band of a size: log2 of the largest size in it."""
    return max(2, (n - 1).bit_length())


def bands(n: int) -> tuple[int, ...]:
    """Bands in which a set of size n meets partners at least as large."""
    return tuple(dict.fromkeys((band(n), band(4 * n // 3))))


def partitions_of(level: int, p: JoinParams) -> int:
    """First-level partitions of a band: K = 2 * largest / 7 differences leave some with at most one."""
    return math.ceil(p.surplus * ((1 << level) // 7 + 1))


@cache
def _edges(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def signatures(s: np.ndarray, level: int, p: JoinParams = JoinParams()) -> np.ndarray:
    """One signature for each two of three parts of a partition that hold any shingle; the last bit is the band's."""
    parts = 3 * partitions_of(level, p)
    at = np.r_[0, np.searchsorted(s, _edges(parts)), len(s)]
    held = np.diff(at).reshape(-1, 3)
    sums = np.diff(np.r_[np.uint64(0), np.cumsum(_mix(s ^ np.uint64(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)))][at]).reshape(-1, 3)
    place = np.arange(1, parts + 1, dtype=np.uint64).reshape(-1, 3) * np.uint64(_BASE)
    subsets = _mix(sums[:, [0, 0, 1]] + sums[:, [1, 2, 2]] + place)
    found = subsets[held[:, [0, 0, 1]] + held[:, [1, 2, 2]] > 0]
    return (found & ~np.uint64(1)) | np.uint64(level & 1)


def changed(differences: int, parts: int) -> int:
    """Most signatures that so many differing shingles change."""
    return min(2 * differences, parts + differences)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def profiles(docs: DataFrame, p: JoinParams) -> DataFrame:
    """doc_id, n, s1, s2, spare0, spare1: size and 128-bit hash of each row's set, and for its two bands
    the signatures that are left when its farthest partner there has changed all it can.

    spare0 belongs to the band with even number, spare1 to the odd one; a band without signatures has null.
    """

    def spare(s: np.ndarray, level: int) -> int:
        n = len(s)
        return len(signatures(s, level, p)) - changed((n + min(1 << level, 4 * n // 3)) // 7, partitions_of(level, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, marks, left = [], [], ([], [])
            for text in batch.column(1):
                s = shingles(text.as_py(), p.words)
                n.append(len(s))
                marks.append(xxhash.xxh3_128_digest(s.tobytes()))
                have = {level & 1: spare(s, level) for level in bands(len(s))} if len(s) else {}
                for side in (0, 1):
                    left[side].append(have.get(side))
            both = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(left[0], pa.int64()), pa.array(left[1], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "spare0", "spare1"])

    return _rows(docs).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, spare0 long, spare1 long")


def _pack(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, sig: np.ndarray) -> bytes:
    """Low halves of one bucket's signatures by document, ids as differences, all little-endian."""
    return np.int64(len(ids)).tobytes() + np.diff(ids, prepend=0).tobytes() + sizes.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + sig.astype("<u4").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids = np.cumsum(np.frombuffer(raw, "<i8", n, 8))
    sizes = np.frombuffer(raw, "<u4", n, 8 + 8 * n)
    counts = np.frombuffer(raw, "<u4", n, 8 + 12 * n)
    sig = np.frombuffer(raw, "<u4", -1, 8 + 16 * n).astype(np.uint64)
    return np.repeat(ids, counts), np.repeat(sizes, counts).astype(np.int64), sig


_MEET = "kind int, a long, b long, n long"
_MEET_NAMES = ["kind", "a", "b", "n"]


def _heat(doc: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    """kind 1 rows: n hot signatures of document a in its band with parity b."""
    both, n = np.unique(np.stack([doc, (sig & np.uint64(1)).astype(np.int64)], 1), axis=0, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n)], names=_MEET_NAMES)


def _dealt(docs: DataFrame, buckets: int, p: JoinParams) -> DataFrame:
    """bucket, blob: the signatures of many documents, by bucket; or kind 1 rows as in _met (blob null).

    What is hot within a batch already is cut to hot + 1 members in the blob, which keeps it hot
    where the bucket is gathered, and the rest is counted here: a signature that a third of all
    sets share never piles up in one bucket.
    """
    parts_of = np.uint64(buckets)
    names = ["bucket", "blob", *_MEET_NAMES]

    def flush(ids: list[int], sets: list[int], sigs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        idv = np.array(ids, np.int64)[order]
        size = np.array([sets[i] for i in order], np.int64)
        sig = np.concatenate([sigs[i] for i in order])
        doc = np.repeat(np.arange(len(order)), [len(sigs[i]) for i in order])
        low = sig & np.uint64(0xFFFFFFFF)
        bucket = ((sig >> np.uint64(32)) % parts_of).astype(np.int64)
        key = (bucket.astype(np.uint64) << np.uint64(32)) | low
        by = np.argsort(key, kind="stable")
        run_at = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        rank = np.arange(len(by)) - np.repeat(run_at, np.diff(np.r_[run_at, len(by)]))
        more = by[rank > p.hot]
        if len(more):
            heat = _heat(idv[doc[more]], sig[more])
            spread = pa.array(heat.column(1).to_numpy() % int(parts_of))
            yield pa.RecordBatch.from_arrays([spread, pa.nulls(heat.num_rows, pa.binary()), *heat.columns], names=names)
        by = by[rank <= p.hot]
        by = by[np.lexsort((doc[by], bucket[by]))]
        bucket, doc, low = bucket[by], doc[by], low[by]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = []
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            have, counts = np.unique(doc[a:b], return_counts=True)
            blobs.append(_pack(idv[have], size[have], counts, low[a:b]))
        none = [pa.nulls(len(blobs), pa.int32()), *[pa.nulls(len(blobs), pa.int64())] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(blobs, pa.binary()), *none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sizes: list[int] = []
        sigs: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                s = shingles(text.as_py(), p.words)
                if not len(s):
                    continue
                ids.append(doc_id.as_py()), sizes.append(len(s))
                sigs.append(np.concatenate([signatures(s, level, p) for level in bands(len(s))]))
                held += len(sigs[-1])
                if held >= p.batch_signatures:
                    yield from flush(ids, sizes, sigs)
                    ids, sizes, sigs, held = [], [], [], 0
        if ids:
            yield from flush(ids, sizes, sigs)

    return docs.mapInArrow(run, f"bucket long, blob binary, {_MEET}")


def _met(dealt: DataFrame, partitions: int, p: JoinParams) -> DataFrame:
    """kind 0: documents a < b with compatible sizes in n common ordinary signatures; kind 1: n hot signatures of document a in its band with parity b."""

    def groups(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(x) for x in blobs]
        doc, size, sig = (np.concatenate([x[i] for x in parts]) for i in range(3))
        by = np.lexsort((doc, size, sig))
        doc, size, sig = doc[by], size[by], sig[by]
        at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[at, len(sig)])
        each = np.repeat(count, count)
        hot = each > p.hot
        if hot.any():
            yield _heat(doc[hot], sig[hot])
        keep = (each > 1) & ~hot
        doc, size, sig = doc[keep], size[keep], sig[keep]
        own = np.searchsorted(_BAND_ENDS, size) + 2 & 1 == (sig & np.uint64(1)).astype(np.int64)  # in the band of the larger
        pairs = []
        for step in range(1, p.hot):  # members of one small group lie side by side, sizes ascending
            if len(doc) <= step:
                break
            i = np.flatnonzero((sig[step:] == sig[:-step]) & own[step:] & (4 * size[:-step] >= 3 * size[step:]) & (doc[step:] != doc[:-step]))
            x, y = doc[i], doc[i + step]
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        if pairs and sum(map(len, pairs)):
            every = np.concatenate(pairs)
            every = every[np.lexsort((every[:, 1], every[:, 0]))]
            new = np.flatnonzero(np.r_[True, (every[1:] != every[:-1]).any(1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(new), np.int32)), pa.array(every[new, 0]), pa.array(every[new, 1]), pa.array(np.diff(np.r_[new, len(every)]))], names=_MEET_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = -1, []
        for batch in batches:
            counted = batch.filter(batch.column(1).is_null())
            if counted.num_rows:
                yield counted.select(_MEET_NAMES)
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not blob.is_valid:
                    continue
                if bucket != now and blobs:
                    yield from groups(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from groups(blobs)

    return dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _MEET)


def _short(ids: DataFrame, p: JoinParams) -> DataFrame:
    """ids, to be shipped whole while they are few enough; a shuffle join otherwise."""
    return F.broadcast(ids) if ids.count() <= p.broadcast_ids else ids


def _only(docs: DataFrame, ids: DataFrame, how: str, p: JoinParams) -> DataFrame:
    """Rows whose doc_id is (left_semi) or is not (left_anti) among ids; shipped while the list is short."""
    ids = ids.select(F.col(ids.columns[0]).alias("_id"))
    return docs.join(_short(ids, p), F.col("doc_id") == F.col("_id"), how)


def _texts(pairs: DataFrame, docs: DataFrame, p: JoinParams, scratch: Scratch) -> DataFrame:
    """a, b, ta, tb: the pairs once each, with both texts."""
    pairs = scratch.stored(pairs.select("a", "b").distinct())
    ids = scratch.stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = _only(_rows(docs), ids, "left_semi", p)
    joined = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb")


def verify(pairs: DataFrame, docs: DataFrame, p: JoinParams, scratch: Scratch) -> DataFrame:
    """a, b, common, n_union: exact set overlap of each pair of documents, whole texts compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, str, np.ndarray] | None = None
        for batch in batches:
            common, union = [], []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                ta = ta.as_py()
                if last is None or last[0] != a or last[1] != ta:
                    last = (a, ta, shingles(ta, p.words))
                y = shingles(tb.as_py(), p.words)
                common.append(len(np.intersect1d(last[2], y, assume_unique=True)))
                union.append(len(last[2]) + len(y) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "n_union"])

    return _texts(pairs, docs, p, scratch).mapInArrow(run, "a long, b long, common long, n_union long")


_LINKED = "100 * common >= 75 * n_union"


def _sets(docs: DataFrame, p: JoinParams) -> DataFrame:
    """doc, n, s: each document's shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [shingles(text.as_py(), p.words).view(np.int64) for text in batch.column(1)]
            at = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), lists], names=["doc", "n", "s"])

    return _rows(docs).mapInArrow(run, "doc long, n long, s array<long>")


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """The least position that links lead to, for each of the sets in one block."""
    count = len(sets)
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(count), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], (np.cumsum(times > 1) - 1)[column[keep]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    common = np.zeros((count, count), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, (c, c + 2048))
        part = np.zeros((count, 2048), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        common += part @ part.T
    links = 175 * common.astype(np.int64) >= 75 * (n[:, None] + n[None, :])
    np.fill_diagonal(links, True)
    label = np.arange(count)
    while True:
        new = np.minimum(label, np.where(links, label[None, :], count).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(pdf):
    """lead, doc, root: the documents of one block and the least one each is linked to, the leader before all others."""
    import pandas as pd

    pdf = pdf.drop_duplicates("doc")
    lead = int(pdf["lead"].iloc[0])
    pdf = pdf.iloc[np.lexsort((pdf["doc"], pdf["doc"] != lead))]
    doc = pdf["doc"].to_numpy()
    return pd.DataFrame({"lead": lead, "doc": doc, "root": doc[linked([np.asarray(s) for s in pdf["s"]])]})


def _families(faces: DataFrame, sets: DataFrame, p: JoinParams, scratch: Scratch) -> DataFrame:
    """a, b: a forest of the links within families; faces: lead, doc, each document with all leaders of its families.

    A family is dealt to blocks, each with its leader, and a block settles its links. Between blocks
    only documents that are not linked to the leader yet have news: they meet the whole family.
    """

    def blocks(rows: DataFrame, by: str, as_: str) -> DataFrame:
        many = F.greatest(F.ceil(F.count(F.lit(1)) / p.block_sets), F.ceil(F.sum("n") / p.block_shingles))
        return rows.groupBy(F.col(by).alias("_lead")).agg(many.cast("int").alias(as_))

    def block(many: str) -> Column:
        return F.pmod(F.xxhash64("doc"), F.col(many)).cast("int")

    members = faces.filter("doc <> lead").join(sets, "doc")
    families = scratch.stored(blocks(faces.filter("doc <> lead").join(sets.select("doc", "n"), "doc"), "lead", "wide"))
    wide = members.join(families, F.col("lead") == F.col("_lead")).withColumn("i", block("wide"))
    heads = families.join(sets, F.col("_lead") == F.col("doc")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    first = wide.select("lead", "i", "doc", "s").unionByName(heads.select(F.col("doc").alias("lead"), "i", "doc", "s"))
    roots = scratch.stored(first.groupBy("lead", "i").applyInPandas(_meet, "lead long, doc long, root long"))
    links = roots.filter("doc <> root").select(F.col("root").alias("a"), F.col("doc").alias("b"))
    large = families.filter("wide > 1")
    if large.isEmpty():
        return links
    apart = roots.filter("root <> lead").select("lead", "doc").join(large, F.col("lead") == F.col("_lead"), "left_semi").join(sets, "doc")
    both = scratch.stored(blocks(apart, "lead", "tall").join(large, "_lead"))
    over = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    tall = apart.join(both, F.col("lead") == F.col("_lead")).withColumn("i", block("tall")).withColumn("j", over("wide"))
    across = members.join(both, F.col("lead") == F.col("_lead")).withColumn("j", block("wide")).withColumn("i", over("tall"))
    rest = tall.select("lead", "i", "j", "doc", "s").unionByName(across.select("lead", "i", "j", "doc", "s"))
    more = rest.groupBy("lead", "i", "j").applyInPandas(_meet, "lead long, doc long, root long").filter("doc <> root")
    return links.unionByName(more.select(F.col("root").alias("a"), F.col("doc").alias("b")))


def _rarest(docs: DataFrame, p: JoinParams, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs a, b, and exact links a, b, among documents that ordinary signatures do not cover.

    Linked sets share one of the rarest floor(n / 4) + 1 shingles of each. Shingles of one document only
    come first in that order and meet nothing. A shingle that few documents have there gives pairs;
    the others lead all their documents to the one with the largest shared part of itself.
    """
    sets = scratch.stored(_sets(docs, p))
    held = sets.select("doc", "n", F.explode("s").alias("h"))
    shared = held.groupBy(F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    own = Window.partitionBy("doc")
    ranked = held.join(shared, F.col("h") == F.col("_h")).withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own)).withColumn("r", F.row_number().over(own.orderBy("f", "h")))
    rare = scratch.stored(ranked.filter("alone + r <= floor(n / 4) + 1").select("doc", "n", "h", (F.col("alone") / F.col("n")).alias("loss")))
    best = F.min(F.struct("loss", "doc")).getField("doc").alias("lead")
    groups = scratch.stored(rare.groupBy(F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("m"), best).filter("m > 1"))
    few = rare.join(groups.filter(F.col("m") <= p.hot), F.col("h") == F.col("_h"), "left_semi")
    other = few.select(F.col("h").alias("_h"), F.col("doc").alias("_d"), F.col("n").alias("_n"))
    pairs = few.join(other, (F.col("h") == F.col("_h")) & (F.col("doc") < F.col("_d")) & (4 * F.least("n", "_n") >= 3 * F.greatest("n", "_n"))).select(F.col("doc").alias("a"), F.col("_d").alias("b"))
    faces = rare.join(groups.filter(F.col("m") > p.hot), F.col("h") == F.col("_h")).select("lead", "doc").distinct()
    return pairs, _families(scratch.stored(faces), sets, p, scratch)


def components(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id; a row per input row.

    Documents link when the Jaccard similarity of their shingle sets is at least 3/4;
    component_id is the smallest doc_id that links lead to. Null or wordless texts have no
    shingles and link with nothing; a null doc_id links with nothing and has a null component.
    Rows that repeat a doc_id are each placed by their own text. Equal sets are one class with one
    representative from the start, so copies are never compared with each other.
    """
    p = params
    docs = _rows(docs)
    with Scratch(docs.sparkSession) as scratch:
        prof = cut(profiles(docs, p))
        sets = prof.filter("n > 0 AND doc_id IS NOT NULL")
        classes = cut(sets.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min("spare0").alias("spare0"), F.min("spare1").alias("spare1")))
        others = sets.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).filter("doc_id <> rep").select("doc_id")
        alone = _only(docs.filter("doc_id IS NOT NULL"), scratch.stored(others), "left_anti", p)
        total = classes.agg(F.sum("n")).first()[0] or 0
        parts = max(shuffle_partitions(docs.sparkSession), -(-total // (4 * p.bucket_signatures)))
        met = scratch.stored(_met(_dealt(alone, 2 * parts, p), parts, p))
        comps = connected_components(links_of(met, classes, alone, p, scratch))
        placed = classes.join(comps, F.col("rep") == F.col("node"), "left").select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), F.col("n").alias("_n"), F.coalesce("component", "rep").alias("_c"))
        same = (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")) & (F.col("n") == F.col("_n"))
        return prof.join(placed, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id"))


def links_of(met: DataFrame, classes: DataFrame, docs: DataFrame, p: JoinParams, scratch: Scratch) -> DataFrame:
    """a, b: verified links between class representatives, enough of them to connect all that are linked."""
    heat = met.filter("kind = 1").groupBy(F.col("a").alias("_doc")).agg(*(F.sum(F.when(F.col("b") == side, F.col("n"))).alias(f"h{side}") for side in (0, 1)))
    left = lambda side: F.col(f"spare{side}") - F.coalesce(f"h{side}", F.lit(0))
    known = scratch.stored(classes.join(heat, F.col("rep") == F.col("_doc"), "left").select(F.col("rep").alias("doc"), "n", left(0).alias("left0"), left(1).alias("left1")))
    of = lambda side: known.select(F.col("doc").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "left0", "left1")))
    pairs = met.filter("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    odd = "greatest(2, length(bin(greatest(n_a, n_b) - 1))) % 2 = 1"
    need = F.when(F.expr(odd), F.greatest("left1_a", "left1_b")).otherwise(F.greatest("left0_a", "left0_b"))
    met_often = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("need", need).filter("need >= 1 AND shared >= need").select("a", "b")
    uncovered = scratch.stored(known.filter("left0 < 1 OR left1 < 1").select("doc"))
    near, links = _rarest(_only(docs, uncovered, "left_semi", p), p, scratch)
    found = verify(met_often.unionByName(near), docs, p, scratch).filter(_LINKED).select("a", "b")
    return found.unionByName(links)
