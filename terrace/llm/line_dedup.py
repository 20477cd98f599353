"""Reversible line dedup: exact reference counts per line key, fronted by sharded cuckoo filters.

The counts say in how many documents a key occurs and which document keeps it. A cuckoo
filter per shard holds the keys that are to be dropped; lines that no filter knows are settled
without a join. Filters support insertion and deletion, so documents can be added and
removed again and leave the index as if they had never been there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from terrace.session import cut

SPACE = b" \t\n\x0b\f\r"


@dataclass(frozen=True)
class LineParams:
    """min_chars, min_docs: keys at least so long in at least so many documents lose their lines.
    shard_keys: keys per filter, about. broadcast_bytes: filters up to this size in all are shipped to
    the tasks whole; larger ones travel to the tasks of their shard. dealt_rows: lines a task
    of a shard looks up, about; a shard with more is dealt to several tasks."""

    min_chars: int = 20
    min_docs: int = 3
    shard_keys: int = 50_000
    broadcast_bytes: int = 16 << 20
    dealt_rows: int = 4_000_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped at both ends, A-Z lower-cased; None where shorter than min_chars code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return key


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, partial-key cuckoo hashing; what finds no seat goes to an exact stash.

    Seats cannot grow without the keys: a filter whose stash outgrows its use calls itself full
    and is built anew from the exact counts."""

    SEATS = 4

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * self.SEATS * 0.6 < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, self.SEATS), np.uint16)
        self.stash: set[tuple[int, int]] = set()
        self._dice = np.random.default_rng(11)

    @staticmethod
    def _mark(k2: np.ndarray) -> np.ndarray:
        mark = (k2.astype(np.int64).view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark

    def _first(self, k1: np.ndarray) -> np.ndarray:
        return ((k1.astype(np.int64).view(np.uint64) >> np.uint64(20)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, at, mark):
        return at ^ (((np.asarray(mark).astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(5)).astype(np.int64) & (len(self.table) - 1))

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for key1, key2, mark, at in zip(k1.tolist(), k2.tolist(), self._mark(k2).tolist(), self._first(k1).tolist(), strict=True):
            undo: list[tuple[int, int, int]] = []
            for _ in range(200):
                if (free := np.flatnonzero(self.table[at] == 0)).size or (free := np.flatnonzero(self.table[at := int(self._other(at, mark))] == 0)).size:
                    self.table[at, free[0]] = mark
                    break
                seat = int(self._dice.integers(self.SEATS))
                undo.append((at, seat, int(self.table[at, seat])))
                self.table[at, seat], mark = mark, int(self.table[at, seat])
                at = int(self._other(at, mark))
            else:  # put everyone back and keep the key itself
                for bucket, seat, old in reversed(undo):
                    self.table[bucket, seat] = old
                self.stash.add((key1, key2))

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for key1, key2, mark, at in zip(k1.tolist(), k2.tolist(), self._mark(k2).tolist(), self._first(k1).tolist(), strict=True):
            if (key1, key2) in self.stash:
                self.stash.remove((key1, key2))
                continue
            for bucket in (at, int(self._other(at, mark))):
                if (held := np.flatnonzero(self.table[bucket] == mark)).size:
                    self.table[bucket, held[0]] = 0
                    break
            else:
                raise KeyError((key1, key2))

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, at = self._mark(k2), self._first(k1)
        hit = (self.table[at] == mark[:, None]).any(1) | (self.table[self._other(at, mark)] == mark[:, None]).any(1)
        if self.stash:
            hit |= np.fromiter(((a, b) in self.stash for a, b in zip(k1.tolist(), k2.tolist(), strict=True)), bool, len(k1))
        return hit

    @property
    def full(self) -> bool:
        return len(self.stash) > 16 + self.table.size // 200

    def dump(self) -> bytes:
        head = np.array([len(self.table), len(self.stash)], "<i8").tobytes()
        return head + self.table.tobytes() + np.array(sorted(self.stash), "<i8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> "CuckooFilter":
        buckets, stashed = np.frombuffer(raw[:16], "<i8").tolist()
        made = cls(1)
        made.table = np.frombuffer(raw[16 : 16 + 8 * buckets], np.uint16).reshape(buckets, cls.SEATS).copy()
        rest = np.frombuffer(raw[16 + 8 * buckets :], "<i8").reshape(stashed, 2)
        made.stash = {tuple(r) for r in rest.tolist()}
        return made


def postings(docs: DataFrame, p: LineParams) -> DataFrame:
    """doc_id, k1, k2: the distinct keys of each row, as 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids: list[int | None] = []
                found: list[bytes] = []
                for doc_id, text in zip(*part.columns, strict=True):
                    raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    keys = {xxhash.xxh3_128_digest(k) for line in raw.split(b"\n") if (k := line_key(line, p.min_chars))}
                    ids += [doc_id.as_py()] * len(keys)
                    found += sorted(keys)
                both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, k1 long, k2 long")


def _counts(posted: DataFrame) -> DataFrame:
    return posted.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def _filters(counts: DataFrame, p: LineParams) -> tuple[DataFrame, int]:
    """shard, seats: a filter per shard for the keys that are to be dropped, and the number of shards."""
    dropped = counts.filter(F.col("n_docs") >= p.min_docs)
    shards = max(1, -(-dropped.count() // p.shard_keys))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter(len(pdf))
        made.add(pdf["k1"].to_numpy(), pdf["k2"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seats": [made.dump()]})

    keyed = dropped.select("k1", "k2", F.pmod("k1", F.lit(shards)).alias("shard"))
    return cut(keyed.groupBy("shard").applyInPandas(fill, "shard long, seats binary")), shards


@dataclass(frozen=True)
class LineIndex:
    """postings (doc_id, k1, k2), counts (k1, k2, n_docs, keeper) and filters (shard, seats), all in the shared folder."""

    params: LineParams
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, params: LineParams = LineParams()) -> "LineIndex":
        posted = cut(postings(docs, params))
        counts = cut(_counts(posted))
        return cls(params, posted, counts, *_filters(counts, params))

    def _changed(self, posted: DataFrame, counts: DataFrame) -> "LineIndex":
        """The index with these postings and counts: each shard adds and removes the keys that crossed min_docs.

        Once a filter is full, all are built anew for the keys there are now.
        """
        filters, shards = self._refiltered(counts), self.shards
        if not filters.filter("full").isEmpty():
            filters, shards = _filters(counts, self.params)
        return LineIndex(self.params, posted, counts, filters.select("shard", "seats"), shards)

    def _refiltered(self, counts: DataFrame) -> DataFrame:
        high = lambda c: F.coalesce(c >= self.params.min_docs, F.lit(False))
        old = self.counts.select("k1", "k2", F.col("n_docs").alias("_was"))
        moved = (
            counts.join(old, ["k1", "k2"], "full").filter(high(F.col("n_docs")) != high(F.col("_was")))
            .select("k1", "k2", high(F.col("n_docs")).alias("up"), F.pmod("k1", F.lit(self.shards)).alias("shard"))
        )

        def change(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.load(bytes(held["seats"].iloc[0])) if len(held) else CuckooFilter(len(keys))
            for up in (False, True):
                some = keys[keys["up"] == up]
                (made.add if up else made.remove)(some["k1"].to_numpy(), some["k2"].to_numpy())
            shard = held["shard"].iloc[0] if len(held) else keys["shard"].iloc[0]
            return pd.DataFrame({"shard": [shard], "seats": [made.dump()], "full": [made.full]})

        return cut(moved.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(change, "shard long, seats binary, full boolean"))

    def insert(self, docs: DataFrame) -> "LineIndex":
        """The index with more documents."""
        new = cut(postings(docs, self.params))
        more = _counts(new).withColumnsRenamed({"n_docs": "_n", "keeper": "_k"})
        counts = cut(self.counts.join(more, ["k1", "k2"], "full").select("k1", "k2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("keeper", "_k").alias("keeper")))
        return self._changed(cut(self.postings.unionByName(new)), counts)

    def delete(self, ids: DataFrame) -> "LineIndex":
        """The index without the documents of the given doc_id; keys they held find their next keeper."""
        ids = ids.select(F.col("doc_id").alias("_id")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_id"))
        rest = cut(self.postings.join(ids, same, "left_anti"))
        touched = self.postings.join(ids, same, "left_semi").select("k1", "k2").distinct()
        again = _counts(rest.join(touched, ["k1", "k2"], "left_semi"))
        counts = cut(self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(again))
        return self._changed(rest, counts)

    def drops(self) -> DataFrame:
        """doc_id, k1, k2: the keys that each document loses.

        Every line asks the filter of its shard first; the exact counts settle the few it knows.
        """
        size = self.filters.agg(F.coalesce(F.sum(F.length("seats")), F.lit(0))).first()[0]
        if size <= self.params.broadcast_bytes:
            held = {r["shard"]: bytes(r["seats"]) for r in self.filters.collect()}
            shipped, shards = self.postings.sparkSession.sparkContext.broadcast(held), self.shards

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                loaded = {s: CuckooFilter.load(raw) for s, raw in shipped.value.items()}
                for batch in batches:
                    k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                    known, of = np.zeros(len(k1), bool), k1 % shards
                    for s, held_by in loaded.items():
                        if (mine := of == s).any():
                            known[mine] = held_by.contains(k1[mine], k2[mine])
                    yield batch.filter(pa.array(known))

            hits = self.postings.mapInArrow(run, "doc_id long, k1 long, k2 long")
        else:
            hits = self._routed()
        lost = self.counts.filter(F.col("n_docs") >= self.params.min_docs).select(F.col("k1").alias("_a"), F.col("k2").alias("_b"), "keeper")
        joined = hits.join(lost, (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")))
        return joined.filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "k1", "k2")

    def _routed(self) -> DataFrame:
        """The postings that the filters know, each looked up where its shard's filter was sent.

        A task holds one filter at a time and streams the lines that follow it. A shard that a very
        common line makes large is dealt over several tasks by document, each with the filter.
        """
        shard = F.pmod("k1", F.lit(self.shards))
        per = self.postings.groupBy(shard.alias("shard")).agg(F.ceil(F.count(F.lit(1)) / self.params.dealt_rows).cast("int").alias("parts"))
        per = cut(per)
        wide = F.broadcast(per) if per.count() <= 100_000 else per
        lines = self.postings.withColumn("shard", shard).join(wide, "shard").select(
            "shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "doc_id", "k1", "k2", F.lit(None).cast("binary").alias("seats"))
        none = F.lit(None).cast("long")
        heads = self.filters.join(wide, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), none.alias("doc_id"), none.alias("k1"), none.alias("k2"), "seats")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now: tuple[int, int] | None = None
            made: CuckooFilter | None = None
            for batch in batches:
                shard, part, kind = (batch.column(i).to_numpy() for i in range(3))
                cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
                for a, b in zip(cuts, np.r_[cuts[1:], len(shard)], strict=True) if len(shard) else ():
                    if kind[a] == 0:
                        now, made = (int(shard[a]), int(part[a])), CuckooFilter.load(batch.column(6)[int(a)].as_py())
                    elif now == (int(shard[a]), int(part[a])):
                        lines = batch.slice(a, b - a).select(["doc_id", "k1", "k2"])
                        yield lines.filter(pa.array(made.contains(lines.column(1).to_numpy(), lines.column(2).to_numpy())))

        dealt = lines.unionByName(heads).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
        return dealt.mapInArrow(run, "doc_id long, k1 long, k2 long")

    def apply(self, docs: DataFrame, *carry: str) -> DataFrame:
        """doc_id, carried columns, n_lines, n_dropped, kept; a row per input row.

        Each row counts as a document; the largest doc_id holding a key keeps it, every row
        with that id. A null text counts as one empty line. Null ids are the smallest; a key
        that only they hold is kept.
        """
        p = self.params
        per_doc = self.drops().groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("_lost")).withColumnRenamed("doc_id", "_id")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
        joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        fields = [f for f in joined.schema if f.name not in ("_text", "_lost")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    names = part.schema.names
                    n_lines, n_dropped, kept = [], [], []
                    for text, lost in zip(part.column(names.index("_text")), part.column(names.index("_lost")), strict=True):
                        text = text.as_py()
                        n_lines.append(text.count("\n") + 1)
                        if not lost.is_valid:
                            n_dropped.append(0)
                            kept.append(text)
                            continue
                        gone = {np.array([x["k1"], x["k2"]], "<i8").tobytes() for x in lost.as_py()}
                        lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                        stay = [x for x in lines if not ((k := line_key(x, p.min_chars)) and xxhash.xxh3_128_digest(k) in gone)]
                        n_dropped.append(len(lines) - len(stay))
                        kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
                    carried = [part.column(names.index(f.name)) for f in fields]
                    yield pa.RecordBatch.from_arrays([*carried, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=[*(f.name for f in fields), "n_lines", "n_dropped", "kept"])

        schema = StructType([*fields]).add("n_lines", LongType()).add("n_dropped", LongType()).add("kept", StringType())
        return joined.mapInArrow(run, schema)
