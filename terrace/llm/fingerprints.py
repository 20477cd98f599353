"""Document fingerprints: threshold-scaled sketches of character shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Sketches of parts
merge by union, and the share of one sketch found in another estimates containment however
unequal the documents are. A short text has few hashes below the fraction, so a sketch also
keeps its `least` smallest hashes and records the bound up to which it is complete;
two sketches are compared below the smaller of their bounds, which keeps both properties.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers of the rolling and the finishing hash.
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class SketchParams:
    """shingle: characters per shingle, a power of two. scale: one of so many hashes is kept.
    least: smallest hashes that are kept in any case. bucket_rows: documents per range in the
    chained pass. most_buckets: bound of the range limits that the driver holds."""

    shingle: int = 16
    scale: int = 64
    least: int = 48
    bucket_rows: int = 4000
    most_buckets: int = 50_000


@dataclass(frozen=True)
class Sketch:
    """hashes: ascending, all shingle hashes up to and including bound."""

    hashes: np.ndarray
    bound: int

    def text(self) -> str:
        body = np.concatenate([np.array([self.bound], "<u8"), self.hashes.astype("<u8")])
        return base64.b64encode(body.tobytes()).decode()

    @staticmethod
    def of(text: str) -> "Sketch":
        body = np.frombuffer(base64.b64decode(text), "<u8")
        return Sketch(body[1:], int(body[0]))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def sketch(text: str, p: SketchParams = SketchParams()) -> Sketch:
    """The sketch of a whole text; a text shorter than a shingle is one shingle, an empty one has none."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(h):
        return Sketch(h, int(_ALL))
    factor, width = _BASE, 1
    h = h + np.uint64(1)
    while width < p.shingle and len(h) > width:  # windows of 1, 2, 4, ... characters
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor & int(_ALL), 2 * width
    if width < p.shingle:  # shorter than a shingle: the text itself
        h = np.array([int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")], np.uint64)
    h = _mix(h)
    limit = int(_ALL) // p.scale
    low = np.unique(h[h <= np.uint64(limit)])
    if len(low) >= p.least:
        return Sketch(low, limit)
    every = np.unique(h)
    if len(every) <= p.least:
        return Sketch(every, int(_ALL))
    return Sketch(every[: p.least], max(limit, int(every[p.least - 1])))


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both documents together, complete up to the smaller bound."""
    bound = min(a.bound, b.bound)
    both = np.union1d(a.hashes, b.hashes)
    return Sketch(both[both <= np.uint64(bound)], bound)


def compare(a: Sketch, b: Sketch) -> tuple[float, float, float]:
    """Estimated resemblance, containment of a in b, containment of b in a; 0 where nothing can be compared.

    Two texts without shingles resemble each other fully.
    """
    if not len(a.hashes) and not len(b.hashes):
        return 1.0, 1.0, 1.0
    bound = np.uint64(min(a.bound, b.bound))
    x = a.hashes[: np.searchsorted(a.hashes, bound, "right")]
    y = b.hashes[: np.searchsorted(b.hashes, bound, "right")]
    common = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - common
    return common / union if union else 0.0, common / len(x) if len(x) else 0.0, common / len(y) if len(y) else 0.0


def fingerprint(docs: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """doc_id, n_chars, fingerprint; null text counts as empty, a row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sketch(t, params).text() for t in texts], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, run, schema: str, params: SketchParams = SketchParams()) -> DataFrame:
    """run(rows) over documents in descending doc_id, each partition's rows followed by the row after them.

    Documents are dealt to ranges of doc_id whose limits are quantiles of doc_id, at most
    most_buckets of them; the first document of each range is also dealt to the range
    before it, the very first one to the last range. So each text crosses the network once,
    and no task or driver holds more than its range. run gets (doc_id, text, last) and must
    not report rows where last is true. Null ids come last; rows with one id stay together,
    ordered by the hash of their text and then the text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(params.most_buckets, -(-n // params.bucket_rows)))
    limits: list[int] = []
    if ranges > 1:
        at = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * min(ranges, 10_000))
        limits = sorted(set(rows.agg(at).first()[0] or []))
    held = np.array(limits, np.int64)

    @F.pandas_udf("long")
    def ranged(ids):  # 0 holds the largest ids, the last range the nulls
        missing = ids.isna().to_numpy()
        place = len(held) - np.searchsorted(held, ids.fillna(0).to_numpy().astype(np.int64), "left")
        place[missing] = len(held) + 1
        import pandas as pd

        return pd.Series(place)

    keyed = rows.withColumn("_b", ranged("doc_id")).withColumn("_h", F.xxhash64("text"))
    # the heads: by ids and hashes alone, then the texts of those few
    best = rows.withColumn("_b", ranged("doc_id")).groupBy("_b").agg(F.max("doc_id").alias("_id"))
    tops = best.collect()  # a row per range, bounded by most_buckets
    order = sorted(int(r["_b"]) for r in tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first range follows the last one
    if not order:
        return spark.createDataFrame([], schema)
    heads = spark.createDataFrame([(r["_id"], int(r["_b"]), before[int(r["_b"])]) for r in tops], "_id long, _of long, _to long")
    head = (
        rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")))
        .withColumn("_h", F.xxhash64("text"))
        .groupBy("_of", "_to").agg(F.min(F.struct("_h", "text", "doc_id")).alias("_m"))
        .select(F.col("_m.doc_id").alias("doc_id"), F.col("_m.text").alias("text"), F.col("_to").alias("_b"), F.col("_m._h").alias("_h"), F.lit(True).alias("_last"))
    )
    every = keyed.withColumn("_last", F.lit(False)).unionByName(head)
    dealt = every.repartition("_b").sortWithinPartitions("_b", "_last", F.col("doc_id").desc_nulls_last(), "_h", "text")
    return dealt.select("doc_id", "text", "_last").mapInArrow(run, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def edit_probe(docs: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how near its own and its successor's are.

    The edited text has its last third replaced by the beginning of the next document in
    descending doc_id; the last document is followed by the first, a single one by itself.
    near_* estimate resemblance, contained_* the share of this document found in the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its successor
        names = [f.split(" ")[0] for f in EDITED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

        def finish(row: tuple, text: str, own: Sketch) -> tuple:
            doc_id, mine, print_ = row
            k = len(mine) // 3
            edited = mine[: len(mine) - k] + text[:k]
            other = sketch(edited, params)
            a, b = compare(print_, other), compare(print_, own)
            return doc_id, len(mine), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_.text(), other.text(), a[0], b[0], a[1], b[1]

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for doc_id, text, last in zip(*part.columns, strict=True):
                    text = text.as_py()
                    print_ = sketch(text, params)
                    if held is not None:
                        out.append(finish(held, text, print_))
                    held = None if last.as_py() else (doc_id.as_py(), text, print_)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return with_next(docs, run, EDITED, params)
