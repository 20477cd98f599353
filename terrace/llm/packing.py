"""Best-fit packing of tokenised documents, planned on the histogram of lengths.

Best-fit decreasing runs over counts: at most `capacity` lengths reach the driver, however
many documents there are. Its plan says which ranks of a length go to which sequences;
documents take their slots by joining on rank within length.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.session import cut

#: Fixed values of the public vocabulary: its special token, and the id that ends a document.
SPECIAL = {"<|endoftext|>": 50256}
END = 0


@dataclass(frozen=True)
class PackParams:
    """vocabulary: name of the tokenizer file. ranks: the same vocabulary as merge ranks, which
    gives the same ids several times as fast; None uses the tokenizer file itself. part_rows:
    documents of one length are ranked in parts of about this many. block: ranks per plan block."""

    capacity: int = 2048
    vocabulary: str = "byte_bpe_50k.json"
    ranks: str | None = "byte_bpe_50k.tiktoken"
    part_rows: int = 20_000
    block: int = 4096


@functools.cache
def encoder(vocabulary: str, ranks: str | None):
    """text -> ids as uint32; one per process."""
    import public_tokenizers as public

    if ranks is None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public.path(vocabulary))
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import tiktoken

    with open(public.path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("packing", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
    return lambda text: np.asarray(encoding.encode(text, allowed_special="all"), dtype="<u4")


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, the first piece is the remainder."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, p: PackParams) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(p.vocabulary, p.ranks)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for i, (s, n) in enumerate(cut_lengths(len(ids), p.capacity)):
                    out.append((doc_id.as_py(), i, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Plan rows (length, first rank, end rank, first sequence, offset), and the number of sequences.

    Rank first + i of the length goes to sequence first + i at offset. Lengths are placed
    in falling order, each into the open sequences with the least room that still holds it;
    sequences with the same room are intervals, handled together.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # rooms of open sequences, ascending
    open_at: dict[int, list[tuple[int, int]]] = {}
    total = 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in open_at:
                bisect.insort(rooms, room)
                open_at[room] = []
            open_at[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left > 0:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(i)
            else:
                room, first = capacity, total
                n = -(-left // (capacity // length))
                total += n
            each = room // length
            full = min(n, left // each)
            for j in range(each if full else 0):
                rows.append((length, rank + j * full, rank + (j + 1) * full, first, capacity - room + j * length))
            rank, left = rank + full * each, left - full * each
            put(room - each * length, first, full)
            first, n = first + full, n - full
            if n and 0 < left < each:
                for j in range(left):
                    rows.append((length, rank + j, rank + j + 1, first, capacity - room + j * length))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return rows, total


def pack(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; a row per piece.

    A null text counts as empty: the end id alone. Repeated rows are packed as often as they
    occur; equal rows may swap slots between runs. Sequences fill without gaps from offset
    0. An empty table gives no rows. Only doc_id and text are read.
    """
    p = params
    spark = docs.sparkSession
    made = cut(pieces(docs, p))
    counts = {int(r[0]): int(r[1]) for r in made.groupBy("length").count().collect()}
    rows, _ = best_fit(counts, p.capacity)
    parts = spark.createDataFrame([(k, -(-n // p.part_rows)) for k, n in counts.items()], "_l long, _parts long")
    keyed = made.withColumn("_h", F.xxhash64("doc_id", "piece", "start")).join(F.broadcast(parts), F.col("length") == F.col("_l"))
    keyed = keyed.withColumn("_part", F.pmod("_h", F.col("_parts"))).drop("_l", "_parts")
    ranks = Window.partitionBy("length", "_part").orderBy("_h", "doc_id", "piece", "ids_crc32")
    sums = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(F.col("length").alias("_l"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(sums), F.lit(0))).drop("_n")
    ranked = keyed.withColumn("_r", F.row_number().over(ranks) - 1).join(offsets, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_before")).withColumn("_block", F.floor(F.col("_rank") / p.block)).drop("_l", "_p")
    plan = spark.createDataFrame(rows, "_l long, _lo long, _hi long, _seq long, _offset long")
    plan = plan.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / p.block), F.floor((F.col("_hi") - 1) / p.block))))
    slot = (F.col("length") == F.col("_l")) & (F.col("_block") == F.col("_b")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(plan, slot).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_seq") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), F.col("_offset").alias("offset")
    )
