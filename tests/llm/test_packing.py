import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import packing

FAST, SLOW = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), packing.encoder("byte_bpe_50k.json", None)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 25), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(counts):
    rows, total = packing.best_fit(counts, 40)
    ranks, bins = {k: [] for k in counts}, {}
    for length, lo, hi, first, offset in rows:
        for i in range(hi - lo):
            ranks[length].append(lo + i)
            bins.setdefault(first + i, []).append((offset, length))
    assert all(sorted(r) == list(range(counts[k])) for k, r in ranks.items()) and set(bins) == set(range(total))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 40
    rooms = []
    for length in sorted(counts, reverse=True):  # item by item
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(40 - length)
    assert len(rooms) == total


def test_ranks_give_the_tokenizer_ids():
    for text in ("", "Hello  world\n\n x", "a<|endoftext|>b", "éß漢字 😀", "1234567 " * 50, "x" * 5000, " \t\r\n" * 300, "don't I'LL"):
        assert np.array_equal(FAST(text), SLOW(text)), text


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_document_has_the_tokenizer_ids(sf):
    """The merge ranks and the tokenizer file agree on whole texts, not only on hand-made ones."""
    for text in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist():
        assert np.array_equal(FAST(text or ""), SLOW(text or "")), (text or "")[:200]


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'aZ9é漢😀")), max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_text_has_the_tokenizer_ids(text):
    assert np.array_equal(FAST(text), SLOW(text))


def test_pieces_and_places(spark):
    texts = [(i, "word " * (i * 9 % 400), "x") for i in range(120)] + [(500, None, "x"), (501, "", "x"), (502, "abc def " * 4000, "x"), (7, "word " * 63, "x"), (None, "n", "x")]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string, length string"), packing.PackParams(part_rows=20, block=8)).collect()
    slow = packing.encoder("byte_bpe_50k.json", None)
    want = Counter()
    for doc_id, text, _ in texts:
        ids = np.append(slow(text or ""), 0).astype("<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in seqs.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
