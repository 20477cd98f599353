"""Language identification by cross-parsing against suffix automata.

A suffix automaton of labelled text per language accepts exactly the substrings of that text.
A document is parsed greedily into the longest phrases that a language's automaton accepts; the
language that needs the fewest phrases, normalised by the length of its text, wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LangParams:
    """sample_docs: a language is learned from the whole texts of at most so many labelled rows, spread by hash
    over the whole table; most_docs: at most so many rows (but one per label) over all languages together.
    short: texts of up to so many characters are taken before longer ones. segment: texts are
    parsed in segments of so many characters, each starting a phrase, for every language alike."""

    sample_docs: int = 24
    most_docs: int = 4096
    short: int = 4000
    segment: int = 1024
    rows: int = 2048


class Moves:
    """Transitions of an automaton, state and letter to state, in space that follows their number.

    The transitions of a state lie at its base plus the letter, in cells that hold their state, so that
    the rows of all states interlock; codes are below letters.
    """

    def __init__(self, edges: list[dict[int, int]], letters: int):
        total = sum(map(len, edges))
        taken = bytearray(2 * letters + 2 * total)  # the first cells stay empty, so that no base is negative
        self.base = np.zeros(len(edges), np.int32)
        at = letters
        for state in sorted((s for s, e in enumerate(edges) if len(e) > 1), key=lambda s: -len(edges[s])):
            codes = sorted(edges[state])
            slot, tries = taken.find(0, at), 0
            while any(taken[slot - codes[0] + c] for c in codes):
                slot, tries = taken.find(0, slot + 1), tries + 1
            if tries > 32:  # crowded: what is left free here goes to states with one transition
                at = slot
            self.base[state] = slot - codes[0]
            for c in codes:
                taken[slot - codes[0] + c] = 1
            if slot + 2 * letters + total > len(taken):
                taken.extend(bytes(2 * letters + total))
        single = [s for s, e in enumerate(edges) if len(e) == 1]
        free = letters + np.flatnonzero(np.frombuffer(taken, np.uint8)[letters:] == 0)[: len(single)]
        self.base[single] = free - np.array([next(iter(edges[s])) for s in single], np.int64)
        state = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        cell = self.base[state] + np.array([c for e in edges for c in e], np.int64)
        size = letters + int(max(self.base, default=0)) + 1
        self.owner, self.to = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.owner[cell] = state
        self.to[cell] = [x for e in edges for x in e.values()]

    def __getitem__(self, at: tuple[int, int]) -> int:
        state, c = at
        cell = self.base[state] + c
        return int(self.to[cell]) if self.owner[cell] == state else -1


def automaton(codes: np.ndarray, letters: int) -> Moves:
    """Transitions of the suffix automaton of a code sequence: state, letter -> state, -1 where none.

    State 0 is the start; every state is accepting for parsing, as any path spells a substring.
    """
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(moves)
        moves.append({}), link.append(-1), length.append(length[last] + 1)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q])), link.append(link[q]), length.append(length[p] + 1)
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return Moves(moves, letters)


class Model:
    """The automata of all languages in one table, and the code of each character."""

    def __init__(self, samples: dict[str, str], p: LangParams):
        self.langs = sorted(samples)
        points = np.array(sorted({ord(c) for text in samples.values() for c in text.lower()}), np.uint32)
        self.points, self.p = points, p
        letters = len(points) + 2  # 0: beyond the text, 1: a character of no sample
        base, owner, to, starts, at, cells = [], [], [], [], 0, 0
        for lang in self.langs:
            m = automaton(self.codes(samples[lang]), letters)
            starts.append(at)
            base.append(m.base + np.int32(cells))
            owner.append(np.where(m.owner >= 0, m.owner + at, -1))
            to.append(np.where(m.to >= 0, m.to + at, -1))
            at, cells = at + len(m.base), cells + len(m.to)
        flat = lambda parts: np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        self.base, self.owner, self.moves = flat(base), flat(owner), flat(to)
        self.starts = np.array(starts, np.int32)
        # a phrase costs about the logarithm of the text it is looked up in
        self.cost = np.array([np.log2(2 + len(samples[x])) for x in self.langs])

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.searchsorted(self.points, points)
        at[at == len(self.points)] = 0
        return np.where(self.points[at] == points, at + 2, 1) if len(self.points) else np.ones(len(points), np.int64)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each language needs for each text; all segments of all texts advance together."""
        width = self.p.segment
        total = np.zeros((len(texts), len(self.langs)))
        rows: list[np.ndarray] = []
        owner: list[int] = []

        def parse() -> None:
            order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
            lens = np.array([len(rows[i]) for i in order])
            grid = np.zeros((lens[0], len(rows)), np.int32)
            for j, i in enumerate(order):
                grid[: lens[j], j] = rows[i]
            alive = len(rows) - np.searchsorted(lens[::-1], np.arange(lens[0]), "right")
            state = np.repeat(self.starts[:, None], len(rows), 1)
            count = np.zeros(state.shape, np.int32)
            for t in range(lens[0]):
                c = grid[t, : alive[t]]
                here = state[:, : alive[t]]
                cell = self.base[here] + c
                now, miss = self.moves[cell], self.owner[cell] != here
                if miss.any():  # a phrase ends before c, or c is in no text and a phrase of its own
                    first = self.base[self.starts][:, None] + c
                    fresh = np.where(self.owner[first] == self.starts[:, None], self.moves[first], self.starts[:, None])
                    open_ = here != self.starts[:, None]
                    count[:, : alive[t]] += miss
                    count[:, : alive[t]] += miss & open_ & (fresh == self.starts[:, None])
                    now = np.where(miss, fresh, now)
                state[:, : alive[t]] = now
            count += state != self.starts[:, None]
            np.add.at(total, np.array(owner)[order], count.T)
            rows.clear(), owner.clear()

        for k, text in enumerate(texts):
            codes = self.codes(text)
            for s in range(0, len(codes), width):
                rows.append(codes[s : s + width])
                owner.append(k)
                if len(rows) >= self.p.rows:
                    parse()
        if rows:
            parse()
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the runner-up's lead, 1 where there is no runner-up."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and _letter.search(t)]
        if not asked or not self.langs:
            return langs, scores
        cost = self.phrases([texts[i] for i in asked]) * self.cost
        first = cost.argmin(1)
        ranked = np.sort(cost, 1)
        lead = 1 - ranked[:, 0] / ranked[:, 1] if len(self.langs) > 1 else np.ones(len(asked))
        for i, f, s in zip(asked, first, lead, strict=True):
            langs[i], scores[i] = self.langs[f], float(min(1.0, max(0.0, s)))
        return langs, scores


def held_out() -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, params: LangParams = LangParams()) -> Model:
    """Automata from a bounded sample of the labelled documents that are not held out.

    One document per language and hash bucket is chosen over the whole table, short ones first;
    the whole texts of the chosen ones are fetched.
    """
    p = params
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    h = F.xxhash64("doc_id")
    labels = labelled.select("lang").distinct().count()
    buckets = max(1, min(p.sample_docs, p.most_docs // max(1, labels)))
    ids = (
        labelled.groupBy("lang", F.pmod(h, F.lit(buckets)).alias("b"))
        .agg(F.min_by("doc_id", F.struct(F.char_length("text") > p.short, h)).alias("_id")).select(F.col("lang").alias("_lang"), "_id")
    )
    ids = ids.collect()  # at most most_docs, or one a label
    if not ids:
        return Model({}, p)
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in ids], "_lang string, _id long")
    texts = labelled.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "doc_id", F.col("text").alias("t")).distinct()
    samples: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["doc_id"], r["t"])):
        samples.setdefault(r["lang"], []).append(r["t"])
    return Model({k: "\n".join(v) for k, v in samples.items()}, p)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a row per input row.

    Prediction reads the text alone. `und` and score 0 where the text is null or has no
    letter, or where nothing was learned. Whole texts are parsed, long ones segment by segment.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most most_docs texts and about three transitions a character

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                langs, scores = shipped.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
