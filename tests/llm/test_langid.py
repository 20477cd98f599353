import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


@given(st.text(alphabet="abc", min_size=1, max_size=40), st.text(alphabet="abcd", max_size=40))
@settings(max_examples=150, deadline=None)
def test_phrases_equal_greedy_parsing(sample, text):
    m = langid.Model({"x": sample}, langid.LangParams(segment=1000))
    want, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        want, at = want + 1, end
    if text:
        assert m.phrases([text])[0, 0] == want


def test_segments_cost_one_phrase_each():
    m = langid.Model({"x": "abcabc"}, langid.LangParams(segment=3, rows=2))
    assert m.phrases(["abcabcabc", "", "ab"])[:, 0].tolist() == [3, 0, 1]


def test_automaton_accepts_all_substrings():
    codes = np.array([2, 3, 2, 2, 3, 3, 2])
    moves = langid.automaton(codes, 4)
    for i in range(len(codes)):
        state = 0
        for c in codes[i:]:
            state = moves[state, c]
            assert state >= 0


def rows():
    dice = random.Random(1)
    sounds = {"aa": "the and ing er th re on".split(), "bb": "ein sch ung ich der aus".split(), "cc": "que ment eau ion les pas".split()}
    out = []
    for i in range(400):
        lang = dice.choice(list(sounds))
        out.append((i, " ".join("".join(dice.choice(sounds[lang]) for _ in range(3)) for _ in range(3 + i % 40)), lang, "x"))
    return out + [(900, None, "aa", ""), (901, "12 34 !!", "aa", ""), (902, "", "aa", ""), (903, "the and", None, ""), (904, "querschung " * 60_000, "bb", ""), (None, "the thing", "cc", "")]


def test_held_out_accuracy_and_edges(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df, langid.LangParams(sample_docs=16))).collect()}
    assert len(got) == len(rows())
    for i in (900, 901, 902):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0
    held = [(got[i]["lang_pred"], lang) for i, _, lang, _ in rows() if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97
    for r in got.values():
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "words here", None, "")], SCHEMA)
    assert langid.identify(df, langid.fit(df)).first()["lang_pred"] == "und"
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    base = rows()[:200]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, x) for i, t, lang, x in base]
    a, b = (langid.fit(spark.createDataFrame(r, SCHEMA)) for r in (base, wrong))
    assert a.langs == b.langs and np.array_equal(a.moves, b.moves)


def test_large_scripts_are_kept_apart():
    """Characters of every script are told apart, however many come before them in frequency."""
    dice = random.Random(5)
    script = lambda first, n: "".join(chr(first + dice.randrange(n)) for _ in range(3000))
    samples = {"la": script(0xC0, 0x180), "ru": script(0x430, 32), "zh": script(0x4E00, 2000), "ja": script(0x5A00, 2000), "ko": script(0xAC00, 2000)}
    m = langid.Model(samples, langid.LangParams())
    got = m.predict([text[i : i + 60] for text in samples.values() for i in (0, 500, 2000)])[0]
    assert got == [lang for lang in samples for _ in range(3)]
    assert m.phrases([samples["ko"][:60]])[0, m.langs.index("zh")] == 60  # each a phrase of its own


def test_every_label_is_learned(spark):
    docs = [(i, f"{chr(0x4E00 + i % 90)}{chr(0x5000 + i % 90)} " * 5, f"l{i % 90:02}", "") for i in range(90 * 12)]
    m = langid.fit(spark.createDataFrame(docs, SCHEMA))
    assert len(m.langs) == 90 and m.predict([t for _, t, _, _ in docs[:90]])[0] == [x for _, _, x, _ in docs[:90]]
