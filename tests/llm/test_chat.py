import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
PIECES = st.lists(st.sampled_from([*chat.CONTROL, "<", "\\", "/", "\n", "a", "é😀", "|turn|>", "s>", "INST]", "[", "%0A", "%"]), max_size=8).map("".join)


@given(PIECES, PIECES)
@settings(max_examples=800, deadline=None)
def test_round_trip(role, text):
    formatted, a, b = chat.render(role, text)
    assert chat.parse(formatted) == (role, text) and chat.unescape(formatted[a:b]) == text
    body = formatted[len(chat.OPEN) : -len(chat.CLOSE)]
    assert not any(c in body for c in chat.CONTROL)


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_conversations_equal_brute_force(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 0, "user", "hi"), (1, 1, "user", None), (2, 0, "system", ""), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 5, None, "[INST] \\ [/INST]"), (None, 0, "assistant", "n"), (4, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, "zz") for r in rows], SCHEMA)
    for got in (chat.read_back(chat.format_turns(df), ordered=True), chat.read_back(chat.format_turns(df).repartition(3))):
        by = {r["conv_id"]: r for r in got.collect()}
        assert set(by) == {1, 2, 3, 4, None}
        for c, r in by.items():
            turns = sorted([(t, ro is not None, ro or "", tx or "") for cc, t, ro, tx in rows if cc == c])
            loss = "".join(x for _, _, ro, x in turns if ro == "assistant")
            assert r["n_turns"] == len(turns) and r["turns_sha256"] == digest("".join(f"{ro}\n{x}\n" for _, _, ro, x in turns))
            assert r["loss_chars"] == len(loss) and r["loss_sha256"] == digest(loss)
            assert r["formatted_chars"] == sum(len(chat.render(ro, x)[0]) for _, _, ro, x in turns)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"system": "s", "conversations": [{"from": "human", "value": "a"}]},
        {"prompt": "a", "completion": "b"},
        {"instruction": "a", "input": "", "output": "b"},
        {"instruction": "a", "input": "i", "output": "b"},
        {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, "{broken"), (99, None)], "conv_id long, record string")
    got = {}
    for r in chat.canonical(df).collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    plain = [("user", "a"), ("assistant", "b")]
    assert got[0] == got[1] == got[3] == got[4] == plain and got[2] == [("system", "s"), ("user", "a")] and got[5][0] == ("user", "a\n\ni")
    assert got[6] == got[98] == got[99] == [(None, None)]


def test_optional_fields_and_empty_lists_keep_a_layout_known(spark):
    records = [
        {"messages": [{"role": "user", "content": "a", "name": "x"}, {"role": "assistant", "content": None}], "meta": {"lang": "en"}},
        {"messages": []},
        {"system": None, "conversations": [{"from": "gpt", "value": "b", "weight": 1}]},
        {"prompt": "a", "response": "b", "score": 3},
        {"role": "narrator", "text": "t", "extra": []},
        [1, 2],
        {"messages": [{"role": "user"}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    found = chat.canonical(df)
    got = {}
    for r in found.filter("item IS NOT NULL").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {0: [("user", "a"), ("assistant", "")], 2: [("system", ""), ("assistant", "b")], 3: [("user", "a"), ("assistant", "b")], 4: [("narrator", "t")]}
    assert sorted(r["conv_id"] for r in chat.unmapped(found).collect()) == [5, 6]


def test_records_of_several_layouts_give_the_rows_back(spark):
    roles, texts = ["user", "assistant", "system", "human", None, "tool"], ["a</s>", "", None, '"q" \\ \n\t\x01', "é😀"]
    rows = [(c, t, roles[(c + t) % 6], texts[(c * 3 + t) % 5]) for c in range(30) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.canonical(chat.as_records(df), order="turn")
    assert sorted(map(str, ((r["conv_id"], r["turn"], r["role"], r["text"]) for r in found.collect()))) == sorted(str((c, t, ro, x or "")) for c, t, ro, x in rows)
    assert found.select("schema_fingerprint").distinct().count() == 6
    by = lambda d: {r["conv_id"]: tuple(r) for r in chat.read_back(d, ordered=True).collect()}
    assert by(chat.format_turns(found)) == by(chat.format_turns(df))


def test_fingerprints_ignore_order_and_values():
    a, b = {"x": [{"p": 1, "q": 2}], "y": 0}, {"y": "s", "x": [{"q": None, "p": 1}, {"p": 3, "q": 4}]}
    assert chat.fingerprint(chat.field_paths(a)) == chat.fingerprint(chat.field_paths(b)) != chat.fingerprint(chat.field_paths({"x": {}, "y": 0}))


def test_empty(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
