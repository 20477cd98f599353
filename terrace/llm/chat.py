"""Chat formatting: records of any known layout become canonical turns, turns become marked text.

A record's layout is known by its schema fingerprint, the hash of its nested field paths; a
registry maps fingerprints to declarative mappings. Control strings inside texts are escaped
reversibly, so the formatted text can be read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's marks and the strings that may not appear bare inside a text.
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROL = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

_bare = re.compile(r"([<\[])(\\*)(" + "|".join(sorted({re.escape(c[1:]) for c in CONTROL}, key=len, reverse=True)) + ")")
_kept = re.compile(r"([<\[])(\\*)\\(" + "|".join(sorted({re.escape(c[1:]) for c in CONTROL}, key=len, reverse=True)) + ")")


def escape(text: str) -> str:
    """One more backslash behind the first character of each control string; none stays bare."""
    return _bare.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _kept.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as formatted, and where its escaped text starts and ends in it."""
    head = OPEN + escape(role).replace("%", "%25").replace("\n", "%0A") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not (formatted.startswith(OPEN) and formatted.endswith(CLOSE)):
        raise ValueError("not a formatted turn")
    head, _, body = formatted[len(OPEN) : -len(CLOSE)].partition("\n")
    return unescape(head.replace("%0A", "\n").replace("%25", "%")), unescape(body)


# --- layouts ---------------------------------------------------------------------------------


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; the items of a list share the path `[]`."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


#: A mapping is (list path or "", [(role or role field, text field)]): with a list path the pairs
#: are read from each item, else from the record; "=user" is a constant role, "!role" a field
#: whose value is kept as it is, "^system" a text field of the record outside the list.
Mapping = tuple[str, tuple[tuple[str, str], ...]]
LAYOUTS: tuple[tuple[tuple[str, ...], Mapping], ...] = (
    (("messages[].role", "messages[].content"), ("messages", (("role", "content"),))),
    (("conversations[].from", "conversations[].value"), ("conversations", (("from", "value"),))),
    (("system", "conversations[].from", "conversations[].value"), ("conversations", (("=system", "^system"), ("from", "value")))),
    (("prompt", "response"), ("", (("=user", "prompt"), ("=assistant", "response")))),
    (("prompt", "completion"), ("", (("=user", "prompt"), ("=assistant", "completion")))),
    (("question", "answer"), ("", (("=user", "question"), ("=assistant", "answer")))),
    (("instruction", "output"), ("", (("=user", "instruction"), ("=assistant", "output")))),
    (("instruction", "input", "output"), ("", (("=user", "instruction\n\ninput"), ("=assistant", "output")))),
    (("prompt",), ("", (("=user", "prompt"),))),
    (("response",), ("", (("=assistant", "response"),))),
    (("role", "text"), ("", (("!role", "text"),))),
)
MAPPINGS: dict[str, Mapping] = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}


def select(paths: frozenset[str], layouts: tuple[tuple[tuple[str, ...], Mapping], ...] = LAYOUTS) -> tuple[str, Mapping | None]:
    """Fingerprint and mapping of one layout, the same for every record that has it.

    A known fingerprint has its mapping. Else the layout is a known one with further (optional)
    fields if all of that one's paths are among its own, the one with the most paths first; an
    empty list stands for a layout's list. Any other layout has no mapping.
    """
    mark = fingerprint(paths)
    if mark in (known := {fingerprint(p): m for p, m in layouts}):
        return mark, known[mark]
    for wanted, mapping in sorted(layouts, key=lambda x: -len(x[0])):
        listed = mapping[0] + "[]"
        if all(p in paths or (mapping[0] and p.startswith(listed) and listed in paths) for p in wanted):
            return mark, mapping
    return mark, None
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def turns(record: dict, mapping: Mapping) -> list[tuple[str | None, str]]:
    """Canonical (role, text) turns of a record by its mapping.

    A null text counts as empty, a null role too where it is translated; an instruction with an
    empty input is the instruction alone.
    """
    listed, pairs = mapping
    text = lambda item, name: "" if item.get(name) is None else str(item[name])

    def pick(item: dict, role: str, name: str) -> tuple[str, str]:
        body = "\n\n".join(x for x in (text(item, n) for n in name.split("\n\n")) if x)
        if role[:1] == "!":
            return item.get(role[1:]), body
        role = role[1:] if role[:1] == "=" else text(item, role)
        return ROLES.get(role, role), body

    outer = [pick(record, r, n[1:]) for r, n in pairs if n[:1] == "^"]
    inner = [(r, n) for r, n in pairs if n[:1] != "^"]
    items = [x if isinstance(x, dict) else {} for x in record[listed]] if listed else [record]
    return outer + [pick(item, r, n) for item in items for r, n in inner]


def canonical(records: DataFrame, column: str = "record", key: str = "conv_id", order: str | None = None) -> DataFrame:
    """key, schema_fingerprint, turn, item, role, text from JSON records.

    turn is the record's place in its conversation (the column named by order, 0 without one), item the
    turn's place in the record. The mapping is selected once per distinct set of field paths. A record
    of a known layout with an empty list has no turns. An unknown layout or broken JSON gives one row
    with null item, so nothing is lost silently: unmapped() returns these, format_turns() leaves them out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[frozenset[str], tuple[str, Mapping | None]] = {}
        for batch in batches:
            out: list[tuple] = []
            for k, no, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    record = json.loads(raw or "")
                except ValueError:
                    out.append((k, None, no, None, None, None))
                    continue
                paths = frozenset(field_paths(record))
                if paths not in chosen:
                    chosen[paths] = select(paths)
                mark, mapping = chosen[paths]
                out += [(k, mark, no, i, r, t) for i, (r, t) in enumerate(turns(record, mapping))] if mapping else [(k, mark, no, None, None, None)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(kinds)], names=["k", "f", "t", "i", "r", "x"])

    place = (F.lit(0) if order is None else F.col(order)).cast("long")
    got = records.select(F.col(key).cast("long").alias("k"), place.alias("t"), F.col(column).cast("string").alias("r")).mapInArrow(run, "k long, f string, t long, i long, r string, x string")
    return got.select(F.col("k").alias(key), F.col("f").alias("schema_fingerprint"), F.col("t").alias("turn"), F.col("i").alias("item"), F.col("r").alias("role"), F.col("x").alias("text"))


def unmapped(found: DataFrame) -> DataFrame:
    """The rows of canonical() whose layout no mapping covers."""
    return found.filter("item IS NULL")


def as_records(rows: DataFrame) -> DataFrame:
    """conv_id, turn, record: rows (conv_id, turn, role, text) as JSON in the layouts they might come in.

    The layout follows a hash of the row: message lists, translated role names, prompts and
    responses; a role beyond user, assistant and system keeps the plain layout (role, text).
    """
    known = F.col("role").isin("user", "assistant", "system")
    foreign = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    shape = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(5))
    keep = {"ignoreNullFields": "false"}
    record = (
        F.when(known & (shape == 1), F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")), keep))
        .when(known & (shape == 2), F.to_json(F.struct(F.array(F.struct(foreign.alias("from"), F.col("text").alias("value"))).alias("conversations")), keep))
        .when((F.col("role") == "user") & (shape == 3), F.to_json(F.struct(F.col("text").alias("prompt")), keep))
        .when((F.col("role") == "assistant") & (shape == 3), F.to_json(F.struct(F.col("text").alias("response")), keep))
        .when(known & (shape == 4), F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")), keep))
        .otherwise(F.to_json(F.struct("role", "text"), keep))
    )
    return rows.select("conv_id", "turn", record.alias("record"))


# --- formatting ------------------------------------------------------------------------------

_SEGMENTS = "conv_id long, turn_no long, formatted string, start long, loss_start long, loss_end long"


def format_turns(rows: DataFrame) -> DataFrame:
    """One segment per turn: the conversation's text is its segments in turn_no order, nothing between.

    start is the segment's offset in the conversation; loss_start and loss_end bound the escaped
    text that counts for the loss (assistant turns; else both null). Turns are ordered by
    turn, within a record by item, then role, then text, nulls first; repeated rows stay repeated
    turns. A conversation of any length is streamed turn by turn from sorted partitions, never held
    whole. rows are those of canonical(), or conv_id, turn, role and text alone.
    """
    item = F.col("item").cast("long") if "item" in rows.columns else F.lit(0).cast("long")
    sorted_rows = (
        rows.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"), F.col("role").cast("string").alias("r"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("x"), item.alias("i"))
        .filter("i IS NOT NULL").repartition("c").sortWithinPartitions("c", "t", "i", "r", "x")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, no, at = object(), 0, 0
        for batch in batches:
            out: list[tuple] = []
            for c, r, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if c != now:
                    now, no, at = c, 0, 0
                s, a, b = render(r or "", x)
                lost = r == "assistant"
                out.append((c, no, s, at, a if lost else None, b if lost else None))
                no, at = no + 1, at + len(s)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.string() if i == 2 else pa.int64()) for i in range(6)], names=["conv_id", "turn_no", "formatted", "start", "loss_start", "loss_end"])

    return sorted_rows.mapInArrow(run, _SEGMENTS)


def read_back(segments: DataFrame, ordered: bool = False) -> DataFrame:
    """Digests of each conversation as parsed from its formatted segments.

    ordered: segments are as format_turns made them, a conversation in one partition and in
    order; otherwise they are dealt and sorted first.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and
    loss_sha256 (unescaped text under the loss mask) and formatted_chars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done() -> tuple:
            c, n, every, chars, loss, size = state
            return c, n, every.hexdigest(), chars, loss.hexdigest(), size

        def emit(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            out = []
            for c, s, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4, 5)), strict=True):
                if state is None or state[0] != c:
                    if state is not None:
                        out.append(done())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(s)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    lost = unescape(s[a:b])
                    state[3] += len(lost)
                    state[4].update(lost.encode("utf-8", "surrogatepass"))
                state[5] += len(s)
            yield emit(out)
        if state is not None:
            yield emit([done()])

    segments = segments.select("conv_id", "turn_no", "formatted", "start", "loss_start", "loss_end")
    if not ordered:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
