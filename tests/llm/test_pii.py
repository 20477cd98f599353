import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                k != 1 or all(int(x) <= 255 for x in m[0].split(".")),
                k != 2 or (12 <= len(d) <= 19 and pii.luhn(d)),
                k != 3 or 9 <= len(d) <= 15,
            )
            if all(good):
                out.append((m.start(), k, m.end()))
    return sorted(out)


@given(st.text(alphabet="ab0123459.@+- ()%é\n", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_disguises_map_back():
    cases = {
        "mail john dot doe at example dot com now": "john dot doe at example dot com",
        "x [at] y.com": "x [at] y.com",
        "jane(at)mail(dot)example(dot)org": "jane(at)mail(dot)example(dot)org",
        "card four one one one 1111 1111 one one one one end": "four one one one 1111 1111 one one one one",
        "call plus four nine one seven one two three four five six seven": "plus four nine one seven one two three four five six seven",
        "jоhn@exаmple.com": "jоhn@exаmple.com",
        "ip １９２.１６８.０.１": "１９２.１６８.０.１",
        "a​b@exa​mple.com": "a​b@exa​mple.com",
    }
    for text, span in cases.items():
        found = [text[a:b] for a, _, b in pii.added_spans(text, pii.base_spans(text))]
        assert span in found, (text, found)


def test_disguised_dots_and_last_digits_of_numbers():
    for kind, text in (
        ("ip", "192 dot 168 dot 10 dot 5"), ("ip", "192[.]168[.]10[.]5"), ("ip", "192(dot)168 [punkt] 10{.}5"), ("ip", "192 dot 168 dot 10 dot five"),
        ("card", "4111 1111 1111 111 one"), ("ip", "one(dot)two(dot)three(dot)4"), ("email", "a" * 400 + ".b at example dot com"),
    ):
        whole = f"see {text}, then"
        assert pii.joined(pii.added_spans(whole, pii.base_spans(whole))) == f"{kind}:4:{4 + len(text)}", text
    for text in ("call +1 (621) 555-4974 ein Tag", "+1 (848) 555-1373 Un an", "1 dot 2 dot 3", "use a.b[.]c", "10 point 5 and 300 dot 1 dot 2 dot 3"):
        assert pii.added_spans(text, pii.base_spans(text)) == [], text


PIECES = ["one", "Five", "ein", "dot", "punkt", "plus", "at", "192", "10", "5", "4111", "1", " ", "  ", "[.]", "(dot)", " [ dot ] ", ".", "-", "+", "x", ", "]


class Always:
    search = staticmethod(lambda view: True)


@given(st.lists(st.sampled_from(PIECES), max_size=24).map("".join))
@settings(max_examples=1500, deadline=None)
def test_hints_drop_nothing(text):
    base = pii.base_spans(text)
    got, hint = pii.added_spans(text, base), pii._number_hint
    try:
        pii._number_hint = Always
        assert got == pii.added_spans(text, base)
    finally:
        pii._number_hint = hint


def test_prose_is_left_alone():
    for text in ("meet us at example.com today", "one two three go", "look at the dot com", "plain@example.com", "ein 25.63.122.242 und", "at dot at dot"):
        assert pii.added_spans(text, pii.base_spans(text)) == []


def test_table_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.co " * 3, "x"), (3, "a@b.co " * 3, "x"), (None, "1.2.3.4", "x"), (4, "z" * 300_000 + " a@b.co", "x")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[1]["spans"] == "" and by[3]["n_email"] == 3 and by[None]["spans"] == "ip:0:7" and by[4]["spans"] == "email:300001:300007"
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pii.mask("write a@b.co ok", "email:6:12") == "write <email> ok"


def _disguised(dice, kind):
    """A disguised identifier and what it reads as in plain."""
    digit_words = [w.split() for w in pii.DIGIT_WORDS]
    look = {v: [k for k, x in pii.HOMOGLYPHS.items() if x == v] for v in set(pii.HOMOGLYPHS.values())}
    glyph = lambda s: "".join(dice.choice(look[c]) if c in look and dice.random() < 0.4 else c for c in s)
    hide = lambda s: "".join(c + (dice.choice(pii.INVISIBLE) if dice.random() < 0.3 else "") for c in s[:-1]) + s[-1]
    say = lambda d: dice.choice(digit_words[int(d)])
    if kind == "email":
        name, site = "".join(dice.choice("abcdehopxy") for _ in range(dice.randrange(3, 200))), dice.choice(["exam-ple", "post", "mail7"])
        at = dice.choice([" [at] ", "(at)", " {@} ", " at ", " <arobase> "])
        dot = dice.choice([" dot ", "[dot]", " (punkt) ", "[.]"]) if at == " at " else dice.choice([" dot ", "[dot]", "."])
        spoken = "".join(" " + say(dice.randrange(10)) for _ in range(dice.choice([0, 2, 4])))
        return name + spoken + at + site + dot + dice.choice(["com", "org"])
    if kind == "glyphs":
        return hide(glyph("oche.pax@exarnple.corp"))
    digits = {"card": "4111111111111111", "ip": "".join(map(str, (192, 168, 10, 5)))}[kind]
    if kind == "ip":
        return dice.choice([" dot ", "[.]", " [dot] "]).join(["192", "168", "10", "5"])
    said, i = [], 0
    while i < len(digits):
        if digits[i : i + 2] == "11" and dice.random() < 0.5:
            said.append("double one")
            i += 2
        else:
            said.append(say(digits[i]) if dice.random() < 0.5 or i == 0 else digits[i])
            i += 1
    return " ".join(said)


def test_disguised_identifiers_map_back_to_their_own_characters():
    """Planted at known places among prose, each is found with exactly its own span."""
    dice = random.Random(12)
    prose = ["Nothing to see in this line; ", "Der Rest bleibt gleich. ", "(ligne suivante) ", "été à la mer, ", "\u200bword ", "é" * 40 + " "]
    for n in range(400):
        kind = dice.choice(["email", "glyphs", "card", "ip"])
        said = _disguised(dice, kind)
        before = "".join(dice.choice(prose) for _ in range(dice.randrange(4))) + "Contact: "
        text = before + said + " ; " + dice.choice(prose)
        spans = pii.base_spans(text) + pii.added_spans(text, pii.base_spans(text))
        want = (len(before), pii.KINDS.index({"glyphs": "email"}.get(kind, kind)), len(before) + len(said))
        assert want in spans, (kind, said, [(k, text[a:b]) for a, k, b in spans])


def test_one_spoken_digit_before_at_stays_alone():
    text = "see page four at example dot com"
    assert [text[a:b] for a, k, b in pii.added_spans(text, []) if k == 0] == ["four at example dot com"]
