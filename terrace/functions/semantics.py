"""Value semantics shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fragment(column: Column | str, text: str) -> Column:
    """Case-insensitive substring test; % and _ in the fragment keep their pattern meaning."""
    return (F.col(column) if isinstance(column, str) else column).ilike(f"%{text}%")


def filled(column: Column | str) -> Column:
    """Neither null nor the empty string."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & (c.cast("string") != "")


def head(column: Column | str, sep: str = ".") -> Column:
    return F.substring_index(column, sep, 1)


def tail(column: Column | str, sep: str = ".") -> Column:
    return F.substring_index(column, sep, -1)


def clip(column: Column | str, width: int) -> Column:
    """The first width characters and how many more there were; 0 keeps the whole text."""
    c = F.col(column) if isinstance(column, str) else column
    if width == 0:
        return c
    return F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width), F.lit("...[+"), (F.char_length(c) - width).cast("string"), F.lit(" chars]"))).otherwise(c)


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted list, not an average."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def number_key(column: Column | str) -> Column:
    """Equal for texts that spell the same number (42, 42.0, 042), the text itself otherwise."""
    c = F.col(column) if isinstance(column, str) else column
    number = c.try_cast("double")
    return F.when(number.isNotNull(), F.concat(F.lit("#"), number.cast("string"))).otherwise(c)


def lenient_double(column: Column | str) -> Column:
    """A number from text that never fails: 0.0 where there is none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def quoted(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def glob_pattern(glob: str, ignore_case: bool = True) -> str:
    """An anchored regular expression for **, * and ?; a single star stays within a folder."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return f"(?s{'i' if ignore_case else ''})^{''.join(out)}$"


def glob_match(column: Column | str, glob: str, ignore_case: bool = True) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.rlike(glob_pattern(glob, ignore_case))


def tokens(column: Column | str) -> Column:
    """Lower-case ASCII letter and digit runs, in order."""
    return F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9]+)"), F.lit(1))


def format_holes(column: Column | str) -> Column:
    """Numbered format holes become anonymous ones."""
    return F.regexp_replace(column, r"\{\d+[^}]*\}", "{}")


def content_hash(column: Column | str, width: int = 16) -> Column:
    return F.substring(F.sha2(column, 256), 1, width)


def indented(depth: Column | str, text: Column | str) -> Column:
    """The text behind two blanks per level."""
    d = F.col(depth) if isinstance(depth, str) else depth
    return F.concat(F.repeat(F.lit("  "), d.cast("int")), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def member_of(json: Column | str, role: str) -> Column:
    """An object's member by its role as text; null where the text is no object or lacks it."""
    return F.try_variant_get(F.try_parse_json(json), f"$['{role}']", "string")


def top_level_args(column: Column | str) -> Column:
    """The generic arguments of a type, cut at commas outside inner brackets; null where the text has none.

    A fold over the characters with the nesting as its state, so that it stays in generated code.
    """
    c = F.col(column) if isinstance(column, str) else column
    inner = F.regexp_extract(c, "(?s)^[^<]*<(.*)>$", 1)
    state = F.struct(F.lit(0).alias("deep"), F.lit("").alias("piece"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        deep = F.when(x.isin("<", "[", "("), s["deep"] + 1).when(x.isin(">", "]", ")"), F.greatest(s["deep"] - 1, F.lit(0))).otherwise(s["deep"])
        at_comma = (x == ",") & (s["deep"] == 0)
        piece = F.when(at_comma, F.lit("")).otherwise(F.concat(s["piece"], x))
        done = F.when(at_comma, F.array_append(s["done"], F.trim(s["piece"]))).otherwise(s["done"])
        return F.struct(deep.alias("deep"), piece.alias("piece"), done.alias("done"))

    args = F.aggregate(F.split(inner, ""), state, step, lambda s: F.array_append(s["done"], F.trim(s["piece"])))
    return F.when(c.rlike("(?s)^[^<]*<.*>$"), args)


def normal_path(column: Column | str) -> Column:
    """The path without `.`, empty and `..` segments that have a folder to leave; a rooted path cannot leave its root."""
    c = F.col(column) if isinstance(column, str) else column
    rooted = c.startswith("/")

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = F.when(last.isNotNull() & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.array_append(done, s))
        return F.when(s.isin("", "."), done).when(s == "..", up).otherwise(F.array_append(done, s))

    text = F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), text)).when(text == "", ".").otherwise(text)
