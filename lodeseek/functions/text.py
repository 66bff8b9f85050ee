"""Bytes, characters, UTF-16 units and lines of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes.
SPACES = " \t\n\x0b\x0c\r\x85\xa0                　"


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], empty: str) -> Column:
    """Outputs of a fold: step(state, item) gives the next state and an output; empty is the type of the array of outputs.

    Appending to an array copies it, so outputs gather in blocks of about the square root of their number first.
    """
    none = F.expr(f"cast(array() as {empty})")

    def over(items: Column, state: Column, outputs: Column, each: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(items, F.struct(state.alias("state"), outputs.alias("out")), each)

    def one(a: Column, x: Column) -> Column:
        return let(F.struct(a.alias("a"), x.alias("x")), lambda s: stepped(s["a"], s["x"]))

    def stepped(a: Column, x: Column) -> Column:
        state, out = step(a["state"], x)
        return F.struct(state.alias("state"), F.concat(a["out"], F.array(out)).alias("out"))

    def of(all_: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_)))).cast("int")

        def block(a: Column, at: Column) -> Column:
            inner = over(F.slice(all_, at, size), a["state"], none, one)
            return let(inner, lambda b: F.struct(b["state"].alias("state"), F.concat(a["out"], b["out"]).alias("out")))

        return F.when(F.size(all_) > 0, over(F.sequence(F.lit(1), F.size(all_), size), start, none, block)["out"]).otherwise(none)

    return let(items, of)


def running_sums(values: Column) -> Column:
    """Of each number (long), the sum of those before it."""
    return scan(values, F.lit(0).cast("long"), lambda total, x: (total + x, total), "array<bigint>")


def clean(text: Column) -> Column:
    """text without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)


def byte_prefix(text: Column, end: Column) -> Column:
    """The text before byte `end`, which must be a character's boundary."""
    raw = F.encode(text, "UTF-8")
    return F.decode(F.substring(raw, F.lit(1), F.least(end, F.octet_length(text)).cast("int")), "UTF-8")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    size = F.octet_length(text)
    a, b = F.least(start, size), F.least(end, size)
    return F.decode(F.substring(F.encode(text, "UTF-8"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "UTF-8")


def line_of(text: Column, byte: Column) -> Column:
    """1-based line of a byte offset."""
    return F.regexp_count(byte_prefix(text, byte), F.lit("\n")) + 1


def compat_line_of(text: Column, byte: Column) -> Column:
    """As line_of, but a range that begins at a line's start counts to the line before, 0 becoming 1."""
    prefix = byte_prefix(text, byte)
    newlines = F.regexp_count(prefix, F.lit("\n"))
    return F.greatest(newlines + F.when(F.endswith(prefix, F.lit("\n")) | (prefix == ""), 0).otherwise(1), F.lit(1))


def line_range(text: Column, line: Column) -> Column:
    """Byte range (start, end) of a 1-based line without its end; (0, 0) if there is none.

    One byte is counted for each line end, so offsets drift where lines end with two.
    """
    struct = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))

    def of(lines: Column) -> Column:
        bare = F.transform(lines, lambda x: F.regexp_replace(x, r"\r\z", ""))
        last_empty = F.element_at(lines, -1) == ""
        count = F.size(lines) - F.when(last_empty, 1).otherwise(0)

        def found(b: Column) -> Column:
            start = F.octet_length(F.array_join(F.slice(b, F.lit(1), line - 1), "\n")) + F.when(line > 1, 1).otherwise(0)
            return struct(start, start + F.octet_length(F.get(b, line - 1)))

        return F.when((line >= 1) & (line <= count), let(bare, found)).otherwise(struct(F.lit(0), F.lit(0)))

    return let(F.split(text, "\n"), of)


def context_before(prefix: Column, chars: int = 120) -> Column:
    """The last characters of prefix, without white space in front, line ends as spaces."""
    return F.translate(F.ltrim(F.right(prefix, F.lit(chars)), F.lit(SPACES)), "\n\r", "  ")


def context_after(suffix: Column, chars: int = 120) -> Column:
    return F.translate(F.rtrim(F.left(suffix, F.lit(chars)), F.lit(SPACES)), "\n\r", "  ")
