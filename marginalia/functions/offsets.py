"""Byte, character and UTF-16 positions as expressions. Ranges are half-open and count UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def byte_slice(binary: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary column; empty where end <= start."""
    return F.when(end > start, F.substring(binary, start + 1, end - start)).otherwise(F.lit(b""))


def text_at(text: Column, start: Column, end: Column) -> Column:
    """Substring by bytes (SQL: text_at)."""
    return F.decode(byte_slice(utf8(text), start, end), "UTF-8")


def on_boundary(text: Column, at: Column) -> Column:
    """Whether a byte position is the start of a character or the end of the text."""
    follower = F.hex(F.substring(utf8(text), at + 1, F.lit(1))).rlike("^[89AB]")
    return (at >= 0) & (at <= F.octet_length(text)) & ~follower


def checked_text_at(text: Column, start: Column, end: Column) -> Column:
    """text_at that raises for ranges that are inverted, out of range or cut a character."""
    fail = lambda why: F.raise_error(F.concat(F.lit(why + ": "), start.cast("string"), F.lit(".."), end.cast("string")))
    return (
        F.when(start > end, fail("inverted range"))
        .when((start < 0) | (end > F.octet_length(text)), fail("out of range"))
        .when(~on_boundary(text, start) | ~on_boundary(text, end), fail("not on a character boundary"))
        .otherwise(text_at(text, start, end))
    )


def char_to_byte(text: Column, at: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), at))


def byte_to_char(text: Column, at: Column) -> Column:
    return F.char_length(F.decode(F.substring(utf8(text), F.lit(1), at), "UTF-8"))


def byte_to_utf16(text: Column, at: Column) -> Column:
    """UTF-16 units before a byte position; a position within a character rounds up to its end."""
    width = lambda k: F.hex(F.substring(utf8(text), at + k, F.lit(1))).rlike("^[89AB]")
    up = at + F.when(width(1) & width(2) & width(3), 3).when(width(1) & width(2), 2).when(width(1), 1).otherwise(0)
    return (F.octet_length(F.encode(F.decode(F.substring(utf8(text), F.lit(1), up), "UTF-8"), "UTF-16BE")) / 2).cast("int")


def utf16_to_byte(text: Column, at: Column) -> Column:
    """Bytes before a UTF-16 position; a position within a surrogate pair rounds up."""
    units = F.encode(text, "UTF-16BE")
    inside = F.hex(F.substring(units, at * 2 + 1, F.lit(1))).rlike("^D[CDEF]")
    return F.octet_length(F.decode(F.substring(units, F.lit(1), (at + F.when(inside, 1).otherwise(0)) * 2), "UTF-16BE"))


def strip_version(name: Column) -> Column:
    """Without what follows the last @."""
    return F.regexp_replace(name, "@[^@]*$", "")


def anchor(type_id: Column, name: Column) -> Column:
    """type#name, or the type alone."""
    return F.when(name.isNull(), type_id).otherwise(F.concat_ws("#", type_id, name))


def anchor_type(key: Column) -> Column:
    return F.when(F.instr(key, "#") > 0, F.regexp_replace(key, "#[^#]*$", "")).otherwise(key)


def anchor_name(key: Column) -> Column:
    return F.when(F.instr(key, "#") > 0, F.substring_index(key, "#", -1))
