"""String rules of the trip and shape files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What strip takes off.
BLANKS = " \f\n\r\t\x0b"
_NUMBER = r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_WHOLE = r"^[ \t\n\x0B\f\r]*\+?([0-9]+)"


def split_fields(line: Column, delimiter: str) -> Column:
    """Fields of a line; one empty field at the very end does not count, and an empty line has none."""
    one = "[" + delimiter + "]"
    # within a lambda the line is named once, however deep the calls are nested
    cut = F.transform(F.array(line), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, one + r"\z", ""), one, -1)))
    return F.element_at(cut, 1)


def split_lines(content: Column) -> Column:
    """Lines of a file; what follows the last line feed counts only if there is something."""
    return split_fields(content, "\n")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def split_attribute(text: Column) -> tuple[Column, Column]:
    """Key and value around the first equals sign; no value without one."""
    at = F.instr(text, "=")
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at + 1, F.length(text)))


def number_prefix(text: Column) -> Column:
    """The number that a text begins with, after blanks; null if it begins with none, or with one that isn't finite."""
    value = F.regexp_extract(text, _NUMBER, 1).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def whole_prefix(text: Column) -> Column:
    """The whole number that a text begins with; null for negative ones and those beyond 64 bits."""
    return F.regexp_extract(text, _WHOLE, 1).try_cast("bigint")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def remove_extension(name: Column) -> Column:
    """Without the last dot and what follows it, unless the name begins with that dot."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
