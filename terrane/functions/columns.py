"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: ASCII white space, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also if ``body`` uses it within lambdas.

    The optimizer may inline a projected column into a lambda, where it would be computed anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII rows take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def trim_ascii(text: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The maximal runs without ASCII white space; an empty array for null or blank text."""
    body = trim_ascii(F.coalesce(text, F.lit("")))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
