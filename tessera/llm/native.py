"""Column helpers for the operators that use DataFrame functions alone."""
from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Words of letters and digits: ASCII ones and every character beyond \x7F.
ALNUM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: What ends a word of the other kind: \x09-\x0D and the space.
SPACES = r"[\x20\x09-\x0D]"
SOLID = r"[^\x20\x09-\x0D]"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_key, h, doc_id, text): doc_key and h together tell texts of one id, and null ids, apart."""
    rows = texts(df, id_col, text_col)
    return rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_key"), F.xxhash64("text").alias("h"), "doc_id", "text")


def union_length(starts: Column, length: Column) -> Column:
    """How many places [s, s + length) cover, of sorted starts; 0 for none."""
    zero = F.struct(F.lit(-(2**40)).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts, zero, lambda a, s: F.struct(s.cast("long").alias("last"), (a["n"] + F.least(length.cast("long"), s.cast("long") - a["last"])).alias("n")), lambda a: a["n"]
    )
