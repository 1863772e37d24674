"""Text functions with Python's semantics, as native expressions where possible."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's class of what str.strip() takes off.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WHITE}+|{WHITE}+\z", "")


def normalize_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapse(c: Column) -> Column:
    """Runs of white space within a line become one space; line feeds count as white space."""
    return strip(F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), r"[ \t\r\f\x0B]+", " "))


def safe_truncate(c: Column, limit: Column) -> Column:
    """At most ``limit`` characters; an ellipsis marks the cut."""
    cut = F.concat(F.regexp_replace(F.substring(c, F.lit(1), limit - 1), rf"{WHITE}+\z", ""), F.lit("…"))
    return F.when(F.length(c) <= limit, c).when(limit <= 1, F.substring(c, F.lit(1), limit)).otherwise(cut)


#: Fixed values of a heading: blanks before it at most, levels, blanks behind its marks.
INDENT, LEVELS, BLANKS = 3, 6, " \t"


def heading(c: Column) -> Column:
    """ATX heading of a line: struct(level, title), or null. Marks that close the
    title count only behind a blank."""
    body = F.ltrim(c, F.lit(" \t\n\x0b\f\r"))
    rest = F.ltrim(body, F.lit("#"))
    level = F.length(body) - F.length(rest)
    title = strip(rest)
    bare = F.rtrim(title, F.lit("#"))
    closed = (bare != title) & F.right(bare, F.lit(1)).isin(*BLANKS)
    is_one = (F.length(c) - F.length(body) <= INDENT) & level.between(1, LEVELS) & F.substring(rest, 1, 1).isin(*BLANKS) & (F.length(rest) > 1)
    return F.when(is_one, F.struct(level.alias("level"), F.when(closed, strip(bare)).otherwise(title).alias("title")))


def heading_of(line: str) -> tuple[int, str] | None:
    """The same of one line in Python."""
    body = line.lstrip()
    rest = body.lstrip("#")
    level = len(body) - len(rest)
    if len(line) - len(body) > INDENT or not 0 < level <= LEVELS or len(rest) < 2 or rest[0] not in BLANKS:
        return None
    title = rest.strip()
    bare = title.rstrip("#")
    return level, bare.strip() if bare != title and bare.endswith(tuple(BLANKS)) else title


def collapse_text(text: str) -> str:
    return re.sub(r"[ \t\r\f\v]+", " ", text.replace("\n", " ")).strip()


def ordered_distinct(labels: Column) -> Column:
    """Trimmed labels without blanks or repeats, in their first order."""
    return F.array_distinct(F.filter(F.transform(labels, strip), lambda x: x != ""))


#: Bytes of text that Python objects are made of at once.
SLICE_BYTES = 1 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches of about ``most`` bytes; Spark's batches have ten thousand rows of any size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first, before = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, last - first
        first, before = last, int(ends[last - 1])


def by_slices(make, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``make`` of each slice's columns as lists, put together; slices are cut by the first column."""
    return pa.concat_arrays([pa.array([], kind), *(make(*(c.slice(*at).to_pylist() for c in columns)) for at in slices(columns[0]))])
