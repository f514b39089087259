"""Name filters and FNV-1a hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 64-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def matches(name: Column, wanted: str) -> Column:
    """Whether a name passes a filter, in either case of letters.

    ``*`` stands for any run and ``?`` for any character of the whole name; without these, the filter
    is looked for anywhere in the name. An empty filter passes everything, a null name nothing.
    """
    if not wanted:
        return name.isNotNull()
    if "*" not in wanted and "?" not in wanted:
        return F.coalesce(F.contains(F.lower(name), F.lit(wanted.lower())), F.lit(False))
    pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in wanted)
    return F.coalesce(name.rlike(rf"(?is)\A{pattern}\z"), F.lit(False))


def fnv1a(data: bytes | Iterable[int], value: int = FNV_BASIS) -> int:
    for byte in data:
        value = ((value ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return value


def file_name(name: str) -> str:
    """A name of letters, digits, ``-``, ``_`` and ``.`` only."""
    return re.sub(r"[^0-9A-Za-z._-]", "_", name)
