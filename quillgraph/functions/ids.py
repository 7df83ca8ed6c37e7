"""Identifiers: time-ordered UUIDs and timestamps as columns, and branching ids (1, 1a, 1a1, 2) with their order."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7(at: Column, random: Column | None = None) -> Column:
    """A version 7 UUID: 48 bits of Unix milliseconds, then random bits (32 hexadecimal digits of ``random``, or of uuid())."""
    digits = F.replace(F.uuid() if random is None else random, F.lit("-"))
    ms = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    variant = F.lower(F.hex(F.conv(F.substring(digits, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(digits, 14, 3), F.lit("-"), variant, F.substring(digits, 18, 3), F.lit("-"), F.substring(digits, 21, 12))


def timestamp_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMddHHmm")


def branching_key(id_: Column) -> Column:
    """An array that orders branching ids as a slip box does: numbers by value, letters by length and then text."""
    parts = F.regexp_extract_all(id_, F.lit(r"(\d+|[a-z]+)"))
    return F.transform(parts, lambda p: F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 6, "0"), F.ltrim(p, F.lit("0"))))


def segments(id_: str) -> list[str]:
    if not re.fullmatch(r"\d+(?:[a-z]+\d+)*(?:[a-z]+)?", id_):
        raise ValueError(f"{id_!r} is not a branching id")
    return re.findall(r"\d+|[a-z]+", id_)


def following(part: str) -> str:
    """The next number, or the next in a, b, ..., z, aa, ab, ..."""
    if part.isdigit():
        return str(int(part) + 1)
    n = 0
    for c in part:
        n = n * 26 + ord(c) - 96
    n, out = n + 1, ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


def sibling(id_: str, taken: Iterable[str]) -> str:
    *head, last = segments(id_)
    taken = set(taken)
    while True:
        last = following(last)
        if (found := "".join(head) + last) not in taken:
            return found


def child(id_: str, taken: Iterable[str]) -> str:
    first = id_ + ("a" if segments(id_)[-1].isdigit() else "1")
    taken = set(taken)
    return sibling(first, taken) if first in taken else first


def root(taken: Iterable[str]) -> str:
    tops = [int(segments(t)[0]) for t in taken if re.fullmatch(r"\d+(?:[a-z]+\d+)*(?:[a-z]+)?", t)]
    return str(max(tops, default=0) + 1)
