"""Limits and format marks of archive members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of an archive's members in bytes, and of their compression.
MEMBER_BYTES, RATIO, RATIO_FLOOR = 1 << 30, 1000, 1 << 20


def limit_error(size: Column, compressed: Column, most: int = MEMBER_BYTES, floor: int = RATIO_FLOOR, ratio: int = RATIO) -> Column:
    """The error of a member beyond the limits, null within."""
    return F.when(size > most, "binary_too_large").when((size >= floor) & (size > ratio * compressed), "compression_ratio_exceeded")


def sniffed(head: Column) -> Column:
    """The format that a member's first bytes tell."""
    four = F.hex(F.substring(head, 1, 4))
    out = F.when(four == "7F454C46", "elf").when(F.substring(four, 1, 4) == "4D5A", "pe")
    for magic in ("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "CAFEBABF"):
        out = out.when(four == magic, "macho")
    return out.when(F.hex(F.substring(head, 1, 8)) == "213C617263683E0A", "ar").otherwise("unknown")
