"""Predicates over evidence columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_opaque() -> Column:
    """An object that names no dependency and has no symbol, string or crate to show; its own
    kind of symbol count is zero (P6)."""
    empty = [F.size(c) == 0 for c in ("needed", "matched_symbols", "matched_strings", "rust_crates")]
    count = F.when(F.col("format") == "elf", F.col("dynsym_count")).otherwise(F.col("symtab_count"))
    return empty[0] & empty[1] & empty[2] & empty[3] & (count == 0)


def costs_an_answer(reasons: Column, exempt: list[str]) -> Column:
    """Whether a reason beyond the exempt ones is among them (P10)."""
    return F.size(F.array_except(reasons, F.array(*[F.lit(r) for r in exempt]))) > 0


def source_available(py: Column, pyc: Column, unparsed: Column) -> Column:
    """Whether there is source that was read, or nothing to read."""
    return (py - unparsed > 0) | ((py == 0) & (pyc == 0))
