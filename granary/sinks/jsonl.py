"""Canonical JSON Lines in discovery order, and reading them again to resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record with one of these errors is scanned again.
ABORTED = ["bad_zip", "unexpected_error", "member_read_error", "elf_parse_error", "macho_parse_error", "pe_parse_error", "python_recursion_limit_exceeded"]


def write(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line a wheel, ordered over all part files by name; ranges of the order are written
    side by side, so no task holds all lines."""
    records.sort(*order(records)).select("line").write.mode(mode).text(path)


def order(records: DataFrame) -> list[str]:
    """What the lines are ordered by (O1, O2): file name, then path where it is known."""
    return ["filename", *[c for c in ("path",) if c in records.columns]]


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """(filename, line, aborted) of the lines that parse, and all other columns."""
    v = F.try_parse_json(line)
    kinds = F.from_json(F.get_json_object(line, "$.errors"), "array<struct<kind:string>>")
    aborted = F.coalesce(F.exists(kinds, lambda e: e["kind"].isin(ABORTED)), F.lit(False))
    return lines.where(v.isNotNull()).select(
        *[c for c in lines.columns if c not in (line, "filename")],
        F.get_json_object(line, "$.wheel.filename").alias("filename"),
        F.col(line).alias("line"),
        aborted.alias("aborted")
    ).where("filename is not null")


def resumable(spark: SparkSession, path: str) -> DataFrame:
    """(filename, line) of an earlier output that need not be scanned again."""
    return parsed(spark.read.text(path)).where("not aborted").dropDuplicates(["filename"]).select("filename", "line")
