"""From wheels to evidence, findings, verdicts and records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.extract import wheel
from granary.extract.archive import Bounds
from granary.operators import relational as R
from granary.plans import linkage as L
from granary.plans import matchers as M
from granary.plans.keep import kept
from granary.plans.policy import Policy, load

SCHEMA_VERSION, ANALYZER_VERSION, TOOL = 2, 59, "granary"
#: Objects, errors and other rows that a record lists.
RECORD_ROWS = 256


def evidence(wheels: DataFrame, policy: Policy, bounds: Bounds = Bounds()) -> DataFrame:
    """One row a wheel with all its evidence in nested columns; wheels: (filename, content,
    and ordinal or path).  Members' bytes never leave the function that decodes them."""
    spark = wheels.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    out = StructType.fromDDL(wheel.SCHEMA)
    patterns, targets = policy.patterns(), policy.targets()
    limits, conventions = policy.limits, policy.conventions
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    rest = [c for c in wheels.columns if c not in {"content", "wheel_id", *out.fieldNames()}]
    schema = StructType([*wheels.select(*rest).schema.fields, *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, contents = b.column("filename").to_pylist(), b.column("content")
            rows = [wheel.extract(c.as_py() or b"", n or "", patterns, targets, limits, conventions, bounds) for n, c in zip(names, contents, strict=True)]
            if rows:
                decoded = pa.Table.from_pylist(_maps(rows), schema=arrow).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *decoded.columns], names=[*rest, *decoded.schema.names])

    found = wheels.select(*rest, "content").mapInArrow(run, schema)
    return found.withColumn("wheel_id", F.sha2(F.concat("sha256", "filename"), 256))


def _maps(rows: list[dict]) -> list[dict]:
    for r in rows:
        for s in r["py_sites"]:
            s["attrs"] = list(s["attrs"].items())
    return rows


def findings(c: M.Context, keep=kept) -> DataFrame:
    """Rule and subject a wheel: attributes of the first hit, the rule's where it has none,
    with its distinct places (A1-A3)."""
    hits = M.unsuppressed(keep(M.all_hits(c), "hits"), c.policy)
    attrs = ["subject_kind", "severity", "verdict", "needs_human_review", "relation", "basis", "family"]
    out = R.group_findings(
        hits.withColumn("line", F.coalesce("line", F.lit(-1))),
        ["wheel_id", "rule_id", "subject"],
        attrs,
        ["match_ix", "hit_ix", "path", "line"],
        ["path", "line", "evidence"],
        c.policy.limits["max_locations_per_finding"]
    )
    rules = c.policy.rules_frame(c.spark)
    out = out.join(F.broadcast(rules), "rule_id")  # the policy's rules
    own = {"severity": "r_severity", "verdict": "r_verdict", "relation": "r_relation", "family": "r_family", "basis": "r_basis", "needs_human_review": "r_review"}
    out = out.withColumns({k: F.coalesce(k, v) for k, v in own.items()}).withColumn("basis", F.array_sort("basis"))
    return out.select(
        "wheel_id",
        "rule_id",
        "subject",
        "subject_kind",
        "severity",
        "category",
        "layer",
        "confidence",
        "verdict",
        "relation",
        "basis",
        "family",
        "needs_human_review",
        "occurrences",
        "truncated",
        F.transform("locations", lambda p: F.struct(p["path"].alias("path"), F.nullif(p["line"], F.lit(-1)).alias("line"), p["evidence"].alias("evidence"))).alias("locations")
    )


def verdicts(ev: DataFrame, found: DataFrame, linkage: DataFrame, policy: Policy) -> DataFrame:
    """One verdict a wheel (A7-A10); a wheel without findings has the last class."""
    classes = R.by_precedence(found, ["wheel_id"], "verdict", policy.precedence)
    reason = F.concat("rule_id", F.lit(": "), F.coalesce("subject", F.col("locations")[0]["path"], "rule_id"))
    more = found.groupBy("wheel_id").agg(
        F.array_sort(F.collect_set("relation")).alias("relations"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.array_sort(F.collect_set(reason)).alias("reasons"),
        F.bool_or("needs_human_review").alias("flagged"),
        F.array_sort(F.collect_set("family")).alias("families")
    )
    conditions = R.conditions_map(linkage, ["wheel_id"], "library", "value")
    out = ev.select("wheel_id", "filename").join(classes, "wheel_id", "left").join(more, "wheel_id", "left").join(conditions, "wheel_id", "left")
    none = F.array().cast("array<string>")
    last = policy.precedence[-1]
    out = out.withColumns({
        "class": F.coalesce("class", F.lit(last)),
        "classes": F.when(F.size(F.coalesce("classes", none)) > 0, F.col("classes")).otherwise(F.array(F.lit(last))),
        **{k: F.coalesce(k, none) for k in ("relations", "rule_ids", "reasons", "families")}
    })
    return out.withColumn("needs_human_review", (F.col("class") != last) | F.coalesce("flagged", F.lit(False))).drop("flagged")


class Scan:
    """A corpus' relations, each a DataFrame that is made and kept when first asked for."""

    def __init__(self, wheels: DataFrame, policy: Policy | None = None, keep=kept, evidence_level: str = "standard", bounds: Bounds = Bounds()):
        if evidence_level not in ("standard", "minimal"):
            raise ValueError(f"unknown evidence level {evidence_level!r}")
        self.policy, self.level = policy or load(), evidence_level
        self._wheels, self._keep, self._bounds = wheels, keep, bounds

    @cached_property
    def evidence(self) -> DataFrame:
        return self._keep(evidence(self._wheels, self.policy, self._bounds), "evidence")

    @cached_property
    def needed(self) -> DataFrame:
        return self._keep(L.needed(self.evidence, self.policy), "needed")

    @cached_property
    def postures(self) -> DataFrame:
        return self._keep(L.postures(self.evidence, self.needed, self.policy), "postures")

    @cached_property
    def linkage(self) -> DataFrame:
        return self._keep(L.resolve(self.evidence, self.postures, self.policy), "linkage")

    @cached_property
    def findings(self) -> DataFrame:
        context = M.Context(self.policy, self.evidence, self.needed, self.postures, self.linkage, RECORD_ROWS)
        return self._keep(findings(context, self._keep), "findings")

    @cached_property
    def verdicts(self) -> DataFrame:
        return self._keep(verdicts(self.evidence, self.findings, self.linkage, self.policy), "verdicts")

    def records(self, observed: Observation | None = None) -> DataFrame:
        """(wheel_id, filename, path or ordinal where known, line): the canonical JSON line of
        every wheel.  An observation gets counts of what went by (S34): wheels, those with
        cryptography, those to be looked at, errors, and each class."""
        ev = self.evidence
        place = [c for c in ("path", "ordinal") if c in ev.columns]
        found = self.findings.groupBy("wheel_id").agg(F.array_sort(F.collect_list(F.struct(
            "rule_id",
            F.coalesce("subject", F.lit("")).alias("_s"),
            *[c for c in self.findings.columns if c not in ("wheel_id", "rule_id")]
        ))).alias("findings"))
        rows = ev.drop("py_sites").join(found, "wheel_id", "left").join(self.verdicts.drop("filename"), "wheel_id")
        if observed is not None:
            last = self.policy.precedence[-1]
            each = [F.count(F.when(F.col("class") == c, 1)).alias(c) for c in self.policy.precedence]
            rows = rows.observe(
                observed,
                F.count("*").alias("wheels"),
                F.count(F.when(F.col("class") != last, 1)).alias("with_crypto"),
                F.count(F.when(F.col("needs_human_review"), 1)).alias("to_review"),
                F.sum(F.size("errors")).alias("errors"),
                *each
            )
        version, level = self.policy.version, self.level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lines = [canonical(record(r | {"conditions": dict(r["conditions"] or ())}, version, level)) for r in _rows(b)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("wheel_id", "filename", *place)], pa.array(lines, pa.string())], names=["wheel_id", "filename", *place, "line"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("wheel_id", "filename", *place)) + ", line string")


def _rows(batch: pa.RecordBatch) -> list[dict]:
    """What `to_pylist` gives, made column by column and not value by value."""
    return [dict(zip(batch.schema.names, r, strict=True)) for r in zip(*map(_values, batch.columns), strict=True)]


def _values(a: pa.Array) -> list:
    if pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        rows = [dict(zip(names, r, strict=True)) for r in zip(*map(_values, a.flatten()), strict=True)]
        return [r if there else None for r, there in zip(rows, a.is_valid().to_pylist(), strict=True)] if a.null_count else rows
    if pa.types.is_list(a.type):
        flat, out, at = _values(a.flatten()), [], 0
        for n in pc.list_value_length(a).to_pylist():
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
        return out
    return a.to_pylist()


def canonical(x: object) -> str:
    """JSON with sorted keys, without spaces, all ASCII."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def _cap(items: list, key, limit: int = RECORD_ROWS) -> tuple[list, bool]:
    return wheel._capped([*items], key, limit) if len(items) > limit else (list(items), False)


def record(r: dict, ruleset: str, level: str = "standard") -> dict:
    """A wheel's record: every key is there, null where nothing is known."""
    meta, art = r["metadata"], r["artifacts"]
    found = [{k: v for k, v in f.items() if k != "_s"} for f in r["findings"] or []]
    objects = _objects_kept(r["binaries"], found)
    detailed = level == "standard"
    binaries = []
    for b in objects:
        b = {k: v for k, v in b.items() if k != "from_archive"}
        b["symbol_counts"] = {"dynsym": b.pop("dynsym_count"), "symtab": b.pop("symtab_count")}
        b["truncated"] = {"symbols": b.pop("symbols_truncated"), "strings": b.pop("strings_truncated")}
        for k in ("matched_symbols", "matched_strings", "rust_crates"):
            b[k] = b[k] if detailed else []
        binaries.append(b)
    keys = ("name", "canonical_name", "version", "tags", "platform_tags", "requires_python", "requires_dist", "root_is_purelib")
    head = {k: (meta or {}).get(k) if meta or not k.startswith(("tags", "platform", "requires_dist")) else [] for k in keys}
    generator = {"name": meta["generator_name"], "version": meta["generator_version"], "raw": meta["generator_raw"]} if meta and meta["generator_raw"] else None
    errors, errors_cut = _cap([tuple(e.values()) for e in map(lambda e: {k: e[k] for k in ("stage", "kind", "path", "message")}, r["errors"])], lambda e: e[:2])
    skipped, skipped_cut = _cap([(s["path"], s["reason"]) for s in art["skipped"]], lambda s: s[1])
    links, links_cut = _cap([(s["path"], s["target"]) for s in art["symlinks"]], lambda s: s[1])
    conditions = r["conditions"] or {}
    return {
        "schema_version": SCHEMA_VERSION,
        "tool": {"name": TOOL, "analyzer_version": ANALYZER_VERSION, "ruleset_version": ruleset, "evidence_level": level},
        "wheel": {"filename": r["filename"], "sha256": r["sha256"], "size_bytes": r["size_bytes"], "generator": generator, **head},
        "artifacts": {k: art[k] for k in ("py_files", "pyc_files", "py_files_unparsed", "source_available", "total_uncompressed_bytes")}
        | {
            "binaries_truncated": len(r["binaries"]) > RECORD_ROWS,
            "record_entries": (meta or {}).get("record_entries") or 0,
            "extensions": [{"path": b["path"], "format": b["format"]} for b in objects],
            "bundled_libs": [b["path"] for b in objects if b["vendored_path"]],
            "sboms": (meta or {}).get("sbom_paths") or [],
            "skipped": [{"path": p, "reason": x} for p, x in skipped],
            "skipped_truncated": skipped_cut,
            "symlinks": [{"path": p, "target": x} for p, x in links],
            "symlinks_truncated": links_cut
        },
        "binaries": binaries,
        "findings": found,
        "verdict": {k: r[k] for k in ("class", "classes", "relations", "rule_ids", "reasons", "needs_human_review")} | {"conditions": conditions},
        "crypto": {"families": r["families"], "libraries": [{"name": k.removesuffix("_linkage"), "linkage": v} for k, v in sorted(conditions.items()) if v != "none"]},
        "errors": [dict(zip(("stage", "kind", "path", "message"), e, strict=True)) for e in errors],
        "errors_truncated": errors_cut,
    }


def _objects_kept(objects: list[dict], found: list[dict]) -> list[dict]:
    """At most `RECORD_ROWS` objects, those first that findings need."""
    if len(objects) <= RECORD_ROWS:
        return objects
    paths = {b["path"] for b in objects}
    turn: dict[str, tuple] = {}
    for f in found:
        own = sorted({p["path"] for p in f["locations"]} & paths)
        for i, p in enumerate(own):
            turn[p] = min(turn.get(p, (9, "")), (1, f"{f['rule_id']}\0{f['subject'] or ''}") if i == 0 else (2, p))
    kept = set(sorted(paths, key=lambda p: (turn.get(p, (3, p)), p))[:RECORD_ROWS])
    return [b for b in objects if b["path"] in kept]


def scan(spark: SparkSession, *inputs: str, policy: Policy | None = None, **more) -> Scan:
    """Scan wheels in folders or at paths."""
    from granary.sources.discovery import wheels

    return Scan(wheels(spark, *inputs), policy, **more)
