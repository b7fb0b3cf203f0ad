"""Rule matchers: evidence joined with the rules of each kind, one plan a kind.

A kind's rules are a small dimension of (rule_id, match_ix, parameters).  Evidence is
exploded once a kind and joined with it, so the plan has 21 branches whatever the number
of rules.  `register` adds a kind of one's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans import linkage as L
from granary.plans.policy import Policy, local_frame

HIT = {
    "wheel_id": "string", "rule_id": "string", "match_ix": "int", "hit_ix": "bigint", "subject": "string", "subject_kind": "string", "path": "string", "line": "int",
    "evidence": "string", "severity": "string", "verdict": "string", "needs_human_review": "boolean", "relation": "string", "basis": "array<string>", "family": "string",
    "suppressed_by": "array<struct<rule_id:string,subject:string>>",
}


@dataclass
class Context:
    """What a matcher may read."""

    policy: Policy
    evidence: DataFrame
    needed: DataFrame
    postures: DataFrame
    linkage: DataFrame
    max_objects: int = 256

    @property
    def spark(self):
        return self.evidence.sparkSession

    def rules(self, kind: str, *params: str, kinds: dict[str, str] | None = None) -> DataFrame:
        """(rule_id, match_ix, parameters) of one kind; absent parameters are null."""
        kinds = kinds or {}
        rows = [(r["id"], ix, *[m.get(p) for p in params]) for ix, r, m in self.policy.matches(kind)]
        ddl = ", ".join(["rule_id string", "match_ix int", *[f"`{p}` {kinds.get(p, 'string')}" for p in params]])
        return F.broadcast(local_frame(self.spark, rows, ddl))  # some of the policy's rules

    def entries(self, table: str) -> DataFrame:
        return F.broadcast(self.policy.frame(self.spark, table).withColumnRenamed("name", "entry"))  # a policy table

    def limit(self) -> int:
        return self.policy.limits["max_evidence_chars"]


MATCHERS: dict[str, Callable[[Context], DataFrame]] = {}


def register(kind: str):
    """Add or replace the matcher of a kind: a function from Context to hits."""

    def add(f):
        MATCHERS[kind] = f
        return f

    return add


_ENTRY = {"severity": "severity", "verdict": "verdict", "needs_human_review": "needs_human_review", "relation": "relation", "basis": "basis", "family": "family"}


def hits(
    df: DataFrame,
    subject: Column | None,
    kind: str,
    path: Column,
    evidence: Column,
    line: Column | None = None,
    order: Column | None = None,
    inherit: Column | bool = False,
    family: Column | None = None,
    suppressed: Column | None = None,
    limit: int = 200
) -> DataFrame:
    """Rows as hits.  Inherited attributes are the entry's columns where `inherit` holds."""
    when = F.lit(inherit) if isinstance(inherit, bool) else inherit
    own = {c: F.when(when, F.col(c)) if inherit is not False else F.lit(None) for c in _ENTRY}
    if family is not None:
        own["family"] = family
    own["basis"] = F.when(F.size(own["basis"]) > 0, own["basis"]) if inherit is not False else F.lit(None)
    columns = {
        "wheel_id": F.col("wheel_id"), "rule_id": F.col("rule_id"), "match_ix": F.col("match_ix"), "hit_ix": order if order is not None else F.lit(0),
        "subject": subject if subject is not None else F.lit(None), "subject_kind": F.lit(kind), "path": path, "line": line if line is not None else F.lit(None),
        "evidence": T.clean(evidence, limit), **own, "suppressed_by": suppressed if suppressed is not None else F.array(),
    }
    return df.select(*[columns[name].cast(kind).alias(name) for name, kind in HIT.items()])


def _repr(x: Column) -> Column:
    """A text between quotes, as Python shows it: double ones if it has only single ones."""
    slashed = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    plain = F.concat(F.lit("'"), F.replace(slashed, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), F.concat(F.lit('"'), slashed, F.lit('"'))).otherwise(plain)


def _named(name: Column, version: Column) -> Column:
    return F.concat(name, F.coalesce(F.concat(F.lit(" "), version), F.lit("")))


def _meta(c: Context) -> DataFrame:
    return c.evidence.where("metadata is not null").select("wheel_id", "filename", "metadata.*")


def _objects(c: Context, *fields: str) -> DataFrame:
    return L.objects(c.evidence).select("wheel_id", "filename", "object_ix", F.col("b.path").alias("path"), *[F.col(f"b.{f}").alias(f) for f in fields])


def _place(df_order: Column, pos: Column) -> Column:
    return df_order.cast("bigint") * 1_000_000 + pos


def _file(info: Column, name: str) -> Column:
    return F.concat(info, F.lit(f"/{name}"))


#: The sentences that the matchers below put together as evidence (`Requires-Dist: `,
#: `DT_NEEDED=`, `cargo path for `, ... `linkage resolved to `) are part of the record's contract.

# -- metadata ----------------------------------------------------------------------


@register("dist_name")
def dist_name(c: Context) -> DataFrame:
    d = c.entries("crypto_distribution")
    rows = _meta(c).drop("name").withColumn("name", F.col("canonical_name")).join(d, F.col("canonical_name") == F.col("entry")).join(c.rules("dist_name"), F.col("rule_id") == F.col("owner"))
    return hits(rows, F.col("entry"), "distribution", F.coalesce("dist_info_dir", "filename"), _named(F.col("entry"), F.col("version")), inherit=True)


@register("requires_dist")
def requires_dist(c: Context) -> DataFrame:
    rows = _meta(c).select("wheel_id", "filename", "dist_info_dir", F.posexplode("requires_dist_names").alias("pos", "dep")).join(c.entries("crypto_distribution"), F.col("dep") == F.col("entry"))
    rows = rows.crossJoin(c.rules("requires_dist", "any_entry", kinds={"any_entry": "boolean"})).where(F.coalesce("any_entry", F.lit(False)) | (F.col("owner") == F.col("rule_id")))
    return hits(
        rows,
        F.col("entry"),
        "distribution",
        F.coalesce(_file(F.col("dist_info_dir"), "METADATA"), F.col("filename")),
        F.concat(F.lit("Requires-Dist: "), F.col("entry")),
        order=F.col("pos"),
        inherit=~F.coalesce("any_entry", F.lit(False)),
        family=F.col("family")
    )


@register("wheel_generator")
def wheel_generator(c: Context) -> DataFrame:
    rows = _meta(c).where("generator_raw <> ''").crossJoin(c.rules("wheel_generator"))
    return hits(rows, F.col("generator_name"), "generator", _file(F.col("dist_info_dir"), "WHEEL"), F.concat(F.lit("Generator: "), F.col("generator_raw")))


@register("no_source")
def no_source(c: Context) -> DataFrame:
    a = F.col("artifacts")
    rows = c.evidence.where(~a["source_available"] & ((a["py_files"] > 0) | (a["pyc_files"] > 0))).crossJoin(c.rules("no_source"))
    said = F.when(
        a["py_files"] > 0,
        F.concat(a["py_files_unparsed"].cast("string"), F.lit(" of "), a["py_files"].cast("string"), F.lit(" source files unparsed"))
    ).otherwise(F.concat(a["pyc_files"].cast("string"), F.lit(" bytecode files, 0 source files")))
    return hits(rows, None, "wheel", F.col("filename"), said)


@register("binaries_truncated")
def binaries_truncated(c: Context) -> DataFrame:
    rows = c.evidence.where(F.size("binaries") > c.max_objects).crossJoin(c.rules("binaries_truncated"))
    return hits(rows, None, "wheel", F.col("filename"), F.concat(F.size("binaries").cast("string"), F.lit(" native objects evaluated, binaries[] is capped")))


@register("record_mismatch")
def record_mismatch(c: Context) -> DataFrame:
    rows = _meta(c).select("wheel_id", F.posexplode("record_mismatches").alias("pos", "path")).crossJoin(c.rules("record_mismatch"))
    return hits(rows, None, "member", F.col("path"), F.lit("not reconciled with RECORD"), order=F.col("pos"))


@register("scan_error")
def scan_error(c: Context) -> DataFrame:
    rows = c.evidence.select("wheel_id", "filename", F.posexplode("errors").alias("pos", "e")).crossJoin(c.rules("scan_error", "error_kinds", kinds={"error_kinds": "array<string>"})).where(F.array_contains("error_kinds", F.col("e.kind")))
    return hits(rows, None, "error", F.coalesce("e.path", "filename"), F.concat("e.kind", F.lit(": "), "e.message"), order=F.col("pos"))


@register("sbom_component")
def sbom_component(c: Context) -> DataFrame:
    comp = c.evidence.select("wheel_id", F.posexplode("sbom").alias("pos", "s")).withColumns({
        "library_key": T.sbom_library_key("s.name"),
        "crate_key": T.sbom_crate_key("s.name"),
        "dist_key": T.canonical_name("s.name"),
        "cargo": F.coalesce(F.startswith("s.purl", F.lit("pkg:cargo/")), F.lit(False))
    })
    p, spark = c.policy, c.spark
    for table, key, fold in (("crypto_library", "library_key", T.sbom_library_key), ("rust_crate", "crate_key", T.sbom_crate_key), ("crypto_distribution", "dist_key", T.canonical_name)):
        d = p.frame(spark, table)
        side = d.select(fold("name").alias(f"{table}_k"), F.struct(*d.columns, F.lit(table).alias("table")).alias(table))
        comp = comp.join(F.broadcast(side), F.col(key) == F.col(f"{table}_k"), "left")  # a policy table
    crate_first = F.coalesce("rust_crate", "crypto_library", "crypto_distribution")
    comp = comp.withColumn("hit", F.when(F.col("cargo"), crate_first).otherwise(F.coalesce("crypto_library", "rust_crate", "crypto_distribution"))).where("hit is not null")
    rows = comp.select("wheel_id", "pos", "s", "hit.*").crossJoin(c.rules("sbom_component"))
    by = F.when(F.col("table") == "rust_crate", F.transform("suppressed_by", lambda x: F.struct(x.alias("rule_id"), F.col("s.name").alias("subject"))))
    return hits(rows, F.col("s.name"), "component", F.col("s.source"), F.concat(F.lit("SBOM component "), _named(F.col("s.name"), F.col("s.version"))), order=F.col("pos"), inherit=True, suppressed=F.coalesce(by, F.array()))


# -- objects -----------------------------------------------------------------------


def _sonames(c: Context) -> DataFrame:
    """soname -> library; a soname of several belongs to the first by name."""
    rows: dict[str, str] = {}
    for x in sorted(c.policy.entries("crypto_library"), key=lambda x: x["name"]):
        for s in x["sonames"]:
            rows.setdefault(s, x["name"])
    return F.broadcast(local_frame(c.spark, sorted(rows.items()), "known string, library string"))  # some fifty sonames


_LIBRARY_RULE = ("library", "exclude_libraries")
_KINDS = {
    "exclude_libraries": "array<string>",
    "mangled": "boolean",
    "resolved": "boolean",
    "groups": "array<string>",
    "values": "array<string>",
    "object_values": "array<string>",
    "exclude_object_values": "array<string>",
    "sbom_declared": "boolean",
    "reasons": "array<string>",
    "exclude_reasons": "array<string>"
}


def _library_ok() -> Column:
    return F.coalesce(F.col("m.library") == F.col("library"), F.lit(True)) & ~F.coalesce(F.array_contains("m.exclude_libraries", F.col("library")), F.lit(False))


def _as_match(df: DataFrame) -> DataFrame:
    return df.select("rule_id", "match_ix", F.struct(*[x for x in df.columns if x not in ("rule_id", "match_ix")]).alias("m"))


@register("bundled_library")
def bundled_library(c: Context) -> DataFrame:
    rows = _objects(c, "vendored_path", "soname", "matched_strings").where("vendored_path").withColumn("base", T.normalise_soname(F.coalesce("soname", "path"))).join(_sonames(c), F.col("base") == F.col("known"))
    rows = rows.join(c.entries("crypto_library"), F.col("library") == F.col("entry"))
    rows = rows.join(_as_match(c.rules("bundled_library", *_LIBRARY_RULE, kinds=_KINDS)), _library_ok())
    rows = rows.where("owner is null or owner = rule_id")  # an entry without an owner is for any rule (P20)
    groups = local_frame(c.spark, [(x["name"], x.get("string_group")) for x in c.policy.entries("crypto_library")], "lib string, lib_group string")
    rows = rows.join(F.broadcast(groups), F.col("library") == F.col("lib"))  # a policy table
    banner = F.try_element_at(F.filter("matched_strings", lambda s: s["group"] == F.col("lib_group")), F.lit(1))["value"]
    name = F.coalesce(F.concat(F.lit("DT_SONAME="), "soname"), F.concat(F.lit("file "), F.substring_index("path", "/", -1)))
    said = F.concat(name, F.coalesce(F.concat(F.lit("; string="), _repr(banner)), F.lit("")))
    return hits(rows, F.col("library"), "library", F.col("path"), said, order=F.col("object_ix"), inherit=True)


@register("dt_needed")
def dt_needed(c: Context) -> DataFrame:
    rows = c.needed.join(_sonames(c), F.col("base") == F.col("known")).join(c.entries("crypto_library"), F.col("library") == F.col("entry"))
    rows = rows.join(_as_match(c.rules("dt_needed", *_LIBRARY_RULE, "mangled", "resolved", kinds=_KINDS)), _library_ok())
    m = F.col("m.mangled")
    ok = m.isNull() | ((m == F.col("mangled")) & (m | (F.col("posture") == "system")))
    ok &= F.col("m.resolved").isNull() | (F.col("m.resolved") == (~F.col("mangled") & (F.col("posture") == "bundled")))
    inherit = F.coalesce(m, F.lit(False)) | F.coalesce("m.resolved", F.lit(False))
    return hits(rows.where(ok), F.col("library"), "library", F.col("path"), F.concat(F.lit("DT_NEEDED="), "needed"), order=F.col("object_ix"), inherit=inherit, family=F.col("family"))


def _groups(c: Context, kind: str, table: str, *params: str) -> DataFrame:
    rows = [(r["id"], ix, g, *[m.get(p) for p in params], {x["name"]: x["family"] for x in c.policy.entries(table)}.get(g)) for ix, r, m in c.policy.matches(kind) for g in ([m["group"]] if "group" in m else m["groups"])]
    return F.broadcast(local_frame(c.spark, rows, "rule_id string, match_ix int, group string, " + "".join(f"{p} string, " for p in params) + "group_family string"))  # the policy's groups


@register("dynamic_symbol")
def dynamic_symbol(c: Context) -> DataFrame:
    rows = _objects(c, "matched_symbols").select("wheel_id", "object_ix", "path", F.posexplode("matched_symbols").alias("pos", "s")).withColumns({"group": F.col("s.group"), "bound": F.col("s.binding")})
    rows = rows.join(_groups(c, "dynamic_symbol", "symbol_group", "binding"), "group").where("binding is null or binding = 'any' or binding = bound")
    return hits(rows, F.col("group"), "symbol_group", F.col("path"), F.concat("bound", F.lit(" symbol "), "s.name"), order=_place(F.col("object_ix"), F.col("pos")), family=F.col("group_family"))


@register("binary_string")
def binary_string(c: Context) -> DataFrame:
    rows = _objects(c, "matched_strings").select("wheel_id", "object_ix", "path", F.posexplode("matched_strings").alias("pos", "s")).withColumn("group", F.col("s.group"))
    rows = rows.join(_groups(c, "binary_string", "string_group"), "group")
    return hits(rows, F.col("group"), "string_group", F.col("path"), F.concat(F.lit("string="), _repr(F.col("s.value"))), order=_place(F.col("object_ix"), F.col("pos")), family=F.col("group_family"))


@register("rust_crate")
def rust_crate(c: Context) -> DataFrame:
    rows = _objects(c, "rust_crates").select("wheel_id", "object_ix", "path", F.posexplode("rust_crates").alias("pos", "r")).join(c.entries("rust_crate"), F.col("r.name") == F.col("entry")).join(c.rules("rust_crate"), F.col("rule_id") == F.col("owner"))
    by = F.transform("suppressed_by", lambda x: F.struct(x.alias("rule_id"), F.col("entry").alias("subject")))
    return hits(rows, F.col("entry"), "crate", F.col("path"), F.concat(F.lit("cargo path for "), _named(F.col("r.name"), F.col("r.version"))), order=_place(F.col("object_ix"), F.col("pos")), inherit=True, suppressed=by)


@register("linkage")
def linkage(c: Context) -> DataFrame:
    rows_m = [
        (r["id"], ix, "table" in x, x.get("name"), list(x.get("values", [])) or [x["value"]], _list(x.get("exclude_libraries")), _list(x.get("object_values")), _list(x.get("exclude_object_values")), x.get("sbom_declared")) for ix,
        r,
        x in c.policy.matches("linkage")
    ]
    rules = F.broadcast(local_frame(c.spark, rows_m, "rule_id string, match_ix int, inherits boolean, only string, values array<string>, not_in array<string>, object_values array<string>, not_object array<string>, declared boolean"))  # the policy's rules
    by_object = c.postures.groupBy("wheel_id", "library").agg(F.collect_set("posture").alias("postures"))
    confirmed = c.postures.where("posture = 'system'").select("wheel_id", "library", F.explode("object_crates").alias("crate"))
    said = L.declared(c.evidence, c.policy, confirmed).withColumn("is_declared", F.lit(True))
    rows = c.linkage.join(c.evidence.select("wheel_id", "filename"), "wheel_id").join(by_object, ["wheel_id", "library"], "left").join(said, ["wheel_id", "library"], "left")
    rows = rows.join(c.entries("crypto_library"), F.col("library") == F.col("entry"))
    rows = rows.join(rules, F.array_contains("values", F.col("value")) & (F.col("only").isNull() | (F.col("only") == F.col("library"))) & ~F.array_contains(F.coalesce("not_in", F.array().cast("array<string>")), F.col("library")))
    rows = rows.where("declared is null or declared = coalesce(is_declared, false)")
    wheel = rows.where("object_values is null").where(~F.coalesce(F.arrays_overlap("postures", "not_object"), F.lit(False)))
    a = hits(wheel, F.col("library"), "library", F.col("filename"), F.concat("library", F.lit(" linkage resolved to "), "value"), inherit=F.col("inherits"))
    objects = rows.where("object_values is not null").join(c.postures.select("wheel_id", "library", "object_ix", "path", "posture"), ["wheel_id", "library"]).where(F.array_contains("object_values", F.col("posture")))
    b = hits(objects, F.col("library"), "library", F.col("path"), F.concat("library", F.lit(" read "), "posture", F.lit(" on this object; the wheel resolved to "), "value"), order=F.col("object_ix"), inherit=F.col("inherits"))
    return a.unionByName(b)


def _list(x) -> list[str] | None:
    return None if x is None else [x] if isinstance(x, str) else list(x)


@register("opaque_binary")
def opaque_binary(c: Context) -> DataFrame:
    rows = L.objects(c.evidence).where(L.opaque(F.col("b"))).crossJoin(c.rules("opaque_binary"))
    return hits(rows, None, "object", F.col("b.path"), F.lit("no dependencies, no symbols, no readable strings"), order=F.col("object_ix"))


@register("partial_binary")
def partial_binary(c: Context) -> DataFrame:
    rows_m = [(r["id"], ix, _list(m.get("reasons")), _list(m.get("exclude_reasons"))) for ix, r, m in c.policy.matches("partial_binary")]
    rules = F.broadcast(local_frame(c.spark, rows_m, "rule_id string, match_ix int, reasons array<string>, exclude_reasons array<string>"))  # two rules
    rows = _objects(c, "format", "partial_analysis", "partial_reasons").where("partial_analysis").crossJoin(rules)
    rest = F.array_except("partial_reasons", F.coalesce("exclude_reasons", F.array().cast("array<string>")))
    told = F.when(F.col("reasons").isNotNull(), F.array_intersect("partial_reasons", "reasons")).otherwise(rest)
    rows = rows.withColumn("told", told).where((F.size("told") > 0) | (F.col("exclude_reasons").isNotNull() & (F.size("partial_reasons") == 0)))
    said = F.concat("format", F.lit(" object was only partially read"), F.when(F.size("told") > 0, F.concat(F.lit(": "), F.array_join("told", ", "))).otherwise(""))
    return hits(rows, F.col("format"), "format", F.col("path"), said, order=F.col("object_ix"))


# -- Python sources ----------------------------------------------------------------


def _sites(c: Context, kind: str) -> DataFrame:
    return c.evidence.select("wheel_id", F.posexplode("py_sites").alias("pos", "s")).where(F.col("s.kind") == kind)


def _site_hits(rows: DataFrame, subject: Column | None, kind: str, **more) -> DataFrame:
    return hits(rows, subject, kind, F.col("s.path"), F.col("s.detail"), line=F.col("s.line"), order=F.col("pos"), **more)


@register("py_import")
def py_import(c: Context) -> DataFrame:
    rows = _sites(c, "py_import").join(c.entries("python_module"), F.col("s.target") == F.col("entry")).join(c.rules("py_import"), F.col("rule_id") == F.col("owner"))
    return _site_hits(rows, F.col("entry"), "module", inherit=True)


@register("py_call")
def py_call(c: Context) -> DataFrame:
    weak = {"refused": c.policy.conventions["refused_hash_algorithms"], "restricted": c.policy.conventions["restricted_hash_algorithms"]}
    weak["weak"] = weak["refused"] + weak["restricted"]
    rows_m = [(r["id"], ix, m.get("targets"), weak.get(m.get("algorithm_list")), m.get("algorithm"), _list(m.get("usedforsecurity"))) for ix, r, m in c.policy.matches("py_call")]
    rules = F.broadcast(local_frame(c.spark, rows_m, "rule_id string, match_ix int, targets array<string>, algorithms array<string>, algorithm string, used array<string>"))  # the policy's rules
    a, t = F.col("s.attrs"), F.col("s.target")
    ok = F.array_contains("targets", t) | F.array_contains("targets", F.concat(F.lit("*."), F.substring_index(t, ".", -1)))
    ok &= F.col("algorithms").isNull() | F.coalesce(F.array_contains("algorithms", a["algorithm"]), F.lit(False))
    ok &= F.col("algorithm").isNull() | F.coalesce(F.col("algorithm") == a["algorithm"], F.lit(False))
    ok &= F.col("used").isNull() | F.coalesce(F.array_contains("used", a["usedforsecurity"]), F.lit(False))
    return _site_hits(_sites(c, "py_call").join(rules, ok), None, "call")


@register("py_attr")
def py_attr(c: Context) -> DataFrame:
    rows_m = [(r["id"], ix, m["attributes"], m.get("values")) for ix, r, m in c.policy.matches("py_attr")]
    rules = F.broadcast(local_frame(c.spark, rows_m, "rule_id string, match_ix int, attributes array<string>, values array<string>"))  # the policy's rules
    ok = F.array_contains("attributes", F.col("s.target")) & (F.col("values").isNull() | F.coalesce(F.array_contains("values", F.col("s.attrs")["value"]), F.lit(False)))
    return _site_hits(_sites(c, "py_attr").join(rules, ok), F.col("s.target"), "attribute")


@register("py_constant")
def py_constant(c: Context) -> DataFrame:
    rules = c.rules("py_constant", "constants", kinds={"constants": "array<string>"})
    return _site_hits(_sites(c, "py_constant").join(rules, F.array_contains("constants", F.col("s.target"))), F.col("s.target"), "constant")


@register("py_ctypes_load")
def py_ctypes_load(c: Context) -> DataFrame:
    return _site_hits(_sites(c, "py_ctypes_load").crossJoin(c.rules("py_ctypes_load")), F.col("s.target"), "library")


# -- all ---------------------------------------------------------------------------


def all_hits(c: Context) -> DataFrame:
    out = None
    for kind in MATCHERS:
        if c.policy.matches(kind):
            part = MATCHERS[kind](c)
            out = part if out is None else out.unionByName(part)
    return out


def unsuppressed(found: DataFrame, policy: Policy) -> DataFrame:
    """Hits that no fired rule suppresses: a rule's suppressors in the same place, an entry's
    in the same place and subject.  All are looked up among the hits as they were (M23)."""
    pairs = [(r["id"], by) for r in policy.entries("rule") for by in r.get("suppressed_by", ())]
    spark = found.sparkSession
    rules = F.broadcast(local_frame(spark, pairs, "rule_id string, by string"))  # the policy's rules
    fired = found.select("wheel_id", F.col("rule_id").alias("by"), "path").distinct()
    out = found.join(fired.join(rules, "by").select("wheel_id", "path", "rule_id").distinct(), ["wheel_id", "path", "rule_id"], "left_anti")
    own = found.select("wheel_id", F.col("rule_id").alias("f_rule"), F.col("subject").alias("f_subject"), F.col("path").alias("f_path")).distinct()
    listed = found.where(F.size("suppressed_by") > 0).select("wheel_id", "rule_id", "subject", "path", F.explode("suppressed_by").alias("x"))
    silent = listed.join(
        own.withColumnRenamed("wheel_id", "w"),
        (F.col("wheel_id") == F.col("w")) & (F.col("f_rule") == F.col("x.rule_id")) & F.col("f_subject").eqNullSafe(F.col("x.subject")) & (F.col("f_path") == F.col("path"))
    ).select("wheel_id", "rule_id", F.col("subject").alias("s_subject"), F.col("path").alias("s_path")).distinct()
    return out.join(
        silent.withColumnsRenamed({"wheel_id": "w", "rule_id": "r"}),
        (F.col("wheel_id") == F.col("w")) & (F.col("rule_id") == F.col("r")) & F.col("subject").eqNullSafe(F.col("s_subject")) & (F.col("path") == F.col("s_path")),
        "left_anti"
    )
