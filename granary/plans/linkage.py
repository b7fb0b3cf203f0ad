"""How each library is linked: postures of objects and the wheel's answer, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import relational as R
from granary.operators.evidence import costs_an_answer
from granary.plans.policy import Policy, local_frame


def _own_stem(soname: Column, path: Column) -> Column:
    return T.reduce_soname(F.coalesce(soname, path))


def objects(evidence: DataFrame) -> DataFrame:
    """(wheel_id, filename, object_ix, b struct) of every native object."""
    return evidence.select("wheel_id", "filename", F.posexplode("binaries").alias("object_ix", "b"))


def opaque(b: Column) -> Column:
    """P6 on an object's struct."""
    count = F.when(b["format"] == "elf", b["dynsym_count"]).otherwise(b["symtab_count"])
    return (F.size(b["needed"]) == 0) & (F.size(b["matched_symbols"]) == 0) & (F.size(b["matched_strings"]) == 0) & (F.size(b["rust_crates"]) == 0) & (count == 0)


def incompletely_read() -> Column:
    """Whether a wheel has members that were not read, links, or objects with errors."""
    a = F.col("artifacts")
    return (F.size(a["skipped"]) > 0) | (F.size(a["symlinks"]) > 0) | F.exists("errors", lambda e: e["stage"] == "binary")


def needed(evidence: DataFrame, policy: Policy) -> DataFrame:
    """(wheel_id, object_ix, path, needed, base, mangled, posture) of every dependency (L1, L2)."""
    globs = policy.conventions["vendor_dir_globs"]
    obj = objects(evidence).select(
        "wheel_id",
        "object_ix",
        F.col("b.path").alias("path"),
        _own_stem(F.col("b.soname"), F.col("b.path")).alias("own"),
        F.col("b.from_archive").alias("from_archive"),
        F.concat("b.rpath", "b.runpath").alias("rpaths"),
        F.col("b.needed").alias("all_needed")
    )
    stems = obj.where(~F.col("from_archive")).groupBy("wheel_id", F.col("own").alias("stem")).agg(F.count("*").alias("n"))
    unread = evidence.select("wheel_id", incompletely_read().alias("unread"))
    rows = obj.select("wheel_id", "object_ix", "path", "own", "from_archive", "rpaths", F.explode("all_needed").alias("needed")).withColumn("stem", T.reduce_soname("needed"))
    rows = rows.join(stems, ["wheel_id", "stem"], "left").join(unread, "wheel_id")
    inside = F.coalesce("n", F.lit(0)) > F.when((F.col("own") == F.col("stem")) & ~F.col("from_archive"), 1).otherwise(0)
    vendored = T.is_vendor_path("needed", globs) | F.exists("rpaths", lambda r: T.is_vendor_path(F.concat(F.rtrim(r, F.lit("/")), F.lit("/"), F.col("needed")), globs))
    posture = F.when(T.is_mangled("needed"), "bundled").when(F.startswith("needed", F.lit("/")), "system").when(inside, "bundled").when(F.col("unread") & vendored, "unknown").otherwise("system")
    return rows.select("wheel_id", "object_ix", "path", "needed", T.normalise_soname("needed").alias("base"), T.is_mangled("needed").alias("mangled"), posture.alias("posture"))


def library_frame(spark, policy: Policy) -> DataFrame:
    groups = {g["name"]: g["substrings"] for g in policy.entries("string_group")}
    rows = [(
        x["name"],
        x["sonames"],
        x.get("symbol_group"),
        x.get("string_group"),
        x.get("copy_string_group"),
        x.get("crates", []),
        x.get("fork_symbol_groups", []),
        x.get("fork_string_groups", []),
        [s for g in x.get("fork_string_groups", []) for s in groups[g]],
        x["always_report"]
    ) for x in policy.entries("crypto_library")]
    return local_frame(
        spark,
        rows,
        "library string, sonames array<string>, symbol_group string, string_group string, copy_group string, crates array<string>, fork_symbols array<string>, fork_strings array<string>, fork_texts array<string>, always_report boolean"
    )


def postures(evidence: DataFrame, deps: DataFrame, policy: Policy) -> DataFrame:
    """(wheel_id, object_ix, path, library, posture) of every object and library."""
    libs = library_frame(evidence.sparkSession, policy)
    by_object = deps.groupBy("wheel_id", "object_ix").agg(F.collect_list(F.struct("base", "posture")).alias("deps"))
    # the libraries are the policy's thirteen
    rows = objects(evidence).select("wheel_id", "object_ix", "b").join(by_object, ["wheel_id", "object_ix"], "left").crossJoin(F.broadcast(libs))
    b, c = F.col("b"), F.col
    found = F.filter(F.coalesce("deps", F.array()), lambda d: F.array_contains(c("sonames"), d["base"]))
    has = lambda p: F.exists(found, lambda d: d["posture"] == p)
    symbol = lambda binding: F.exists(b["matched_symbols"], lambda s: (s["group"] == c("symbol_group")) & (s["binding"] == binding))
    text = lambda group: F.exists(b["matched_strings"], lambda s: s["group"] == group)
    own = T.normalise_soname(F.coalesce(b["soname"], b["path"]))
    flags = rows.withColumns({
        "own": b["vendored_path"] & F.array_contains("sonames", own),
        "system": has("system"),
        "bundled": has("bundled"),
        "uncertain": has("unknown"),
        "defined": F.coalesce(symbol("defined"), F.lit(False)),
        "imported": F.coalesce(symbol("imported"), F.lit(False)),
        "seen": F.coalesce(text(c("string_group")), F.lit(False))
    })
    lacks = c("copy_group").isNotNull() & ~b["partial_analysis"] & ~F.coalesce(text(c("copy_group")), F.lit(False))
    flags = flags.withColumn("lacks", lacks).withColumn("alone", c("seen") & ~(c("system") | c("bundled") | c("uncertain")) & c("lacks"))
    flags = flags.withColumn("banner", c("seen") & ~c("alone") & ~((c("system") | c("bundled")) & c("lacks") & c("imported")))
    flags = flags.withColumn("static", c("defined") | c("banner"))
    banners = F.filter(b["matched_strings"], lambda s: s["group"] == c("string_group"))
    fork_text = (F.size(banners) > 0) & F.forall(banners, lambda s: F.exists("fork_texts", lambda t: F.contains(s["value"], t)))
    fork = F.exists(b["matched_symbols"], lambda s: F.array_contains(c("fork_symbols"), s["group"]) & (s["binding"] == "defined")) | F.exists(b["matched_strings"], lambda s: F.array_contains(c("fork_strings"), s["group"]))
    count = c("system").cast("int") + c("bundled").cast("int") + c("static").cast("int")
    posture = (
        F.when(c("own"), "bundled")
        .when(count > 1, "mixed")
        .when(c("system"), "system")
        .when(c("bundled"), "bundled")
        .when(c("uncertain") & c("static"), "mixed")
        .when(c("uncertain"), "unknown")
        .when(c("static") & fork & ~(c("banner") & ~F.coalesce(fork_text, F.lit(False))), "unknown")
        .when(c("static"), "static")
        .when(c("alone") | c("imported"), "unknown")
        .when(F.exists(b["rust_crates"], lambda r: F.array_contains(c("crates"), r["name"])), "unknown")
        .otherwise("none")
    )
    return flags.select("wheel_id", "object_ix", b["path"].alias("path"), "library", posture.alias("posture"), F.transform(b["rust_crates"], lambda r: r["name"]).alias("object_crates"))


def declared(evidence: DataFrame, policy: Policy, confirmed: DataFrame | None = None) -> DataFrame:
    """(wheel_id, library) that an SBOM names, by library or by a crate that binds it.
    With confirmed (wheel_id, library, crate), components carried by a system object do not
    count."""
    spark = evidence.sparkSession
    comp = evidence.select("wheel_id", F.explode("sbom").alias("c")).select(
        "wheel_id",
        T.sbom_library_key("c.name").alias("library_key"),
        T.sbom_crate_key("c.name").alias("crate_key"),
        F.coalesce(F.startswith("c.purl", F.lit("pkg:cargo/")), F.lit(False)).alias("cargo")
    )
    crates = {c["name"] for c in policy.entries("rust_crate")}
    # a name that is both a library's and a foreign crate's is the library's unless it came from cargo
    rows = [(x["name"], x["name"].lower(), x["name"] in crates and x["name"] not in x.get("crates", []), False) for x in policy.entries("crypto_library")]
    rows += [(x["name"], c.lower().replace("_", "-"), False, True) for x in policy.entries("crypto_library") for c in x.get("crates", [])]
    keys = local_frame(spark, rows, "library string, key string, shared boolean, by_crate boolean")
    hit = comp.join(F.broadcast(keys), ((F.col("key") == F.col("library_key")) & ~F.col("by_crate") & ~(F.col("shared") & F.col("cargo"))) | ((F.col("key") == F.col("crate_key")) & F.col("by_crate")))
    if confirmed is not None:
        hit = hit.join(confirmed.select("wheel_id", "library", T.sbom_crate_key("crate").alias("crate_key")).distinct(), ["wheel_id", "library", "crate_key"], "left_anti")
    return hit.select("wheel_id", "library").distinct()


def unanswered(evidence: DataFrame, policy: Policy) -> DataFrame:
    """(wheel_id, unanswered): whether some object did not say how it is linked."""
    costly = F.exists("binaries", lambda b: opaque(b) | (b["partial_analysis"] & ((F.size(b["partial_reasons"]) == 0) | costs_an_answer(b["partial_reasons"], policy.exempt_reasons))))
    return evidence.select("wheel_id", (costly | F.exists("errors", lambda e: e["stage"] == "binary")).alias("unanswered"))


def resolve(evidence: DataFrame, found: DataFrame, policy: Policy) -> DataFrame:
    """(wheel_id, library, value): one answer a wheel and library; `none` only where it is
    always reported (A5, A6, L8)."""
    libs = library_frame(evidence.sparkSession, policy).select("library", "always_report")
    base = unanswered(evidence, policy).crossJoin(F.broadcast(libs))
    sets = found.groupBy("wheel_id", "library").agg(F.collect_set("posture").alias("seen"))
    said = declared(evidence, policy).withColumn("said", F.lit(True))
    out = base.join(sets, ["wheel_id", "library"], "left").join(said, ["wheel_id", "library"], "left")
    extra = F.when((F.col("unanswered") & F.col("always_report")) | F.coalesce("said", F.lit(False)), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    value = R.posture_of(F.concat(F.coalesce("seen", F.array().cast("array<string>")), extra))
    return out.select("wheel_id", "library", value.alias("value"), "always_report").where((F.col("value") != "none") | F.col("always_report")).select("wheel_id", "library", "value")
