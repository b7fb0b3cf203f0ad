"""The engine over wheels with awkward objects, each answer in closed form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans import linkage as L
from granary.plans import scan as S
from granary.sources import synthetic_objects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SCANS: dict[tuple[str, str], S.Scan] = {}

#: Pieces of the SQL: a wheel's name, its own file, and all keys of a shape.
_WHEEL = "'odd' || p_partkey || '-1.0-py3-none-any.whl'"
_INFO = "'odd' || p_partkey || '-1.0.dist-info/'"
_EXT = "'odd' || p_partkey || '/_ext.so'"
_MANY = "p_partkey % 160 = 6"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _scan(spark: SparkSession, d: str) -> S.Scan:
    """One scan of a folder's corpus a session."""
    key = spark.sparkContext.applicationId, d
    if key not in _SCANS:
        _SCANS[key] = S.Scan(synthetic_objects.corpus(spark.read.parquet(f"{d}/part.parquet")))
    return _SCANS[key]


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).evidence.select("key", F.explode("binaries").alias("b"))


def _by_key(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return _scan(spark, d).evidence.select("key", "wheel_id").join(rows, "wheel_id")


def _places(spark: SparkSession, d: str, *rules: str) -> DataFrame:
    found = _by_key(spark, d, _scan(spark, d).findings.where(F.col("rule_id").isin(*rules)))
    return found.select("key", "rule_id", "subject", F.explode("locations").alias("p")).select("key", "rule_id", "subject", "p.path", "p.evidence")


def _joined(c) -> F.Column:
    return F.array_join(c, ",")


# -- archive and errors ------------------------------------------------------------


@query(
    "g1_all_errors",
    f"""SELECT p_partkey AS key, stage, kind, CASE f WHEN 'sbom' THEN {_INFO} || 'sboms/b.json' ELSE 'odd' || p_partkey || '/' || f END AS path
    FROM part, (VALUES (15, 'archive', 'compression_ratio_exceeded', 'bomb.so'), (15, 'archive', 'duplicate_member', 'twice.txt'), (15, 'metadata', 'sbom_parse_error', 'sbom'),
    (15, 'python', 'python_syntax_error', 'bad.py'), (8, 'binary', 'elf_parse_error', '_ext.so'), (9, 'binary', 'elf_parse_error', '_ext.so'), (10, 'binary', 'elf_parse_error', '_ext.so'),
    (11, 'binary', 'elf_parse_error', '_ext.so')) v(s, stage, kind, f) WHERE p_partkey % 16 = s AND NOT (s = 11 AND p_partkey % 32 = 11)""",
)
def g1(spark, d):
    """Errors of the archive, metadata, objects and sources of every wheel (G1)."""
    return _scan(spark, d).evidence.select("key", F.explode("errors").alias("e")).select("key", "e.stage", "e.kind", "e.path")


@query("o5_error_order", "SELECT p_partkey AS key, 'archive/compression_ratio_exceeded,archive/duplicate_member,metadata/sbom_parse_error,python/python_syntax_error' AS errors FROM part WHERE p_partkey % 16 = 15")
def o5(spark, d):
    """Errors are distinct and sorted."""
    said = F.transform("errors", lambda e: F.concat(e["stage"], F.lit("/"), e["kind"]))
    return _scan(spark, d).evidence.where("size(errors) > 1").select("key", _joined(said).alias("errors"))


@query(
    "s11_symlinks",
    f"SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 14 THEN 'odd' || p_partkey || '.libs/libcrypto.so.3' ELSE 'odd' || p_partkey || '/link' END AS path, CASE p_partkey % 16 WHEN 14 THEN '../elsewhere' ELSE 'target' END AS target FROM part WHERE p_partkey % 16 IN (14, 15)"
)
def s11(spark, d):
    return _scan(spark, d).evidence.select("key", F.explode("artifacts.symlinks").alias("l")).select("key", "l.path", "l.target")


@query("c3_skipped_members", "SELECT p_partkey AS key, 'odd' || p_partkey || '/' || f AS path, reason FROM part, (VALUES ('bomb.so', 'compression_ratio_exceeded'), ('twice.txt', 'duplicate_member')) v(f, reason) WHERE p_partkey % 16 = 15")
def c3(spark, d):
    return _scan(spark, d).evidence.select("key", F.explode("artifacts.skipped").alias("s")).select("key", "s.path", "s.reason")


@query(
    "y1_unparsed_sources",
    "SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 13 THEN 2 WHEN 15 THEN 2 ELSE 1 END::BIGINT AS py_files, CASE p_partkey % 16 WHEN 15 THEN 1 ELSE 0 END::BIGINT AS unparsed, true AS source_available FROM part"
)
def y1(spark, d):
    return _scan(spark, d).evidence.select("key", "artifacts.py_files", F.col("artifacts.py_files_unparsed").alias("unparsed"), "artifacts.source_available")


@query(
    "m7_error_rules",
    f"""SELECT p_partkey AS key, rule_id, CASE f WHEN 'sbom' THEN {_INFO} || 'sboms/b.json' ELSE 'odd' || p_partkey || '/' || f END AS path FROM part,
    (VALUES (15, 'PY_UNREADABLE', 'bad.py'), (15, 'SBOM_UNREADABLE', 'sbom'), (15, 'WHEEL_ARCHIVE_ANOMALY', 'twice.txt'), (15, 'WHEEL_MEMBER_UNREADABLE', 'bomb.so'),
    (8, 'BIN_UNPARSEABLE', '_ext.so'), (9, 'BIN_UNPARSEABLE', '_ext.so'), (10, 'BIN_UNPARSEABLE', '_ext.so'), (11, 'BIN_UNPARSEABLE', '_ext.so')) v(s, rule_id, f)
    WHERE p_partkey % 16 = s AND NOT (s = 11 AND p_partkey % 32 = 11)""",
)
def m7(spark, d):
    return _places(spark, d, "PY_UNREADABLE", "SBOM_UNREADABLE", "WHEEL_ARCHIVE_ANOMALY", "WHEEL_MEMBER_UNREADABLE", "BIN_UNPARSEABLE").select("key", "rule_id", "path")


# -- decoders ----------------------------------------------------------------------


@query(
    "s13_objects",
    f"""SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 2 THEN 'odd' || p_partkey || '/Bin/tool' WHEN 4 THEN 'odd' || p_partkey || '/bin/tool' WHEN 5 THEN 'odd' || p_partkey || '/_ext.dylib' ELSE {_EXT} END AS path,
    CASE p_partkey % 16 WHEN 5 THEN 'macho' WHEN 7 THEN 'unknown' ELSE 'elf' END AS format FROM part WHERE p_partkey % 16 IN (0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 14)
    UNION ALL SELECT p_partkey, 'odd' || p_partkey || '/part' || lpad(i::VARCHAR, 3, '0') || '.so', 'unknown' FROM part, range({synthetic_objects.MANY}) r(i) WHERE {_MANY}""",
)
def s13(spark, d):
    """Which members are native objects, folder names without regard to case."""
    return _objects(spark, d).select("key", "b.path", "b.format")


@query("w2_crate_cap", "SELECT p_partkey AS key, 128 AS crates, true AS has_ring, true AS truncated, '0.17.8' AS ring_version FROM part WHERE p_partkey % 16 = 0")
def w2(spark, d):
    """Two hundred crates before `ring` in order: those that the policy names come first."""
    ring = F.try_element_at(F.filter("b.rust_crates", lambda r: r["name"] == "ring"), F.lit(1))
    return _objects(spark, d).where("size(b.rust_crates) > 100").select(
        "key",
        F.size("b.rust_crates").alias("crates"),
        ring.isNotNull().alias("has_ring"),
        F.col("b.strings_truncated").alias("truncated"),
        ring["version"].alias("ring_version")
    )


@query("n27_nested_vendor", "SELECT p_partkey AS key, name, version FROM part, (VALUES ('bar', '1.0.0'), ('baz', '2.0.0'), ('ring', '-')) v(name, version) WHERE p_partkey % 16 = 1")
def n27(spark, d):
    """A vendor folder inside a registry crate is that crate's; one after other text is not."""
    rows = _objects(spark, d).where("size(b.rust_crates) < 100").select("key", F.explode("b.rust_crates").alias("r"))
    return rows.select("key", "r.name", F.coalesce("r.version", F.lit("-")).alias("version"))


@query("n28_go_program", "SELECT p_partkey AS key, 'go1.22.3' AS go_version, false AS boring_crypto, 'go_stock_crypto' AS markers FROM part WHERE p_partkey % 16 = 4")
def n28(spark, d):
    """Go build info and markers."""
    return _objects(spark, d).where("b.go is not null").select("key", "b.go.go_version", "b.go.boring_crypto", _joined("b.go.markers").alias("markers"))


@query(
    "n13_fat_slices",
    "SELECT p_partkey AS key, 'arm64' AS machine, '@rpath/me.dylib' AS soname, '/usr/lib/libSystem.B.dylib,/usr/lib/libcrypto.dylib' AS needed, 2::BIGINT AS symtab_count, 'EVP_x:imported,MD5_y:defined' AS symbols FROM part WHERE p_partkey % 16 = 5"
)
def n13(spark, d):
    """Slices of a universal library, merged."""
    names = F.array_sort(F.transform("b.matched_symbols", lambda s: F.concat_ws(":", s["name"], s["binding"])))
    return _objects(spark, d).where("b.format = 'macho'").select("key", "b.machine", "b.soname", _joined("b.needed").alias("needed"), "b.symtab_count", _joined(names).alias("symbols"))


@query(
    "n23_partial_reasons",
    f"""SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 7 THEN 'no_structural_reader' WHEN 8 THEN 'elf_section_table_absent' WHEN 9 THEN 'elf_symtab_unread,symtab_understates_rows'
    WHEN 10 THEN 'elf_dynsym_unread,symtab_understates_rows' ELSE 'elf_section_data_unread' END AS reasons, 1::BIGINT AS objects FROM part
    WHERE p_partkey % 16 IN (7, 8, 9, 10) OR p_partkey % 32 = 27 UNION ALL SELECT p_partkey, 'no_structural_reader', {synthetic_objects.MANY} FROM part WHERE {_MANY}""",
)
def n23(spark, d):
    """Objects that do not say all: no format, no section table, a decoy string table (N7), fewer
    rows than names (N23), a section that claims a terabyte (N8)."""
    return _objects(spark, d).where("b.partial_analysis").groupBy("key", _joined("b.partial_reasons").alias("reasons")).agg(F.count("*").alias("objects"))


@query(
    "n8_compressed_section",
    """SELECT p_partkey AS key, g AS grp, v AS value FROM part, (VALUES (3, 'boringssl', 'made from BoringSSL sources'), (4, 'go_stock_crypto', 'crypto/sha256.Sum256'), (8, 'openssl_banner', 'OpenSSL 3.0.14 4 Jun 2024'),
    (11, 'openssl_banner', 'OpenSSL 3.0.14 4 Jun 2024'), (11, 'openssl_build_info', 'OPENSSLDIR: "/usr"')) x(s, g, v) WHERE p_partkey % 16 = s AND p_partkey % 32 <> 27""",
)
def n8(spark, d):
    """Strings of all objects; those of shape 11 are in a section that is stored compressed."""
    rows = _objects(spark, d).select("key", F.explode("b.matched_strings").alias("s"))
    return rows.select("key", F.col("s.group").alias("grp"), "s.value")


@query("n32_header_fields", f"SELECT p_partkey AS key, {_EXT} AS path, 'EM_X86_64' AS machine, 64 AS bits, 'ET_DYN' AS elf_type, 'OpenSSL 3.0.14 4 Jun 2024' AS banner FROM part WHERE p_partkey % 16 = 8")
def n32(spark, d):
    """What is left of an object without section table."""
    rows = _objects(spark, d).where(F.array_contains("b.partial_reasons", "elf_section_table_absent"))
    return rows.select("key", "b.path", "b.machine", "b.bits", "b.elf_type", F.col("b.matched_strings")[0]["value"].alias("banner"))


@query("n3_run_paths", "SELECT p_partkey AS key, 'libcrypto.so.3,libssl.so.3' AS needed, '$ORIGIN/../odd' || p_partkey || '.libs' AS runpath FROM part WHERE p_partkey % 16 = 14")
def n3(spark, d):
    return _objects(spark, d).where("size(b.runpath) > 0").select("key", _joined("b.needed").alias("needed"), _joined("b.runpath").alias("runpath"))


@query("y7_python_constants", "SELECT p_partkey AS key, 'odd' || p_partkey || '/net.py' AS path, 2 AS line, 'ssl.PROTOCOL_TLSv1' AS target FROM part WHERE p_partkey % 16 = 13")
def y7(spark, d):
    rows = _scan(spark, d).evidence.select("key", F.explode("py_sites").alias("s")).where("s.kind = 'py_constant'")
    return rows.select("key", "s.path", "s.line", "s.target")


# -- linkage -----------------------------------------------------------------------


@query(
    "l2_vendored_unknown",
    "SELECT p_partkey AS key, n AS needed, CASE p_partkey % 16 WHEN 14 THEN 'unknown' ELSE 'system' END AS posture FROM part, (VALUES (2, 'libcrypto.so.3'), (5, '/usr/lib/libSystem.B.dylib'), (5, '/usr/lib/libcrypto.dylib'), (14, 'libcrypto.so.3'), (14, 'libssl.so.3')) v(s, n) WHERE p_partkey % 16 = s"
)
def l2(spark, d):
    """A dependency by a path into a vendor folder that could not be read is unknown (L1, L2)."""
    return _by_key(spark, d, _scan(spark, d).needed).select("key", "needed", "posture")


@query(
    "l5_fork_posture",
    "SELECT p_partkey AS key, 'openssl' AS library, CASE p_partkey % 16 WHEN 2 THEN 'system' WHEN 3 THEN 'unknown' WHEN 5 THEN 'system' WHEN 14 THEN 'unknown' ELSE 'static' END AS posture FROM part WHERE p_partkey % 16 IN (2, 3, 5, 8, 14) OR p_partkey % 32 = 11"
)
def l5(spark, d):
    """A fork's definitions are not the library's own (L5, L11); copies are told by their banner (L4)."""
    return _by_key(spark, d, _scan(spark, d).postures.where("posture <> 'none'")).select("key", "library", "posture")


@query("l6_declared_by_sbom", "SELECT p_partkey AS key, 'openssl' AS library FROM part WHERE p_partkey % 16 = 12")
def l6(spark, d):
    s = _scan(spark, d)
    return _by_key(spark, d, L.declared(s.evidence, s.policy)).select("key", "library")


@query(
    "l7_wheel_linkage",
    f"""SELECT p_partkey AS key, CASE WHEN p_partkey % 16 IN (2, 5) THEN 'system' WHEN p_partkey % 16 = 8 OR p_partkey % 32 = 11 THEN 'static'
    WHEN p_partkey % 16 IN (3, 7, 9, 10, 11, 12, 14) OR {_MANY} THEN 'unknown' ELSE 'none' END AS value FROM part""",
)
def l7(spark, d):
    """What every wheel says of OpenSSL: unread objects, forks and SBOMs make it unknown."""
    return _by_key(spark, d, _scan(spark, d).linkage.where("library = 'openssl'")).select("key", "value")


@query("p18_left_unanswered", f"SELECT p_partkey AS key, p_partkey % 16 IN (7, 8, 9, 10) OR p_partkey % 32 = 27 OR {_MANY} AS unanswered FROM part")
def p18(spark, d):
    s = _scan(spark, d)
    return _by_key(spark, d, L.unanswered(s.evidence, s.policy)).select("key", "unanswered")


# -- matchers and verdicts ---------------------------------------------------------


@query("m5_binaries_truncated", f"SELECT p_partkey AS key, {_WHEEL} AS path, '{synthetic_objects.MANY} native objects evaluated, binaries[] is capped' AS evidence FROM part WHERE {_MANY}")
def m5(spark, d):
    return _places(spark, d, "WHEEL_BINARIES_TRUNCATED").select("key", "path", "evidence")


@query(
    "m15_opaque_binary",
    f"""SELECT p_partkey AS key, 1::BIGINT AS occurrences, false AS truncated, 1 AS places FROM part WHERE p_partkey % 16 IN (7, 9) OR p_partkey % 32 = 27
    UNION ALL SELECT p_partkey, {synthetic_objects.MANY}, true, 10 FROM part WHERE {_MANY}""",
)
def m15(spark, d):
    """Objects with nothing to read; places are capped, occurrences are not (A2, A3)."""
    found = _scan(spark, d).findings.where("rule_id = 'BIN_OPAQUE'")
    return _by_key(spark, d, found).select("key", F.col("occurrences").cast("bigint").alias("occurrences"), "truncated", F.size("locations").alias("places"))


@query(
    "m16_partial_format",
    f"SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 7 THEN 'unknown' ELSE 'elf' END AS subject, CASE p_partkey % 16 WHEN 7 THEN 'no_structural_reader' WHEN 8 THEN 'elf_section_table_absent' WHEN 9 THEN 'elf_symtab_unread, symtab_understates_rows' WHEN 10 THEN 'elf_dynsym_unread, symtab_understates_rows' ELSE 'elf_section_data_unread' END AS reasons FROM part WHERE p_partkey % 16 IN (7, 8, 9, 10) OR p_partkey % 32 = 27 UNION ALL SELECT p_partkey, 'unknown', 'no_structural_reader' FROM part WHERE {_MANY}"
)
def m16(spark, d):
    rows = _places(spark, d, "BIN_PARTIAL_FORMAT")
    return rows.select("key", "subject", F.substring_index("evidence", ": ", -1).alias("reasons")).distinct()


@query("m20_py_constant", "SELECT p_partkey AS key, 'ssl.PROTOCOL_TLSv1' AS subject, 'odd' || p_partkey || '/net.py' AS path FROM part WHERE p_partkey % 16 = 13")
def m20(spark, d):
    return _places(spark, d, "PY_LEGACY_TLS_PROTOCOL").select("key", "subject", "path")


@query("m14_linkage_unknown", f"SELECT p_partkey AS key, {_WHEEL} AS path, 'openssl linkage resolved to unknown' AS evidence FROM part WHERE p_partkey % 16 IN (3, 7, 9, 10, 12, 14) OR p_partkey % 32 = 27 OR {_MANY}")
def m14(spark, d):
    return _places(spark, d, "BIN_OPENSSL_LINKAGE_UNKNOWN").select("key", "path", "evidence")


@query(
    "f29_basis",
    "SELECT p_partkey AS key, r AS rule_id, b AS basis FROM part, (VALUES (0, 'BIN_RUST_CRYPTO_CRATE', 'FIPS-140-3'), (2, 'BIN_NEEDED_SYSTEM_OPENSSL', ''), (3, 'BIN_BORINGSSL', 'FIPS-140-3'), (5, 'BIN_OWN_WEAK_HASH_IMPL', 'FIPS-180-4'), (13, 'PY_LEGACY_TLS_PROTOCOL', 'SP-800-52-r2')) v(s, r, b) WHERE p_partkey % 16 = s UNION ALL SELECT p_partkey, 'BIN_RUST_CRYPTO_CRATE', 'FIPS-140-3' FROM part WHERE p_partkey % 16 = 1 UNION ALL SELECT p_partkey, 'BIN_NEEDED_SYSTEM_OPENSSL', '' FROM part WHERE p_partkey % 16 = 5"
)
def f29(spark, d):
    """An entry's basis, or its rule's where it has none."""
    rules = ("BIN_RUST_CRYPTO_CRATE", "BIN_NEEDED_SYSTEM_OPENSSL", "BIN_BORINGSSL", "BIN_OWN_WEAK_HASH_IMPL", "PY_LEGACY_TLS_PROTOCOL")
    found = _scan(spark, d).findings.where(F.col("rule_id").isin(*rules))
    return _by_key(spark, d, found).select("key", "rule_id", _joined("basis").alias("basis"))


_CLASS = f"""CASE WHEN p_partkey % 16 IN (0, 1, 3, 4, 5) THEN 'NON_APPROVED_CRYPTO' WHEN p_partkey % 16 IN (2, 8, 12, 13) OR p_partkey % 32 = 11 THEN 'CONDITIONAL'
    WHEN p_partkey % 16 IN (7, 9, 10, 11, 14, 15) OR {_MANY} THEN 'OPAQUE' ELSE 'NO_CRYPTO_DETECTED' END"""


@query("c6_verdicts", f"SELECT {_WHEEL} AS filename, {_CLASS} AS class, {_CLASS} <> 'NO_CRYPTO_DETECTED' AS needs_human_review FROM part")
def c6(spark, d):
    """The verdict as the canonical line has it."""
    line = lambda path: F.get_json_object("line", path)
    return _scan(spark, d).records().select("filename", line("$.verdict.class").alias("class"), line("$.verdict.needs_human_review").cast("boolean").alias("needs_human_review"))


@query(
    "o11_record_cap",
    f"SELECT {_WHEEL} AS filename, CASE WHEN {_MANY} THEN {S.RECORD_ROWS} WHEN p_partkey % 16 IN (6, 12, 13, 15) THEN 0 ELSE 1 END AS objects, {_MANY} AS truncated FROM part",
)
def o11(spark, d):
    """Records list a bounded number of objects and say so."""
    r = _scan(spark, d).records()
    names = F.from_json(F.get_json_object("line", "$.binaries"), "array<struct<path: string>>")
    return r.select("filename", F.size(names).alias("objects"), F.get_json_object("line", "$.artifacts.binaries_truncated").cast("boolean").alias("truncated"))


@query(
    "c7_record_errors",
    f"SELECT {_WHEEL} AS filename, CASE WHEN p_partkey % 16 = 15 THEN 4 WHEN p_partkey % 16 IN (8, 9, 10) OR p_partkey % 32 = 27 THEN 1 ELSE 0 END AS errors, CASE p_partkey % 16 WHEN 14 THEN 1 WHEN 15 THEN 1 ELSE 0 END AS symlinks, CASE p_partkey % 16 WHEN 15 THEN 2 ELSE 0 END AS skipped FROM part"
)
def c7(spark, d):
    """Errors, symlinks and skipped members of the canonical lines."""
    size = lambda path: F.size(F.from_json(F.get_json_object("line", path), "array<map<string, string>>"))
    return _scan(spark, d).records().select("filename", size("$.errors").alias("errors"), size("$.artifacts.symlinks").alias("symlinks"), size("$.artifacts.skipped").alias("skipped"))


@query(
    "c5_record_findings",
    f"SELECT {_WHEEL} AS filename, CASE WHEN {_MANY} THEN 5 ELSE CASE p_partkey % 16 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 5 WHEN 6 THEN 1 WHEN 7 THEN 4 WHEN 8 THEN 5 WHEN 9 THEN 5 WHEN 10 THEN 4 WHEN 11 THEN CASE WHEN p_partkey % 32 = 11 THEN 3 ELSE 5 END WHEN 12 THEN 3 WHEN 13 THEN 3 WHEN 14 THEN 3 ELSE 6 END END AS findings, true AS sorted FROM part"
)
def c5(spark, d):
    """Findings of the canonical lines, in order of rule and subject."""
    ids = F.transform(F.from_json(F.get_json_object("line", "$.findings"), "array<struct<rule_id: string>>"), lambda f: f["rule_id"])
    return _scan(spark, d).records().select("filename", F.size(ids).alias("findings"), (ids == F.array_sort(ids)).alias("sorted"))
