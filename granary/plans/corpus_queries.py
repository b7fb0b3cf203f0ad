"""The engine over synthetic wheels made from the part table, with closed-form answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans import scan as S
from granary.sources import synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_SCANS: dict[tuple[str, str], S.Scan] = {}


def _scan(spark: SparkSession, d: str) -> S.Scan:
    """One scan of a folder's corpus a session; its kept relations serve all queries."""
    key = spark.sparkContext.applicationId, d
    if key not in _SCANS:
        _SCANS[key] = S.Scan(synthetic.corpus(spark.read.parquet(f"{d}/part.parquet")))
    return _SCANS[key]


_CLASS = "CASE p_partkey % 16 WHEN 0 THEN 'CONDITIONAL' WHEN 1 THEN 'CONDITIONAL' WHEN 2 THEN 'CONDITIONAL' WHEN 3 THEN 'NON_APPROVED_CRYPTO' WHEN 4 THEN CASE p_size % 3 WHEN 1 THEN 'CONTEXT_DEPENDENT' ELSE 'FIPS_BREAKING' END WHEN 5 THEN 'NO_CRYPTO_DETECTED' WHEN 6 THEN 'OPAQUE' WHEN 7 THEN 'NON_APPROVED_CRYPTO' WHEN 8 THEN 'NON_APPROVED_CRYPTO' WHEN 9 THEN 'NON_APPROVED_CRYPTO' WHEN 10 THEN 'CONDITIONAL' WHEN 11 THEN 'NON_APPROVED_CRYPTO' WHEN 12 THEN 'CONDITIONAL' WHEN 13 THEN 'CONDITIONAL' WHEN 14 THEN 'OPAQUE' ELSE 'NO_CRYPTO_DETECTED' END"


@query("x1_corpus_class", f"SELECT p_partkey AS key, {_CLASS} AS class, {_CLASS} <> 'NO_CRYPTO_DETECTED' OR p_partkey % 16 = 15 AS needs_human_review FROM part")
def x1(spark, d):
    s = _scan(spark, d)
    return s.evidence.select("key", "wheel_id").join(s.verdicts.select("wheel_id", "class", "needs_human_review"), "wheel_id").drop("wheel_id")


@query(
    "l8_corpus_linkage",
    "SELECT p_partkey AS key, 'openssl' AS library, CASE p_partkey % 16 WHEN 0 THEN 'system' WHEN 1 THEN 'bundled' WHEN 2 THEN 'static' WHEN 8 THEN 'system' WHEN 9 THEN 'system' WHEN 10 THEN 'static' ELSE 'none' END AS value FROM part"
)
def l8(spark, d):
    """Every library's linkage of every wheel; `none` is told of OpenSSL alone."""
    s = _scan(spark, d)
    return s.evidence.select("key", "wheel_id").join(s.linkage, "wheel_id").select("key", "library", "value")


@query(
    "l1_needed_posture",
    "SELECT p_partkey AS key, n AS needed, CASE WHEN n LIKE 'libcrypto-%' THEN 'bundled' ELSE 'system' END AS posture FROM part, (VALUES (0, 'libcrypto.so.3'), (0, 'libssl.so.3'), (0, 'libc.so.6'), (1, 'libcrypto-3a1f2b4c.so.3'), (1, 'libc.so.6'), (2, 'libc.so.6'), (3, 'libc.so.6'), (8, '/usr/lib/libcrypto.dylib'), (9, 'LIBCRYPTO-3.dll'), (9, 'other.dll'), (10, 'libc.so.6')) v(s, n) WHERE p_partkey % 16 = s"
)
def l1(spark, d):
    s = _scan(spark, d)
    return s.evidence.select("key", "wheel_id").join(s.needed.select("wheel_id", "needed", "posture").distinct(), "wheel_id").drop("wheel_id")


@query(
    "l3_object_posture",
    """SELECT p_partkey AS key, library, o AS objects, CASE library WHEN 'openssl' THEN v ELSE 'none' END AS posture FROM part,
    (VALUES (0, 1, 'system'), (1, 2, 'bundled'), (2, 1, 'static'), (3, 1, 'none'), (8, 1, 'system'), (9, 1, 'system'), (10, 2, 'static')) x(s, o, v),
    (VALUES ('openssl'), ('libsodium'), ('gnutls'), ('nss'), ('secp256k1'), ('nettle'), ('tomcrypt'), ('libgcrypt'), ('blake2'), ('mbedtls'), ('wolfssl'), ('cryptopp'), ('argon2')) y(library)
    WHERE p_partkey % 16 = s""",
)
def l3(spark, d):
    s = _scan(spark, d)
    return s.evidence.select("key", "wheel_id").join(s.postures, "wheel_id").groupBy("key", "library", "posture").agg(F.count("*").cast("int").alias("objects"))


#: What every shape's findings are: rule and subject, or the place of findings without one
#: (# stands for the key).
_FOUND = """(SELECT p_partkey AS key, r AS rule_id, replace(x, '#', p_partkey::VARCHAR) AS subject FROM part, (VALUES
    (0, 'BIN_NEEDED_SYSTEM_OPENSSL', 'openssl'), (0, 'BIN_OPENSSL_SYMBOLS_IMPORTED', 'openssl'), (0, 'DERIVED_SYSTEM_OPENSSL_ONLY', 'openssl'),
    (1, 'BIN_BUNDLED_OPENSSL', 'openssl'), (1, 'BIN_NEEDED_MANGLED_CRYPTO', 'openssl'), (1, 'BIN_OPENSSL_BANNER', 'openssl_banner'), (1, 'BIN_OPENSSL_SYMBOLS_DEFINED', 'openssl'), (1, 'BIN_OPENSSL_SYMBOLS_IMPORTED', 'openssl'),
    (2, 'BIN_OPENSSL_BANNER', 'openssl_banner'), (2, 'BIN_OPENSSL_SYMBOLS_DEFINED', 'openssl'), (2, 'BIN_STATIC_OPENSSL', 'openssl'),
    (3, 'BIN_RUST_CRYPTO_CRATE', 'ring'), (4, 'PY_IMPORT_CRYPTO_MODULE', 'hashlib'), (6, 'WHEEL_UNREADABLE', 'pkg#-1.0-py3-none-any.whl'), (7, 'DIST_NON_APPROVED_CRYPTO', 'pycryptodome'),
    (8, 'BIN_NEEDED_SYSTEM_OPENSSL', 'openssl'), (8, 'BIN_OPENSSL_SYMBOLS_IMPORTED', 'openssl'), (8, 'BIN_OWN_WEAK_HASH_IMPL', 'unspecified_hash_impl'), (8, 'DERIVED_SYSTEM_OPENSSL_ONLY', 'openssl'),
    (9, 'BIN_NEEDED_SYSTEM_OPENSSL', 'openssl'), (9, 'BIN_OPENSSL_SYMBOLS_IMPORTED', 'openssl'), (9, 'BIN_OWN_WEAK_HASH_IMPL', 'unspecified_hash_impl'), (9, 'BIN_PARTIAL_ROUTINE', 'pe'), (9, 'DERIVED_SYSTEM_OPENSSL_ONLY', 'openssl'),
    (10, 'BIN_OPENSSL_BANNER', 'openssl_banner'), (10, 'BIN_OPENSSL_SYMBOLS_DEFINED', 'openssl'), (10, 'BIN_STATIC_OPENSSL', 'openssl'), (11, 'SBOM_CRYPTO_COMPONENT', 'ring'),
    (12, 'PY_IMPORT_CRYPTO_MODULE', 'ssl'), (12, 'PY_TLS_POLICY_OVERRIDE', 'pkg#/net.py'), (12, 'PY_TLS_VERIFICATION_DISABLED', 'check_hostname'), (12, 'PY_TLS_VERIFICATION_DISABLED', 'verify_mode'),
    (13, 'PY_CTYPES_CRYPTO_LOAD', 'libcrypto'), (14, 'WHEEL_NO_PYTHON_SOURCE', 'pkg#-1.0-py3-none-any.whl'), (15, 'DIST_DEPENDS_ON_CRYPTO', 'cryptography'), (15, 'DIST_DEPENDS_ON_CRYPTO', 'pynacl'), (15, 'WHEEL_RECORD_MISMATCH', 'pkg#/extra.txt')
    ) v(s, r, x) WHERE p_partkey % 16 = s
    UNION ALL SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 'PY_WEAK_HASH_CALL_MARKED' ELSE 'PY_WEAK_HASH_CALL' END, 'pkg' || p_partkey || '/__init__.py' FROM part WHERE p_partkey % 16 = 4
    UNION ALL SELECT p_partkey, 'WHEEL_GENERATOR', 'bdist_wheel' FROM part WHERE p_partkey % 16 <> 6)"""


@query("m_corpus_rules", f"SELECT DISTINCT key, rule_id FROM {_FOUND}")
def m(spark, d):
    s = _scan(spark, d)
    return s.evidence.select("key", "wheel_id").join(s.findings.select("wheel_id", "rule_id").distinct(), "wheel_id").drop("wheel_id")


@query(
    "y5_python_calls",
    "SELECT p_partkey AS key, 'pkg' || p_partkey || '/__init__.py' AS path, 2 AS line, 'hashlib.md5' AS target, 'md5' AS algorithm, CASE p_size % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'false' ELSE 'true' END AS usedforsecurity FROM part WHERE p_partkey % 16 = 4"
)
def y5(spark, d):
    sites = _scan(spark, d).evidence.select("key", F.explode("py_sites").alias("s")).where("s.kind = 'py_call' and s.target = 'hashlib.md5'")
    return sites.select("key", "s.path", "s.line", "s.target", F.col("s.attrs")["algorithm"].alias("algorithm"), F.col("s.attrs")["usedforsecurity"].alias("usedforsecurity"))


@query(
    "n4_elf_symbols",
    """SELECT p_partkey AS key, g AS grp, b AS binding, count(*) AS symbols FROM part, (VALUES (0, 'openssl', 'imported'), (1, 'openssl', 'imported'), (1, 'openssl', 'defined'), (2, 'openssl', 'defined'),
    (8, 'openssl', 'imported'), (8, 'unspecified_hash_impl', 'defined'), (9, 'openssl', 'imported'), (9, 'openssl', 'imported'), (9, 'unspecified_hash_impl', 'defined'), (10, 'openssl', 'defined'),
    (10, 'openssl', 'defined')) v(s, g, b) WHERE p_partkey % 16 = s GROUP BY ALL""",
)
def n4(spark, d):
    b = _scan(spark, d).evidence.select("key", F.explode("binaries").alias("b")).select("key", F.explode("b.matched_symbols").alias("s"))
    return b.groupBy("key", F.col("s.group").alias("grp"), F.col("s.binding").alias("binding")).agg(F.count("*").alias("symbols"))


@query("n27_rust_crates", "SELECT p_partkey AS key, 'ring' AS name, '0.17.8' AS version FROM part WHERE p_partkey % 16 = 3")
def n27(spark, d):
    return _scan(spark, d).evidence.select("key", F.explode("binaries").alias("b")).select("key", F.explode("b.rust_crates").alias("r")).select("key", "r.name", "r.version")


@query(
    "s21_metadata",
    "SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 7 THEN 'pycryptodome' ELSE 'pkg' || p_partkey END AS canonical_name, CASE p_partkey % 16 WHEN 7 THEN p_partkey || '.0' ELSE '1.0' END AS version, 'bdist_wheel' AS generator_name, '0.43.0' AS generator_version FROM part WHERE p_partkey % 16 <> 6"
)
def s21(spark, d):
    return _scan(spark, d).evidence.where("metadata is not null").select("key", *[f"metadata.{c}" for c in ("canonical_name", "version", "generator_name", "generator_version")])


@query("c1_records")
def c1(spark, d):
    """The canonical lines: byte-exact output has no SQL twin."""
    return _scan(spark, d).records().select("filename", "line")


@query("r11_will_raise", "SELECT p_partkey AS key, 'pkg' || p_partkey || '/__init__.py' AS path, 2 AS line FROM part WHERE p_partkey % 16 = 4 AND p_size % 3 <> 1")
def r11(spark, d):
    """Which wheels will raise where only approved algorithms are allowed, and where."""
    s = _scan(spark, d)
    found = s.findings.where("verdict = 'FIPS_BREAKING'").select("wheel_id", F.explode("locations").alias("p"))
    return s.evidence.select("key", "wheel_id").join(found, "wheel_id").select("key", "p.path", "p.line")


# -- one decoder or matcher each ---------------------------------------------------


def _found(spark, d: str, rule: str) -> DataFrame:
    s = _scan(spark, d)
    return s.evidence.select("key", "wheel_id").join(s.findings.where(F.col("rule_id") == rule), "wheel_id")


def _places(df: DataFrame) -> DataFrame:
    return df.select("key", "subject", F.explode("locations").alias("p")).select("key", "subject", "p.path", "p.evidence")


@query("n14_macho_objects", "SELECT p_partkey AS key, 'macho' AS format, 'arm64' AS machine, 64 AS bits, 'little' AS endian, '/usr/lib/libcrypto.dylib' AS needed, 2::BIGINT AS symtab_count FROM part WHERE p_partkey % 16 = 8")
def n14(spark, d):
    b = _scan(spark, d).evidence.select("key", F.explode("binaries").alias("b")).where("b.format = 'macho'")
    return b.select("key", "b.format", "b.machine", "b.bits", "b.endian", F.array_join("b.needed", ",").alias("needed"), "b.symtab_count")


@query(
    "n18_pe_objects",
    "SELECT p_partkey AS key, 'amd64' AS machine, 'me.dll' AS soname, 'LIBCRYPTO-3.dll,other.dll' AS needed, 'pe_ordinal_import' AS reasons, 'EVP_x:imported,EVP_z:imported,MD5_y:defined' AS symbols FROM part WHERE p_partkey % 16 = 9"
)
def n18(spark, d):
    b = _scan(spark, d).evidence.select("key", F.explode("binaries").alias("b")).where("b.format = 'pe'")
    names = F.array_sort(F.transform("b.matched_symbols", lambda s: F.concat_ws(":", s["name"], s["binding"])))
    return b.select("key", "b.machine", "b.soname", F.array_join("b.needed", ",").alias("needed"), F.array_join("b.partial_reasons", ",").alias("reasons"), F.array_join(names, ",").alias("symbols"))


@query("n22_ar_members", "SELECT p_partkey AS key, 'pkg' || p_partkey || '/libown.a(' || m || ')' AS path FROM part, (VALUES ('evp.o'), ('evp2.o')) v(m) WHERE p_partkey % 16 = 10")
def n22(spark, d):
    return _scan(spark, d).evidence.select("key", F.explode("binaries").alias("b")).where("b.from_archive").select("key", "b.path")


@query("s23_sbom_components", "SELECT p_partkey AS key, n AS name, v AS version, p AS purl FROM part, (VALUES ('app', '-', '-'), ('ring', '0.17.8', 'pkg:cargo/ring@0.17.8')) c(n, v, p) WHERE p_partkey % 16 = 11")
def s23(spark, d):
    return _scan(spark, d).evidence.select("key", F.explode("sbom").alias("c")).select("key", "c.name", F.coalesce("c.version", F.lit("-")).alias("version"), F.coalesce("c.purl", F.lit("-")).alias("purl"))


@query("s22_record_mismatch", "SELECT p_partkey AS key, 'pkg' || p_partkey || '/extra.txt' AS path FROM part WHERE p_partkey % 16 = 15")
def s22(spark, d):
    return _scan(spark, d).evidence.where("metadata is not null").select("key", F.explode("metadata.record_mismatches").alias("path"))


@query("f9_requirement_names", "SELECT p_partkey AS key, n AS name FROM part, (VALUES ('cryptography'), ('pynacl'), ('requests')) v(n) WHERE p_partkey % 16 = 15")
def f9(spark, d):
    return _scan(spark, d).evidence.where("metadata is not null").select("key", F.explode("metadata.requires_dist_names").alias("name"))


@query(
    "a12_wheel_inventory",
    "SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 6 THEN 0 WHEN 14 THEN 0 WHEN 12 THEN 2 WHEN 13 THEN 2 ELSE 1 END::BIGINT AS py_files, CASE p_partkey % 16 WHEN 14 THEN 1 ELSE 0 END::BIGINT AS pyc_files, p_partkey % 16 NOT IN (6, 14) AS source_available FROM part"
)
def a12(spark, d):
    return _scan(spark, d).evidence.select("key", *[f"artifacts.{c}" for c in ("py_files", "pyc_files", "source_available")])


@query("m1_dist_name", "SELECT p_partkey AS key, 'pycryptodome' AS subject, 'pycryptodome-' || p_partkey || '.0.dist-info' AS path, 'pycryptodome ' || p_partkey || '.0' AS evidence FROM part WHERE p_partkey % 16 = 7")
def m1(spark, d):
    return _places(_found(spark, d, "DIST_NON_APPROVED_CRYPTO"))


@query("m2_requires_dist", "SELECT p_partkey AS key, n AS subject, 'pkg' || p_partkey || '-1.0.dist-info/METADATA' AS path, 'Requires-Dist: ' || n AS evidence FROM part, (VALUES ('cryptography'), ('pynacl')) v(n) WHERE p_partkey % 16 = 15")
def m2(spark, d):
    return _places(_found(spark, d, "DIST_DEPENDS_ON_CRYPTO"))


@query("m3_wheel_generator", "SELECT p_partkey AS key, 'bdist_wheel' AS subject, 'Generator: bdist_wheel (0.43.0)' AS evidence FROM part WHERE p_partkey % 16 <> 6")
def m3(spark, d):
    return _places(_found(spark, d, "WHEEL_GENERATOR")).drop("path")


@query("m4_no_source", "SELECT p_partkey AS key, 'pkg' || p_partkey || '-1.0-py3-none-any.whl' AS path, '1 bytecode files, 0 source files' AS evidence FROM part WHERE p_partkey % 16 = 14")
def m4(spark, d):
    return _places(_found(spark, d, "WHEEL_NO_PYTHON_SOURCE")).drop("subject")


@query("m6_record_mismatch", "SELECT p_partkey AS key, 'pkg' || p_partkey || '/extra.txt' AS path, 'not reconciled with RECORD' AS evidence FROM part WHERE p_partkey % 16 = 15")
def m6(spark, d):
    return _places(_found(spark, d, "WHEEL_RECORD_MISMATCH")).drop("subject")


@query("m7_scan_error", "SELECT p_partkey AS key, 'pkg' || p_partkey || '-1.0-py3-none-any.whl' AS path FROM part WHERE p_partkey % 16 = 6")
def m7(spark, d):
    return _places(_found(spark, d, "WHEEL_UNREADABLE")).select("key", "path")


@query("m8_sbom_component", "SELECT p_partkey AS key, 'ring' AS subject, 'pkg' || p_partkey || '-1.0.dist-info/sboms/cargo.json' AS path, 'SBOM component ring 0.17.8' AS evidence FROM part WHERE p_partkey % 16 = 11")
def m8(spark, d):
    return _places(_found(spark, d, "SBOM_CRYPTO_COMPONENT"))


@query(
    "m9_bundled_library",
    "SELECT p_partkey AS key, 'openssl' AS subject, 'pkg' || p_partkey || '.libs/libcrypto-3a1f2b4c.so.3' AS path, concat('DT_SONAME=libcrypto-3a1f2b4c.so.3; string=', chr(39), 'OpenSSL 3.0.14 4 Jun 2024', chr(39)) AS evidence FROM part WHERE p_partkey % 16 = 1"
)
def m9(spark, d):
    return _places(_found(spark, d, "BIN_BUNDLED_OPENSSL"))


@query(
    "m10_dt_needed",
    "SELECT p_partkey AS key, 'openssl' AS subject, CASE p_partkey % 16 WHEN 0 THEN 'pkg' || p_partkey || '/_ext.cpython-312-x86_64-linux-gnu.so' WHEN 8 THEN 'pkg' || p_partkey || '/_ext.dylib' ELSE 'pkg' || p_partkey || '/_ext.pyd' END AS path, 'DT_NEEDED=' || n AS evidence FROM part, (VALUES (0, 'libcrypto.so.3'), (0, 'libssl.so.3'), (8, '/usr/lib/libcrypto.dylib'), (9, 'LIBCRYPTO-3.dll')) v(s, n) WHERE p_partkey % 16 = s"
)
def m10(spark, d):
    return _places(_found(spark, d, "BIN_NEEDED_SYSTEM_OPENSSL"))


@query("m11_dynamic_symbol", "SELECT p_partkey AS key, 'unspecified_hash_impl' AS subject, 'defined symbol MD5_y' AS evidence FROM part WHERE p_partkey % 16 IN (8, 9)")
def m11(spark, d):
    return _places(_found(spark, d, "BIN_OWN_WEAK_HASH_IMPL")).drop("path")


@query("m12_binary_string", "SELECT p_partkey AS key, 'openssl_banner' AS subject, count(*) AS places FROM part, (VALUES (1), (2), (10), (10)) v(s) WHERE p_partkey % 16 = s GROUP BY ALL")
def m12(spark, d):
    return _places(_found(spark, d, "BIN_OPENSSL_BANNER")).groupBy("key", "subject").agg(F.count("*").alias("places"))


@query("m13_rust_crate", "SELECT p_partkey AS key, 'ring' AS subject, 'cargo path for ring 0.17.8' AS evidence FROM part WHERE p_partkey % 16 = 3")
def m13(spark, d):
    return _places(_found(spark, d, "BIN_RUST_CRYPTO_CRATE")).drop("path")


@query("m14_linkage_rule", "SELECT p_partkey AS key, 'openssl' AS subject, 'openssl linkage resolved to static' AS evidence FROM part WHERE p_partkey % 16 IN (2, 10)")
def m14(spark, d):
    return _places(_found(spark, d, "BIN_STATIC_OPENSSL")).drop("path")


@query("m16_partial_binary", "SELECT p_partkey AS key, 'pe' AS subject, 'pe object was only partially read: pe_ordinal_import' AS evidence FROM part WHERE p_partkey % 16 = 9")
def m16(spark, d):
    return _places(_found(spark, d, "BIN_PARTIAL_ROUTINE")).drop("path")


@query(
    "m17_py_import",
    "SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 4 THEN 'hashlib' ELSE 'ssl' END AS subject, CASE p_partkey % 16 WHEN 4 THEN 'import hashlib as h' ELSE 'import ssl' END AS evidence FROM part WHERE p_partkey % 16 IN (4, 12)"
)
def m17(spark, d):
    return _places(_found(spark, d, "PY_IMPORT_CRYPTO_MODULE")).drop("path")


@query("m18_py_call", "SELECT p_partkey AS key, 'pkg' || p_partkey || '/__init__.py' AS path FROM part WHERE p_partkey % 16 = 4 AND p_size % 3 = 1")
def m18(spark, d):
    return _places(_found(spark, d, "PY_WEAK_HASH_CALL_MARKED")).select("key", "path")


@query(
    "m19_py_attr",
    "SELECT p_partkey AS key, a AS subject, 'pkg' || p_partkey || '/net.py' AS path, e AS evidence FROM part, (VALUES ('check_hostname', 'check_hostname = False'), ('verify_mode', 'verify_mode = ssl.CERT_NONE')) v(a, e) WHERE p_partkey % 16 = 12"
)
def m19(spark, d):
    return _places(_found(spark, d, "PY_TLS_VERIFICATION_DISABLED"))


@query("m21_py_ctypes_load", "SELECT p_partkey AS key, 'libcrypto' AS subject, 'pkg' || p_partkey || '/load.py' AS path FROM part WHERE p_partkey % 16 = 13")
def m21(spark, d):
    return _places(_found(spark, d, "PY_CTYPES_CRYPTO_LOAD")).drop("evidence")


@query("a8_reasons", f"SELECT key, string_agg(rule_id || ': ' || subject, '; ' ORDER BY rule_id || ': ' || subject) AS reasons FROM {_FOUND} GROUP BY key")
def a8(spark, d):
    s = _scan(spark, d)
    return s.evidence.select("key", "wheel_id").join(s.verdicts, "wheel_id").select("key", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "a11_crypto_families",
    "SELECT p_partkey AS key, CASE WHEN p_partkey % 16 IN (5, 6, 14) THEN '' WHEN p_partkey % 16 = 4 THEN 'hash' WHEN p_partkey % 16 = 12 THEN 'tls' WHEN p_partkey % 16 IN (8, 9) THEN 'hash,library' ELSE 'library' END AS families FROM part"
)
def a11(spark, d):
    s = _scan(spark, d)
    return s.evidence.select("key", "wheel_id").join(s.verdicts, "wheel_id").select("key", F.array_join("families", ",").alias("families"))


@query(
    "a8_relations",
    "SELECT p_partkey AS key, CASE WHEN p_partkey % 16 IN (5, 6, 14, 15) THEN '' WHEN p_partkey % 16 IN (3, 7, 11) THEN 'outside_module' WHEN p_partkey % 16 = 4 THEN CASE WHEN p_size % 3 = 1 THEN 'use_unresolved' ELSE 'runtime_refusal' END WHEN p_partkey % 16 IN (8, 9) THEN 'boundary_unresolved,not_specified' WHEN p_partkey % 16 = 12 THEN 'policy_bypass' ELSE 'boundary_unresolved' END AS relations FROM part"
)
def a8r(spark, d):
    s = _scan(spark, d)
    return s.evidence.select("key", "wheel_id").join(s.verdicts, "wheel_id").select("key", F.array_join("relations", ",").alias("relations"))


@query("x3_errors", "SELECT p_partkey AS key, 'archive' AS stage, 'bad_zip' AS kind FROM part WHERE p_partkey % 16 = 6")
def x3(spark, d):
    return _scan(spark, d).evidence.select("key", F.explode("errors").alias("e")).select("key", "e.stage", "e.kind")


@query(
    "c2_record_heads",
    "SELECT CASE p_partkey % 16 WHEN 7 THEN 'pycryptodome-' || p_partkey || '.0' ELSE 'pkg' || p_partkey || '-1.0' END || '-py3-none-any.whl' AS filename, 2 AS schema_version, CASE p_partkey % 16 WHEN 6 THEN '-' WHEN 7 THEN 'pycryptodome' ELSE 'pkg' || p_partkey END AS name, '43' AS ruleset_version FROM part"
)
def c2(spark, d):
    get = lambda path: F.get_json_object("line", path)
    return _scan(spark, d).records().select("filename", get("$.schema_version").cast("int").alias("schema_version"), F.coalesce(get("$.wheel.name"), F.lit("-")).alias("name"), get("$.tool.ruleset_version").alias("ruleset_version"))


@query(
    "a10_wheel_conditions",
    "SELECT p_partkey AS key, 'openssl_linkage=' || CASE p_partkey % 16 WHEN 0 THEN 'system' WHEN 1 THEN 'bundled' WHEN 2 THEN 'static' WHEN 8 THEN 'system' WHEN 9 THEN 'system' WHEN 10 THEN 'static' ELSE 'none' END AS conditions FROM part"
)
def a10w(spark, d):
    s = _scan(spark, d)
    text = F.array_join(F.transform(F.map_entries("conditions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return s.evidence.select("key", "wheel_id").join(s.verdicts, "wheel_id").select("key", text.alias("conditions"))


@query("r11_own_openssl", "SELECT 'pkg' || p_partkey || '-1.0-py3-none-any.whl' AS filename, CASE p_partkey % 16 WHEN 1 THEN 'bundled' ELSE 'static' END AS linkage FROM part WHERE p_partkey % 16 IN (1, 2, 10)")
def r11_own(spark, d):
    from granary.plans import triage

    triage.create(_scan(spark, d))
    return spark.table("triage_own_openssl").select("filename", "linkage")


@query("r11_unread", "SELECT 'pkg' || p_partkey || '-1.0-py3-none-any.whl' AS filename FROM part WHERE p_partkey % 16 IN (6, 14)")
def r11_unread(spark, d):
    from granary.plans import triage

    triage.create(_scan(spark, d))
    return spark.table("triage_unread").select("filename")


@query(
    "r11_outside_module_only",
    "SELECT CASE p_partkey % 16 WHEN 7 THEN 'pycryptodome-' || p_partkey || '.0-py3-none-any.whl' ELSE 'pkg' || p_partkey || '-1.0-py3-none-any.whl' END AS filename FROM part WHERE p_partkey % 16 IN (3, 7, 11)"
)
def r11_outside(spark, d):
    from granary.plans import triage

    triage.create(_scan(spark, d))
    return spark.table("triage_outside_module_only").select("filename")


@query("a19_corpus_summary", f"SELECT {_CLASS} AS class, count(*) AS wheels FROM part GROUP BY ALL")
def a19(spark, d):
    return _scan(spark, d).verdicts.groupBy("class").agg(F.count("*").alias("wheels"))


@query("j15_referenced_rules", f"SELECT rule_id, count(DISTINCT key) AS wheels FROM {_FOUND} GROUP BY rule_id")
def j15(spark, d):
    """Of the policy's rules those that findings refer to, with their wheels."""
    s = _scan(spark, d)
    used = s.findings.groupBy("rule_id").agg(F.count_distinct("wheel_id").alias("wheels"))
    return s.policy.rules_frame(spark).select("rule_id").join(used, "rule_id")
