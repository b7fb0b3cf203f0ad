"""The engine over wheels that differ in metadata, sources and tables, and its sinks; each
answer in closed form."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans import scan as S
from granary.plans.keep import kept, root
from granary.sinks import cache, jsonl, report, schema
from granary.sources import synthetic_parts as made

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SCANS: dict[tuple[str, str], S.Scan] = {}
_WHEEL = "'bit' || p_partkey || '-1.0-py2.py3-none-any.whl'"
_INFO = "'bit' || p_partkey || '-1.0.dist-info'"
_EXT = "'bit' || p_partkey || '/_ext.so'"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _scan(spark: SparkSession, d: str) -> S.Scan:
    """One scan of a folder's corpus a session."""
    key = spark.sparkContext.applicationId, d
    if key not in _SCANS:
        _SCANS[key] = S.Scan(made.corpus(spark.read.parquet(f"{d}/part.parquet")))
    return _SCANS[key]


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).evidence


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("key", F.explode("binaries").alias("b"))


def _places(spark: SparkSession, d: str, *rules: str) -> DataFrame:
    found = _scan(spark, d).findings.where(F.col("rule_id").isin(*rules))
    rows = _evidence(spark, d).select("key", "wheel_id").join(found, "wheel_id")
    return rows.select("key", "rule_id", "subject", F.explode("locations").alias("p")).select("key", "rule_id", "subject", "p.path", "p.line", "p.evidence")


# -- metadata ----------------------------------------------------------------------


@query(
    "f12_dist_info",
    f"""SELECT p_partkey AS key, kind, CASE f WHEN '' THEN '-' WHEN 'a' THEN 'bit' || p_partkey || '/libown.a' WHEN 'd' THEN 'bit' || p_partkey || '/_ext.dylib' WHEN 'p' THEN 'bit' || p_partkey || '/_ext.pyd' ELSE {_INFO} || '/' || f END AS path
    FROM part, (VALUES (0, 'dist_info_missing', ''), (1, 'dist_info_ambiguous', ''), (2, 'metadata_missing', 'METADATA'), (3, 'metadata_decode_error', 'METADATA'), (4, 'wheel_missing', 'WHEEL'), (5, 'record_missing', 'RECORD'),
    (10, 'macho_parse_error', 'd'), (11, 'pe_parse_error', 'p'), (15, 'ar_parse_error', 'a')) v(s, kind, f) WHERE p_partkey % 16 = s""",
)
def f12(spark, d):
    """Errors of wheels whose metadata, objects or archives are damaged."""
    return _evidence(spark, d).select("key", F.explode("errors").alias("e")).select("key", "e.kind", F.coalesce("e.path", F.lit("-")).alias("path"))


@query(
    "f11_identity",
    "SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 6 THEN 'Bit' ELSE 'bit' END || p_partkey AS name, 'bit' || p_partkey AS canonical_name, '1.0' AS version, 'py2-none-any,py3-none-any' AS tags, 'any' AS platform_tags, CASE p_partkey % 16 WHEN 4 THEN '-' WHEN 6 THEN 'maturin' ELSE 'bdist_wheel' END AS generator, p_partkey % 16 NOT IN (4, 6) AS purelib FROM part WHERE p_partkey % 16 > 1",
)
def f11(spark, d):
    """The file name decides but for the spelling of the name (F11, F14, S25); no metadata
    without one dist-info folder."""
    m = _evidence(spark, d).where("metadata is not null").select("key", "metadata.*")
    return m.select(
        "key",
        "name",
        "canonical_name",
        "version",
        F.array_join("tags", ",").alias("tags"),
        F.array_join("platform_tags", ",").alias("platform_tags"),
        F.coalesce("generator_name", F.lit("-")).alias("generator"),
        F.col("root_is_purelib").alias("purelib")
    )


@query("f24_headers", "SELECT p_partkey AS key, '>=3.9' AS requires_python, '!bad|Zed.Lib[x]>=1|a_b; extra == ''t''' AS requires, 'a-b,zed-lib' AS names, '1.4.0' AS generator_version FROM part WHERE p_partkey % 16 = 6")
def f24(spark, d):
    """Headers once and many times, after a byte order mark, one of them no requirement."""
    m = _evidence(spark, d).where("metadata.requires_python is not null").select("key", "metadata.*")
    return m.select("key", "requires_python", F.array_join("requires_dist", "|").alias("requires"), F.array_join("requires_dist_names", ",").alias("names"), "generator_version")


@query(
    "s22_record_files",
    f"SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 5 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 4 WHEN 6 THEN 4 ELSE 5 END::BIGINT AS entries, CASE p_partkey % 16 WHEN 2 THEN {_INFO} || '/METADATA' WHEN 4 THEN {_INFO} || '/WHEEL' ELSE '' END AS mismatches FROM part WHERE p_partkey % 16 > 1"
)
def s22(spark, d):
    m = _evidence(spark, d).where("metadata is not null").select("key", "metadata.*")
    return m.select("key", F.col("record_entries").alias("entries"), F.array_join("record_mismatches", ",").alias("mismatches"))


# -- objects -----------------------------------------------------------------------


@query(
    "n6_symbol_tables",
    f"""SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 15 THEN 'bit' || p_partkey || '/libown.a(evp.o)' ELSE {_EXT} END AS path, CASE p_partkey % 16 WHEN 8 THEN 2 ELSE 0 END::BIGINT AS dynsym_count, 4::BIGINT AS symtab_count, n AS name, b AS binding
    FROM part, (VALUES ('EVP_DigestInit_ex', 'defined'), ('RAND_bytes', 'imported')) v(n, b) WHERE p_partkey % 16 IN (7, 8, 15)""",
)
def n6(spark, d):
    """A static table alone gives imports too (N6); beside a dynamic one, definitions only.
    A source file's name is no symbol."""
    rows = _objects(spark, d).where("b.symtab_count > 0").select("key", "b.path", "b.dynsym_count", "b.symtab_count", F.explode("b.matched_symbols").alias("s"))
    return rows.select("key", "path", "dynsym_count", "symtab_count", "s.name", "s.binding")


@query("n26_code_strings", f"SELECT p_partkey AS key, {_EXT} AS path, 'aws_lc_fips' AS grp, 'AWS-LC FIPS 2.0.0' AS value FROM part WHERE p_partkey % 16 = 9")
def n26(spark, d):
    """In code only the groups that are meant for it are looked for."""
    rows = _objects(spark, d).select("key", "b.path", F.explode("b.matched_strings").alias("s")).where("s.group like 'aws%' or s.value like '%3.0.0'")
    return rows.select("key", "path", F.col("s.group").alias("grp"), "s.value")


@query(
    "n35_header_fallbacks",
    "SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 10 THEN 'macho' ELSE 'pe' END AS format, CASE p_partkey % 16 WHEN 10 THEN 'macho_header_unread' ELSE 'pe_header_unread' END AS reasons, 'OpenSSL 3.0.14 4 Jun 2024' AS banner FROM part WHERE p_partkey % 16 IN (10, 11)"
)
def n35(spark, d):
    """Objects whose header cannot be read give their strings."""
    rows = _objects(spark, d).where("b.partial_analysis")
    return rows.select("key", "b.format", F.array_join("b.partial_reasons", ",").alias("reasons"), F.col("b.matched_strings")[0]["value"].alias("banner"))


@query("n30_ar_names", "SELECT p_partkey AS key, 'bit' || p_partkey || '/libown.a(evp.o)' AS path, true AS from_archive FROM part WHERE p_partkey % 16 = 15")
def n30(spark, d):
    """BSD names; what was read before an archive breaks off stays."""
    return _objects(spark, d).where("b.from_archive").select("key", "b.path", "b.from_archive")


@query(
    "f4_quoted_evidence",
    f"SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 14 THEN {_EXT} WHEN 10 THEN 'bit' || p_partkey || '/_ext.dylib' ELSE 'bit' || p_partkey || '/_ext.pyd' END AS path, CASE p_partkey % 16 WHEN 14 THEN 'string=\"it''s OpenSSL 3.0.14 \\\\ here\"' ELSE 'string=''OpenSSL 3.0.14 4 Jun 2024''' END AS evidence FROM part WHERE p_partkey % 16 IN (10, 11, 14)"
)
def f4(spark, d):
    """Evidence between the quotes that it does not hold; backslashes doubled."""
    return _places(spark, d, "BIN_OPENSSL_BANNER").select("key", "path", "evidence")


# -- sources -----------------------------------------------------------------------


@query(
    "y6_assignments",
    """SELECT p_partkey AS key, line, target, value FROM part, (VALUES (4, 'verify_mode', 'ssl.CERT_NONE'), (5, 'check_hostname', 'unresolved'), (6, 'options', 'unresolved'), (7, 'options', 'ssl.OP_NO_SSLv2'),
    (8, 'minimum_version', 'ssl.TLSVersion.TLSv1')) v(line, target, value) WHERE p_partkey % 16 = 12""",
)
def y6(spark, d):
    """Plain, unpacked, starred, augmented and annotated assignments, through aliases."""
    rows = _evidence(spark, d).select("key", F.explode("py_sites").alias("s")).where("s.kind = 'py_attr'")
    return rows.select("key", "s.line", "s.target", F.col("s.attrs")["value"].alias("value"))


@query("f13_hash_calls", f"SELECT p_partkey AS key, line, target, algorithm, used FROM part, (VALUES {', '.join(str(c) for c in made.CALLS)}) v(line, target, algorithm, used) WHERE p_partkey % 16 = 13")
def f13(spark, d):
    """Which algorithm, and whether for security; two equal calls in a line are one."""
    rows = _evidence(spark, d).select("key", F.explode("py_sites").alias("s")).where("s.kind = 'py_call' and s.target like 'hashlib.%'")
    return rows.select("key", "s.line", "s.target", F.col("s.attrs")["algorithm"].alias("algorithm"), F.col("s.attrs")["usedforsecurity"].alias("used"))


@query(
    "o6_site_order",
    "SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 12 THEN 'py_attr:4,py_attr:5,py_attr:6,py_attr:7,py_attr:8,py_call:3,py_call:10,py_import:1,py_import:2' ELSE 'py_call:3,py_call:4,py_call:5,py_call:6,py_call:7,py_call:9,py_import:1,py_import:2' END AS sites FROM part WHERE p_partkey % 16 IN (12, 13)"
)
def o6(spark, d):
    said = F.transform("py_sites", lambda s: F.concat(s["kind"], F.lit(":"), s["line"].cast("string")))
    return _evidence(spark, d).where("size(py_sites) > 0").select("key", F.array_join(said, ",").alias("sites"))


@query(
    "m18_call_rules",
    """SELECT p_partkey AS key, rule_id, line FROM part, (VALUES (12, 'PY_TLS_POLICY_OVERRIDE', 3), (12, 'PY_TLS_POLICY_OVERRIDE', 10), (12, 'PY_TLS_VERSION_PINNED', 6), (12, 'PY_TLS_VERSION_PINNED', 7), (12, 'PY_TLS_VERSION_PINNED', 8),
    (12, 'PY_TLS_VERIFICATION_DISABLED', 4), (13, 'PY_WEAK_HASH_CALL', 3), (13, 'PY_WEAK_HASH_CALL', 9), (13, 'PY_WEAK_HASH_CALL_MARKED', 4), (13, 'PY_WEAK_HASH_UNRESOLVED', 5), (13, 'PY_WEAK_HASH_UNRESOLVED', 6),
    (13, 'PY_WEAK_HASH_UNRESOLVED', 7)) v(s, rule_id, line) WHERE p_partkey % 16 = s""",
)
def m18(spark, d):
    """Rules on calls and attributes: by target, last name, algorithm, purpose and value."""
    rules = ("PY_TLS_POLICY_OVERRIDE", "PY_TLS_VERSION_PINNED", "PY_TLS_VERIFICATION_DISABLED", "PY_WEAK_HASH_CALL", "PY_WEAK_HASH_CALL_MARKED", "PY_WEAK_HASH_UNRESOLVED", "PY_RESTRICTED_HASH_CALL")
    return _places(spark, d, *rules).select("key", "rule_id", "line")


# -- records and sinks -------------------------------------------------------------


def _per_line(records: DataFrame, f: Callable[[dict], list[tuple]], ddl: str, kinds: list[pa.DataType]) -> DataFrame:
    """Rows made from the parsed line of every record, batch by batch."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for line in b.column(0).to_pylist() for x in f(json.loads(line))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return records.select("line").mapInArrow(run, ddl)


@query(
    "r12_report_sections",
    f"""SELECT {_WHEEL} AS filename, h AS heading FROM part, (VALUES (0, 'Other evidence'), (1, 'Other evidence'), (2, 'Other evidence'), (3, 'Other evidence'), (4, 'Other evidence'), (5, 'Other evidence'), (6, 'Other evidence'),
    (7, 'Inventory: library'), (7, 'Compatibility: boundary_unresolved'), (7, 'Other evidence'), (8, 'Inventory: library'), (8, 'Compatibility: boundary_unresolved'), (8, 'Other evidence'),
    (9, 'Inventory: library'), (9, 'Compatibility: boundary_unresolved'), (9, 'Other evidence'), (10, 'Inventory: library'), (10, 'Compatibility: boundary_unresolved'), (10, 'Other evidence'),
    (11, 'Inventory: library'), (11, 'Compatibility: boundary_unresolved'), (11, 'Other evidence'), (12, 'Inventory: tls'), (12, 'Compatibility: policy_bypass'), (12, 'Other evidence'),
    (13, 'Inventory: hash'), (13, 'Compatibility: runtime_refusal'), (13, 'Compatibility: use_unresolved'), (13, 'Other evidence'), (14, 'Inventory: library'), (14, 'Compatibility: boundary_unresolved'), (14, 'Other evidence'),
    (15, 'Inventory: library'), (15, 'Compatibility: boundary_unresolved'), (15, 'Other evidence')) v(s, h) WHERE p_partkey % 16 = s""",
)
def r12(spark, d):
    """Sections of each wheel in the Markdown view."""
    heads = lambda r: [(r["wheel"]["filename"], x[4:]) for x in report.markdown([r]).splitlines() if x.startswith("### ")]
    return _per_line(_scan(spark, d).records(), heads, "filename string, heading string", [pa.string(), pa.string()])


@query(
    "r2_summary_cells",
    f"""SELECT {_WHEEL} AS filename, CASE WHEN p_partkey % 16 IN (7, 8, 10, 11, 14, 15) THEN 'openssl:static' ELSE '-' END AS libraries,
    CASE WHEN p_partkey % 16 < 7 THEN '-' WHEN p_partkey % 16 = 12 THEN 'tls' WHEN p_partkey % 16 = 13 THEN 'hash' ELSE 'library' END AS families,
    CASE WHEN p_partkey % 16 IN (5, 6) THEN 'no' ELSE 'yes' END AS review, CASE WHEN p_partkey % 16 IN (6, 7, 8, 9, 12, 13, 14) THEN '0' ELSE '1' END AS errors FROM part""",
)
def r2(spark, d):
    """A wheel's line in the summary."""
    def cells(r):
        row = report.summary(r)
        return [(row[0], row[2], row[3], row[6], row[7])]

    return _per_line(_scan(spark, d).records(), cells, "filename string, libraries string, families string, review string, errors string", [pa.string()] * 5)


@query("s30_schema", f"SELECT {_WHEEL} AS filename, 0 AS mismatches FROM part")
def s30(spark, d):
    """Every record fits the record schema."""
    wanted = schema.record_schema(_scan(spark, d).policy.precedence)
    return _per_line(_scan(spark, d).records(), lambda r: [(r["wheel"]["filename"], len(schema.mismatches(r, wanted)))], "filename string, mismatches int", [pa.string(), pa.int32()])


@query("f17_canonical_lines", f"SELECT {_WHEEL} AS filename, true AS canonical FROM part")
def f17(spark, d):
    """Lines are their own canonical form (F17, C1); each is held against it where it is made."""
    again = lambda r: (r["wheel"]["filename"], S.canonical(r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b.column("line").to_pylist()
            yield pa.RecordBatch.from_pydict({"filename": b.column("filename"), "canonical": pa.array([(n, x) == again(json.loads(x)) for n, x in zip(b.column("filename").to_pylist(), lines, strict=True)], pa.bool_())})

    return _scan(spark, d).records().select("filename", "line").mapInArrow(run, "filename string, canonical boolean")


@query("s26_jsonl_sink", f"SELECT {_WHEEL} AS filename, true AS in_order FROM part")
def s26(spark, d):
    """Lines over all part files are in order of names."""
    at = f"{root(spark)}/lines-{uuid.uuid4().hex}"
    jsonl.write(_scan(spark, d).records(), at)
    lines = kept(spark.read.text(at).select(F.col("_metadata.file_name").alias("file"), "value"), "lines")
    names = lines.select("file", F.get_json_object("value", "$.wheel.filename").alias("filename"))
    files = names.groupBy("file").agg(F.min("filename").alias("lo"), F.max("filename").alias("hi"))
    a, b = files.alias("a"), files.alias("b")
    bad = a.join(b, F.col("a.file") < F.col("b.file")).where("a.hi > b.lo").select(F.col("a.file").alias("file")).distinct()  # part files, a few
    return names.join(bad.withColumn("bad", F.lit(True)), "file", "left").select("filename", F.col("bad").isNull().alias("in_order"))


@query("s31_record_cache", f"SELECT {_WHEEL} AS filename, p_partkey % 16 NOT IN (10, 11) AS found FROM part")
def s31(spark, d):
    """A cache gives back what was put in, but for wheels whose reading broke off."""
    s = _scan(spark, d)
    c = cache.RecordCache(spark, f"{root(spark)}/cache-{uuid.uuid4().hex}", s.policy.version)
    c.put(s.records())
    keys = s.evidence.select("filename", "wheel_id")
    return c.found(keys).select("filename", F.lit(True).alias("found")).unionByName(c.misses(keys).select("filename", F.lit(False).alias("found")))


@query("s32_resumed", f"SELECT {_WHEEL} AS filename FROM part WHERE p_partkey % 16 NOT IN (10, 11)")
def s32(spark, d):
    """Of an earlier output, the lines that need not be made again."""
    at = f"{root(spark)}/lines-{uuid.uuid4().hex}"
    jsonl.write(_scan(spark, d).records(), at)
    return jsonl.resumable(spark, at).select("filename")


@query(
    "s34_counts",
    "SELECT count(*) AS wheels, count(*) FILTER (p_partkey % 16 NOT IN (5, 6)) AS to_review, count(*) FILTER (p_partkey % 16 IN (0, 1, 2, 3, 4)) AS opaque, count(*) FILTER (p_partkey % 16 IN (0, 1, 2, 3, 4, 5, 10, 11, 15)) AS errors FROM part"
)
def s34(spark, d):
    """Counts of what went by while records were made."""
    from pyspark.sql import Observation

    seen = Observation("counts")
    kept(_scan(spark, d).records(seen).select("wheel_id"), "counted")
    got = seen.get
    return spark.range(1).select(*[F.lit(got[k]).cast("bigint").alias(n) for k, n in (("wheels", "wheels"), ("to_review", "to_review"), ("OPAQUE", "opaque"), ("errors", "errors"))])


@query("a17_all_classes", "SELECT * FROM (VALUES (0, 'NON_APPROVED_CRYPTO'), (1, 'FIPS_BREAKING'), (2, 'CONDITIONAL'), (3, 'CONTEXT_DEPENDENT'), (4, 'OPAQUE'), (5, 'NO_CRYPTO_DETECTED')) v(place, class)")
def a17(spark, d):
    """The policy's classes in order, then any others that records have."""
    s = _scan(spark, d)
    known = spark.createDataFrame(list(enumerate(s.policy.precedence)), "place int, class string")
    return known.unionByName(s.verdicts.select(F.lit(len(s.policy.precedence)).alias("place"), "class").distinct().join(known, "class", "left_anti"))


@query("j15_cited_standards", "SELECT * FROM (VALUES ('FIPS-140-3'), ('FIPS-180-4'), ('FIPS-202'), ('SP-800-131A-r2'), ('SP-800-52-r2')) v(standard)")
def j15s(spark, d):
    """Of the policy's standards those that findings cite."""
    s = _scan(spark, d)
    cited = s.findings.select(F.explode("basis").alias("standard")).distinct()
    return spark.createDataFrame([(x["id"],) for x in s.policy.entries("standard")], "standard string").join(cited, "standard", "left_semi")


# -- table functions ---------------------------------------------------------------


def _table_functions(spark: SparkSession, d: str) -> None:
    from granary.plans import udtfs

    udtfs.register(spark, _scan(spark, d).policy)
    made.corpus(spark.read.parquet(f"{d}/part.parquet")).createOrReplaceTempView("part_wheels")


@query("u1_wheel_members", "SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 4 ELSE 5 END::BIGINT AS members, 0::BIGINT AS symlinks FROM part")
def u1(spark, d):
    """Members of every archive by a table function."""
    _table_functions(spark, d)
    return spark.sql("SELECT key, count(*) AS members, count_if(m.is_symlink) AS symlinks FROM part_wheels w, LATERAL wheel_members(w.content) m GROUP BY key")


@query("u2_python_sites", f"SELECT p_partkey AS key, line, target, used FROM part, (VALUES {', '.join(str((c[0], c[1], c[3])) for c in made.CALLS)}) v(line, target, used) WHERE p_partkey % 16 = 13")
def u2(spark, d):
    _table_functions(spark, d)
    return spark.sql("SELECT key, s.line, s.target, s.attrs['usedforsecurity'] AS used FROM part_wheels w, LATERAL py_sites(w.content, w.filename) s WHERE s.kind = 'py_call' AND s.target LIKE 'hashlib.%'")


@query(
    "u3_native_objects",
    f"SELECT p_partkey AS key, CASE p_partkey % 16 WHEN 10 THEN 'bit' || p_partkey || '/_ext.dylib' WHEN 11 THEN 'bit' || p_partkey || '/_ext.pyd' WHEN 15 THEN 'bit' || p_partkey || '/libown.a(evp.o)' ELSE {_EXT} END AS path, CASE p_partkey % 16 WHEN 10 THEN 'macho' WHEN 11 THEN 'pe' ELSE 'elf' END AS format FROM part WHERE p_partkey % 16 IN (7, 8, 9, 10, 11, 14, 15)"
)
def u3(spark, d):
    _table_functions(spark, d)
    return spark.sql("SELECT key, o.path, o.format FROM part_wheels w, LATERAL native_objects(w.content, w.filename) o")


# -- small functions and the policy's tables ---------------------------------------


def _bytes_to(df: DataFrame, f: Callable[[bytes], tuple], ddl: str, kinds: list[pa.DataType]) -> DataFrame:
    """A column of bytes (the last) replaced by what a decoder makes of it."""
    keys, names = df.columns[:-1], [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f(x or b"") for x in b.column(b.num_columns - 1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*keys, *names])

    head = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{head}, {ddl}")


@query("w7_name_bounds", "SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) <= 8192 THEN length(regexp_replace(coalesce(text, ''), '[^\\x20-\\x7e]', '', 'g')) ELSE -1 END AS printable FROM documents")
def w7(spark, d):
    """Names of at most 8 KiB, read to their end or not at all."""
    from granary.extract.native.common import Names

    def read(x: bytes) -> tuple:
        name = Names(x + b"\0").at(0)
        return (-1 if name is None else len(name),)

    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.replace("text", F.lit("\0"), F.lit("")).cast("binary").alias("text"))
    return _bytes_to(rows, read, "printable long", [pa.int64()])


@query("f6_uvarint", "SELECT o_orderkey, o_orderkey * 131 AS value, CASE WHEN o_orderkey * 131 < 128 THEN 1 WHEN o_orderkey * 131 < 16384 THEN 2 WHEN o_orderkey * 131 < 2097152 THEN 3 WHEN o_orderkey * 131 < 268435456 THEN 4 ELSE 5 END::BIGINT AS bytes FROM orders")
def f6(spark, d):
    """Numbers in base 128, low digits first."""
    from granary.extract.native.strings import _uvarint

    digit = lambda i: F.shiftrightunsigned("value", 7 * i)
    byte = lambda i: F.when((digit(i) > 0) | F.lit(i == 0), F.unhex(F.lpad(F.hex(digit(i).bitwiseAND(F.lit(127)) + F.when(digit(i + 1) > 0, 128).otherwise(0)), 2, "0"))).otherwise(F.lit(b""))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 131).alias("value")).withColumn("data", F.concat(*[byte(i) for i in range(9)]))
    return _bytes_to(rows.select("o_orderkey", "data"), lambda x: _uvarint(x, 0), "value long, bytes long", [pa.int64(), pa.int64()])


@query("p17_incompletely_read", "SELECT p_partkey AS key, p_partkey % 16 IN (10, 11, 15) AS unread FROM part")
def p17(spark, d):
    from granary.plans import linkage

    return _evidence(spark, d).select("key", linkage.incompletely_read().alias("unread"))


@query("p20_owners", "SELECT * FROM (VALUES ('crypto_distribution', 'DIST_NON_APPROVED_CRYPTO', 17::BIGINT), ('crypto_distribution', 'DIST_NON_CRYPTO_HASH', 7), ('crypto_distribution', 'DIST_SYSTEM_CRYPTO_WRAPPER', 5), ('crypto_distribution', 'DIST_BUNDLED_TRUST_STORE', 1), ('rust_crate', 'BIN_RUST_CRYPTO_CRATE', 43), ('rust_crate', 'BIN_AWS_LC_RS_CRATE', 1), ('rust_crate', 'BIN_AWS_LC_FIPS', 1), ('python_module', 'PY_IMPORT_CRYPTO_MODULE', 21), ('python_module', 'PY_INSECURE_RNG', 1), ('crypto_library', '-', 13)) v(tbl, owner, entries)")
def p20(spark, d):
    """Which rule reports an entry: its own, its table's default, or any (P20, V7)."""
    p = _scan(spark, d).policy
    out = None
    for t in ("crypto_distribution", "rust_crate", "python_module", "crypto_library"):
        own = p.frame(spark, t).select(F.lit(t).alias("tbl"), F.coalesce("owner", F.lit("-")).alias("owner"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("tbl", "owner").agg(F.count("*").alias("entries"))


@query("s29_rules_table", "SELECT * FROM (VALUES ('NON_APPROVED_CRYPTO', 'binary', 12::BIGINT), ('CONDITIONAL', 'binary', 11), ('-', 'binary', 9), ('-', 'metadata', 7), ('OPAQUE', 'metadata', 6), ('CONDITIONAL', 'python', 6), ('OPAQUE', 'binary', 5), ('CONTEXT_DEPENDENT', 'python', 4), ('CONDITIONAL', 'metadata', 2), ('OPAQUE', 'derived', 2), ('-', 'python', 2), ('NON_APPROVED_CRYPTO', 'metadata', 1), ('CONTEXT_DEPENDENT', 'metadata', 1), ('CONDITIONAL', 'derived', 1), ('CONTEXT_DEPENDENT', 'binary', 1), ('FIPS_BREAKING', 'python', 1)) v(class, layer, rules)")
def s29(spark, d):
    """The rules by class and layer, read back from the printed Markdown table."""
    import argparse
    import contextlib
    import io

    from granary import cli

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli._rules(argparse.Namespace(ruleset=None, format="md"))
    lines = [[c.strip() for c in x.strip("| ").split("|")] for x in out.getvalue().split("\n\n")[0].splitlines()[2:]]
    rows = spark.createDataFrame([(x[0], x[1], x[3]) for x in lines], "rule_id string, layer string, class string")
    return rows.groupBy("class", "layer").agg(F.count("*").alias("rules"))


@query("o8_sorted_evidence", "SELECT p_partkey AS key, true AS sorted FROM part")
def o8(spark, d):
    """Objects by path, symbols by group, name and binding, strings by group and value."""
    inner = lambda b: (F.transform(b["matched_symbols"], lambda s: F.struct(s["group"], s["name"], s["binding"])) == F.array_sort(F.transform(b["matched_symbols"], lambda s: F.struct(s["group"], s["name"], s["binding"])))) & (b["matched_strings"] == F.array_sort(b["matched_strings"]))
    paths = F.transform("binaries", lambda b: b["path"])
    return _evidence(spark, d).select("key", (F.forall("binaries", inner) & (paths == F.array_sort(paths))).alias("sorted"))
