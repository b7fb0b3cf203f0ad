"""The relational operators bound to the test tables, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VENDOR_GLOBS = ["*.libs", ".dylibs", "*.dylibs"]
PRECEDENCE = ["NON_APPROVED_CRYPTO", "FIPS_BREAKING", "CONDITIONAL", "CONTEXT_DEPENDENT", "OPAQUE", "NO_CRYPTO_DETECTED"]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- sources -----------------------------------------------------------------------


@query("s1_ordered_listing", "SELECT url, regexp_extract(url, '([^/]*)$', 1) AS filename, row_number() OVER (ORDER BY regexp_extract(url, '([^/]*)$', 1), url) AS ordinal FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)")
def s1(spark, d):
    from granary.sources.discovery import ordered

    return ordered(_t(spark, d, "pages").where("url is not null").select("url"), "url")


@query("s3_listing_source", "SELECT conv_id, turn, trim(line) AS line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')")
def s3(spark, d):
    lines = _t(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    from granary.sources.discovery import listed

    return listed(lines, "line")


@query("s4_index_links", """SELECT page_id, href, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"''#]*)', 1)) AS href FROM pages) GROUP BY ALL""")
def s4(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(T.hrefs("html")).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("links"))


@query("s6_content_hash", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes FROM documents")
def s6(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query(
    "s8_limit_filter",
    "SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'binary_too_large' WHEN n_chars >= 500 AND n_chars > 20 * (doc_id % 50 + 1) THEN 'compression_ratio_exceeded' END AS error, NOT coalesce(n_chars > 4000 OR (n_chars >= 500 AND n_chars > 20 * (doc_id % 50 + 1)), false) AS within FROM documents"
)
def s8(spark, d):
    from granary.sources.wheels import limit_error

    out = _t(spark, d, "documents").withColumn("error", limit_error(F.col("n_chars"), F.col("doc_id") % 50 + 1, 4000, 500, 20))
    return out.select("doc_id", "error", F.col("error").isNull().alias("within"))


@query("s14_format_sniff", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'elf' WHEN 1 THEN 'pe' WHEN 2 THEN 'macho' WHEN 3 THEN 'ar' ELSE 'unknown' END AS format FROM orders")
def s14(spark, d):
    from granary.sources.wheels import sniffed

    heads = F.array(*[F.unhex(F.lit(x)) for x in ("7F454C4602010100", "4D5A900003000000", "CFFAEDFE07000001", "213C617263683E0A", "0011223344556677")])
    out = _t(spark, d, "orders").select("o_orderkey", F.element_at(heads, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("head"))
    return out.select("o_orderkey", sniffed(F.col("head")).alias("format"))


@query("s23_json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def s23(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("s32_resume_source", "SELECT event_id, event_type FROM events WHERE json_valid(props) AND try_cast(json_extract_string(props, '$.k') AS BIGINT) >= 10")
def s32(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long") if hasattr(F.col("props"), "try_cast") else F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").where(F.try_parse_json("props").isNotNull() & (k >= 10)).select("event_id", "event_type")


# -- predicates --------------------------------------------------------------------

_PATHS = "CASE p_partkey % 6 WHEN 0 THEN 'pkg/mod' || p_size || '.cpython-312.so' WHEN 1 THEN 'pkg.libs/libz-' || p_size || '.so.1' WHEN 2 THEN CASE p_size % 2 WHEN 0 THEN 'pkg/bin/tool' ELSE 'pkg/Bin/tool' END WHEN 3 THEN 'pkg/data.txt' WHEN 4 THEN 'pkg/run' ELSE 'a/.dylibs/LIBX.DYLIB' END"


def _members(spark, d):
    p = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    path = F.when(p == 0, F.concat(F.lit("pkg/mod"), size, F.lit(".cpython-312.so"))).when(p == 1, F.concat(F.lit("pkg.libs/libz-"), size, F.lit(".so.1"))).when((p == 2) & (F.col("p_size") % 2 == 0), "pkg/bin/tool").when(p == 2, "pkg/Bin/tool").when(p == 3, "pkg/data.txt").when(p == 4, "pkg/run").otherwise("a/.dylibs/LIBX.DYLIB")
    return _t(spark, d, "part").select("p_partkey", path.alias("path"), (F.col("p_size") * 8).alias("size"), F.when(F.col("p_partkey") % 2 == 0, 493).otherwise(420).alias("mode"), (F.col("p_partkey") % 11 == 0).alias("is_symlink"))


@query("p1_native_candidate", f"SELECT p_partkey, p_partkey % 11 <> 0 AND p_size * 8 >= 64 AND (p_partkey % 6 IN (0, 1, 2, 5) OR (p_partkey % 6 = 4 AND p_partkey % 2 = 0)) AS candidate FROM part WHERE {_PATHS} IS NOT NULL")
def p1(spark, d):
    return _members(spark, d).select("p_partkey", T.is_native_candidate("path", "size", "mode", "is_symlink", VENDOR_GLOBS).alias("candidate"))


@query("p2_vendor_path", f"SELECT p_partkey, regexp_matches({_PATHS}, '^([^/]*/)*([^/]*\\.libs|[^/]*\\.dylibs)/') AS vendored FROM part")
def p2(spark, d):
    return _members(spark, d).select("p_partkey", T.is_vendor_path("path", VENDOR_GLOBS).alias("vendored"))


_SO = "CASE p_partkey % 5 WHEN 0 THEN 'lib' || lower(replace(p_brand, '#', '')) || '.so.' || p_size || '.1' WHEN 1 THEN 'libcrypto-' || substr(md5(p_name), 1, 8) || '.so.3' WHEN 2 THEN 'LibCrypto-3-x64.DLL' WHEN 3 THEN 'usr/lib/libssl.3.dylib' ELSE 'libfoo-' || p_size || '.so' END"


def _sonames(spark, d):
    p = F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    so = F.when(
        p == 0,
        F.concat(F.lit("lib"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".so."), size, F.lit(".1"))
    ).when(p == 1, F.concat(F.lit("libcrypto-"), F.substring(F.md5("p_name"), 1, 8), F.lit(".so.3"))).when(p == 2, "LibCrypto-3-x64.DLL").when(p == 3, "usr/lib/libssl.3.dylib").otherwise(F.concat(F.lit("libfoo-"), size, F.lit(".so")))
    return _t(spark, d, "part").select("p_partkey", so.alias("soname"))


@query(
    "p3_soname_reduce",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'lib' || lower(replace(p_brand, '#', '')) WHEN 1 THEN 'libcrypto-' || substr(md5(p_name), 1, 8) WHEN 2 THEN 'libcrypto-3-x64' WHEN 3 THEN 'libssl' ELSE 'libfoo-' || p_size END AS base FROM part"
)
def p3(spark, d):
    return _sonames(spark, d).select("p_partkey", T.reduce_soname("soname").alias("base"))


@query(
    "p4_soname_normalise",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'lib' || lower(replace(p_brand, '#', '')) WHEN 1 THEN 'libcrypto' WHEN 2 THEN 'libcrypto' WHEN 3 THEN 'libssl' ELSE 'libfoo-' || p_size END AS base, p_partkey % 5 = 1 AS mangled FROM part"
)
def p4(spark, d):
    return _sonames(spark, d).select("p_partkey", T.normalise_soname("soname").alias("base"), T.is_mangled("soname").alias("mangled"))


@query("p6_opaque_object", "SELECT o_orderkey, o_orderstatus <> 'F' AND (CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 7 ELSE o_custkey % 5 END) = 0 AS opaque FROM orders")
def p6(spark, d):
    from granary.operators.evidence import is_opaque

    o = _t(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, "elf").otherwise("pe").alias("format"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("libc.so.6"))).otherwise(F.array().cast("array<string>")).alias("needed"),
        F.array().cast("array<string>").alias("matched_symbols"),
        F.array().cast("array<string>").alias("matched_strings"),
        F.array().cast("array<string>").alias("rust_crates"),
        (F.col("o_custkey") % 7).alias("dynsym_count"),
        (F.col("o_custkey") % 5).alias("symtab_count")
    )
    return o.select("o_orderkey", is_opaque().alias("opaque"))


@query("p10_costly_reasons", "SELECT l_orderkey, l_linenumber, len(list_filter([l_returnflag, l_linestatus], lambda r: r NOT IN ('N', 'O'))) > 0 AS costs FROM lineitem")
def p10(spark, d):
    from granary.operators.evidence import costs_an_answer

    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", costs_an_answer(F.array("l_returnflag", "l_linestatus"), ["N", "O"]).alias("costs"))


@query("p13_target_match", "SELECT event_id, ('ssl.' || event_type) IN ('ssl.click', 'hashlib.view') OR ('*.' || event_type) IN ('*.purchase') AS matched FROM events")
def p13(spark, d):
    return _t(spark, d, "events").select("event_id", T.target_matches(F.concat(F.lit("ssl."), F.col("event_type")), ["ssl.click", "hashlib.view", "*.purchase"]).alias("matched"))


@query("p16_source_available", "SELECT o_orderkey, (o_custkey % 3) - (o_custkey % 2) > 0 OR ((o_custkey % 3) = 0 AND o_orderkey % 2 = 0) AS source_available FROM orders")
def p16(spark, d):
    from granary.operators.evidence import source_available

    return _t(spark, d, "orders").select("o_orderkey", source_available(F.col("o_custkey") % 3, F.col("o_orderkey") % 2, F.col("o_custkey") % 2).alias("source_available"))


# -- joins -------------------------------------------------------------------------


@query("j1_dimension_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j1(spark, d):
    n = _t(spark, d, "nation").join(R.dimension(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return _t(spark, d, "customer").join(R.dimension(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query(
    "j4_priority_coalesce",
    "SELECT c_custkey, coalesce(s.s_name, n.n_name) AS name, CASE WHEN s.s_suppkey IS NOT NULL THEN 'supplier' WHEN n.n_nationkey IS NOT NULL THEN 'nation' END AS resolved_table FROM customer LEFT JOIN supplier s ON c_custkey = s.s_suppkey LEFT JOIN nation n ON c_custkey = n.n_nationkey"
)
def j4(spark, d):
    tables = [("supplier", _t(spark, d, "supplier").withColumnRenamed("s_name", "name"), "s_suppkey"), ("nation", _t(spark, d, "nation").withColumnRenamed("n_name", "name"), "n_nationkey")]
    return R.first_of_tables(_t(spark, d, "customer").select("c_custkey"), "c_custkey", tables, "name").select("c_custkey", "name", "resolved_table")


@query(
    "j7_prefix_join",
    "SELECT DISTINCT p_partkey, prefix FROM part, (SELECT DISTINCT substr(p_name, 1, k) AS prefix FROM part, (VALUES (3), (5), (8)) v(k)) x, (VALUES (3), (5), (8)) w(n) WHERE length(prefix) = n AND substr(p_name, 1, n) = prefix"
)
def j7(spark, d):
    """Names with all beginnings of three, five and eight characters that some name has."""
    p = _t(spark, d, "part")
    prefixes = p.select(F.explode(F.array(*[F.substring("p_name", 1, k) for k in (3, 5, 8)])).alias("prefix")).where("length(prefix) in (3, 5, 8)").distinct()
    return R.prefix_join(p.select("p_partkey", "p_name"), "p_name", prefixes, "prefix").select("p_partkey", "prefix")


_GROUPS = {"license": ["License", "license"], "toxic": ["idiot", "moron"], "shout": ["!!"], "symbols": ["###", "$$$"]}


@query(
    "j8_contains_groups",
    "SELECT doc_id, g AS \"group\" FROM documents, (VALUES ('license', 'License'), ('license', 'license'), ('toxic', 'idiot'), ('toxic', 'moron'), ('shout', '!!'), ('symbols', '###'), ('symbols', '$$$')) v(g, lit) WHERE contains(text, lit) GROUP BY ALL"
)
def j8(spark, d):
    return R.contains_groups(_t(spark, d, "documents"), "text", _GROUPS).select("doc_id", "group")


@query(
    "j9_dotted_prefix",
    "SELECT p_partkey, min(m) AS module FROM part, (VALUES ('pkg'), ('pkg.Brand'), ('pkg.b1'), ('other')) v(m) WHERE ('pkg.b' || p_partkey % 4 || '.c') = m OR starts_with('pkg.b' || p_partkey % 4 || '.c', m || '.') GROUP BY p_partkey"
)
def j9(spark, d):
    names = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("pkg.b"), (F.col("p_partkey") % 4).cast("string"), F.lit(".c")).alias("name"))
    modules = spark.createDataFrame([("pkg",), ("pkg.Brand",), ("pkg.b1",), ("other",)], "module string")
    return R.dotted_prefix_join(names, "name", modules, "module", ["p_partkey"])


@query("j10_sibling_resolution", "SELECT s.s_suppkey, (SELECT count(*) FROM supplier o WHERE o.s_nationkey = s.s_nationkey AND o.s_suppkey % 4 = s.s_suppkey % 3 AND o.s_suppkey <> s.s_suppkey) > 0 AS resolves FROM supplier s")
def j10(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 3).alias("wanted"), (F.col("s_suppkey") % 4).alias("own"))
    return R.sibling_counts(s, "s_nationkey", "wanted", "own").select("s_suppkey", "resolves")


@query("j11_suppress", "SELECT event_id FROM events h WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = h.user_id AND ((h.event_type = 'click' AND f.event_type = 'purchase') OR (h.event_type = 'view' AND f.event_type = 'click')))")
def j11(spark, d):
    by = spark.createDataFrame([("click", "purchase"), ("view", "click")], "event_type string, by string")
    return R.suppress(_t(spark, d, "events"), by, ["user_id"], "event_type").select("event_id")


@query(
    "j11_suppress_subject",
    "SELECT o_orderkey FROM orders h WHERE NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = h.o_custkey AND h.o_orderstatus = 'O' AND f.o_orderstatus = 'F' AND nullif(f.o_orderpriority, '5-LOW') IS NOT DISTINCT FROM nullif(h.o_orderpriority, '5-LOW'))"
)
def j11s(spark, d):
    o = _t(spark, d, "orders").withColumn("subject", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return R.suppress(o, spark.createDataFrame([("O", "F")], "o_orderstatus string, by string"), ["o_custkey"], "o_orderstatus", "subject").select("o_orderkey")


@query(
    "j13_as_of",
    "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_purchase FROM events"
)
def j13(spark, d):
    return R.as_of(_t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", "event_id", "last_purchase").select("event_id", F.coalesce("last_purchase", F.lit(-1)).alias("last_purchase"))


@query("j14_semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def j14(spark, d):
    return _t(spark, d, "orders").join(_t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("j16_resume_merge", "SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j16(spark, d):
    kept = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("long"))
    return R.resume_merge(_t(spark, d, "documents").select("doc_id"), kept, "doc_id", "quality", F.lit(-1).cast("long"))


@query("j17_cache_miss", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j17(spark, d):
    return R.misses(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


# -- aggregations ------------------------------------------------------------------


@query("a1_group_findings", """WITH p AS (SELECT DISTINCT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM p), f AS (SELECT l_returnflag, l_linestatus, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY ALL) SELECT r.l_returnflag, r.l_linestatus, f.l_partkey, max(n)::BIGINT AS occurrences, max(n) > 10 AS truncated, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) FILTER (rn <= 10) AS locations FROM r JOIN f USING (l_returnflag, l_linestatus) GROUP BY ALL""")
def a1(spark, d):
    out = R.group_findings(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_partkey"], ["l_orderkey", "l_linenumber", "l_partkey"], ["l_orderkey", "l_linenumber"])
    return out.withColumn("locations", F.array_join(F.transform("locations", lambda p: F.concat_ws(":", p["l_orderkey"].cast("string"), p["l_linenumber"].cast("string"))), ","))


_POSTURE = "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'system' WHEN o_orderkey % 7 = 0 THEN 'bundled' WHEN o_orderkey % 11 = 0 THEN 'static' WHEN o_orderkey % 13 = 0 THEN 'unknown' WHEN o_orderkey % 97 = 0 THEN 'mixed' ELSE 'none' END"


@query(
    "a5_posture_lattice",
    f"WITH p AS (SELECT o_custkey, {_POSTURE} AS posture FROM orders), s AS (SELECT o_custkey, bool_or(posture = 'mixed') AS m, count(DISTINCT posture) FILTER (posture IN ('system', 'bundled', 'static')) AS n, min(posture) FILTER (posture IN ('system', 'bundled', 'static')) AS one, bool_or(posture = 'unknown') AS u FROM p GROUP BY o_custkey) SELECT o_custkey, CASE WHEN m OR n >= 2 THEN 'mixed' WHEN n = 1 THEN one WHEN u THEN 'unknown' ELSE 'none' END AS value FROM s"
)
def a5(spark, d):
    return R.resolve_postures(_t(spark, d, "orders").withColumn("posture", F.expr(_POSTURE)), ["o_custkey"], "posture")


@query(
    "a7_verdict_precedence",
    "WITH v AS (SELECT DISTINCT o_custkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 1 WHEN '2' THEN 3 WHEN '3' THEN 4 WHEN '4' THEN 5 END AS rank FROM orders) SELECT o_custkey, coalesce(string_agg(list_extract(['NON_APPROVED_CRYPTO', 'FIPS_BREAKING', 'CONDITIONAL', 'CONTEXT_DEPENDENT', 'OPAQUE'], rank), ',' ORDER BY rank) FILTER (rank IS NOT NULL), '') AS classes, coalesce(list_extract(['NON_APPROVED_CRYPTO', 'FIPS_BREAKING', 'CONDITIONAL', 'CONTEXT_DEPENDENT', 'OPAQUE'], min(rank)), 'NO_CRYPTO_DETECTED') AS class FROM v GROUP BY o_custkey"
)
def a7(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    v = F.when(p == "1", PRECEDENCE[0]).when(p == "2", PRECEDENCE[2]).when(p == "3", PRECEDENCE[3]).when(p == "4", PRECEDENCE[4])
    return R.by_precedence(_t(spark, d, "orders").withColumn("verdict", v), ["o_custkey"], "verdict", PRECEDENCE).withColumn("classes", F.array_join("classes", ","))


@query("a10_conditions_map", "SELECT o_custkey, string_agg(k || '_linkage=' || v, ';' ORDER BY k) AS conditions FROM (SELECT o_custkey, o_orderstatus AS k, max(o_orderpriority) AS v FROM orders GROUP BY ALL) GROUP BY o_custkey")
def a10(spark, d):
    o = _t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderpriority").alias("v"))
    m = R.conditions_map(o, ["o_custkey"], "o_orderstatus", "v")
    return m.select("o_custkey", F.array_join(F.transform(F.map_entries("conditions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("conditions"))


@query("a12_inventory_counts", "SELECT source, count(*) AS files, count(*) FILTER (lang = 'en') AS english, sum(n_chars)::BIGINT AS total_chars, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def a12(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("lang") == "en").alias("english"), F.sum("n_chars").cast("long").alias("total_chars"), F.countDistinct("lang").alias("langs"))


@query(
    "a13_slice_merge",
    "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS names, sum(l_linenumber)::BIGINT AS total, coalesce(arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (l_partkey % 3 <> 0), 0) AS first_known, bool_and(l_quantity > 5) AS \"all\" FROM lineitem GROUP BY l_orderkey"
)
def a13(spark, d):
    li = _t(spark, d, "lineitem").withColumn("known", F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")))
    return R.merge_slices(
        li,
        ["l_orderkey"],
        ["l_linenumber", "l_partkey"],
        "l_returnflag",
        "l_linenumber",
        "known",
        F.col("l_quantity") > 5
    ).withColumns({"names": F.array_join("names", ","), "first_known": F.coalesce("first_known", F.lit(0))})


@query("a15_tallies", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 4")
def a15(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(4)


@query("a16_distinct_variants", "SELECT DISTINCT p_brand, p_type FROM part")
def a16(spark, d):
    return _t(spark, d, "part").select("p_brand", "p_type").distinct()


@query("a18_grouped_lists", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def a18(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


# -- windows and caps --------------------------------------------------------------


@query(
    "w1_representative_cap",
    "WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 4 = 0 AS pin, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY (l_partkey % 4 = 0) DESC, l_orderkey, l_linenumber) AS rn FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN rn = 1 AND pin THEN 1 WHEN rn = 1 THEN 2 WHEN pin THEN 3 ELSE 4 END, l_orderkey, l_linenumber) AS place FROM a) SELECT l_suppkey, l_orderkey, l_linenumber FROM b WHERE place <= 10"
)
def w1(spark, d):
    li = _t(spark, d, "lineitem")
    return R.representative_cap(li, ["l_suppkey"], ["l_returnflag"], F.col("l_partkey") % 4 == 0, ["l_orderkey", "l_linenumber"], 10).select("l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "w3_finding_aware_cap",
    "WITH o AS (SELECT DISTINCT l_suppkey, l_orderkey AS path FROM lineitem), n AS (SELECT DISTINCT l_suppkey, l_orderkey AS path, l_returnflag FROM lineitem WHERE l_linenumber = 3), u AS (SELECT l_suppkey, min(path) AS path, 1 AS c, l_returnflag AS k FROM n GROUP BY l_suppkey, l_returnflag UNION ALL SELECT l_suppkey, path, 2, path::VARCHAR FROM n UNION ALL SELECT l_suppkey, path, 3, path::VARCHAR FROM o), b AS (SELECT l_suppkey, path, min(c::VARCHAR || k) AS s FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, path) AS place FROM b) SELECT l_suppkey, path FROM r WHERE place <= 8"
)
def w3(spark, d):
    li = _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "path")
    return R.finding_cap(li.select("l_suppkey", "path"), li.where("l_linenumber = 3"), "l_suppkey", "path", ["l_returnflag"], 8)


@query("w5_duplicate_suffix", "SELECT doc_id, CASE WHEN n > 1 THEN lang || '#' || n ELSE lang END AS name FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)")
def w5(spark, d):
    return R.numbered_duplicates(_t(spark, d, "documents"), "source", "lang", ["doc_id"], "name").select("doc_id", "name")


@query("w6_running_budget", "SELECT doc_id, greatest(0, least(n_chars, 60000 - coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM documents")
def w6(spark, d):
    return R.running_budget(_t(spark, d, "documents"), "source", ["doc_id"], "n_chars", 60_000, "taken").select("doc_id", "taken")


@query(
    "w8_interval_merge",
    "WITH i AS (SELECT user_id, event_id AS s, event_id + 300 AS e FROM events), a AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY user_id ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS fresh FROM i), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM a) SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS merged FROM b GROUP BY user_id, island"
)
def w8(spark, d):
    return R.merge_intervals(_t(spark, d, "events").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 300).alias("e")), "user_id", "s", "e")


# -- sets --------------------------------------------------------------------------


@query("g1_union_distinct", "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0")
def g1(spark, d):
    lab = _t(spark, d, "labels")
    return lab.where("toxic = 1").select("doc_id").unionByName(lab.where("quality = 0").select("doc_id")).distinct()


@query("g3_array_sets", "SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct([l_returnflag, l_linestatus])), ',') AS either, l_returnflag = l_linestatus AS both FROM lineitem")
def g3(spark, d):
    a, b = F.array("l_returnflag"), F.array("l_linestatus")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("either"), (F.size(F.array_intersect(a, b)) > 0).alias("both"))


_SIDE = "SELECT CASE WHEN doc_id % 9 <> 0 THEN doc_id END AS doc_id FROM"


@query("g4_symmetric_difference", f"(SELECT doc_id, 'left' AS side FROM ({_SIDE} documents EXCEPT {_SIDE} labels)) UNION ALL (SELECT doc_id, 'right' FROM ({_SIDE} labels EXCEPT {_SIDE} documents))")
def g4(spark, d):
    """Rows of one side alone; nulls are equal, so those that both sides have are in neither."""
    side = lambda name: _t(spark, d, name).select(F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")).alias("doc_id"))
    return R.symmetric_difference(side("documents"), side("labels"))


# -- scalar functions --------------------------------------------------------------


@query("f1_clean", "SELECT doc_id, substr(trim(regexp_replace(text, '[^\\x20-\\x7e]', ' ', 'g')), 1, 200) AS cleaned FROM documents")
def f1(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.clean("text").alias("cleaned"))


@query("f2_sanitize", "SELECT doc_id, md5(regexp_replace(text, '[^\\x20-\\x7e]', '', 'g')) AS printable FROM documents")
def f2(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.sanitize("text").cast("binary")).alias("printable"))


@query("f3_clip", "SELECT doc_id, substr(regexp_replace(text, '[^\\x20-\\x7e]', '?', 'g'), 1, 200) AS clipped FROM documents")
def f3(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.clip("text").alias("clipped"))


@query("f5_abi_underscore", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '_' || s_name END AS name FROM supplier")
def f5(spark, d):
    sym = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("_"), F.col("s_name"))).otherwise(F.concat(F.lit("__"), F.col("s_name")))
    return _t(spark, d, "supplier").select("s_suppkey", T.strip_abi_underscore(sym).alias("name"))


@query("f7_split_generator", "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'custom tool' ELSE 'bdist_wheel' END AS name, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE '0.' || p_size || '.1' END AS version FROM part")
def f7(spark, d):
    p, v = F.col("p_partkey") % 3, F.concat(F.lit("0."), F.col("p_size").cast("string"), F.lit(".1"))
    raw = F.when(p == 0, F.concat(F.lit("bdist_wheel ("), v, F.lit(")"))).when(p == 1, F.concat(F.lit("bdist_wheel "), v)).otherwise("custom tool")
    return _t(spark, d, "part").select("p_partkey", T.generator_name(raw).alias("name"), T.generator_version(raw).alias("version"))


@query("f8_canonical_name", "SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', '_.'), '[-_.]+', '-', 'g')) AS canonical FROM part")
def f8(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.canonical_name(F.replace("p_name", F.lit(" "), F.lit("_."))).alias("canonical"))


@query("f10_platform_tags", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'any' ELSE 'manylinux2014_x86_64,manylinux_2_17_x86_64' END AS platforms FROM part")
def f10(spark, d):
    tags = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("py2-none-any"), F.lit("py3-none-any"))).otherwise(F.array(F.lit("cp312-cp312-manylinux_2_17_x86_64.manylinux2014_x86_64")))
    return _t(spark, d, "part").select("p_partkey", F.array_join(T.platform_tags(tags), ",").alias("platforms"))


@query("f16_cache_key", "SELECT doc_id, sha256(concat_ws('|', sha256(text), lang, source, '2', '59')) AS key FROM documents")
def f16(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.cache_key(F.sha2(F.col("text").cast("binary"), 256), "lang", "source", F.lit("2"), F.lit("59")).alias("key"))


@query(
    "f20_sbom_keys",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'Ünï_' || s_name ELSE lower('Lib_' || s_name) END AS library_key, replace(CASE WHEN s_suppkey % 5 = 0 THEN 'Ünï_' || s_name ELSE lower('Lib_' || s_name) END, '_', '-') AS crate_key FROM supplier"
)
def f20(spark, d):
    name = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("Ünï_"), F.col("s_name"))).otherwise(F.concat(F.lit("Lib_"), F.col("s_name")))
    return _t(spark, d, "supplier").select("s_suppkey", T.sbom_library_key(name).alias("library_key"), T.sbom_crate_key(name).alias("crate_key"))


@query("n20_forwarder", "SELECT s_suppkey, 'KERNEL' || s_suppkey || '.dll' AS dll, 'Fn.' || s_nationkey AS symbol FROM supplier")
def n20(spark, d):
    f = F.concat(F.lit("KERNEL"), F.col("s_suppkey").cast("string"), F.lit(".Fn."), F.col("s_nationkey").cast("string"))
    return _t(spark, d, "supplier").select("s_suppkey", T.forwarder_dll(f).alias("dll"), T.forwarder_symbol(f).alias("symbol"))


@query("n24_printable_runs", "SELECT doc_id, len(regexp_extract_all(text, '[\\x20-\\x7e]{4,}'))::BIGINT AS runs, md5(array_to_string(regexp_extract_all(text, '[\\x20-\\x7e]{4,}'), chr(10))) AS joined FROM documents")
def n24(spark, d):
    r = T.printable_runs("text")
    return _t(spark, d, "documents").select("doc_id", F.size(r).cast("long").alias("runs"), F.md5(F.array_join(r, "\n").cast("binary")).alias("joined"))


@query(
    "r1_summary_row",
    "SELECT c_custkey, coalesce(string_agg(o_orderstatus || ':' || n, ', ' ORDER BY o_orderstatus), '-') AS libraries FROM customer LEFT JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) ON c_custkey = o_custkey GROUP BY c_custkey"
)
def r1(spark, d):
    o = _t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").count().groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.concat_ws(":", "o_orderstatus", F.col("count").cast("string")))).alias("l"))
    return _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", T.or_dash(F.coalesce("l", F.array().cast("array<string>"))).alias("libraries"))


@query(
    "r3_reasons_summary",
    "SELECT o_custkey, array_to_string(list_slice(l, 1, 3), '; ') || CASE WHEN len(l) > 3 THEN '; +' || (len(l) - 3) || ' more' ELSE '' END AS reasons FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey::VARCHAR)) AS l FROM orders GROUP BY o_custkey)"
)
def r3(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))).alias("l")).select("o_custkey", T.first_and_more("l").alias("reasons"))


@query("r9_script_safe", "SELECT page_id, md5(replace(replace(replace(html, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')) AS embedded FROM pages")
def r9(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(T.script_safe("html").cast("binary")).alias("embedded"))


@query(
    "v16_suppression_cycle",
    "WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey <> n_regionkey), w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT a AS node, bool_or(a = b) AS cyclic FROM w GROUP BY a"
)
def v16(spark, d):
    from granary.operators.graph import cyclic_nodes

    e = _t(spark, d, "nation").where("n_nationkey <> n_regionkey").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    return cyclic_nodes(e)


# -- more of the inventory ---------------------------------------------------------


@query("p5_own_stem", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'libme' ELSE 'libother' END AS stem FROM part")
def p5(spark, d):
    declared = F.when(F.col("p_partkey") % 2 == 0, "libme.so.1.2")
    return _t(spark, d, "part").select("p_partkey", T.reduce_soname(F.coalesce(declared, F.lit("pkg/lib/libother.so.3"))).alias("stem"))


@query("p14_evidence_level", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS shown FROM lineitem")
def p14(spark, d):
    level = F.when(F.col("l_linenumber") % 2 == 0, "standard").otherwise("minimal")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.size(F.when(level == "standard", F.array("l_returnflag")).otherwise(F.array().cast("array<string>"))).alias("shown"))


@query("p15_scan_aborted", "SELECT event_id, event_type IN ('click', 'purchase') AS aborted FROM events")
def p15(spark, d):
    errors = F.array(F.struct(F.col("event_type").alias("kind")))
    return _t(spark, d, "events").select("event_id", F.exists(errors, lambda e: e["kind"].isin("click", "purchase")).alias("aborted"))


@query("p19_cargo_purl", "SELECT s_suppkey, s_suppkey % 3 = 0 AS cargo FROM supplier")
def p19(spark, d):
    purl = F.when(F.col("s_suppkey") % 3 == 0, "pkg:cargo/ring@1").when(F.col("s_suppkey") % 3 == 1, "pkg:pypi/ring@1")
    return _t(spark, d, "supplier").select("s_suppkey", F.coalesce(F.startswith(purl, F.lit("pkg:cargo/")), F.lit(False)).alias("cargo"))


@query("j3_soname_library", "SELECT p_partkey, 'openssl' AS library FROM part WHERE p_partkey % 5 IN (1, 2, 3)")
def j3(spark, d):
    dim = spark.createDataFrame([("libcrypto", "openssl"), ("libssl", "openssl"), ("libsodium", "libsodium")], "known string, library string")
    return _sonames(spark, d).withColumn("base", T.normalise_soname("soname")).join(R.dimension(dim), F.col("base") == F.col("known")).select("p_partkey", "library")


@query("j12_confirmed", "SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j12(spark, d):
    system = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, d, "lineitem").join(system, "l_orderkey", "left_semi").select("l_orderkey", "l_returnflag").distinct()


@query("o1_ordered_top", "SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 25")
def o1(spark, d):
    from pyspark.sql import Window

    top = _t(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(25)  # the report's feature
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("place"))


@query("g5_reason_complement", "SELECT l_orderkey, l_linenumber, array_to_string(list_filter(['A', 'N', 'R'], lambda x: x <> l_returnflag), ',') AS others FROM lineitem")
def g5(spark, d):
    every = F.array(*[F.lit(x) for x in "ANR"])
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.array_except(every, F.array("l_returnflag")), ",").alias("others"))


@query("f18_glob", "SELECT p_partkey, regexp_matches(p_name, '^.*a.$') AS matched FROM part")
def f18(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.col("p_name").rlike(T.glob_regex("*a?")).alias("matched"))


@query("w9_one_per_run", "SELECT DISTINCT doc_id, run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([\\x20-\\x7e]{4,})', 1)) AS run FROM documents) WHERE contains(run, 'licens') OR contains(run, 'Licens')")
def w9(spark, d):
    runs = _t(spark, d, "documents").select("doc_id", F.explode(T.printable_runs("text")).alias("run"))
    return R.contains_groups(runs, "run", {"license": ["licens", "Licens"]}).select("doc_id", "run").distinct()
