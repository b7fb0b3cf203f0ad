"""The engine end to end: records, sinks, cache, command line and the drop folder."""

import io
import json
import zipfile

import pyarrow as pa
import pytest

from granary.plans import scan as S
from granary.plans.policy import load
from granary.sinks import jsonl, report
from granary.sinks.cache import RecordCache
from granary.sources import synthetic, synthetic_objects, synthetic_parts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("wheels")
    for k in range(16):
        name, content = synthetic.wheel_of(k, k)
        (at / name).write_bytes(content)
    return at


@pytest.fixture(scope="module")
def scanned(spark, folder):
    return S.scan(spark, str(folder))


@pytest.fixture(scope="module")
def records(scanned):
    return [json.loads(r["line"]) for r in scanned.records().sort("filename", "path").collect()]


def test_every_wheel_has_a_full_record(records):
    assert len(records) == 16
    keys = {"schema_version", "tool", "wheel", "artifacts", "binaries", "findings", "verdict", "crypto", "errors", "errors_truncated"}
    assert all(set(r) == keys for r in records)
    shapes = [{k: set(r[k]) for k in ("wheel", "artifacts", "verdict", "crypto")} for r in records]
    assert all(s == shapes[0] for s in shapes)
    names = [r["wheel"]["filename"] for r in records]
    assert names == sorted(names)


def test_lines_are_canonical_and_repeatable(scanned, spark, folder):
    a = {r["filename"]: r["line"] for r in scanned.records().collect()}
    b = {r["filename"]: r["line"] for r in S.scan(spark, str(folder)).records().repartition(3).collect()}
    assert a == b
    for line in a.values():
        assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def test_minimal_evidence_leaves_out_names_only(spark, folder, records):
    small = [json.loads(r["line"]) for r in S.scan(spark, str(folder), evidence_level="minimal").records().sort("filename").collect()]
    assert [r["findings"] for r in small] == [r["findings"] for r in records]
    assert all(not b["matched_symbols"] and not b["rust_crates"] for r in small for b in r["binaries"])


def test_jsonl_and_resume(spark, scanned, tmp_path):
    out = str(tmp_path / "out")
    jsonl.write(scanned.records(), out)
    assert spark.read.text(out).count() == 16
    kept = {r["filename"] for r in jsonl.resumable(spark, out).collect()}
    assert len(kept) == 15 and "pkg6-1.0-py3-none-any.whl" not in kept


def test_records_fit_their_schema(records):
    from granary.sinks.schema import mismatches, record_schema

    schema = record_schema(load().precedence)
    assert [m for r in records for m in mismatches(r, schema)] == []
    assert mismatches(records[0] | {"more": 1}, schema) == ["$.more is unknown"]
    assert mismatches({k: v for k, v in records[0].items() if k != "errors"}, schema) == ["$.errors is missing"]
    assert mismatches(records[0] | {"errors_truncated": 1}, schema) and mismatches(records[0] | {"crypto": {"families": ["wood"], "libraries": []}}, schema)


def test_wheels_stay_where_they_are_read(spark, folder, scanned):
    """No exchange has contents in it, and overlapping inputs give each wheel once."""
    from granary.sources.discovery import names, only, wheels

    found = wheels(spark, str(folder), str(folder / "pkg5-1.0-py3-none-any.whl"), f"{folder}/")
    assert found.count() == 16
    plan = S.evidence(found, load())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    some = names(found).where("filename < 'pkg13'")
    assert only(spark, some).count() == some.count() > 0 and only(spark, some.where("false")) is None


def test_cache(spark, scanned, folder, tmp_path):
    from granary.sinks.cache import keyed
    from granary.sources.discovery import wheels

    cache, keys = RecordCache(spark, f"file://{tmp_path}", "43"), keyed(wheels(spark, str(folder)))
    assert cache.misses(keys).count() == 16 and cache.found(keys).count() == 0
    cache.put(scanned.records())
    cache.put(scanned.records())
    assert [r["filename"] for r in cache.misses(keys).collect()] == ["pkg6-1.0-py3-none-any.whl"]
    assert sorted(r["line"] for r in cache.found(keys).collect()) == sorted(r["line"] for r in scanned.records().where("filename not like 'pkg6-%'").collect())
    assert RecordCache(spark, f"file://{tmp_path}", "44").read().count() == RecordCache(spark, f"file://{tmp_path}", "43", limits="9/9").read().count() == 0


def test_counts_of_a_scan(spark, scanned):
    from pyspark.sql import Observation

    seen = Observation("counts")
    n = scanned.records(seen).count()
    assert seen.get["wheels"] == n == 16 and seen.get["errors"] == 1
    assert sum(seen.get[c] for c in load().precedence) == 16 and seen.get["with_crypto"] == 16 - seen.get["NO_CRYPTO_DETECTED"]


def test_bounds_on_members_and_archives(spark, folder):
    from granary.extract.archive import Bounds
    from granary.sources.discovery import wheels

    one = wheels(spark, str(folder / "pkg0-1.0-py3-none-any.whl"))
    kinds = lambda b: {e["kind"] for e in S.evidence(one, load(), b).first()["errors"]}
    assert kinds(Bounds()) == set() and kinds(Bounds(member=500)) == {"binary_too_large"} and kinds(Bounds(total=500)) == {"size_limit_exceeded"}


def test_fetching(spark, tmp_path):
    from granary.sources import discovery

    pages = spark.createDataFrame([("https://host/simple/a/", '<a href="a-1.0-py3-none-any.whl#sha256=1">a</a><a href="../b/b%2Bx-1.0-py3-none-any.whl">b</a><a href="c.zip">c</a>')], "url string, html string")
    links = discovery.index_links(pages, "url", "html")
    assert {r["link"] for r in links.collect()} == {"https://host/simple/a/a-1.0-py3-none-any.whl", "https://host/simple/b/b%2Bx-1.0-py3-none-any.whl"}
    got = discovery.fetched(links, "link", str(tmp_path / "w"), lambda u: u.encode()).collect()
    assert {r["path"].rsplit("/", 1)[-1] for r in got} == {p.name for p in (tmp_path / "w").iterdir()} == {"a-1.0-py3-none-any.whl", "b+x-1.0-py3-none-any.whl"}
    with pytest.raises(Exception):
        discovery.fetched(spark.createDataFrame([("file:///etc/x.whl",)], "link string"), "link", str(tmp_path / "v")).collect()


def test_reports(records):
    md = report.markdown(records)
    assert md.count("\n## ") == 16 and "| wheel" in md
    page = report.page(records, load())
    body = page.split('id="data">')[1].split("</script>")[0]
    data = json.loads(body)
    assert "<" not in body and set(data["rules"]) == {i for r in records for i in r["verdict"]["rule_ids"]}
    assert set(data["standards"]) == {b for r in records for f in r["findings"] for b in f["basis"]} and data["standards"]
    assert data["classes"] == load().precedence and len(data["tool"]) == 1 and set(data["class_help"]) == set(load().precedence)
    odd = records[0] | {"verdict": records[0]["verdict"] | {"class": "ODD"}}
    assert report.classes_of([odd], load().precedence)[-1] == "ODD"


def test_drop_folder(spark, folder, tmp_path):
    from granary.streaming.drop import scan_stream

    got = []
    query = scan_stream(spark, str(folder), str(tmp_path / "cp"), lambda df, n: got.extend(r["filename"] for r in df.select("filename").collect()), once=True)
    query.awaitTermination()
    assert len(got) == len(set(got)) == 16


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    from granary import cli

    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "xdg"))
    assert cli.cache_root() == tmp_path / "xdg/granary"
    assert cli.main(["scan", "-o", str(tmp_path / "x")]) == 2
    assert cli.main(["scan", str(folder), "-o", str(tmp_path / "x"), "--format", "md", "--resume"]) == 2
    assert cli.main(["scan", "--index-url", "https://host/", "-o", str(tmp_path / "x")]) == 2
    assert cli.main(["scan", str(folder), "-o", "/dev/null"]) == 2
    (tmp_path / "bad.toml").write_text("ruleset_version = 1")
    assert cli.main(["scan", str(folder), "-o", str(tmp_path / "x"), "--ruleset", str(tmp_path / "bad.toml")]) == 2
    capsys.readouterr()
    assert cli.main(["rules", "--format", "json"]) == 0 and len(json.loads(capsys.readouterr().out)["rules"]) == 71
    assert cli.main(["schema"]) == 0 and "findings" in json.loads(capsys.readouterr().out)["properties"]
    out, one = str(tmp_path / "out"), str(tmp_path / "one.jsonl")
    assert cli.main(["scan", str(folder), "-o", out]) == 0
    assert "wheels 16" in capsys.readouterr().err
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert cli.main(["scan", str(folder), "-o", out, "--resume", "--no-cache", "-q"]) == 0 and not capsys.readouterr().err
    assert sorted(lines) == sorted(r["value"] for r in spark.read.text(out).collect())
    assert cli.main(["scan", str(folder), "-o", one]) == 0  # one wheel alone is not in the cache
    assert "wheels 1," in capsys.readouterr().err
    written = open(one).read().splitlines()
    assert written == sorted(lines, key=lambda x: json.loads(x)["wheel"]["filename"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad.toml", "one.jsonl", "out", "xdg"]


def test_a_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        S.scan(spark, str(tmp_path / "nothing")).verdicts.collect()
    with pytest.raises(ValueError):
        S.scan(spark)


def test_only_relations_asked_for_are_made(spark):
    parts = spark.range(1, 17).selectExpr("id AS p_partkey", "id AS p_size")
    made = []
    s = S.Scan(synthetic.corpus(parts), keep=lambda df, name: made.append(name) or df)
    s.evidence.schema, s.evidence.schema
    assert made == ["evidence"]
    s.linkage.schema
    assert made == ["evidence", "needed", "postures", "linkage"]


@pytest.mark.parametrize("corpus", [synthetic.corpus, synthetic_parts.corpus, synthetic_objects.corpus])
def test_wheels_are_dealt_to_tasks_by_their_number(spark, corpus):
    parts = spark.range(3 * synthetic.TASK_WHEELS).coalesce(1).selectExpr("id AS p_partkey", "id AS p_size")
    assert corpus(parts).rdd.getNumPartitions() == 3


def test_archives_are_as_zipfile_writes_them():
    members = [("a/b.py", b"x = 1\n" * 50, 0o100644, True), ("a/empty", b"", 0o600, False), ("a/none.py", b"", 0o100644, True), ("a/c", b"stored", 0o600, False)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data, mode, deflated in members:
            i = zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0))
            i.external_attr = mode << 16
            z.writestr(i, data, zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED)
    assert synthetic.zipped(members) == out.getvalue()


def test_rows_are_as_arrow_gives_them():
    kind = pa.struct([("a", pa.list_(pa.struct([("x", pa.int32()), ("m", pa.map_(pa.string(), pa.string()))]))), ("b", pa.list_(pa.string()))])
    rows = [{"s": {"a": [{"x": 1, "m": [("k", "v")]}, None], "b": None}}, {"s": None}, {"s": {"a": [], "b": ["u", None]}}, {"s": {"a": None, "b": []}}] * 3
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("s", kind)]))
    assert S._rows(batch) == batch.to_pylist() == rows and S._rows(batch.slice(1, 6)) == rows[1:7]
