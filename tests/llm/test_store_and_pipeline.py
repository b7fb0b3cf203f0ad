"""The shard store and the pipeline."""

import json

import pytest
from pyspark.sql import functions as F

from granary.llm import jaccard, sharding

from .conftest import prose
from .test_models import plain_matches
from .test_similarity import classes, sets


def rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def test_store_keeps_all_rows_through_compaction(spark, docs, repeated, tmp_path):
    s = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=200_000)
    both = docs.unionByName(repeated).repartition(8)
    assert s.append(both, arrivals=4, key="doc_id") == 4 and [len(s.manifest(v)["shards"]) > 0 for v in (1, 2, 3, 4)] == [True] * 4
    assert sum(s.read(v).count() - (s.read(v - 1).count() if v > 1 else 0) for v in (1, 2, 3, 4)) == both.count()
    s.append(docs)
    want = rows(both.unionByName(docs))
    before = s.manifest()
    assert rows(s.read()) == want and before["version"] == 5
    after = s.compact()
    assert after > 5 and len(s.manifest()["shards"]) < len(before["shards"])
    assert rows(s.read()) == want and rows(s.read(5)) == want
    assert s.vacuum(1) > 0
    assert s.versions() == [after] and rows(s.read()) == want


def test_parts_are_taken_over_and_rewritten_only_where_shards_go(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 2)
    s = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20)
    s.append(docs.repartition(5))
    first = s.head()["parts"]
    assert [p["shards"] for p in first] == [2, 2, 1] and sum(p["rows"] for p in first) == docs.count()
    s.append(docs.limit(3).coalesce(1))
    assert s.head()["parts"][:3] == first
    shards = s.manifest()["shards"]
    s._commit([], {shards[0]["path"]})
    now = s.head()["parts"]
    assert [p["file"] for p in now[1:]] == [p["file"] for p in s.head(2)["parts"][1:]] and now[0]["shards"] == 1
    with pytest.raises(sharding.CommitConflict):
        s._commit([], {shards[0]["path"]})


def test_vacuum_finds_what_failed_writers_left(spark, docs, tmp_path):
    s = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    s.append(docs)
    docs.write.parquet(f"file://{tmp_path}/store/data/failed")
    s._parts([{"path": "x", "bytes": 1, "rows": 1, "tier": 0}])
    assert s.vacuum() == 0 and len(list((tmp_path / "store/data/failed").glob("*.parquet"))) > 0
    assert s.vacuum(grace=-1) > 0 and not list((tmp_path / "store/data/failed").glob("*.parquet"))
    assert len(list((tmp_path / "store/manifest").glob("part-*"))) == 1 and rows(s.read()) == rows(docs)


def test_settings_of_the_session_stay(spark, docs, tmp_path):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    s = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20)
    s.append(docs.repartition(9))
    s.compact()
    assert spark.conf.get(name) == before and len(s.manifest()["shards"]) < 9


def test_empty_appends_and_missing_versions(spark, empty, tmp_path):
    s = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError):
        s.read()
    s.append(empty)
    assert s.read().count() == 0 and s.read().columns == empty.columns
    s.append(empty, arrivals=4, key="doc_id")
    assert s.read().count() == 0


def test_commits_do_not_overwrite_one_another(spark, docs, tmp_path, monkeypatch):
    a, b = (sharding.ShardStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    a.append(docs)
    held, head = a.head(), a.head
    seen = []

    def slow(version=None):  # another writer commits between reading and writing
        if not seen:
            seen.append(b.append(docs))
            return held
        return head(version)

    monkeypatch.setattr(a, "head", slow)
    assert a._commit([{"path": "x", "bytes": 1, "rows": 0, "tier": 1}]) == 3
    assert len(head(3)["parts"]) == len(head(2)["parts"]) + 1 and len(a.manifest(3)["shards"]) == len(a.manifest(2)["shards"]) + 1


def test_manifests_are_json(spark, docs, tmp_path):
    s = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    s.append(docs)
    m = json.loads((tmp_path / "store/manifest/0000000001.json").read_text())
    assert sum(x["rows"] for x in m["parts"]) == docs.count()


def plain_stage(spark, name, docs, src):
    """doc_ids that a stage keeps, from scores of all rows or by brute force."""
    from granary.llm import quality, toxicity

    labelled, labels = (spark.read.parquet(f"{src}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    if name == "toxicity":
        return {r["doc_id"] for r in toxicity.scored(docs, labelled, labels, 0.3).where("predicted = 0").collect()}
    if name == "quality":
        return {r["doc_id"] for r in quality.scored(docs, labelled, labels, 0.7).where("predicted = 1").collect()}
    if name == "near_duplicates":
        return {k for k, c in classes(sets(texts)).items() if k == c}
    items = [tuple(r) for r in spark.read.parquet(f"{src}/benchmark.parquet").select("item_id", "text").collect()]
    return set(texts) - {k for k, _ in plain_matches(list(texts.items()), items)}


def test_pipeline_stages_keep_what_they_should(spark, tmp_path):
    import corpus_pipeline as P

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    columns, dropped = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, src)
        if i < len(P.STAGES) - 1:
            assert out.columns == columns, name
            want, before = plain_stage(spark, name, docs, src), rows(docs)
            path = str(tmp_path / name)
            out.write.parquet(path)
            now = spark.read.parquet(path)
            assert set(rows(now)) <= set(before) and {r["doc_id"] for r in now.collect()} == want and now.count() == len(want), name
            dropped[name] = docs.count() - now.count()
            docs = now
    assert all(dropped.values())
    lengths = {r["doc_id"]: (r["n"], r["first"], r["last"]) for r in out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.min("start").alias("first"), F.max(F.col("start") + F.col("length")).alias("last")).collect()}
    assert lengths.keys() == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(first == 0 and last == n for n, first, last in lengths.values())
    assert out.where(F.col("length") > 1024).count() == 0


def test_rows_without_ids_and_repeated_rows_are_judged_each(spark):
    d = spark.createDataFrame([(None, prose(1, 30)), (None, prose(1, 30)), (3, prose(1, 30)), (3, prose(1, 30)), (4, prose(1, 30)), (5, prose(2, 30)), (5, prose(3, 30)), (6, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in jaccard.deduplicated(d).collect()))
    assert got == sorted([(0, prose(1, 30)), (0, prose(1, 30)), (3, prose(1, 30)), (5, prose(2, 30)), (5, prose(3, 30)), (6, "")])
