"""A store of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as they come, as small Parquet files that are never changed.  A
shard's tier is the power of `FAN_IN` of its size below the target.  Compaction takes a
tier with at least `FAN_IN` shards (similarly sized by construction) and rewrites them as
files near the target: Spark's file scan packs many small files into one task up to the
target, so the rewrite is a map without a shuffle.  A version is a small manifest that names parts,
immutable files with up to `PART` shards each; a commit writes parts for what is new, takes
over all others as they are, and renames the manifest to its number, which fails if another
writer was first, so readers see a whole version or none.  A writer that lost tries again
on the newer version unless its inputs are gone.  Shards that a merge could not make fewer
are marked `final` and left alone from then on.

Only DataFrame operations touch the data; manifests are small JSON files that the driver
writes through Hadoop's file system API.

Cases: all columns, nulls and texts are kept as they are, whatever the columns are called;
repeated rows stay; an append without rows adds no shard; a store without shards reads as
an empty table of its schema.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.llm import common

FAN_IN, TARGET_BYTES, PART = 4, 128 << 20, 4096
#: Seconds after which files that no version names belong to a writer that failed.
GRACE = 24 * 3600


class CommitConflict(RuntimeError):
    """Shards that a commit replaces were replaced by another writer."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # -- manifests -----------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        at = self._path("manifest")
        if not self._fs().exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _json(self, name: str) -> dict:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, name: str, data: dict) -> None:
        out = self._fs().create(self._path(name), False)
        out.write(bytearray(json.dumps(data).encode()))
        out.close()

    def head(self, version: int | None = None) -> dict:
        """A version's manifest: schema and parts."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "parts": []}
        return self._json(f"manifest/{known[-1] if version is None else version:010d}.json")

    def manifest(self, version: int | None = None) -> dict:
        """A version with all its shards."""
        m = self.head(version)
        return m | {"shards": [s for p in m["parts"] for s in self._json(f"manifest/{p['file']}")["shards"]]}

    def _parts(self, shards: list[dict]) -> list[dict]:
        """Write shards as new parts."""
        out = []
        for i in range(0, len(shards), PART):
            own = shards[i : i + PART]
            name = f"part-{uuid.uuid4().hex}.json"
            self._put(f"manifest/{name}", {"shards": own})
            out.append({"file": name, "shards": len(own), "rows": sum(x["rows"] for x in own), "bytes": sum(x["bytes"] for x in own)})
        return out

    def _commit(self, new: list[dict], gone: set[str] = frozenset(), schema: dict | None = None) -> int:
        """The next version: without the shards at the paths `gone`, with the new ones."""
        fs = self._fs()
        fs.mkdirs(self._path("manifest"))
        added = self._parts(new)
        while True:
            old = self.head()
            parts, missing = [], set(gone)
            for p in old["parts"]:
                own = self._json(f"manifest/{p['file']}")["shards"] if missing else []
                left = [x for x in own if x["path"] not in gone]
                missing -= {x["path"] for x in own}
                parts += [p] if len(left) == len(own) else self._parts(left)
            if missing:
                raise CommitConflict("another writer replaced these shards")
            head = {"version": old["version"] + 1, "parent": old["version"], "schema": old["schema"] or schema, "parts": parts + added}
            aside, final = f"manifest/.{uuid.uuid4().hex}.tmp", self._path(f"manifest/{head['version']:010d}.json")
            self._put(aside, head)
            at = self._path(aside)
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), self._conf)
            options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(fs.makeQualified(at), fs.makeQualified(final), options)
                return head["version"]
            except Exception as e:
                fs.delete(at, False)
                if "FileAlreadyExistsException" not in str(e):
                    raise

    def tier(self, size: int) -> int:
        """0 for shards near the target, and one more for every factor of FAN_IN below it."""
        return max(0, math.ceil(math.log(self.target / max(size, 1), FAN_IN) - 0.5))

    def _shards(self, run: str, schema: StructType) -> list[dict]:
        """Files of a finished write with their rows; reads no column."""
        rows = self.spark.read.schema(schema).parquet(run).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
        found = [{"path": r["path"], "bytes": r["bytes"], "rows": r["rows"], "tier": self.tier(r["bytes"])} for r in rows.collect()]
        return sorted(found, key=lambda s: s["path"])

    # -- writing -------------------------------------------------------------------

    def append(self, df: DataFrame, arrivals: int = 1, key: str | None = None) -> int:
        """Add rows as new shards and commit; the last version.  With arrivals and a key, the
        rows are written in one pass and committed as that many arrivals, one after the other."""
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        name = "arrival"
        while name in df.columns:
            name += "_"
        if arrivals > 1:
            df.withColumn(name, F.pmod(F.xxhash64(key or df.columns[0]), F.lit(arrivals))).write.partitionBy(name).parquet(run)
        else:
            df.write.parquet(run)
        by_arrival: dict[str, list[dict]] = {} if arrivals > 1 else {"": []}
        for x in self._shards(run, df.schema):
            by_arrival.setdefault(x["path"].rsplit("/", 2)[-2] if arrivals > 1 else "", []).append(x)
        version, schema = 0, json.loads(df.schema.json())
        for _, own in sorted(by_arrival.items()) or [("", [])]:
            version = self._commit(own, schema=schema)
        return version

    def compact(self) -> int:
        """Merge tiers until none below the target has FAN_IN shards; the last version."""
        while True:
            now = self.manifest()
            by_tier: dict[int, list[dict]] = {}
            for s in now["shards"]:
                if not s.get("final"):
                    by_tier.setdefault(s["tier"], []).append(s)
            due = [t for t, s in by_tier.items() if t > 0 and len(s) >= FAN_IN]
            if not due:
                return now["version"]
            self._merge(by_tier[max(due)], StructType.fromJson(now["schema"]))

    def _merge(self, shards: list[dict], schema: StructType) -> None:
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        total = sum(s["bytes"] for s in shards)
        files = max(1, round(total / self.target))
        session = self.spark.newSession()  # settings of its own: the scan packs whole files into about `files` tasks
        session.conf.set("spark.sql.files.maxPartitionBytes", max(1, -(-total // files) + max(s["bytes"] for s in shards)))
        session.conf.set("spark.sql.files.openCostInBytes", 1)
        session.conf.set("spark.sql.files.minPartitionNum", files)
        session.read.schema(schema).parquet(*[s["path"] for s in shards]).write.parquet(run)
        new = self._shards(run, schema)
        if len(new) >= len(shards):  # nothing gained, as from a scan that may not pack
            new = [s | {"final": True} for s in new]
        self._commit(new, {s["path"] for s in shards})

    def vacuum(self, keep_versions: int = 2, grace: int = GRACE) -> int:
        """Delete older manifests, and files that no kept version names: shards of older
        versions, and what writers left that failed more than `grace` seconds ago."""
        fs, known = self._fs(), self.versions()
        keep, old = known[-keep_versions:], known[:-keep_versions]
        heads = [self.head(v) for v in keep]
        live = {s["path"] for v in keep for s in self.manifest(v)["shards"]}
        was = {s["path"] for v in old for s in self.manifest(v)["shards"]}
        parts = {p["file"] for m in heads for p in m["parts"]}
        was_parts = {p["file"] for v in old for p in self.head(v)["parts"]}
        for v in old:
            fs.delete(self._path(f"manifest/{v:010d}.json"), False)
        now, gone = self._jvm.java.lang.System.currentTimeMillis(), 0

        def stale(status, known_dead: bool) -> bool:
            return known_dead or now - status.getModificationTime() > 1000 * grace

        for f in fs.listStatus(self._path("manifest")):
            name = f.getPath().getName()
            if name.startswith(("part-", ".")) and name not in parts and stale(f, name in was_parts):
                fs.delete(f.getPath(), False)
        plain = lambda p: p.replace("file:///", "file:/")
        live_plain, was_plain = {plain(p) for p in live}, {plain(p) for p in was}
        files = fs.listFiles(self._path("data"), True) if fs.exists(self._path("data")) else None
        while files is not None and files.hasNext():
            f = files.next()
            at = plain(f.getPath().toString())
            if at.endswith(".parquet") and at not in live_plain and stale(f, at in was_plain):
                gone += bool(fs.delete(f.getPath(), False))
        return gone

    # -- reading -------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, the latest unless told otherwise."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError(f"no version at {self.root}")
        schema = StructType.fromJson(m["schema"])
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in m["shards"]])


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents through eight arrivals and a compaction, read from the last manifest."""
    store = ShardStore(spark, f"{common.shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes=32 << 20)
    store.append(common.documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars"), arrivals=8, key="doc_id")
    store.compact()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
