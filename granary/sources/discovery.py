"""Finding wheels: folders, listing files and index pages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urldefrag, urljoin, urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.keep import kept


def ordered(paths: DataFrame, path: str) -> DataFrame:
    """Distinct paths with their file name and place in (filename, path) order.

    The places of a whole corpus come from a global sort with counts per range: window
    functions without a partition would put all rows in one task."""
    rows = paths.select(path).distinct().withColumn("filename", F.substring_index(path, "/", -1))
    # kept, as both uses below must see the same ranges
    at = kept(rows.sort("filename", path).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "ordered")
    sizes = at.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return at.join(F.broadcast(before), "_part").select(path, "filename", (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("ordinal"))


def listed(lines: DataFrame, line: str) -> DataFrame:
    """Entries of a listing: trimmed, without blanks and # comments (S3)."""
    out = lines.withColumn(line, F.trim(line))
    return out.where((F.col(line) != "") & ~F.startswith(F.col(line), F.lit("#")))


def index_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Wheel links of PEP 503 pages: absolute, without fragments, distinct."""

    @F.arrow_udf("string")
    def absolute(base: pa.Array, href: pa.Array) -> pa.Array:
        both = zip(base.to_pylist(), href.to_pylist(), strict=True)
        return pa.array([None if b is None or h is None else urldefrag(urljoin(b, h))[0] for b, h in both], pa.string())

    links = pages.select(url, F.explode(T.hrefs(html)).alias("href"))
    return links.select(url, absolute(url, "href").alias("link")).where(F.col("link").endswith(".whl")).distinct()


def fetched(links: DataFrame, link: str, folder: str, fetch: Callable[[str], bytes] | None = None) -> DataFrame:
    """(link, path) of wheels fetched into a folder that all executors share; what is there
    already is not fetched again (S5).  Written aside and renamed, so a lost task leaves no
    half of a wheel.  `fetch` reads a URL; by default only http and https are."""
    get = fetch or _over_http

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Path(folder)
        at.mkdir(parents=True, exist_ok=True)
        for b in batches:
            urls, paths = b.column(0).to_pylist(), []
            for u in urls:
                target = at / unquote(urlsplit(u).path).rsplit("/", 1)[-1]
                if not target.exists():
                    partial = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                    partial.write_bytes(get(u))
                    partial.replace(target)
                paths.append(str(target))
            yield pa.RecordBatch.from_pydict({"link": pa.array(urls, pa.string()), "path": pa.array(paths, pa.string())})

    return links.select(F.col(link).alias("link")).distinct().mapInArrow(run, "link string, path string")


def _over_http(url: str) -> bytes:
    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not fetched: {url}")
    with urlopen(Request(url, headers={"User-Agent": "granary"}), timeout=30) as r:
        return r.read()


def _roots(inputs: tuple[str, ...]) -> list[str]:
    """Inputs without repeats and without those below another one."""
    given = sorted({x.rstrip("/") or "/" for x in inputs})
    return [x for x in given if not any(x != y and x.startswith(y.rstrip("/") + "/") for y in given)]


def wheels(spark: SparkSession, *inputs: str) -> DataFrame:
    """(path, filename, content, size_bytes) of wheels below folders or at paths.  Nothing is
    joined or sorted here: contents stay with the task that reads them, and the order of
    outputs is made from names when records are written."""
    if not inputs:
        raise ValueError("nothing to scan")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.whl").option("recursiveFileLookup", "true").load(_roots(inputs))
    return raw.select("path", F.substring_index("path", "/", -1).alias("filename"), "content", F.col("length").alias("size_bytes"))


def names(found: DataFrame) -> DataFrame:
    """(path, filename) of wheels; their contents are not read for it."""
    return found.select("path", "filename")


def only(spark: SparkSession, paths: DataFrame) -> DataFrame | None:
    """The wheels at the paths of (path), None if there are none.  The driver holds the paths
    of a file scan in any case."""
    chosen = [r["path"] for r in paths.select("path").distinct().collect()]
    return wheels(spark, *chosen) if chosen else None


def from_listing(spark: SparkSession, listing: str) -> DataFrame:
    """Wheels that a listing file names, a path a line."""
    lines = listed(spark.read.text(listing), "value")
    return wheels(spark, *[r["value"] for r in lines.distinct().collect()])
