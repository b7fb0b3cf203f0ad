"""Decoders as SQL table functions: what a wheel's bytes hold, row by row.

    register(spark)
    SELECT f.path, m.name, m.size FROM binary_files f, LATERAL wheel_members(f.content) m

A function reads the archive once a call; a whole scan decodes everything at once and is the
way to go for a corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.extract import metadata, wheel
from granary.extract.archive import UNREADABLE, Archive
from granary.plans.policy import Policy, load


def register(spark: SparkSession, policy: Policy | None = None) -> None:
    """Register wheel_members, sbom_components, py_sites and native_objects for SQL."""
    p = policy or load()
    arguments = p.patterns(), p.targets(), p.limits, p.conventions

    def opened(content: bytes | None) -> Archive | None:
        try:
            return Archive(content or b"")
        except UNREADABLE:
            return None

    @F.udtf(returnType="name string, size bigint, compressed_size bigint, is_symlink boolean, mode int")
    class Members:
        """Members of an archive; none of what is no archive."""

        def eval(self, content: bytes) -> Iterator[tuple]:
            a = opened(content)
            for name in sorted(a.members) if a else ():
                m = a.members[name]
                yield name, m.size, m.compressed, m.is_symlink, m.mode

    @F.udtf(returnType="name string, version string, purl string, source string")
    class Components:
        def eval(self, content: bytes, filename: str) -> Iterator[tuple]:
            a = opened(content)
            for c in metadata.read(a, filename or "")[1] if a else ():
                yield c["name"], c["version"], c["purl"], c["source"]

    def evidence(content: bytes, filename: str) -> dict:
        return wheel.extract(content or b"", filename or "", *arguments)

    @F.udtf(returnType="path string, line int, kind string, target string, detail string, attrs map<string, string>")
    class Sites:
        def eval(self, content: bytes, filename: str) -> Iterator[tuple]:
            for s in evidence(content, filename)["py_sites"]:
                yield s["path"], s["line"], s["kind"], s["target"], s["detail"], dict(s["attrs"])

    @F.udtf(returnType="path string, format string, machine string, soname string, needed array<string>, partial_reasons array<string>")
    class Objects:
        def eval(self, content: bytes, filename: str) -> Iterator[tuple]:
            for b in evidence(content, filename)["binaries"]:
                yield b["path"], b["format"], b["machine"], b["soname"], b["needed"], b["partial_reasons"]

    for name, f in (("wheel_members", Members), ("sbom_components", Components), ("py_sites", Sites), ("native_objects", Objects)):
        spark.udtf.register(name, f)
