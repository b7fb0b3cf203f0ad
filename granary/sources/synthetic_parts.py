"""Wheels that differ in metadata, sources and less usual tables: a third corpus with closed forms.

Shape by p_partkey modulo 16: 0 no dist-info folder, 1 two of them, 2 no METADATA, 3 METADATA
that is not UTF-8, 4 no WHEEL, 5 no RECORD, 6 headers of all kinds and a name with capitals,
7 a `.symtab` alone, 8 a `.symtab` beside `.dynsym`, 9 a banner in code, 10 a Mach-O header
cut short, 11 a PE image without its headers, 12 assignments of many forms, 13 hash calls of
many forms, 14 quotes in a banner, 15 ar members in the BSD form and one cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.sources import synthetic as S
from granary.sources import synthetic_objects as O

ASSIGNMENTS = b"""import ssl
from ssl import CERT_NONE as NOTHING
ctx = ssl.SSLContext()
ctx.verify_mode = NOTHING
(ctx.check_hostname, other) = False, True
[*rest, ctx.options] = thing()
ctx.options |= ssl.OP_NO_SSLv2
ctx.minimum_version: object = ssl.TLSVersion.TLSv1
if other:
    ctx.set_ciphers("ALL")
"""
HASHES = b"""import hashlib
from hashlib import md5 as digest, new
digest(b"")
hashlib.new("MD5", b"", usedforsecurity=False)
new("sha1", **options)
hashlib.new(name)
hashlib.sha1(usedforsecurity=flag)
hashlib.sha256(b"")
digest(b""); digest(b"")
"""
#: Calls that HASHES makes: line, target, algorithm, usedforsecurity.
CALLS = [
    (3, "hashlib.md5", "md5", "absent"),
    (4, "hashlib.new", "md5", "false"),
    (5, "hashlib.new", "sha1", "unresolved"),
    (6, "hashlib.new", "unresolved", "absent"),
    (7, "hashlib.sha1", "sha1", "unresolved"),
    (9, "hashlib.md5", "md5", "absent")
]


def _with(members: dict[str, bytes], drop: str | None = None, change: dict[str, bytes] | None = None) -> bytes:
    """A wheel of the members without one of the dist-info folder, and with others replaced or
    added; added ones are stored as they are."""
    new = dict(change or {})
    kept = [(n, new.pop(n, data), 0o100644, True) for n, data in members.items() if drop is None or not n.endswith(f".dist-info/{drop}") and not (drop == "*" and ".dist-info/" in n)]
    return S.zipped([*kept, *((n, data, 0o600, False) for n, data in new.items())])


def _bsd(members: dict[str, bytes], tail: bytes = b"") -> bytes:
    out = b"!<arch>\n"
    for name, body in members.items():
        n = name.encode() + bytes(-len(name) % 4)
        out += f"{f'#1/{len(n)}':<16}{0:<12}{0:<6}{0:<6}{100644:<8}{len(n) + len(body):<10}`\n".encode() + n + body + b"\n" * ((len(n) + len(body)) & 1)
    return out + tail


def _tables(dynamic: bool) -> bytes:
    """A static table with a definition, an import and a file's name; with or without a dynamic one."""
    strtab, at = O.names("EVP_DigestInit_ex", "RAND_bytes", "MD5_source.c")
    rows = bytes(24) + b"".join(O.struct.pack("<IBBHQQ", at[n], info, 0, shndx, 0, 0) for n, info, shndx in (("EVP_DigestInit_ex", 0x12, 1), ("RAND_bytes", 0x12, 0), ("MD5_source.c", 4, 0xFFF1)))
    sections = [O.text(b"plain words of a library"), (".symtab", 2, 0, 0, rows, ".strtab", 24), (".strtab", 3, 0, 0, strtab, "", 0)]
    if dynamic:
        dynstr, where = O.names("RAND_bytes")
        sections += [(".dynstr", 3, 2, 0x100, dynstr, "", 0), (".dynsym", 11, 2, 0, O.symbols((where["RAND_bytes"], False)), ".dynstr", 24)]
    return O.elf(sections)


def wheel_of(key: int) -> tuple[str, bytes]:
    shape, name = key % 16, f"bit{key}"
    ext, info = f"{name}/_ext.so", f"{name}-1.0.dist-info"
    files: dict[str, bytes] = {f"{name}/__init__.py": b"VALUE = 1\n"}
    if shape == 7:
        files[ext] = _tables(False)
    elif shape == 8:
        files[ext] = _tables(True)
    elif shape == 9:
        files[ext] = O.elf([O.text(b"plain words of a library"), (".text", 1, 6, 0, b"\x90\x90AWS-LC FIPS 2.0.0\0OpenSSL 3.0.0\0", "", 0)])
    elif shape == 10:
        files[f"{name}/_ext.dylib"] = b"\xcf\xfa\xed\xfe" + O.struct.pack("<iiIIIII", 0x0100000C, 0, 6, 1, 1 << 30, 0, 0) + b"OpenSSL 3.0.14 4 Jun 2024\0" + bytes(40)
    elif shape == 11:
        files[f"{name}/_ext.pyd"] = b"MZ" + bytes(62) + b"OpenSSL 3.0.14 4 Jun 2024\0" + bytes(40)
    elif shape == 12:
        files[f"{name}/net.py"] = ASSIGNMENTS
    elif shape == 13:
        files[f"{name}/sums.py"] = HASHES
    elif shape == 14:
        files[ext] = O.elf([O.text(b"it's OpenSSL 3.0.14 \\ here\0OPENSSLDIR: \"it's\" here")])
    elif shape == 15:
        files[f"{name}/libown.a"] = _bsd({"evp.o": _tables(False), "notes": b"nothing"}, b"short.o/        0")
    members = S.members(name, "1.0", files)
    if shape == 0:
        wheel = _with(members, "*")
    elif shape == 1:
        wheel = _with(members, change={"other-2.0.dist-info/METADATA": b"Name: other\n"})
    elif shape in (2, 4, 5):
        wheel = _with(members, {2: "METADATA", 4: "WHEEL", 5: "RECORD"}[shape])
    elif shape == 3:
        wheel = _with(members, change={f"{info}/METADATA": f"Name: {name}\nVersion: 1.0\nSummary: \xff\n".encode("latin-1")})
    elif shape == 6:
        meta = f"﻿Name: Bit{key}\nVersion: 9\nRequires-Python: >=3.9\nRequires-Dist: Zed.Lib[x]>=1\nRequires-Dist: a_b; extra == 't'\nRequires-Dist: Zed.Lib[x]>=1\nRequires-Dist: !bad\n"
        wheel = _with(members, change={f"{info}/METADATA": meta.encode(), f"{info}/WHEEL": b"Generator: maturin 1.4.0\nRoot-Is-Purelib: FALSE\nTag: cp39-abi3-linux_x86_64\n"})
    else:
        wheel = _with(members)
    return f"{name}-1.0-py2.py3-none-any.whl", wheel


def corpus(parts: DataFrame, key: str = "p_partkey") -> DataFrame:
    """(key, filename, ordinal, content): a wheel for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [wheel_of(k) for k in b.column(0).to_pylist()]
            if made:
                yield pa.RecordBatch.from_pydict({"key": b.column(0), "filename": pa.array([n for n, _ in made]), "ordinal": b.column(0), "content": pa.array([c for _, c in made], pa.binary())})

    return S.dealt(parts, key).mapInArrow(run, "key long, filename string, ordinal long, content binary")
