"""Wheels whose objects are awkward: a second corpus with closed-form answers.

Shape by p_partkey modulo 16: 0 two hundred crates and `ring` behind them, 1 a vendor folder
beside and one inside a registry crate, 2 an executable without suffix in `Bin/`, 3 a fork of
OpenSSL, 4 a Go program, 5 a universal Mach-O library, 6 more objects than a record lists
(every tenth; pure Python else), 7 an object without anything to read, 8 an object without
section table, 9 a decoy in place of the string table of `.symtab`, 10 a `.dynsym` that
declares fewer rows than it has names, 11 a compressed section, whole or (every second key of
these) too large by its own account, 12 an SBOM that names OpenSSL, 13 an old TLS constant,
14 a dependency next to a vendor folder of which not all could be read, 15 errors of many
kinds.
"""

from __future__ import annotations

import io
import stat
import struct
import warnings
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.sources import synthetic as S

MANY = 260


def elf(sections: list[tuple[str, int, int, int, bytes, str, int]], table: bool = True) -> bytes:
    """A 64-bit little-endian library of (name, type, flags, address, bytes, linked section, row size)."""
    titles = b"\0" + b"".join(s[0].encode() + b"\0" for s in sections) + b".shstrtab\0"
    every = [*sections, (".shstrtab", 3, 0, 0, titles, "", 0)]
    index = {s[0]: i + 1 for i, s in reversed(list(enumerate(every)))}
    body, headers = bytearray(64), [bytes(64)]
    for name, kind, flags, addr, data, link, size in every:
        headers.append(struct.pack("<IIQQQQIIQQ", titles.index(b"\0" + name.encode() + b"\0") + 1, kind, flags, addr, len(body), len(data), index.get(link, 0), 0, 1, size))
        body += data
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, len(body) if table else 0, 0, 64, 0, 0, 64, len(headers) if table else 0, len(headers) - 1 if table else 0)
    body[: len(head)] = head
    return bytes(body) + (b"".join(headers) if table else b"")


def names(*texts: str) -> tuple[bytes, dict[str, int]]:
    """A string table and the place of each text."""
    out, at = bytearray(b"\0"), {}
    for t in texts:
        at[t] = len(out)
        out += t.encode() + b"\0"
    return bytes(out), at


def symbols(*rows: tuple[int, bool]) -> bytes:
    """Rows of (place of the name, defined), after the empty first one."""
    return bytes(24) + b"".join(struct.pack("<IBBHQQ", at, 0x12, 0, int(defined), 0x1000 if defined else 0, 0) for at, defined in rows)


def text(data: bytes, flags: int = 2) -> tuple[str, int, int, int, bytes, str, int]:
    return (".rodata", 1, flags, 0, data, "", 0)


def universal(*slices: bytes) -> bytes:
    at, table, body = 4096, b"", b""
    for s in slices:
        table += struct.pack(">IIIII", 0x0100000C, 0, at + len(body), len(s), 12)
        body += s + bytes(-len(s) % 4096)
    head = struct.pack(">II", 0xCAFEBABE, len(slices)) + table
    return head + bytes(at - len(head)) + body


def go_info(version: str) -> bytes:
    return b"\xff Go buildinf:" + b"\x08\x02" + bytes(16) + bytes([len(version)]) + version.encode()


def _decoy() -> bytes:
    strtab, at = names("EVP_DigestInit_ex", "helper")
    return elf([text(b"plain words of a library"), (".symtab", 2, 0, 0, symbols((at["EVP_DigestInit_ex"], True)), ".decoy", 24), (".decoy", 3, 0, 0, bytes(64), "", 0), (".strtab", 3, 0, 0, strtab, "", 0)])


def _understated() -> bytes:
    dynstr, at = names("helper", "EVP_DigestInit_ex", "RAND_bytes")
    return elf([(".dynstr", 3, 2, 0x100, dynstr, "", 0), (".dynsym", 11, 2, 0, symbols((at["helper"], True)), ".dynstr", 24), text(b"plain words of a library")])


def _compressed(honest: bool) -> bytes:
    data = b"OpenSSL 3.0.14 4 Jun 2024\0OPENSSLDIR: \"/usr\"" + bytes(200)
    return elf([text(struct.pack("<IIQQ", 1, 0, len(data) if honest else 1 << 40, 1) + zlib.compress(data), 0x802)])


def _library(*needed: str, runpath: str | None = None) -> bytes:
    strtab, at = names(*needed, *([runpath] if runpath else []))
    rows = [(1, at[n]) for n in needed] + ([(29, at[runpath])] if runpath else []) + [(5, 0x100), (0, 0)]
    dynamic = b"".join(struct.pack("<qQ", *r) for r in rows)
    return elf([(".dynstr", 3, 2, 0x100, strtab, "", 0), (".dynamic", 6, 2, 0, dynamic, ".dynstr", 16), text(b"plain words of a library")])


def _with_link(wheel: bytes, name: str, target: str, again: str | None = None, ratio: str | None = None) -> bytes:
    """The wheel with a symlink, with a member twice, and with one that claims to unpack hugely."""
    out = io.BytesIO(wheel)
    with warnings.catch_warnings(), zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
        warnings.simplefilter("ignore")  # a member twice is meant
        i = zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0))
        i.external_attr = (stat.S_IFLNK | 0o777) << 16
        z.writestr(i, target)
        if again:
            z.writestr(zipfile.ZipInfo(again, (2020, 1, 1, 0, 0, 0)), b"again")
        if ratio:
            i = zipfile.ZipInfo(ratio, (2020, 1, 1, 0, 0, 0))
            z.writestr(i, bytes(2 << 20), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def wheel_of(key: int) -> tuple[str, bytes]:
    shape, name = key % 16, f"odd{key}"
    ext = f"{name}/_ext.so"
    files: dict[str, bytes] = {f"{name}/__init__.py": b"VALUE = 1\n"}
    cargo = b"/root/.cargo/registry/src/index.crates.io-6f17d22bba15001f/"
    more = ""
    if shape == 0:
        files[ext] = elf([text(b"\0".join(cargo + f"aaa{i:03d}-1.0.0/src/lib.rs".encode() for i in range(200)) + b"\0" + cargo + b"ring-0.17.8/src/digest.rs")])
    elif shape == 1:
        files[ext] = elf([text(cargo + b"bar-1.0.0/a b vendor/ring/src/x.rs\0" + cargo + b"baz-2.0.0/deps/vendor/sha2/src/lib.rs")])
    elif shape == 2:
        files[f"{name}/Bin/tool"] = _library("libcrypto.so.3")
    elif shape == 3:
        strtab, at = names("EVP_DigestInit_ex", "OPENSSL_is_boringssl")
        files[ext] = elf([(".dynstr", 3, 2, 0x100, strtab, "", 0), (".dynsym", 11, 2, 0, symbols((at["EVP_DigestInit_ex"], True), (at["OPENSSL_is_boringssl"], True)), ".dynstr", 24), text(b"made from BoringSSL sources")])
    elif shape == 4:
        files[f"{name}/bin/tool"] = elf([(".go.buildinfo", 1, 2, 0, go_info("go1.22.3"), "", 0), text(b"crypto/sha256.Sum256")])
    elif shape == 5:
        files[f"{name}/_ext.dylib"] = universal(S.macho(["/usr/lib/libcrypto.dylib"], [("EVP_x", False)]), S.macho(["/usr/lib/libSystem.B.dylib"], [("MD5_y", True)], "@rpath/me.dylib"))
    elif shape == 6 and key % 160 == 6:
        files |= {f"{name}/part{i:03d}.so": b"a part that is no object but has words in it, as many as it takes to count" for i in range(MANY)}
    elif shape == 7:
        files[ext] = bytes(80)
    elif shape == 8:
        files[ext] = elf([text(b"OpenSSL 3.0.14 4 Jun 2024\0and no table of sections")], table=False)
    elif shape == 9:
        files[ext] = _decoy()
    elif shape == 10:
        files[ext] = _understated()
    elif shape == 11:
        files[ext] = _compressed(key % 32 == 11)
    elif shape == 12:
        files[f"{name}-1.0.dist-info/sboms/a.json"] = b'{"components": [{"name": "OpenSSL", "version": "3.0.14"}]}'
    elif shape == 13:
        files[f"{name}/net.py"] = b"from ssl import PROTOCOL_TLSv1\nwanted = PROTOCOL_TLSv1\n"
    elif shape == 14:
        files[ext] = _library("libcrypto.so.3", "libssl.so.3", runpath=f"$ORIGIN/../{name}.libs")
    elif shape == 15:
        files[f"{name}/bad.py"] = b"def (\n"
        files[f"{name}-1.0.dist-info/sboms/b.json"] = b"["
        more = f"{name}/twice.txt"
        files[more] = b"once"
    wheel = S.build(name, "1.0", files)
    if shape == 14:
        wheel = _with_link(wheel, f"{name}.libs/libcrypto.so.3", "../elsewhere")
    if shape == 15:
        wheel = _with_link(wheel, f"{name}/link", "target", more, f"{name}/bomb.so")
    return f"{name}-1.0-py3-none-any.whl", wheel


def corpus(parts: DataFrame, key: str = "p_partkey") -> DataFrame:
    """(key, filename, ordinal, content): a wheel for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [wheel_of(k) for k in b.column(0).to_pylist()]
            if made:
                yield pa.RecordBatch.from_pydict({"key": b.column(0), "filename": pa.array([n for n, _ in made]), "ordinal": b.column(0), "content": pa.array([c for _, c in made], pa.binary())})

    return S.dealt(parts, key).mapInArrow(run, "key long, filename string, ordinal long, content binary")
