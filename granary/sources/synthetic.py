"""Wheels made from rows: a corpus whose answers have a closed form.

Shape by p_partkey modulo 16: 0 system OpenSSL, 1 bundled copy with a mangled name, 2 static
copy with a banner and build data, 3 a Rust extension with `ring`, 4 pure Python calling
md5 (with usedforsecurity by p_size modulo 3), 5 pure Python without crypto, 6 a broken
archive, 7 a distribution known to carry its own implementation, 8 a Mach-O extension, 9 a
PE extension with an ordinal import and a forwarder, 10 an ar archive with static copies,
11 an SBOM that names `ring`, 12 TLS verification switched off, 13 a library loaded by
ctypes, 14 byte code without source, 15 crypto dependencies and a file that RECORD leaves out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SHAPES = 16
#: The first of January 2020, as archives have it.
_DAY = 40 << 9 | 1 << 5 | 1
#: Wheels that one task makes and decodes, about.
TASK_WHEELS = 2000


def dealt(parts: DataFrame, key: str, *more: str) -> DataFrame:
    """The columns as whole numbers, rows dealt out by key to tasks of `TASK_WHEELS`: a row of
    a few bytes becomes a wheel, so the splits of the table's files are far too few."""
    n = max(1, -(-parts.count() // TASK_WHEELS))
    return parts.select(*[parts[c].cast("long") for c in (key, *more)]).repartition(n, key)


def elf(needed: list[str], symbols: list[tuple[str, bool]], rodata: bytes, soname: str | None = None) -> bytes:
    """A small 64-bit little-endian ELF library: (name, defined) symbols."""
    names = bytearray(b"\0")

    def put(s: str) -> int:
        at = len(names)
        names.extend(s.encode() + b"\0")
        return at

    dynamic = [(1, put(n)) for n in needed] + ([(14, put(soname))] if soname else [])
    table = bytearray(24)
    for name, defined in symbols:
        table += struct.pack("<IBBHQQ", put(name), 0x12, 0, 1 if defined else 0, 0x1000 if defined else 0, 0)
    dynamic += [(5, 0x100), (0, 0)]
    dyn = b"".join(struct.pack("<qQ", *d) for d in dynamic)
    titles = b"\0.dynstr\0.dynsym\0.dynamic\0.rodata\0.shstrtab\0"
    parts = [(b".dynstr", 3, 2, 0x100, bytes(names), 0, 0), (b".dynsym", 11, 2, 0, bytes(table), 1, 24), (b".dynamic", 6, 2, 0, dyn, 1, 16), (b".rodata", 1, 2, 0, rodata + b"\0", 0, 0), (b".shstrtab", 3, 0, 0, titles, 0, 0)]
    body, headers = bytearray(64), [bytes(64)]
    for title, kind, flags, addr, data, link, size in parts:
        headers.append(struct.pack("<IIQQQQIIQQ", titles.index(title + b"\0"), kind, flags, addr, len(body), len(data), link, 0, 1, size))
        body += data
    shoff = len(body)
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, shoff, 0, 64, 0, 0, 64, len(headers), len(headers) - 1)
    body[: len(head)] = head
    return bytes(body) + b"".join(headers)


def macho(needed: list[str], symbols: list[tuple[str, bool]], soname: str | None = None) -> bytes:
    """A small thin arm64 Mach-O library: (name, defined) symbols."""

    def dylib(cmd: int, name: str) -> bytes:
        body = name.encode() + b"\0"
        body += bytes(-len(body) % 8)
        return struct.pack("<IIIIII", cmd, 24 + len(body), 24, 0, 0, 0) + body

    names, table = bytearray(b"\0"), bytearray()
    for name, defined in symbols:
        table += struct.pack("<IBBHQ", len(names), 0x0F if defined else 1, int(defined), 0, 16 if defined else 0)
        names += f"_{name}\0".encode()
    commands = [dylib(0xC, n) for n in needed] + ([dylib(0xD, soname)] if soname else [])
    size = sum(map(len, commands)) + 24
    commands.append(struct.pack("<IIIIII", 2, 24, 32 + size, len(symbols), 32 + size + len(table), len(names)))
    return struct.pack("<IiiIIIII", 0xFEEDFACF, 0x0100000C, 0, 6, len(commands), size, 0, 0) + b"".join(commands) + table + bytes(names)


def pe() -> bytes:
    """A small 64-bit PE library: imports EVP_x and an ordinal from LIBCRYPTO-3.dll, exports
    MD5_y, and forwards fwd to EVP_z of other.dll."""
    base, va = 0x400, 0x1000
    body = bytearray(0x200)

    def at(rva: int, data: bytes) -> None:
        body[rva - va : rva - va + len(data)] = data

    at(0x1000, struct.pack("<IIIII", 0x1040, 0, 0, 0x1060, 0x1040))
    at(0x1040, struct.pack("<QQQ", 0x1070, (1 << 63) | 5, 0))
    at(0x1060, b"LIBCRYPTO-3.dll\0")
    at(0x1070, b"\0\0EVP_x\0")
    at(0x1080, struct.pack("<IIIIIIIIIII", 0, 0, 0, 0x10E0, 1, 2, 2, 0x10B0, 0x10B8, 0x10C0, 0))
    at(0x10B0, struct.pack("<II", 0x5000, 0x10F8))
    at(0x10B8, struct.pack("<II", 0x10E8, 0x10F0))
    at(0x10C0, struct.pack("<HH", 0, 1))
    for rva, text in ((0x10E0, b"me.dll\0"), (0x10E8, b"MD5_y\0"), (0x10F0, b"fwd\0"), (0x10F8, b"other.EVP_z\0")):
        at(rva, text)
    dirs = [(0x1080, 0x84), (0x1000, 40)] + [(0, 0)] * 14
    optional = struct.pack("<H", 0x20B) + bytes(106) + struct.pack("<I", 16) + b"".join(struct.pack("<II", *d) for d in dirs)
    head = b"MZ" + bytes(0x3A) + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(optional), 0) + optional
    head += b".rdata\0\0" + struct.pack("<IIIIIIHHI", 0x200, va, 0x200, base, 0, 0, 0, 0, 0x40000040)
    return head + bytes(base - len(head)) + bytes(body)


def archive(members: dict[str, bytes]) -> bytes:
    """An ar archive in the GNU form."""
    out = b"!<arch>\n"
    for name, body in members.items():
        out += f"{name + '/':<16}{0:<12}{0:<6}{0:<6}{100644:<8}{len(body):<10}`\n".encode() + body + b"\n" * (len(body) & 1)
    return out


def zipped(members: Iterable[tuple[str, bytes, int, bool]]) -> bytes:
    """An archive of (name, bytes, mode, deflated), byte for byte as `zipfile` writes it for
    names in ASCII, but put together in one pass."""
    body, index = bytearray(), bytearray()
    n = 0
    for name, data, mode, deflated in members:
        own, at = name.encode("ascii"), len(body)
        packed = data
        if deflated:
            z = zlib.compressobj(-1, zlib.DEFLATED, -15)
            packed = z.compress(data) + z.flush()
        facts = struct.pack("<HHHHIIIHH", 0, 8 if deflated else 0, 0, _DAY, zlib.crc32(data), len(packed), len(data), len(own), 0)
        body += b"PK\x03\x04\x14\0" + facts + own + packed
        index += b"PK\x01\x02\x14\x03\x14\0" + facts + struct.pack("<HHHII", 0, 0, 0, mode << 16, at) + own
        n += 1
    return bytes(body + index) + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, n, n, len(index), len(body), 0)


def members(name: str, version: str, files: dict[str, bytes], tag: str = "py3-none-any", requires: list[str] | None = None, unrecorded: dict[str, bytes] | None = None) -> dict[str, bytes]:
    """A wheel's members in order, with METADATA, WHEEL and a RECORD that lists all but the
    unrecorded."""
    more = "".join(f"Requires-Dist: {r}\n" for r in requires or ())
    info = f"{name}-{version}.dist-info"
    every = dict(files) | {
        f"{info}/METADATA": f"Metadata-Version: 2.1\nName: {name}\nVersion: {version}\n{more}".encode(),
        f"{info}/WHEEL": f"Wheel-Version: 1.0\nGenerator: bdist_wheel (0.43.0)\nRoot-Is-Purelib: true\nTag: {tag}\n".encode()
    }
    every[f"{info}/RECORD"] = "".join(f"{n},,\n" for n in [*every, f"{info}/RECORD"]).encode()
    every |= unrecorded or {}
    return {n: every[n] for n in sorted(every)}


def build(name: str, version: str, files: dict[str, bytes], tag: str = "py3-none-any", requires: list[str] | None = None, unrecorded: dict[str, bytes] | None = None) -> bytes:
    """A wheel of these members."""
    return zipped((n, data, 0o100644, True) for n, data in members(name, version, files, tag, requires, unrecorded).items())


def wheel_of(key: int, size: int) -> tuple[str, bytes]:
    shape, name = key % SHAPES, f"pkg{key}"
    ext, so = f"{name}/_ext.cpython-312-x86_64-linux-gnu.so", b"plain text of an extension"
    files: dict[str, bytes] = {f"{name}/__init__.py": b"VALUE = 1\n"}
    if shape == 0:
        files[ext] = elf(["libcrypto.so.3", "libssl.so.3", "libc.so.6"], [("EVP_DigestInit_ex", False)], so)
    elif shape == 1:
        lib = "libcrypto-3a1f2b4c.so.3"
        files[ext] = elf([lib, "libc.so.6"], [("EVP_DigestInit_ex", False)], so)
        files[f"{name}.libs/{lib}"] = elf(["libc.so.6"], [("EVP_DigestInit_ex", True)], b"OpenSSL 3.0.14 4 Jun 2024\0OPENSSLDIR: \"/usr\"", lib)
    elif shape == 2:
        files[ext] = elf(["libc.so.6"], [("PyInit__ext", True), ("EVP_DigestInit_ex", True)], b"OpenSSL 3.0.14 4 Jun 2024\0OPENSSLDIR: \"/usr\"")
    elif shape == 3:
        files[ext] = elf(["libc.so.6"], [("PyInit__ext", True)], b"/root/.cargo/registry/src/index.crates.io-6f17d22bba15001f/ring-0.17.8/src/digest.rs")
    elif shape == 4:
        used = ("", ", usedforsecurity=False", ", usedforsecurity=True")[size % 3]
        files[f"{name}/__init__.py"] = f"import hashlib as h\nx = h.md5(b''{used})\n".encode()
    elif shape == 6:
        return f"{name}-1.0-py3-none-any.whl", b"PK\x03\x04 this is no archive"
    elif shape == 7:
        name = "pycryptodome"
        return f"{name}-{key}.0-py3-none-any.whl", build(name, f"{key}.0", {"pycryptodome/__init__.py": b"X = 1\n"})
    elif shape == 8:
        files[f"{name}/_ext.dylib"] = macho(["/usr/lib/libcrypto.dylib"], [("EVP_x", False), ("MD5_y", True)])
    elif shape == 9:
        files[f"{name}/_ext.pyd"] = pe()
    elif shape == 10:
        copy = elf(["libc.so.6"], [("EVP_DigestInit_ex", True)], b"OpenSSL 3.0.14 4 Jun 2024\0OPENSSLDIR: \"/usr\"")
        files[f"{name}/libown.a"] = archive({"evp.o": copy, "readme.txt": b"nothing to see", "evp2.o": copy})
    elif shape == 11:
        files[f"{name}-1.0.dist-info/sboms/cargo.json"] = b'{"components": [{"name": "app", "components": [{"name": "ring", "version": "0.17.8", "purl": "pkg:cargo/ring@0.17.8"}]}]}'
    elif shape == 12:
        files[f"{name}/net.py"] = b"import ssl\nctx = ssl.create_default_context()\nctx.check_hostname = False\nctx.verify_mode = ssl.CERT_NONE\n"
    elif shape == 13:
        files[f"{name}/load.py"] = b"import ctypes\nlib = ctypes.CDLL('libcrypto.so.3')\n"
    elif shape == 14:
        return f"{name}-1.0-py3-none-any.whl", build(name, "1.0", {f"{name}/__init__.pyc": b"\0" * 16})
    elif shape == 15:
        return f"{name}-1.0-py3-none-any.whl", build(name, "1.0", files, requires=["cryptography (>=3)", "PyNaCl; python_version > '3'", "requests"], unrecorded={f"{name}/extra.txt": b"?"})
    return f"{name}-1.0-py3-none-any.whl", build(name, "1.0", files)


def corpus(parts: DataFrame, key: str = "p_partkey", size: str = "p_size") -> DataFrame:
    """(key, filename, ordinal, content): a wheel for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            made = [wheel_of(k, s) for k, s in zip(keys, b.column(1).to_pylist(), strict=True)]
            if made:
                yield pa.RecordBatch.from_pydict({"key": b.column(0), "filename": pa.array([n for n, _ in made]), "ordinal": b.column(0), "content": pa.array([c for _, c in made], pa.binary())})

    return dealt(parts, key, size).mapInArrow(run, "key long, filename string, ordinal long, content binary")
