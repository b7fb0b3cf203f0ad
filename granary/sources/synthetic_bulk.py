"""Wheels of a usual size: 3.3 MiB unpacked, for timings."""

from __future__ import annotations

import random

from granary.sources import synthetic as S
from granary.sources import synthetic_objects as O

_WORDS = ["buffer", "stream", "parse", "value", "index", "node", "state", "table", "error", "module", "offset", "length", "handle", "result", "context", "option"]


def library(key: int, rows: int = 20_000, words: int = 180_000) -> bytes:
    """An object of about 2.4 MiB: a symbol table, strings, and a copy of OpenSSL in every fourth."""
    r = random.Random(key)
    names = [f"{r.choice(_WORDS)}_{r.choice(_WORDS)}_{i:x}" for i in range(rows)]
    own = key % 4 == 0
    if own:
        names += [f"EVP_{w}_ex" for w in _WORDS]
    table, at = O.names("libc.so.6", *([] if own else ["libcrypto.so.3"]), *names)
    needed = ["libc.so.6"] if own else ["libc.so.6", "libcrypto.so.3"]
    dynamic = b"".join(O.struct.pack("<qQ", 1, at[n]) for n in needed) + O.struct.pack("<qQqQ", 5, 0x100, 0, 0)
    text = "\0".join(" ".join(r.choices(_WORDS, k=8)) for _ in range(words // 8)).encode()
    if own:
        text += b'\0OpenSSL 3.0.14 4 Jun 2024\0OPENSSLDIR: "/usr"'
    return O.elf([(".dynstr", 3, 2, 0x100, table, "", 0), (".dynsym", 11, 2, 0, O.symbols(*[(at[n], True) for n in names]), ".dynstr", 24), (".dynamic", 6, 2, 0, dynamic, ".dynstr", 16), O.text(text)])


def source(key: int, lines: int = 450) -> bytes:
    """About 30 KB; every seventh has something to say."""
    r, speaks = random.Random(key), key % 7 == 0
    out = ["import hashlib", "import ssl", ""] if speaks else ["import os", ""]
    for i in range(lines):
        out.append(f"def {r.choice(_WORDS)}_{i}({r.choice(_WORDS)}, {r.choice(_WORDS)}_2=None):\n    return {r.choice(_WORDS)}_{i}({i}) if {i} else [x for x in range({i})]")
    if speaks:
        out.append("digest = hashlib.md5(b'', usedforsecurity=False)")
    return "\n".join(out).encode()


def wheel_of(key: int) -> tuple[str, bytes]:
    name = f"bulk{key}"
    files = {f"{name}/_core.so": library(key)} | {f"{name}/part{i}.py": source(key * 100 + i) for i in range(28)}
    return f"{name}-1.0-py3-none-any.whl", S.build(name, "1.0", files)
