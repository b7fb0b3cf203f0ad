"""Members of a wheel: names, limits, symlinks and bounded reads.  Nothing here raises for a
bad member: what cannot be read becomes an error row (stage, kind, path, message)."""

from __future__ import annotations

import io
import stat
import struct
import zipfile
import zlib
from dataclasses import dataclass

from granary.sources.wheels import MEMBER_BYTES, RATIO, RATIO_FLOOR

#: Bytes of a symlink's target, and of all members.
SYMLINK_BYTES, TOTAL_BYTES = 4096, 8 << 30
#: What opening an archive raises where it is damaged, or asks for a later version of the format.
UNREADABLE = (zipfile.BadZipFile, NotImplementedError, ValueError, OSError, struct.error)


@dataclass(frozen=True)
class Member:
    name: str
    size: int
    compressed: int
    is_symlink: bool
    mode: int


@dataclass(frozen=True)
class Bounds:
    """Bytes that a member and a whole archive may unpack to."""

    member: int = MEMBER_BYTES
    total: int = TOTAL_BYTES


class Archive:
    def __init__(self, content: bytes, bounds: Bounds = Bounds()):
        self.bounds, self._content = bounds, content
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.errors: list[tuple[str, str, str | None, str]] = []
        self.members: dict[str, Member] = {}
        self._info: dict[str, zipfile.ZipInfo] = {}
        for i in self.zip.infolist():
            if i.is_dir():
                continue
            if i.filename in self.members:
                self.error("duplicate_member", i.filename, "the last one counts")
            mode = i.external_attr >> 16
            self.members[i.filename] = Member(i.filename, i.file_size, i.compress_size, stat.S_ISLNK(mode), mode & 0o7777)
            self._info[i.filename] = i
        self.total = sum(m.size for m in self.members.values())
        if self.total > bounds.total:
            self.error("size_limit_exceeded", None, f"unpacks to {self.total} bytes")

    def error(self, kind: str, path: str | None, message: str, stage: str = "archive") -> None:
        self.errors.append((stage, kind, path, message))

    def within(self, name: str) -> bool:
        m = self.members[name]
        if m.size > self.bounds.member:
            self.error("binary_too_large", name, f"{m.size} bytes", "binary")
        elif m.size >= RATIO_FLOOR and m.size > RATIO * m.compressed:
            self.error("compression_ratio_exceeded", name, f"{m.size} bytes from {m.compressed}")
        else:
            return True
        return False

    def starts(self, name: str, n: int) -> bytes:
        """The first bytes of a member; no more of it is unpacked."""
        try:
            with self.zip.open(self._info[name]) as f:
                return f.read(n)
        except Exception:  # told when the member is read
            return b""

    def read(self, name: str) -> bytes | None:
        if not self.within(name):
            return None
        try:
            data = self._plain(self._info[name])
            return self.zip.read(self._info[name]) if data is None else data
        except Exception as e:  # zlib, CRC, encryption, lying headers: one member is lost
            self.error("member_read_error", name, type(e).__name__)
            return None

    def _plain(self, i: zipfile.ZipInfo) -> bytes | None:
        """A stored or deflated member of which all headers agree, as `zipfile` gives it but
        in one step; None for any other, which is left to `zipfile`."""
        if i.flag_bits & ~0x80E or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or i.header_offset < 0:
            return None
        at = i.header_offset
        if self._content[at : at + 4] != b"PK\x03\x04" or len(self._content) < at + 30:
            return None
        named, extra = struct.unpack_from("<26xHH", self._content, at)
        start = at + 30 + named
        own = i.orig_filename.encode("utf-8" if i.flag_bits & 0x800 else "cp437")
        begin, end = start + extra, start + extra + i.compress_size
        if self._content[at + 30 : start] != own or end > len(self._content) or end > (getattr(i, "_end_offset", None) or 0):
            return None
        data = self._content[begin:end]
        if i.compress_type == zipfile.ZIP_DEFLATED:
            unpacked = zlib.decompressobj(-15)
            try:
                data = unpacked.decompress(data, i.file_size + 1)
            except zlib.error:
                return None
            if not unpacked.eof:
                return None
        return data if len(data) == i.file_size and zlib.crc32(data) == i.CRC else None

    def target(self, name: str) -> str | None:
        """Where a symlink points; links are never followed."""
        if self.members[name].size > SYMLINK_BYTES:
            self.error("size_limit_exceeded", name, "symlink target too long")
            return None
        data = self.read(name)
        return None if data is None else data.decode("utf-8", "replace")
