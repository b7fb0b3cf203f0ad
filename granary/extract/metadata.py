"""METADATA, WHEEL, RECORD and SBOM files of a wheel."""

from __future__ import annotations

import csv
import io
import json
import re
from email.parser import BytesParser
from email.policy import compat32

from granary.extract.archive import Archive

try:  # the public grammar, where it is installed; the expressions below otherwise
    from packaging import requirements as _requirements
    from packaging import utils as _utils
    from packaging import version as _version
except ImportError:
    _requirements = _utils = _version = None

#: The grammar of wheel file names, requirement names and public versions.
WHEEL_NAME = re.compile(r"^(?P<name>[A-Za-z0-9](?:[A-Za-z0-9._]*[A-Za-z0-9])?)-(?P<version>[^-]+)(?:-(?P<build>[0-9][^-]*))?-(?P<py>[^-]+)-(?P<abi>[^-]+)-(?P<plat>[^-]+)\.whl$")
REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:$|[\[(;@<>=!~,\s])")
VERSION = re.compile(r"^v?([0-9]+!)?[0-9]+(\.[0-9]+)*([-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?[0-9]*)?(-[0-9]+|[-_.]?(post|rev|r)[-_.]?[0-9]*)?([-_.]?dev[-_.]?[0-9]*)?(\+[a-z0-9]+([-_.][a-z0-9]+)*)?$", re.I)
SBOM_DEPTH = 64
#: Headers of one line each, as nearly all are, up to the empty line or the end.
_PLAIN = re.compile(rb"((?:[!-9;-~]+:[^\n]*\n)+)(?:\n.*)?", re.S)


def canonical(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def _is_version(x: str) -> bool:
    if _version is None:
        return bool(VERSION.match(x))
    try:
        _version.Version(x)
    except _version.InvalidVersion:
        return False
    return True


def split_generator(raw: str) -> tuple[str | None, str | None]:
    raw = raw.strip()
    if m := re.fullmatch(r"(.+?)\s+\(([^()]*)\)", raw):
        return m[1].strip(), m[2].strip()
    name, _, version = raw.rpartition(" ")
    return (name, version) if name and _is_version(version) else (raw or None, None)


def wheel_name(filename: str) -> tuple[str, str, list[str]] | None:
    """(canonical name, version, tags) of a wheel's file name, None if it is none."""
    m = WHEEL_NAME.match(filename)
    if _utils is not None:
        try:
            name, version, _, tags = _utils.parse_wheel_filename(filename)
        except _utils.InvalidWheelFilename:
            return None
        return str(name), str(version), sorted(str(t) for t in tags)
    if m is None or not _is_version(m["version"]):
        return None
    return canonical(m["name"]), m["version"], sorted(f"{p}-{b}-{q}" for p in m["py"].split(".") for b in m["abi"].split(".") for q in m["plat"].split("."))


def required(x: str) -> str | None:
    """Canonical name of a requirement, None if it is none."""
    if _requirements is None:
        m = REQUIREMENT.match(x)
        return canonical(m[1]) if m else None
    try:
        return canonical(_requirements.Requirement(x).name)
    except _requirements.InvalidRequirement:
        return None


def _pairs(data: bytes) -> list[tuple[str, object]]:
    """Names and values of headers; the parser of e-mails reads all that are not plain."""
    if b"\r" not in data and (m := _PLAIN.fullmatch(data)) and m[1].isascii():
        return [(k, v) for k, _, v in (x.partition(":") for x in m[1].decode("ascii").split("\n")[:-1])]
    return BytesParser(policy=compat32).parsebytes(data, headersonly=True).items()


def _headers(a: Archive, name: str, missing: str, strict: bool) -> dict[str, list[str]]:
    """Headers of an e-mail-like file; what can be read of a damaged one is read."""
    if name not in a.members:
        a.error(missing, name, "not in the archive", "metadata")
        return {}
    data = a.read(name)
    if data is None:
        return {}
    if strict:
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            a.error("metadata_decode_error", name, "not UTF-8", "metadata")
    out: dict[str, list[str]] = {}
    for k, v in _pairs(data.removeprefix(b"\xef\xbb\xbf")):
        out.setdefault(k.lower(), []).append(str(v).strip())
    if data.strip() and not out:
        a.error("metadata_decode_error", name, "no headers", "metadata")
    return out


def read(a: Archive, filename: str) -> tuple[dict | None, list[dict]]:
    """(metadata, SBOM components); nothing for a wheel without one dist-info folder.

    The file name is the authority for canonical name, version and tags; METADATA for the
    name as its project spells it (F11)."""
    dirs = sorted({n.split("/")[0] for n in a.members if "/" in n and n.split("/")[0].endswith(".dist-info")})
    if len(dirs) != 1:
        a.error("dist_info_missing" if not dirs else "dist_info_ambiguous", None, ", ".join(dirs) or "no dist-info folder", "metadata")
        return None, []
    info = dirs[0]
    named = wheel_name(filename)
    if named is None:
        a.error("wheel_filename_invalid", filename, "does not parse as a wheel's name", "metadata")
    meta, wheel = _headers(a, f"{info}/METADATA", "metadata_missing", True), _headers(a, f"{info}/WHEEL", "wheel_missing", False)
    first = lambda h, k: h.get(k, [None])[0]
    own = first(meta, "name")
    canonical_name, version = named[:2] if named else (canonical(own) if own else "", first(meta, "version") or "")
    tags = named[2] if named else sorted(set(wheel.get("tag", [])))
    requires = sorted(set(meta.get("requires-dist", [])))
    raw = first(wheel, "generator")
    generator = split_generator(raw) if raw else (None, None)
    entries, mismatches = _record(a, info)
    sboms = sorted(n for n in a.members if n.startswith(f"{info}/sboms/"))
    out = {
        "name": own or canonical_name,
        "canonical_name": canonical_name,
        "version": version,
        "tags": tags,
        "platform_tags": sorted({p for t in tags for p in t.split("-", 2)[-1].split(".")}),
        "generator_raw": raw,
        "generator_name": generator[0],
        "generator_version": generator[1],
        "requires_python": first(meta, "requires-python"),
        "requires_dist": requires,
        "requires_dist_names": sorted({n for x in requires if (n := required(x))}),
        "root_is_purelib": (first(wheel, "root-is-purelib") or "").lower() == "true",
        "dist_info_dir": info,
        "record_entries": entries,
        "record_mismatches": mismatches,
        "sbom_paths": sboms,
    }
    return out, [c for s in sboms for c in _sbom(a, s)]


def _record(a: Archive, info: str) -> tuple[int, list[str]]:
    name = f"{info}/RECORD"
    if name not in a.members:
        a.error("record_missing", name, "not in the archive", "metadata")
        return 0, []
    data = a.read(name)
    if data is None:
        return 0, []
    try:
        rows = {r[0] for r in csv.reader(io.StringIO(data.decode("utf-8"))) if r and r[0] and not r[0].endswith("/")}
    except (UnicodeDecodeError, csv.Error):
        a.error("record_parse_error", name, "not a CSV file in UTF-8", "metadata")
        return 0, []
    return len(rows), sorted((rows ^ set(a.members)) - {name})


def _sbom(a: Archive, path: str) -> list[dict]:
    data = a.read(path)
    if data is None:
        return []
    try:
        root = json.loads(data)
        if not isinstance(root, dict):
            raise ValueError
    except (ValueError, RecursionError):
        a.error("sbom_parse_error", path, "not a JSON object", "metadata")
        return []
    text = lambda c, k: c[k] if isinstance(c.get(k), str) else None
    out: set[tuple] = set()
    level, depth = [root], 0
    while level and depth <= SBOM_DEPTH:
        below = [c for parent in level if isinstance(parent.get("components"), list) for c in parent["components"] if isinstance(c, dict)]
        out |= {(text(c, "name"), text(c, "version"), text(c, "purl")) for c in below if text(c, "name")}
        level, depth = below, depth + 1
    return [{"name": n, "version": v, "purl": p, "source": path} for n, v, p in sorted(out, key=lambda x: tuple(y or "" for y in x))]
