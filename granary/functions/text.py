"""Scalar functions as Catalyst expressions (no UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str, limit: int = 200) -> Column:
    """Non-printable characters become spaces; trimmed; at most `limit` characters (F1)."""
    return F.substring(F.trim(F.regexp_replace(_c(x), "[^\\x20-\\x7e]", " ")), 1, limit)


def sanitize(x: Column | str) -> Column:
    """Drop all but printable ASCII (F2)."""
    return F.regexp_replace(_c(x), "[^\\x20-\\x7e]", "")


def clip(x: Column | str, limit: int = 200) -> Column:
    """One ? for every character that is not printable ASCII; at most `limit`."""
    return F.substring(F.regexp_replace(_c(x), "[^\\x20-\\x7e]", "?"), 1, limit)


def printable_runs(x: Column | str, least: int = 4) -> Column:
    """All runs of at least `least` printable characters."""
    return F.regexp_extract_all(_c(x), F.lit(f"([\\x20-\\x7e]{{{least},}})"), 1)


def canonical_name(x: Column | str) -> Column:
    """PEP 503 form of a distribution name (F8)."""
    return F.lower(F.regexp_replace(_c(x), "[-_.]+", "-"))


def ascii_lower(x: Column | str) -> Column:
    """Lower case only of texts that are all ASCII."""
    x = _c(x)
    return F.when(x.rlike("^[\\x00-\\x7f]*$"), F.lower(x)).otherwise(x)


def sbom_library_key(x: Column | str) -> Column:
    """Key under which an SBOM component is compared with a library."""
    return ascii_lower(x)


def sbom_crate_key(x: Column | str) -> Column:
    """Key for crates: the library key with - for _."""
    return F.replace(ascii_lower(x), F.lit("_"), F.lit("-"))


def strip_abi_underscore(x: Column | str) -> Column:
    """A symbol without the one underscore that its ABI puts before it."""
    x = _c(x)
    return F.when(F.startswith(x, F.lit("_")), F.substr(x, F.lit(2))).otherwise(x)


def generator_name(x: Column | str) -> Column:
    """The tool of a Generator header: `name (version)`, `name version` or `name`."""
    x = F.trim(_c(x))
    return F.coalesce(
        F.nullif(F.regexp_extract(x, "^(.+?)\\s+\\(([^()]*)\\)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(x, "^(\\S.*?)\\s+v?([0-9]+(?:\\.[0-9]+)*(?:(?:a|b|rc)[0-9]+)?(?:\\.post[0-9]+)?(?:\\.dev[0-9]+)?)$", 1), F.lit("")),
        x
    )


def generator_version(x: Column | str) -> Column:
    """The version of a Generator header, null without one."""
    x = F.trim(_c(x))
    return F.coalesce(F.nullif(F.regexp_extract(x, "^(.+?)\\s+\\(([^()]*)\\)$", 2), F.lit("")), F.nullif(F.regexp_extract(x, "^(\\S.*?)\\s+v?([0-9]+(?:\\.[0-9]+)*(?:(?:a|b|rc)[0-9]+)?(?:\\.post[0-9]+)?(?:\\.dev[0-9]+)?)$", 2), F.lit("")))


def platform_tags(tags: Column | str) -> Column:
    """Distinct, sorted platform parts of wheel tags."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(_c(tags), lambda t: F.split(F.substring_index(t, "-", -1), "\\.")))))


def reduce_soname(x: Column | str) -> Column:
    """Base of a shared library's name, without version and library suffixes."""
    base = F.substring_index(_c(x), "/", -1)
    stem = F.regexp_replace(base, "(?:\\.[0-9]+|\\.so|\\.dylib|\\.(?i:dll|pyd))+$", "")
    tail = F.substr(base, F.length(stem) + 1)
    return F.when(tail.rlike("(?i)\\.(dll|pyd)"), F.lower(stem)).otherwise(stem)


#: How repaired wheels rename libraries, and how Windows names versions.
MANGLED = "^(lib.+)-([0-9a-f]{6,32})$"
WINDOWS_VERSION = "^(.+?)-([0-9]+(?:_[0-9]+)?)(?:-([A-Za-z0-9_]+))?$"


def is_mangled(x: Column | str) -> Column:
    """Whether the reduced name ends in a content hash."""
    return reduce_soname(x).rlike(MANGLED)


def normalise_soname(x: Column | str) -> Column:
    """The reduced name without a content hash and without a Windows version."""
    r = reduce_soname(x)
    return F.when(r.rlike(MANGLED), F.regexp_extract(r, MANGLED, 1)).when(_c(x).rlike("(?i)\\.(dll|pyd)"), F.coalesce(F.nullif(F.regexp_extract(r, WINDOWS_VERSION, 1), F.lit("")), r)).otherwise(r)


def glob_regex(glob: str) -> str:
    """A whole-string regular expression for a shell pattern."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def is_vendor_path(path: Column | str, globs: list[str]) -> Column:
    """Whether any directory of a path matches a vendor pattern."""
    parts = F.split(_c(path), "/")
    either = "|".join(glob_regex(g) for g in globs)
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.rlike(either))


_NATIVE = "(?i)\\.(so|dylib|pyd|dll|exe|a|lib)(\\.[0-9]+)*$"


def is_native_candidate(path: Column | str, size: Column | str, mode: Column | str, is_symlink: Column | str, globs: list[str]) -> Column:
    """Whether a member may be a native object."""
    path, name = _c(path), F.substring_index(_c(path), "/", -1)
    parent = F.when(path.contains("/"), F.lower(F.element_at(F.split(path, "/"), -2)))
    bare = ~name.contains(".")
    return ~_c(is_symlink) & (_c(size) >= 64) & (name.rlike(_NATIVE) | is_vendor_path(path, globs) | (bare & F.coalesce(parent.isin("bin", "lib", "lib64", "scripts", "libexec"), F.lit(False))) | (bare & (_c(mode).bitwiseAND(73) > 0)))


def target_matches(target: Column | str, wanted: list[str]) -> Column:
    """Exact call target, or `*.name` for its last part."""
    target = _c(target)
    return target.isin(*wanted) | F.concat(F.lit("*."), F.substring_index(target, ".", -1)).isin(*wanted)


def dotted_prefixes(x: Column | str) -> Column:
    """a.b.c -> [a, a.b, a.b.c]."""
    parts = F.split(_c(x), "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def cache_key(*parts: Column | str) -> Column:
    """sha256 over the parts joined by | (F16)."""
    return F.sha2(F.concat_ws("|", *[_c(p) for p in parts]), 256)


def forwarder_dll(x: Column | str) -> Column:
    """DLL of an export forwarder `dll.symbol`."""
    return F.concat(F.substring_index(_c(x), ".", 1), F.lit(".dll"))


def forwarder_symbol(x: Column | str) -> Column:
    """Symbol of an export forwarder: all after the first dot."""
    x = _c(x)
    return F.substr(x, F.instr(x, ".") + 1)


def or_dash(items: Column | str, sep: str = ", ") -> Column:
    """Items joined, - for none."""
    return F.coalesce(F.nullif(F.array_join(_c(items), sep), F.lit("")), F.lit("-"))


def first_and_more(items: Column | str, n: int = 3) -> Column:
    """The first n items and how many more there are."""
    items = _c(items)
    rest = F.size(items) - n
    shown = F.array_join(F.slice(items, 1, n), "; ")
    return F.when(rest > 0, F.concat(shown, F.lit("; +"), rest.cast("string"), F.lit(" more"))).otherwise(shown)


def script_safe(x: Column | str) -> Column:
    """JSON text that may stand inside a script element."""
    x = _c(x)
    for c in "&<>":
        x = F.replace(x, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return x


def hrefs(html: Column | str) -> Column:
    """Targets of all links of a page, in order."""
    return F.regexp_extract_all(_c(html), F.lit("(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"'#]*)"), 1)
