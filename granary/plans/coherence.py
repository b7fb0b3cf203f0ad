"""What a policy must satisfy before anything is scanned with it.

Every check is a generator of complaints over the whole policy, registered under the
inventory's number; `complaints` runs them in order and `check` raises the first.  Shapes
come first, so that later checks may rely on them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

#: Closed vocabularies of the policy.
SEVERITIES = {"high", "medium", "low", "info"}
CONFIDENCES = {"high", "medium", "low"}
LAYERS = {"metadata", "binary", "python", "derived"}
BINDINGS = {"imported", "defined", "any"}
POSTURES = {"system", "bundled", "static", "mixed", "none", "unknown"}
USED_FOR_SECURITY = {"absent", "true", "false", "unresolved"}
ALGORITHM_LISTS = {"refused", "restricted", "weak"}
FAMILIES = {"hash", "checksum", "block_cipher", "stream_cipher", "aead", "mac", "kdf", "password_hash", "signature", "key_agreement", "kem", "drbg", "entropy", "tls", "ssh", "trust_store", "library"}
STATUSES = {"current", "revision_planned", "draft", "planned", "withdrawn"}
ALLOWED = {
    "not_specified": {"NON_APPROVED_CRYPTO"},
    "restricted": {"NON_APPROVED_CRYPTO", "CONTEXT_DEPENDENT"},
    "outside_module": {"NON_APPROVED_CRYPTO"},
    "boundary_unresolved": {"CONDITIONAL"},
    "runtime_refusal": {"FIPS_BREAKING"},
    "policy_bypass": {"CONDITIONAL"},
    "use_unresolved": {"CONTEXT_DEPENDENT"},
}
ERROR_KINDS = {
    "bad_zip", "duplicate_member", "size_limit_exceeded", "compression_ratio_exceeded", "member_read_error", "unexpected_error", "dist_info_missing", "dist_info_ambiguous", "metadata_missing",
    "metadata_decode_error", "wheel_missing", "wheel_filename_invalid", "record_missing", "record_parse_error", "sbom_parse_error", "elf_parse_error", "macho_parse_error", "pe_parse_error",
    "binary_truncated", "binary_too_large", "binary_unknown_format", "ar_parse_error", "python_syntax_error", "python_decode_error", "python_too_large", "python_recursion_limit_exceeded",
}
PARTIAL_REASONS = {
    "no_structural_reader", "elf_header_unread", "elf_section_table_truncated", "elf_section_table_absent", "elf_section_type_ambiguous", "elf_sections_unread", "elf_section_data_unread",
    "elf_dynamic_unread", "elf_dynsym_unread", "elf_symtab_unread", "elf_go_buildinfo_unread", "macho_header_unread", "macho_symtab_incomplete", "macho_fat_slice_unread",
    "macho_load_command_string_unread", "macho_load_command_walk_truncated", "macho_load_command_ambiguous", "pe_header_unread", "pe_section_table_truncated", "pe_no_import_directory",
    "pe_import_incomplete", "pe_export_incomplete", "pe_ordinal_import", "pe_ordinal_export", "pe_delay_load", "symtab_understates_rows", "strings_bytes_unread", "ar_member_table_unread",
}

_ROUTING = {"table", "default"}
#: The keys that a match of each kind may have.
MATCH_KEYS = {
    "dist_name": _ROUTING,
    "requires_dist": _ROUTING | {"any_entry"},
    "wheel_generator": set(),
    "no_source": set(),
    "binaries_truncated": set(),
    "record_mismatch": set(),
    "scan_error": {"error_kinds"},
    "sbom_component": {"tables"},
    "bundled_library": _ROUTING | {"library", "exclude_libraries"},
    "dt_needed": _ROUTING | {"library", "mangled", "resolved"},
    "dynamic_symbol": {"binding", "group", "groups"},
    "binary_string": {"group", "groups"},
    "rust_crate": _ROUTING,
    "linkage": _ROUTING | {"name", "value", "values", "exclude_libraries", "object_values", "exclude_object_values", "sbom_declared"},
    "opaque_binary": set(),
    "partial_binary": {"reasons", "exclude_reasons"},
    "py_import": _ROUTING,
    "py_call": {"targets", "usedforsecurity", "algorithm", "algorithm_list"},
    "py_attr": {"attributes", "values"},
    "py_constant": {"constants"},
    "py_ctypes_load": _ROUTING,
}
#: Where the hits of a kind lie: hits can share a place only within one of these; of the two
#: kinds that are missing, the place can be anything.
PLACES = {
    "wheel": {"no_source", "binaries_truncated", "linkage"},
    "dist_info": {"dist_name"},
    "metadata_file": {"requires_dist"},
    "wheel_file": {"wheel_generator"},
    "sbom": {"sbom_component"},
    "object": {"bundled_library", "dt_needed", "dynamic_symbol", "binary_string", "rust_crate", "opaque_binary", "partial_binary"},
    "python_source": {"py_import", "py_call", "py_attr", "py_constant", "py_ctypes_load"},
}
#: The kinds that follow an entry's own rule, by table.
ROUTED = {"crypto_distribution": {"dist_name", "requires_dist"}, "crypto_library": {"bundled_library"}, "rust_crate": {"rust_crate"}, "python_module": {"py_import"}}
_RELATION = {"relation", "basis", "family"}
_ENTRY = _RELATION | {"name", "rule", "why", "severity", "verdict", "needs_human_review"}
KEYS = {
    "rule": _RELATION | {"id", "layer", "category", "severity", "confidence", "needs_human_review", "title", "why", "match", "verdict", "suppressed_by"},
    "standard": {"id", "title", "edition", "status", "why", "successor", "sunset", "url"},
    "crypto_distribution": _ENTRY,
    "crypto_library": _ENTRY | {"sonames", "symbol_group", "string_group", "copy_string_group", "fork_symbol_groups", "fork_string_groups", "crates", "always_report"},
    "rust_crate": _ENTRY | {"suppressed_by"},
    "python_module": _ENTRY,
    "symbol_group": {"name", "prefixes", "exact", "why", "evidence_only", "family"},
    "string_group": {"name", "substrings", "why", "in_code", "family"},
}
LIMITS = {"max_locations_per_finding", "max_symbols_per_binary", "max_strings_per_binary", "max_rust_crates_per_binary", "max_evidence_chars", "min_string_length"}
CARGO = ("cargo_path_regex", "cargo_vendor_path_regex", "cargo_git_path_regex")
_LISTS = ("vendor_dir_globs", "library_suffixes", "windows_library_suffixes", "refused_hash_algorithms", "restricted_hash_algorithms")
_GO = ("go_boring_group", "go_stock_group", "go_fips140_group")
CONVENTIONS = {*_LISTS, *_GO, *CARGO, "mangled_soname_regex", "windows_version_suffix_regex"}

Check = Callable[["object"], Iterable[str]]
CHECKS: dict[str, list[Check]] = {}


def rule_of(number: str):
    def add(f: Check) -> Check:
        CHECKS.setdefault(number, []).append(f)
        return f

    return add


class PolicyError(ValueError):
    """A policy that does not hold together."""


def complaints(p) -> Iterator[tuple[str, str]]:
    """(number of the check, what is wrong) of everything that is wrong, up to the first check
    that finds shapes the others could not read."""
    for number, own in CHECKS.items():
        for f in own:
            found = list(f(p))
            yield from ((number, x) for x in found)
            if found and number in ("V24", "V1", "V3"):
                return


def check(p) -> None:
    for number, message in complaints(p):
        raise PolicyError(f"{message} [{number}]")


def _title(table: str, e: dict) -> str:
    return f"{table} {e.get('id') or e.get('name')!r}"


def _entries(p, *tables: str) -> Iterator[tuple[str, dict]]:
    for t in tables or KEYS:
        yield from ((t, e) for e in p.tables.get(t, ()))


def _matches(p, *kinds: str) -> Iterator[tuple[dict, dict]]:
    for r in p.tables["rule"]:
        yield from ((r, m) for m in r["match"] if not kinds or m["kind"] in kinds)


def _names(p, table: str) -> set[str]:
    return {e["name"] for e in p.tables[table]}


def _strings(x) -> bool:
    return isinstance(x, (list, tuple)) and all(isinstance(i, str) for i in x)


def owner_of(p, table: str, e: dict) -> str | None:
    """The rule that reports an entry: its own, else its table's default one."""
    return e.get("rule") or (None if table == "crypto_distribution" else p.default_rule(table))


# -- shapes ------------------------------------------------------------------------

_TEXT = {"id", "name", "rule", "layer", "category", "severity", "confidence", "verdict", "relation", "family", "title", "why", "symbol_group", "string_group", "copy_string_group", "status", "edition", "successor", "sunset", "url"}
_TEXTS = {"basis", "suppressed_by", "sonames", "crates", "fork_symbol_groups", "fork_string_groups", "prefixes", "exact", "substrings"}
_FLAGS = {"needs_human_review", "always_report", "evidence_only", "in_code"}
_MATCH_TEXT = {"kind", "table", "library", "group", "binding", "name", "value", "algorithm", "algorithm_list"}
_MATCH_TEXTS = {"tables", "exclude_libraries", "groups", "values", "object_values", "exclude_object_values", "error_kinds", "reasons", "exclude_reasons", "targets", "attributes", "constants"}
_MATCH_FLAGS = {"default", "any_entry", "mangled", "resolved", "sbom_declared"}
_NEEDED = {
    "rule": ("id", "layer", "category", "severity", "confidence", "needs_human_review", "match"),
    "standard": ("id", "edition", "status"),
    "crypto_library": ("name", "sonames"),
    "symbol_group": ("name", "prefixes", "exact"),
    "string_group": ("name", "substrings")
}


def _misshapen(e: dict, texts: set, lists: set, flags: set) -> Iterator[str]:
    for k, v in e.items():
        if k in texts and not isinstance(v, str):
            yield f"{k} must be a text"
        elif k in lists and not _strings(v):
            yield f"{k} must be a list of texts"
        elif k in flags and not isinstance(v, bool):
            yield f"{k} must be true or false"


@rule_of("V24")
def shapes(p):
    for table in KEYS:
        for e in p.tables.get(table, ()):
            if not isinstance(e, dict):
                yield f"{table}: entries must be tables"
                continue
            where = _title(table, e)
            yield from (f"{where}: {k} is missing" for k in _NEEDED.get(table, ("name",)) if k not in e)
            yield from (f"{where}: {x}" for x in _misshapen(e, _TEXT, _TEXTS, _FLAGS))
    if not _strings(p.precedence) or not p.precedence:
        yield "precedence must be a list of texts"
    yield from (f"limits: {k} must be a number" for k, v in p.limits.items() if not isinstance(v, int) or isinstance(v, bool))


@rule_of("V3")
def rules_and_matches(p):
    for r in p.tables["rule"]:
        where = _title("rule", r)
        if not isinstance(r["match"], list) or not r["match"]:
            yield f"{where}: matches nothing"
            continue
        for m in r["match"]:
            if not isinstance(m, dict) or m.get("kind") not in MATCH_KEYS:
                yield f"{where}: unknown kind of match"
                continue
            extra = set(m) - MATCH_KEYS[m["kind"]] - {"kind"}
            if extra:
                yield f"{where}: a match of kind {m['kind']} has no {sorted(extra)}"
            yield from (f"{where}: {x}" for x in _misshapen(m, _MATCH_TEXT, _MATCH_TEXTS, _MATCH_FLAGS))


@rule_of("V1")
def unknown_keys(p):
    for table, e in _entries(p):
        extra = sorted(set(e) - KEYS[table])
        if extra == ["suppressed_by"]:
            yield f"{_title(table, e)}: suppressed_by is for rules and crates"
        elif extra:
            yield f"{_title(table, e)}: unknown keys {extra}"
    for name, own, known in (("limits", p.limits, LIMITS), ("conventions", p.conventions, CONVENTIONS)):
        if set(own) - known:
            yield f"{name}: unknown keys {sorted(set(own) - known)}"
    for table, rows in p.tables.items():
        again = sorted(n for n, k in Counter(e.get("id") or e.get("name") for e in rows).items() if k > 1)
        if again:
            yield f"{table}: more than one {again}"


@rule_of("V2")
def precedence(p):
    if len(set(p.precedence)) < len(p.precedence):
        yield "precedence names a class twice"
    if p.precedence[-1] != "NO_CRYPTO_DETECTED":
        yield "precedence must end with NO_CRYPTO_DETECTED"
    for table, e in _entries(p, "rule", *ROUTED):
        if e.get("verdict") == "NO_CRYPTO_DETECTED":
            yield f"{_title(table, e)}: assigns the class of wheels to which nothing assigns one"
        elif "verdict" in e and e["verdict"] not in p.precedence:
            yield f"{_title(table, e)}: unknown class {e['verdict']!r}"


# -- references --------------------------------------------------------------------


@rule_of("V4")
def vocabularies(p):
    closed = {"layer": LAYERS, "severity": SEVERITIES, "confidence": CONFIDENCES, "family": FAMILIES, "relation": set(ALLOWED), "status": STATUSES}
    for table, e in _entries(p):
        yield from (f"{_title(table, e)}: unknown {k} {e[k]!r}" for k, known in closed.items() if k in e and e[k] not in known)


@rule_of("V4")
def references(p):
    libraries = _names(p, "crypto_library")
    known = {
        "group": None,
        "library": libraries,
        "exclude_libraries": libraries,
        "error_kinds": ERROR_KINDS,
        "reasons": PARTIAL_REASONS,
        "exclude_reasons": PARTIAL_REASONS,
        "object_values": POSTURES,
        "exclude_object_values": POSTURES,
        "value": POSTURES,
        "algorithm_list": ALGORITHM_LISTS,
        "binding": BINDINGS,
        "usedforsecurity": USED_FOR_SECURITY,
        "table": {*ROUTED, "symbol_group", "string_group", "ctypes_library"}
    }
    known["tables"] = known["table"]
    #: what a kind matches on, and filters that would never match if they were empty
    wanted = {"scan_error": ["error_kinds"], "py_call": ["targets"], "py_attr": ["attributes"], "py_constant": ["constants"], "dynamic_symbol": ["binding"]}
    never_empty = {"targets", "attributes", "constants", "object_values", "exclude_object_values", "usedforsecurity"}
    for r, m in _matches(p):
        where, kind = _title("rule", r), m["kind"]
        groups = _names(p, "symbol_group" if kind == "dynamic_symbol" else "string_group")
        own = known | {"group": groups, "groups": groups} | ({"values": POSTURES, "name": libraries} if kind == "linkage" else {})
        for k, v in m.items():
            values = [v] if isinstance(v, str) else v
            if k == "usedforsecurity" and not _strings(values):
                yield f"{where}: usedforsecurity must be a text or a list of texts"
            elif k in own:
                yield from (f"{where}: unknown {k} {x!r}" for x in values if x not in own[k])
            if (k in never_empty or (k == "values" and kind == "py_attr")) and not values:
                yield f"{where}: {k} must not be empty"
        yield from (f"{where}: {k} is missing" for k in wanted.get(kind, ()) if k not in m)
        if kind == "linkage" and not {"value", "values"} & set(m):
            yield f"{where}: names no posture"
        for a, b in (("reasons", "exclude_reasons"), ("object_values", "exclude_object_values")):
            if m.get(a) and m.get(b):
                yield f"{where}: {a} and {b} are alternatives"
    rules = {r["id"] for r in p.tables["rule"]}
    for r in p.tables["rule"]:
        for by in r.get("suppressed_by", ()):
            if by not in rules:
                yield f"{_title('rule', r)}: suppressed by unknown rule {by!r}"
            elif by == r["id"]:
                yield f"{_title('rule', r)}: suppressed by itself"


@rule_of("V5")
def symbol_groups_are_read(p):
    read = {x for _, m in _matches(p, "dynamic_symbol") for x in [*m.get("groups", ()), m.get("group")]} | {x.get("symbol_group") for x in p.tables["crypto_library"]}
    for g in p.tables["symbol_group"]:
        if g.get("evidence_only", False) == (g["name"] in read):
            yield f"symbol_group {g['name']!r}: " + ("is evidence only, but read" if g["name"] in read else "no rule or library reads it, and it is not evidence only")
        if not g["prefixes"] and not g["exact"]:
            yield f"symbol_group {g['name']!r}: names no symbol"


@rule_of("V6")
def routing(p):
    kinds: dict[str, set[str]] = {}
    for r, m in _matches(p):
        kinds.setdefault(r["id"], set()).add(m["kind"])
    for table, e in _entries(p, *ROUTED):
        if table == "crypto_distribution" and "rule" not in e:
            yield f"{_title(table, e)}: names no rule"
        elif "rule" in e and e["rule"] not in kinds:
            yield f"{_title(table, e)}: unknown rule {e['rule']!r}"
        elif "rule" in e and not kinds[e["rule"]] & ROUTED[table]:
            yield f"{_title(table, e)}: rule {e['rule']!r} does not read what is routed to it"


@rule_of("V7")
def defaults(p):
    found: dict[str, set[str]] = {}
    for r, m in _matches(p):
        if not m.get("default"):
            continue
        table = m.get("table")
        if table not in ROUTED or table == "crypto_distribution":
            yield f"{_title('rule', r)}: entries of {table!r} have no default rule"
        elif m["kind"] not in ROUTED[table]:
            yield f"{_title('rule', r)}: a match of kind {m['kind']} cannot be the default of {table}"
        else:
            found.setdefault(table, set()).add(r["id"])
    yield from (f"more than one default rule of {t}: {sorted(ids)}" for t, ids in sorted(found.items()) if len(ids) > 1)


def library_key(name: str) -> str:
    return name.lower() if name.isascii() else name


def crate_key(name: str) -> str:
    return library_key(name).replace("_", "-")


@rule_of("V8")
def sbom_names(p):
    for table, key in (("crypto_library", library_key), ("rust_crate", crate_key)):
        same: dict[str, list[str]] = {}
        for e in p.tables[table]:
            same.setdefault(key(e["name"]), []).append(e["name"])
        yield from (f"{table}: {sorted(names)} are one name to an SBOM" for names in same.values() if len(set(names)) > 1)


@rule_of("V9")
def limits_hold_one_of_each(p):
    for limit, table, each in (("max_strings_per_binary", "string_group", 1), ("max_symbols_per_binary", "symbol_group", 2), ("max_rust_crates_per_binary", "rust_crate", 1)):
        if limit not in p.limits:
            yield f"limits: {limit} is missing"
        elif p.limits[limit] < each * len(p.tables[table]):
            yield f"limits: {limit} is less than the {each * len(p.tables[table])} keys that can match, so names would choose what stays"


def routine_reasons(p) -> set[str]:
    """Reasons that rules without a class record: no reason on their own to look."""
    out: set[str] = set()
    for r, m in _matches(p, "partial_binary"):
        if "verdict" not in r:
            out |= set(m["reasons"]) if "reasons" in m else PARTIAL_REASONS - set(m.get("exclude_reasons", ()))
    return out


@rule_of("V10")
def exemptions(p):
    yield from (f"linkage_policy: unknown reason {x!r}" for x in p.exempt_reasons if x not in PARTIAL_REASONS)
    left = sorted(routine_reasons(p) - set(p.exempt_reasons))
    if left:
        yield f"linkage_policy: {left} are routine, but would make a wheel's linkage unknown"


@rule_of("V11")
def library_groups(p):
    symbols, strings, crates = _names(p, "symbol_group"), _names(p, "string_group"), _names(p, "rust_crate")
    for x in p.tables["crypto_library"]:
        where, banner, copy = _title("crypto_library", x), x.get("string_group"), x.get("copy_string_group")
        forks, texts = x.get("fork_symbol_groups", ()), x.get("fork_string_groups", ())
        for what, names, known in (("symbol group", [x.get("symbol_group"), *forks], symbols), ("string group", [banner, copy, *texts], strings), ("crate", x.get("crates", ()), crates)):
            yield from (f"{where}: unknown {what} {n!r}" for n in names if n is not None and n not in known)
        if copy is not None and (banner is None or banner == copy):
            yield f"{where}: copy_string_group needs another string_group beside it"
        if (forks or texts) and "symbol_group" not in x:
            yield f"{where}: forks without a symbol_group of its own"
        if x.get("symbol_group") in forks:
            yield f"{where}: its own symbol_group is no fork"
        if {banner, copy} & set(texts):
            yield f"{where}: its own string groups are no fork"


@rule_of("V12")
def crate_suppression(p):
    crates = {c["name"]: c for c in p.tables["rust_crate"]}
    for name, c in crates.items():
        for by in c.get("suppressed_by", ()):
            if by == name:
                yield f"rust_crate {name!r}: suppressed by itself"
            elif by not in crates:
                yield f"rust_crate {name!r}: suppressed by unknown crate {by!r}"
            elif owner_of(p, "rust_crate", crates[by]) is None:
                yield f"rust_crate {name!r}: no rule owns its suppressor {by!r}"
        if c.get("suppressed_by") and owner_of(p, "rust_crate", c) is None:
            yield f"rust_crate {name!r}: suppressed, but no rule owns it"


@rule_of("V13")
def printable_substrings(p):
    for g in p.tables["string_group"]:
        if not g["substrings"]:
            yield f"string_group {g['name']!r}: no substrings"
        if any(not x or not all(" " <= ch <= "~" for ch in x) for x in g["substrings"]):
            yield f"string_group {g['name']!r}: substrings must be printable ASCII"


# -- relations between rules -------------------------------------------------------


@rule_of("V14")
def relation_and_basis(p):
    for table, e in _entries(p, "rule", *ROUTED):
        if ("relation" in e) != bool(e.get("basis")):
            yield f"{_title(table, e)}: relation and basis must be given together"


@rule_of("V14")
def relation_and_class(p):
    rules = {r["id"]: r for r in p.tables["rule"]}
    pairs = [(_title("rule", r), r.get("verdict"), r.get("relation")) for r in rules.values()]
    for table, e in _entries(p, *ROUTED):
        owner = rules.get(owner_of(p, table, e))
        verdict, relation = (e.get(k, owner and owner.get(k)) for k in ("verdict", "relation"))
        pairs.append((_title(table, e), verdict, relation))
        if owner is None and relation and not verdict:
            yield f"{_title(table, e)}: relation {relation!r} without a class to hold it against"
        if owner is None and verdict and not relation:  # any rule that reads the table may lend its own
            pairs += [(f"{_title(table, e)} by rule {r['id']!r}", verdict, r.get("relation")) for r, _ in _matches(p, *ROUTED[table])]
    for where, verdict, relation in pairs:
        if verdict and relation and verdict not in ALLOWED[relation]:
            yield f"{where}: {relation} does not go with {verdict}"


def place_of(m: dict) -> str | None:
    """The kind of place where a match's hits lie; None if it can be any."""
    if m["kind"] == "linkage" and "object_values" in m:
        return "object"
    return next((place for place, kinds in PLACES.items() if m["kind"] in kinds), None)


@rule_of("V15")
def suppression_can_fire(p):
    places = {r["id"]: {place_of(m) for m in r["match"]} for r in p.tables["rule"]}
    for r in p.tables["rule"]:
        for by in r.get("suppressed_by", ()):
            mine, theirs = places[r["id"]], places.get(by, {None})
            if None not in mine | theirs and not mine & theirs:
                yield f"{_title('rule', r)}: never in the same place as its suppressor {by!r}"


def circle(edges: dict, what: str) -> str | None:
    """A path that comes back to where it began, as text."""
    done: set = set()
    for start in sorted(edges):
        path, stack = [start], [iter(sorted(edges[start]))]
        while stack and start not in done:
            nxt = next((x for x in stack[-1] if x not in done), None)
            if nxt is None:
                done.add(path.pop())
                stack.pop()
            elif nxt in path:
                return f"{what} goes in a circle: {' -> '.join(map(str, [*path[path.index(nxt) :], nxt]))}"
            else:
                path.append(nxt)
                stack.append(iter(sorted(edges.get(nxt, ()))))
    return None


@rule_of("V16")
def suppression_ends(p):
    """A crate goes where its owner's suppressors are, and a rule with each of its crates that
    can be suppressed."""
    edges: dict[str, set[str]] = {r["id"]: set(r.get("suppressed_by", ())) for r in p.tables["rule"]}
    own = dict(edges)
    for c in p.tables["rust_crate"]:
        owner = owner_of(p, "rust_crate", c)
        if owner in own:
            by = {f"crate {x}" for x in c.get("suppressed_by", ())}
            edges[f"crate {c['name']}"] = by | own[owner]
            if by:
                edges[owner] = edges[owner] | {f"crate {c['name']}"}
    if found := circle(edges, "suppression"):
        yield found


@rule_of("V17")
def sbom_is_covered(p):
    needed, covered = {"crypto_library", "rust_crate"}, set()
    for r, m in _matches(p, "sbom_component"):
        own = needed & set(m.get("tables", ()))
        covered |= own
        if own and r.get("suppressed_by"):
            yield f"{_title('rule', r)}: an SBOM moves linkage, so what explains it cannot be suppressed"
    if needed - covered:
        yield f"no sbom_component rule reads {sorted(needed - covered)}"


@rule_of("V17")
def sbom_crates_stay(p):
    crates, rules = {c["name"]: c for c in p.tables["rust_crate"]}, {r["id"]: r for r in p.tables["rule"]}
    for x in p.tables["crypto_library"]:
        for name in sorted({x["name"], *x.get("crates", ())} & set(crates)):
            owner = rules.get(owner_of(p, "rust_crate", crates[name]), {})
            if crates[name].get("suppressed_by") or owner.get("suppressed_by"):
                yield f"rust_crate {name!r}: moves the linkage of {x['name']} and cannot be suppressed"


@rule_of("V18")
def basis_is_live(p):
    status = {s["id"]: s["status"] for s in p.tables["standard"]}
    for table, e in _entries(p, "rule", *ROUTED):
        for b in e.get("basis", ()):
            if b not in status:
                yield f"{_title(table, e)}: unknown standard {b!r}"
            elif status[b] not in ("current", "revision_planned"):
                yield f"{_title(table, e)}: standard {b!r} is {status[b]}"


@rule_of("V18")
def standards_are_reached(p):
    cited = {b for _, e in _entries(p, "rule", *ROUTED) for b in e.get("basis", ())} | {s.get("successor") for s in p.tables["standard"]}
    yield from (f"standard {s['id']!r}: nothing cites it" for s in p.tables["standard"] if s["id"] not in cited and s["status"] not in ("withdrawn", "planned"))


@rule_of("V19")
def succession(p):
    ids = {s["id"] for s in p.tables["standard"]}
    after = {s["id"]: {s["successor"]} if s.get("successor") else set() for s in p.tables["standard"]}
    yield from (f"standard {k!r}: unknown successor {x!r}" for k, v in after.items() for x in v if x not in ids)
    if found := circle({k: v & ids for k, v in after.items()}, "succession"):
        yield found


@rule_of("V20")
def conventions(p):
    c, groups = p.conventions, _names(p, "string_group")
    yield from (f"conventions: {k} is missing" for k in sorted(CONVENTIONS - set(c)))
    yield from (f"conventions: {k} must be a list of texts" for k in _LISTS if k in c and not _strings(c[k]))
    yield from (f"conventions: {k} names unknown string group {c[k]!r}" for k in _GO if k in c and c[k] not in groups)
    for k in [*CARGO, "mangled_soname_regex", "windows_version_suffix_regex"]:
        if k not in c:
            continue
        try:
            have = re.compile(c[k]).groupindex
        except (re.error, TypeError) as e:
            yield f"conventions: {k}: {e}"
            continue
        wanted = {"name", "version"} if k in CARGO else {"stem"}
        if wanted - set(have):
            yield f"conventions: {k} needs groups {sorted(wanted)}"
    if all(_strings(c.get(k)) for k in _LISTS):
        both = set(c["refused_hash_algorithms"]) & set(c["restricted_hash_algorithms"])
        if both:
            yield f"conventions: {sorted(both)} are both refused and restricted"
        if set(c["windows_library_suffixes"]) - set(c["library_suffixes"]):
            yield "conventions: windows_library_suffixes must be library_suffixes"
