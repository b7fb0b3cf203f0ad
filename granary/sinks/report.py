"""Markdown and HTML views of records."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable

from granary.plans.policy import Policy

COLUMNS = ("wheel", "class", "libraries", "families", "rules", "reasons", "review", "errors")


def summary(r: dict) -> list[str]:
    """One row a wheel; - for nothing."""
    v, libs = r["verdict"], r["crypto"]["libraries"]
    reasons = v["reasons"]
    more = f"; +{len(reasons) - 3} more" if len(reasons) > 3 else ""
    row = [
        r["wheel"]["filename"],
        v["class"],
        ", ".join(f"{x['name']}:{x['linkage']}" for x in libs),
        ", ".join(r["crypto"]["families"]),
        str(len(v["rule_ids"])),
        "; ".join(reasons[:3]) + more,
        "yes" if v["needs_human_review"] else "no",
        str(len(r["errors"]))
    ]
    return [x or "-" for x in row]


def table(header: Iterable[str], rows: list[list[str]]) -> str:
    cells = [[str(c).replace("|", "\\|") for c in row] for row in [list(header), *rows]]
    width = [max(3, *(len(r[i]) for r in cells)) for i in range(len(cells[0]))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(cells[0]), "| " + " | ".join("-" * w for w in width) + " |", *map(line, cells[1:])])


def _section(title: str, found: list[dict]) -> list[str]:
    if not found:
        return []
    rows = [[f["rule_id"], f["subject"] or "-", f["severity"], f["verdict"] or "-", f["occurrences"], f["locations"][0]["evidence"]] for f in found]
    return [f"### {title}", "", table(("rule", "subject", "severity", "verdict", "places", "first evidence"), rows), ""]


def markdown(records: Iterable[dict]) -> str:
    """A summary and a section a wheel: what it holds, how it fits, other evidence."""
    records = sorted(records, key=lambda r: r["wheel"]["filename"])
    out = ["# Cryptography inventory", "", table(COLUMNS, [summary(r) for r in records]), ""]
    for r in records:
        found = r["findings"]
        out += [f"## {r['wheel']['filename']}", "", f"Class: {r['verdict']['class']}", ""]
        by_family: dict[str, list[dict]] = {}
        for f in found:
            if f["family"]:
                by_family.setdefault(f["family"], []).append(f)
        if not by_family:
            out += ["No part of it could be read for an inventory." if r["verdict"]["class"] == "OPAQUE" else "No cryptography was found in what was read.", ""]
        for family in sorted(by_family):
            out += _section(f"Inventory: {family}", by_family[family])
        for relation in sorted({f["relation"] for f in found if f["relation"]}):
            out += _section(f"Compatibility: {relation}", [f for f in found if f["relation"] == relation])
        out += _section("Other evidence", [f for f in found if not f["family"] and not f["relation"]])
    return "\n".join(out)


def embedded(data: object) -> str:
    """JSON that may stand inside a script element."""
    text = json.dumps(data, sort_keys=True, separators=(",", ":"))
    for c in "&<>":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


#: What the words of a record mean, in the page's own words.
CLASS_HELP = {
    "NON_APPROVED_CRYPTO": "Carries implementations that no approved module stands behind.",
    "FIPS_BREAKING": "Calls what a host restricted to approved algorithms refuses: it will raise there.",
    "CONDITIONAL": "Fine or not depending on which library it meets, or on a setting of its own.",
    "CONTEXT_DEPENDENT": "Uses something whose purpose decides; the code does not say which.",
    "OPAQUE": "Could not be read well enough to say.",
    "NO_CRYPTO_DETECTED": "Nothing was found in what was read; no promise that there is nothing.",
}
LINKAGE_HELP = {
    "system": "the host's copy", "bundled": "a copy inside the wheel", "static": "compiled into an object of the wheel", "mixed": "several of these at once",
    "none": "no sign of it", "unknown": "some object did not say",
}
FAMILY_HELP = {
    "hash": "digests", "checksum": "digests that are not meant for security", "block_cipher": "block ciphers", "stream_cipher": "stream ciphers", "aead": "ciphers with authentication", "mac": "authentication codes",
    "kdf": "key derivation", "password_hash": "password hashing", "signature": "signatures", "key_agreement": "key agreement", "kem": "key encapsulation", "drbg": "random generators", "entropy": "sources of entropy",
    "tls": "TLS", "ssh": "SSH", "trust_store": "certificates that are trusted", "library": "a library of several of these",
}
RELATION_HELP = {
    "not_specified": "the algorithm is in no standard", "restricted": "allowed for some purposes only", "outside_module": "an approved algorithm outside an approved module", "boundary_unresolved": "which module does the work is open",
    "runtime_refusal": "the host refuses the call", "policy_bypass": "overrides what the host sets", "use_unresolved": "the purpose is open",
}


def classes_of(records: Iterable[dict], precedence: list[str]) -> list[str]:
    """All classes, the policy's first, then others that records have as they come."""
    return list(dict.fromkeys([*precedence, *[r["verdict"]["class"] for r in records]]))


def payload(records: list[dict], policy: Policy) -> dict:
    """What a page needs and no more: the records, the rules and standards that they name (J15),
    classes, tool variants (A16) and the meaning of words (R8, R10)."""
    found = [f for r in records for f in r["findings"]]
    named = {f["rule_id"] for f in found} | {i for r in records for i in r["verdict"]["rule_ids"]}
    cited = {b for f in found for b in f["basis"]}
    rule = lambda r: {k: r.get(k) for k in ("title", "why", "verdict", "severity", "family", "relation")} | {"basis": sorted(r.get("basis", ()))}
    standard = lambda s: {k: s.get(k) for k in ("title", "edition", "status", "successor", "url")}
    variants = {json.dumps(r["tool"], sort_keys=True) for r in records}
    return {
        "records": records,
        "rules": {r["id"]: rule(r) for r in policy.entries("rule") if r["id"] in named},
        "standards": {s["id"]: standard(s) for s in policy.entries("standard") if s["id"] in cited},
        "classes": classes_of(records, policy.precedence),
        "class_help": CLASS_HELP, "linkage_help": LINKAGE_HELP, "family_help": FAMILY_HELP, "relation_help": RELATION_HELP,
        "tool": [json.loads(t) for t in sorted(variants)],
    }


def page(records: Iterable[dict], policy: Policy) -> str:
    """One file: the summary as a table that can be read without scripts, a legend of classes,
    and all data for whoever wants more."""
    records = sorted(records, key=lambda r: (r["wheel"]["filename"], json.dumps(r, sort_keys=True)))
    head = "".join(f"<th>{c}</th>" for c in COLUMNS)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in summary(r)) + "</tr>" for r in records)
    legend = "".join(f"<dt>{html.escape(c)}</dt><dd>{html.escape(CLASS_HELP.get(c, ''))}</dd>" for c in classes_of(records, policy.precedence))
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>Cryptography inventory</title><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table><dl>{legend}</dl><script type="application/json" id="data">{embedded(payload(records, policy))}</script></html>\n'
