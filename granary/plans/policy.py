"""The policy: tables read from TOML, checked once on the driver, and made into dimensions."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from granary.extract.native.common import Patterns
from granary.extract.pysource import Targets
from granary.plans import coherence
from granary.plans.coherence import PolicyError, check

HERE = Path(__file__).parent.parent / "policy"

KINDS = set(coherence.MATCH_KEYS)
TABLES = {"distributions": "crypto_distribution", "libraries": "crypto_library", "symbols": "symbol_group", "strings": "string_group", "crates": "rust_crate", "modules": "python_module", "standards": "standard", "rules": "rule"}


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table as a local relation: part of the plan itself, without a job to read it."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))


@dataclass
class Policy:
    version: str
    precedence: list[str]
    limits: dict[str, int]
    conventions: dict
    exempt_reasons: list[str]
    ctypes: list[str]
    tables: dict[str, list[dict]] = field(default_factory=dict)
    readers: dict[bytes, Callable] = field(default_factory=dict)

    def read_by(self, magic: bytes, reader: Callable) -> None:
        """Read objects that begin so by a function of (bytes, path, patterns, vendored) to `Obj`."""
        self.readers[magic] = reader

    def entries(self, table: str) -> list[dict]:
        return self.tables[table]

    def rule(self, rule_id: str) -> dict:
        return next(r for r in self.tables["rule"] if r["id"] == rule_id)

    def library_of_sbom(self, name: str) -> dict | None:
        """The library that an SBOM component's name means."""
        return next((x for x in self.tables["crypto_library"] if coherence.library_key(x["name"]) == coherence.library_key(name)), None)

    def crate_of_sbom(self, name: str) -> dict | None:
        return next((x for x in self.tables["rust_crate"] if coherence.crate_key(x["name"]) == coherence.crate_key(name)), None)

    def matches(self, kind: str) -> list[tuple[int, dict, dict]]:
        """(order, rule, match) of one kind in emission order."""
        return [(i * 100 + j, r, m) for i, r in enumerate(self.tables["rule"]) for j, m in enumerate(r["match"]) if m["kind"] == kind]

    def default_rule(self, table: str) -> str | None:
        return next((r["id"] for r in self.tables["rule"] for m in r["match"] if m.get("default") and m.get("table") == table), None)

    def patterns(self) -> Patterns:
        exact: dict[str, list[str]] = {}
        for g in self.tables["symbol_group"]:
            for x in g["exact"]:
                exact.setdefault(x, []).append(g["name"])
        strings = {g["name"]: g["substrings"] for g in self.tables["string_group"]}
        code = {g["name"]: g["substrings"] for g in self.tables["string_group"] if g.get("in_code")}
        prefixes = [(p, g["name"]) for g in self.tables["symbol_group"] for p in g["prefixes"]]
        cargo = {k: self.conventions[k] for k in coherence.CARGO}
        return Patterns(exact, prefixes, strings, code, self.limits["min_string_length"], self.limits["max_evidence_chars"], cargo, frozenset(c["name"] for c in self.tables["rust_crate"]), dict(self.readers))

    def targets(self) -> Targets:
        of = lambda key: {x for r in self.tables["rule"] for m in r["match"] for x in m.get(key, ())}
        return Targets(sorted(m["name"] for m in self.tables["python_module"]), of("targets"), of("attributes"), of("constants"), sorted(self.ctypes))

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        """One table as a dimension of (name, rule, severity, verdict, ...)."""
        default = self.default_rule(table)
        rows = [(e["name"], e.get("rule") or default, e.get("severity"), e.get("verdict"), e.get("relation"), e.get("family"), e.get("basis") or [], e.get("needs_human_review"), e.get("suppressed_by") or []) for e in self.tables[table]]
        return local_frame(spark, rows, "name string, owner string, severity string, verdict string, relation string, family string, basis array<string>, needs_human_review boolean, suppressed_by array<string>")

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r["id"], r["severity"], r["category"], r["layer"], r["confidence"], r.get("verdict"), r.get("relation"), r.get("family"), r.get("basis") or [], bool(r.get("needs_human_review"))) for r in self.tables["rule"]]
        return local_frame(spark, rows, "rule_id string, r_severity string, category string, layer string, confidence string, r_verdict string, r_relation string, r_family string, r_basis array<string>, r_review boolean")


def documents(at: Path) -> dict:
    """A rule set as one mapping: a single TOML file, or a folder with a file for each table."""
    if at.is_file():
        return tomllib.loads(at.read_text())
    out = tomllib.loads((at / "settings.toml").read_text())
    return out | {t: tomllib.loads((at / f"{f}.toml").read_text()).get(t, []) for f, t in TABLES.items()}


def parsed(raw: dict) -> Policy:
    """A policy from a mapping, its shape made even: `match` is always a list."""
    known = {"ruleset_version", "verdict", "limits", "conventions", "linkage_policy", "ctypes_library", *TABLES.values()}
    for name in ("ruleset_version", "verdict", "conventions", "ctypes_library", *(set(TABLES.values()) - {"standard"})):
        if name not in raw:
            raise PolicyError(f"{name} is missing [V24]")
    if set(raw) - known or set(raw["verdict"]) - {"precedence"}:
        raise PolicyError(f"unknown tables or keys {sorted(set(raw) - known) or sorted(raw['verdict'])} [V1]")
    tables = {t: [dict(e) if isinstance(e, dict) else e for e in raw.get(t, [])] for t in TABLES.values()}
    for r in tables["rule"]:
        if isinstance(r, dict) and isinstance(r.get("match"), dict):
            r["match"] = [r["match"]]
    ctypes = [x for e in raw["ctypes_library"] for x in e.get("substrings", ())]
    policy = Policy(str(raw["ruleset_version"]), raw["verdict"].get("precedence", []), dict(raw.get("limits", {})), dict(raw["conventions"]), [], ctypes, tables)
    given = raw.get("linkage_policy")
    if given is not None and set(given) - {"why", "exclude_reasons"}:
        raise PolicyError("linkage_policy: unknown keys [V1]")
    check_shapes = next(coherence.complaints(policy), None) if given is None else None
    if check_shapes and check_shapes[0] in ("V24", "V3"):
        raise PolicyError(f"{check_shapes[1]} [{check_shapes[0]}]")
    # without a table of exemptions, what is routine is exempt
    policy.exempt_reasons = sorted(coherence.routine_reasons(policy)) if given is None else list(given.get("exclude_reasons", ()))
    return policy


def load(at: str | Path | None = None) -> Policy:
    """The policy in a file or a folder of files, the built-in one by default, checked."""
    policy = parsed(documents(Path(at) if at else HERE))
    check(policy)
    return policy
