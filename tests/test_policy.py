"""What the policy checks refuse."""

import tomllib

import pytest

from granary.plans import coherence, policy_queries
from granary.plans import policy as P


def test_the_built_in_policy_holds_together():
    p = P.load()
    assert len(p.entries("rule")) == 71 and p.default_rule("rust_crate") == "BIN_RUST_CRYPTO_CRATE"
    assert {m["kind"] for r in p.entries("rule") for m in r["match"]} == set(P.KINDS)
    assert p.library_of_sbom("OPENSSL")["name"] == "openssl" and p.crate_of_sbom("Boring_Sys")["name"] == "boring-sys" and p.library_of_sbom("ÖPENSSL") is None


@pytest.mark.parametrize("number", list(policy_queries.CASES))
def test_refused(number):
    want = None if number == "allowed" else number
    assert [c for c, by in policy_queries.refusals(number) if by != want] == []


@pytest.mark.parametrize("name", sorted(policy_queries.SQL))
def test_policy_query(spark, name):
    import duckdb

    got = sorted(tuple(r) for r in policy_queries.QUERIES[name](spark, "").select("case", "refused_by").collect())
    assert got == sorted(duckdb.sql(policy_queries.SQL[name]).fetchall())


def test_every_check_has_a_case():
    assert set(coherence.CHECKS) == set(policy_queries.CASES) - {"allowed"}


def _toml(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, str)):
        return str(x) if isinstance(x, int) else '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\0", "\\u0000") + '"'
    if isinstance(x, list):
        return "[" + ", ".join(map(_toml, x)) + "]"
    return "{" + ", ".join(f"{k} = {_toml(v)}" for k, v in x.items()) + "}"


def test_one_file(tmp_path):
    """The whole policy in one file, single matches as tables, exemptions left out."""
    raw = P.documents(P.HERE)
    raw.pop("linkage_policy")
    lines = [f'ruleset_version = {_toml(raw.pop("ruleset_version"))}']
    for name in ("verdict", "limits", "conventions"):
        lines += [f"[{name}]", *[f"{k} = {_toml(v)}" for k, v in raw.pop(name).items()]]
    for table, entries in raw.items():
        for e in entries:
            e = dict(e)
            if len(e.get("match", ())) == 1:
                e["match"] = e["match"][0]
            lines += [f"[[{table}]]", *[f"{k} = {_toml(v)}" for k, v in e.items()]]
    (tmp_path / "own.toml").write_text("\n".join(lines))
    assert tomllib.loads((tmp_path / "own.toml").read_text())
    a, b = P.load(tmp_path / "own.toml"), P.load()
    assert a.tables == b.tables and a.conventions == b.conventions and a.exempt_reasons == ["pe_ordinal_import"]
    (tmp_path / "bad.toml").write_text("\n".join([*lines[:1], *lines[3:]]))
    with pytest.raises(P.PolicyError):
        P.load(tmp_path / "bad.toml")
