"""Triage questions as SQL views over findings and verdicts."""

from __future__ import annotations

from granary.plans.scan import Scan

VIEWS = {
    "will_raise": "SELECT f.wheel_id, v.filename, p.path, p.line, p.evidence FROM findings f JOIN verdicts v USING (wheel_id) LATERAL VIEW explode(f.locations) x AS p WHERE f.verdict = 'FIPS_BREAKING'",
    "own_openssl": "SELECT wheel_id, filename, conditions['openssl_linkage'] AS linkage FROM verdicts WHERE conditions['openssl_linkage'] IN ('bundled', 'static', 'mixed')",
    "unread": "SELECT wheel_id, filename, reasons FROM verdicts WHERE array_contains(classes, 'OPAQUE')",
    "needs_human": "SELECT wheel_id, filename, class FROM verdicts WHERE needs_human_review",
    "outside_module_only": "SELECT wheel_id, filename FROM verdicts WHERE relations = array('outside_module')",
}


def create(scan: Scan) -> None:
    """Register findings, verdicts, linkage and the views in the scan's session."""
    spark = scan.evidence.sparkSession
    for name in ("findings", "verdicts", "linkage"):
        getattr(scan, name).createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMP VIEW triage_{name} AS {sql}")
