"""Document governance: missing fields, effective state, findings.

Rows hold owner, applicable_region, effective_at, expires_at, is_permanent,
review_interval_days, next_review_at, version_label, version_status and
has_meta, false where a document has no governance row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stored statuses, and states that keep a document from being found.
VERSION_STATUSES = ["draft", "effective", "superseded", "withdrawn"]
HIDDEN = ["superseded", "withdrawn", "not_yet_effective", "expired"]
SEVERITY = {"metadata_missing": "warning", "not_yet_effective": "info", "expired": "critical", "expiring": "warning", "review_due": "warning"}


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def missing_fields() -> Column:
    rules = {
        "owner": _blank("owner"),
        "applicableRegion": _blank("applicable_region"),
        "effectiveAt": F.col("effective_at").isNull(),
        "expiryPolicy": ~F.coalesce(F.col("is_permanent"), F.lit(False)) & F.col("expires_at").isNull(),
        "reviewPolicy": (F.coalesce(F.col("review_interval_days"), F.lit(0)) == 0) & F.col("next_review_at").isNull(),
        "versionLabel": _blank("version_label"),
        "versionStatus": ~F.coalesce(F.col("version_status"), F.lit("")).isin(VERSION_STATUSES),
    }
    return F.array_compact(F.array(*[F.when(~F.col("has_meta") | rule, name) for name, rule in rules.items()]))


def effective_state(now: datetime) -> Column:
    permanent = F.coalesce(F.col("is_permanent"), F.lit(False))
    return (
        F.when(~F.col("has_meta"), "metadata_incomplete")
        .when(F.col("version_status").isin("draft", "superseded", "withdrawn"), F.col("version_status"))
        .when(F.col("effective_at").isNull(), "metadata_incomplete")
        .when(F.col("effective_at") > F.lit(now), "not_yet_effective")
        .when(~permanent & (F.col("expires_at") < F.lit(now)), "expired")
        .otherwise("active")
    )


def retrievable(state: Column) -> Column:
    return ~state.isin(HIDDEN)


def findings(rows: DataFrame, now: datetime, key: str = "doc_id") -> DataFrame:
    """One row (key, issue_type, severity) per finding."""
    state, moment = effective_state(now), F.lit(now)
    expiring = (state == "active") & ~F.coalesce(F.col("is_permanent"), F.lit(False)) & (F.col("expires_at") <= moment + F.expr("INTERVAL 30 DAYS"))
    tests = {
        "metadata_missing": F.size(missing_fields()) > 0,
        "not_yet_effective": state == "not_yet_effective",
        "expired": state == "expired",
        "expiring": expiring,
        "review_due": F.col("has_meta") & (F.col("next_review_at") <= moment),
    }
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("issue_type"), F.lit(SEVERITY[name]).alias("severity"))) for name, test in tests.items()]))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*")
