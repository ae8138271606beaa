"""Sinks: findings by region, and the report of each package as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finding_regions(checks: DataFrame, package: str = "package_id") -> DataFrame:
    """(package, region_id, rule_id, status): for each region in a finding the last rule by order; rules that don't apply say nothing.

    ``checks``: rule_ord, rule_id, status and region_ids.
    """
    rows = checks.where("status <> 'not_applicable'").select(package, "rule_ord", "rule_id", "status", F.explode("region_ids").alias("region_id"))
    last = rows.groupBy(package, "region_id").agg(F.max(F.struct("rule_ord", "rule_id", "status")).alias("x"))
    return last.select(package, "region_id", "x.rule_id", "x.status")


def regions_with_findings(regions: DataFrame, findings: DataFrame, package: str = "package_id") -> DataFrame:
    """The regions (package, id, …) that stand in a finding."""
    return regions.join(findings.select(package, F.col("region_id").alias("id")), [package, "id"], "left_semi")


def documents(summed: DataFrame, package: str = "package_id") -> DataFrame:
    """(package, report): summary and checks of each package as JSON. ``summed``: a row for each package, as ``rules.summed`` gives it."""
    head = F.struct("score", "status", "passed", "warnings", "failed", "not_applicable")
    body = F.struct(F.col(package), head.alias("summary"), "checks")
    return summed.select(package, F.to_json(body).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON line for each package."""
    reports.select(F.col("report").alias("value")).write.text(path)
