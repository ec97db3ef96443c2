"""Matching finished runs to alert rules, and message text."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TabularError

# Trigger bits of a rule by terminal run status.
TRIGGERS = {"Failed": 1, "Succeeded": 2, "Cancelled": 4}

# Variables a message template may use.
TEMPLATE_VARIABLES = (
    "workflow.id", "workflow.name", "run.id", "run.status", "run.triggeredBy", "run.startedAtUtc",
    "run.completedAtUtc", "error.code", "error.category", "error.summary",
)


def rule_triggers(rules: DataFrame) -> DataFrame:
    """Enabled rules, one row per (workflow, status) they fire on.

    Spelling the bits out turns the match into an equi-join.
    """
    fires = F.array_compact(F.array(*[F.when(F.col("triggers").bitwiseAND(bit) != 0, s) for s, bit in TRIGGERS.items()]))
    return rules.where("enabled").select(
        "rule_id", F.col("workflow_id").alias("rule_workflow_id"), F.explode(fires).alias("rule_status")
    )


def delivery_key(rule: Column, run: Column, status: Column) -> Column:
    return F.concat(F.lit("rule:"), rule.cast("string"), F.lit(":run:"), run.cast("string"), F.lit(":event:Run"), status)


def match_rules(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """One delivery per rule, run and terminal event.

    Copies of a run event collapse before the join, so a heavily repeated event is combined
    map-side; a workflow with very many runs is split by adaptive execution.
    """
    once = (
        runs.where(F.col("status").isin(*TRIGGERS))
        .groupBy("run_id", "workflow_id", "status")
        .agg(F.min("completed_at").alias("completed_at"))
    )
    triggers = rule_triggers(rules)
    hit = (once["workflow_id"] == triggers["rule_workflow_id"]) & (once["status"] == triggers["rule_status"])
    return once.join(triggers, hit, "inner").select(
        "rule_id", "run_id", "workflow_id", "status", "completed_at",
        delivery_key(F.col("rule_id"), F.col("run_id"), F.col("status")).alias("delivery_key"),
    )


def check_template(template: str, allowed=TEMPLATE_VARIABLES) -> list[tuple[str, str]]:
    """The template as ("text" | "variable", value) pieces; unmatched braces and unknown names fail."""
    pieces: list[tuple[str, str]] = []
    for part in re.split(r"(\{\{.*?\}\})", template, flags=re.DOTALL):
        if part.startswith("{{") and part.endswith("}}") and len(part) >= 4:
            name = part[2:-2].strip()
            if name not in allowed:
                raise TabularError("template.variable", f"template variable '{name}' is not allowed")
            pieces.append(("variable", name))
        elif "{{" in part or "}}" in part:
            raise TabularError("template.delimiter", "unmatched template delimiter")
        elif part:
            pieces.append(("text", part))
    return pieces


def render_template(template: str, columns: Mapping[str, Column], allowed=TEMPLATE_VARIABLES) -> Column:
    """The message text per row; a missing or null variable is empty, values are not expanded again."""
    parts = [
        F.lit(value) if kind == "text" else F.coalesce(columns[value].cast("string"), F.lit(""))
        if value in columns
        else F.lit("")
        for kind, value in check_template(template, allowed)
    ]
    return F.concat(*parts) if parts else F.lit("")
