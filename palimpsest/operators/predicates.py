"""Row conditions that many operators share, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def active() -> Column:
    return F.col("deleted_at").isNull()


def in_project(project: str) -> Column:
    return F.col("project_id").isin(project, "global")


def valid_at(at: Column) -> Column:
    """Validity is half open: from its beginning, up to but without its end; nulls are open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def valid_now(now: Column) -> Column:
    """Not ended; unlike valid_at it doesn't ask for the beginning."""
    return F.col("valid_to").isNull() | (F.col("valid_to") > now)


def visible_to(agent: str | None) -> Column:
    return F.lit(True) if agent is None else F.col("agent_id").isNull() | F.col("agent_id").isin(agent, "system")


def confident(least: float) -> Column:
    return F.coalesce(F.col("confidence"), F.lit(0.5)) >= least
