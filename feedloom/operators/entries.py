"""Structured entry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.schemas import ENTRY_DDL


def entries(structured: DataFrame, entry_col: str = "entry", id_col: str = "episode_id") -> DataFrame:
    """Typed view of default-scheme entries (unparsable -> NULL fields)."""
    parsed = F.from_json(F.col(entry_col), ENTRY_DDL, {"mode": "PERMISSIVE"})
    return structured.select(F.col(id_col).alias("episode_id"), parsed["guests"].alias("guests"),
                             parsed["companies"].alias("companies"))


def guests(typed: DataFrame) -> DataFrame:
    """One row per guest per episode, with its position in the entry."""
    return typed.select("episode_id", F.posexplode("guests").alias("pos", "g")).select(
        "episode_id", "pos", "g.name", "g.background", "g.ideology")


def companies(typed: DataFrame) -> DataFrame:
    """One row per company per episode."""
    return typed.select("episode_id", F.posexplode("companies").alias("pos", "c")).select(
        "episode_id", "pos", "c.name", "c.business_model", "c.customers")


def entry_keys(structured: DataFrame, entry_col: str = "entry", id_col: str = "episode_id") -> DataFrame:
    """Top-level keys of caller-shaped entries (dynamic schemes);
    non-object entries have no keys."""
    return structured.select(F.col(id_col).alias("episode_id"),
                             F.explode(F.json_object_keys(F.col(entry_col))).alias("key"))
