"""Shared pieces of the training-data operators: table access, text constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..staging import Stages, clear, shared_dir

__all__ = ["SPACE", "WORD", "Stages", "clear", "free_name", "shared_dir", "table"]

#: White space that separates words, as a regular-expression class body (ASCII only).
SPACE = "\\x20\\x09-\\x0D"
#: A word.
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with signs added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
