"""Region trees as nested JSON: nodes with ``id``, ``name`` and ``areas``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.session import materialize

_NODE = "id BIGINT, name STRING, areas STRING"


def _nodes(df: DataFrame, col: str) -> DataFrame:
    """(id, name, children): a node's children stay JSON text until their turn."""
    n = df.select(F.from_json(col, _NODE).alias("n")).select("n.*")
    return n.select("id", "name", F.coalesce(F.from_json("areas", "array<string>"),
                                             F.array().cast("array<string>")).alias("children"))


def tree_roots(docs: DataFrame, col: str) -> DataFrame:
    """Distinct (leaf_id, name) of the documents' top nodes."""
    return _nodes(docs, col).select(F.col("id").alias("leaf_id"), "name").distinct()


def tree_leaves(docs: DataFrame, col: str) -> DataFrame:
    """Distinct (leaf_id, name) of all nodes below the top that have no
    children, at any depth: one level is opened per round until none is left."""
    level, leaves = _nodes(docs, col), None
    while True:
        level = materialize(_nodes(level.select(F.explode("children").alias("json")), "json"))
        here = level.filter(F.size("children") == 0).select(F.col("id").alias("leaf_id"), "name")
        leaves = here if leaves is None else leaves.unionByName(here)
        if level.filter(F.size("children") > 0).isEmpty():
            return leaves.distinct()


def ids_by_name(leaves: DataFrame) -> DataFrame:
    """The inverse, name -> leaf id; of a repeated name the largest id stays."""
    return leaves.groupBy("name").agg(F.max("leaf_id").alias("leaf_id"))
