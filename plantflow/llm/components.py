"""Connected components of a link table, with every round kept in a table of the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plantflow.llm.storage import materialize
from plantflow.operators import components as contraction


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); the root is the smallest reachable node."""
    return contraction.components(links, lambda rows: materialize(rows, "components"))
