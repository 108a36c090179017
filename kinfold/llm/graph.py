"""Connected components of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import clustering


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component is its smallest node."""
    return clustering.components(links).select(F.col("id").alias("node"), "component")
