"""The registry that query modules add to: a function of (spark, sf_dir) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.vectors import doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name; ``sql`` is DuckDB's form."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as (vec_id, cluster, x): the label stands for the cluster."""
    from pyspark.sql import functions as F

    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("cluster"), doubles("embedding").alias("x"))


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one bag with the label as cluster: (bag, vec_id, cluster, x, selected), every fourth selected."""
    from pyspark.sql import functions as F

    return vectors(spark, sf_dir).select(F.lit(1).alias("bag"), "vec_id", "cluster", "x", (F.col("vec_id") % 4 == 0).alias("selected"))


#: SQL that the oracles share.
V = "v AS (SELECT vec_id, label::INT AS cluster, embedding::DOUBLE[] AS x FROM embeddings)"
C = """e AS (SELECT vec_id, cluster, unnest(x) AS value, unnest(range(1, len(x) + 1)) AS d FROM v),
c AS (SELECT cluster, list(m ORDER BY d) AS centre FROM (SELECT cluster, d, avg(value) AS m FROM e GROUP BY 1, 2) GROUP BY 1)"""


def sq(a: str, b: str) -> str:
    """Squared distance of two lists in DuckDB."""
    return f"pow(list_distance({a}, {b}), 2)"
