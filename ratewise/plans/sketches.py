"""Registered query of the matrix sketch: its bound, held against exact sums of squares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.operators.sketch import frequent_directions
from ratewise.sources import views as V

SIZE = 32

# Column energies are |A x|^2 along the axes; the sketch may fall short by its bound, never exceed.
BOUND_SQL = """
WITH e AS (SELECT unnest(range(1, len(embedding) + 1)) AS i, embedding AS v FROM embeddings)
SELECT CAST(i AS INT) AS dim, round(sum(CAST(v[i] AS DOUBLE) * v[i]), 4) AS energy, TRUE AS within_bound, TRUE AS bound_small FROM e GROUP BY i"""


def m23_sketch_bound(spark: SparkSession, sf: str) -> DataFrame:
    """For each column of the embeddings its exact energy, whether the sketch's lies within
    ``lost`` below it, and whether ``lost`` keeps its own bound."""
    emb = V.table(spark, sf, "embeddings").select("embedding")
    b = frequent_directions(emb, "embedding", SIZE)
    own = (b.rows**2).sum(0)
    slack = 1e-6 * max(b.total, 1.0)
    small = bool(b.lost <= (b.total - own.sum()) / SIZE + slack)
    sketched = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(own)], "dim int, sketched double")
    exact = emb.select(F.posexplode("embedding").alias("i", "x")).groupBy((F.col("i") + 1).alias("dim")).agg(
        F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("energy"))
    gap = F.col("energy") - F.col("sketched")
    return exact.join(sketched, "dim").select("dim", F.round("energy", 4).alias("energy"),
                                              gap.between(F.lit(-slack), F.lit(b.lost + slack)).alias("within_bound"), F.lit(small).alias("bound_small"))


QUERIES = {"m23_sketch_bound": m23_sketch_bound}
ORACLE = {"m23_sketch_bound": BOUND_SQL}
