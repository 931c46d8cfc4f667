"""ALS on the bias residual.

ALS itself is ``pyspark.ml.recommendation.ALS`` (block-partitioned alternating
least squares on the JVM).  A factor is sent once to every block that needs it, so
the blocks are as few as memory and cores allow: their number follows the ratings and
the rank, not the ratings alone.  Where that exchange would still be beyond ``EXCHANGE_BYTES``
the same method runs in waves (``als_waves``).  The item factors are checkpointed to the shared
checkpoint folder in every iteration, which cuts the lineage and deletes the shuffle
files of the iteration before it.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.operators import als_waves
from ratewise.session import ensure_checkpoint_dir


ROWS_PER_BLOCK = 16_000_000  # 12 bytes a rating in a block
FACTOR_BYTES = 512 << 20  # factors that a block receives in a half iteration, at most


EXCHANGE_BYTES = 12 << 30  # factors sent in a half iteration, one a rating, beyond which it runs in waves


def in_waves(rows: int, rank: int) -> bool:
    """Whether one factor for each of the rows is more than may be exchanged at once."""
    return rows * (4 * rank + 16) > EXCHANGE_BYTES


def _blocks(df: DataFrame, rank: int) -> int:
    """Blocks for the ratings, at least one per core.  A block receives at most one factor
    for each of its ratings, so ``FACTOR_BYTES`` bounds its ratings too."""
    rows = min(ROWS_PER_BLOCK, FACTOR_BYTES // (4 * rank + 16))
    return max(10, df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def fit_als(
    train: DataFrame,
    rank: int = 70,
    max_iter: int = 5,
    reg: float = 0.01,
    seed: int = 1,
    user_col: str = "user_ix",
    item_col: str = "business_ix",
    rating_col: str = "residual",
    cold: str = "nan",
    num_blocks: int | None = None,
    checkpoint_interval: int = 1,
) -> ALSModel:
    """M4: explicit-feedback ALS.  ``cold`` is the cold-start strategy used at predict time."""
    ensure_checkpoint_dir(train.sparkSession)
    if num_blocks is None and max_iter > 0:
        n = train.count()
        if in_waves(n, rank):
            return als_waves.fit_in_waves(train, n, rank, max_iter, reg, seed, user_col, item_col, rating_col, cold)
    nb = num_blocks or _blocks(train, rank)
    als = ALS(
        rank=rank,
        maxIter=max_iter,
        regParam=reg,
        seed=seed,
        userCol=user_col,
        itemCol=item_col,
        ratingCol=rating_col,
        coldStartStrategy=cold,
        numUserBlocks=nb,
        numItemBlocks=nb,
        checkpointInterval=checkpoint_interval,
        nonnegative=False,
        implicitPrefs=False,
    )
    return als.fit(train.select(user_col, item_col, rating_col))


def predict_als(model: ALSModel, df: DataFrame, cold: str = "nan") -> DataFrame:
    """M5: transform; ``cold='drop'`` removes pairs without factors, ``'nan'`` keeps them as NaN."""
    out = model.copy().setColdStartStrategy(cold).transform(df)  # the caller's model stays as it is
    return out.withColumn("prediction", F.col("prediction").cast("double"))


def item_factors(model: ALSModel) -> DataFrame:
    """(id, features array<float>) for businesses."""
    return model.itemFactors


def user_factors(model: ALSModel) -> DataFrame:
    return model.userFactors


def save_model(model: ALSModel, path: str) -> str:
    """S12."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> ALSModel:
    return ALSModel.load(path)
