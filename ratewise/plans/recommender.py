"""End-to-end recommender: split -> bias -> one consistent index -> ALS on the
residual -> bias re-added -> fallback -> metrics (SURVEY entry 1, M1-M12).

Shuffle budget: the rating rows are shuffled once per entity key (the
per-entity table carries mean, count and dense index together, so one join
attaches all three), plus ALS's own block exchanges.  Entity tables and the
scored test rows are checkpointed to the shared folder: they are reused by
several consumers and their lineage survives executor loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.columns import clean_prediction, fallback_rating, final_rating, residual
from ratewise.operators import evaluate as E
from ratewise.operators.bias import Bias, fit_bias
from ratewise.operators.als_waves import release, waves
from ratewise.operators.recommend import fit_als, in_waves, predict_als
from ratewise.operators.split import dense_index, flag_split, join_key
from ratewise.session import materialise, remove_paths
from ratewise.sources import views as V


@dataclass
class RecommenderConfig:
    # The original scripts' settings.
    rank: int = 70
    max_iter: int = 5
    reg: float = 0.01
    seed: int = 1
    min_business: int = 0
    min_user: int = 10
    star_threshold: float = 3.0
    cold: str = "nan"

    def label(self) -> str:
        return f"rank={self.rank},reg={self.reg},maxIter={self.max_iter},seed={self.seed}"


@dataclass
class RecommenderResult:
    scored: DataFrame
    bias: Bias
    model: ALSModel
    config: RecommenderConfig = field(default_factory=RecommenderConfig)
    users: DataFrame | None = None
    items: DataFrame | None = None
    test_indexed: DataFrame | None = None


def entity_tables(bias: Bias) -> tuple[DataFrame, DataFrame]:
    """(user_id, user_mean, user_count, user_ix), (business_id, ..., business_ix)."""
    # The index is computed on the entity tables themselves (unique per key), carrying
    # mean and count; the result is already checkpointed by ``dense_index``.
    users = dense_index(bias.users, "user_id", "user_ix", carry=["user_mean", "user_count"])
    items = dense_index(bias.items, "business_id", "business_ix", carry=["business_mean", "business_count"])
    return users, items


@dataclass
class Prepared:
    """What every fit over one split shares: bias model, index and joined rows."""

    bias: Bias
    users: DataFrame
    items: DataFrame
    train: DataFrame
    test: DataFrame


def with_entities(rows: DataFrame, bias: Bias, users: DataFrame, items: DataFrame) -> DataFrame:
    """Rows with means, counts and indices; unseen entities get mu, count 0 and index -1."""
    j = join_key(join_key(rows, users, "user_id", "left"), items, "business_id", "left")
    return j.select(
        *rows.columns,
        F.coalesce("user_mean", bias.mu).alias("user_mean"),
        F.coalesce("business_mean", bias.mu).alias("business_mean"),
        F.coalesce("user_count", F.lit(0).cast("long")).alias("user_count"),
        F.coalesce("business_count", F.lit(0).cast("long")).alias("business_count"),
        # ALS takes whole numbers in the int range only.
        F.coalesce("user_ix", F.lit(-1)).cast("int").alias("user_ix"),
        F.coalesce("business_ix", F.lit(-1)).cast("int").alias("business_ix"),
    )


def prepare(train: DataFrame, test: DataFrame) -> Prepared:
    bias = fit_bias(train)
    users, items = entity_tables(bias)
    # Every training entity has a mean and an index.
    tr = with_entities(train.select("user_id", "business_id", "stars"), bias, users, items).withColumn(
        "residual", residual("stars", "user_mean", "business_mean", bias.mu))
    te = with_entities(test.select("review_id", "user_id", "business_id", "stars"), bias, users, items)
    return Prepared(bias, users, items, materialise(tr.select("user_ix", "business_ix", "residual"), "train-rows"),
                    materialise(te, "test-rows"))


def run_recommender(train: DataFrame, test: DataFrame, cfg: RecommenderConfig | None = None) -> RecommenderResult:
    return fit_and_score(prepare(train, test), cfg or RecommenderConfig())


def fit_and_score(ready: Prepared, cfg: RecommenderConfig) -> RecommenderResult:
    model = fit_als(ready.train, cfg.rank, cfg.max_iter, cfg.reg, cfg.seed, cold=cfg.cold)
    scored = materialise(score(ready, model, cfg), "scored")
    return RecommenderResult(scored, ready.bias, model, cfg, ready.users, ready.items, ready.test)


def score(ready: Prepared, model: ALSModel, cfg: RecommenderConfig) -> DataFrame:
    """The test rows with the model's prediction and every rating made from it."""
    mu = ready.bias.mu
    return predict_als(model, ready.test, cfg.cold).select(
        "review_id", "user_id", "business_id", "stars", "user_mean", "business_mean", "user_count",
        "business_count",
        (~F.isnan("prediction")).alias("has_prediction"),
        clean_prediction("prediction").alias("prediction"),
    ).withColumn("final_rating", final_rating("prediction", "user_mean", "business_mean", mu)).withColumn(
        "bias_rating", final_rating(F.lit(0.0), "user_mean", "business_mean", mu)
    ).withColumn(
        "fallback_rating",
        fallback_rating("final_rating", "user_mean", "business_mean", mu, "business_count", "user_count",
                        cfg.min_business, cfg.min_user),
    )


def predict_pairs(res: RecommenderResult, pairs: DataFrame) -> DataFrame:
    """M20 for a given pair table: its columns plus ``rating``, the residual prediction with
    the bias added back; null where the user or the business was not trained.  Only the
    given pairs are scored: equi-joins with the factor tables, no grid."""
    rows = with_entities(pairs, res.bias, res.users, res.items)
    got = predict_als(res.model, rows, "nan")
    rating = final_rating("prediction", "user_mean", "business_mean", res.bias.mu)
    return got.select(*pairs.columns, F.when(~F.isnan("prediction"), rating).alias("rating"))


def metrics(res: RecommenderResult) -> DataFrame:
    """Every RMSE of the run as rows (metric, n, value, config)."""
    cfg, s = res.config, res.scored
    stars = E.star_strata("final_rating", cfg.star_threshold)
    act = E.activity_strata(cfg.min_business, cfg.min_user)
    strata = {
        "als_bias": None,
        "als_bias_predicted_pairs": F.col("has_prediction"),
        "als_bias_high_stars": stars["high"],
        "als_bias_low_stars": stars["low"],
        "als_bias_popular": act["popular"],
        "als_bias_power": act["power"],
        "als_bias_popular_power": act["popular_power"],
    }
    extra = {
        "bias_only": F.col("bias_rating"),
        "raw_als": F.col("prediction"),
        "fallback": F.col("fallback_rating"),
    }
    return E.report([
        (E.baseline_rmse(s, extra=extra), "baseline", "baseline"),
        (E.stratified_rmse(s, strata, pred="final_rating"), "stratum", cfg.label()),
    ])


# The settings that the fixtures state for the stand-in ratings.
FIXTURE = RecommenderConfig(rank=10, reg=0.1, min_user=25)


def flagship_report(spark: SparkSession, sf_dir: str, cfg: RecommenderConfig | None = None) -> DataFrame:
    train, test = flag_split(V.ratings(spark, sf_dir))
    return metrics(run_recommender(train, test, cfg or FIXTURE))


def sweep(spark: SparkSession, sf_dir: str, grid: list[dict]) -> DataFrame:
    """One fit per grid point over the same split, bias model, index and joined rows;
    returns (rank, reg, max_iter, n, rmse) with ALS + bias over all test rows.  Of every
    point only its row is written, so no fit's factors or scored rows stay for the next.  Test
    rows that would carry too much of factors through the joins are scored in waves."""
    ready = prepare(*flag_split(V.ratings(spark, sf_dir)))
    n_test = ready.test.count()
    out = None

    def errors(model: ALSModel, cfg: RecommenderConfig) -> DataFrame:
        if not in_waves(n_test, cfg.rank):
            return E.rmse(score(ready, model, cfg), "stars", "final_rating")

        def parts() -> Iterator[DataFrame]:
            n = waves(cfg.rank)
            for k in range(n):
                some = ready.test.where(F.pmod(F.xxhash64("user_ix", "business_ix"), F.lit(n)) == k)
                yield score(replace(ready, test=some), model, cfg)
                release(spark)

        return E.rmse_of_parts(parts(), "stars", "final_rating")

    for point in grid:
        cfg = RecommenderConfig(**point)
        model = fit_als(ready.train, cfg.rank, cfg.max_iter, cfg.reg, cfg.seed, cold=cfg.cold)
        row = materialise(errors(model, cfg).select(
            F.lit(cfg.rank).alias("rank"), F.lit(cfg.reg).alias("reg"), F.lit(cfg.max_iter).alias("max_iter"),
            "n", "rmse"), "sweep-row")
        remove_paths(spark, getattr(model, "_rw_paths", []))
        out = row if out is None else out.unionByName(row)
    return out
