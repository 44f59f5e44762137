"""Queries of the loader: batches of the study's splits, and the loss over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import absolute_error
from ..operators import evaluate, loader
from . import queries
from .registry import register


def _permuted_sql(place: str) -> str:
    """What loader.permuted_once does, over the columns n, a, b and epoch."""
    p, left, right = loader.PRIME, f"({place} // b)", f"({place} % b)"
    for turn, factor in enumerate(loader.FACTORS):
        key = f"((((epoch * {factor} + {loader.SEED}) % {p}) * {loader.FACTORS[-1 - turn]} + {turn + 1}) % {p})"
        if turn % 2:
            right = f"(({right} + (({left} + {key}) % {p}) * {factor} % {p}) % b)"
        else:
            left = f"(({left} + (({right} + {key}) % {p}) * {factor} % {p}) % a)"
    return f"({left} * b + {right})"


BATCHES_SQL = f"""{queries.SPLIT_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, sized AS (SELECT p.id, p.split, s.pred, s.boneage, count(*) OVER (PARTITION BY p.split) AS n,
        row_number() OVER (PARTITION BY p.split ORDER BY {queries.HASH.replace("id", "p.id")}, p.id) - 1 AS place FROM parted p JOIN study s USING (id)),
    ab AS (SELECT *, ceil(sqrt(n::DOUBLE))::BIGINT AS a, ((n + ceil(sqrt(n::DOUBLE))::BIGINT - 1) // ceil(sqrt(n::DOUBLE))::BIGINT)::BIGINT AS b, unnest([1, 2])::BIGINT AS epoch FROM sized),
    walk AS (SELECT *, CASE WHEN split = 'train' THEN {_permuted_sql("place")} ELSE place END AS pos FROM ab
             UNION ALL SELECT * EXCLUDE (pos), {_permuted_sql("pos")} FROM walk WHERE pos >= n),
    batched AS (SELECT id, split, epoch, pos // 16 AS batch, (pos % 16)::INTEGER AS slot, pred, boneage FROM walk WHERE pos < n)"""


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = queries.parted(spark, sf_dir).select("id", "split", "pred", "boneage")
    return loader.batches(p, [1, 2])


@register(f"{BATCHES_SQL} SELECT id, split, epoch, batch, slot FROM batched")
def loader_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(spark, sf_dir).select("id", "split", "epoch", "batch", "slot")


@register(f"{BATCHES_SQL} SELECT epoch, round(avg(l), 9) AS loss FROM (SELECT epoch, batch, avg(abs(pred - boneage)) AS l FROM batched WHERE split = 'train' GROUP BY ALL) GROUP BY epoch")
def batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of two epochs: the mean over the train split's batches of their means."""
    train = batched(spark, sf_dir).filter("split = 'train'")
    return evaluate.batch_loss(train, F.col("batch"), absolute_error(F.col("pred"), F.col("boneage")), "epoch")
