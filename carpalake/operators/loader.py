"""Batches of an epoch: each row once, the train split in another order each epoch, without a sort.

A row's place in its split is the number of rows before its bucket of hashes plus its rank in it (as splits are dealt). An
epoch's order is a permutation of places that is computed row by row: places are written as a pair (l, r) of numbers under a and b
with a * b just over the split's size, and a few rounds add to l a hash of r and to r a hash of l. That is a bijection of pairs; a
pair past the end is permuted again until it isn't. So nothing but the split's size is needed to know a row's batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .split import ranked

BATCH, SEED = 16, 42
#: Fixed values of the rounds: a prime, and a multiplier for each round.
PRIME, FACTORS = (1 << 31) - 1, (48_271, 69_621, 16_807, 39_373, 40_692, 62_089)
WALK = 32  # permutations of one place at most; a longer walk has a chance of (rows) ** -16


def round_key(seed: int, epoch: Column | int, turn: int) -> Column:
    """A number under PRIME for each seed, epoch and round."""
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.pmod(F.pmod(epoch.cast("long") * FACTORS[turn] + F.lit(seed % PRIME).cast("long"), F.lit(PRIME)) * FACTORS[-1 - turn] + F.lit(turn + 1), F.lit(PRIME))


def permuted_once(place: Column, n: Column, seed: int, epoch: Column | int) -> Column:
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")
    left, right = F.floor(place / b).cast("long"), place % b
    for turn, factor in enumerate(FACTORS):
        key = round_key(seed, epoch, turn)
        if turn % 2:
            right = (right + F.pmod(left + key, F.lit(PRIME)) * factor % PRIME) % b
        else:
            left = (left + F.pmod(right + key, F.lit(PRIME)) * factor % PRIME) % a
    return left * b + right


def permuted(place: Column, n: Column, seed: int = SEED, epoch: Column | int = 1) -> Column:
    """The place that an epoch gives a row of n: a bijection of 0 to n - 1."""
    once = permuted_once(place, n, seed, epoch)
    more = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda x, _: F.when(x >= n, permuted_once(x, n, seed, epoch)).otherwise(x))
    walked = F.when(once < n, once).otherwise(more)
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a place was permuted too often; take another seed")).cast("long"))


def placed(df: DataFrame, split: str = "split", id_col: str = "id") -> DataFrame:
    """row, the columns of df; place, from 0 on in each split; and n, the split's size."""
    rows, place = ranked(df, split, id_col)
    sizes = df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).select(F.col(split).alias("size_of"), "n")
    before = sizes.alias("a").join(sizes.alias("b"), F.coalesce(F.col("b.size_of"), F.lit("")) < F.coalesce(F.col("a.size_of"), F.lit("")), "left")  # a row for each split
    first = before.groupBy("a.size_of", "a.n").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("first"))
    numbered = rows.select("row", place.alias("place"))
    both = numbered.join(F.broadcast(first), F.col(f"row.{split}").eqNullSafe(F.col("size_of")))
    return both.select("row", (F.col("place") - F.col("first")).alias("place"), "n")


def batches(df: DataFrame, epochs: list[int], size: int = BATCH, seed: int = SEED, shuffled: str = "train", split: str = "split", id_col: str = "id") -> DataFrame:
    """df with epoch, batch and slot: each row once an epoch, in batches of `size` (the last one of a split may be shorter), numbered from 0 by split.

    Only the split named `shuffled` changes its order with the epoch. Rows of one id, and without one, are rows like others.
    """
    rows = placed(df, split, id_col).withColumn("epoch", F.explode(F.array(*map(F.lit, epochs))))
    place = F.when(F.col(f"row.{split}") == shuffled, permuted(F.col("place"), F.col("n"), seed, F.col("epoch"))).otherwise(F.col("place"))
    dealt = rows.select("row", "epoch", place.alias("place"))
    return dealt.select("row.*", "epoch", F.floor(F.col("place") / size).cast("long").alias("batch"), (F.col("place") % size).cast("int").alias("slot"))
