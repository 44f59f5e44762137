"""Exact deduplication in three combining steps, with built-in functions only.

1. Local: each map task combines equal texts (partial aggregation by digest, salt and text).
2. Salted: rows of one digest and salt meet; a hot text is spread over `salts` tasks.
3. Global: the at most `salts` winners of a text meet under its digest.

Texts are group keys in every step, so equal digests never merge unequal texts. Documents
then learn their group by a narrow join on the digest; AQE splits a hot digest there. Digests
that more than one text shares are joined on the text itself instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, StructType, VariantType

from .common import cut


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _winners(keyed: DataFrame, of: str, pick: Callable[[str], Column] = F.max) -> DataFrame:
    """digest, text, best, size: one row per distinct text. pick chooses the best of a column, and of the best."""
    salted = keyed.groupBy("digest", "salt", "text").agg(pick(of).alias("best"), F.count(F.lit(1)).alias("size"))
    return salted.repartition("digest").groupBy("digest", "text").agg(pick("best").alias("best"), F.sum("size").alias("size"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest"), F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("salt"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each text stays. Cases: a null text equals an empty one; a
    null id counts in group_size but only stays (with keep_id null) where its text has no other
    id; rows that repeat id and text each keep their row and share one verdict; an empty table
    gives no rows; other columns are not read. digest is a parameter for tests; it may collide.
    """
    keyed = _keyed(docs, id_col, text_col, salts, digest)
    won = _winners(keyed, "id").groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("best").alias("keep_id"), F.max("size").alias("group_size")
    )
    won = cut(won)
    narrow = keyed.select("id", "digest", F.sha2("text", 256).alias("text_sha256"))
    out = narrow.join(won.filter("texts = 1"), "digest").select("id", "keep_id", "group_size", "text_sha256")
    if not won.filter("texts > 1").isEmpty():
        shared = won.filter("texts > 1").select("digest")
        some = keyed.join(shared, "digest", "left_semi")
        exact = _winners(some, "id").select("digest", "text", F.col("best").alias("keep_id"), F.col("size").alias("group_size"))
        out = out.unionByName(some.join(exact, ["digest", "text"]).select("id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _ordered(kind: DataType) -> bool:
    """Whether values of a type have an order."""
    if isinstance(kind, ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType, CalendarIntervalType))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs that stay, with all their columns: one per distinct text, of the largest id.

    The same three steps, with whole rows as the aggregate in place of ids, so no join follows.
    Of rows that share text and id, the largest by the other columns stays; columns without an order (maps, variants,
    intervals, and what holds them) count as their JSON text. A kept null text stays null unless an empty text with the same id ties with it.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    plain = [i for i, c in enumerate(rest) if not _ordered(docs.schema[c].dataType)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    column = lambda i: F.col(f"`{rest[i]}`")
    as_text = lambda i: F.to_json(F.struct(column(i).alias("v")))
    order = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNotNull().alias("given"), *[(as_text(i) if i in plain else column(i)).alias(f"c{i}") for i in range(len(rest))])
    row = F.struct(order.alias("order"), *[column(i).alias(f"c{i}") for i in plain]) if plain else order
    keyed = docs.select(row.alias("row"), text.alias("text"), _sha256(text).alias("digest"), F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("salt"))
    won = _winners(keyed, "row", (lambda c: F.max_by(c, F.col(f"{c}.order"))) if plain else F.max)
    top = "best.order" if plain else "best"
    back = {id_col: F.col(f"{top}.id"), text_col: F.when(F.col(f"{top}.given"), F.col("text"))} | {c: F.col(f"best.c{i}" if i in plain else f"{top}.c{i}") for i, c in enumerate(rest)}
    return won.select(*[back[c].alias(c) for c in docs.columns])
