"""Helpers that every training-data operator shares: the cluster's shared folder, stored tables, sizes and bindings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import shared
from strandline.shared import dropped

#: Below so many bytes a side may be broadcast; the size is measured, not assumed.
BROADCAST_BYTES = 32 << 20
#: The same for tables of keys, of which a run makes many: the driver holds each for a while.
KEYS_BYTES = 4 << 20
_scopes: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """`shared.stored`: a lasting table outlives the scope in which it is written."""
    out = shared.stored(df, name)
    if _scopes and not lasting:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the tables that were stored inside it, but for lasting ones."""
    _scopes.append([])
    try:
        yield
    finally:
        dropped(*_scopes.pop())


def plan_bytes(df: DataFrame) -> int:
    """Bytes of df: Catalyst's estimate (for a file scan the size of its files) or, where it has none, its measured texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    wide = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    return int(df.agg(F.sum(sum(wide[1:], wide[0]).cast("long"))).first()[0] or 0)


def partitions_for(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """Partitions that grow with the input, so that one holds about bytes_each of it."""
    return max(least, -(-plan_bytes(df) // bytes_each))


def small(df: DataFrame, measured_bytes: int) -> DataFrame:
    """Broadcast a side of a measured size below the bound; leave the choice to Spark beyond it."""
    return F.broadcast(df) if measured_bytes <= BROADCAST_BYTES else df


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: Column, ask: Column | None = None) -> DataFrame:
    """rows with the columns of table, a stored one with a row for each key and, in `n`, how many of the rows have it; null
    where there is none or `ask` doesn't hold. No key makes a large task: a table of a small size is broadcast; of a larger
    one the keys with more than a 256th of all rows, 256 at most, are; rows left without a question are dealt by `spread`."""
    ask, own = F.lit(True) if ask is None else F.coalesce(ask, F.lit(False)), [c for c in table.columns if c not in (key, "n")]
    told = table.select(F.col(key).alias("_key"), "n", F.struct(*own).alias("_told"))
    if 8 * plan_bytes(table) <= KEYS_BYTES:
        met = rows.withColumn("_ask", ask).join(F.broadcast(told.drop("n")), F.col("_ask") & (F.col(key) == F.col("_key")), "left")
    else:
        total = table.agg(F.sum("n")).first()[0] or 0
        heavy = told.where(F.col("n") * 256 > total).select(F.col("_key").alias("_heavy"), F.col("_told").alias("_first"))
        light = told.where(F.col("n") * 256 <= total).select("_key", "_told", F.lit(0).cast("long").alias("_deal"))
        some = rows.withColumn("_ask", ask).join(F.broadcast(heavy), F.col("_ask") & (F.col(key) == F.col("_heavy")), "left")
        open_ = F.col("_ask") & F.col("_heavy").isNull() & F.col(key).isNotNull()
        dealt = some.withColumn("_own", F.when(open_, 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 40))).cast("long"))
        met = dealt.join(light, (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_deal")), "left").withColumn("_told", F.coalesce("_told", "_first"))
    return met.select(*rows.columns, *(F.col(f"_told.{c}").alias(c) for c in own))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def row_key(*cols: str | Column) -> Column:
    """A key of a whole row, so that repeated ids and null ids stay apart and identical rows fall together."""
    return F.xxhash64(*cols)


def carried(docs: DataFrame, carry: tuple[str, ...]) -> list[Column]:
    """The columns that an operator passes through beside its own, as one struct whose names can't clash with them."""
    return [F.struct(*(docs[c] for c in carry)).alias("carried")] if carry else []


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))
