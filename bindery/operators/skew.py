"""Finding hot keys, and joins that spread them over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, functions as F

HOT_ROWS = 2_000_000
#: Narrow rows that Spark may well broadcast.
FEW_ROWS = 200_000


def hashed_if_many(narrow: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """The narrow, stored side of a join with file contents: if it is too long for a
    broadcast, it is to be hashed, so that the contents aren't sorted (and spilled)."""
    return narrow.hint("shuffle_hash") if narrow.count() > few else narrow


def hot_keys(df: DataFrame, keys: Sequence[str], more_than: int) -> list[Row]:
    """Hashes and row counts of the keys with more than `more_than` rows.

    One pass over the key columns alone. Counts are combined within each task
    before the shuffle. There can be no more such keys than rows / more_than,
    so the list is small enough to fetch and to broadcast, whatever the data.
    """
    return (
        df.groupBy(F.xxhash64(*keys).alias("_hot_hash"))
        .agg(F.count("*").alias("_hot_rows"))
        .where(F.col("_hot_rows") > more_than)
        .collect()
    )


def flagged(df: DataFrame, keys: Sequence[str], hot: list[Row]) -> DataFrame:
    """Add `_is_hot` and `_hot_rows`, by a broadcast of the (bounded) list of hot hashes."""
    hashes = df.sparkSession.createDataFrame(hot, "_hot_hash bigint, _hot_rows bigint")
    return (
        df.withColumn("_key_hash", F.xxhash64(*keys))
        .join(F.broadcast(hashes), F.col("_key_hash") == F.col("_hot_hash"), "left")
        .withColumn("_is_hot", F.col("_hot_hash").isNotNull())
        .drop("_key_hash", "_hot_hash")
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    Left rows of a hot key are salted by a hash of `spread_by`, into as many
    parts as its row count has multiples of `hot_rows`, and the right rows of
    that key copied once per part; every left row still meets each right row
    once. `right` should have few rows per key. Keys are counted in `counted`,
    or else in `left`, which had better be stored then.
    """
    hot = hot_keys(left if counted is None else counted, on, hot_rows)
    if not hot:
        return left.join(right, list(on), how)
    parts = F.ceil(F.col("_hot_rows") / hot_rows).cast("long")
    zero = F.lit(0).cast("long")
    salt = F.coalesce(F.pmod(F.xxhash64(*spread_by), parts), zero)
    salted = flagged(left, on, hot).withColumn("_salt", salt).drop("_is_hot", "_hot_rows")
    salts = F.coalesce(F.sequence(zero, parts - 1), F.array(zero))
    copies = flagged(right, on, hot).withColumn("_salt", F.explode(salts))
    return salted.join(copies.drop("_is_hot", "_hot_rows"), [*on, "_salt"], how).drop("_salt")
