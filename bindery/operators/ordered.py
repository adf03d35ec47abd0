"""Running values in processing order that survive a hot key.

A plain window puts all rows of a key into one task. Here a key that holds
more rows than one task should take is cut into segments of consecutive
sequence numbers; each segment is windowed on its own, and what it needs from
the segments before it arrives through a join with per-segment tails. Sequence
numbers are unique, so a segment of width W never holds more than W rows, and
the tails of a key number at most (highest sequence number / W).

Which keys are cut only affects speed; cutting any set of keys gives the same
rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from bindery.operators.skew import HOT_ROWS, flagged, hot_keys

SEGMENT = "_segment"
SEGMENT_ROWS = HOT_ROWS


@dataclass(frozen=True)
class Order:
    """Rows of `keys` taken one after another by `seq`; `cut` if some are in segments."""

    keys: tuple[str, ...]
    seq: str
    cut: bool = False

    @property
    def parts(self) -> tuple[str, ...]:
        return (*self.keys, SEGMENT) if self.cut else self.keys

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(self.seq)


def segmented(
    df: DataFrame,
    order: Order,
    segment_rows: int = SEGMENT_ROWS,
    counted: DataFrame | None = None,
) -> tuple[DataFrame, Order]:
    """Cut hot keys into segments.

    The hot keys (a short list) are fetched first: with none, as is usual, the
    plan keeps to plain windows. Otherwise rows gain a segment column, null for
    the ordinary keys. Where `df` is a batch on top of one base row per key, it
    is enough to count the keys of the batch, given as `counted`.
    """
    hot = hot_keys(df if counted is None else counted, order.keys, segment_rows)
    if not hot:
        return df, order
    number = F.floor(F.col(order.seq) / F.lit(segment_rows)).cast("long")
    cut = flagged(df, order.keys, hot).withColumn(SEGMENT, F.when(F.col("_is_hot"), number))
    return cut.drop("_is_hot", "_hot_rows"), replace(order, cut=True)


def _carried(
    df: DataFrame, order: Order, last: Mapping[str, Column], total: Mapping[str, Column]
) -> DataFrame:
    """What each segment of a hot key inherits from the segments before it."""
    seq = F.col(order.seq)
    # Tails are combined before the shuffle, so a hot key sends one row per task.
    tails = (
        df.where(F.col(SEGMENT).isNotNull())
        .groupBy(*order.parts)
        .agg(
            *[F.max_by(c, F.when(c.isNotNull(), seq)).alias(n) for n, c in last.items()],
            *[F.sum(c).alias(n) for n, c in total.items()],
        )
    )
    earlier = (
        Window.partitionBy(*order.keys)
        .orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return tails.select(
        *order.parts,
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in last],
        *[F.sum(n).over(earlier).alias(f"_in_{n}") for n in total],
    )


def running(
    df: DataFrame,
    order: Order,
    *,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    before_only: bool = False,
) -> DataFrame:
    """Add, per row, the last non-null value and the sum of expressions so far.

    "So far" includes the row itself unless `before_only`. Takes what
    `segmented` returned. Calls on the same order share one shuffle and sort.
    """
    last, total = dict(last or {}), dict(total or {})
    frame = order.window().rowsBetween(Window.unboundedPreceding, -1 if before_only else 0)
    within = {n: F.last(c, ignorenulls=True).over(frame) for n, c in last.items()}
    within |= {n: F.sum(c).over(frame) for n, c in total.items()}
    zero = F.lit(0)
    if not order.cut:
        plain = {n: F.coalesce(c, zero) if n in total else c for n, c in within.items()}
        return df.select("*", *[c.alias(n) for n, c in plain.items()])

    # Key columns may be null; the segment is null for the ordinary keys, which inherit nothing.
    carried = _carried(df, order, last, total)
    carried = carried.withColumnsRenamed({p: f"_of_{p}" for p in order.parts})
    same = F.col(SEGMENT) == F.col(f"_of_{SEGMENT}")
    for key in order.keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    joined = df.join(carried, same, "left").drop(*[f"_of_{p}" for p in order.parts])
    scanned = joined.select("*", *[c.alias(f"_seg_{n}") for n, c in within.items()])
    done = {n: F.coalesce(f"_seg_{n}", f"_in_{n}") for n in last}
    done |= {n: F.coalesce(f"_seg_{n}", zero) + F.coalesce(f"_in_{n}", zero) for n in total}
    return scanned.select(*df.columns, *[c.alias(n) for n, c in done.items()])
