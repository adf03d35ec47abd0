"""Identity of rows, whatever their columns hold."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from bindery.session import written

KEY = ("_file", "_row")


def keyed(docs: DataFrame) -> DataFrame:
    """Add `_file` and `_row`: the file of each row and its place in that file.

    Unlike a document id, which may be null or repeat, and unlike a running
    number, which follows the partitions, this is the same in every pass and
    retry. Only a scan of Parquet files, each read once, has such places of its
    own, be it filtered or with some columns only. Anything else (rows that were
    exploded, joined, united or sampled) is stored first. Columns of `docs` with
    these names have to be set `aside` before.
    """
    if taken := _clashing(docs, KEY):
        raise ValueError(f"columns exist already: {taken}")
    if _scan_of_distinct_files(docs):
        try:
            return _numbered(docs)
        except AnalysisException:  # files of another format
            pass
    return _numbered(written(docs, "rows"))


def _scan_of_distinct_files(docs: DataFrame) -> bool:
    """Whether each row of `docs` is another row of its files."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or not docs.inputFiles():
        return False
    files = list(plan.relation().location().inputFiles())
    return len(files) == len(set(files))


def _numbered(docs: DataFrame) -> DataFrame:
    own = docs.columns
    found = docs.select(
        *[F.col(f"`{c}`") for c in own],
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    return found


def _clashing(docs: DataFrame, names: Iterable[str]) -> list[str]:
    taken = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() in taken]


def aside(
    docs: DataFrame, *names: str
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with columns called like `names` renamed, and what gives them their names back."""
    free = (f"own{i}" for i in itertools.count() if f"own{i}" not in map(str.lower, docs.columns))
    renamed = dict(zip(_clashing(docs, names), free, strict=False))
    back = {new: old for old, new in renamed.items()}
    return docs.withColumnsRenamed(renamed), lambda df: df.withColumnsRenamed(
        {c: back[c] for c in df.columns if c in back}
    )


def aside_private(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`aside` for all columns that begin with an underscore, as helper columns do."""
    return aside(docs, *[c for c in docs.columns if c.startswith("_")])


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Mark for broadcast what has been stored and counted to be small enough.

    Beyond the limit the join is left to shuffle; its result is the same.
    """
    stored = written(df, "side")
    return F.broadcast(stored) if stored.count() <= rows else stored
