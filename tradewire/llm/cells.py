"""Comparing all pairs within groups of any size: a group is dealt out as pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(rows: DataFrame, count: str, most: int) -> DataFrame:
    """Rows once for each pair of blocks (of at most about ``most`` rows) that has theirs; column ``cell``, and ``side`` is the row's own block."""
    parts = F.ceil(F.col(count) / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), "rep"), parts.cast("long")).cast("int")
    rows = rows.withColumns({"parts": parts, "side": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).drop("other", "parts")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key, "low", "high").sortWithinPartitions(key, "low", "high", "rep")


def cells(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one cell after another; rows come sorted by (key, low, high)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in (key, "low", "high")]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = tuple(c[a] for c in cols)
            if held and at != last:
                yield pa.Table.from_batches(held)
                held = []
            last = at
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def labels(near: np.ndarray) -> np.ndarray:
    """The least index of each row's component, given a symmetric matrix of links."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new
