"""Vector rows as matrices, and the best scores of a tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(rows: DataFrame, key: str, vector: str, zeros: bool, once: bool = True) -> DataFrame:
    """(id long, v array<double>) of the rows that take part: key and vector not null, every component finite and not
    null, and unless ``zeros`` some component not 0. With ``once``, rows that repeat key and vector are one. An empty
    vector is zero; where lengths differ, missing components count as 0."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    out = out.where(F.col("id").isNotNull() & v.isNotNull() & good)
    if not zeros:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out.distinct() if once else out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """List column to (rows x dims), shorter rows filled with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None):
    """(row, id, score) of the k best of every row, ties to the smaller id; ``allowed`` masks pairs out."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    ok = None if allowed is None else allowed[:, order]
    rows, found, values = [], [], []
    for i in range(len(scores)):
        s = scores[i]
        at = np.arange(len(s)) if ok is None else np.flatnonzero(ok[i])
        if len(at) > k:
            t = s[at]
            kth = np.partition(t, len(t) - k)[len(t) - k]
            over, tied = at[t > kth], at[t == kth]
            at = np.concatenate([over, tied[: k - len(over)]])
        rows.append(np.full(len(at), i))
        found.append(ids[at])
        values.append(s[at])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(found), np.concatenate(values)) if rows else (none, none, np.zeros(0))


def top(pairs: DataFrame, k: int) -> DataFrame:
    """(query, id, score) to each query's k best with their rank, ties to the smaller id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
