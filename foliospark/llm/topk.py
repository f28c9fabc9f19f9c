"""Exact top-k inner products by block-at-a-time pruning.

Rows in ranges of ids form blocks; a block keeps its forward index, the vectors themselves, and the largest and the
smallest value of every component, the term. For a query, a block's bound is the sum over terms of the most that the
query's weight times such a value can be. Each query takes its blocks in the order of their bounds, in waves of
growing length, and after each wave only the blocks whose bound reaches its k-th best score stay.

A bound equal to the k-th score is opened only if the block begins with an id below the k-th row's, as ties go to the
smaller id. With ``scale`` all sums are whole and exact up to 2**53; scores beyond that have double precision, and those
that a long cannot hold are its least or greatest value. Rows whose vector is null or holds a
null or non-finite component take no part, nor do null keys; rows that repeat key and vector are one. Fewer than k
candidates: all of them. Only key and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm._rows import saved
from foliospark.llm._vectors import best, matrix, top, valid

#: Rows of a block's forward index that one array holds, and the number of blocks at most, whose term maxima are
#: 2 * dimensions * 8 bytes each and are sent to every task.
CHUNK, BLOCKS = 4_096, 4_096
#: Queries of a block come in parts of about so many.
PART = 2_048
#: Queries whose bounds a task holds at once, with all blocks: 16 MB an array.
TURN = 512
#: Up to which place in its order of blocks a query gets in each wave; the last wave takes the rest.
WAVES = (1, 8, None)


def _blocks(rows: DataFrame, dims: int, total: int) -> DataFrame:
    """(block, first id, ids, values, most, least) in pieces of at most CHUNK rows; a block is a range of ids."""
    blocks = max(1, min(BLOCKS, -(-total // CHUNK)))
    ranged = rows.repartitionByRange(blocks, "id").withColumn("block", F.spark_partition_id())

    def build(batches):
        for batch in batches:
            ids, block = batch.column("id").to_numpy(), batch.column("block").to_numpy()
            m = matrix(batch.column("v"), dims)
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                for i in range(0, len(at), CHUNK):
                    part = at[i : i + CHUNK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(b)], pa.int32()), pa.array([ids[part].min()]), pa.array([ids[part].astype("<i8").tobytes()]), pa.array([m[part].astype("<f8").tobytes()]), pa.array([m[part].max(0)]), pa.array([m[part].min(0)])],
                        ["block", "first", "ids", "values", "most", "least"],
                    )

    return ranged.mapInArrow(build, "block int, first long, ids binary, values binary, most array<double>, least array<double>")


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float | None = None) -> DataFrame:
    """(query, rank, id, score): for each row where ``is_query`` (of the column ``id``), the k rows of the greatest
    inner product, itself left out. With ``scale``, components become floor(scale * x) first and scores are whole."""
    data = valid(rows, key, vector, zeros=True)
    if scale is not None:
        data = data.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    data = saved(data)
    total, dims = data.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(1, dims or 0)
    index = saved(_blocks(data, dims, total))
    terms = index.groupBy("block").agg(F.min("first").alias("first"), *(F.array(*(f(F.col(c)[i]) for i in range(dims))).alias(c) for c, f in (("most", F.max), ("least", F.min)))).orderBy("block").collect()
    names, firsts = np.array([r["block"] for r in terms], np.int32), np.array([r["first"] for r in terms], np.int64)
    most, least = (np.array([r[c] for r in terms]).reshape(len(terms), dims) for c in ("most", "least"))
    shipped = rows.sparkSession.sparkContext.broadcast((names, firsts, most, least))

    queries = data.where(is_query)
    kept, seen = None, 0
    for upto in WAVES:
        upto = len(names) if upto is None else min(upto, len(names))
        if upto <= seen and kept is not None:
            continue
        if kept is None:
            waiting = queries.withColumns({"kth": F.lit(None).cast("double"), "kth_id": F.lit(None).cast("bigint")})
        else:
            floor = kept.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("kth"), F.col("id").alias("kth_id"))
            waiting = queries.join(floor, "id", "left")
        asks = saved(_asks(waiting, shipped, dims, seen, upto, 0 if scale is not None else 1e-12))
        new = _score(asks, index, dims, k)
        kept = saved(top(new if kept is None else kept.select("query", "id", "score").unionByName(new), k))
        seen = upto
    low, high = -(1 << 63), (1 << 63) - 1
    whole = F.when(F.col("score") >= float(high), F.lit(high)).when(F.col("score") <= float(low), F.lit(low)).otherwise(F.expr("try_cast(score AS bigint)"))
    score = whole if scale is not None else F.col("score")
    return kept.select("query", F.col("rank").cast("int").alias("rank"), "id", score.alias("score"))


def _asks(queries: DataFrame, shipped, dims: int, seen: int, upto: int, slack: float) -> DataFrame:
    """(block, query, v) of every query and each block at its places seen to upto that may have a row before its kth."""

    def run(batches):
        names, firsts, most, least = shipped.value
        for batch in (whole.slice(i, TURN) for whole in batches for i in range(0, whole.num_rows, TURN)):
            q = matrix(batch.column("v"), dims)
            kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
            bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
            bound += np.abs(bound) * slack
            order = np.argsort(-bound, 1, kind="stable")[:, seen:upto]
            kth, last = np.where(np.isnan(kth), -np.inf, kth)[:, None], batch.column("kth_id").fill_null(0).to_numpy()[:, None]
            at = np.take_along_axis(bound, order, 1)
            reach = (at > kth) | ((at == kth) & ((firsts[order] < last) | np.isinf(kth)))
            row, place = np.nonzero(reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[order[row, place]], pa.int32()), batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row))], ["block", "query", "v"]
            )

    return queries.select("id", "v", "kth", "kth_id").mapInArrow(run, "block int, query long, v array<double>")


def _score(asks: DataFrame, index: DataFrame, dims: int, k: int) -> DataFrame:
    """(query, id, score): the k best of each asked block. A block with many queries gets them in parts."""
    parts = asks.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    left = asks.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("query"), "parts").cast("int")).drop("parts")
    many = F.broadcast(parts.select(F.col("block").alias("of"), F.col("parts").alias("many")))
    right = index.join(many, F.col("block") == F.col("of")).select("block", "ids", "values", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("part"))

    def tile(ask: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        if len(ask) and len(block):
            q, names = matrix(ask.column("v"), dims), ask.column("query").to_numpy()
            for ids, values in zip(block.column("ids"), block.column("values"), strict=True):
                i = np.frombuffer(ids.as_py(), "<i8")
                s = q @ np.frombuffer(values.as_py(), "<f8").reshape(-1, dims).T
                r, found, score = best(s, i, k, names[:, None] != i[None, :])
                out.append((names[r], found, score))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(tile, "query long, id long, score double")
