"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Every tree is an array of long hash strings, the signs of random projections, in sorted order, beside the block that
holds the vector; the vectors themselves are kept once. A query descends each tree to its longest matching prefix and
then ascends in all trees at once, one bit at a time, until its prefixes cover enough candidates. Those prefixes are
ranges of the sorted arrays; the query goes once to every block that the ranges name, and there all rows under the
prefixes, or all rows if the prefixes cover most of them, are scored exactly on the original vectors. How many candidates are enough is measured: for a bounded sample
of queries the true neighbours are found over all rows, and the least number whose recall reaches the target is taken.

Equal vectors (by two 64-bit hashes) are one entry. An entry names its k + 1 least keys: they stand before the
entry's other keys in every ranking, so no answer can name another.

The arrays are cut into slices of neighbouring strings, and the asks of a slice or block into parts. Rows whose vector
is null, zero or holds a null or non-finite component take no part, nor do null keys; rows that repeat key and vector
are one. Fewer candidates than asked for: the trees' roots are reached, so all rows are scored. Only key and vector
are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm._rows import saved, small
from foliospark.llm._vectors import best, matrix, top, valid

TREES, BITS = 16, 32
#: Prefixes up to this depth are counted for all tasks, at most 2**(DEPTH + 1) counts a tree; deeper ones are counted in
#: the slices, for the queries that need them.
DEPTH = 14
#: Strings that one slice of a tree holds, rows that one block holds, queries that one part of its asks holds, and rows
#: of a block that are scored at a time.
SLICE, PIECE, PART, CHUNK = 1 << 17, 1 << 16, 2_048, 4_096
#: A query whose prefixes cover more of a block than this, as trees that do not depend on each other would, is scored on
#: all of its rows: to tell which ones costs more than it saves.
WIDE = 0.5
#: Queries whose true neighbours set the number of candidates, and the recall to reach among them.
SAMPLE, RECALL = 128, 0.94
SEED = 2024


def _planes(dims: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dims, trees * bits))


def codes(vectors: np.ndarray, planes: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """(rows x trees) hash strings as integers, the first bit the highest."""
    signs = (vectors @ planes > 0).reshape(len(vectors), trees, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, TREES)


def _entries(data: DataFrame, is_query: Column, dims: int, k: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors (vid, v, ids, asked, codes), and the queries (query, vid)."""
    hashed = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    rows = data.select("id", F.transform("v", lambda x: x + F.lit(0.0)).cast(kind).alias("v"))  # no -0.0
    rows = rows.select("id", "v", *hashed, F.coalesce(is_query, F.lit(False)).alias("asked"))
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    least = rows.select("id", "h1", "h2").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    least = least.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    found = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max("asked").alias("asked")).join(least, ["h1", "h2"])
    planes = _planes(dims)

    def run(batches):
        for batch in batches:
            c = codes(matrix(batch.column("v"), dims), planes)
            offsets = np.arange(0, c.size + 1, TREES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.ravel()))], [*batch.schema.names, "codes"])

    coded = found.mapInArrow(run, f"h1 long, h2 long, v {kind}, asked boolean, ids array<long>, codes array<long>")
    entries = saved(coded.withColumn("vid", F.monotonically_increasing_id()))
    queries = rows.where("asked").select(F.col("id").alias("query"), "h1", "h2").distinct()
    queries = queries.join(entries.where("asked").select("h1", "h2", "vid"), ["h1", "h2"]).select("query", "vid")
    return entries.drop("h1", "h2"), queries


def _cells(entries: DataFrame) -> np.ndarray:
    """(trees x prefixes) entries under every prefix of DEPTH bits."""
    cells = entries.select(F.posexplode("codes").alias("tree", "code")).groupBy("tree", F.shiftright("code", BITS - DEPTH).alias("prefix")).agg(F.count("*").alias("n"))
    out = np.zeros((TREES, 1 << DEPTH), np.int64)
    got = cells.toPandas()
    out[got["tree"].to_numpy(), got["prefix"].to_numpy()] = got["n"].to_numpy()
    return out


def _covered(counts, c: np.ndarray) -> np.ndarray:
    """(queries x levels) candidates, over all trees, of each counted level's prefixes."""
    return np.stack([sum(counts[level][t][c[:, t] >> (BITS - level)] for t in range(TREES)) for level in range(len(counts))], 1)


def _meet(asks: DataFrame, held: DataFrame, by: list[str], tile, schema: str, more: DataFrame | None = None) -> DataFrame:
    """``tile`` of all asks and all held rows with equal ``by``; the asks of a group in parts. ``more`` is joined to the
    asks by vid once they are counted."""
    asks = saved(asks)
    parts = small(saved(asks.groupBy(*by).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))))
    asks = asks.join(parts, by).withColumn("part", F.pmod(F.xxhash64("vid"), "parts").cast("int")).drop("parts")
    asks = asks if more is None else asks.join(more, "vid")
    held = held.join(parts, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return asks.groupBy(*by, "part").cogroup(held.groupBy(*by, "part")).applyInArrow(tile, schema)


class _Forest:
    """The sorted arrays over the entries, without their vectors: strings and blocks, in slices."""

    def __init__(self, entries: DataFrame):
        self.cells = _cells(entries)
        self.counts = [self.cells.reshape(TREES, 1 << level, -1).sum(2) for level in range(DEPTH + 1)]
        total = int(self.cells[0].sum())
        # Blocks follow the first tree's order: its prefixes, a large one in pieces.
        self.bits = min(DEPTH, max(0, (max(1, total) // PIECE).bit_length()))
        pieces = -(-self.counts[self.bits][0] // PIECE)
        ends = np.cumsum(pieces)
        # A slice is a run of neighbouring prefixes of one tree; a prefix beyond that is cut by block.
        rank = (np.cumsum(self.cells, 1) - self.cells) // SLICE
        self.slice = rank + np.arange(TREES)[:, None] * (int(rank.max()) + 1)
        self.cuts = np.maximum(1, -(-np.bincount(self.slice.ravel(), self.cells.ravel()).astype(np.int64) // (2 * SLICE)))
        spark = entries.sparkSession
        blocks = [(int(i), int(e - n), int(n)) for i, (e, n) in enumerate(zip(ends, pieces)) if n]
        blocks = F.broadcast(spark.createDataFrame(blocks, "cell int, first long, pieces long"))  # at most 2**DEPTH rows
        cell = F.shiftright(F.get("codes", F.lit(0)), BITS - self.bits).cast("int")
        self.entries = entries.withColumn("cell", cell).join(blocks, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vid"), "pieces")).drop("cell", "first", "pieces")
        self.shared = spark.sparkContext.broadcast((self.counts, self.slice, self.cuts))
        shared, depth = self.shared, DEPTH

        def deal(batches):
            _, slices, cuts = shared.value
            for batch in batches:
                c, block = _stack(batch.column("codes")), batch.column("block").to_numpy()
                for t in range(TREES):
                    at = slices[t][c[:, t] >> (BITS - depth)]
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((block % cuts[at]).astype(np.int32)), pa.array(c[:, t]), pa.array(block)], ["slice", "cut", "code", "block"])

        self.arrays = self.entries.select("codes", "block").mapInArrow(deal, "slice long, cut int, code long, block long")

    def _asks(self, queries: DataFrame) -> DataFrame:
        """Queries (vid, codes, level) to every slice that their prefixes meet."""
        shared, depth = self.shared, DEPTH

        def run(batches):
            _, slices, cuts = shared.value
            for batch in batches:
                c, level, vid = _stack(batch.column("codes")), batch.column("level").to_numpy().astype(np.int64), batch.column("vid").to_numpy()
                up = np.maximum(depth - level, 0)
                for t in range(TREES):
                    first = c[:, t] >> (BITS - depth) >> up << up
                    a, b = slices[t][first], slices[t][first + (1 << up) - 1]
                    for row in np.array_split(np.arange(len(vid)), max(1, len(vid) * int((b - a).max(initial=0) + 1) >> 20)):
                        n = (b - a + 1)[row]
                        of = np.repeat(row, n)
                        at = a[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                        each = cuts[at]
                        cut = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                        of, at = np.repeat(of, each), np.repeat(at, each)
                        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cut.astype(np.int32)), pa.array(vid[of]), pa.array(c[of, t]), pa.array(level[of].astype(np.int32))], ["slice", "cut", "vid", "code", "level"])

        return queries.select("vid", "codes", "level").mapInArrow(run, "slice long, cut int, vid long, code long, level int")

    def deep(self, queries: DataFrame) -> DataFrame:
        """(vid, n<level> for every level below DEPTH): descends the sorted arrays."""
        below = range(DEPTH + 1, BITS + 1)
        names = [f"n{level}" for level in below]

        def tile(a: pa.Table, b: pa.Table) -> pa.Table:
            code, held = a.column("code").to_numpy(), np.sort(b.column("code").to_numpy())
            n = []
            for level in below:
                first = code >> (BITS - level) << (BITS - level)
                n.append(np.searchsorted(held, first + (1 << (BITS - level))) - np.searchsorted(held, first))
            return pa.table({"vid": a.column("vid"), **{name: pa.array(x, pa.int64()) for name, x in zip(names, n)}})

        schema = "vid long, " + ", ".join(f"{name} long" for name in names)
        asks = self._asks(queries.withColumn("level", F.lit(DEPTH)))
        return _meet(asks, self.arrays, ["slice", "cut"], tile, schema).groupBy("vid").agg(*[F.sum(name).alias(name) for name in names])

    def levels(self, queries: DataFrame, enough: int) -> DataFrame:
        """Queries (vid, codes) with each one's level: the deepest whose prefixes cover enough."""
        shared = self.shared

        def run(batches):
            for batch in batches:
                c = _stack(batch.column("codes"))
                level = (_covered(shared.value[0], c) >= enough).sum(1).clip(1) - 1
                yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("codes"), pa.array(level.astype(np.int32))], ["vid", "codes", "level"])

        out = saved(queries.select("vid", "codes").mapInArrow(run, "vid long, codes array<long>, level int"))
        below = out.where(F.col("level") == DEPTH)
        if below.isEmpty():
            return out
        more = self.deep(below)
        more = more.select("vid", sum((F.col(name) >= enough).cast("int") for name in more.columns[1:]).alias("more"))
        return out.join(more, "vid", "left").select("vid", "codes", (F.col("level") + F.coalesce("more", F.lit(0))).cast("int").alias("level"))

    def blocks(self, queries: DataFrame) -> DataFrame:
        """(vid, block) of the blocks that hold a row under a prefix of the query's level."""

        def tile(a: pa.Table, b: pa.Table) -> pa.Table:
            held, block = b.column("code").to_numpy(), b.column("block").to_numpy()
            order = np.argsort(held, kind="stable")
            held, block = held[order], block[order]
            code, shift = a.column("code").to_numpy(), BITS - a.column("level").to_numpy().astype(np.int64)
            first = code >> shift << shift
            low, high = np.searchsorted(held, first), np.searchsorted(held, first + (1 << shift))
            # Queries with one range name the same blocks.
            ranges, of = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
            named = [np.unique(block[x:y]) for x, y in ranges]
            n = np.array([len(x) for x in named], np.int64)[of.ravel()]
            out = [named[i] for i in of.ravel()]
            return pa.table({"vid": pa.array(np.repeat(a.column("vid").to_numpy(), n), pa.int64()), "block": pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64())})

        return _meet(self._asks(queries), self.arrays, ["slice", "cut"], tile, "vid long, block long").distinct()


def _enough(forest: _Forest, queries: DataFrame, dims: int, k: int, recall: float) -> int:
    """The least number of candidates at which the sampled queries reach the recall."""
    sample = queries.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).collect()
    if not sample:
        return 1
    vids, c, own = np.array([r["vid"] for r in sample]), np.array([r["codes"] for r in sample]), [r["ids"][0] for r in sample]
    q = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        q[i, : len(r["v"])] = r["v"]
    shipped = forest.entries.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        for batch in batches:
            least = _least(batch.column("ids"))
            order = np.argsort(least, kind="stable")
            r, at, s = best((shipped.value @ matrix(batch.column("v"), dims).T)[:, order], np.arange(len(order)), k + 1)
            at = pa.array(order[at])
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(least[at]), pa.array(s), batch.column("codes").take(at), batch.column("ids").take(at)], ["query", "id", "score", "codes", "ids"])

    near = top(forest.entries.select("v", "codes", "ids").mapInArrow(run, "query long, id long, score double, codes array<long>, ids array<long>"), k + 1).collect()
    true = [(r["query"], np.array(r["codes"])) for r in _first(near, own, k)]
    if not true:
        return 1
    of = np.array([i for i, _ in true])
    apart = np.stack([x for _, x in true]) ^ c[of]
    depth = np.array([max(BITS - int(x).bit_length() for x in row) for row in apart])
    spark = queries.sparkSession
    more = {r["vid"]: r[1:] for r in forest.deep(spark.createDataFrame([(int(v), x.tolist()) for v, x in zip(vids, c)], "vid long, codes array<long>")).collect()}
    covered = np.concatenate([_covered(forest.counts, c), np.array([more[v] for v in vids.tolist()])], 1)
    low, high = 1, int(covered.max())
    while low < high:  # recall grows with the number
        mid = (low + high) // 2
        level = (covered >= mid).sum(1).clip(1) - 1
        low, high = (low, mid) if (depth >= level[of]).mean() >= recall else (mid + 1, high)
    return low


def _least(ids: pa.Array) -> np.ndarray:
    """The first of every list."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    offsets = ids.offsets.to_numpy()
    return ids.flatten().to_numpy()[offsets[:-1] - offsets[0]]


def _first(near, own: list, k: int):
    """The sample's k best rows, each as its entry's row, in order of score and key."""
    left = dict.fromkeys(range(len(own)), k)
    for _, i, r in sorted(((-r["score"], i, r) for r in near for i in r["ids"]), key=lambda x: x[:2]):
        if i != own[r["query"]] and left[r["query"]] > 0:
            left[r["query"]] -= 1
            yield r


def _share(asked: np.ndarray, held: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Of the held strings (rows x trees), the share that each asked string's prefixes would cover together."""
    left = np.ones(len(asked))
    for t in range(TREES):
        order = np.sort(held[:, t])
        low = asked[:, t] >> shift << shift
        left *= 1 - (np.searchsorted(order, low + (1 << shift)) - np.searchsorted(order, low)) / max(1, len(order))
    return 1 - left


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query, rank, id, score): for each row where ``is_query`` (of the column ``id``), the k best rows found."""
    data = valid(rows, key, vector, zeros=False, once=False)
    kind = rows.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    dims = max(1, data.agg(F.max(F.size("v"))).first()[0] or 0)
    entries, queries = _entries(data, is_query, dims, k, kind)
    forest = _Forest(entries)
    asked = entries.where("asked")
    levelled = forest.levels(asked, _enough(forest, asked, dims, k, recall))
    levelled = saved(levelled)
    chunk = CHUNK
    with_vectors = levelled.join(asked.select("vid", "v"), "vid")

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pa.array(np.argsort(_least(b.column("ids")), kind="stable"))).combine_chunks()
        q, m = matrix(a.column("v"), dims).astype(np.float64), matrix(b.column("row"), dims)
        qc, mc = _stack(a.column("codes").combine_chunks()), _stack(b.column("strings").combine_chunks())
        shift = BITS - a.column("level").to_numpy().astype(np.int64)
        wide = _share(qc, mc, shift) > WIDE
        none = np.zeros(0, np.int64)
        r, at, s = none, none, np.zeros(0)
        for first in range(0, len(m), chunk):
            last = first + chunk
            scored = m[first:last].astype(np.float64).T
            for some in (np.flatnonzero(wide), np.flatnonzero(~wide)):
                within = None
                if len(some) and not wide[some[0]]:
                    within = np.zeros((len(some), scored.shape[1]), bool)
                    for t in range(TREES):
                        within |= (qc[some, t] >> shift[some])[:, None] == mc[None, first:last, t] >> shift[some, None]
                    hit = within.any(1)
                    some, within = some[hit], within[hit]
                x, y, z = best(q[some] @ scored, np.arange(scored.shape[1]), k + 1, within)
                r, at, s = np.concatenate([r, some[x]]), np.concatenate([at, y + first]), np.concatenate([s, z])
            order = np.lexsort((at, -s, r))  # each query's k + 1 best so far
            r, at, s = r[order], at[order], s[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r) <= k
            r, at, s = r[kept], at[kept], s[kept]
        ids = b.column("ids").take(pa.array(at, pa.int64()))
        return pa.table({"query": pa.array(a.column("vid").to_numpy()[r], pa.int64()), "id": pa.array(_least(ids), pa.int64()), "score": pa.array(s, pa.float64()), "ids": ids})

    held = forest.entries.select("block", F.col("v").alias("row"), F.col("codes").alias("strings"), "ids")
    got = _meet(forest.blocks(levelled), held, ["block"], tile, "query long, id long, score double, ids array<long>", with_vectors)
    near = top(got, k + 1).select(F.col("query").alias("vid"), "score", F.explode("ids").alias("id"))
    near = top(near.withColumnRenamed("vid", "query"), k + 1).select(F.col("query").alias("vid"), "id", "score")
    each = queries.join(near, "vid").where(F.col("id") != F.col("query")).groupBy("query", "id").agg(F.max("score").alias("score"))
    return top(each, k).select("query", F.col("rank").cast("int").alias("rank"), "id", "score")
