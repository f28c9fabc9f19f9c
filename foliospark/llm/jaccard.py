"""Exact n-gram Jaccard join with a token-group matrix.

A document is the set of its distinct k-word shingles. Documents with equal sets are one class. Classes that share
their least shared token form a group, cut into blocks of bounded size; the token-group matrix holds, for every
token of the prefixes, which blocks have it and the sizes of their sets. A query's overlap with a block's token
union bounds its overlap with every member, so only blocks that reach the bound are opened, and there all pairs are
counted by matrix products. Each opened block returns a spanning forest of its links, and the links' connected
components are the result.

Order of work. Each block is opened for its own members first, and its links are contracted. One member of each
component with links in a group of several blocks then stands for it in a smaller matrix of its own, which joins the
blocks of a large group of near copies. Only classes that are still in different components are then held against each other's blocks, the one
in the smaller component asking. So a group of copies is never paired with all blocks of its own.

The bound. Tokens have one global order, common ones last. If two sets of n and m tokens have a Jaccard similarity
of at least t, they share at least o = ceil(t * max(n, m)) tokens, and then the first n - ceil(t n) + l and
m - ceil(t m) + l tokens in that order share at least l. So a query sees a block's member unless the counted overlap
is under l, which here is one and a fiftieth of the smaller size that can still match.

Sets go by 64-bit hashes of 64-bit token hashes. Null or blank text: size 0, linked with nothing, its own component. Null keys take part; a component is named by its
least non-null key. Repeated keys and rows are separate entries. An empty table gives no rows. Only key and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm import _words as W
from foliospark.llm._graph import components
from foliospark.llm._rows import fresh, saved, text_batches

#: Bytes of text that are shingled at once; the passes hold some forty times as much.
SLICE = 1 << 18
#: Shingles found twice within so many of a task's are counted as possibly common.
COUNTED = 1 << 21
#: From this count on a shingle is common; so many at most, the most frequent first, reach the tasks (2 MB).
COMMON, COMMON_MOST = 32, 1 << 17
#: A block of a group has about so many documents and shingles at most, and its queries come in parts of that many.
BLOCK_DOCUMENTS, BLOCK_TOKENS = 512, 1 << 19
PART_DOCUMENTS, PART_TOKENS = 2_048, 1 << 20
#: Bits of the map of classes that must be opened (16 MB); when it fills, more is read and nothing is lost.
MAP_BITS = 27


def _sets(texts: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of every text."""
    for first, _, data, offs in W.slices(texts, SLICE):
        starts, ends, bounds = W.spans(data, offs)
        found, at = W.shingles(W.hashes(data, starts, ends), bounds, k)
        for i in range(len(at) - 1):
            yield first + i, np.unique(found[at[i] : at[i + 1]])


def _key(tokens: np.ndarray) -> int:
    """64 bits that name a set, from two sums over its hashes."""
    one = W.mix(tokens + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64, keepdims=True)
    two = np.bitwise_xor.reduce(W.mix(tokens ^ np.uint64(0xC2B2AE3D27D4EB4F)), keepdims=True)
    return int(W.mix(one ^ W.mix(two + np.uint64(len(tokens)))).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + 1 + n // 50)


def _common(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and the rank of each, the most frequent last. Counts miss shingles that are rare
    everywhere, which changes the order's speed and not the result."""

    def count(batches):
        held, size = [], 0

        def told():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            twice = n > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[twice].view(np.int64)), pa.array(n[twice])], ["token", "n"])

        for batch in batches:
            for _, s in _sets(batch.column(0), k):
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    seen = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = seen.orderBy(F.desc("n"), "token").limit(COMMON_MOST).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    rank = np.arange(len(rows))[::-1]
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, th, n, cid, prefix) of each row; cid names the set."""
    common, rank = _common(docs, k)

    def run(batches):
        for batch in batches:
            sizes, cids, prefixes = [], [], []
            for _, s in _sets(batch.column("text"), k):
                p = prefix_length(len(s), percent)
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    hot = common[at] == s
                    rare = s[~hot]
                    head = rare[:p] if len(rare) >= p else np.concatenate([rare, s[hot][np.argsort(rank[at[hot]])][: p - len(rare)]])
                else:
                    head = s[:p]
                sizes.append(len(s))
                cids.append(_key(s))
                prefixes.append(head)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            values = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["key", "th", "n", "cid", "prefix"],
            )

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, th long, n long, cid long, prefix array<long>")


def links_in(members: list[np.ndarray], queries: list[np.ndarray], percent: int, tile: int = 4096) -> np.ndarray:
    """Boolean matrix (members x queries) of exact links, by products of their membership matrices."""
    nm, nq = np.array([len(s) for s in members]), np.array([len(s) for s in queries])
    tokens, at = np.unique(np.concatenate([*members, *queries]), return_inverse=True)
    row = np.repeat(np.arange(len(members) + len(queries)), np.concatenate([nm, nq]))
    used = np.bincount(at, minlength=len(tokens)) > 1
    column = np.cumsum(used) - 1
    keep = used[at]
    row, col = row[keep], column[at[keep]]
    both = np.zeros((len(members), len(queries)), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for low in range(0, int(used.sum()), tile):
        a, b = np.searchsorted(col, [low, low + tile])
        m = np.zeros((len(members) + len(queries), min(tile, int(used.sum()) - low)), np.float32)
        m[row[a:b], col[a:b] - low] = 1
        both += m[: len(members)] @ m[len(members) :].T
    shared = np.rint(both).astype(np.int64)
    return (100 * shared >= percent * (nm[:, None] + nq[None, :] - shared)) & (nm[:, None] > 0) & (nq[None, :] > 0)


def _forest(linked: np.ndarray, members: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every linked node."""
    ids, inverse = np.unique(np.concatenate([members, queries]), return_inverse=True)
    label = np.arange(len(ids))
    mi, qi = inverse[: len(members)], inverse[len(members) :]
    i, j = np.nonzero(linked)
    i, j = mi[i], qi[j]
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: key, n_shingles, component_id and text_hash, xxhash64 of the text. Two rows link when
    100 * intersection >= percent * union."""
    with text_batches(docs.sparkSession):
        return _components_of(docs, key, text, k, percent)


def _components_of(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    rows = saved(_prefixes(docs, k, percent))
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("key").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))

    # tokens of prefixes that at least two classes have
    postings = classes.select("cid", "n", F.explode("prefix").alias("token"))
    often = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    grouped = saved(postings.join(often, "token"))

    # first the pairs inside each block, then components of groups cut into blocks by one member each, then what is left
    placed = _placed(grouped)
    many = placed.groupBy("block").agg(F.count("*").alias("members")).where("members > 1").select("block")
    found = components(_links(placed.join(many, "block").select(F.col("cid").alias("query"), "block", F.col("n").alias("size")), placed, docs, k, percent))
    roots = found.where("node = root").select(F.col("node").alias("cid")).join(placed.where("cut").select("cid"), "cid")
    heads = saved(grouped.join(roots, "cid"))
    placed_heads = _placed(heads)
    found = _joined(found, _links(_opened(heads, _ranked(placed_heads, None), percent), placed_heads, docs, k, percent))
    asks = _opened(grouped, _ranked(placed, found), percent).join(placed.select(F.col("cid").alias("query"), F.col("block").alias("home")), "query").where("block != home").drop("home")
    found = _joined(found, _links(asks, placed, docs, k, percent))

    least = found.join(classes.select(F.col("cid").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("joined"))
    named = found.join(least, "root").select("node", "joined")
    alone = classes.select("cid", "least").join(named, F.col("cid") == F.col("node"), "left").select(F.col("cid").alias("of"), F.coalesce("joined", "least").alias("component"))
    return rows.join(alone, (F.col("cid") == F.col("of")) & (F.col("n") > 0), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"), F.col("th").alias("text_hash")
    )


def _placed(grouped: DataFrame) -> DataFrame:
    """(cid, n, block, cut) of each class of (token, cid, n): its group is its least token, cut into blocks if it is large."""
    member = grouped.groupBy("cid").agg(F.min("token").alias("gkey"), F.first("n").alias("n"))
    blocks = member.groupBy("gkey").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCUMENTS, F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    block = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks"))
    return saved(member.join(blocks, "gkey").select("cid", "n", F.xxhash64("gkey", block).alias("block"), (F.col("blocks") > 1).alias("cut")))


def _ranked(placed: DataFrame, found: DataFrame | None) -> DataFrame:
    """(cid, block, rank): a larger component has a higher rank, and classes of one component have the same."""
    low = lambda root: F.xxhash64(root, F.lit(3)).bitwiseAND(F.lit((1 << 56) - 1))
    if found is None:
        return placed.select("cid", "block", low("cid").alias("rank"))
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    rank = F.shiftleft(F.floor(F.log2("size")).cast("bigint"), 56).bitwiseOR(low("root"))
    named = found.join(sizes, "root").select(F.col("node").alias("cid"), rank.alias("rank"))
    return placed.select("cid", "block").join(named, "cid", "left").withColumn("rank", F.coalesce("rank", low("cid")))


def _opened(grouped: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """(query, block, size): the blocks each class must open. The token-group matrix holds, for every token, the blocks
    that have it and the sizes and ranks of their sets there. Of two components the one of lower rank asks, so a large
    component is never held against itself, nor asks every small one."""
    cells = grouped.join(ranked, "cid")
    mixed = cells.groupBy("token").agg(F.max("rank").alias("top"), F.min("rank").alias("low")).where("top != low").select("token", "top")
    cells = saved(cells.join(mixed, "token"))
    matrix = cells.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rank").alias("best"))
    hits = cells.where("rank < top").select("token", F.col("cid").alias("query"), F.col("n").alias("size"), "rank").join(matrix, "token")
    hits = hits.where((F.col("best") > F.col("rank")) & (F.col("low") * percent <= F.col("size") * 100) & (F.col("size") * percent <= F.col("high") * 100))
    need = F.floor(F.col("size") * percent / 5000) + 1
    return hits.groupBy("query", "block").agg(F.count("*").alias("overlap"), F.first("size").alias("size")).where(F.col("overlap") >= need).select("query", "block", "size")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components with more links."""
    return found if links.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def _links(asks: DataFrame, placed: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the exact links between each query and the members of the block it opens."""
    asks = saved(asks)
    if asks.isEmpty():
        return asks.select(F.col("query").alias("a"), F.col("block").alias("b"))
    # queries of a block come in parts; its members go to every part
    parts = asks.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / PART_DOCUMENTS, F.sum("size") / PART_TOKENS)).cast("int").alias("parts"))
    queries = asks.join(parts, "block").select(F.col("query").alias("cid"), "block", F.pmod(F.xxhash64("query", F.lit(2)), "parts").cast("int").alias("part"), F.lit(True).alias("asks"), F.lit(False).alias("is_member"))
    holds = placed.join(parts, "block").select("cid", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), F.lit(True).alias("is_member"))
    roles = saved(queries.unionByName(holds).groupBy("cid", "block", "part").agg(F.max("asks").alias("asks"), F.max("is_member").alias("is_member")))

    opened = _tokens(docs, roles, k).join(roles, "cid")

    def verify(group: pa.Table) -> pa.Table:
        ids = group.column("cid").to_numpy()
        tokens = group.column("tokens").combine_chunks()
        values, offs = tokens.values.to_numpy(), tokens.offsets.to_numpy()
        sets = [values[offs[i] : offs[i + 1]] for i in range(len(ids))]
        m = np.flatnonzero(group.column("is_member").to_numpy(zero_copy_only=False))
        q = np.flatnonzero(group.column("asks").to_numpy(zero_copy_only=False))
        if not len(m) or not len(q):
            a = b = np.zeros(0, np.int64)
        else:
            a, b = _forest(links_in([sets[i] for i in m], [sets[i] for i in q], percent), ids[m], ids[q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return saved(opened.groupBy("block", "part").applyInArrow(verify, "a long, b long"))


def _tokens(docs: DataFrame, roles: DataFrame, k: int) -> DataFrame:
    """(cid, tokens) of each class in ``roles``, once, found again from the texts by way of a bounded bit map. Copies go
    within tasks, and then where a class's rows meet, before anything is joined."""
    bit = F.pmod("cid", F.lit(1 << MAP_BITS))
    packed = roles.select(F.floor(bit / 32768).alias("bucket"), F.pmod(bit, F.lit(32768)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in packed.collect():
        bits[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    def told(cids: list, sets: list) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["cid", "tokens"])

    def run(batches):
        wanted, seen = shipped.value, set()
        for batch in batches:
            cids, sets, size = [], [], 0
            for _, s in _sets(batch.column(0), k):
                if len(s):
                    cid = _key(s)
                    at = cid % (1 << MAP_BITS)
                    if wanted[at >> 3] >> (at & 7) & 1 and cid not in seen:
                        seen.add(cid)
                        cids.append(cid)
                        sets.append(s)
                        size += len(s)
                        if size >= COUNTED // 4:
                            yield told(cids, sets)
                            cids, sets, size = [], [], 0
            if cids:
                yield told(cids, sets)

    told_once = docs.select("text").mapInArrow(run, "cid long, tokens array<long>")
    # the join with roles needs this exchange and order as well; an aggregate would sort the sets twice
    earlier = F.lag("cid").over(Window.partitionBy("cid").orderBy("cid"))
    return told_once.withColumn("earlier", earlier).where("earlier is null").drop("earlier")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the text with the least key stays, once. Rows
    without a key stay, once a text, unless a row with a key is in their component."""
    found = components_of(docs, key, text, k, percent)
    a, b, same = fresh(docs, "_stay"), fresh(docs, "_stay_text"), fresh(docs, "_text")
    stay = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(a), F.col("text_hash").alias(b)).distinct()
    kept = docs.withColumn(same, F.xxhash64(text)).join(stay, F.col(key).eqNullSafe(F.col(a)) & (F.col(same) == F.col(b)), "left_semi")
    return kept.dropDuplicates([key, same]).drop(same)
