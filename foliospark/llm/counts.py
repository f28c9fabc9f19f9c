"""Unigram token counts by dynamic programming shared over a trie.

A text's words, each with a word mark in front, are cut into the pieces of a vocabulary so that the sum of the pieces'
scores is greatest, and of equal sums the one with fewer tokens; a character that no piece covers stands as its UTF-8
bytes. The best score of a prefix does not depend on what follows, so distinct words, in order, form a trie: each
task walks its range of words depth first and computes the forward score of a shared prefix once, keeping the count
where a word ends. The most frequent words' counts, a bounded table, are told to the tasks that read the texts; the
rarer words of each row are joined with theirs.

Null or blank text has no tokens. Null keys take part. Repeated keys and rows are separate entries. An empty table
gives no rows. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import _words as W
from foliospark.llm._rows import most_frequent, saved, stored

#: So many words of a task are counted together, and so many of the most frequent words reach all tasks (16 MB).
COUNTED, FREQUENT = 1 << 22, 1 << 20
MARK = "▁"
#: A score counts this much for each unit, which leaves room below it for the number of tokens: a text has under 2**31
#: bytes, and no token is shorter than one.
_SCALE = 1 << 32


def load_scores(path: str) -> dict[str, int]:
    """piece -> score of a piece model: its pieces are listed by falling frequency, and a piece at place i is taken
    to be as likely as Zipf's law has it, 1 / (i + 2.7). Scores are whole, in 2**32ths less one a token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: score(i) for i, p in enumerate(pieces)}


def score(place: int) -> int:
    return -round(1000 * math.log(place + 2.7)) * _SCALE - 1


class Walk:
    """The forward pass over words in order; consecutive words share the scores of their common prefix."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0) // _SCALE * _SCALE - 1
        self.word, self.best = "", [0]
        self.computed = 0

    def tokens(self, word: str) -> int:
        """The number of tokens of a word with its mark."""
        old, best, scores, longest = self.word, self.best, self.scores, self.longest
        shared, most = 0, min(len(old), len(word))
        while shared < most and old[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :]
        for i in range(shared + 1, len(word) + 1):
            found = best[i - 1] + self.byte * len(word[i - 1].encode("utf-8", "replace"))
            for j in range(max(0, i - longest), i):
                s = scores.get(word[j:i])
                if s is not None and best[j] + s > found:
                    found = best[j] + s
            best.append(found)
        self.computed += len(word) - shared
        self.word = word
        return -best[-1] % _SCALE


def distinct_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of all words."""

    def count(batches):
        known: dict[str, list] = {"h": [], "w": [], "n": []}
        size = 0

        def told():
            h, first = np.unique(np.concatenate(known["h"]), return_index=True)
            n = np.zeros(len(h), np.int64)
            np.add.at(n, np.searchsorted(h, np.concatenate(known["h"])), np.concatenate(known["n"]))
            words = pa.chunked_array(known["w"]).take(pa.array(first)).combine_chunks()
            return pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])

        for batch in batches:
            for _, _, data, offs in W.slices(batch.column(0)):
                starts, ends, _ = W.spans(data, offs)
                if not len(starts):
                    continue
                h, first, n = np.unique(W.hashes(data, starts, ends, W._BYTE), return_index=True, return_counts=True)
                a, b = starts[first], ends[first]
                bounds = np.concatenate([[0], np.cumsum(b - a)])
                at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], b - a) + np.repeat(a, b - a)
                words = pa.Array.from_buffers(pa.string(), len(a), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[at])])
                known["h"].append(h)
                known["w"].append(words)
                known["n"].append(n)
                size += len(h)
                if size >= COUNTED:
                    yield told()
                    known, size = {"h": [], "w": [], "n": []}, 0
        if size:
            yield told()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_tokens(words: DataFrame, scores: dict[str, int]) -> DataFrame:
    """(h, n, tokens) of distinct words, walked in ranges of their order; h is a word's 64-bit hash."""
    shipped = words.sparkSession.sparkContext.broadcast(scores)

    def walk(batches):
        state = Walk(shipped.value)
        for batch in batches:
            words = batch.column("word")
            h = [W.hashes(data, offs[:-1], offs[1:], W._BYTE) for _, _, data, offs in W.slices(words)]
            tokens = [state.tokens(MARK + w) for w in words.to_pylist()]
            hashes = np.concatenate(h).view(np.int64) if h else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column("n"), pa.array(tokens, pa.int64())], ["h", "n", "tokens"])

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(walk, "h long, n long, tokens long")


def count_tokens(docs: DataFrame, scores: dict[str, int], key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per row: key, n_words, n_tokens."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = stored(word_tokens(distinct_words(docs, "text"), scores))
    top = most_frequent(known, "n", frequent).select("h", "tokens").toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    shipped = docs.sparkSession.sparkContext.broadcast((h[order], top.column("tokens").to_numpy()[order]))

    def read(batches):
        hot, worth = shipped.value
        for batch in batches:
            words, sums, rare, counts, sizes = [], [], [], [], []
            for _, _, data, offs in W.slices(batch.column("text")):
                starts, ends, bounds = W.spans(data, offs)
                found = W.hashes(data, starts, ends, W._BYTE)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(hot, found), max(len(hot) - 1, 0))
                hit = hot[at] == found if len(hot) else np.zeros(len(found), bool)
                sums.append(np.bincount(row[hit], worth[at[hit]], len(n)).astype(np.int64) if len(found) else np.zeros(len(n), np.int64))
                words.append(n)
                lost, lost_row = found[~hit], row[~hit]
                order = np.lexsort((lost, lost_row))
                lost, lost_row = lost[order], lost_row[order]
                new = np.concatenate([[True], (lost[1:] != lost[:-1]) | (lost_row[1:] != lost_row[:-1])]) if len(lost) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                rare.append(lost[first])
                counts.append(np.diff(np.concatenate([first, [len(lost)]])).astype(np.int64) if len(lost) else np.zeros(0, np.int64))
                sizes.append(np.bincount(lost_row[first], minlength=len(n)))
            if not words:
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array(np.concatenate(words)), pa.array(np.concatenate(sums)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rare).view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts))),
                ],
                ["key", "n_words", "known", "rare", "times"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    rows = docs.mapInArrow(read, f"key {kind}, n_words long, known long, rare array<long>, times array<long>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    rest = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    rest = rest.join(known.select("h", "tokens"), "h").groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("more"))
    return rows.select("row", "key", "n_words", "known").join(rest, "row", "left").select(
        F.col("key").alias(key), "n_words", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    )
