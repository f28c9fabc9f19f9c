"""Language identification by rank-order profiles.

A language's profile is the order of its most frequent letter n-grams (one to three letters, word ends as a
mark). A document's own order is compared with each profile by out-of-place distance: the sum over the
document's most frequent n-grams of how far the ranks lie apart, an n-gram that a profile lacks counting the
profile's length.

Learned are all languages with a text, from distinct texts; more than a thousand are an error. Null text or text without a letter: 'und', score 0. Ties go to the language that sorts first. Nothing to learn
from: 'und' for all. Rows are never dropped or merged; other columns pass through whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm._rows import fresh

#: n-grams in a profile, and of a document.
PROFILE, OWN = 400, 300
#: More languages are an error.
LANGUAGES = 1_000
UNKNOWN = "und"
#: Floors come from all learning documents, each cut to 4, 8, 16 ... characters. A floor needs so many pieces of one length
#: class. Their scores are counted in steps of one part of ``STEPS``, so that a class has a bounded number of counts.
FLOOR_PIECES, LONGEST_PIECE, STEPS = 50, 1 << 12, 1 << 16
#: Floors are this quantile of the pieces' scores and margins. Texts from elsewhere than the learning documents, though of
#: the same language, score less than those: a text under its floor passes with these shares of the two floors.
FLOOR_QUANTILE, SCORE_SHARE, MARGIN_SHARE = 0.005, 0.5, 0.25
#: Texts with this length class or less tell too little for a margin.
SHORT = 5
#: The floor where too few pieces tell a better one.
LEAST_FLOOR = 0.1
#: Stands for a word's end; no code point is so large.
_END = 0x1FFFFF

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        table = np.zeros(sys.maxunicode + 1, bool)
        table[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = True
        _letter.append(table)
    return _letter[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as integers, up to three code points of 21 bits each, ``_END`` for the end of a word."""
    codes = np.frombuffer(unicodedata.normalize("NFC", text).lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes = np.concatenate([[_END], np.where(_letters()[codes], codes, _END), [_END]])
    letter = codes != _END
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = codes[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != _END], two, three[c[1:-1] != _END]])


def ranked(text: str, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by value."""
    found, counts = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:top]]


def _sample(rows: DataFrame, text: str, lang: str, documents: int | None = None) -> DataFrame:
    """(text, lang) of all distinct texts of each language, or of about so many at most if a caller asks for fewer."""
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if documents is not None:
        h = F.xxhash64("text")
        found = rows.select("lang", h.alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()
        if found:
            share = F.create_map(*(F.lit(x) for r in found for x in (r["lang"], min(1.0, documents / r["n"]))))
            rows = rows.where(F.pmod(h, F.lit(1 << 40)) < F.try_element_at(share, F.col("lang")) * (1 << 40))
    return rows.dropDuplicates(["lang", "text"])


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", documents: int | None = None, size: int = PROFILE) -> dict[str, np.ndarray]:
    """language -> its n-grams by rank, from all rows whose text and language are not null, a text once; from about
    ``documents`` texts a language if a caller sets that bound."""
    chosen = _sample(rows, text, lang, documents)

    def count(batches):
        for batch in batches:
            for k, group in batch.groupby("lang"):
                parts = [np.unique(grams(t), return_counts=True) for t in group["text"]]
                all_grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(at, np.concatenate([p[1] for p in parts]), len(all_grams)).astype(np.int64) if len(all_grams) else np.zeros(0, np.int64)
                yield pd.DataFrame({"lang": k, "gram": all_grams, "n": total})

    totals = chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    profiles: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


class _Profiles:
    """All profiles as one sorted table: n-gram -> rank in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names = sorted(profiles)
        self.size = size
        self.known = np.unique(np.concatenate([profiles[n] for n in self.names]))
        self.ranks = np.full((len(self.known), len(self.names)), -(10**9), np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.known, profiles[name]), j] = np.arange(len(profiles[name]))

    def nearest(self, text: str, own: int) -> tuple[str, float, float]:
        """(language, score, margin). Score: 1 less the distance as a share of the largest possible."""
        mine = ranked(text, own)
        if not len(mine):
            return UNKNOWN, 0.0, 0.0
        at = np.minimum(np.searchsorted(self.known, mine), len(self.known) - 1)
        hit = self.known[at] == mine
        apart = np.minimum(np.abs(self.ranks[at[hit]] - np.flatnonzero(hit)[:, None]), self.size)
        distance = (apart.sum(0) + (len(mine) - int(hit.sum())) * self.size) / (len(mine) * self.size)
        best = int(np.argmin(distance))
        rest = np.delete(distance, best)
        return self.names[best], float(1 - distance[best]), float(rest.min() - distance[best]) if len(rest) else 1.0


def length_class(text: str) -> int:
    """Bits of the number of letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return int(_letters()[codes].sum()).bit_length()


def floors(rows: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", lang: str = "lang", own: int = OWN, size: int = PROFILE) -> dict[str, list[tuple[float, float]]]:
    """language -> (score, margin) floors of each length class, longer texts' at the end. Pieces of learning
    documents stand for texts of every length; a class with few pieces takes the floors of the class below, and the
    classes before the first with enough ``LEAST_FLOOR`` alone."""
    if not profiles:
        return {}
    chosen = _sample(rows, text, lang)
    table = _Profiles(profiles, size)

    def score(batches):
        for batch in batches:
            out = []
            for name, t in zip(batch["lang"], batch["text"], strict=True):
                n = 4
                while n <= LONGEST_PIECE and n < 2 * len(t):
                    piece = t[:n]
                    if (c := length_class(piece)) > 0:
                        out.append((name, c, *table.nearest(piece, own)[1:]))
                    n *= 2
            pieces = pd.DataFrame(out, columns=["lang", "class", "score", "margin"]).melt(["lang", "class"], var_name="of", value_name="value")
            pieces["value"] = np.floor(pieces["value"].astype(float) * STEPS).astype(np.int64)
            yield pieces.value_counts().rename("n").reset_index()

    counted = chosen.mapInPandas(score, "lang string, class int, of string, value long, n long").groupBy("lang", "class", "of", "value").agg(F.sum("n").alias("n"))
    low = (F.expr(f"percentile(value, {FLOOR_QUANTILE}, n) filter (where of = '{c}') / {STEPS}").alias(c) for c in ("score", "margin"))
    found = counted.groupBy("lang", "class").agg(F.sum(F.when(F.col("of") == "score", F.col("n"))).alias("pieces"), *low).where(F.col("pieces") >= FLOOR_PIECES).collect()
    told = {(r["lang"], r["class"]): (r["score"], r["margin"]) for r in found}
    out = {}
    for name in profiles:
        out[name] = [(LEAST_FLOOR, 0.0)]
        for c in range(1, LONGEST_PIECE.bit_length() + 1):
            out[name].append(told.get((name, c), out[name][-1]))
    return out


def resembles(profiles: dict[str, np.ndarray], least: dict[str, list[tuple[float, float]]], text: Column, own: int = OWN, size: int = PROFILE) -> Column:
    """Whether each text reaches the floors of its nearest language and length."""
    table = _Profiles(profiles, size) if profiles else None

    def passes(t: str) -> bool:
        name, score, margin = table.nearest(t, own)
        if name == UNKNOWN:
            return False
        c = length_class(t)
        low, apart = least[name][min(c, len(least[name]) - 1)]
        return score >= low or (score >= SCORE_SHARE * low and (c <= SHORT or margin >= MARGIN_SHARE * apart))

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([table is not None and t.is_valid and passes(t.as_py()) for t in texts], pa.bool_())

    return run.asNondeterministic()(text)


RESULT = "struct<lang_pred:string,score:double,margin:double>"


def predict(profiles: dict[str, np.ndarray], text: Column, own: int = OWN, size: int = PROFILE) -> Column:
    """A struct (lang_pred, score, margin) for each text, the whole of it."""
    table = _Profiles(profiles, size) if profiles else None

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        out = [(UNKNOWN, 0.0, 0.0) if table is None or not t.is_valid else table.nearest(t.as_py(), own) for t in texts]
        names, scores, margins = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=["lang_pred", "score", "margin"])

    return run.asNondeterministic()(text)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", prefix: str = "lang_") -> DataFrame:
    """The rows with lang_pred, score and margin added (numbered names where the rows have those already)."""
    r = fresh(docs, "r")
    a, b, c = (fresh(docs, n) for n in ("lang_pred", "score", "margin"))
    out = docs.withColumn(r, predict(profiles, F.col(text)))
    return out.select(*docs.columns, F.col(r)["lang_pred"].alias(a), F.col(r)["score"].alias(b), F.col(r)["margin"].alias(c))
