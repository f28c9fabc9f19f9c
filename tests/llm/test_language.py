import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import language, queries
from tests.llm.data import SF, docs, empty


def plain_grams(text):
    text = "".join(c if c.isalpha() else "_" for c in unicodedata.normalize("NFC", text).lower())
    text = "_" + "_".join(w for w in text.split("_") if w) + "_"
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            g = text[i : i + n]
            if g != "_" and "_" not in g[1:-1]:
                out[g] += 1
    return out


def value(gram):
    out = 0
    for c in gram:
        out = out << 21 | (0x1FFFFF if c == "_" else ord(c))
    return out


def plain_order(text, top):
    return [g for g, _ in sorted(((value(g), n) for g, n in plain_grams(text).items()), key=lambda x: (-x[1], x[0]))[:top]]


def test_against_plain_distances(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    profiles = language.learn(table)
    names = sorted(profiles)
    for r in language.identify(table, profiles).collect():
        mine = plain_order(r.text, language.OWN)
        far = []
        for n in names:
            rank = {g: i for i, g in enumerate(profiles[n].tolist())}
            far.append(sum(min(abs(i - rank[g]), language.PROFILE) if g in rank else language.PROFILE for i, g in enumerate(mine)) / (len(mine) * language.PROFILE))
        assert r.lang_pred == names[far.index(min(far))]
        assert abs(r.score - (1 - min(far))) < 1e-9


def test_held_out_accuracy(spark):
    found = queries.op3_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    share = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.98


def test_odd_rows(spark):
    table = docs(spark)
    got = language.identify(table, language.learn(table)).collect()
    assert len(got) == table.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.score_2 <= 1
    assert {r.lang_pred for r in got if r.doc_id == 14} == {"de"}


def test_nothing_to_learn_and_nothing_to_read(spark):
    assert {r.lang_pred for r in language.identify(docs(spark), language.learn(empty(spark))).collect()} == {"und"}
    assert language.identify(empty(spark), {}).collect() == []


def test_every_language_with_a_text_is_learned_and_copies_count_once(spark, monkeypatch):
    few = [(f"text of {chr(97 + i)}", f"l{i}") for i in range(12) for _ in range(40)]
    copies = [("the same text", "hot")] * 400 + [(f"other {chr(97 + i)}", "hot") for i in range(8)]
    table = spark.createDataFrame(few + copies, "text string, lang string").repartition(3)
    assert set(language.learn(table, documents=20)) == {f"l{i}" for i in range(12)} | {"hot"}
    assert language._sample(table.where("lang = 'hot'"), "text", "lang", 20).count() == 9
    monkeypatch.setattr(language, "LANGUAGES", 12)
    with pytest.raises(ValueError):
        language.learn(table)


def test_profiles_and_floors_come_from_all_texts(spark):
    """Every text of a large table counts: words that few texts have, and of each piece its score."""
    rows = [(i, f"{'abcdefgh'[i % 8]}x{'ijklmnop'[i // 8 % 8]} y{i}" + (" zqz" * 9 if i % 50 == 0 else ""), "a") for i in range(4_000)]
    table = spark.createDataFrame([*rows, *rows[:500], (None, "uu vv", "b")], "doc_id long, text string, lang string")
    total = Counter()
    for text in {r[1] for r in rows}:
        total.update({value(g): n for g, n in plain_grams(text).items()})
    best = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]]
    profiles = language.learn(table)
    assert profiles["a"].tolist() == best
    nearest, scores = language._Profiles(profiles, language.PROFILE).nearest, {}
    for text in {r[1] for r in rows}:
        n = 4
        while n < 2 * len(text):
            scores.setdefault(language.length_class(text[:n]), []).append(nearest(text[:n], language.OWN)[1:])
            n *= 2
    least = language.floors(table, profiles)["a"]
    for c, found in scores.items():
        if c and len(found) >= language.FLOOR_PIECES:
            assert np.allclose(least[c], np.quantile(found, language.FLOOR_QUANTILE, axis=0), atol=3 / language.STEPS)
