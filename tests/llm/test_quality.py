import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import _words as W
from foliospark.llm import quality, queries
from tests.llm.data import SF, docs, empty
import pyarrow as pa


def test_gradient_is_the_slope():
    r = np.random.default_rng(3)
    x, at, y = r.normal(size=(9, quality.FEATURES)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.Model()

    def loss():
        p = model.score(x, at)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model.gradient(x, at, y)
    for name, grad in grads.items():
        flat = model.p[name].reshape(-1)
        for i in {0, len(flat) // 2, len(flat) - 1}:
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            model.p[name] = flat.reshape(model.p[name].shape)
            assert abs((up - down) / 2e-6 - np.asarray(grad).reshape(-1)[i]) < 1e-5


def test_passages_cover_whole_texts():
    texts = pa.array(["a " * 130, None, "", "b"])
    ((_, _, data, offs),) = W.slices(texts)
    x, at = quality.passages(data, offs)
    assert at.tolist() == [0, 3, 4, 5, 6]
    assert np.allclose(x[:3, -2], [1, 1, 2 / 64]) and (x[3:5] == 0).all()


def test_features_do_not_depend_on_neighbours():
    texts = ["One, two; THREE 44!", "$$$ ### x x x", "", "Ünïcode words, more"]
    ((_, _, data, offs),) = W.slices(pa.array(texts))
    together, _ = quality.passages(data, offs)
    for i, t in enumerate(texts):
        ((_, _, data, offs),) = W.slices(pa.array([t]))
        assert np.allclose(quality.passages(data, offs)[0][0], together[i])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.95


def test_odd_rows(spark):
    table = docs(spark)
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 0), (9, None), (None, 1), (99, 1), (13, 0), (14, 1)], "doc_id long, quality int")
    model = quality.learn(table, labels)
    got = table.select("doc_id", "text", quality.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == table.count() and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if r.doc_id == 2}) == 1
    assert len({r.s for r in got if not (r.text or "").strip()}) == 1


def test_nothing_to_learn_and_nothing_to_read(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learn(docs(spark), labels)
    assert {r[0] for r in docs(spark).select(quality.score(model, F.col("text"))).collect()} == {0.5}
    assert empty(spark).select(quality.score(model, F.col("text"))).collect() == []
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.learn(docs(spark), one).constant == 1.0


def test_scores_equal_a_plain_version(spark):
    """Every passage is encoded, attended to and pooled one document at a time, without the batches of the operator."""
    import math

    import numpy as np

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.learn(table, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.s for r in table.select("doc_id", quality.score(model, F.col("text")).alias("s")).collect()}
    p = model.p
    for row in table.collect():
        text = (row.text or "").encode()
        x = quality.passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        logits, pooled = [], []
        for passage in (x - model.mean) / model.scale:
            h = np.tanh(passage @ p["A"] + p["b"])
            gate = 1 / (1 + np.exp(-(h @ p["U"])))
            logits.append(float((np.tanh(h @ p["V"]) * gate) @ p["w"]))
            pooled.append(h)
        weights = [math.exp(e - max(logits)) for e in logits]
        z = sum(a * h for a, h in zip(weights, pooled, strict=True)) / sum(weights)
        assert abs(got[row.doc_id] - 1 / (1 + math.exp(-float(z @ p["c"] + p["d"])))) < 1e-9


def plain_passages(text):
    """The figures of each passage, by loops over its bytes and words."""
    import re

    raw = (text or "").encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    punct = [b for b in range(33, 127) if not chr(b).isalnum()]
    out = []
    for i in range(0, max(1, len(words)), quality.PASSAGE):
        some = words[i : i + quality.PASSAGE]
        if not some:
            return [[0.0] * quality.FEATURES]
        span = raw[some[0][0] : some[-1][1]]
        size, lengths = len(span), [b - a for a, b in some]
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in raw[a:b]) for a, b in some]
        letters = sum(1 for c in span if chr(c).isascii() and chr(c).isalpha() or c >= 128)
        mean = sum(lengths) / len(some)
        out.append([
            *((span.count(p) / size) ** 0.5 for p in punct), letters / size, sum(1 for c in span if 65 <= c <= 90) / size, sum(1 for c in span if 48 <= c <= 57) / size,
            mean / 10, max(0.0, sum(n * n for n in lengths) / len(some) - mean**2) ** 0.5 / 10, len(set(low)) / len(some), max(low.count(w) for w in set(low)) / len(some),
            sum(a == b for a, b in zip(low, low[1:], strict=False)) / len(some), len(some) / quality.PASSAGE, sum(n <= 3 for n in lengths) / len(some),
        ])
    return out


def test_passages_equal_a_plain_encoder(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    for text in [*texts, None, "", " \n", "Übung macht den MEISTER, ja ja ja! 1.2.3", "x" * 3000, "a b " * 500]:
        ((_, _, data, offs),) = W.slices(pa.array([text], pa.string()))
        got, _ = quality.passages(data, offs)
        assert np.allclose(got, plain_passages(text), atol=1e-5), text


def test_many_rows_under_one_labelled_key_stay_bounded(spark):
    """A third of all rows under one labelled key, some of them copies."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id) as doc_id", "concat('text ', if(id % 9 = 0, 0, id), ' of some words') as text")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.Model.fit
    try:
        quality.Model.fit = lambda self, x, at, y, **more: seen.append(len(y)) or fit(self, x, at, y, **more)
        quality.learn(rows, labels, bound=50)
        quality.learn(rows, labels.where("doc_id <> 1"), bound=50)
        quality.learn(rows.where("doc_id = 1"), labels)
    finally:
        quality.Model.fit = fit
    assert seen == [50, 2, 668]
