import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from foliospark.llm import bpe, queries
from tests.llm.data import SF, docs, empty

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(table, **options):
    out = bpe.encode(table, RANKS, public_tokenizers.PATTERN, **options)
    got = out.select("doc_id", "ids", bpe.count(F.col("ids")).alias("c"), bpe.decode(F.col("ids"), RANKS).alias("b")).collect()
    want = []
    for r in table.select("doc_id", "text").collect():
        ids = OWN.encode_ordinary(r.text or "")
        want.append(repr((r.doc_id, ",".join(map(str, ids)), len(ids), (r.text or "").encode())))
    assert sorted(repr((r.doc_id, r.ids, r.c, bytes(r.b))) for r in got) == sorted(want)


def test_odd_rows(spark):
    table = docs(spark)
    check(table)
    check(table, most=3)


def test_scripts_and_blanks(spark):
    texts = ["it's we'll IT'S  x", "a  b  c\u0085d", "\x1c\x1d a \x0b\x0c b", "тест тестовый 漢字かな交じり", "🙂🙂‍↔️ áé", "١٢٣ ½ ²³", "   lead", "trail   ", "\n\n\n x \r\n", "<|endoftext|>", "﻿bom", "a" * 70, "=" * 50, "ſK"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=4)


def test_long_words(spark):
    r = random.Random(7)
    drawn = lambda letters, n: "".join(r.choices(letters, k=n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    texts = [drawn(lower, n) for n in (255, 256, 257, 258, 320, 321, 1000, 30_000)]
    texts += [drawn("ab", 3000), drawn("aeinrst", 5000), drawn("тест漢字かな交", 2000), drawn("=-", 3000), drawn("\u0301🙂‍👩é", 1500)]
    texts += ["=" * 5000, "=" * 20_001, "a" * 3001, "ab" * 2000, "aab" * 1000, " " * 3000, "theand" * 700, "\n" * 2000, "x" * 300 + "y" * 300]
    texts += [base64.b64encode(r.randbytes(4000)).decode(), r.randbytes(2000).hex(), "\ue000" * 1000]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8), most=4)


def test_short_words_are_folded_together():
    r = random.Random(5)
    words = ["".join(r.choices(letters, k=r.randint(1, n))).encode()[:40] for letters, n in (("etaoinshr", 40), ("ab", 40), (" =\n-", 40), ("тест漢é🙂", 20)) for _ in range(500)]
    words += [bytes([b]) for b in range(256)] + [b"", b"\xff\xfe", b"the", b"aaaa"]
    got = bpe.Pieces(RANKS).fold(pa.array(words, pa.binary())).to_pylist()
    assert got == [",".join(map(str, OWN._encode_single_piece(w))) if w else "" for w in words]
    few = {b"a": 0, b"ab": 1, b"abc": 2, b"cc": 3}  # bytes without a rank have no id
    assert bpe.Pieces(few).fold(pa.array([b"abcx", b"xa", b"bb", b"ccab"])).to_pylist() == ["2", "0", "", "3,1"]
    assert bpe.Pieces({}).fold(pa.array([b"ab"])).to_pylist() == [""]
    assert bpe.Pieces(RANKS).fold(pa.array([], pa.binary())).to_pylist() == []


def test_query(spark):
    got = {r.doc_id: r for r in queries.op7_bpe(spark, SF, most=3000).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = OWN.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_empty(spark):
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).collect() == []
