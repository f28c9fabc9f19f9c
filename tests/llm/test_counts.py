import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import counts
from tests.llm.data import SF, docs, empty

SCORES = counts.load_scores(public_tokenizers.path("piece_bpe_32k.model"))
LEAST, LONGEST = min(SCORES.values()), max(map(len, SCORES))


def plain(word, scores, least=None, longest=None):
    byte, longest = (least or min(scores.values())) // counts._SCALE, longest or max(map(len, scores))
    best = [(0, 0)]
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(best[i - 1][0] + byte * n, best[i - 1][1] - n)]
        options += [(best[j][0] + (scores[word[j:i]] + 1) // counts._SCALE, best[j][1] - 1) for j in range(max(0, i - longest), i) if word[j:i] in scores]
        best.append(max(options))
    return -best[-1][1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abcé🙂", min_size=1, max_size=9), min_size=1, max_size=20))
def test_walk_shares_prefixes_and_counts_alike(words):
    small = {p: counts.score(i) for i, p in enumerate(["▁", "a", "b", "c", "ab", "▁a", "abc", "bc", "▁ab", "ca"])}
    walk = counts.Walk(small)
    words = sorted(set(words))
    assert [walk.tokens("▁" + w) for w in words] == [plain("▁" + w, small) for w in words]
    prefixes = {("▁" + w)[:i] for w in words for i in range(1, len(w) + 2)}
    assert walk.computed == len(prefixes)


def check(table, **options):
    want = sorted(repr((r.doc_id, len(w := re.findall("[^\x20\x09-\x0d]+", r.text or "")), sum(plain("▁" + x, SCORES, LEAST, LONGEST) for x in w))) for r in table.select("doc_id", "text").collect())
    assert sorted(repr(tuple(r)) for r in counts.count_tokens(table, SCORES, **options).select("doc_id", "n_words", "n_tokens").collect()) == want


def test_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40"))


def test_odd_rows(spark):
    table = docs(spark).where("length(text) < 20000 or text is null")
    check(table)
    check(table, frequent=5)


def test_empty(spark):
    assert counts.count_tokens(empty(spark), SCORES).collect() == []


def test_a_word_of_more_than_a_million_tokens():
    n = (1 << 20) + 5
    assert counts.Walk({"a": counts.score(0)}).tokens("a" * n) == n
