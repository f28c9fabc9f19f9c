import re

from foliospark.llm import licenses
from tests.llm.data import SF, docs, empty, lower


def plain(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(table):
    texts = {(r.doc_id, r.n): r.text for r in table.selectExpr("doc_id", "text", "0 as n").collect()}
    got = licenses.scan(table).collect()
    assert len(got) == table.count()
    want = sorted(map(repr, (((r.doc_id, *plain(r.text))) for r in table.select("doc_id", "text").collect())))
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert texts is not None
    return got


def test_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark):
    check(docs(spark))


def test_places_and_changed_templates(spark):
    mit = next(t for t, label in licenses.TEMPLATES if label == "mit" and len(t) > 100)
    w = mit.split()
    changed = w[:20] + ["extra"] + w[20:40] + w[41:55] + ["altered"] + w[56:]
    texts = [
        (1, "CC-BY cc by, CC BY! MIT License? mit  license Apache\nLicense"),
        (2, "x " * 50 + " ".join(changed) + " y" * 50),
        (3, " ".join(reversed(w))),
        (4, "GNU General Public Licence; gnu general public license, version 3: licensed under the GNU General Public License, version 3."),
        (5, "mit licenKe mité license cc bý"),
        (6, "cc by cc by cc by"),
    ]
    got = {r.doc_id: r for r in check(spark.createDataFrame(texts, "doc_id long, text string"))}
    assert got[2].labels == "mit" and got[2].base_labels == "" and 0.7 <= got[2].score < 1
    assert 45 <= got[2].spans[0].start <= 52
    assert got[3].labels == ""
    assert got[4].labels == "gpl,gpl-3.0"
    assert got[6].n_base == 3 and (got[6].first_word, got[6].last_word) == (0, 4)


def test_empty(spark):
    assert licenses.scan(empty(spark)).collect() == []


def test_repeated_templates_are_found_and_repeated_pairs_are_not(spark):
    isc = next(t for t, label in licenses.TEMPLATES if label == "isc")
    changed = " ".join("altered" if i == 12 else w for i, w in enumerate(isc.split()))
    texts = [
        (1, " ".join(f"Song{i} All rights reserved." for i in range(9))),
        (2, "All rights reserved. " * 4),
        (3, "Licensed under CC BY 4.0. CC BY 4.0. CC BY 4.0. CC BY 4.0."),
        (4, "all rights, and all rights"),
        (5, " ".join([changed] * 3)),
    ]
    got = {r.doc_id: r for r in check(spark.createDataFrame(texts, "doc_id long, text string"))}
    assert got[1].labels == got[2].labels == "all-rights-reserved" and got[1].score == 1
    assert len(got[1].spans) == 9 and len(got[2].spans) == 4
    assert got[3].labels == "cc-by" and any(x.start == 0 and x.stop == 6 for x in got[3].spans)
    assert got[4].labels == "" and got[4].score == 0
    assert got[5].labels == "isc" and 0.7 <= got[5].score < 1 and [x.start for x in got[5].spans] == [0, len(isc.split()), 2 * len(isc.split())]


def plain_matches(text):
    """Labels and best coverage: every diagonal, run of near diagonals and window of every template, one after the other."""
    w = [x for x in re.split(licenses._SEPARATORS, lower((text or "").replace("K", "ĸ")).lower()) if x]
    where = {}
    for i, pair in enumerate(zip(w, w[1:], strict=False)):
        where.setdefault(pair, []).append(i)
    labels, score = set(), 0.0
    for words, label, phrase in [*((p, b, True) for p, b in licenses.PHRASES), *((t, b, False) for t, b in licenses.TEMPLATES)]:
        t = words.split()
        pairs = [i for i in range(len(t) - 1) if phrase or not (t[i] in licenses.STOP and t[i + 1] in licenses.STOP)]
        least = 1.0 if len(pairs) <= licenses.SHORT else licenses.COVERAGE
        diagonals = {}
        for i in pairs:
            for pos in where.get((t[i], t[i + 1]), ()):
                diagonals.setdefault(pos - i, []).append((pos, i))
        if any(len(hits) == len(pairs) for hits in diagonals.values()):
            labels.add(label)
            score = 1.0
        if phrase:
            continue
        rest, run = sorted(d for d, hits in diagonals.items() if len(hits) < len(pairs)), []
        for d, after in zip(rest, [*rest[1:], None], strict=False):
            run += diagonals[d]
            if after is None or after - d > licenses.GAP:
                width = int(len(t) * licenses.STRETCH + licenses.GAP)
                if len(run) / len(pairs) >= least:
                    for start, _ in run:
                        share = len({i for pos, i in run if pos >= start and pos + 2 - start <= width}) / len(pairs)
                        if share >= least:
                            labels.add(label)
                            score = max(score, share)
                run = []
    return ",".join(sorted(labels)), score


def test_labels_and_scores_equal_a_plain_version(spark):
    templates = [t.split() for t, _ in licenses.TEMPLATES]
    texts = []
    for k, t in enumerate(templates):
        texts.append(" ".join(t[: len(t) * 3 // 4]))
        texts.append(" ".join(x if i % 9 else f"other{k}" for i, x in enumerate(t)))
        texts.append(" ".join(["before", *t[: len(t) // 2], "between", "two", *t[len(t) // 2 :], *t[3:], "after"]))
    made = spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    for table in (made, docs(spark).select("doc_id", "text"), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")):
        got = sorted(repr((r.doc_id, r.labels, round(r.score, 9))) for r in licenses.scan(table).collect())
        want = []
        for r in table.collect():
            labels, score = plain_matches(r.text)
            want.append(repr((r.doc_id, labels, round(score, 9))))
        assert got == sorted(want)
