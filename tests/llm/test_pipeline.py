import base64
import random

import corpus_pipeline
from foliospark.llm import _graph, packing
from foliospark.llm._rows import saved
from tests.llm.data import SF, docs, empty, least_linked, without_lines
from tests.llm.test_packing import check


def test_run_against_plain_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.filter_quality(spark, saved(corpus_pipeline.identify_language(spark, table, SF)), SF)
    entries = sorted((r.doc_id, r.text) for r in kept.collect())
    texts = without_lines(entries)
    left = [(k, texts[k, t]) for k, t in entries if texts[k, t] == t or texts[k, t].strip()]
    groups, _ = least_linked([t for _, t in left], 5, 80)
    stay = {left[i][0]: left[i][1] for i in range(len(left)) if left[i][0] == min(left[j][0] for j in groups[i])}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(t.split()) for k, t in stay.items()}
    check(got, len(stay), packing.BUDGET)


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    columns = "doc_id text lang source n_chars".split()
    spark.createDataFrame([(1, 1), (14, 1), (9, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs(spark).select(columns), empty(spark).select(columns)):
        for name, stage in corpus_pipeline.STAGES:
            table = saved(stage(spark, table, str(tmp_path)))
            assert name == "packing" or table.columns == columns
        table.collect()


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id + 1 as a", "id as b").union(spark.range(5).selectExpr("1000 + id * 2 as a", "1001 as b"))
    got = {r.node: r.root for r in _graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[1008] == 1000


def test_language_stage_drops_junk_and_keeps_short_clean_texts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    italian = "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. "
    bad = [" ".join(word() for _ in range(400)), base64.b64encode(r.randbytes(3000)).decode(), r.randbytes(1500).hex(), r.randbytes(1500).hex(" "), polish, polish * 4, italian]
    good = [
        "All human beings are born free and equal in dignity and rights.",
        "The weather is fine today.",
        "Das Wetter ist heute schön.",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits.",
        "El tiempo es bueno hoy.",
        "We will meet at the station after the concert and walk home together.",
    ]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    known = table.count()
    added = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(bad + good)], "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, table.unionByName(added), "").collect()
    assert sorted(r.text for r in got if r.doc_id >= 10_000_000) == sorted(good)
    assert len(got) - len(good) >= 0.999 * known
