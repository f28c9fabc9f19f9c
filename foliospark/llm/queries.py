"""The registered queries of the operators over the shared tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, counts, forest, jaccard, language, licenses, lines, packing, periods, quality, spelling, topk, warc
from foliospark.llm._rows import key_crc, scratch


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op2_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf, "documents"), k=4, percent=85).drop("text_hash")


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rest = key_crc(F.col("doc_id")) % 4
    profiles = language.learn(docs.where(rest != 2))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "margin")


def op4_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents")).drop("spans")


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return counts.count_tokens(table(spark, sf, "documents"), counts.load_scores(public_tokenizers.path("piece_bpe_32k.model")))


def op7_bpe(spark: SparkSession, sf: str, most: int = bpe.FREQUENT) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, most=most)
    return encoded.select(
        "doc_id", bpe.count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256")
    )


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rest = key_crc(F.col("doc_id")) % 5
    model = quality.learn(docs, table(spark, sf, "labels").where(rest != 0))
    scored = docs.select("doc_id", F.coalesce(rest == 0, F.lit(True)).alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(topk.search(table(spark, sf, "embeddings"), F.col("id") % 20 == 0, scale=64))


def op10_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(forest.search(table(spark, sf, "embeddings"), F.col("id") % 20 == 0))


def _repeating(text: Column, hashed: Column) -> Column:
    """The words of a text, from one of them on, as repetitions of the first of those, as the contract plants them."""
    words = F.array_remove(F.split(text, r"[ \x09-\x0D]+"), "")
    n, g = F.size(words), F.floor(hashed / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice(words, F.lit(1), a), F.slice(turns, F.lit(1), n - a))
    return F.when((hashed % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(text)


def op11_periods(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", _repeating(F.col("text"), key_crc(F.col("doc_id"))).alias("text"))
    runs, best = F.col("runs"), F.col("best")
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return periods.with_runs(docs).withColumn("best", periods.greatest(runs)).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "best.*", F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Words of six letters or more that occur five times, after the contract's deletions."""
    word = F.col("word")
    found = table(spark, sf, "documents").select("doc_id", F.explode(spelling.runs(F.col("text"), 6)).alias("word"))
    hashed = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), word).cast("binary"))
    at = (hashed % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    words = found.select(F.when(hashed % 199 == 0, cut).otherwise(word).alias("word")).where(F.char_length("word") >= 6)
    return spelling.variants(words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5"))


def op13_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf, "pages"), folder)
    back = warc.read(spark, folder, payloads=False)
    return back.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("to_key").cast("long").alias("refers_to"))


_TOPK_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
 SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

_JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) m ON m.node = d.doc_id"""

_LINES_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
 q AS (SELECT doc_id * 1000000 + i AS place, doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS w FROM l),
 s AS (SELECT w, len(w) AS n, min(place) AS place FROM q WHERE len(w) > 0 GROUP BY w),
 t AS (SELECT place, n, w, unnest(w) AS x FROM s),
 c AS (SELECT x, count(*) AS c FROM t GROUP BY x),
 p AS (SELECT place, n, w, x FROM (SELECT t.*, row_number() OVER (PARTITION BY place ORDER BY c.c, x) AS r FROM t JOIN c USING (x)) WHERE r <= n - ceil(n * 4 / 5) + 1),
 late AS (SELECT DISTINCT a.w FROM p a JOIN p b ON a.x = b.x AND a.place > b.place AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
 k AS (SELECT q.doc_id, q.place, q.line, coalesce(q.place <> s.place, false) OR late.w IS NOT NULL AS gone FROM q LEFT JOIN s ON q.w = s.w LEFT JOIN late ON q.w = late.w)
 SELECT d.doc_id, CAST(coalesce(g.n_lines, 0) AS INT) AS n_lines, CAST(coalesce(g.n_removed, 0) AS INT) AS n_removed, g.text FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
 coalesce(array_to_string(list(line ORDER BY place) FILTER (NOT gone), chr(10)), '') AS text FROM k GROUP BY doc_id) g USING (doc_id)"""


def _crc_step(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def _crc_sql(text: str) -> str:
    """crc32 of a text of code points to U+00FF in UTF-8."""
    units = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] WHEN unicode(c) < 192 THEN [194, unicode(c)] ELSE [195, unicode(c) - 64] END))"
    steps = ",".join(str(_crc_step(i)) for i in range(256))
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {units}::BIGINT[]), lambda c, b: xor(c >> 8, ([{steps}]::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"


def _levels_sql(last: int) -> str:
    """Hashes of 2**m words from each place, and where the next equal ones stand: at the period of a run that begins there,
    if the period is over half of 2**m and no more than that."""
    out = ["h0 AS (SELECT doc_id, i, hash(w) AS h FROM t)"]
    for m in range(last + 1):
        out.append(f"c{m} AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id, h ORDER BY i) - i AS q FROM h{m}) WHERE 2 * q > {1 << m} AND q <= {1 << m})")
        both = f"SELECT doc_id, i, h, lead(h, {1 << m}) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM h{m}"
        out.append(f"h{m + 1} AS (SELECT doc_id, i, hash(h, next) AS h FROM ({both}) WHERE next IS NOT NULL)")
    return ",\n ".join(out)


_PERIODS_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
 g AS (SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d),
 t AS MATERIALIZED (SELECT doc_id, i, CASE WHEN planted AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w FROM (SELECT *, unnest(range(len(w))) AS i FROM g)),
 {_levels_sql(14)},
 q AS ({" UNION ".join(f"SELECT * FROM c{m}" for m in range(15))}),
 e AS (SELECT q.doc_id, q.q, x.i, x.i - row_number() OVER (PARTITION BY q.doc_id, q.q ORDER BY x.i) AS isle FROM q JOIN t x ON x.doc_id = q.doc_id JOIN t y ON y.doc_id = q.doc_id AND y.i = x.i + q.q AND x.w = y.w),
 s AS (SELECT doc_id, q AS period, min(i) AS start, count(*) + q AS length FROM e GROUP BY doc_id, q, isle),
 l AS MATERIALIZED (SELECT * FROM s WHERE length >= greatest(24, 3 * period)),
 r AS MATERIALIZED (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.doc_id = l.doc_id AND x.period < l.period AND x.start <= l.start AND x.start + x.length >= l.start + l.length)),
 f AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r) WHERE k = 1),
 o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
 k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM t ANTI JOIN o USING (doc_id, i) GROUP BY 1)
 SELECT d.doc_id, coalesce(f.n, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(f.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
 FROM d LEFT JOIN f USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""

_SPELLING_SQL = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
 c AS (SELECT w, doc_id, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY ALL),
 h AS (SELECT w, n, {_crc_sql("doc_id || ':' || w")} AS h FROM c),
 v AS (SELECT * FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1) WHERE length(word) >= 6 AND n >= 5),
 d AS (SELECT word, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
 p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word),
 f AS (SELECT p.word, count(*) AS n_near, first(p.near ORDER BY v.n DESC, p.near) AS near, max(v.n) AS near_n FROM p JOIN v ON p.near = v.word GROUP BY 1),
 t AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.near_n >= 5 * v.n THEN f.near END AS form, CASE WHEN f.near_n >= 5 * v.n THEN f.near_n END AS form_n FROM v LEFT JOIN f USING (word)),
 e AS (SELECT word, word AS root FROM t UNION ALL SELECT e.word, t.form FROM e JOIN t ON e.root = t.word WHERE t.form IS NOT NULL)
 SELECT t.word, t.form, e.root, t.n, t.n_near, t.form_n FROM t JOIN e ON e.word = t.word JOIN t l ON l.word = e.root WHERE l.form IS NULL"""

_WARC_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS s FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS first FROM p)
 SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
 ((CAST('0x' || substr(h, CAST(1 + 2 * (5 * i // 8) AS INT), 2) AS INT) * 256 + CAST('0x' || coalesce(nullif(substr(h, CAST(3 + 2 * (5 * i // 8) AS INT), 2), ''), '0') AS INT)) >> CAST(11 - 5 * i % 8 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_packing": (op1_packing, None),
    "op2_jaccard": (op2_jaccard, _JACCARD_SQL),
    "op3_language": (op3_language, None),
    "op4_licenses": (op4_licenses, None),
    "op5_line_dedup": (op5_line_dedup, _LINES_SQL),
    "op6_token_counts": (op6_token_counts, None),
    "op7_bpe": (op7_bpe, None),
    "op8_quality": (op8_quality, None),
    "op9_exact_topk": (op9_exact_topk, _TOPK_SQL),
    "op10_forest": (op10_forest, None),
    "op11_periods": (op11_periods, _PERIODS_SQL),
    "op12_spelling": (op12_spelling, _SPELLING_SQL),
    "op13_warc": (op13_warc, _WARC_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
