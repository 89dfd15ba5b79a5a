"""Registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cutting_stock, exact_dedup, flac, language, line_dedup, mixing, ngram_join, packing, phrases, pii, quality, sharding, spelling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Place of the public word tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(flac.flac_encode(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op5_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, the markup's declaration before the column's, the first address's suffix and the source's prior."""
    docs = table(spark, sf_dir, "documents")
    declared = F.coalesce(language.markup_language(F.col("text")), F.col("lang"))
    return language.identify(docs, declared=declared, suffix=language.link_suffix(F.col("text")), host=F.col("source"))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion over raw web pages, with the markup's language and the address.

    Null pages count as empty and are rejected; null addresses are no evidence;
    pages of any length, repeated rows and an empty table as in ``identify``.
    """
    pages = table(spark, sf_dir, "pages")
    host, suffix = language.url_parts(F.col("url"))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    pages = pages.select("page_id", "url", text.alias("text"), F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})", 1).alias("declared"))
    return language.identify(pages, "page_id", "text", F.col("declared"), suffix, host).withColumnRenamed("doc_id", "page_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    found = quality.score(docs, quality.fit(docs, labels.where(fold != 0)))
    return found.select(
        "doc_id", (fold == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack_cutting(table(spark, sf_dir, "documents"), word_tokenizer())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_flac": op2_flac,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_feistel": op5_feistel,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_phrases": op12_phrases,
    "op13_cutting_stock": op13_cutting_stock,
    "pages_language": pages_language,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op3_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM n""",
    # each frequent word, pair and triple from positions inside pieces
    "op12_phrases": r"""
        WITH pieces AS (SELECT row_number() OVER () AS piece, lang, p FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
        lists AS (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
        w AS (SELECT lang, piece, generate_subscripts(ws, 1) AS i, unnest(ws) AS w1 FROM lists),
        t AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
        f1 AS (SELECT lang, w1, count(*) AS a FROM t GROUP BY ALL HAVING count(*) >= 10),
        f2 AS (SELECT lang, w1, w2, count(*) AS a FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        totals AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
        cuts AS (SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.a, 1 AS k, x.a AS l, y.a AS r FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
            UNION ALL SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.a, 1, x.a, y.a FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
            UNION ALL SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.a, 2, x.a, y.a FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3),
        scored AS (SELECT lang, phrase, a, l, r, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score, k FROM cuts),
        worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS m FROM scored) WHERE m = 1),
        longer AS (SELECT lang, phrase, max(a) AS top FROM (SELECT lang, w1 || ' ' || w2 AS phrase, a FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f3) GROUP BY ALL),
        left_over AS (SELECT w.* FROM worst w LEFT JOIN longer USING (lang, phrase) WHERE top IS NULL OR 100 * top < 50 * a),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
        SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000""",
}
