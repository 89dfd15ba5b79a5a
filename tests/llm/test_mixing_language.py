"""Stated targets of the mix, held-back declarations of the language, odd rows of both."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framewright.llm import language, mixing, queries

SF = "/root/testdata/sf0.01"


def shares(found, margin):
    total = found.agg(F.sum(F.col("tokens") * F.col("factor"))).first()[0]
    return {r[0]: r.s / total for r in found.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("factor")).alias("s")).collect()}


def test_stated_targets_are_met_and_sampled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = mixing.mix(docs, targets={"lang": {"en": 0.4, "fr": 0.3}, "source": {"src8": 0.04}}).cache()
    lang, source = shares(found, "lang"), shares(found, "source")
    assert lang["en"] == pytest.approx(0.4, abs=1e-6) and lang["fr"] == pytest.approx(0.3, abs=1e-6)
    assert source["src8"] == pytest.approx(0.04, abs=1e-6)
    assert found.count() == docs.count() and found.where("probability > 1 OR probability < 0").count() == 0
    # the draw keeps each document with its probability: expected and drawn documents agree within five deviations
    p, v, n = found.agg(F.sum("probability"), F.sum(F.col("probability") * (1 - F.col("probability"))), F.sum(F.col("sampled").cast("int"))).first()
    assert abs(n - p) <= 5 * v**0.5 + 1


def test_targets_that_make_no_sense_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en")], "doc_id long, text string, source string, lang string")
    for bad in ({"lang": {"en": 0.8, "de": 0.3}}, {"lang": {"de": 1.0}}, {"colour": {"x": 1.0}}):
        with pytest.raises(ValueError):
            mixing.mix(docs, targets=bad)


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, lang string, tokens string, factor string, _salt int"
    rows = [(1, None, None, None, "x", "y", 1), (2, "", "s", "en", None, None, 2), (3, "a b c", "s", "en", None, None, 3), (3, "a b c", "s", "en", None, None, 3), (4, "w " * 300_000, "t", None, None, None, 4)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.source, r.lang, r.tokens) for r in got) == [(1, "", "", 0), (2, "s", "en", 0), (3, "s", "en", 3), (3, "s", "en", 3), (4, "t", "", 300_000)]
    assert len({r.sampled for r in got if r.doc_id == 3}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0), targets={"lang": {"en": 1.0}}).count() == 0


def test_held_back_declarations_are_found_again(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isin(*language.LANGS))
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    found = language.identify(docs, declared=F.when(~hidden, F.col("lang")), host=F.col("source"))
    held = docs.where(hidden).select("doc_id", F.col("lang").alias("said")).join(found, "doc_id")
    right, n = held.agg(F.sum((F.col("lang") == F.col("said")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n
    assert held.where("declared IS NOT NULL").count() == 0


def test_a_wrong_declaration_loses_and_evidence_decides_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'fr' AND n_chars > 500").limit(200).select("text").union(
        spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars > 500").limit(200).select("text")
    )
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").withColumn("ends", F.col("lang"))
    odd = spark.createDataFrame([(-1, "la", "fr", "fr"), (-2, "la", "es", "es"), (-3, docs.first()[0], "de", None)], "doc_id long, text string, lang string, ends string")
    got = {r.doc_id: r.lang for r in language.identify(base.unionByName(odd), declared=F.col("lang"), suffix=F.col("ends")).where("doc_id < 0").collect()}
    assert got == {-1: "fr", -2: "es", -3: "fr"}


def test_markup_and_addresses_in_texts(spark):
    rows = [('<HTML class="x" LANG="de-AT"><p>x', "de", None), ("see https://a.example.fr/x and http://b.es/", None, "fr"), ("at http://example.com/es/12", None, "es"), ("lang = en", None, None), (None, None, None), ("a < b lang=fr", None, None)]
    docs = spark.createDataFrame(rows, "text string, m string, s string")
    for r in docs.select("m", "s", language.markup_language(F.col("text")).alias("gm"), language.link_suffix(F.col("text")).alias("gs")).collect():
        assert (r.gm, r.gs) == (r.m, r.s)


def test_pages(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = queries.pages_language(spark, SF)
    said = pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]{2})', 1).alias("said")).where(F.col("said").isin(*language.LANGS))
    right, n = found.join(said, "page_id").agg(F.sum((F.col("lang") == F.col("said")).cast("int")), F.count("*")).first()
    assert found.count() == pages.count() and n > 0 and right >= 0.95 * n
    odd = pages.limit(3).withColumns({"html": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    odd.write.parquet(f"{tmp_path}/pages.parquet")
    assert all(r.rejected for r in queries.pages_language(spark, str(tmp_path)).collect())


def test_language_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, host string")
    assert language.identify(docs, declared=F.col("lang"), host=F.col("host")).count() == 0
