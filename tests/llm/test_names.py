"""Extra columns of any name, and rows that repeat an id."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import line_dedup, linkage
from framewright.llm.store import cut

LINE = "the quick brown fox jumps over the lazy dog again"


@pytest.mark.parametrize("name", ["_fw_gone", "_fw_lines", "_fw_id", "_FW__x", "h1", "group", "lead"])
def test_lines_keep_columns_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, f"{LINE}\nsomething else altogether here", "a"), (2, f"{LINE}\nanother line of other words", "b")], f"doc_id long, text string, {name} string")
    got = {r.doc_id: r for r in line_dedup.drop_lines(docs).collect()}
    assert got[1][name] == "a" and got[2][name] == "b"
    assert got[1].text == f"{LINE}\nsomething else altogether here" and got[2].text == "another line of other words"
    assert (got[2].n_lines, got[2].n_dropped) == (2, 1)


def test_language_stage_with_clashing_names_and_repeated_ids(spark):
    text = "the house and the garden are near the old river where the children play every day"
    rows = [(i % 7, text + f" number {i}", "en", "a.example", 80) for i in range(14)] + [(99, None, "en", "a.example", 0), (98, "", "en", "a.example", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_lang": F.lit("x"), "_id": F.lit(1)})
    first = sorted(map(tuple, corpus_pipeline.language_id(spark, docs, "").collect()))
    assert first == sorted(map(tuple, corpus_pipeline.language_id(spark, docs, "").collect()))
    assert len(first) == 14 and {r[0] for r in first} == set(range(7)) and {len(r) for r in first} == {5}


def test_a_long_chain_is_one_component(spark):
    n = 300
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = linkage.components(edges, cut).collect()
    assert len(got) == n + 1 and {r.group for r in got} == {0}
