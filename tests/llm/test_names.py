"""Extra columns with the names the operators use themselves: they come back as they were."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestra.llm import near_jaccard, op04_fuzzy_lines, op06_language, op07_near_simhash, op08_mixing, op09_exact_stream
from attestra.llm.common import free_name

NAMES = (
    "__near_row", "__kept", "__line_row", "__row", "__dropped", "__mix_row", "__taken", "__copies", "__copy", "__lettered", "__keep_id", "__keep_digest",
    "__keep_text", "__keep_content", "__nth", "_row", "row", "root", "_next",
)
TEXTS = {
    1: "the old mill stood by the river and nobody had ground corn there", 2: "the old mill stood by the river and nobody had ground corn there",
    3: "a letter came from the town on monday with news of the fair", 4: None,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("a")})
    # the same value in every row: taken for a row number, it would make one document of all
    return rows.select("*", *[F.lit(7).alias(name) for name in NAMES])


def test_free_name(spark):
    frame = spark.range(1).select(F.lit(1).alias("A"), F.lit(1).alias("a_"))
    assert free_name(frame, "a") == "a__" and free_name(frame, "b") == "b"


@pytest.mark.parametrize("keep, ids", [
    (near_jaccard.keep_one, {1, 3, 4}), (op07_near_simhash.keep_one, {1, 3, 4}), (op09_exact_stream.keep_one, {2, 3, 4}),
    (op08_mixing.take, {1, 2, 3}), (op04_fuzzy_lines.drop_lines, {1, 2, 3, 4}),
])
def test_columns_come_back(docs, keep, ids):
    made = keep(docs)
    assert made.columns == docs.columns
    rows = made.collect()
    assert {r["doc_id"] for r in rows} == ids and all(r[name] == 7 for r in rows for name in NAMES)


def test_languages_with_and_without_labels(docs):
    made = op06_language.keep_known(docs).collect()
    assert {r["doc_id"] for r in made} == {1, 2, 3} and all(r[name] == 7 for r in made for name in NAMES)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in op06_language.keep_known(unlabelled).collect()} == {1, 2, 3}
