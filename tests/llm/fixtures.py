"""Awkward documents: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, key STRING, node LONG, _text STRING, code LONG, digest STRING"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 7, "clash", 1, "d") for i, t, lang, src in rows], SCHEMA)


PROSE = "the old mill stood by the river and nobody had ground corn there since the flood took the wheel away "

ODD = [
    (5, None, "en", "a"), (6, "", None, None), (7, " \t\n ", "en", "b"), (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"),
    (3, PROSE + "again", "en", "b"), (None, PROSE, None, None), (None, None, None, None), (8, "one", "en", "c"), (9, "ONE", "de", "c"),
    (10, "one two three", "en", None), (11, PROSE * 300, "en", "d"), (12, PROSE * 300 + "tail", "en", "d"), (13, "é è ü ß ñ — ¿qué?", "es", "é"),
    (14, "\U0001f600 \U0001f600", None, "\U0001f600"), (15, "a\x00b", "fr", ""), (16, "12 34 56", "fr", "z"),
]
