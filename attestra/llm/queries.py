"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.llm import op01_html, op02_repeats, op03_packing, op04_fuzzy_lines, op05_fingerprints, op06_language, op07_near_simhash, op08_mixing, op09_exact_stream, op10_token_counts as op10_token_counts_module, op11_ranked_search as op11_module, op12_vector_codes as op12_module, op13_jaccard_join as op13_module
from attestra.llm.pretokens import tokenizer_path
from corpus_pipeline import run as run_pipeline

WORDS_SQL = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return op01_html.main_text(_table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return op02_repeats.remove_repeats(_table(spark, folder, "documents"))


def op3_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return op03_packing.pack(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    made = op04_fuzzy_lines.line_decisions(_table(spark, folder, "documents"))
    return made.select("doc_id", "n_lines", "n_dropped", "dropped")


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return op05_fingerprints.report(_table(spark, folder, "documents"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    told = op06_language.identify(_table(spark, folder, "documents"))
    return told.select("doc_id", op06_language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_near_simhash(spark: SparkSession, folder: str) -> DataFrame:
    grouped = op07_near_simhash.near_groups(_table(spark, folder, "documents"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = op08_mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    made = op09_exact_stream.decisions(_table(spark, folder, "documents"))
    return made.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = op10_token_counts_module.token_counts(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return op11_module.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return op12_module.vector_codes(_table(spark, folder, "embeddings")).drop("label")


def op13_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return op13_module.similar_groups(_table(spark, folder, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
OP11_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), listed AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
), bags AS (SELECT kind, id, term, count(*) AS tf FROM listed GROUP BY ALL),
sizes AS (SELECT id, sum(tf)::BIGINT AS n FROM bags WHERE kind = 'd' GROUP BY id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM bags, totals WHERE kind = 'd' GROUP BY term),
scored AS (
  SELECT i.id AS item_id, d.id AS doc_id, sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM bags i JOIN bags d ON i.kind = 'i' AND d.kind = 'd' AND i.term = d.term JOIN weights ON weights.term = d.term JOIN sizes ON sizes.id = d.id, totals
  GROUP BY ALL
)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10"""

def _op12_sql(rounds: int = 6, entries: int = 16) -> str:
    assigned = """a{0} AS MATERIALIZED (
  SELECT vec_id, part, (best % 16)::BIGINT AS entry, (best // 16)::BIGINT AS d FROM (
    SELECT vec_id, part, min(d * 16 + entry) AS best FROM (
      SELECT vec_id, part, entry, sum((x - y) * (x - y))::BIGINT AS d FROM c JOIN b{0} USING (part, j) GROUP BY ALL) GROUP BY ALL))"""
    replaced = """b{1} AS MATERIALIZED (
  SELECT part, entry, j, coalesce(mean, y) AS y FROM b{0} LEFT JOIN (
    SELECT part, entry, j, floor(sum(x) / count(*))::BIGINT AS mean FROM a{0} JOIN c USING (vec_id, part) GROUP BY ALL) USING (part, entry, j))"""
    steps = [step for k in range(rounds) for step in (assigned.format(k), replaced.format(k, k + 1))] + [assigned.format(rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS nth FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS MATERIALIZED (
  SELECT vec_id, nth, (i - 1) // (len(embedding) // 8) AS part, (i - 1) % (len(embedding) // 8) AS j, floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), b0 AS MATERIALIZED (SELECT part, nth AS entry, j, x AS y FROM c WHERE nth < {entries}),
{", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, j)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


OP13_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN edges ON other = a)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": run_pipeline,
    "op1_main_text": op1_main_text,
    "op2_repeats": op2_repeats,
    "op3_best_fit": op3_best_fit,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_fingerprints": op5_fingerprints,
    "op6_language_id": op6_language_id,
    "op7_near_simhash": op7_near_simhash,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_search": op11_ranked_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_jaccard_join": op13_jaccard_join,
}
ORACLES: dict[str, str] = {"op9_exact_dedup": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_jaccard_join": OP13_SQL}
