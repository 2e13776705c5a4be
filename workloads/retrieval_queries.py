"""Retrieval and evaluation family."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.functions import text
from attestra.operators import evaluation, retrieval
from attestra.plans import benchmark as benchmark_plan, retrieval as retrieval_plan
from attestra.session import derived_path
from attestra.sources import assessments
from workloads import domain, evidence_queries
from workloads.registry import Tables, query

TOKENS_SQL = """
dt AS (SELECT doc_id, source, lang, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks FROM documents),
qt AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks FROM benchmark),
d AS (SELECT doc_id, len(toks) AS d_size, unnest(toks) AS token FROM dt),
q AS (SELECT item_id, len(toks) AS q_size, unnest(toks) AS token FROM qt),
idf AS (SELECT token, count(*) AS document_frequency, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS w FROM d GROUP BY token),
qn AS (SELECT item_id, sum(coalesce(w, 1) * coalesce(w, 1)) AS q2 FROM q LEFT JOIN idf USING (token) GROUP BY item_id),
dn AS (SELECT doc_id, sum(w * w) AS d2 FROM d JOIN idf USING (token) GROUP BY doc_id),
shared AS (SELECT item_id, doc_id, count(*) AS n, sum(w * w) AS dot, min(q_size) AS q_size, min(d_size) AS d_size
           FROM q JOIN d USING (token) JOIN idf USING (token) GROUP BY item_id, doc_id),
every AS (SELECT item_id, doc_id FROM benchmark, documents),
scores AS (SELECT item_id, doc_id, round(coalesce(n / (q_size + d_size - n), 0), 12) AS lexical,
                  round(coalesce(dot / (sqrt(q2) * sqrt(d2)), 0), 12) AS vector,
                  round(coalesce(0.5e0 * (n / (q_size + d_size - n)) + 0.5e0 * (dot / (sqrt(q2) * sqrt(d2))), 0), 12) AS hybrid
           FROM every LEFT JOIN shared USING (item_id, doc_id) LEFT JOIN qn USING (item_id) LEFT JOIN dn USING (doc_id))"""
RANK_SQL = """
SELECT item_id, doc_id, round({mode}, 9) AS score, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {mode} DESC, doc_id) AS rn FROM scores) WHERE rn <= {k}"""


def _corpus(t: Tables) -> DataFrame:
    return retrieval.prepared(t.documents, "doc_id", "text", ["source", "lang"])


def _questions(t: Tables) -> DataFrame:
    return retrieval.prepared(t.benchmark, "item_id", "text")


def _ranked(t: Tables, mode: str, k: int) -> DataFrame:
    ranked = retrieval.rank(_corpus(t).select("id", "tokens"), _questions(t), mode, k)
    return ranked.select(
        F.col("question_id").alias("item_id"), F.col("document_id").alias("doc_id"), F.round("score", 9).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


@query("tokens", """
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') AS tokens FROM documents""")
def tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query("idf", "SELECT token, document_frequency, round(w, 9) AS idf FROM idf", (TOKENS_SQL,))
def idf(t: Tables) -> DataFrame:
    return retrieval.idf(_corpus(t)).select("token", "document_frequency", F.round("idf", 9).alias("idf"))


for _mode in retrieval.MODES:
    query(f"rank_{_mode}", RANK_SQL.format(mode=_mode, k=5), (TOKENS_SQL,))(lambda t, mode=_mode: _ranked(t, mode, 5))


@query("rank_topk", RANK_SQL.format(mode="lexical", k=25), (TOKENS_SQL,))
def rank_topk(t: Tables) -> DataFrame:
    return _ranked(t, "lexical", 25)


CASES_SQL = """
cases AS (SELECT item_id, b.text AS question, item_id * 5 AS expected_id, e.source, e.lang FROM benchmark b JOIN documents e ON e.doc_id = b.item_id * 5),
expected AS (SELECT c.item_id, s.lexical, s.vector, s.hybrid FROM cases c JOIN scores s ON s.item_id = c.item_id AND s.doc_id = c.expected_id),
within_subject AS (SELECT c.item_id, c.expected_id, s.doc_id, s.lexical, s.vector, s.hybrid FROM cases c JOIN documents x ON x.source = c.source AND x.lang = c.lang
            JOIN scores s ON s.item_id = c.item_id AND s.doc_id = x.doc_id),
ranks AS (
  SELECT w.item_id, 'lexical' AS mode, count(*) AS candidate_count, 1 + count(*) FILTER (w.lexical > e.lexical OR (w.lexical = e.lexical AND doc_id < expected_id)) AS rank
  FROM within_subject w JOIN expected e USING (item_id) GROUP BY w.item_id
  UNION ALL SELECT w.item_id, 'vector', count(*), 1 + count(*) FILTER (w.vector > e.vector OR (w.vector = e.vector AND doc_id < expected_id))
  FROM within_subject w JOIN expected e USING (item_id) GROUP BY w.item_id
  UNION ALL SELECT w.item_id, 'hybrid', count(*), 1 + count(*) FILTER (w.hybrid > e.hybrid OR (w.hybrid = e.hybrid AND doc_id < expected_id))
  FROM within_subject w JOIN expected e USING (item_id) GROUP BY w.item_id),
metrics AS (SELECT mode, count(*) AS query_count, avg(CASE WHEN rank = 1 THEN 1e0 ELSE 0 END) AS top1_accuracy,
                   avg(CASE WHEN rank <= 3 THEN 1e0 ELSE 0 END) AS recall_at_3, avg(1 / rank) AS mean_reciprocal_rank,
                   count(*) FILTER (candidate_count = 1) AS single_candidate_count FROM ranks GROUP BY mode)"""


def _cases(t: Tables) -> DataFrame:
    expected = t.documents.select(F.col("doc_id").alias("expected_id"), "source", "lang")
    return retrieval.prepared(
        t.benchmark.withColumn("expected_id", F.col("item_id") * 5).join(expected, "expected_id"), "item_id", "text",
        ["source", "lang", "expected_id"],
    )


@query("retrieval_ranks", "SELECT item_id, mode, candidate_count, rank FROM ranks", (TOKENS_SQL, CASES_SQL))
def retrieval_ranks(t: Tables) -> DataFrame:
    return retrieval.expected_ranks(_corpus(t), _cases(t), ["source", "lang"]).select(
        F.col("question_id").alias("item_id"), "mode", "candidate_count", "rank"
    )


@query("retrieval_metrics", """
SELECT mode, query_count, round(top1_accuracy, 9) AS top1_accuracy, round(recall_at_3, 9) AS recall_at_3,
       round(mean_reciprocal_rank, 9) AS mean_reciprocal_rank, single_candidate_count FROM metrics""", (TOKENS_SQL, CASES_SQL))
def retrieval_metrics(t: Tables) -> DataFrame:
    measured = retrieval.metrics(retrieval.expected_ranks(_corpus(t), _cases(t), ["source", "lang"]))
    return measured.select(
        "mode", "query_count", *[F.round(c, 9).alias(c) for c in ("top1_accuracy", "recall_at_3", "mean_reciprocal_rank")],
        "single_candidate_count",
    )


@query("retrieval_decision", """
, gain AS (SELECT greatest(max(top1_accuracy) FILTER (mode = 'vector'), max(top1_accuracy) FILTER (mode = 'hybrid'))
                  - max(top1_accuracy) FILTER (mode = 'lexical') AS g FROM metrics)
SELECT round(g, 9) AS best_alternative_top1_gain,
       CASE WHEN g >= 5e-2 THEN 'EVALUATE_VECTOR_FOR_PRODUCTION' ELSE 'RETAIN_LEXICAL_NO_EXTERNAL_VECTOR_INFRASTRUCTURE' END AS decision FROM gain""",
       (TOKENS_SQL, CASES_SQL))
def retrieval_decision(t: Tables) -> DataFrame:
    decided = retrieval_plan.evaluate(_corpus(t), _cases(t), ["source", "lang"])
    return decided.select(F.round("best_alternative_top1_gain", 9).alias("best_alternative_top1_gain"), "decision")


@query("label_leakage", """
SELECT item_id, contains(lower(question), lower(CAST(expected_id AS VARCHAR))) OR contains(lower(question), lower(lang)) AS leaks
FROM (SELECT item_id, b.text AS question, item_id * 5 AS expected_id, lang FROM benchmark b JOIN documents e ON e.doc_id = b.item_id * 5)""")
def label_leakage(t: Tables) -> DataFrame:
    expected = t.documents.select(F.col("doc_id").alias("expected_id"), "lang")
    cases = t.benchmark.withColumn("expected_id", F.col("item_id") * 5).join(expected, "expected_id")
    return cases.select("item_id", retrieval.label_leakage(F.col("text"), [F.col("expected_id"), F.col("lang")]).alias("leaks"))


OUTCOMES_SQL = """
outcomes AS (SELECT doc_id, source, lang, concat('S', doc_id % 3) AS split, quality = 1 - toxic AS exact, quality = 1 - toxic OR doc_id % 50 > 0 AS replay_equal,
                    toxic = 1 AND quality = 1 AS unsupported, doc_id % 4 = 0 AS security_case, toxic = 0 AS non_inference_ok,
                    quality = 0 AS expected_refused, toxic = 1 AS refused_clean
             FROM labels JOIN documents USING (doc_id)),
rates AS (
  SELECT coalesce(split, 'ALL') AS split, count(*) AS case_count, count(*) FILTER (exact) / count(*) AS exact_outcome_rate,
         coalesce(count(*) FILTER (expected_refused AND refused_clean) / nullif(count(*) FILTER (expected_refused), 0), 1) AS forbidden_request_refusal_rate,
         count(*) FILTER (replay_equal) / count(*) AS deterministic_replay_rate, count(*) FILTER (unsupported) / count(*) AS unsupported_assertion_rate,
         coalesce(count(*) FILTER (security_case AND exact AND non_inference_ok) / nullif(count(*) FILTER (security_case), 0), 1) AS security_case_pass_rate
  FROM outcomes GROUP BY GROUPING SETS ((), (split)))"""


def _outcomes(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    exact = F.col("quality") == 1 - F.col("toxic")
    return rows.select(
        "doc_id", "source", "lang", F.concat(F.lit("S"), F.col("doc_id") % 3).alias("split"), exact.alias("exact"),
        (exact | (F.col("doc_id") % 50 > 0)).alias("replay_equal"), ((F.col("toxic") == 1) & (F.col("quality") == 1)).alias("unsupported"),
        (F.col("doc_id") % 4 == 0).alias("security_case"), (F.col("toxic") == 0).alias("non_inference_ok"),
        (F.col("quality") == 0).alias("expected_refused"), (F.col("toxic") == 1).alias("refused_clean"),
    )


RATES = ("exact_outcome_rate", "forbidden_request_refusal_rate", "deterministic_replay_rate", "unsupported_assertion_rate", "security_case_pass_rate")


def _rates(t: Tables) -> DataFrame:
    outcomes = _outcomes(t)
    overall = evaluation.outcome_rates(outcomes).withColumn("split", F.lit("ALL"))
    return evaluation.outcome_rates(outcomes, ["split"]).unionByName(overall)


@query("eval_metrics", "SELECT split, case_count, " + ", ".join(f"round({r}, 9) AS {r}" for r in RATES) + " FROM rates", (OUTCOMES_SQL,))
def eval_metrics(t: Tables) -> DataFrame:
    return _rates(t).select("split", "case_count", *[F.round(r, 9).alias(r) for r in RATES])


THRESHOLDS = {
    "exact_outcome_rate": ("min", 0.5), "forbidden_request_refusal_rate": ("min", 0.1), "deterministic_replay_rate": ("min", 0.9),
    "unsupported_assertion_rate": ("max", 0.2), "security_case_pass_rate": ("min", 0.5),
}


@query("eval_thresholds", "SELECT split, " + ", ".join(
    f"{r} {'>=' if side == 'min' else '<='} {bound:e} AS check_{r}" for r, (side, bound) in THRESHOLDS.items())
    + ", CASE WHEN " + " AND ".join(f"{r} {'>=' if side == 'min' else '<='} {bound:e}" for r, (side, bound) in THRESHOLDS.items())
    + " THEN 'PASS' ELSE 'FAIL' END AS evaluation_status FROM rates", (OUTCOMES_SQL,))
def eval_thresholds(t: Tables) -> DataFrame:
    return evaluation.threshold_checks(_rates(t), THRESHOLDS, ["split"])


@query("benchmark_evaluation", evidence_queries.QUALIFY_SQL + evidence_queries.RANKED_SQL + """
, made AS (
  SELECT request_id, refused_code, CASE WHEN refused_code IS NOT NULL THEN 'REFUSED' WHEN NOT passed OR statement IS NULL THEN 'ERROR'
              WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN 'ABSTAINED' ELSE 'QUALIFIED' END AS made_status,
         CASE WHEN passed AND statement IS NULL THEN 'REQUIRED_FIELD_MISSING' WHEN failure <> '' THEN failure WHEN NOT passed THEN 'DETERMINISTIC_PROCESSING_ERROR'
              WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN observed ELSE '' END AS reason, passed AND statement IS NOT NULL AS states FROM stated),
kept AS (SELECT *, CASE WHEN request_id % 29 = 0 THEN 'ERROR' ELSE made_status END AS status, request_id % 23 = 0 AS inferred,
         (states AND (request_id % 13 = 0 OR request_id % 17 = 0)) OR (made_status = 'REFUSED' AND request_id % 19 = 0) AS unfounded FROM made),
judged_cases AS (SELECT *, status = CASE WHEN refused_code IS NOT NULL THEN 'REFUSED' ELSE 'ERROR' END
         AND reason = coalesce(refused_code, 'REQUIRED_EVIDENCE_MISSING') AS exact FROM kept)
SELECT concat('S', request_id % 3) AS split, count(*) AS case_count, round(count(*) FILTER (exact) / count(*), 9) AS exact_outcome_rate,
       round(count(*) FILTER (refused_code IS NOT NULL AND status = 'REFUSED') / count(*) FILTER (refused_code IS NOT NULL), 9) AS forbidden_request_refusal_rate,
       round(count(*) FILTER (NOT inferred AND NOT unfounded AND status = made_status) / count(*), 9) AS deterministic_replay_rate,
       round(count(*) FILTER (inferred OR unfounded) / count(*), 9) AS unsupported_assertion_rate,
       round(count(*) FILTER (refused_code IS NOT NULL AND exact AND NOT inferred) / count(*) FILTER (refused_code IS NOT NULL), 9) AS security_case_pass_rate
FROM judged_cases GROUP BY ALL""", domain.QUALIFY_CTES)
def benchmark_evaluation(t: Tables) -> DataFrame:
    """Stored results, some altered after they were made, as cases that expect refusal of refused families and missing evidence else.

    The alterations: another wording (13), no citations (17), a refusal that
    states something (19), a failed inference check (23), another status (29).
    """
    refused = F.col("claim_family").isin("CARBON_QUANTITY", "FINANCIAL_ACTION")
    code = F.when(F.col("claim_family") == "CARBON_QUANTITY", "CARBON_QUANTITY_UNSUPPORTED").when(
        F.col("claim_family") == "FINANCIAL_ACTION", "FINANCIAL_DECISION_UNSUPPORTED").otherwise("REQUIRED_EVIDENCE_MISSING")
    cases = domain.requests(t).select(
        "*", F.when(refused, "REFUSED").otherwise("ERROR").alias("expected_workflow_status"),
        F.lit(None).cast("string").alias("expected_qualification"), F.array(code).alias("expected_reason_codes"),
        refused.alias("security_case"), F.concat(F.lit("S"), F.col("request_id") % 3).alias("split"),
    )
    records = evidence_queries.records(t)
    every = lambda n: F.col("request_id") % n == 0
    statement = F.col("bounded_statement")
    altered = records.select("*", F.col("workflow_status").alias("_made")).withColumns({
        "bounded_statement": F.when(every(19) & (F.col("_made") == "REFUSED"), "It is granted.").when(every(13), F.concat(statement, F.lit(" It is certified."))).otherwise(statement),
        "evidence_refs": F.when(every(17) & F.col("evidence_refs").isNotNull(), F.slice("evidence_refs", 1, 0)).otherwise(F.col("evidence_refs")),
        "assurance_checks": F.when(every(23), F.col("assurance_checks").withField("non_inference", F.lit("FAIL"))).otherwise(F.col("assurance_checks")),
        "workflow_status": F.when(every(29), "ERROR").otherwise(F.col("workflow_status")),
    }).drop("_made")
    path = derived_path(t.spark, "benchmark-results")
    assessments.write_results(altered, path, ["claim_family"])
    stored = assessments.read_results(t.spark, path, records.schema)
    rates = benchmark_plan.evaluate(cases, stored, records, domain.facts(t), ["split"])
    return rates.select("split", "case_count", *[F.round(r, 9).alias(r) for r in RATES])


@query("denominators", """
SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(source) = 0 THEN 'source' ELSE 'lang' END AS dimension,
       coalesce(split, source, lang) AS value, count(*) AS case_count
FROM (SELECT concat('S', doc_id % 3) AS split, source, lang FROM documents) GROUP BY GROUPING SETS ((split), (source), (lang))""")
def denominators(t: Tables) -> DataFrame:
    cases = t.documents.select(F.concat(F.lit("S"), F.col("doc_id") % 3).alias("split"), "source", "lang")
    return evaluation.denominators(cases, ["split", "source", "lang"])


@query("latency_summary", """
SELECT event_type, count(value) AS sample_count, round(median(value), 3) AS p50_ms, round(quantile_disc(value, 0.95), 3) AS p95_ms,
       round(min(value), 3) AS min_ms, round(max(value), 3) AS max_ms FROM events GROUP BY event_type""")
def latency_summary(t: Tables) -> DataFrame:
    return evaluation.latency_summary(t.events, ["event_type"], "value")


SPLITS_SQL = """
keyed AS (
  SELECT DISTINCT concat('S', conv_id % 3) AS split, 'conversation' AS dimension, CAST(conv_id AS VARCHAR) AS key FROM conversations
  UNION SELECT DISTINCT concat('S', conv_id % 3), 'role', role FROM conversations
  UNION SELECT DISTINCT concat('S', conv_id % 3), 'word', unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) FROM conversations)"""


def _keys(t: Tables) -> DataFrame:
    cases = t.conversations.withColumn("split", F.concat(F.lit("S"), F.col("conv_id") % 3))
    return evaluation.partition_keys(cases, {
        "conversation": F.array("conv_id"), "role": F.array("role"), "word": text.tokens(F.col("text")),
    })


@query("split_inventory", "SELECT split, dimension, key FROM keyed", (SPLITS_SQL,))
def split_inventory(t: Tables) -> DataFrame:
    return _keys(t)


@query("split_leakage", """
SELECT dimension, key, count(DISTINCT split) AS split_count FROM keyed GROUP BY ALL HAVING count(DISTINCT split) > 1""", (SPLITS_SQL,))
def split_leakage(t: Tables) -> DataFrame:
    return evaluation.split_leakage(_keys(t))


@query("case_corpus", """
, templates AS (SELECT * FROM (VALUES (1, 'IDENTITY', 'Restate the registered name of '), (2, 'LOCATION', 'Which region lists '), (3, 'BOUNDED', 'Give a bounded memo for ')) v(no, category, head))
SELECT n_nationkey, no AS template_no, category, CASE WHEN n_regionkey = 2 THEN 'HELD_OUT' ELSE 'DEVELOPMENT' END AS split,
       head || n_name || ' in ' || r_name || '.' AS question
FROM nation JOIN region ON r_regionkey = n_regionkey, templates""", ("one AS (SELECT 1)",))
def case_corpus(t: Tables) -> DataFrame:
    subjects = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    templates = [("IDENTITY", "Restate the registered name of {name} in {region}."), ("LOCATION", "Which region lists {name} in {region}."),
                 ("BOUNDED", "Give a bounded memo for {name} in {region}.")]
    made = evaluation.case_corpus(subjects, templates, F.col("n_regionkey") == 2, {"name": F.col("n_name"), "region": F.col("r_name")})
    return made.select("n_nationkey", "template_no", "category", "split", "question")


HOLD_SQL = """
members AS (SELECT 'HELD_OUT' AS split, CAST(doc_id AS VARCHAR) AS id, sha256(concat_ws('|', doc_id, quality, toxic)) AS digest FROM labels WHERE doc_id % 3 = 1)"""


@query("holdout_freeze", "SELECT split, tree_sha256 AS held_out_sha256, member_count FROM roots", (HOLD_SQL, evidence_queries.TREE_SQL.format(key="split")))
def holdout_freeze(t: Tables) -> DataFrame:
    cases = t.labels.withColumn("split", F.when(F.col("doc_id") % 3 == 1, "HELD_OUT").otherwise("DEVELOPMENT"))
    return evaluation.holdout_freeze(cases, "doc_id", F.concat_ws("|", "doc_id", "quality", "toxic"))
