"""Quality family: URL rules, scans, rule rows, references, reasons, ledgers, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra import fixed_values as fixed
from attestra.functions import decision, hashing, numeric, text, uri
from attestra.operators import ledger, quality
from attestra.plans import manifest, provenance, replay
from attestra.session import derived_path
from attestra.sources import assessments
from workloads.evidence_queries import TREE_SQL
from workloads.registry import Tables, query

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("page_text_fields", """
, t AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') AS body FROM pages)
SELECT page_id, length(body) AS text_chars, contains(body, 'the') OR contains(body, 'und') AS has_token,
       nullif(regexp_extract(body, '[A-Z][a-z]+ [a-z]+', 0), '') AS first_pair FROM t""", ("one AS (SELECT 1)",))
def page_text_fields(t: Tables) -> DataFrame:
    body = text.html_text(F.col("html"))
    return t.pages.select("page_id", body.alias("body")).select(
        "page_id", F.length("body").cast("long").alias("text_chars"), text.contains_any(F.col("body"), ("the", "und")).alias("has_token"),
        text.first_match(F.col("body"), "[A-Z][a-z]+ [a-z]+").alias("first_pair"),
    )


def _identity_urls(t: Tables) -> DataFrame:
    k, page = F.col("page_id") % 9, F.col("page_id").cast("string")
    made = (
        F.when(k == 0, F.concat(F.lit("https://user@example.com/project/"), page))
        .when(k == 1, F.concat(F.lit("https://example.com/project/"), page, F.lit("#top")))
        .when(k == 2, F.concat(F.lit("https://example.com:8443/project/"), page))
        .when(k == 3, F.concat(F.lit("http://example.com/project/"), page))
        .when(k == 4, F.col("url"))
        .when(k == 5, F.concat(F.lit("https://example.com/project/"), page, F.lit("?SIG=1")))
        .when(k == 6, F.concat(F.lit("https://example.com/project/"), page, F.lit("?page=1")))
        .when(k == 7, F.lit("https://example.com/project/other"))
        .otherwise(F.concat(F.lit("https://Example.com/project/"), page))
    )
    return t.pages.select("page_id", "url", made.alias("candidate"))


@query("uri_identity", """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'USERINFO' WHEN 1 THEN 'FRAGMENT' WHEN 2 THEN 'PORT' WHEN 3 THEN 'SCHEME'
         WHEN 4 THEN CASE WHEN url LIKE '%#%' THEN 'FRAGMENT' WHEN url LIKE 'http:%' THEN 'SCHEME' ELSE 'HOST' END
         WHEN 5 THEN 'CREDENTIAL_QUERY' WHEN 6 THEN 'UNEXPECTED_QUERY' WHEN 7 THEN 'PATH_NOT_PROJECT' END AS violation,
       CASE page_id % 9 WHEN 2 THEN FALSE WHEN 4 THEN url LIKE 'https:%' AND url NOT LIKE '%?%' AND url NOT LIKE '%#%' ELSE page_id % 9 IN (7, 8) END AS stable
FROM pages""")
def uri_identity(t: Tables) -> DataFrame:
    rule = uri.identity_violation(
        F.col("candidate"), required_scheme="https", hosts=("example.com",), allowed_query=(), path_rule="PROJECT_PATH",
        path_value="/project/", stable_identifier="project", project_id=F.col("page_id").cast("string"),
    )
    return _identity_urls(t).select("page_id", rule.alias("violation"), uri.stable_reference(F.col("candidate")).alias("stable"))


@query("host_allowlist", """
, h AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), ':[0-9]+$', '') AS host FROM pages)
SELECT page_id, lower(host) AS host, url LIKE 'https:%' AND lower(host) IN (SELECT host FROM h WHERE page_id % 3 = 0) AS allowed FROM h""",
       ("one AS (SELECT 1)",))
def host_allowlist(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", "url", uri.host(F.col("url")).alias("host"))
    listed = pages.filter("page_id % 3 = 0").select("host", F.lit(True).alias("listed")).distinct()
    return pages.join(listed, "host", "left").select(
        "page_id", "host",
        ((uri.scheme(F.col("url")) == "https") & F.coalesce("listed", F.lit(False)) & ~uri.has_userinfo(F.col("url"))).alias("allowed"),
    )


def _marked(t: Tables, every: int, words: str) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.col("doc_id") % every == 0, F.concat("text", F.lit(words))).otherwise(F.col("text")).alias("text"))


@query("forbidden_language", """
SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 7 = 0 THEN ' a Multi-Year  Trend and multi-year trend.' ELSE '' END,
  '(?i)\\b(persistent|persistence|sustained\\s+vegetation\\s+development|multi-year\\s+trend|climatologically\\s+typical)\\b') AS forbidden FROM documents""")
def forbidden_language(t: Tables) -> DataFrame:
    return _marked(t, 7, " a Multi-Year  Trend and multi-year trend.").select("doc_id", text.forbidden_language(F.col("text")).alias("forbidden"))


SECRET_TEXTS = (
    (11, " C:\\Users\\someone\\key"), (13, " -----BEGIN RSA PRIVATE KEY-----"), (17, " Authorization: Bearer abcdefgh12345678"),
    (19, " api_key = 'abcdefghijklmnop'"), (23, " https://h/p?sig=abc"), (29, " value NaN here"),
)


@query("secret_scan", """
, made AS (SELECT doc_id, text""" + "".join(
    f" || CASE WHEN doc_id % {n} = 0 THEN '" + w.replace("'", "''") + "' ELSE '' END" for n, w in SECRET_TEXTS) + """ AS t FROM documents),
patterns AS (SELECT * FROM (VALUES
  ('MACHINE_PATH', '(?i)([a-z]:[\\\\/](users|documents and settings)[\\\\/][^\\\\/\\s]+)'),
  ('PRIVATE_KEY', '-----BEGIN [A-Z ]*PRIVATE KEY-----'),
  ('AUTHORIZATION_VALUE', '(?i)\\bauthorization\\s*[:=]\\s*(bearer|basic)\\s+[A-Za-z0-9+/._~-]{8,}'),
  ('CONNECTION_SECRET', '(?i)\\b(accountkey|client_secret|api[_-]?key|password)\\s*[:=]\\s*[''"]?[^\\s''"]{12,}'),
  ('CREDENTIAL_QUERY', '(?i)([?&](sig|token|sv|se|sp)=|x-amz-(credential|signature)=|authorization\\s*:)'),
  ('LOCAL_USER_PATH', '(?i)[a-z]:\\\\users\\\\'),
  ('NON_FINITE_TOKEN', '(^|[^A-Za-z])(NaN|-?Infinity)([^A-Za-z]|$)')) v(finding, pattern))
SELECT doc_id, finding FROM made, patterns WHERE regexp_matches(t, pattern)""", ("one AS (SELECT 1)",))
def secret_scan(t: Tables) -> DataFrame:
    marked = F.col("text")
    for every, words in SECRET_TEXTS:
        marked = F.concat(marked, F.when(F.col("doc_id") % every == 0, F.lit(words)).otherwise(F.lit("")))
    return quality.secret_scan(t.documents.select("doc_id", marked.alias("text")), ["doc_id"], "text")


@query("signed_url_scan", """
SELECT page_id, CASE WHEN page_id % 14 = 0 THEN 'sig,sv' ELSE 'sig' END AS names FROM pages WHERE page_id % 7 = 0 AND url NOT LIKE '%#%'""")
def signed_url_scan(t: Tables) -> DataFrame:
    joint = F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?"))
    added = F.when(F.col("page_id") % 14 == 0, F.lit("Sig=a&sv=2&sig=b")).otherwise(F.lit("sig=a"))
    urls = t.pages.select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat("url", joint, added)).otherwise(F.col("url")).alias("u"))
    return quality.signed_urls(urls, ["page_id"], "u").select("page_id", F.array_join("names", ",").alias("names"))


@query("url_redact", """
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS page_url, 'see ' || url AS note,
       'failed for ' || CASE WHEN url LIKE 'https:%' THEN regexp_replace(url, '[?#].*$', '') ELSE url END || ' twice' AS message FROM pages""")
def url_redact(t: Tables) -> DataFrame:
    """Columns lose the query of every web address; messages only that of the https ones, which are all that may be cited."""
    rows = t.pages.select(
        "page_id", F.col("url").alias("page_url"), F.concat(F.lit("see "), "url").alias("note"),
        F.concat(F.lit("failed for "), "url", F.lit(" twice")).alias("raw_message"),
    )
    return quality.redact_urls(rows).withColumn("message", uri.strip_queries_in_text(F.col("raw_message"))).drop("raw_message")


@query("non_finite", """
SELECT event_id, path FROM (SELECT event_id, unnest(CASE WHEN event_id % 14 = 0 THEN ['value', 'scaled'] WHEN event_id % 7 = 0 THEN ['value'] ELSE CAST([] AS VARCHAR[]) END) AS path FROM events)""")
def non_finite(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 14 == 0, F.lit(float("inf"))).otherwise(F.col("value") * 2).alias("scaled"),
    )
    return quality.non_finite(rows, ["event_id"], ["value", "scaled"])


@query("dq_rules", """
, broken AS (
  SELECT o_orderkey, 'created_at' AS path, 'TIME_WITHOUT_ZONE' AS rule FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 'o_orderpriority', 'NOT_IN_SET' FROM orders WHERE o_orderpriority = '3-MEDIUM'
  UNION ALL SELECT o_orderkey, 'o_totalprice', 'OUT_OF_RANGE' FROM orders WHERE o_totalprice > 300000
  UNION ALL SELECT o_orderkey, 'order_code', 'BAD_IDENTIFIER' FROM orders WHERE o_orderkey % 11 = 0)
SELECT o_orderkey, min(path) AS path, arg_min(rule, path) AS rule, count(*) AS violation_count FROM broken GROUP BY o_orderkey""",
       ("one AS (SELECT 1)",))
def dq_rules(t: Tables) -> DataFrame:
    zone = F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).when(F.col("o_orderkey") % 5 == 1, F.lit("+10:00")).otherwise(F.lit("Z"))
    rows = t.orders.withColumn("created_at", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)).withColumn(
        "order_code", F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("-bad "), "o_orderkey")).otherwise(F.concat(F.lit("O."), "o_orderkey"))
    )
    found = quality.violations(rows, ["o_orderkey"], {
        "TIME_WITHOUT_ZONE": ("created_at", numeric.zoned_timestamp(F.col("created_at")).isNull()),
        "NOT_IN_SET": ("o_orderpriority", ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW")),
        "OUT_OF_RANGE": ("o_totalprice", ~F.col("o_totalprice").between(0, 300000)),
        "BAD_IDENTIFIER": ("order_code", ~text.safe_identifier(F.col("order_code"))),
    })
    return quality.first_violation(found, ["o_orderkey"])


@query("distribution_rules", """
, spread AS (SELECT l_suppkey, count(*) AS n, quantile_cont(l_quantity, 0.05) AS q05, quantile_cont(l_quantity, 0.25) AS q25, median(l_quantity) AS med,
             quantile_cont(l_quantity, 0.75) AS q75, quantile_cont(l_quantity, 0.95) AS q95 FROM lineitem GROUP BY l_suppkey),
altered AS (SELECT l_suppkey, CASE WHEN l_suppkey % 10 = 0 THEN q95 + 1 ELSE q75 END AS q75, q25, med, q05, q95 FROM spread)
SELECT l_suppkey, 'QUANTILES_UNORDERED' AS rule FROM altered WHERE NOT (q05 <= q25 AND q25 <= med AND med <= q75 AND q75 <= q95)""", ("one AS (SELECT 1)",))
def distribution_rules(t: Tables) -> DataFrame:
    from attestra.functions import quantiles

    spread = quantiles.distribution(t.lineitem, ["l_suppkey"], "l_quantity")
    altered = spread.withColumn("q75", F.when(F.col("l_suppkey") % 10 == 0, F.col("q95") + 1).otherwise(F.col("q75")))
    return quality.distribution_violations(altered, ["l_suppkey"]).select("l_suppkey", "rule")


@query("duplicates", "SELECT text, count(*) AS occurrences FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates(t: Tables) -> DataFrame:
    return quality.duplicates(t.documents, ["text"])


@query("set_diff", """
SELECT nationkey, CASE WHEN c THEN 'MISSING' ELSE 'EXTRA' END AS difference FROM (
  SELECT nationkey, bool_or(side = 's') AS s, bool_or(side = 'c') AS c FROM (
    SELECT s_nationkey AS nationkey, 's' AS side FROM supplier WHERE s_nationkey % 6 <> 0 UNION ALL
    SELECT c_nationkey, 'c' FROM customer WHERE c_nationkey % 5 <> 0) GROUP BY 1) WHERE NOT (s AND c)""")
def set_diff(t: Tables) -> DataFrame:
    suppliers = t.supplier.filter("s_nationkey % 6 <> 0").select(F.col("s_nationkey").alias("nationkey"))
    customers = t.customer.filter("c_nationkey % 5 <> 0").select(F.col("c_nationkey").alias("nationkey"))
    return quality.set_differences(customers, suppliers, "nationkey")


@query("binding_rules", """
, allowed AS (SELECT DISTINCT c_nationkey AS case_id, c_mktsegment AS source_id FROM customer),
made AS (SELECT c_custkey % 25 AS case_id, c_mktsegment AS source_id, count(*) AS n, bool_or(c_custkey % 50 = 7) AS fabricated FROM customer GROUP BY ALL)
SELECT coalesce(a.case_id, m.case_id) AS case_id, coalesce(a.source_id, m.source_id) AS source_id,
       CASE WHEN a.case_id IS NULL THEN 'BINDING_EXTRA' WHEN m.case_id IS NULL THEN 'BINDING_MISSING' WHEN n > 1 THEN 'BINDING_DUPLICATE'
            WHEN fabricated THEN 'PENDING_WITH_CANONICAL_URI' END AS violation
FROM allowed a FULL JOIN made m ON a.case_id = m.case_id AND a.source_id = m.source_id
WHERE a.case_id IS NULL OR m.case_id IS NULL OR n > 1 OR fabricated""", ("one AS (SELECT 1)",))
def binding_rules(t: Tables) -> DataFrame:
    allowed = t.customer.select(F.col("c_nationkey").cast("long").alias("case_id"), F.col("c_mktsegment").alias("source_id")).distinct()
    pending = F.col("c_custkey") % 50 == 7
    bindings = t.customer.select(
        (F.col("c_custkey") % 25).alias("case_id"), F.col("c_mktsegment").alias("source_id"),
        F.when(pending, "PENDING_STEP_2").otherwise("FROZEN").alias("binding_status"), F.lit("https://h/a").alias("canonical_uri"),
        F.lit("https://h/b").alias("discovery_uri"),
    )
    return quality.binding_cardinality(allowed, bindings)


@query("dangling_refs", """
SELECT o_orderkey, reference FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1000]) AS reference FROM orders)
WHERE reference NOT IN (SELECT c_custkey FROM customer)""")
def dangling_refs(t: Tables) -> DataFrame:
    records = t.orders.select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_custkey") + 1000).alias("refs"))
    return quality.dangling_references(records, ["o_orderkey"], "refs", t.customer, "c_custkey")


@query("unregistered", "SELECT event_type AS name, count(*) AS uses FROM events WHERE event_type NOT IN ('view', 'click', 'error') GROUP BY 1")
def unregistered(t: Tables) -> DataFrame:
    registry = t.spark.createDataFrame([("view",), ("click",), ("error",)], "code string")
    return quality.unregistered(t.events, "event_type", registry, "code")


@query("linked_check", """
, m AS (SELECT l_orderkey AS run_id, min(l_linestatus) AS status, count(*) AS n FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY 1),
pairs AS (SELECT coalesce(o_orderkey, run_id) AS run_id, o_orderkey, o_orderstatus, m.run_id AS other, m.status, m.n FROM orders LEFT JOIN m ON o_orderkey = run_id)
SELECT run_id, 'MANIFEST_MISSING' AS mismatch FROM pairs WHERE other IS NULL
UNION ALL SELECT run_id, 'STATUS' FROM pairs WHERE other IS NOT NULL AND o_orderstatus <> status
UNION ALL SELECT run_id, 'RECORDS' FROM pairs WHERE other IS NOT NULL AND n <> 4""", ("one AS (SELECT 1)",))
def linked_check(t: Tables) -> DataFrame:
    assessments = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("a_status"), F.lit(4).cast("long").alias("a_n"))
    manifests = t.lineitem.filter("l_orderkey % 13 <> 0").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.min("l_linestatus").alias("m_status"), F.count(F.lit(1)).alias("m_n")
    )
    return quality.linked_mismatches(assessments, manifests, "run_id", {"STATUS": ("a_status", "m_status"), "RECORDS": ("a_n", "m_n")})


@query("source_binding_check", """
, b AS (SELECT o_custkey % 100 AS case_id, o_orderkey AS source_id, CASE WHEN o_orderkey % 6 = 0 THEN 'PENDING' ELSE 'FROZEN' END AS status, o_orderkey % 7 AS uri FROM orders WHERE o_orderkey % 4 <> 0),
r AS (SELECT o_custkey % 100 AS case_id, o_orderkey AS source_id, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_orderkey % 7 END AS uri FROM orders WHERE o_orderkey % 9 <> 0),
j AS (SELECT coalesce(r.case_id, b.case_id) AS case_id, coalesce(r.source_id, b.source_id) AS source_id,
        CASE WHEN b.status IS NULL THEN 'SOURCE_NOT_ALLOWED' WHEN b.status <> 'FROZEN' THEN 'BINDING_NOT_FROZEN' WHEN r.uri IS NULL THEN 'SOURCE_RECORD_MISSING'
             WHEN r.uri <> b.uri THEN 'URI_DIFFERS_FROM_BINDING' END AS violation FROM r FULL JOIN b ON r.case_id = b.case_id AND r.source_id = b.source_id)
SELECT * FROM j WHERE violation IS NOT NULL""", ("one AS (SELECT 1)",))
def source_binding_check(t: Tables) -> DataFrame:
    key, case = F.col("o_orderkey"), (F.col("o_custkey") % 100).alias("case_id")
    bindings = t.orders.filter("o_orderkey % 4 <> 0").select(
        case, key.alias("source_id"), F.when(key % 6 == 0, "PENDING").otherwise("FROZEN").alias("binding_status"), (key % 7).cast("string").alias("canonical_uri")
    )
    records = t.orders.filter("o_orderkey % 9 <> 0").select(
        case, key.alias("source_id"), F.when(key % 10 == 0, F.lit("-1")).otherwise((key % 7).cast("string")).alias("canonical_uri")
    )
    return quality.source_bindings(records, bindings)


@query("record_cardinality", """
SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS primary_count, count(*) FILTER (l_linenumber <> 1) AS sensitivity_count,
       count(*) FILTER (l_linenumber = 1) = 1 AND count(*) FILTER (l_linenumber <> 1) = 3 AS complete,
       count(DISTINCT l_returnflag) = 2 AND bool_and(l_returnflag IN ('A', 'N')) AS exact FROM lineitem GROUP BY l_orderkey""")
def record_cardinality(t: Tables) -> DataFrame:
    counts = quality.record_cardinality(t.lineitem, "l_orderkey", F.col("l_linenumber") == 1, 3)
    return counts.join(quality.exact_members(t.lineitem, ["l_orderkey"], "l_returnflag", ["A", "N"]), "l_orderkey")


@query("quality_checks", """
, runs AS (SELECT user_id, bool_or(event_type = 'error' AND value > 100) AS low, bool_or(event_type = 'purchase' AND value > 250) AS limited FROM events GROUP BY 1)
SELECT user_id, CASE WHEN limited THEN 'NOT_RUN' WHEN low THEN 'FAIL' ELSE 'PASS' END AS observation_coverage,
       CASE WHEN limited THEN 'FAIL' ELSE 'PASS' END AS system_execution, 'PASS' AS claim_contract FROM runs""", ("one AS (SELECT 1)",))
def quality_checks(t: Tables) -> DataFrame:
    code = F.when((F.col("event_type") == "error") & (F.col("value") > 100), "VALID_OBSERVATION_COVERAGE_LOW").when(
        (F.col("event_type") == "purchase") & (F.col("value") > 250), "RESOURCE_LIMIT_EXCEEDED")
    runs = t.events.groupBy("user_id").agg(F.collect_set(code).alias("codes"))
    checks = decision.quality_checks(F.col("codes"), F.lit(True))
    return runs.select("user_id", *[checks[c].alias(c) for c in ("observation_coverage", "system_execution", "claim_contract")])


@query("reason_semantics", """
, runs AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderstatus AS s FROM orders)
SELECT o_orderkey AS run_id, rule FROM (
  SELECT o_orderkey, unnest(CASE
    WHEN k = 0 THEN CASE s WHEN 'O' THEN CAST([] AS VARCHAR[]) ELSE ['STATUS_NOT_ALLOWED', 'REFUSED_WITHOUT_AUTHORITY'] END
    WHEN k = 1 THEN CASE s WHEN 'O' THEN ['STATUS_NOT_ALLOWED', 'DISPOSITION_NOT_ALLOWED', 'ABSTAINED_WITHOUT_INSUFFICIENCY', 'CHECK_STATE_NOT_ALLOWED'] ELSE ['DISPOSITION_NOT_ALLOWED', 'CHECK_STATE_NOT_ALLOWED'] END
    WHEN k = 2 THEN CASE s WHEN 'O' THEN ['UNORDERED_REASONS', 'CHECK_STATE_NOT_ALLOWED'] ELSE ['UNORDERED_REASONS', 'STATUS_NOT_ALLOWED', 'REFUSED_WITHOUT_AUTHORITY', 'CHECK_STATE_NOT_ALLOWED'] END
    WHEN k = 3 THEN CASE s WHEN 'O' THEN ['DUPLICATE_REASON'] ELSE ['DUPLICATE_REASON', 'STATUS_NOT_ALLOWED', 'REFUSED_WITHOUT_AUTHORITY'] END
    WHEN k = 4 THEN CASE s WHEN 'O' THEN ['UNKNOWN_REASON', 'ABSTAINED_WITHOUT_INSUFFICIENCY'] ELSE ['UNKNOWN_REASON', 'REFUSED_WITHOUT_AUTHORITY'] END
    ELSE CASE s WHEN 'O' THEN ['INCOMPATIBLE_REASONS', 'CHECK_STATE_NOT_ALLOWED'] ELSE ['INCOMPATIBLE_REASONS', 'STATUS_NOT_ALLOWED', 'REFUSED_WITHOUT_AUTHORITY', 'CHECK_STATE_NOT_ALLOWED'] END
  END) AS rule FROM runs)""", ("one AS (SELECT 1)",))
def reason_semantics(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    low, band = F.lit("VALID_OBSERVATION_COVERAGE_LOW"), F.lit(fixed.BAND_CODE)
    codes = (
        F.when(k == 0, F.array(low)).when(k == 1, F.array(F.lit("CAUSALITY_UNSUPPORTED"))).when(k == 2, F.array(F.lit("AOI_NO_OVERLAP"), F.lit("SOURCE_UNAVAILABLE")))
        .when(k == 3, F.array(low, low)).when(k == 4, F.array(F.lit("NOT_A_CODE"))).otherwise(F.array(low, band))
    )
    states = [F.lit("FAIL" if c == "observation_coverage" else "PASS").alias(c) for c in fixed.QUALITY_CHECKS]
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), codes.alias("reason_codes"),
        F.when(F.col("o_orderstatus") == "O", "ABSTAINED").otherwise("REFUSED").alias("execution_status"),
        F.lit("INCONCLUSIVE").alias("evidence_disposition"), F.struct(*states).alias("quality_checks"), F.lit(True).alias("human_review_required"),
    )
    return quality.reason_violations(runs)


# --- ledgers ---------------------------------------------------------------------------


@query("attempt_stats", """
SELECT user_id, count(*) AS attempt_count, arg_min(event_type, (ts, event_id)) AS first_outcome, arg_max(event_type, (ts, event_id)) AS terminal_outcome,
       '0' || CASE WHEN count(*) >= 2 THEN ',2' ELSE '' END || repeat(',5', greatest(count(*) - 2, 0)) AS delays,
       CASE WHEN count(*) = 1 THEN 0 WHEN count(*) = 2 THEN 2 ELSE 5 END AS last_delay,
       CASE WHEN count(*) = 1 THEN 0 ELSE 2 + 5 * (count(*) - 2) END AS waited_seconds, count(*) > 3 AS over_limit
FROM events GROUP BY user_id""")
def attempt_stats(t: Tables) -> DataFrame:
    made = ledger.attempt_stats(t.events, "user_id", ["ts", "event_id"], "event_type")
    return made.select("user_id", "attempt_count", "first_outcome", "terminal_outcome", "delays",
                       F.col("last_delay").cast("int").alias("last_delay"), F.col("waited_seconds").cast("long").alias("waited_seconds"), "over_limit")


@query("first_last", """
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event_id, arg_max(event_id, (ts, event_id)) AS last_event_id FROM events GROUP BY user_id""")
def first_last(t: Tables) -> DataFrame:
    return ledger.first_last(t.events, "user_id", ["ts", "event_id"], "event_id")


@query("event_ids", """
SELECT event_id, 'NET-' || left(sha256('{"event_type":"' || event_type || '","sequence":' || event_id || ',"user_id":' || user_id || '}'), 32) AS network_event_id FROM events""")
def event_ids(t: Tables) -> DataFrame:
    seed = F.format_string('{"event_type":"%s","sequence":%d,"user_id":%d}', "event_type", "event_id", "user_id")
    return t.events.select("event_id", hashing.event_id("NET-", seed).alias("network_event_id"))


@query("failure_class", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'HTTP_STATUS' WHEN 'view' THEN 'TIMEOUT' WHEN 'click' THEN 'CONNECTION_RESET' WHEN 'signup' THEN 'NORMALISED_SOURCE_UNAVAILABLE' END AS category,
       CASE WHEN event_type = 'error' THEN event_id % 3 <> 0 ELSE TRUE END AS retryable FROM events""")
def failure_class(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    failure = F.when(kind == "error", "urllib.error.HTTPError: 404").when(kind == "view", "TimeoutError").when(
        kind == "click", "URLError(ConnectionResetError)").when(kind == "signup", "OddFailure")
    http = F.when(kind == "error", F.when(F.col("event_id") % 3 == 0, 404).when(F.col("event_id") % 3 == 1, 503).otherwise(429))
    return t.events.select("event_id", ledger.transport_class(failure).alias("category"), ledger.retryable(http).alias("retryable"))


def _checkpoints(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", (F.col("turn") + 1).alias("sequence"), F.sha2(F.col("text").cast("binary"), 256).alias("state"))


@query("sequence_gaps", """
, kept AS (SELECT conv_id, turn + 1 AS sequence FROM conversations WHERE (conv_id + turn) % 5 <> 2)
SELECT conv_id, sequence FROM kept k WHERE sequence > 1 AND NOT EXISTS (SELECT 1 FROM kept p WHERE p.conv_id = k.conv_id AND p.sequence = k.sequence - 1)""",
       ("one AS (SELECT 1)",))
def sequence_gaps(t: Tables) -> DataFrame:
    kept = _checkpoints(t).filter((F.col("conv_id") + F.col("sequence") - 1) % 5 != 2)
    return ledger.sequence_gaps(kept, "conv_id", "sequence")


@query("sequence_summary", """
, kept AS (SELECT conv_id, turn + 1 AS sequence FROM conversations WHERE (conv_id + turn) % 5 <> 2)
SELECT conv_id, count(*) AS row_count, min(sequence) AS first_sequence, max(sequence) AS last_sequence,
       min(sequence) = 1 AND max(sequence) = count(*) AND count(DISTINCT sequence) = count(*) AS contiguous FROM kept GROUP BY conv_id""", ("one AS (SELECT 1)",))
def sequence_summary(t: Tables) -> DataFrame:
    kept = _checkpoints(t).filter((F.col("conv_id") + F.col("sequence") - 1) % 5 != 2)
    return ledger.sequence_summary(kept, "conv_id", "sequence").drop("distinct_sequences")


@query("latest_state", """
SELECT conv_id, max(turn) + 1 AS latest_sequence, arg_max(sha256(text), turn) AS latest_state FROM conversations GROUP BY conv_id""")
def latest_state(t: Tables) -> DataFrame:
    return ledger.latest_state(_checkpoints(t), "conv_id", "sequence", "state")


STAGE_LIST = ", ".join(f"'{s}'" for s in fixed.STAGES)


@query("stage_timeline", f"""
, s AS (SELECT o_orderkey, o_orderkey % 13 AS through, unnest([{STAGE_LIST}]) AS transformation_id, CAST(unnest(range(1, 13)) AS INT) AS sequence FROM orders)
SELECT o_orderkey, sequence, transformation_id, CASE WHEN sequence <= through OR sequence = 12 THEN 'COMPLETED' WHEN sequence = through + 1 THEN 'FAILED' ELSE 'SKIPPED' END AS status,
       CASE WHEN sequence <= through OR sequence = 12 THEN '' ELSE 'RESOURCE_LIMIT_EXCEEDED' END AS reasons FROM s""", ("one AS (SELECT 1)",))
def stage_timeline(t: Tables) -> DataFrame:
    runs = t.orders.select("o_orderkey", (F.col("o_orderkey") % 13).alias("through"), F.array(F.lit("RESOURCE_LIMIT_EXCEEDED")).alias("why"))
    return ledger.stage_timeline(runs, "o_orderkey", "through", "why").select(
        "o_orderkey", "sequence", "transformation_id", "status", F.array_join("reason_codes", ",").alias("reasons")
    )


@query("replay_compare", """
SELECT o_orderkey, o_orderkey % 20 <> 0 AND o_orderkey % 21 <> 0 AS equal FROM orders""")
def replay_compare(t: Tables) -> DataFrame:
    content = F.sha2(F.concat_ws("|", "o_orderstatus", "o_totalprice", "o_orderpriority").cast("binary"), 256).alias("digest")
    live = t.orders.select("o_orderkey", content)
    changed = t.orders.filter("o_orderkey % 21 <> 0").withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 20 == 0, F.lit("?")).otherwise(F.col("o_orderstatus"))
    )
    return ledger.replay_differences(live, changed.repartition("o_custkey").select("o_orderkey", content), ["o_orderkey"], "digest")


@query("run_identity", """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'BOUNDARY_NOT_FROZEN' WHEN o_orderkey % 7 = 0 THEN 'BOUNDARY_HASH_MISMATCH' WHEN o_orderkey % 9 = 0 THEN 'POLICY_MUTATED'
       WHEN o_orderkey % 10 = 0 THEN 'INPUT_MUTATED' END AS violation, n > 1 AS run_id_reused
FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) USING (o_custkey)""")
def run_identity(t: Tables) -> DataFrame:
    key, changed = F.col("o_orderkey"), lambda n, column: F.when(F.col("o_orderkey") % n == 0, F.lit("X")).otherwise(F.col(column))
    runs = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("run_id"), F.when(key % 8 == 0, "OTHER").otherwise("CEA").alias("boundary_role"),
        changed(7, "o_orderpriority").alias("boundary_sha256"), F.col("o_orderpriority").alias("approved_boundary_sha256"),
        F.col("o_orderstatus").alias("approved_policy_sha256"), F.col("o_orderstatus").alias("start_policy_sha256"),
        changed(9, "o_orderstatus").alias("final_policy_sha256"), F.lit("i").alias("start_input_sha256"),
        F.when(key % 10 == 0, "j").otherwise("i").alias("final_input_sha256"),
    )
    reused = ledger.reused_run_ids(runs).select("run_id", F.lit(True).alias("reused"))
    return ledger.run_identity_violations(runs).join(reused, "run_id", "left").select(
        "o_orderkey", "violation", F.coalesce("reused", F.lit(False)).alias("run_id_reused")
    )


@query("ledger_audit", """
, ev AS (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at, bool_or(l_discount = 1e-1) AS edited, bool_and(l_suppkey % 5 <> 0) AS bound, bool_and(l_partkey % 6 <> 0) AS run_ok
         FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
tr AS (SELECT l_orderkey, count(*) AS n, bool_or(l_tax = 8e-2) AS wrote FROM lineitem GROUP BY 1),
co AS (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM lineitem WHERE l_linenumber = 3 GROUP BY 1)
SELECT o_orderkey AS request_id, coalesce(co.n, 0) AS consumption_count,
  CASE WHEN ev.n IS NULL THEN 'APPROVAL_EVIDENCE_UNAVAILABLE' WHEN coalesce(tr.n, 0) = 0 OR tr.wrote OR (o_orderkey % 10 = 0 AND tr.n <> 1) THEN 'APPROVAL_EVIDENCE_NOT_INDEPENDENT'
       WHEN NOT ev.bound OR ev.edited THEN 'APPROVAL_BINDING_INVALID' WHEN NOT ev.run_ok THEN 'APPROVAL_RUN_ID_MISMATCH'
       WHEN ev.first_at < o_orderdate OR ev.last_at > o_orderdate + INTERVAL 900 DAY THEN 'APPROVAL_EXPIRED' WHEN coalesce(co.n, 0) > 1 THEN 'APPROVAL_ALREADY_CONSUMED'
       WHEN co.first_at <= ev.last_at THEN 'APPROVAL_BINDING_INVALID' WHEN co.last_at > o_orderdate + INTERVAL 900 DAY THEN 'APPROVAL_EXPIRED' END AS violation
FROM orders LEFT JOIN ev ON ev.l_orderkey = o_orderkey LEFT JOIN tr ON tr.l_orderkey = o_orderkey LEFT JOIN co ON co.l_orderkey = o_orderkey""", ("one AS (SELECT 1)",))
def ledger_audit(t: Tables) -> DataFrame:
    line = t.lineitem.withColumnRenamed("l_orderkey", "request_id")
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("expires_at"),
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(1)).alias("declared_attempts"),
    )
    evidence = line.filter("l_linenumber <= 2").select(
        "request_id", F.col("l_shipdate").alias("created_at"),
        (F.col("l_shipdate") + F.when(F.col("l_discount") == 0.1, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))).alias("updated_at"),
        (F.col("l_suppkey") % 5 != 0).alias("binds_request"), (F.col("l_partkey") % 6 != 0).alias("binds_run"),
    )
    attempts = line.select("request_id", F.when(F.col("l_tax") == 0.08, "POST").otherwise("GET").alias("method"))
    consumptions = line.filter("l_linenumber = 3").select("request_id", F.col("l_shipdate").alias("consumed_at"))
    return ledger.ledger_audit(requests, evidence, attempts, consumptions)


@query("manifest_rollup", """
SELECT run_id, record_kind, tree_sha256 AS records_sha256, member_count FROM roots""", ("""
members AS (SELECT o_orderkey AS run_id, 'source' AS record_kind, CAST(o_custkey AS VARCHAR) AS id, sha256(o_orderpriority || '|' || o_orderstatus) AS digest FROM orders
            UNION ALL SELECT l_orderkey, 'artifact', concat_ws('-', l_linenumber, l_partkey, l_suppkey), sha256(l_returnflag || '|' || l_linestatus) FROM lineitem)""",
       TREE_SQL.format(key="run_id, record_kind")))
def manifest_rollup(t: Tables) -> DataFrame:
    sources = provenance.records(t.orders, "source", F.col("o_orderkey"), F.col("o_custkey"), F.concat_ws("|", "o_orderpriority", "o_orderstatus"))
    artifacts = provenance.records(
        t.lineitem, "artifact", F.col("l_orderkey"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey"), F.concat_ws("|", "l_returnflag", "l_linestatus")
    )
    return provenance.manifest_rollup([sources, artifacts])


MANIFEST_SQL = """
m AS (SELECT *, o_orderkey AS k FROM orders),
src AS (SELECT m.k, 'SRC' || k % 6 AS id FROM m WHERE k % 7 <> 0),
steps AS (SELECT k, CASE WHEN k % 23 = 0 AND s = 12 THEN 13 ELSE s END AS sequence,
                 CASE WHEN k % 29 = 0 AND s = 2 THEN 'OTHER' ELSE ({stages})[s] END AS id, CASE WHEN k % 4 = 1 AND s = 12 THEN 'FAILED' ELSE 'COMPLETED' END AS status, s
          FROM m, (SELECT unnest(range(1, 13)) AS s)),
sol AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 2 = 1 THEN 'PRE' ELSE 'POST' END || '|' || l_partkey AS id, l_quantity <= 36 AS admitted,
               CASE WHEN l_tax = 0.08 AND l_quantity > 36 THEN 10 ELSE l_quantity * 2 END AS v,
               CASE WHEN l_quantity > 48 THEN 'OTHER' WHEN l_quantity > 36 THEN 'SOLAR_GEOMETRY_OUT_OF_RANGE' END AS reason, l_discount = 0.1 AS crossed
        FROM lineitem WHERE l_linenumber <= 3),
rad AS (SELECT l_orderkey AS k, l_partkey || '|B04' AS id, l_suppkey % 3 > 0 AS unstable, l_suppkey % 4 = 0 AS signed, l_discount = 0.1 AS crossed FROM lineitem WHERE l_linenumber = 4),
found AS (
  SELECT k, 'identity' AS kind, CAST(k AS VARCHAR) AS id, 'POLICY_HASHES_DIFFER' AS rule FROM m WHERE k % 11 = 0
  UNION SELECT k, 'identity', CAST(k AS VARCHAR), 'INPUT_HASHES_DIFFER' FROM m WHERE k % 13 = 0
  UNION SELECT k, 'identity', CAST(k AS VARCHAR), 'FIXTURE_SOFTWARE' FROM m WHERE k % 17 = 0 AND k % 2 = 0
  UNION SELECT k, 'source', id, 'UNKNOWN_SOURCE' FROM src WHERE k % 6 = 5
  UNION SELECT k, 'source', id, 'SOURCE_URI_INSECURE' FROM src WHERE k % 5 = 1
  UNION SELECT k, 'source', id, 'SOURCE_URI_CREDENTIALS' FROM src WHERE k % 5 = 2
  UNION SELECT k, 'source', id, 'SOURCE_URI_QUERY' FROM src WHERE k % 5 = 3
  UNION SELECT k, 'source', id, 'RETRIEVAL_URI_INSECURE' FROM src WHERE k % 9 = 0
  UNION SELECT k, 'source', id, 'DUPLICATE_RECORD' FROM src WHERE k % 19 = 0
  UNION SELECT k, 'radiometry', id, 'ASSET_IDENTITY_UNSTABLE' FROM rad WHERE unstable
  UNION SELECT k, 'radiometry', id, 'RETRIEVAL_CREDENTIALS' FROM rad WHERE signed
  UNION SELECT k, 'radiometry', id, 'CROSS_CHECK_NOT_PASSED' FROM rad WHERE crossed
  UNION SELECT k, 'solar', id, 'ADMITTED_BEYOND_LIMIT' FROM sol WHERE admitted AND (v > 70 OR crossed)
  UNION SELECT k, 'solar', id, 'EXCLUDED_WITHOUT_REASON' FROM sol WHERE NOT admitted AND reason = 'OTHER'
  UNION SELECT k, 'solar', id, 'OUT_OF_RANGE_WITHIN_LIMIT' FROM sol WHERE reason = 'SOLAR_GEOMETRY_OUT_OF_RANGE' AND v <= 70
  UNION SELECT k, 'solar', id, 'DUPLICATE_RECORD' FROM sol GROUP BY k, id HAVING count(*) > 1
  UNION SELECT k, 'qualification', 'V4|0.05', 'PRIMARY_NOT_FROZEN' FROM m WHERE k % 12 = 0
  UNION SELECT k, 'run', CAST(k AS VARCHAR), 'QUALIFICATION_COUNT' FROM m WHERE k % 15 = 0
  UNION SELECT k, 'transformation', sequence || '|' || id, 'UNKNOWN_TRANSFORMATION' FROM steps WHERE id = 'OTHER'
  UNION SELECT k, 'transformation', sequence || '|' || id, 'UNKNOWN_REASON' FROM steps WHERE k % 47 = 0 AND s = 7
  UNION SELECT k, 'transformation', sequence || '|' || id, 'PARAMETER_REFERENCE_UNSTABLE' FROM steps WHERE k % 31 = 0 AND s = 3
  UNION SELECT k, 'transformation', sequence || '|' || id, 'COMPLETED_WITHOUT_PARAMETERS' FROM steps WHERE k % 37 = 0 AND s = 4
  UNION SELECT k, 'transformation', sequence || '|' || id, 'COMPLETED_WITHOUT_LINEAGE' FROM steps WHERE k % 41 = 0 AND s = 5
  UNION SELECT k, 'transformation', sequence || '|' || id, 'REASON_MISSING' FROM steps WHERE status = 'FAILED' AND k % 8 = 1
  UNION SELECT k, 'transformation', sequence || '|' || id, 'UNRESOLVED_REFERENCE' FROM steps WHERE k % 43 = 0 AND s = 6
  UNION SELECT k, 'artifact', 'a1', 'DUPLICATE_RECORD' FROM m WHERE k % 53 = 0
  UNION SELECT k, 'terminal', CAST(k AS VARCHAR), 'UNRESOLVED_REFERENCE' FROM m WHERE k % 59 = 0
  UNION SELECT k, 'terminal', CAST(k AS VARCHAR), 'COMPLETED_WITH_REASONS' FROM m WHERE k % 61 = 0 AND k % 4 < 2
  UNION SELECT k, 'run', CAST(k AS VARCHAR), 'SEQUENCE_NOT_CONTIGUOUS' FROM m WHERE k % 23 = 0
  UNION SELECT k, 'run', CAST(k AS VARCHAR), 'ORDER_NOT_REGISTERED' FROM m WHERE k % 23 = 0 OR k % 29 = 0
  UNION SELECT k, 'run', CAST(k AS VARCHAR), 'COMPLETED_INCOMPLETE' FROM m WHERE k % 4 < 2 AND (k % 7 = 0 OR k % 4 = 1)
  UNION SELECT k, 'run', CAST(k AS VARCHAR), 'SOLAR_PROVENANCE_MISSING' FROM m WHERE k % 4 = 0 AND k NOT IN (SELECT k FROM sol))""".format(
    stages="[" + ", ".join(f"'{s}'" for s in fixed.STAGES) + "]")


@query("manifest_violations", "SELECT k AS run_id, kind, id AS record_id, rule FROM found", (MANIFEST_SQL,))
def manifest_violations(t: Tables) -> DataFrame:
    """Every order is a run with a manifest; each rule is broken by some of its records and kept by the others."""
    k, every = F.col("run_id"), lambda n: F.col("run_id") % n == 0
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"))
    texts = lambda *values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    identity = runs.select(
        "run_id", F.lit("p").alias("approved_policy"), F.lit("p").alias("start_policy"), F.when(every(11), "q").otherwise("p").alias("final_policy"),
        F.lit("i").alias("start_input"), F.when(every(13), "j").otherwise("i").alias("final_input"), F.when(every(2), "EXECUTION").otherwise("REPLAY").alias("runtime_mode"),
        F.array(F.lit("spark 4"), F.when(every(17), "Fixture 1").otherwise("python 3")).alias("environment"))
    addresses = texts("https://host/a", "http://host/a", "https://host/a?sig=1", "https://host/a?page=2", None)
    named = runs.filter(k % 7 != 0).select(
        "run_id", F.concat(F.lit("SRC"), k % 6).alias("source_id"), F.get(addresses, (k % 5).cast("int")).alias("canonical_uri"),
        F.when(every(9), "ftp://x/y").otherwise("https://host/r").alias("retrieval_uri"))
    named = named.unionByName(named.filter(every(19)))
    lines = t.lineitem.withColumn("run_id", F.col("l_orderkey"))
    rad = lines.filter("l_linenumber = 4").select(
        "run_id", F.col("l_partkey").cast("string").alias("item_id"), F.lit("B04").alias("asset_key"),
        F.get(texts("https://h/a", "http://h/a", "https://h/a?x=1"), (F.col("l_suppkey") % 3).cast("int")).alias("canonical_asset_identity"),
        F.when(F.col("l_suppkey") % 4 == 0, "https://h/r?sig=1").otherwise("https://h/r").alias("retrieval_uri"), F.when(F.col("l_discount") == 0.1, "FAIL").otherwise("PASS").alias("cross_check"))
    quantity = F.col("l_quantity")
    sun = lines.filter("l_linenumber <= 3").select(
        "run_id", F.when(F.col("l_linenumber") % 2 == 1, "PRE").otherwise("POST").alias("win"), F.col("l_partkey").cast("string").alias("item_id"),
        F.when((F.col("l_tax") == 0.08) & (quantity > 36), 10).otherwise(quantity * 2).alias("value"), (quantity <= 36).alias("admissible"),
        F.when(quantity > 48, "OTHER").when(quantity > 36, "SOLAR_GEOMETRY_OUT_OF_RANGE").alias("reason"), F.when(F.col("l_discount") == 0.1, "FAIL").otherwise("PASS").alias("cross_check"))
    primary = F.when(every(12), "0.05").otherwise("0.03")
    judged = runs.filter(every(3)).select("run_id", F.lit("V4").alias("policy_id"), F.posexplode(F.array(primary, F.lit("0.01"), F.lit("0.02"), F.lit("0.04"))).alias("_i", "tau"))
    judged = judged.filter(~(every(15) & (F.col("_i") == 3))).withColumn("is_primary", F.col("_i") == 0)
    at = F.col("_i") + 1
    stages = runs.select("run_id", F.posexplode(texts(*fixed.STAGES)).alias("_i", "stage"))
    failed = (k % 4 == 1) & (at == 12)
    steps = stages.select(
        "run_id", F.when(every(23) & (at == 12), 13).otherwise(at).alias("sequence"), F.when(every(29) & (at == 2), "OTHER").otherwise(F.col("stage")).alias("transformation_id"),
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), F.when(every(31) & (at == 3), "http://x").otherwise("urn:x:p").alias("parameter_ref"),
        F.when(~(every(37) & (at == 4)), F.lit("f" * 64)).alias("parameter_sha256"),
        F.when(every(41) & (at == 5), texts()).when(every(43) & (at == 6), texts("missing")).otherwise(texts("a1")).alias("inputs"), texts("a2").alias("outputs"),
        F.when(failed & (k % 8 != 1), texts("RESOURCE_LIMIT_EXCEEDED")).when(every(47) & (at == 7), texts("MADE_UP")).otherwise(texts()).alias("reason_codes"))
    made = runs.select("run_id", F.explode(F.when(every(53), texts("a1", "a1", "a2", "a3")).otherwise(texts("a1", "a2", "a3"))).alias("artifact_id"))
    ended = runs.select(
        "run_id", F.when(k % 4 < 2, "COMPLETED").otherwise("STOPPED").alias("execution_status"), F.when(every(59), "nope").otherwise("a3").alias("assessment_ref"),
        F.when(every(61), texts("RESOURCE_LIMIT_EXCEEDED")).otherwise(texts()).alias("reason_codes"))
    return manifest.violations([
        manifest.identities(identity), manifest.sources(named, [f"SRC{i}" for i in range(5)]), manifest.radiometry(rad), manifest.solar(sun),
        manifest.qualifications(judged, "V4"), manifest.transformations(steps), manifest.artifacts(made), manifest.terminals(ended)])


REPLAY_SQL = """
medians AS (SELECT l_suppkey AS run_id, median(l_quantity) FILTER (l_linenumber <= 3) AS pre, median(l_quantity) FILTER (l_linenumber > 3) AS post FROM lineitem GROUP BY 1),
live AS (SELECT run_id, post - pre AS d, 0.03 AS tau FROM medians),
later AS (SELECT run_id, CASE WHEN run_id % 7 = 0 THEN post - 2 * pre ELSE post - pre END AS d, CASE WHEN run_id % 11 = 0 THEN 9.5 ELSE 0.03 END AS tau FROM medians),
both_ AS (SELECT l.run_id, l.d = n.d AND CASE WHEN l.d > l.tau THEN 1 WHEN l.d < -l.tau THEN -1 ELSE 0 END = CASE WHEN n.d > n.tau THEN 1 WHEN n.d < -n.tau THEN -1 ELSE 0 END
                 AND l.run_id % 13 <> 0 AS result_equal FROM live l JOIN later n USING (run_id))"""


@query("replay_runs", """
SELECT run_id, run_id % 7 <> 0 AS inputs_equal, run_id % 11 <> 0 AS policy_equal, result_equal,
       CASE WHEN run_id % 7 = 0 THEN 'INPUT_ALTERED' WHEN run_id % 11 = 0 THEN 'POLICY_ALTERED' WHEN NOT result_equal THEN 'RESULT_DIFFERS' ELSE 'REPLAYED' END AS replay_status
FROM both_""", (REPLAY_SQL,))
def replay_runs(t: Tables) -> DataFrame:
    """Every supplier is a run over its lines; later some inputs, policies and results are no longer what was sealed."""
    run = F.col("run_id")
    identity = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("line")
    inputs = t.lineitem.select(F.col("l_suppkey").alias("run_id"), identity, F.when(F.col("l_linenumber") <= 3, "PRE").otherwise("POST").alias("win"), F.col("l_quantity").alias("value"))
    policies = inputs.select("run_id").distinct().withColumn("tau", F.lit("0.03"))

    def compute(rows: DataFrame, rules: DataFrame) -> DataFrame:
        of = lambda win: F.median(F.when(F.col("win") == win, F.col("value")))
        deltas = rows.groupBy("run_id").agg(of("PRE").alias("pre"), of("POST").alias("post")).withColumn("delta", numeric.exact_difference(F.col("post"), F.col("pre")))
        verdict = decision.classify(F.col("delta"), F.col("tau").cast("double"))["evidence_disposition"]
        return deltas.join(rules, "run_id").select("run_id", F.col("delta").cast("double").alias("delta"), verdict.alias("disposition"))

    what = F.concat_ws("|", "win", "value")
    sealed = replay.seal(inputs, policies, ["run_id"], "line", what, F.col("tau"))
    path = derived_path(t.spark, "sealed-results")
    results = compute(inputs, policies).withColumn("disposition", F.when(run % 13 == 0, "ALTERED").otherwise(F.col("disposition")))
    assessments.write_results(results, path, ["disposition"])
    later = inputs.withColumn("value", F.when((run % 7 == 0) & (F.col("win") == "PRE"), F.col("value") * 2).otherwise(F.col("value")))
    changed = policies.withColumn("tau", F.when(run % 11 == 0, "9.5").otherwise(F.col("tau")))
    stored = assessments.read_results(t.spark, path, results.schema)
    return replay.replay(sealed, later, changed, stored, ["run_id"], "line", what, F.col("tau"), compute)
