"""Evidence family: documents, source policy, gates, qualification, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra import fixed_values as fixed
from attestra.functions import hashing, uri
from attestra.operators import evidence as ev
from attestra.plans import qualification
from attestra.session import derived_path
from attestra.sources import artifacts, assessments, evidence as source, registries
from workloads import domain
from workloads.registry import Tables, query


def _documents(t: Tables, repeated: Column | bool = False) -> DataFrame:
    """Evidence documents written by Spark from orders and their lines, then read back strictly."""
    # lines are dealt as they are and become facts, which are far wider, only where the documents are written
    fact = F.struct(
        "fact_id", "text", "claim_families", "tags", "subject_type", "subject_id", "authority_scope", "assertion_key",
        F.col("assertion_value"), F.col("attributes"),
    )
    partitions = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = t.lineitem.repartition(partitions, "l_orderkey")
    grouped = domain.facts(t, dealt, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(fact).alias("facts"))
    head = t.orders.select(
        "o_orderkey", F.lit("1.0.0").alias("document_schema_version"), F.col("o_orderkey").cast("string").alias("evidence_id"),
        F.lit("REGISTRY_RECORD").alias("evidence_type"),
        F.struct(
            F.concat(F.lit("SRC"), F.col("o_custkey") % 5).alias("source_id"),
            F.concat(F.lit("https://host/"), "o_orderkey").alias("canonical_uri"),
            F.col("o_orderdate").cast("date").alias("accessed_on"), F.lit("PUBLIC_REGISTRY_FACTS").alias("authority_scope"),
        ).alias("source"),
        F.struct(F.lit("ACCU_PROJECT").alias("subject_type"), F.col("o_orderkey").cast("string").alias("subject_id")).alias("subject"),
    )
    path = derived_path(t.spark, "evidence")
    made = head.join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("facts", F.coalesce("facts", F.array()))
    copies = F.when(F.lit(repeated), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    filed = made.withColumn("_copy", F.explode(copies)).drop("o_orderkey", "l_orderkey", "_copy")
    # compressed files are not split when read, so each holds a bounded number of documents
    filed.write.option("compression", "gzip").option("maxRecordsPerFile", 50_000).json(path)
    return source.read_documents(t.spark, path)


@query("evidence_scan", """
SELECT CAST(o_orderkey AS VARCHAR) AS evidence_id, concat('SRC', o_custkey % 5) AS source_id, strftime(o_orderdate, '%Y-%m-%d') AS accessed_on,
       coalesce(n, 0) AS fact_count, TRUE AS hashed, CASE WHEN o_orderkey % 50 = 0 THEN 'DUPLICATE_EVIDENCE_ID' END AS violation
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey,
     (VALUES (1), (2)) copies(copy) WHERE copy = 1 OR o_orderkey % 50 = 0""")
def evidence_scan(t: Tables) -> DataFrame:
    """Every document, with the rule that it breaks; every fiftieth is filed twice."""
    documents = source.scanned(_documents(t, F.col("evidence_id").cast("long") % 50 == 0))
    bad = source.document_violations(documents).select("evidence_id", "violation").distinct()
    return documents.select(
        F.col("document.evidence_id").alias("evidence_id"), F.col("document.source.source_id").alias("source_id"),
        F.col("document.source.accessed_on").cast("string").alias("accessed_on"), F.col("document.fact_count").cast("long").alias("fact_count"),
        (F.length("document_sha256") == 64).alias("hashed"),
    ).join(bad, "evidence_id", "left")


@query("facts_flatten", """
SELECT fact_id, subject_id AS evidence_id, authority_scope, array_to_string(tags, ',') AS tags, commit_value AS commit_attribute FROM facts""",
       (domain.FACTS_SQL,))
def facts_flatten(t: Tables) -> DataFrame:
    return source.facts(_documents(t)).select(
        "fact_id", "evidence_id", "authority_scope", F.array_join("tags", ",").alias("tags"),
        F.try_variant_get("attributes", "$.commit", "string").alias("commit_attribute"),
    )


@query("events_props_flatten", """
SELECT event_id, 'k' AS property, CAST(props::JSON ->> '$.k' AS BIGINT) AS property_value FROM events""")
def events_props_flatten(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("property", "property_value"))


@query("strict_json", """
SELECT event_id, event_id % 10 > 1 AS strict FROM events""")
def strict_json(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 10 == 0, F.lit('{"k": 1, "k": 2}')).when(
        F.col("event_id") % 10 == 1, F.lit('{"k": NaN}')).otherwise(F.col("props"))
    return t.events.select("event_id", source.strict_json(text).alias("strict"))


@query("canonical_json_rows", """
SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS canonical,
       sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS canonical_sha256 FROM events""")
def canonical_json_rows(t: Tables) -> DataFrame:
    """Written as canonical JSON files and read back as text."""
    path = derived_path(t.spark, "canonical")
    artifacts.write_canonical_json(t.events.select("user_id", "event_type", "event_id"), path)
    lines = t.spark.read.text(path).withColumnRenamed("value", "canonical")
    return lines.select(
        F.get_json_object("canonical", "$.event_id").cast("long").alias("event_id"), "canonical", hashing.sha256_text(F.col("canonical")).alias("canonical_sha256"))


@query("row_checksums", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def row_checksums(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.sha256_text(F.col("text")).alias("text_sha256"))


@query("corpus_manifest", """
SELECT source, lang, count(*) AS document_count, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, count(DISTINCT text) AS distinct_contents
FROM documents GROUP BY ALL""")
def corpus_manifest(t: Tables) -> DataFrame:
    return source.corpus_manifest(t.documents, ["source", "lang"], "text")


@query("snapshot_put", """
SELECT sha256(text) AS digest, bool_or(doc_id % 2 = 0) AS in_first_put, left(sha256(text), 1) = '0' AS corrupt FROM documents GROUP BY text""")
def snapshot_put(t: Tables) -> DataFrame:
    """Even documents are put, then all; of a copy of the store, contents whose digest begins with 0 are damaged."""
    path, damaged = derived_path(t.spark, "snapshots"), derived_path(t.spark, "damaged")
    first = source.put_snapshots(t.documents.filter("doc_id % 2 = 0"), "text", path)
    source.put_snapshots(t.documents, "text", path)
    stored = source.store_rows(t.spark, path)
    stored.withColumn("content", F.when(F.col("digest").startswith("0"), F.concat("content", F.lit("!"))).otherwise(F.col("content"))).write.parquet(damaged)
    corrupt = source.corrupt_snapshots(t.spark, damaged).select("digest", F.lit(True).alias("corrupt"))
    return stored.join(first.select("digest", F.lit(True).alias("early")), "digest", "left").join(corrupt, "digest", "left").select(
        "digest", F.coalesce("early", F.lit(False)).alias("in_first_put"), F.coalesce("corrupt", F.lit(False)).alias("corrupt")
    )


# leaves of 4,096 rows on average at most, by three hex digits here; nodes of more than two digits combine to two
TREE_SQL = """
counted AS (SELECT {key}, id || ':' || digest AS r, count(*) AS c FROM members GROUP BY ALL),
entries AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS size FROM counted),
leaves AS (SELECT {key}, left(sha256(r), CAST(size > 4096 AS INT) + CAST(size > 65536 AS INT) + CAST(size > 1048576 AS INT)) AS node,
                  sha256(string_agg(r || CASE WHEN c > 1 THEN '*' || c ELSE '' END, ',' ORDER BY r || CASE WHEN c > 1 THEN '*' || c ELSE '' END)) AS h, sum(c) AS n
           FROM entries GROUP BY ALL),
nodes AS (SELECT {key}, left(node, 2) AS node, CASE WHEN max(length(node)) > 2 THEN sha256(string_agg(node || ':' || h, ',' ORDER BY node || ':' || h)) ELSE any_value(h) END AS h,
                 sum(n) AS n FROM leaves l GROUP BY {key}, left(l.node, 2)),
roots AS (SELECT {key}, sha256(string_agg(node || ':' || h, ',' ORDER BY node || ':' || h)) AS tree_sha256, CAST(sum(n) AS BIGINT) AS member_count
          FROM nodes GROUP BY ALL)"""


@query("snapshot_hash", """
SELECT lang, tree_sha256, member_count FROM roots""",
       ("members AS (SELECT lang, CAST(doc_id AS VARCHAR) AS id, sha256(text) AS digest FROM documents)", TREE_SQL.format(key="lang")))
def snapshot_hash(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", "doc_id", hashing.sha256_text(F.col("text")).alias("digest"))
    return hashing.tree_digest(rows, ["lang"], "doc_id", "digest")


@query("memory_snapshot_hash", """
, entries AS (SELECT l_suppkey, '{"document_sha256":"' || sha256(CAST(l_extendedprice AS VARCHAR)) || '","evidence_id":"' || id || '"}' AS entry, id
              FROM (SELECT l_suppkey, l_extendedprice, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id FROM lineitem))
SELECT l_suppkey, count(*) AS document_count, sha256('[' || string_agg(entry, ',' ORDER BY id) || ']') AS memory_snapshot_sha256, count(*) > 100 AS over_limit
FROM entries GROUP BY l_suppkey""", ("one AS (SELECT 1)",))
def memory_snapshot_hash(t: Tables) -> DataFrame:
    documents = t.lineitem.select(
        "l_suppkey", hashing.sha256_text(F.col("l_extendedprice").cast("string")).alias("document_sha256"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("evidence_id"),
    )
    return hashing.snapshot_sha256(documents, ["l_suppkey"])


@query("source_allowlist", """
, pages2 AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '') AS host, url, page_id % 5 AS k FROM pages),
shaped AS (SELECT page_id, regexp_extract(host, '[^.]+[.][^.]+$') AS source_id, CASE WHEN k = 1 THEN 'http://other/' ELSE 'https://' || regexp_extract(host, '[^.]+[.][^.]+$') || '/' END AS uri,
                  CASE WHEN k = 2 THEN 'OTHER' ELSE 'PUBLIC' END AS scope, CASE WHEN k = 3 THEN 'ELSE' WHEN k = 2 THEN 'OTHER' ELSE 'PUBLIC' END AS fact_scope FROM pages2)
SELECT page_id, CASE WHEN source_id NOT IN ('example.com', 'example.org') THEN 'UNREGISTERED_SOURCE' WHEN uri <> 'https://' || source_id || '/' THEN 'URI_MISMATCH'
                     WHEN scope <> 'PUBLIC' THEN 'SOURCE_AUTHORITY_MISMATCH' WHEN fact_scope <> scope THEN 'FACT_AUTHORITY_MISMATCH' END AS violation FROM shaped""",
       ("one AS (SELECT 1)",))
def source_allowlist(t: Tables) -> DataFrame:
    k = F.col("page_id") % 5
    site = F.regexp_extract(uri.host(F.col("url")), r"([^.]+[.][^.]+)$", 1)
    documents = t.pages.select(
        "page_id", site.alias("source_id"),
        F.when(k == 1, F.lit("http://other/")).otherwise(F.concat(F.lit("https://"), site, F.lit("/"))).alias("canonical_uri"),
        F.when(k == 2, "OTHER").otherwise("PUBLIC").alias("authority_scope"),
        F.when(k == 3, "ELSE").when(k == 2, "OTHER").otherwise("PUBLIC").alias("fact_authority_scope"),
    )
    rows = [(s, [f"https://{s}/"], "PUBLIC") for s in ("example.com", "example.org")]
    policies = registries.policy_rows(t.spark, rows, "source_id string, canonical_uris array<string>, authority_scope string")
    return ev.source_violations(documents, policies).select("page_id", "violation")


@query("claim_gate", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'CAUSALITY_UNSUPPORTED' WHEN 'purchase' THEN 'FINANCIAL_DECISION_UNSUPPORTED'
       WHEN 'click' THEN 'CLAIM_NOT_BOUNDED' WHEN 'view' THEN CASE WHEN user_id % 2 = 1 THEN 'ENTITY_TYPE_MISMATCH' END END AS gate_code FROM events""")
def claim_gate(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    family = F.when(kind == "error", "CAUSAL_ATTRIBUTION").when(kind == "purchase", "FINANCIAL_ACTION").when(
        kind == "view", "REGISTRY_FACTS").when(kind == "signup", "POLICY_APPLICABILITY").otherwise("UNKNOWN_FAMILY")
    subject = F.when(F.col("user_id") % 2 == 1, "SAFEGUARD_FACILITY").otherwise("ACCU_PROJECT")
    requests = t.events.select("event_id", family.alias("claim_family"), subject.alias("subject_type"))
    return ev.claim_gate(requests, registries.claim_rules(t.spark)).select("event_id", "gate_code")


@query("tag_completeness", """
, tagged AS (SELECT user_id, event_type, CASE WHEN value > 300 THEN 'PRIVATE' ELSE 'PUBLIC' END AS scope, event_type IN ('view', 'click', 'purchase') AS chosen FROM events)
SELECT user_id, count(*) FILTER (chosen) AS selected_fact_count,
       count(DISTINCT event_type) FILTER (chosen) = 3 AS complete, coalesce(bool_and(scope = 'PUBLIC') FILTER (chosen), FALSE) AS authority_ok
FROM tagged GROUP BY user_id""", ("one AS (SELECT 1)",))
def tag_completeness(t: Tables) -> DataFrame:
    rows = t.events.select(
        "user_id", F.array("event_type").alias("tags"), F.when(F.col("value") > 300, "PRIVATE").otherwise("PUBLIC").alias("authority_scope")
    )
    required = F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))
    return ev.tag_completeness(rows, ["user_id"], required, F.array(F.lit("PUBLIC")))


@query("freshness_gate", """
SELECT o_custkey, CAST(minimum AS VARCHAR) AS minimum, CAST(min(o_orderdate::DATE) AS VARCHAR) AS oldest_source, minimum IS NULL OR min(o_orderdate::DATE) >= minimum AS fresh
FROM (SELECT o_custkey, o_orderdate, CASE WHEN o_custkey % 3 <> 0 THEN make_date(1994 + CAST(o_custkey % 5 AS INT), 6, 1) END AS minimum FROM orders) GROUP BY o_custkey, minimum""")
def freshness_gate(t: Tables) -> DataFrame:
    minimum = F.when(F.col("o_custkey") % 3 != 0, F.make_date(1994 + (F.col("o_custkey") % 5).cast("int"), F.lit(6), F.lit(1)))
    rows = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("accessed_on"), minimum.alias("minimum"))
    return ev.freshness(rows, ["o_custkey"], "minimum").select(
        "o_custkey", F.col("minimum").cast("string").alias("minimum"), F.col("oldest_source").cast("string").alias("oldest_source"), "fresh"
    )


@query("consistency", """
SELECT subject_id, bool_and(n = 1) AS consistent FROM (SELECT subject_id, assertion_key, count(DISTINCT assertion_value) AS n FROM facts
WHERE assertion_key IS NOT NULL GROUP BY ALL) GROUP BY subject_id""", (domain.FACTS_SQL,))
def consistency(t: Tables) -> DataFrame:
    return ev.consistency(domain.facts(t), ["subject_id"])


@query("request_facts", """
SELECT r.request_id, f.fact_id FROM requests r LEFT JOIN facts f
  ON r.subject_type = f.subject_type AND r.subject_id = f.subject_id AND list_contains(f.claim_families, r.claim_family)""", domain.QUALIFY_CTES)
def request_facts(t: Tables) -> DataFrame:
    return ev.request_facts(domain.requests(t), domain.facts(t)).select("request_id", "fact_id")


@query("fact_selection", """
, q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks FROM benchmark),
d AS (SELECT doc_id, doc_id % 40 AS item_id, [lang, source] AS tags, list_distinct(regexp_extract_all(lower(text || ' ' || lang || ' ' || source), '[a-z0-9]+')) AS toks FROM documents)
SELECT q.item_id, d.doc_id, 100 * len(list_intersect(d.tags, ['en', 'fr', 'src1'])) + 20 + len(list_intersect(q.toks, d.toks)) AS score
FROM q JOIN d USING (item_id) WHERE len(list_intersect(d.tags, ['en', 'fr', 'src1'])) > 0""", ("one AS (SELECT 1)",))
def fact_selection(t: Tables) -> DataFrame:
    kind = lambda key: F.concat(F.lit("K"), F.col(key) % 2).alias("subject_type")
    facts = t.documents.withColumn("subject_id", F.col("doc_id") % 40).select(
        F.col("doc_id").alias("fact_id"), kind("subject_id"), "subject_id", F.array(F.lit("F0"), F.lit("F1")).alias("claim_families"),
        F.array("lang", "source").alias("tags"), "text",
    )
    requests = t.benchmark.select(
        F.col("item_id").alias("request_id"), kind("item_id"), F.col("item_id").alias("subject_id"),
        F.concat(F.lit("F"), F.col("item_id") % 2).alias("claim_family"), F.col("text").alias("question"),
    )
    rows = [(family, ["en", "fr", "src1"]) for family in ("F0", "F1")]
    rules = registries.policy_rows(t.spark, rows, "claim_family string, required_fact_tags array<string>")
    return ev.scored_facts(ev.request_facts(requests, facts), rules).select(
        F.col("request_id").alias("item_id"), F.col("fact_id").alias("doc_id"), "score"
    )


QUALIFY_SQL = """
, selected AS (
  SELECT f.subject_type, f.subject_id, r.claim_family, f.*, r.required_tags, list_intersect(f.tags, r.required_tags) AS hit,
         list_contains(r.allowed_scopes, f.authority_scope) AS scope_ok
  FROM facts f JOIN rules r ON list_contains(f.claim_families, r.claim_family)),
chosen AS (SELECT * FROM selected WHERE len(hit) > 0),
conflicts AS (SELECT subject_type, subject_id, claim_family, bool_and(n = 1) AS consistent FROM
  (SELECT subject_type, subject_id, claim_family, assertion_key, count(DISTINCT assertion_value) AS n FROM chosen WHERE assertion_key IS NOT NULL GROUP BY ALL) GROUP BY ALL),
tags AS (SELECT subject_type, subject_id, claim_family, count(DISTINCT tag) AS n_tags FROM
  (SELECT subject_type, subject_id, claim_family, unnest(hit) AS tag FROM chosen) GROUP BY ALL),
gathered AS (SELECT subject_type, subject_id, claim_family, count(*) AS n, bool_and(scope_ok) AS authority_ok, min(accessed_on) AS oldest,
  bool_or(role = 'INTEGRITY' AND commit_value = 'c0') AND bool_or(role = 'OBSERVATION' AND run_value = 'r0') AS bound,
  min(reason_code) FILTER ((role = 'INTEGRITY' AND commit_value = 'c0') OR (role = 'OBSERVATION' AND run_value = 'r0')) AS observed FROM chosen GROUP BY ALL),
flags AS (
  SELECT q.*, r.refused_code, NOT list_contains(r.subject_types, q.subject_type) AS mismatch, coalesce(g.n, 0) > 0 AS has_facts, g.observed,
         coalesce(c.consistent, TRUE) AS consistent, q.claim_family <> 'OBSERVATIONAL_CONSISTENCY' OR coalesce(g.bound, FALSE) AS frozen,
         q.minimum_source_date IS NULL OR coalesce(g.oldest >= q.minimum_source_date, FALSE) AS fresh, coalesce(g.authority_ok, FALSE) AS authority,
         coalesce(t.n_tags, 0) = len(r.required_tags) AS complete
  FROM requests q JOIN rules r USING (claim_family) LEFT JOIN gathered g USING (subject_type, subject_id, claim_family)
  LEFT JOIN conflicts c USING (subject_type, subject_id, claim_family) LEFT JOIN tags t USING (subject_type, subject_id, claim_family)),
judged AS (
  SELECT *, CASE WHEN refused_code IS NOT NULL THEN refused_code WHEN mismatch THEN 'ENTITY_TYPE_MISMATCH' WHEN NOT has_facts THEN 'REQUIRED_EVIDENCE_MISSING'
     WHEN NOT consistent THEN 'EVIDENCE_CONFLICT_UNRESOLVED' WHEN NOT frozen THEN 'PROVENANCE_HASH_MISMATCH' WHEN NOT fresh THEN 'EVIDENCE_TEMPORAL_MISMATCH'
     WHEN NOT authority THEN 'EVIDENCE_SOURCE_NOT_ALLOWED' WHEN NOT complete THEN 'REQUIRED_EVIDENCE_MISSING' ELSE '' END AS failure FROM flags)
"""


@query("qualify_requests", QUALIFY_SQL + """
SELECT request_id, claim_family,
       CASE WHEN refused_code IS NOT NULL THEN 'REFUSED' WHEN failure <> '' OR claim_family = 'POLICY_APPLICABILITY' THEN 'ERROR'
            WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN 'ABSTAINED' ELSE 'QUALIFIED' END AS workflow_status,
       CASE WHEN failure <> '' OR claim_family = 'POLICY_APPLICABILITY' THEN NULL WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN 'INCONCLUSIVE' ELSE 'SUPPORTED' END AS qualification,
       CASE WHEN failure <> '' THEN failure WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN observed
            WHEN claim_family = 'POLICY_APPLICABILITY' THEN 'DETERMINISTIC_PROCESSING_ERROR' ELSE '' END AS reasons,
       CASE WHEN refused_code IS NOT NULL OR mismatch THEN 'PASS,FAIL,NOT_RUN,NOT_RUN,NOT_RUN,NOT_RUN,NOT_RUN,PASS,NOT_RUN,PASS'
            ELSE concat_ws(',', 'PASS', 'PASS', CASE WHEN has_facts THEN 'PASS' ELSE 'FAIL' END, CASE WHEN authority THEN 'PASS' ELSE 'FAIL' END,
              CASE WHEN complete THEN 'PASS' ELSE 'FAIL' END, CASE WHEN fresh THEN 'PASS' ELSE 'FAIL' END, CASE WHEN consistent THEN 'PASS' ELSE 'FAIL' END, 'PASS',
              CASE WHEN failure = '' AND claim_family <> 'OBSERVATIONAL_CONSISTENCY' THEN 'NOT_RUN' WHEN frozen THEN 'PASS' ELSE 'FAIL' END, 'PASS') END AS checks
FROM judged""", domain.QUALIFY_CTES)
def qualify_requests(t: Tables) -> DataFrame:
    rules = registries.claim_rules(t.spark)
    gathered = qualification.gather(domain.facts(t), rules, domain.BINDINGS, role=F.col("role"))
    results = qualification.qualify(domain.requests(t), gathered, rules)
    checks = F.array_join(F.array(*[F.col(f"assurance_checks.{c}") for c in fixed.ASSURANCE_CHECKS]), ",")
    return results.select(
        "request_id", "claim_family", "workflow_status", "qualification", F.array_join("reason_codes", ",").alias("reasons"), checks.alias("checks")
    )


@query("evidence_references", QUALIFY_SQL + """
SELECT q.request_id, row_number() OVER (PARTITION BY q.request_id ORDER BY
         100 * len(c.hit) + 20 + len(list_intersect(list_distinct(regexp_extract_all(lower(q.question), '[a-z0-9]+')),
           list_distinct(regexp_extract_all(lower(c.text || ' ' || array_to_string(c.tags, ' ')), '[a-z0-9]+')))) DESC, c.fact_id) AS fact_rank,
       c.fact_id, c.authority_scope
FROM requests q JOIN chosen c USING (subject_type, subject_id, claim_family)""", domain.QUALIFY_CTES)
def evidence_references(t: Tables) -> DataFrame:
    rules = registries.claim_rules(t.spark)
    pairs = ev.request_facts(domain.requests(t), domain.facts(t))
    return ev.ranked_facts(ev.scored_facts(pairs, rules)).select(
        "request_id", F.col("fact_rank").cast("long").alias("fact_rank"), "fact_id", "authority_scope"
    )


RANKED_SQL = """
, ranked AS (SELECT q.request_id, c.*, row_number() OVER (PARTITION BY q.request_id ORDER BY
         100 * len(c.hit) + 20 + len(list_intersect(list_distinct(regexp_extract_all(lower(q.question), '[a-z0-9]+')),
           list_distinct(regexp_extract_all(lower(c.text || ' ' || array_to_string(c.tags, ' ')), '[a-z0-9]+')))) DESC, c.fact_id) AS fact_rank
  FROM requests q JOIN chosen c USING (subject_type, subject_id, claim_family)),
firsts AS (SELECT request_id, string_agg(fact_id, ',' ORDER BY fact_rank) AS refs,
  arg_min(struct_pack(part, supp, line), fact_rank) FILTER (list_contains(tags, 'project_identity')) AS p,
  arg_min(struct_pack(part, supp, line), fact_rank) FILTER (list_contains(tags, 'facility_identity')) AS f,
  arg_min(struct_pack(part, supp, line), fact_rank) FILTER (list_contains(tags, 'frozen_observation') AND line = 2) AS o FROM ranked GROUP BY request_id),
memory AS (SELECT request_id, sha256('[' || string_agg('{"document_sha256":"' || sha256(subject_id) || '","evidence_id":"' || subject_id || '"}', ',') || ']') AS snapshot
  FROM (SELECT DISTINCT request_id, subject_id FROM ranked) GROUP BY request_id),
stated AS (SELECT j.*, refs, snapshot, failure = '' AND claim_family <> 'POLICY_APPLICABILITY' AS passed, CASE
    WHEN claim_family = 'REGISTRY_FACTS' THEN 'The CER public record identifies P' || j.subject_id || ' as N' || p.part || ', a M' || p.supp || ' project in L' ||
      CASE WHEN p.line % 3 <> 0 THEN p.line END || ', with model start date not listed. This is a registry-fact restatement, not a project-quality conclusion.'
    WHEN claim_family = 'SAFEGUARD_FACILITY_FACTS' THEN 'For the R' || f.supp || ' Safeguard publication, the CER record lists F' || f.part || ' with baseline emissions B' || f.supp ||
      ', covered emissions C' || f.part || ', and S' || f.supp || ' in the SMCs-issued field. This restates one cited CSV row; the repository does not independently prove an issuance event. It is a facility-period record, not an ACCU project record or a general prediction of future SMC eligibility.'
    WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN 'For ' || j.subject_id || ', the frozen Step 2B assessment recorded PRE median NDVI a' || o.part || ', POST median NDVI b' || o.part ||
      ', and POST-minus-PRE delta d' || o.supp || '. Under the frozen primary tau of t' || o.supp || ', the evidence disposition is INCONCLUSIVE. This is a bounded observational result and does not establish causality, carbon quantity, credit quality, compliance, or financial suitability.'
    END AS statement
  FROM judged j LEFT JOIN firsts USING (request_id) LEFT JOIN memory USING (request_id))
"""


def records(t: Tables) -> DataFrame:
    rules, requests = registries.claim_rules(t.spark), domain.requests(t)
    pairs = domain.request_pairs(t, ev.asked_requests(requests, rules)).select(
        "*", F.lit("SRC").alias("source_id"), F.concat(F.lit("https://host/"), "evidence_id").alias("canonical_uri"),
        hashing.sha256_text(F.col("evidence_id")).alias("document_sha256"))
    gathered = qualification.request_evidence(pairs, domain.BINDINGS, role=F.col("role"))
    return qualification.request_records(requests, gathered, rules, ["Restates public records."], ["No carbon quantity."])


@query("qualification_results", QUALIFY_SQL + RANKED_SQL + """
SELECT request_id, CASE WHEN refused_code IS NOT NULL THEN 'REFUSED' WHEN NOT passed OR statement IS NULL THEN 'ERROR'
            WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN 'ABSTAINED' ELSE 'QUALIFIED' END AS workflow_status,
       CASE WHEN passed AND statement IS NULL THEN 'REQUIRED_FIELD_MISSING' WHEN failure <> '' THEN failure WHEN NOT passed THEN 'DETERMINISTIC_PROCESSING_ERROR'
            WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN observed ELSE '' END AS reasons,
       CASE WHEN passed THEN statement END AS bounded_statement, CASE WHEN passed AND statement IS NOT NULL THEN refs END AS reference_ids,
       CASE WHEN passed AND statement IS NOT NULL THEN 'SRC|https://host/' || subject_id || '|' || sha256(subject_id) END AS first_reference,
       refs AS traced_ids, snapshot AS memory_snapshot_sha256 FROM stated""", domain.QUALIFY_CTES)
def qualification_results(t: Tables) -> DataFrame:
    ids = lambda refs: F.array_join(F.transform(refs, lambda r: r["fact_id"]), ",")
    first = F.get(F.col("evidence_refs"), F.lit(0))
    return records(t).select(
        "request_id", "workflow_status", F.array_join("reason_codes", ",").alias("reasons"), "bounded_statement", ids(F.col("evidence_refs")).alias("reference_ids"),
        F.when(first.isNotNull(), F.concat_ws("|", first["source_id"], first["canonical_uri"], first["document_sha256"])).alias("first_reference"),
        F.array_join("retrieval_trace.selected_fact_ids", ",").alias("traced_ids"), "memory_snapshot_sha256")


@query("result_hash_check", "SELECT o_orderkey AS request_id FROM orders WHERE o_orderkey % 11 = 0")
def result_hash_check(t: Tables) -> DataFrame:
    """Results stored, one in eleven altered afterwards, and checked when read back."""
    path = derived_path(t.spark, "results")
    altered = F.when(F.col("request_id") % 11 == 0, F.lit("ALTERED")).otherwise(F.col("workflow_status"))
    made = records(t)
    assessments.write_results(made.withColumn("workflow_status", altered), path, ["claim_family"])
    return qualification.result_hash_violations(assessments.read_results(t.spark, path, made.schema))


@query("frozen_binding", """
SELECT subject_id, coalesce(bool_or(role = 'INTEGRITY' AND commit_value = 'c0'), FALSE) AS integrity_bound,
       coalesce(bool_or(role = 'OBSERVATION' AND run_value = 'r0'), FALSE) AS observation_bound FROM facts GROUP BY subject_id""", (domain.FACTS_SQL,))
def frozen_binding(t: Tables) -> DataFrame:
    flags = ev.frozen_flags(F.col("role"), F.col("attributes"), domain.BINDINGS)
    return domain.facts(t).select("subject_id", *flags).groupBy("subject_id").agg(
        F.bool_or("frozen_0").alias("integrity_bound"), F.bool_or("frozen_1").alias("observation_bound")
    )


@query("packet_match", """
SELECT user_id, count(*) AS member_count, NOT (user_id % 10 = 0 AND bool_or(event_type = 'error')) AS hash_match FROM events GROUP BY user_id""")
def packet_match(t: Tables) -> DataFrame:
    content = F.concat_ws("|", "event_type", "value", "props")
    other = t.events.filter(~((F.col("user_id") % 10 == 0) & (F.col("event_type") == "error")))
    left = ev.packets(t.events, ["user_id"], "event_id", content)
    return ev.packet_match(left, ev.packets(other, ["user_id"], "event_id", content), ["user_id"])


@query("size_caps", """
SELECT doc_id, 'QUESTION_CHARS' AS cap, length(text) AS actual FROM documents WHERE length(text) > 2000
UNION ALL SELECT doc_id, 'DOCUMENT_BYTES', strlen(text) FROM documents WHERE strlen(text) > 10000""")
def size_caps(t: Tables) -> DataFrame:
    return ev.size_violations(t.documents, "doc_id", {
        "QUESTION_CHARS": (F.length("text"), fixed.MAX_QUESTION_CHARS), "DOCUMENT_BYTES": (F.octet_length("text"), 10_000),
    })


@query("registry_dims", """
SELECT n_name AS key, 'DUPLICATE' AS violation FROM (SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 7 = 0) GROUP BY n_name HAVING count(*) > 1
UNION ALL SELECT n_name, 'EXTRA' FROM nation WHERE n_nationkey >= 20
UNION ALL SELECT 'NATION_X', 'MISSING'""")
def registry_dims(t: Tables) -> DataFrame:
    path = derived_path(t.spark, "registry")
    t.nation.unionByName(t.nation.filter("n_nationkey % 7 = 0")).write.json(path)
    schema = "n_nationkey INT, n_name STRING, n_regionkey INT"
    registry = registries.read_registry(t.spark, path, schema, multi_line=False)
    return registries.registry_violations(registry, "n_name", [*(f"NATION_{i}" for i in range(20)), "NATION_X"])


@query("artifact_records", """
, paths AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['', '.zip', '.xml', '.npy', '.npz', '.md', '.TXT', '.json', '.raw'][page_id % 9 + 1] AS p FROM pages)
SELECT page_id, concat('urn:run:artifact:', p) AS artifact_id, trim(regexp_replace(upper(p), '[^A-Z0-9]+', '_', 'g'), '_') AS artifact_type,
       CASE WHEN p LIKE '%.zip' THEN 'application/zip' WHEN p LIKE '%.xml' THEN 'application/xml' WHEN p LIKE '%.npy' OR p LIKE '%.npz' THEN 'application/x-numpy'
            WHEN p LIKE '%.md' OR p LIKE '%.TXT' OR p LIKE '%.raw' THEN 'text/plain' ELSE 'application/json' END AS media_type FROM paths""", ("one AS (SELECT 1)",))
def artifact_records(t: Tables) -> DataFrame:
    suffixes = F.array(*[F.lit(s) for s in ("", ".zip", ".xml", ".npy", ".npz", ".md", ".TXT", ".json", ".raw")])
    ending = F.element_at(suffixes, (F.col("page_id") % 9 + 1).cast("int"))
    paths = t.pages.select("page_id", F.concat(uri.strip_query(F.col("url")), ending).alias("p"))
    return artifacts.artifact_records(paths, "p", F.lit("run"), "page_id")


@query("file_checksums", """
SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS total_bytes, 1 AS differences FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)""")
def file_checksums(t: Tables) -> DataFrame:
    """A tree of files and its manifest; then one more file comes, which the manifest lacks."""
    folder, manifest = derived_path(t.spark, "tree"), derived_path(t.spark, "checksums")
    t.documents.repartition(8, "doc_id").select("text").write.text(folder)
    artifacts.write_checksums(artifacts.file_checksums(t.spark, folder), manifest)
    t.benchmark.select("text").coalesce(1).write.mode("append").text(folder)
    actual = artifacts.file_checksums(t.spark, folder)
    found = artifacts.checksum_differences(artifacts.read_checksums(t.spark, manifest), actual)
    total = actual.select(F.col("bytes"), F.lit(0).alias("difference"))
    wrong = found.select(F.lit(0).cast("long").alias("bytes"), F.lit(1).alias("difference"))
    return total.unionByName(wrong).agg(F.sum("bytes").alias("total_bytes"), F.sum("difference").cast("int").alias("differences"))
