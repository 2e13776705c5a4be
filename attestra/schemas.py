"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

PIXELS = (
    "case_id STRING, platform STRING, tile INT, item_id STRING, pixel_id BIGINT, component_order BIGINT, "
    "red_dn DOUBLE, nir_dn DOUBLE, scl INT, source_valid BOOLEAN, win STRING, acquisition BIGINT"
)

SOURCE = (
    "STRUCT<source_id: STRING, publisher: STRING, canonical_uri: STRING, accessed_on: DATE, retrieval_mode: STRING, "
    "authority_scope: STRING, source_content_sha256: STRING, source_content_bytes: BIGINT, redistribution_status: STRING>"
)
SUBJECT = "STRUCT<subject_type: STRING, subject_id: STRING, name: STRING>"
FACT = (
    "STRUCT<fact_id: STRING, text: STRING, claim_families: ARRAY<STRING>, tags: ARRAY<STRING>, subject_type: STRING, "
    "subject_id: STRING, authority_scope: STRING, assertion_key: STRING, assertion_value: VARIANT, attributes: VARIANT>"
)
EVIDENCE = (
    "document_schema_version STRING, evidence_id STRING, evidence_type STRING, "
    f"source {SOURCE}, subject {SUBJECT}, facts ARRAY<{FACT}>"
)
REQUEST = (
    "request_id STRING, subject_type STRING, subject_id STRING, claim_family STRING, question STRING, "
    "minimum_source_date DATE"
)
CLAIM_RULE = (
    "claim_family STRING, refused_code STRING, permitted_subject_types ARRAY<STRING>, required_fact_tags ARRAY<STRING>, "
    "allowed_scopes ARRAY<STRING>"
)
SOURCE_POLICY = "source_id STRING, canonical_uris ARRAY<STRING>, authority_scope STRING"

RADIOMETRY = (
    "STRUCT<scale: DOUBLE, offset: DOUBLE, quantification_value: DOUBLE, nodata: DOUBLE, metadata_source: STRING, "
    "cross_check: STRING>"
)
SCENE = (
    "win STRING, id STRING, collection STRING, platform STRING, datatake_id STRING, datetime TIMESTAMP, mgrs_tile STRING, "
    "processing_baseline STRING, processing_datetime TIMESTAMP, mean_solar_zenith_angle DOUBLE, "
    f"assets MAP<STRING, STRING>, radiometry MAP<STRING, {RADIOMETRY}>"
)
ASSET = "STRUCT<href: STRING, `proj:transform`: ARRAY<DOUBLE>>"
ITEM = (
    "STRUCT<id: STRING, collection: STRING, properties: STRUCT<platform: STRING, datetime: STRING, "
    "`s2:datatake_id`: STRING, `s2:mgrs_tile`: STRING, `sat:relative_orbit`: INT, `s2:processing_baseline`: STRING, "
    "`s2:generation_time`: STRING, `eo:cloud_cover`: DOUBLE, `s2:mean_solar_zenith`: DOUBLE, `proj:epsg`: INT>, "
    f"assets: MAP<STRING, {ASSET}>>"
)
FEATURE_COLLECTION = f"features ARRAY<{ITEM}>"
REASON = (
    "ord INT, code STRING, category STRING, allowed_statuses ARRAY<STRING>, allowed_dispositions ARRAY<STRING>, "
    "check_requirements MAP<STRING, ARRAY<STRING>>, incompatible ARRAY<STRING>"
)
ATTEMPT = (
    "run_id STRING, sequence INT, attempted_at TIMESTAMP, source_category STRING, operation STRING, attempt_number INT, "
    "request_identity STRING, method STRING, failure STRING, http_code INT"
)
CHECKPOINT = "workflow_id STRING, sequence INT, state STRING"
BOUNDARY_COORDINATES = "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
