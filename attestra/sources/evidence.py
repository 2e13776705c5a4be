"""Evidence documents: strict JSON to rows, facts, manifests and the snapshot store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestra import fixed_values as fixed
from attestra.functions.hashing import sha256_text
from attestra.schemas import EVIDENCE
from attestra.session import cut_lineage


def strict_json(text: Column) -> Column:
    """True for standard JSON: no duplicate keys, no NaN or infinities."""
    return F.try_parse_json(text).isNotNull()


def read_documents(spark: SparkSession, path: str, *, one_per_file: bool = False) -> DataFrame:
    """Documents with their content hash and size; malformed ones keep a NULL ``document``."""
    raw = spark.read.text(path, wholetext=one_per_file).withColumn("path", F.col("_metadata.file_path"))
    parsed = F.from_json("value", EVIDENCE, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    return raw.select(
        "path", F.octet_length("value").alias("document_bytes"), sha256_text(F.col("value")).alias("document_sha256"),
        F.when(strict_json(F.col("value")), parsed).alias("document"),
    )


def scanned(documents: DataFrame) -> DataFrame:
    """Each document with its identity, source and number of facts, written once: whatever is asked of the rows, a text is read and parsed a single time."""
    head = F.struct("document.evidence_id", "document.source", F.size("document.facts").alias("fact_count"))
    return cut_lineage(documents.select("path", "document_bytes", "document_sha256", F.when(F.col("document").isNotNull(), head).alias("document")))


def document_violations(documents: DataFrame, max_bytes: int = fixed.MAX_EVIDENCE_BYTES) -> DataFrame:
    """Malformed or oversized documents and evidence ids used twice."""
    identifier = F.col("document.evidence_id")
    single = documents.select(
        identifier.alias("evidence_id"), "path",
        F.explode(F.array_compact(F.array(
            F.when(identifier.isNull(), F.lit("MALFORMED_DOCUMENT")),
            F.when(F.col("document_bytes") > max_bytes, F.lit("DOCUMENT_TOO_LARGE")),
        ))).alias("violation"),
    )
    repeated = (
        documents.filter(identifier.isNotNull()).groupBy(identifier.alias("evidence_id"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path")).filter("_n > 1")
        .select("evidence_id", "path", F.lit("DUPLICATE_EVIDENCE_ID").alias("violation"))
    )
    return single.unionByName(repeated)


def facts(documents: DataFrame) -> DataFrame:
    """One row per fact, carrying evidence id, source and document hash."""
    return documents.filter("document IS NOT NULL").select(
        F.col("document.evidence_id").alias("evidence_id"), "document_sha256", F.col("document.source").alias("source"),
        F.inline("document.facts"),
    )


def corpus_manifest(documents: DataFrame, kinds: list[str], text: str) -> DataFrame:
    """Documents, bytes and distinct contents per subject kind."""
    return documents.groupBy(*kinds).agg(
        F.count(F.lit(1)).alias("document_count"), F.sum(F.octet_length(text)).alias("total_bytes"),
        F.count_distinct(F.sha2(F.col(text).cast("binary"), 256)).alias("distinct_contents"),
    )


# --- content-addressed store ------------------------------------------------------


def store_rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("digest STRING, content STRING").parquet(path)
    except AnalysisException:
        return None


def put_snapshots(contents: DataFrame, content: str, path: str) -> DataFrame:
    """Append contents whose digest the store lacks; the same bytes again are a no-op.

    Returns the rows that were added.
    """
    spark = contents.sparkSession
    keyed = contents.select(sha256_text(F.col(content)).alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"])
    stored = store_rows(spark, path)
    new = keyed if stored is None else keyed.join(stored.select("digest"), "digest", "left_anti")
    added = cut_lineage(new)
    added.write.mode("append").parquet(path)
    return added


def corrupt_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows whose content no longer has the digest it is stored under."""
    return store_rows(spark, path).filter(sha256_text(F.col("content")) != F.col("digest"))
