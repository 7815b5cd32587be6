"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every historical version of a path is content-addressed. The ledger, Parquet in a shared
folder, knows which (blob, rule version) pairs were scanned and what was found; a scan reads
only unseen pairs, and findings are joined back to all paths that ever held the blob.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_key
from .spans import SpanRule, attach, hits

# The base patterns.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE_KINDS = ["assign", "access", "hex"]
BASE_RULES = [
    SpanRule("assign", ASSIGN, "[:=]", lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= 8),
    SpanRule("access", "AKIA[A-Z0-9]{12,}+", "AKIA"),
    SpanRule("hex", "[0-9a-f]{32,}+", "[0-9a-f]{32}"),
]
#: Kinds beyond the base: heads of private keys, and signed web tokens.
MORE_RULES = [
    SpanRule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY"),
    SpanRule("jwt", "eyJ[A-Za-z0-9_-]{8,}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", "eyJ"),
]
RULES = BASE_RULES + MORE_RULES
#: What a change of how findings are made, not of the rules, adds to.
RULE_VERSION = "secrets-1"


def rule_version(rules: list[SpanRule]) -> str:
    """A version that differs for other rules: by their kinds, patterns and conditions."""
    hit = F.col("hit")
    told = [(r.kind, r.pattern, r.prefilter, str(r.keep(hit)) if r.keep else "") for r in rules]
    return f"{RULE_VERSION}-{hashlib.sha256(repr(told).encode()).hexdigest()[:16]}"

SCANNED = "blob string, rule_version string"
FOUND = "blob string, kind string, kind_order int, start long, end long, hit string, rule_version string"


def _ledger(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = f"{folder}/{name}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan(versions: DataFrame, ledger: str, rules: list[SpanRule] = RULES, text: str = "text") -> DataFrame:
    """Brings the ledger up to date with `versions` and returns the findings of all its blobs under these rules.

    A blob that the ledger has under these rules isn't read again; equal versions are one blob, and other rules have another version.
    Null and empty texts have no findings; an empty table leaves the ledger as it is. Findings are appended
    before the blobs count as scanned, so a run that breaks off is repeated and repeats are dropped on reading.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    seen = _ledger(spark, ledger, "scanned", SCANNED).filter(F.col("rule_version") == version).select("blob")
    fresh = versions.select(text_key(F.col(f"`{text}`")).alias("blob"), F.col(f"`{text}`").alias("_text")).filter("_text <> ''")
    unseen = fresh.join(seen, "blob", "left_anti").groupBy("blob").agg(F.first("_text").alias("_text"))
    found = hits(unseen, "blob", "_text", rules).select("blob", "kind", "kind_order", "start", "end", "hit", F.lit(version).alias("rule_version"))
    found.write.mode("append").parquet(f"{ledger}/found")
    fresh.select("blob").join(seen, "blob", "left_anti").distinct().withColumn("rule_version", F.lit(version)).write.mode("append").parquet(f"{ledger}/scanned")
    return _ledger(spark, ledger, "found", FOUND).filter(F.col("rule_version") == version).dropDuplicates(["blob", "kind", "start", "end"])


def findings_by_path(versions: DataFrame, found: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each finding and each path whose text, in any version, is the finding's blob."""
    return versions.select(path, text_key(F.col(f"`{text}`")).alias("blob")).distinct().join(found, "blob")


def with_digest(versions: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Every version row with counts, digest and spans of its text; repeated rows stay, and so does a column `blob`."""
    rows = versions.withColumn("_blob", text_key(F.col(f"`{text}`")))
    return attach(rows, found.withColumnRenamed("blob", "_blob"), "_blob", BASE_KINDS).drop("_blob", "found_spans")
