"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor.  All but the last return the columns of
``documents``.  A row is known by its id and its text (``xxhash64`` of it), so verdicts on one text never touch another text under the same id.
An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haloscape.llm import bpe, contamination, near_dup, quality, secrets
from haloscape.llm.common import discard, materialize, scope, table
from haloscape.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: By the general rule for stages on word shingles: five words, a similarity of 0.8.
FOREST = near_dup.Forest(k=5)


def same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash"))


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))


#: What a row is known by, without nulls, so that equal rows meet by plain equality.
KEYS = ["unnamed", "named", "text_hash"]


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"unnamed": F.col("doc_id").isNull(), "named": F.coalesce("doc_id", F.lit(0))})


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and blank texts are rejected, repeated rows judged alike, null languages judged by the
    nearest reference.  Clashing extra columns aren't returned."""
    return quality.quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, once: the one with the smallest id that isn't null, of several texts under it the one with the
    smallest hash.  Null and blank texts are copies of nothing; of rows that are equal in id and text one stays."""
    found = near_dup.near_duplicates(docs.select("doc_id", "text"), forest=FOREST).select("doc_id", "text_hash", "component")
    groups = materialize(found, "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    keepers = groups.where("component is not null").groupBy("component").agg(first.alias("k"))
    stays = F.col("component").isNull() | (F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash")))
    judged = groups.join(keepers, "component", "left").groupBy("doc_id", "text_hash").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("copies"))
    verdicts = materialize(keyed(judged.where("not stays or copies > 1")).select(*KEYS, "stays", "copies"), "verdicts")
    # texts are shuffled once, at every size: repeated rows then stand together, in the order that the join leaves
    met = keyed(hashed(docs)).hint("merge").join(verdicts, KEYS, "left").where("stays is null or stays")
    again = F.count(F.lit(1)).over(Window.partitionBy(*KEYS).rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("again", again).where("copies is null or copies = 1 or again = 1").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts hold none, and repeated rows and texts under one id are judged each on its own."""
    found = contamination.matched(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = materialize(found.where("n_hit > 0").select(F.col("id").alias("doc_id"), F.col("th").alias("text_hash")), "gone")
    return hashed(docs).alias("d").join(contamination.small(gone, gone.count()).alias("g"), same_row("d", "g"), "left_anti").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and ``n_chars`` follows; texts without any, null ones too, stay as they are."""
    found = secrets.scan(docs.select(*COLUMNS))
    n_chars = F.when(F.size("spans") > 0, F.length("redacted").cast("bigint")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of what they decode to; a null text has no tokens."""
    out = bpe.tokenize(docs.select("doc_id", "text", "lang", "source"), tokenizer_path())
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]
#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages.  A stage's scratch tables, and its predecessor's table, go as soon as its own table is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for n, (name, stage) in enumerate(STAGES):
        if n == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scope() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs
