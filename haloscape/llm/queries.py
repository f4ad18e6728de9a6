"""The registered queries: each applies an operator, with production parameters, to its whole table and derives the contract's
columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, contamination, licenses, line_dedup, near_dup, paragraphs, prefix_trie, quality, secrets, sharding, spelling, url_filter
from .common import table

BLOCK, ALLOW = ("net/", "example.com/de/"), ("example.net/en/", "org/fr/")
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, BLOCK, ALLOW).select("page_id", "host", "path", "rule", "verdict")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(documents, 24, keep_text=False).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality.quality(documents, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language_seen", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return out.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def with_marked_conversation(conversations: DataFrame) -> DataFrame:
    """And conversation -7, whose texts hold control strings of a common template."""
    said = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


def chat_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the conversations as three sources would hold them, by their id: a record a turn; one record with all
    messages; one with from and value, under those sources' names of roles."""
    turn = F.struct(F.coalesce("turn", F.lit(0)).cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = rows.select("conv_id", turn.alias("t"), F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3)).alias("source"))
    whole = said.where("source > 0").groupBy("conv_id", "source").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.max(F.col("t.role").isin(list(chat.HUMAN))).alias("odd"))
    names = {v: k for k, v in chat.HUMAN.items()}

    def renamed(role: F.Column) -> F.Column:
        for name, given in names.items():
            role = F.when(role == name, given).otherwise(role)
        return role

    messages = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    values = F.transform("ts", lambda t: F.struct(renamed(t["role"]).alias("from"), t["text"].alias("value")))
    whole = whole.select("conv_id", F.when((F.col("source") == 1) | F.col("odd"), F.to_variant_object(F.struct(messages.alias("messages")))).otherwise(F.to_variant_object(F.struct(values.alias("conversations")))).alias("record"))
    return said.where("source = 0").select("conv_id", F.to_variant_object("t").alias("record")).unionAll(whole)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_marked_conversation(table(spark, sf_dir, "conversations"))
    out = chat.format_conversations(chat_records(rows), "conv_id")
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_mask"))
    read = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated", F.array_join("near_items", ",").alias("near_items"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE_RULES))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("bigint")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("conv_id") - F.col("conv_id") % 20
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    out = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), base, taken)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), word=spelling.with_deletions("doc_id"))
    return spelling.variants(words).select("word", "n", "n_near", "form", "form_n", "root")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filter, op2_sharding, op3_quality, op4_near_duplicates, op5_bpe, op6_substring_dedup, op7_licenses, op8_chat_format, op9_contamination, op10_secrets, op11_prefix_trie, op12_spelling_variants, op13_line_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
