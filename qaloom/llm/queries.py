"""The registered ``opN_`` queries of this subpackage: thin wrappers that derive the contract's columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, gam, line_quality, linkgraph, packing, sharding, simhash, spm, substrings, suffix_dedup, telephony, token_counts, trie
from .common import crc_bucket, tidy



def tokenizer(name: str) -> str:
    """Path of a public vocabulary file: in the folder that QALOOM_TOKENIZERS names, else where its package has it."""
    if folder := os.environ.get("QALOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


@tidy
def packed(docs: DataFrame) -> DataFrame:
    """Packing of whole documents, with each piece's checksum in place of its ids."""
    pieces = packing.tokenize_pieces(docs, tokenizer("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@_query
@tidy
def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


ORACLE["op6_feistel_sharding"] = sharding.oracle()


@_query
def op8_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("n_bytes"), telephony.payload_of().alias("payload"))
    rows = rows.withColumn("codec", telephony.codec_of(F.col("payload")))
    files = telephony.store_payloads(rows, "payload", "codec", ["doc_id", "n_bytes"])
    stored = files.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read = telephony.decode_media(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(";", F.concat(F.lit("codec="), "codec"), "feature", F.concat(F.lit("pcm="), F.octet_length("pcm").cast("string"), F.lit(":"), F.crc32("pcm").cast("string"))).alias("feature"),
    )


@_query
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality.measure(docs, clean=None).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


ORACLE["op7_line_quality"] = line_quality.oracle()


@_query
@tidy
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = suffix_dedup.remove_repeats(docs, words=suffix_dedup.WORDS)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words")


ORACLE["op10_suffix_dedup"] = suffix_dedup.oracle()


@_query
def op2_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_bucket("doc_id", gam.FOLDS) == 0, F.lit(False))
    return gam.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= gam.THRESHOLD).cast("int").alias("predicted"))


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return token_counts.section_counts(docs, tokenizer("byte_bpe_50k.tiktoken"), ["lang", "source"])


@_query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "text")
    coded = spm.encode(docs, model, keep=["doc_id", "text_crc32"])
    plain = spm.decode(coded.withColumn("ids_crc32", F.crc32("ids")).withColumn("n_ids", (F.octet_length("ids") / 4).cast("long")), model, keep=["doc_id", "text_crc32", "n_ids", "ids_crc32"])
    return plain.select("doc_id", "n_ids", "ids_crc32", (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


#: The rules of the URL query: (verdict, host and path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@_query
@tidy
def op9_url_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linkgraph.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return out.withColumns({c: F.round(c, 5) for c in ("trust", "distrust")})


ORACLE["op9_url_linkgraph"] = linkgraph.oracle(URL_RULES)


@_query
@tidy
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeated_runs(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op11_substring_dedup"] = substrings.oracle()


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


ORACLE["op13_source_divergence"] = divergence.oracle()


@_query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(_table(spark, sf_dir, "conversations")))


ORACLE["op12_conversation_trie"] = trie.oracle()
