"""The operators over the test tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, chat, fim, jaccard, jpeg, licenses, neardup, packing, quality, repeats, secrets, spelling, warc
from tagloom.llm.common import read, ship

QUERIES: dict = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return fn(spark, d)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again; digests of ids and bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(read(spark, d, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_embedding_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Links, components and survivors of all vectors by cosine 0.95."""
    return neardup.near_duplicates(read(spark, d, "embeddings"))


@query
def op3_zip_warc(spark: SparkSession, d: str) -> DataFrame:
    """Every page written as a WARC record into ZIP archives, and read back from them."""
    found = warc.round_trip(spark, read(spark, d, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"),
        F.lit(said).alias("text"),
    )
    turns = read(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    out = chat.format_conversations(turns.union(tricky))
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_spans(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_all = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op6_media_jpeg(spark: SparkSession, d: str) -> DataFrame:
    """Every document stored as a JPEG and read back."""
    media = jpeg.encode_media(read(spark, d, "documents").select("doc_id", "text")).drop("text")
    return jpeg.decode_media(media).select(
        "doc_id",
        F.col("note").cast("long").alias("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumb_hash").alias("feature"),
    )


@query
def op7_license_scan(spark: SparkSession, d: str) -> DataFrame:
    """License phrases and templates in every document."""
    found = licenses.scan(read(spark, d, "documents").select("doc_id", "text")).drop("text")
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return found.withColumn("b", F.filter("matches", lambda m: m["base"])).select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform("b", lambda m: m["start"])).alias("last_word"),
        labels(F.col("b")).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


@query
def op8_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Posterior of good quality of every document: its text, its source and the language within it."""
    docs = read(spark, d, "documents")
    model = quality.train(docs, read(spark, d, "labels"))
    scored = quality.score(docs.select("doc_id", "text", "source", "lang"), model)
    return scored.select("doc_id", "evidence", "site_rate", "score", (F.col("score") >= quality.KEEP).alias("keep"))


@query
def op9_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.jaccard_components(read(spark, d, "documents"))


@query
def op10_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Secrets in every document: counts by kind, digest of the base spans, all spans."""
    found = secrets.scan(read(spark, d, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        listed("secrets").alias("spans"),
    )


@query
def op11_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the passages of 50 bytes or more that an earlier document has."""
    found = repeats.remove_repeats(read(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents, each with the near word it follows and the last of that chain."""
    return spelling.spelling_variants(read(spark, d, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and restored; digests of both."""
    pieces = fim.transform(read(spark, d, "documents").select("doc_id", "text"))
    return fim.digests(fim.restore(pieces)).select(
        "kept.doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )
