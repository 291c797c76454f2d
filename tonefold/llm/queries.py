"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefold.llm import chat, dedup, language, lm, media, mixing, oracles, packing, quality, resample, simhash, urls, variants, warc
from tonefold.llm.common import held_out, new_path, table, word_count, written


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: (host, path, verdict)
URL_LISTS = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the lists, else by rules mined from the lists' verdicts and the labels."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    given = labels.select(F.col("doc_id").alias("page_id"), F.when(bad, F.lit(urls.BLOCK)).otherwise(F.lit(urls.ALLOW)).alias("verdict"))
    return urls.judged(table(spark, sf_dir, "pages"), given, URL_LISTS).select("page_id", "host", "path", "rule", "verdict")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of those that have one."""
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4)
    model = language.fit(docs.filter(~out))
    rows = language.with_language(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents under add-one counts and under the log-bilinear model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer, counts = lm.train(docs.filter(~held_out("doc_id", 7)))
    rows = lm.scored(docs, scorer, counts)
    return rows.select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, written, read again and parsed back; with one more that holds the template's own marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = written(chat.formatted(turns.unionByName(more)), "op5-chats")
    return chat.digests(chat.read_back(chats))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, read back and indexed in order of URL and time."""
    path = new_path(spark, "op6-archives")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    runs = warc.read_runs(spark.read.format("binaryFile").load(path))
    index = warc.merged_index(warc.resolved(runs.drop("payload")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited copies among the embeddings, each drawn as a picture as no table has images, and among edits of every 50th."""
    images = media.drawn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.edited_copies(media.with_edits(images)).withColumnRenamed("image_id", "vec_id")


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of up to 2048 ids."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systematic sampling of documents to the sources' target words."""
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "op9-sizes")
    rows = mixing.with_copies(sized, F.col("words"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality ledger of documents, under the base and the full policy."""
    rows = quality.with_ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.fails(quality.BASE).alias("base_failed"), (~quality.fails(quality.FULL)).alias("kept"), "failed_bits",
    )


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the word features of the benchmark."""
    return resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its commoner near spelling."""
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_url_filter, op3_language_id, op4_score_texts, op5_format_chats, op6_warc_archive, op7_media_copies,
        op8_pack_sequences, op9_mix_sources, op10_quality_rules, op11_simhash_dedup, op12_importance_resampling, op13_spelling_variants,
    )
}
ORACLES = oracles.ORACLES
