"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import brown, chat, collocation, curve_packing, jaccard_tree, licenses, media, mixing, oracles, pii, quality, toxicity, warc, whitening
from stallwise.llm.common import id_fold
from stallwise.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_weights(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "uses")


def op2_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licence_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_licence_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), id_fold(F.col("doc_id"), 4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    digest = F.sha2(pii.joined(F.col("base_spans")), 256)
    return found.select("doc_id", *[count(k) for k in pii.KINDS], digest.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


#: Time from a page's capture to its revisit in op5, in units of half a page_id.
REVISIT_LAG = 2001


def page_captures(pages: DataFrame) -> DataFrame:
    """Every page as a full response, and as a later revisit that claims it has not changed since.

    By page_id modulo 4 the validators are an ETag, both, a Last-Modified, and a Last-Modified of the response alone.
    """
    tag, validator = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.col("page_id") % 4
    modified = F.when(validator != 0, F.concat(F.lit("length "), F.length("html")))
    named = lambda pairs: F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("ts"), F.lit(200).alias("status"),
        named([("ETag", F.when(validator < 2, tag)), ("Last-Modified", modified), ("Content-Type", F.lit("text/html")), ("Date", F.col("page_id").cast("string"))]).alias("headers"),
        F.col("html").alias("payload"),
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 2 + REVISIT_LAG).alias("ts"), F.lit(304).alias("status"),
        named([("etag", F.when(validator < 2, F.concat(F.lit("W/"), tag))), ("last-modified", F.when(validator != 3, modified)), ("date", F.lit("later")), ("server", F.lit("x"))]).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(revisit)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    return found.select(
        ((F.col("record_id") - 1) / 2).cast("long").alias("page_id"),
        "canonical_url",
        (F.col("base_id") / 2).cast("long").alias("base_page_id"),
        "outcome",
        F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";").alias("headers"),
        F.length("payload").cast("long").alias("payload_chars"),
        F.md5("payload").alias("payload_md5"),
    )


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), id_fold(F.col("doc_id"), 5)
    model, words = brown.fit(docs, fold != 1)
    return brown.score(docs, model, words).select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return curve_packing.pack_along_curve(table(spark, sf_dir, "documents"), path, keep_ids=False)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts_as_media(table(spark, sf_dir, "documents"))
    described = media.media_features(stored.withColumn("media_bytes", F.length("media").cast("long")))
    return described.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"))


def op9_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = F.array_contains("failed_rules", "too_few_words") | F.array_contains("failed_rules", "repeated_windows")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


#: A conversation that says the template's own marks.
PLANTED = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("conv_id", "turn", "role", "text"), row, strict=True)]) for row in PLANTED])))
    made = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))
    read = made.select("conv_id", "formatted", "valid", chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("segments")).alias("learned"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_licence_rules": op2_licence_rules,
    "op3_toxicity": op3_toxicity,
    "op4_weak_pii": op4_weak_pii,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_brown_lm": op6_brown_lm,
    "op7_curve_packing": op7_curve_packing,
    "op8_media_columns": op8_media_columns,
    "op9_jaccard_tree": op9_jaccard_tree,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_chat_format": op13_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licence_rules": oracles.licence_sql(),
    "op5_warc_revisits": oracles.revisit_sql(REVISIT_LAG),
    "op9_jaccard_tree": oracles.JACCARD_SQL,
    "op10_quality_rules": oracles.quality_sql(),
    "op12_collocations": oracles.COLLOCATION_SQL,
    "op13_chat_format": oracles.chat_sql(PLANTED),
}
