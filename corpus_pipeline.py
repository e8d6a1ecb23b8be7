"""A training corpus from ``documents``: toxicity, near duplicates, personal data, mix, packing.

Each stage works on all that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import curve_packing, jaccard_tree, mixing, pii, toxicity
from stallwise.session import checkpoint, table

TOXIC = 0.3
#: Near duplicates share so many percent of their runs of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the classifier learns from the labelled ones among ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=None, column="_toxicity").where(F.col("_toxicity") < TOXIC).drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component; of its repeated rows one.

    Linked are documents whose five-word shingles have a Jaccard similarity of 0.8 or more, which is wider than op9's rule.

    Documents without words link with nothing and stay.
    """
    return jaccard_tree.first_of_components(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.find_pii(docs, pii.fit(docs), base="_base_spans", spans="_spans")
    redacted = pii.redact(found, spans="_spans")
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.size("_spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return redacted.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    return curve_packing.pack_along_curve(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Training, search for links and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, with a checkpoint between them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
