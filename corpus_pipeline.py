"""From raw documents to token ids in five stages, each one of the training-data operators of ``tessella.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read again as the next
stage's docs. All but the last return the columns of ``documents``.

1. toxicity: documents that the compression-distance classifier rejects go.
2. simhash: of each group of near duplicates, the document of the smallest id stays. Texts are in one group where operator 3 links them, or where their
   five-word shingles have a Jaccard similarity of 0.8 or more (``near_copies``: candidates miss no pair, each is verified).
3. decontaminate: documents with a window of a benchmark item go.
4. pii: personal data is masked by its kind in brackets; ``n_chars`` follows the text.
5. pieces: the text becomes SentencePiece ids, whose count, checksum and round trip are returned.

Null or empty texts, empty tables, repeated rows: see each operator's docstring; none of them stops the pipeline. A null text
passes the filters of stages 1 and 3, takes part in stage 2 as an empty text, and stays null in stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, near_copies, pieces, pii, simhash, toxicity
from tessella.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By operator 3 alone."""
    return simhash.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs, groups=simhash.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.mask(docs, pii.learn(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("pieces", encode_pieces),
]

#: The classifier, the tagger and the segmentation have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
