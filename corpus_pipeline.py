"""A training corpus from raw documents: quality, near-duplicates, decontamination, personal data, tokens."""

from pyspark.sql import DataFrame, SparkSession

from ridgelog.llm.decontam import clean_documents
from ridgelog.llm.pii import redacted
from ridgelog.llm.quality import accepted, fit_rules
from ridgelog.llm.queries import MODEL_PATH, table
from ridgelog.llm.simhash import one_of_each
from ridgelog.llm.sptok import encode, read_model
from ridgelog.session import checkpointed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, calibrated with ``labels``."""
    return accepted(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    return redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_ids, exact)``: the documents as ids of the SentencePiece model."""
    return encode(docs, read_model(MODEL_PATH))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("SentencePiece", tokens),
]

#: the forest, the fingerprints and the tokenizer have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
