"""From raw documents to packed sequences: the stages of the corpus pipeline.

Every stage takes any table with the columns of ``documents``, more columns under any names
among them, and an empty one. NULL texts count as empty ones, a NULL id, language or source
is a value like others, texts have any length. Repeated rows are one row after exact dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strayline.lineage import job
from strayline.llm.dartminhash import drop_near_copies
from strayline.llm.exact import drop_exact_copies
from strayline.llm.kneser_ney import keep_good, trusted_ids
from strayline.llm.mixing import emit_mix
from strayline.llm.packing import pack_documents
from strayline.llm.registry import ship

TOKENIZER = "word_bpe_49k.json"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is that of good ones; repeated rows stay or go together."""
    return keep_good(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; NULL and empty texts are one group."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; texts without words stay."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; one without words takes part at its source's rate."""
    return emit_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every sequence, with its token ids; a NULL or empty text is its end alone."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models, signatures and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        # A stage's own tables go once its result is written.
        with job(spark) as own:
            docs = own.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
