"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes the documents that the one before kept, as a stored table. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import decontamination, jaccard, line_spread, packing, toxicity
from panelmill.llm.queries import table, tokenizer_file
from panelmill.llm.shipping import ship_package
from panelmill.llm.storage import positional, stored

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; the model learns from the labels not held out."""
    ship_package(spark)
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, to="_toxicity").where(F.col("_toxicity") < TOXIC_FROM).drop("_toxicity")


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go from the texts; n_chars follows. No document goes."""
    cleaned = line_spread.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship_package(spark)
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    ship_package(spark)
    plain, at = positional(docs)
    others = [name for name in plain.columns if name != at["doc_id"]]
    found = decontamination.find_passages(
        plain, table(spark, sf_dir, "benchmark"), key=at["doc_id"], text=at["text"], keep=others
    )
    return found.where(F.size("spans") == 0).select(*plain.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left, as pieces with their places."""
    ship_package(spark)
    return packing.pack(packing.tokenised_pieces(docs, tokenizer_file("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_boilerplate),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: the classifier and the packing cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
