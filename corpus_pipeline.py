"""A corpus from documents to a training mixture: five operators, each on what its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrazzo.llm.common import remove_folder, shared_folder, table
from terrazzo.llm.decontam import drop_contaminated
from terrazzo.llm.exact_dedup import drop_exact
from terrazzo.llm.mixing import mixed
from terrazzo.llm.quality import fit_quality_model, keep_good
from terrazzo.llm.simhash import drop_near

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null texts count as empty; without labels of both kinds all stay."""
    return keep_good(docs, fit_quality_model(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, whatever the rows' ids; null texts equal empty ones."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one stays, by row and not by id."""
    return drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; an empty benchmark leaves all."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents with the number of times that each occurs; null sources and languages count as empty names."""
    return mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: The classifier is beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each but the last is written to the shared folder and read again; once a stage is written,
    what it read is removed, so that one stage's rows are kept at a time."""
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{number}")
            docs = spark.read.parquet(f"{top}/{number}")
            if number:
                remove_folder(spark, f"{top}/{number - 1}")
    return docs
