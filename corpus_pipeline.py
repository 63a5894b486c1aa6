"""From documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the folder that the cluster
shares and hands the written table to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm.decontaminate import without_benchmark
from rillwork.llm.language_id import of_known_language
from rillwork.llm.line_dedup import unrepeated_lines
from rillwork.llm.near_dedup import one_of_each
from rillwork.llm.packing import packed
from rillwork.llm.store import shared_dir, table

STAGES = [
    ("language_id", of_known_language),
    ("line_dedup", unrepeated_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The tokenizer's ids can't be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
