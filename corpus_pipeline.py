"""From raw documents to packed training sequences.

Five stages, each written as Parquet and read again as the next one's input:
toxic documents go, one document of each group of near duplicates stays,
secrets are masked, sources are mixed to target weights, and what is left is
packed into sequences. All but the last return the columns of ``documents``;
``lodestar.llm.stages`` says what each does with nulls, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import stages
from lodestar.llm.tables import written
from lodestar.session import table, tune

mask_secrets = stages.mask_secrets

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.one_per_group),
    ("secrets", mask_secrets),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: A model, a similarity join and a packing are not expressed in SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(tune(spark), sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = written(docs)
    return docs
