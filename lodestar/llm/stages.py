"""Stages of a training-data pipeline: each takes (spark, docs, sf_dir) and returns documents or packed pieces.

Every stage reads ``doc_id``, ``text``, ``lang`` and ``source`` and carries all
other columns along, whatever their names. Rows are documents of their own, also
where ids are null or repeat; null texts are kept by every filter but the draw of
the mix. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import mixing, ngram_join, packing, secret_scan, toxicity
from lodestar.llm.tables import free_name, maybe_broadcast, written
from lodestar.session import discard, table

#: Documents with this score or more go.
TOXIC = 0.7


def _place(docs: DataFrame) -> Column:
    """Name of a row that stays the same in every job over ``docs``: its file and its number there."""
    meta = docs.metadataColumn("_metadata")
    return F.concat_ws(":", F.hex(F.xxhash64(meta["file_path"])), meta["row_index"].cast("string"))


def _placed(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with the place of each row, and the copy that was written where ``docs`` are not read from files."""
    try:
        return docs.withColumn(name, _place(docs)), None
    except AnalysisException:
        copy = written(docs)
        return copy.withColumn(name, _place(copy)), copy


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``TOXIC``; learned from the labels of two thirds of the ids.

    A null or empty text has the score of a text without words; equal texts have equal scores.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold != 1))
    score = free_name("__score", docs)
    scored = model.score(docs, keep=[c for c in docs.columns if c != "doc_id"], name=score)
    return scored.filter(F.col(score) < TOXIC).select(*docs.columns)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id, nulls last; of equal ids the first by place.

    Null, empty and blank texts are alone and stay. Rows are named by their place
    in the files that they are read from, so that no second copy of them is written.
    """
    row = free_name("__row", docs)
    rows, _ = _placed(docs, row)
    grouped = written(ngram_join.ngram_join(rows, id_col=row).select(row, "component_id"))
    several = written(grouped.join(grouped.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
                                   "component_id", "left_semi"))
    discard(grouped)
    named = several.join(rows.select(row, "doc_id"), row)
    first = named.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))).alias("stays"))
    gone = written(named.join(first, "component_id").filter(F.col(row) != F.col(f"stays.{row}")).select(row))
    return rows.join(maybe_broadcast(gone), row, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mask; ``n_chars`` follows the new text.

    Null texts stay null; texts without a secret, and their ``n_chars``, stay as they are.
    """
    no_text, hit = free_name("__no_text", docs), free_name("__hit", docs)
    found = secret_scan.with_spans(
        docs.withColumn(no_text, F.col("text").isNull()), keep=[no_text, *[c for c in docs.columns if c not in ("doc_id", "text")]])
    spans = secret_scan.with_key_bodies(F.col("text"), F.col("spans"))
    masked = F.when(~F.col(f"kept_{no_text}"), secret_scan.redact(F.col("text"), spans))
    named = {"doc_id": F.col("id"), "text": masked}
    out = found.select(*[named.get(c, F.col(f"kept_{c}")).alias(c) for c in docs.columns],
                       (F.size("spans") > 0).alias(hit))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(hit), size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents in which sources, languages and topics take their reachable target shares.

    Null sources and languages are values of their own; a null or empty text goes
    by its cell's rate; rows of one id stay or go together.
    """
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in packed sequences.

    A text without words has one row without a sequence; repeated rows are packed each.
    """
    return packing.best_fit(docs)
