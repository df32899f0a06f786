"""From raw documents to packed training sequences: five stages, each one operator.

Every stage reads the table that the stage before it wrote. A stage that judges documents removes whole
rows; a stage that judges lines or words changes ``text`` and ``n_chars``. All but the last
return the columns of ``documents``, in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm.common import free_name, table, without_ids
from tableflow.llm.decontaminate import decontaminate
from tableflow.llm.line_rules import apply_line_rules
from tableflow.llm.near_dedup import near_duplicates
from tableflow.llm.packing import pack_documents
from tableflow.llm.queries import tokenizer_file
from tableflow.llm.substring import remove_repeats
from tableflow.sources.scratch import drop_scratch, written


#: Words of a shingle and the limit of the near_dedup stage; op5's own are those of its query.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``columns`` with another text and its length in characters."""
    new = {"text": text, "n_chars": F.when(text.isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))}
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule are removed; documents that the rules reject go."""
    into = free_name(docs, "lines")
    judged = apply_line_rules(docs, with_text=True, into=into).where(F.col(f"{into}.kept"))
    return _with_text(judged, docs.columns, F.col(f"{into}.text_left"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest id stays, one without an id last.

    Linked are rows whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.
    Where ids are missing or repeated, rows get numbers of their own first, so that copies among these rows
    are found too. A blank text has no near copies; of blank rows with one id, one stays.
    """
    limits = {"shingle": NEAR_SHINGLE, "percent": NEAR_PERCENT}
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        dropped, _ = written(near_duplicates(docs, **limits).where("NOT kept").select("id"), "dropped")
        return without_ids(docs, "doc_id", dropped)
    number = free_name(docs, "row")
    rows, _ = written(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    ids = rows.select(F.col(number).alias("id"), "doc_id")
    blank = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = F.struct(blank.alias("blank"), F.when(blank, F.col("doc_id")).otherwise(F.col("component_id")).alias("of"))
    grouped, path = written(near_duplicates(rows, number, **limits).join(ids, "id").withColumn("group", group), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("id")))
    kept = grouped.groupBy("group").agg(first.alias("first")).select("first.id")
    dropped, _ = written(grouped.join(kept, "id", "left_anti").select("id"), "dropped")
    drop_scratch(spark, path)
    return without_ids(rows, number, dropped).select(*[f"`{c}`" for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated windows are cut; a document that loses all its words stays, with an empty text."""
    into = free_name(docs, "cut")
    cut = remove_repeats(docs, with_text=True, into=into)
    left = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.col(f"{into}.text_left"))
    return _with_text(cut, docs.columns, left)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by passages of the benchmark go."""
    into = free_name(docs, "tests")
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"), into=into)
    return judged.where(~F.col(f"{into}.contaminated")).select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training sequence."""
    return pack_documents(docs, tokenizer_file()).drop("token_ids").withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the packing nor the ids of a tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the table is written and read again.

    A stage's table is dropped once the next one is written. The last stage reads its input when the result
    is used, so that table stays until the caller drops scratch tables.
    """
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, *last)
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
