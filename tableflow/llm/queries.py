"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm import language, quality, toxicity
from tableflow.llm.common import table
from tableflow.llm.decontaminate import decontaminate
from tableflow.llm.line_rules import apply_line_rules
from tableflow.llm.near_dedup import near_duplicates
from tableflow.llm.oracles import ORACLES
from tableflow.llm.packing import pack_documents
from tableflow.llm.prefix_trie import Opening, conversation_trie
from tableflow.llm.runs import find_runs
from tableflow.llm.substring import remove_repeats
from tableflow.llm.top_products import top_products
from tableflow.llm.url_filter import Rule, filter_urls
from tableflow.llm.warc_zip import read_packages, write_packages
from tableflow.sources.scratch import scratch_dir, written

__all__ = ["ORACLES", "QUERIES", "tokenizer_file"]

TOKENIZER_FILE = "TABLEFLOW_TOKENIZER"


def tokenizer_file() -> str:
    """Path of the tokenizer: the environment's, or the installed public one."""
    if path := os.environ.get(TOKENIZER_FILE):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    result = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return result.select("doc_id", "tests.*").drop("spans", "items")


def _op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_packages(table(spark, sf_dir, "pages"), scratch_dir(spark, "packages"), describe=True)
    return read_packages(written(manifest, "manifest")[0]).drop("url", "payload", "record_id", "refers_to_record")


def _remainder(divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; -1 for no id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor, F.lit(-1))


def _op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = _remainder(4) == 2
    labelled = labels.select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labelled, "doc_id", "text", ~held_out)
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "toxicity.score",
        (F.col("toxicity.score") >= 0.3).cast("int").alias("predicted"),
        "toxicity.n_hits",
        "toxicity.n_quoted",
        "toxicity.terms",
    )


def _op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = remove_repeats(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "cut.*").drop("text_left")


def _op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


URL_RULES = (
    Rule("org/", True),
    Rule("example.org/es/", False),
    Rule("example.org/en/1", False),
    Rule("com/fr/", True),
    Rule("com/de/", False),
)


def _op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is good if the document that its path numbers is labelled good and not toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]{1,18})', 1) AS BIGINT)")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    labelled = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", good.cast("int").alias("good"))
    numbered = pages.select("page_id", number.alias("doc_id")).where("doc_id IS NOT NULL")
    return filter_urls(pages, numbered.join(labelled, "doc_id").select("page_id", "good"), URL_RULES)


def _op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = apply_line_rules(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "lines.*").drop("text_left")


def _op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
    return result.drop("token_ids").withColumnRenamed("id", "doc_id")


def _op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(3) == 1
    model = language.train(docs, "lang", "text", ~held_out & F.col("doc_id").isNotNull())
    identified = language.identify(docs.select("doc_id", "text"), model)
    return identified.select("doc_id", held_out.alias("held_out"), "mixture.*")


def _op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = _remainder(5) == 0
    labelled = labels.select("doc_id", F.col("quality").alias("label"))
    vectors = quality.train_vectors(docs, "text")
    network = quality.train(docs, labelled, vectors, "doc_id", "text", ~held_out)
    scored = quality.score_documents(docs.select("doc_id", "text"), vectors, network)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "quality.score", (F.col("quality.score") >= 0.3).cast("int").alias("predicted")
    )


def _op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)[0]


def _op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation opens with up to three turns of the first of its twenty."""
    turns = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    opening = Opening(base=F.col("conv") - F.col("conv") % 20, turns=turns)
    return conversation_trie(table(spark, sf_dir, "conversations"), opening=opening)[0]


def _repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the contract's tenth of the documents repeat a few of their words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    cut = cut.withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    cut = cut.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), CAST(1 + (n - a) div p AS INT))), 1, n - a)")
    altered = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, altered).otherwise(F.col("text")).alias("text"))


def _op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_repeated_tails(table(spark, sf_dir, "documents"))).select("doc_id", "runs.*")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("spans", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_runs"),
        *(F.col(f"strongest.{x}").alias(x) for x in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": _op1_decontaminate,
    "op2_warc_zip": _op2_warc_zip,
    "op3_toxicity": _op3_toxicity,
    "op4_substring": _op4_substring,
    "op5_near_dedup": _op5_near_dedup,
    "op6_url_filter": _op6_url_filter,
    "op7_line_rules": _op7_line_rules,
    "op8_packing": _op8_packing,
    "op9_language": _op9_language,
    "op10_quality": _op10_quality,
    "op11_top_products": _op11_top_products,
    "op12_conversation_trie": _op12_conversation_trie,
    "op13_periodic_runs": _op13_periodic_runs,
}
