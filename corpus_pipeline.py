"""A training corpus from `documents`: rules, near duplicates, decontamination, mixing, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualspark.llm.common import materialize, packed, sized_broadcast
from qualspark.llm.decontaminate import decontaminate
from qualspark.llm.jaccard_join import BROADCAST_ROWS, jaccard_components
from qualspark.llm.mixing import emit_mix
from qualspark.llm.quality_rules import apply_quality_rules, fit_quality_rules
from qualspark.llm.queries import TOKENIZER
from qualspark.llm.token_store import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects.

    Null, empty and short texts fail the base rule and go. Rows that repeat a document are judged alike. Ties between
    rules go to the first. Rows stay whole, so columns of any name stay; an empty table stays empty.
    """
    rules = fit_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_quality_rules(packed(docs, "text"), rules).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join (five words, 0.8): the one with the smallest doc_id.

    Documents that link with nothing stay, and so do null and empty texts. Of rows that repeat a doc_id and a text one
    stays, too, as they are copies of each other. Rows without a doc_id stay where nothing in their component has one.
    """
    parts = materialize(jaccard_components(docs.select("doc_id", "text"), width=5, num=80, den=100), "pipeline-parts")
    own = packed(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_mark"))
    named = lambda rows: rows.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).distinct()
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m"))
    # A component's smallest doc_id is the row that stays. What goes is the smaller side, and is broadcast if small.
    gone = materialize(named(parts.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))), "pipeline-gone")
    left = own.join(sized_broadcast(gone, BROADCAST_ROWS), same, "left_anti")
    again = materialize(named(parts.groupBy("doc_id", "mark").count().where("count > 1")), "pipeline-repeats")
    if again.isEmpty():
        return left.select("_row.*")
    again = sized_broadcast(again, BROADCAST_ROWS)
    once = left.join(again, same, "left_semi").dropDuplicates(["_id", "_mark"])
    return left.join(again, same, "left_anti").unionByName(once).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; the whole document goes.

    Null and empty texts hold nothing and stay, as do all rows where the benchmark is empty. Rows that repeat a document
    go or stay together. Rows stay whole, so columns of any name stay; an empty table stays empty.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 3 times; a null source is one more source.

    Null and empty texts have size 0 and are sampled as others are. Rows that repeat a document are sampled each on
    their own. Columns of any name stay; an empty table stays empty.
    """
    return emit_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back: doc_id, start, n_tokens, ids_crc32, a row for each copy in doc_id order.

    Null and empty texts hold the end id alone; null doc_ids come first. Other columns are ignored; an empty table gives
    no rows.
    """
    import public_tokenizers

    return encode_documents(spark, docs, public_tokenizers.path(TOKENIZER), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token ids", token_ids),
]

#: SQL cannot express learned rules, alignment and the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
