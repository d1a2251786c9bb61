"""Helpers shared by the training-data operators: scratch tables, paths, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word in every contract here: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that separates words, as translate() and trim() take it.
SPACES = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and that no later plan reads."""
    for table in tables:
        jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def words_of(text) -> F.Column:
    """Array of the text's words (WORD), built-in functions only; null text: empty array."""
    plain = F.coalesce(text, F.lit(""))
    for space in SPACES[1:]:
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def once(df: DataFrame, name: str, value: F.Column) -> DataFrame:
    """`df` with column `name`, computed once per row: an optimizer that inlines it would compute it per array element.

    A generator over an array of one is where projections stop being merged and filters stop being pushed down.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The row as one struct `_row` beside the named columns, so that no other column of it can clash; null structs never occur."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *columns)


def rows_under(df: DataFrame, most: int) -> bool:
    """Whether `df` has at most `most` rows; reads no more than it must to tell."""
    return df.limit(most + 1).count() <= most


def sized_broadcast(df: DataFrame, most: int) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows, otherwise as it is (shuffled join)."""
    return F.broadcast(df) if rows_under(df, most) else df
