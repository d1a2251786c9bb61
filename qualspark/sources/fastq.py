"""FASTQ files with four lines a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..jobs.tables import materialize


#: Pieces of files (a row each) whose first line numbers are sent to all tasks.
MOST_PIECES = 1_000_000


def _edges(batches):
    """Per piece of a file (a partition's lines of it): how many lines it has, its first three and its last three."""
    import pyarrow as pa

    held: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, part, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            piece = held.setdefault((file, part), [0, [], []])
            piece[0] += 1
            if len(piece[1]) < 3:
                piece[1].append(value)
            piece[2] = [*piece[2][-2:], value]
    lines = pa.list_(pa.string())
    columns = zip(*((f, p, n, a, z) for (f, p), (n, a, z) in held.items()), strict=True) if held else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), lines, lines), strict=True)], ["file", "part", "n", "firsts", "lasts"])


def _whole(batches):
    """Records whose four lines a piece holds, from its lines in order (file, number of its first line, value)."""
    import pyarrow as pa

    at: dict[str, int] = {}
    open_at: dict[str, list[str]] = {}
    for batch in batches:
        rows = []
        for file, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            line = at.setdefault(file, start)
            at[file] = line + 1
            if line % 4 == 0:
                open_at[file] = []
            if (lines := open_at.get(file)) is not None:
                lines.append(value)
                if line % 4 == 3:
                    rows.append((line // 4, *lines))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if k else pa.int64()) for k, c in enumerate(columns)], ["rec", "head", "seq", "plus", "qual"])


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(rec, name, comment, seq, qual); rec is the record's ordinal in its file, the name ends at the first white space.

    Pieces of a file count their lines; their running sums, one row per piece, tell each piece where its records begin, and
    it puts together all that lie within it. Only the records cut by the edges of pieces, one a piece, are gathered from
    their lines. So the text is read twice and its lines are never shuffled. Blank lines at the end are no record. A record
    whose marks are not @ and +, or whose sequence and qualities differ in length, fails.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("part"), "value")
    pieces = materialize(text.mapInArrow(_edges, "file string, part int, n long, firsts array<string>, lasts array<string>"), "fastq-pieces")
    if pieces.limit(MOST_PIECES + 1).count() > MOST_PIECES:
        raise ValueError("too many pieces of files: raise spark.sql.files.maxPartitionBytes")
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(pieces.select("file", "part", "n", "firsts", "lasts", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "fastq-starts")
    placed = text.join(F.broadcast(starts.select("file", "part", "start")), ["file", "part"]).select("file", "start", "value")
    whole = placed.mapInArrow(_whole, "rec long, head string, seq string, plus string, qual string")
    # A piece's lines before its first whole record and after its last one.
    lead, tail = (4 - F.col("start") % 4) % 4, (F.col("start") + F.col("n")) % 4
    line = lambda x, at: F.struct(at.cast("long").alias("line"), x.alias("value"))
    ahead = F.filter(F.transform("firsts", lambda x, k: line(x, F.col("start") + k)), lambda x: x["line"] < F.col("start") + lead)
    behind = F.filter(F.transform("lasts", lambda x, k: line(x, F.col("start") + F.col("n") - F.size("lasts") + k)), lambda x: x["line"] >= F.col("start") + F.col("n") - tail)
    cut = starts.select("file", F.explode(F.array_distinct(F.concat(ahead, behind))).alias("x")).select("file", "x.*")
    field = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    edge = cut.groupBy("file", F.floor(F.col("line") / 4).alias("rec")).agg(*(field(k).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual")))).drop("file")
    records = whole.unionByName(edge).where(F.concat_ws("", "head", "seq", "plus", "qual") != "")
    fine = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    head = F.when(fine, F.substring(F.col("head"), 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("not a record of four lines: "), F.coalesce("head", F.lit("")))))
    parts = F.split(head, r"\s+", 2)
    return records.select("rec", F.element_at(parts, 1).alias("name"), F.try_element_at(parts, F.lit(2)).alias("comment"), "seq", "qual")


def fastq_text(reads: DataFrame) -> DataFrame:
    """One `value` per read, its four lines, in order of rec; comments are dropped. reads: rec, name, seq, qual."""
    value = F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), "seq", F.lit("+"), "qual")
    return reads.orderBy("rec").select(value.alias("value"))


def write_fastq(reads: DataFrame, path: str) -> None:
    """Text files under `path` that in name order hold the reads in order of rec."""
    fastq_text(reads).write.text(path)
