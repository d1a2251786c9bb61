"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

Files are cut into fixed blocks, read by range in parallel. Within a block numpy finds every separator; a block gives
the ids before its first separator, the documents that lie within it, and the ids after its last one. A prefix scan
over the blocks of a file then carries open tails across block borders and numbers the documents. Ids after the last
separator of a file make a last, unterminated document. A file without ids has no document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store_fs import open_fs, read_range
from .token_store import spread

_BLOCK = "path string, block long, start long, length long"
_FOUND = "path string, block long, start long, n_ids long, ends array<long>"


def blocks_of(files: DataFrame, width: int, block_ids: int) -> DataFrame:
    """One row per block of each file in `files` (path string): path, block, start, length, in ids."""

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            paths = batch.column(0).to_pylist()
            n = [(lambda fs, path: fs.get_file_info(path).size)(*open_fs(p)) for p in paths]
            if bad := [p for p, size in zip(paths, n, strict=True) if size % width]:
                raise ValueError(f"{bad[0]}: size is no multiple of {width} bytes")
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "n": pa.array([x // width for x in n], pa.int64())})

    sized = spread(files.select("path")).mapInArrow(sizes, "path string, n long").where("n > 0")
    cut = sized.select("path", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block_ids))).alias("block"))
    return cut.select("path", F.col("block").cast("long").alias("block"), (F.col("block") * block_ids).cast("long").alias("start"), F.least(F.lit(block_ids), F.col("n") - F.col("block") * block_ids).cast("long").alias("length"))


def scan_separators(files: DataFrame, end_id: int, *, dtype: str = "<u2", block_ids: int = 1 << 21) -> DataFrame:
    """Documents of flat token files: path, ordinal (from 0 in file order), start, n_tokens (with the end id), closed.

    files: path string, one row per file. A document longer than many blocks costs a few numbers per block.
    """
    width = np.dtype(dtype).itemsize

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            for path, block, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as source:
                    ids = np.frombuffer(read_range(source, start * width, length * width), dtype)
                ends = np.flatnonzero(ids == end_id) + 1 + start
                yield pa.RecordBatch.from_pydict({"path": [path], "block": pa.array([block], pa.int64()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([length], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int64()))})

    blocks = blocks_of(files, width, block_ids)
    tasks = 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(tasks, "path", "block").mapInArrow(find, _FOUND)
    # The scan over blocks: each needs the last separator and the number of separators before it.
    by_file = Window.partitionBy("path").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "path",
        "block",
        "ends",
        (F.col("start") + F.col("n_ids")).alias("stop"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(0)).alias("open_from"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("n_before"),
        F.lead("block").over(by_file).isNull().alias("last"),
    )
    inner = stitched.select("path", "ends", "open_from", "n_before", F.posexplode("ends").alias("k", "end"))
    previous = F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1)).otherwise(F.col("open_from"))
    closed = inner.select("path", (F.col("n_before") + F.col("k")).alias("ordinal"), previous.alias("start"), (F.col("end") - previous).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = F.greatest("open_from", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)))
    rest = stitched.where(F.col("last") & (tail < F.col("stop"))).select("path", (F.col("n_before") + F.size("ends")).alias("ordinal"), tail.alias("start"), (F.col("stop") - tail).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)
