"""Ordered lines: the number and the place of each line of files that are read in many splits, and the rules of checksum lists.

Splits are read side by side. Each counts its own lines and bytes as they stream by; prefix sums over the splits of a file, some numbers each,
then turn these into places in the file. So no task reads a whole file, and lines don't move."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.functions import paths
from provena.shared import bounded, written

#: Splits whose sums are broadcast at most.
MOST_SPLITS = 200_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: path, number (from 1), start (the byte at which it starts), line (without its newline), ended (whether it has one).

    Only the last line of a file may have none; an empty file has no line. Carriage returns stay, and bytes that are no UTF-8 stay as they are."""
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select(meta.file_path.alias("path"), meta.file_size.alias("file_size"), meta.file_block_start.alias("block"), F.col("value").cast("binary").alias("line"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, start = None, 0, 0
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column("line")), 1).to_numpy(zero_copy_only=False).astype(np.int64)
            blocks, names = batch.column("block").to_numpy(zero_copy_only=False), pc.dictionary_encode(batch.column("path"))
            codes = names.indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1).tolist(), batch.num_rows]
            numbers, starts = np.arange(1, batch.num_rows + 1), np.cumsum(sizes) - sizes
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                here = (names.dictionary[int(codes[low])].as_py(), int(blocks[low]))
                if here != now:
                    now, number, start = here, 0, 0
                numbers[low:high] += number - low
                starts[low:high] += start - starts[low]
                number, start = int(numbers[high - 1]), int(starts[high - 1] + sizes[high - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(starts, pa.int64())], names=[*batch.schema.names, "number", "start"])

    lines = rows.mapInArrow(placed, "path string, file_size long, block long, line binary, number long, start long")
    end = F.col("start") + F.octet_length("line") + 1
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy(F.col("path").alias("_path"), F.col("block").alias("_block")).agg(F.max("number").alias("n"), F.max(end).alias("size"))
    sums = sums.select("_path", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("bytes_before"))
    out = lines.join(bounded(written(sums), MOST_SPLITS), (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    out = out.select("path", (F.col("number") + F.col("lines_before")).alias("number"), (F.col("start") + F.col("bytes_before")).alias("start"), F.col("line").cast("string").alias("line"), "file_size")
    return out.select("path", "number", "start", "line", (F.col("start") + F.octet_length("line") + 1 <= F.col("file_size")).alias("ended"))


#: A line of a checksum list: digest, two spaces, path.
CHECKSUM = r"(?s)\A([0-9a-f]{64})  (\S.*)\z"


def checksum_rows(lines: DataFrame) -> DataFrame:
    """``numbered_lines`` of checksum lists with sha256 and file, null for a line of another form, and the rules that a line breaks.

    Rules: form; ending (a carriage return, or no newline at the end); path (not portable); order (not strictly after the line before, in byte order, so also
    a path that comes twice in a row). The line before is found by its number, wherever it was read."""
    fine = F.col("line").rlike(CHECKSUM)
    rows = lines.withColumns({"sha256": F.when(fine, F.regexp_extract("line", CHECKSUM, 1)), "file": F.when(fine, F.regexp_extract("line", CHECKSUM, 2))})
    last = rows.select(F.col("path").alias("_path"), (F.col("number") + 1).alias("_number"), F.col("file").alias("_file"))
    rows = rows.join(last, (F.col("path") == F.col("_path")) & (F.col("number") == F.col("_number")), "left")
    rules = {"form": ~fine, "ending": ~F.col("ended") | F.contains("line", F.lit("\r")), "path": ~paths.portable(F.col("file")) & fine, "order": F.coalesce(F.col("file") <= F.col("_file"), F.lit(False))}
    faults = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*lines.columns, "sha256", "file", faults.alias("faults"))


def checksum_diff(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files against those that are there (path, sha256), closed world: file and status missing, extra, drift, match or listed twice."""
    listed = rows.filter("file IS NOT NULL").groupBy("file").agg(F.count("*").alias("n"), F.min("sha256").alias("_listed"))
    there = files.select(F.col("path").alias("file"), F.col("sha256").alias("_there"), F.lit(True).alias("_is"))
    status = F.when(F.col("n") > 1, "listed twice").when(F.col("_is").isNull(), "missing").when(F.col("n").isNull(), "extra").when(F.col("_listed") == F.col("_there"), "match").otherwise("drift")
    return listed.join(there, "file", "full_outer").select("file", status.alias("status"))
