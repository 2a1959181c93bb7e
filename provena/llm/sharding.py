"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text are a group and stay together. A group's vector is (bytes, tokens, rows), each as a share of a
shard's capacity, an equal part of the total. Groups are placed in falling order of their largest component, each
on the shard where the dot product of its vector with the residual capacity is highest, among those with room for its
bytes; where none has room, the emptiest takes it.

Placing is sequential, so its input must not grow with the data: groups with over 1/grain of all bytes (fewer than
``grain`` of them) are placed one by one, all others in ``grain`` bundles by the hash of their text. At most 2 * grain
vectors reach the driver, and their shards go back in a broadcast of that bound. A group of a third of all rows is summed
on the map side. Slots are dealt in cells of a shard by hash of id and text, so no task holds a whole shard.

The law is ``bytes``: the shards' bytes are near equal. Size is the UTF-8 bytes of the text plus 1; null is sized, hashed
and grouped as the empty text. Rows with equal id and text get neighbouring slots. Of groups of equal size the one that comes first by its
hash is placed first, and of shards with equal room the lower number takes it. An empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.llm.common import WORD, table, written

GRAIN = 16384


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (bytes, tokens, rows), which come in any order; ties go to the lower number."""
    total = np.maximum(vectors.sum(axis=0, dtype=float), 1.0)
    need = vectors * (shards / total)
    room = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int32)
    for i in np.lexsort((np.arange(len(need)), -need.max(axis=1))):
        v = need[i]
        score = np.where(room[:, 0] >= v[0], room @ v, -np.inf)
        best = int(score.argmax()) if np.isfinite(score).any() else int(room[:, 0].argmax())
        out[i] = best
        room[best] -= v
    return out


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", grain: int = GRAIN, rows_in_cell: int = 20_000) -> DataFrame:
    """Per row of ``docs``: id, size, text_crc32, tokens, text_sha256, shard and slot."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(F.col(id_col), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("tokens"), F.sha2(body, 256).alias("text_sha256")))
    groups = written(rows.groupBy("text_sha256").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    total = groups.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    limit = (total["size"] or 0) / grain
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("text_sha256"), F.lit(grain)).cast("string"))
    unit = F.when(F.col("size") > limit, F.col("text_sha256")).otherwise(bundle)
    units = groups.groupBy(unit.alias("unit")).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).toPandas().sort_values("unit", kind="stable")
    units["shard"] = place(units[["size", "tokens", "n"]].to_numpy(dtype=float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(str(u), int(s)) for u, s in zip(units["unit"], units["shard"], strict=True)], "unit string, shard int")
    large, bundles = placed.filter(F.length("unit") == 64), placed.filter(F.length("unit") < 64)
    out = rows.withColumn("_b", bundle)
    out = out.join(F.broadcast(large.select(F.col("unit").alias("text_sha256"), F.col("shard").alias("_own"))), "text_sha256", "left")
    out = out.join(F.broadcast(bundles.select(F.col("unit").alias("_b"), F.col("shard").alias("_shared"))), "_b", "left").withColumn("shard", F.coalesce("_own", "_shared"))
    cells = max(256, (total["n"] or 0) // rows_in_cell)
    out = out.withColumn("_cell", F.pmod(F.xxhash64(id_col, "text_sha256"), F.lit(cells))).drop("_b", "_own", "_shared")
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = out.groupBy("shard", "_cell").agg(F.count("*").alias("_n")).select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_cell").orderBy("text_sha256", id_col)
    out = out.withColumn("_k", F.row_number().over(within) - 1).join(starts, ["shard", "_cell"])
    return out.select(id_col, "size", "text_crc32", "tokens", "text_sha256", "shard", (F.col("_start") + F.col("_k")).cast("long").alias("slot"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
