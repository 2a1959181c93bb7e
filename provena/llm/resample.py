"""Importance resampling towards a target distribution of hashed features (JVM-side functions only).

A feature is a run of words, its bucket the CRC-32 modulo the number of buckets. Two counts, over the corpus and over the target,
give each bucket a gain, the logarithm of how much likelier the target makes it. Only those totals shuffle: buckets are counted
on the map side, so at most one row a bucket leaves a task, and at most one row a bucket reaches the driver, which makes the
gains a literal array. Scoring then explodes nothing: higher-order functions make a document's array of buckets and add up
``element_at`` of the gains over it.

The draw is a Gumbel top-k: each document gets noise from the SHA-256 of seed and id, and the highest sums are drawn. The scores
are whole numbers in a narrow range (under 40,000 thousandths of logarithm units either way for up to 10^17 features, plus noise
between -3,112 and 22,874), so their histogram has at most ~110,000 rows, whatever the input. It comes to the driver, which finds the
score at the cut and the number of documents above each score. Ranks within a score are row numbers by id, so no
task sorts all that is drawn: noise spreads even equal texts, and no score has over about 1/2,700 of the documents.

Edge cases: null, empty and wordless texts have no features, weight 0 and, as they are under the least number of words, no rank; a null
id counts as no digits for the noise and comes after all ids in ties; rows that tie in score and id are ordered by
features, weight and then in any order, so ranks are always 1, 2, 3...; repeated rows are each scored and drawn on their own; an
empty target has gains by the corpus alone; an empty corpus gives no rows. Columns named as those of the result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.llm.common import kept_after, table, written
from provena.llm.decontaminate import words_of
from provena.llm.middle import draw

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024


def buckets_of(words: Column, longest: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to ``longest`` words (a column of its own, not an expression: lambdas compute it anew)."""
    bucket = lambda feature: (F.crc32(feature) % buckets).cast("int")
    runs = [F.transform(words, bucket)]

    def of(n: int) -> Column:
        heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(heads, lambda w, i: bucket(F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, n)])))

    runs += [of(n) for n in range(2, longest + 1)]
    return runs[0] if longest == 1 else F.flatten(F.array(*runs))


def bucket_totals(texts: DataFrame, text: str, longest: int, buckets: int) -> list[int]:
    """How many features of a table are in each bucket."""
    words = texts.select(words_of(F.col(f"`{text}`")).alias("_words")).select(buckets_of(F.col("_words"), longest, buckets).alias("_buckets"))
    totals = [0] * buckets
    for row in words.select(F.explode_outer("_buckets").alias("bucket")).groupBy("bucket").count().filter("bucket IS NOT NULL").collect():
        totals[row["bucket"]] = row["count"]
    return totals


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Per bucket: floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))), for B buckets and totals S and T, in doubles."""
    b, s_all, t_all = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000.0 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(corpus, target, strict=True)]


def scored(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text: str = "text", longest: int = 1, seed: int = SEED) -> DataFrame:
    """``docs`` with n_words, n_features, weight (floored mean of gains) and score (weight and noise), all long."""
    added = ("n_words", "n_features", "weight", "score")
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded to a literal when planned
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), words_of(F.col(f"`{text}`")).alias("_words"))
    out = out.withColumn("_buckets", buckets_of(F.col("_words"), longest, len(gain)))
    out = out.select("_row", "_id", F.size("_words").cast("long").alias("n_words"), F.size("_buckets").cast("long").alias("n_features"), F.aggregate("_buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal, b + 1)).alias("_sum"))
    # exact in whole numbers: the remainder of the floored division goes first
    weight = F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((draw(str(seed), F.col("_id"), 1) + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    out = out.withColumns({"weight": weight, "_noise": noise}).withColumn("score", F.col("weight") + F.col("_noise"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)


def ranked(rows: DataFrame, id_col: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` rows with rank: 1, 2, 3... over floor(percent * N / 100) of the N rows with enough words, else null.

    ``rows`` are read twice; give a written table where they are costly to make."""
    spark, fit = rows.sparkSession, F.col("n_words") >= least_words
    histogram = sorted(((r["score"], r["n"]) for r in kept_after(rows, fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    most = percent * sum(n for _, n in histogram) // 100
    above, before = [], 0
    for score, n in histogram:
        if before >= most:
            break
        above.append((score, before))
        before += n
    rank = F.lit(None).cast("long")
    if not above:
        return rows.withColumn("rank", rank)
    cut = above[-1][0]
    high = kept_after(rows, fit & (F.col("score") >= cut)).withColumn("_score", F.col("score"))
    high = high.join(F.broadcast(spark.createDataFrame(above, "_at long, _before long")), F.col("_score") == F.col("_at"))
    within = Window.partitionBy("_score").orderBy(F.col(f"`{id_col}`").asc_nulls_last(), "n_features", "weight")
    high = high.withColumn("_rank", F.col("_before") + F.row_number().over(within)).withColumn("rank", F.when(F.col("_rank") <= most, F.col("_rank")))
    rest = kept_after(rows, ~(fit & (F.col("score") >= cut))).withColumn("rank", rank)
    return high.select(*rows.columns, "rank").unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn documents, whole, with n_words, n_features, weight, score and rank. Only they shuffle, not the corpus."""
    gain = gains(bucket_totals(docs, text, longest, buckets), bucket_totals(target, target_text, longest, buckets))
    return ranked(scored(docs, gain, id_col, text, longest, seed), id_col, least_words, percent).filter("rank IS NOT NULL")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    gain = gains(bucket_totals(docs, "text", 1, BUCKETS), bucket_totals(table(spark, sf_dir, "benchmark", "text"), "text", 1, BUCKETS))
    rows = written(scored(docs, gain).select("doc_id", "n_words", "n_features", "weight", "score"))
    return ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH w(t, doc_id, r, ws) AS (
  SELECT 0, doc_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM documents
  UNION ALL
  SELECT 1, NULL, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
-- CRC-32 of each distinct word, byte by byte over the table of the reflected polynomial
crc AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(256) g(b))),
f AS (SELECT t, doc_id, r, unnest(ws) AS word FROM w),
dist AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM f)),
bk AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT)),
         lambda x, y: xor(x // 256, tab[xor(x, y) % 256 + 1])), 4294967295) % 10000 AS b FROM dist, crc),
n AS (SELECT b, count(*) FILTER (t = 0) AS s, count(*) FILTER (t = 1) AS u FROM f JOIN bk USING (word) GROUP BY b),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(u), 0)::DOUBLE AS tt FROM n),
g AS (SELECT b, floor(1000 * ln((u + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM n, tot),
d AS (SELECT f.r, count(*) AS nf, sum(gain)::BIGINT AS sm FROM f JOIN bk USING (word) JOIN g USING (b) WHERE t = 0 GROUP BY f.r),
e AS (SELECT doc_id, coalesce(nf, 0)::BIGINT AS n_features, CASE WHEN nf > 0 THEN (sm - ((sm % nf) + nf) % nf) // nf ELSE 0 END::BIGINT AS weight,
        ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM w LEFT JOIN d USING (r) WHERE t = 0),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS pos,
        count(*) FILTER (n_features >= 20) OVER () AS nn FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN pos <= 10 * nn // 100 THEN pos END::BIGINT AS rank FROM k
"""
