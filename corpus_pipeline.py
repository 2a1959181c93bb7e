"""A training corpus from raw documents: quality rules, near duplicates, benchmark decontamination, pseudonyms, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. Each stage works on
all its predecessor kept; all but the last return the columns of documents. What a stage drops is a list of keys that is
broadcast after a check of its size and joined with a shuffle beyond that, so texts move only where they must.

The quality stage also passes texts on without their boilerplate lines. Edge cases are those of the operators; besides, at the
near-duplicate stage one row of a component stays, that of the least id or a null one if there is no other, and of rows with equal id and text one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import bpe, decontaminate, jaccard, pii, quality
from provena.llm.common import importable, kept_after, small, table, written

#: Keys of dropped documents that are broadcast at most.
MOST_KEYS = 1_000_000
#: SQL cannot express the stages; tests hold each of them against a brute-force version.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> DataFrame:
    """Text beside the whole row as one column, so that no column of the row can clash with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_provena_row"), "text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` whose id and text hash are not among keys (_id, _text)."""
    gone = keys.select(F.col("_id").alias("_provena_id"), F.col("_text").alias("_provena_text")).distinct()
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(small(written(gone), MOST_KEYS), F.col("doc_id").eqNullSafe(F.col("_provena_id")) & (text == F.col("_provena_text")), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cleaned(docs, copies=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_provena_text")
    found = written(jaccard.joined(docs.select("doc_id", "text", text), k=5, percent=80, also=("_provena_text",)))
    key = [F.col("doc_id").alias("_id"), F.col("_provena_text").alias("_text")]
    left = _without(docs, found.filter("not stays").select(*key))
    twice = written(found.filter("stays").groupBy(*key).count().filter("count > 1").select(F.col("_id").alias("_provena_id"), F.col("_text").alias("_provena_text")))
    if twice.isEmpty():
        return left
    hint, same = small(twice, MOST_KEYS), F.col("doc_id").eqNullSafe(F.col("_provena_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_provena_text"))
    return left.join(hint, same, "left_anti").unionByName(left.join(hint, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(body).alias("_text"), "text")
    found = decontaminate.hits(keyed, items, ["_id", "_text"]).select(F.col("_id").alias("i"), F.col("_text").alias("t"), "n_hit")
    n_words = F.regexp_count(decontaminate.ascii_lower(body), F.lit(decontaminate.TOKEN))
    sized = keyed.select("_id", "_text", n_words.alias("n_words")).join(found, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_text") == F.col("t")))
    return _without(docs, kept_after(sized, 20 * F.col("n_hit") >= F.col("n_words")))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(_whole(docs), spark.conf.get("spark.provena.pii.key", pii.DEMO_KEY))
    new = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return out.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col(f"_provena_row.`{f.name}`")).alias(f.name) for f in docs.schema])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    importable(spark)
    out = bpe.coded(docs.select("doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.json")), digests=False)
    return out.select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
