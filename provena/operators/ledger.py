"""The ledger of outside evidence: record rules, doubles, derived counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.urls import bounded_line, iso_date

#: Kinds whose records are counted one by one, and those counted by distinct subject.
BY_RECORD, BY_SUBJECT = ("independent_reproduction", "third_party_review"), ("independent_user", "institutional_adoption")


def faults(as_of: str, key: Column) -> Column:
    """Names of the rules that a ledger record breaks; ``key`` is its URL key."""
    c = F.col
    observed, verified, retracted, limit = iso_date(c("observed_date")), iso_date(c("verified_date")), iso_date(c("retracted_date")), F.lit(as_of).cast("date")
    gone = c("status") == "retracted"
    rules = {
        "status": ~c("status").isin("verified", "retracted"),
        "id": ~c("id").rlike(r"^EXT-[0-9]{4}-[0-9]{4}$"),
        "kind": ~c("kind").isin(*BY_RECORD, *BY_SUBJECT),
        "subject": ~bounded_line(c("subject"), 120),
        "scope": ~bounded_line(c("scope"), 240),
        "relationship": c("relationship") != "independent",
        "consent": ~c("consent_to_list"),
        "source_commit": ~c("source_commit").rlike(r"^[0-9a-f]{40}$"),
        "observed_date": observed.isNull(),
        "verified_date": verified.isNull() | (verified < observed) | (verified > limit),
        "id_year": F.substring("id", 5, 4) != F.substring("observed_date", 1, 4),
        "evidence_url": key.isNull(),
        "retracted_date": F.when(gone, retracted.isNull() | (retracted < verified) | (retracted > limit)).otherwise(c("retracted_date").isNotNull()),
        "retraction_reason": F.when(gone, ~bounded_line(c("retraction_reason"), 240)).otherwise(c("retraction_reason").isNotNull()),
    }
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules.items()]), lambda x: x.isNotNull())


def doubles(records: DataFrame, *columns: str) -> DataFrame:
    """Values that stand in several records, by column. URLs are compared by their key (``urls.url_key``), so give that column."""
    out = None
    for name in columns:
        found = records.groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n")).filter("n > 1 and value is not null").withColumn("column", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def counts(records: DataFrame, subject_key: str = "subject_key") -> DataFrame:
    """Per kind: records, and distinct subjects, of those not retracted."""
    live = F.col("status") != "retracted"
    return records.groupBy("kind").agg(F.count_if(live).alias("n_records"), F.countDistinct(F.when(live, F.col(subject_key))).alias("n_subjects"))
