"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.scratch import Scratch

#: A key with more than this share of all references is heavy; at most 1 / share keys can be.
HEAVY_SHARE = 0.001
#: A heavy key with more lifetimes than this isn't broadcast; its references are spread over so many copies of its lifetimes.
MAX_LIFETIMES, SPREAD = 1_000, 64


def lifetimes(targets: DataFrame, key: str, starts: str, ends: str) -> DataFrame:
    """One row per key: its distinct lifetimes and the earliest start. A null start was always there, a null end still is."""
    return (
        targets.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.collect_set(F.struct(F.col(starts).alias("starts"), F.col(ends).alias("ends"))).alias("_lives"))
    )


def orphan_references(refs: DataFrame, targets: DataFrame, starts: str = "starts", ends: str = "ends", heavy_share: float = HEAVY_SHARE, max_lifetimes: int = MAX_LIFETIMES) -> DataFrame:
    """References to keys that didn't exist when the reference was made.

    refs: origin, record_id, ref_key, ref_at; the same reference counts once, those with a null in any column are none.
    targets: ref_key and the two ends of a lifetime; it includes its start and not its end.

    References are first counted per key and month, combined before the shuffle. Keys that hold more than heavy_share of all
    references, of which there can only be 1 / heavy_share, are checked against a broadcast of their lifetimes, or, if a key has
    more than max_lifetimes, against one of several copies of them; the references to all others are shuffled by key and joined.
    Each key takes one of these ways, so the union holds each orphan once.

    Result: origin, record_id, ref_key, reason (missing: no such key; later: all its lifetimes begin after; deleted: otherwise),
    ref_month (YYYY-MM). Empty inputs: no references, no rows; no targets, all references are missing.
    """
    scratch = Scratch(refs.sparkSession, "references")
    # Written once: references come out of explodes and joins, and are read for the counts and by both ways of the check.
    refs = scratch.save(refs.select("origin", "record_id", "ref_key", "ref_at").dropna())
    lives = lifetimes(targets, "ref_key", starts, ends)
    per_period = refs.groupBy("ref_key", F.trunc("ref_at", "month").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    per_period = scratch.save(per_period)
    per_key = per_period.groupBy("ref_key").agg(F.sum("n").alias("n"))
    total = per_period.agg(F.sum("n").alias("total")).scalar()
    heavy = per_key.filter(F.col("n") > total * heavy_share).select("ref_key")
    # way: 0 for keys whose lifetimes are broadcast, 1 for those with too many; at most 1 / heavy_share rows.
    heavy_lives = heavy.join(lives, heavy["ref_key"] == lives["_key"], "left")
    heavy_lives = scratch.save(heavy_lives.select(F.col("ref_key").alias("_heavy"), "_lives", (F.coalesce(F.size("_lives"), F.lit(0)) > max_lifetimes).cast("int").alias("_way")))

    split = refs.join(F.broadcast(heavy_lives.select("_heavy", "_way", F.when(F.col("_way") == 0, F.col("_lives")).alias("_lives"))), refs["ref_key"] == F.col("_heavy"), "left")
    seen = split.filter("_way = 0").drop("_heavy", "_way")
    rest = split.filter("_way is null").drop("_heavy", "_way", "_lives").join(lives, F.col("ref_key") == F.col("_key"), "left").drop("_key")
    salt = F.pmod(F.xxhash64("origin", "record_id"), F.lit(SPREAD)).cast("int")
    copies = heavy_lives.filter("_way = 1").select(F.col("_heavy").alias("ref_key"), "_lives", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_salt"))
    many = split.filter("_way = 1").drop("_heavy", "_way", "_lives").withColumn("_salt", salt).join(copies, ["ref_key", "_salt"]).select("origin", "record_id", "ref_key", "ref_at", "_lives")
    checked = seen.unionByName(rest).unionByName(many)

    at = F.col("ref_at")
    alive = F.exists("_lives", lambda x: (x["starts"].isNull() | (x["starts"] <= at)) & (x["ends"].isNull() | (at < x["ends"])))
    all_later = F.forall("_lives", lambda x: F.coalesce(x["starts"] > at, F.lit(False)))
    reason = F.when(F.col("_lives").isNull(), "missing").when(alive, None).when(all_later, "later").otherwise("deleted")
    return (
        checked.select("origin", "record_id", "ref_key", reason.alias("reason"), F.date_format("ref_at", "yyyy-MM").alias("ref_month"))
        .filter(F.col("reason").isNotNull())
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per referenced table and month, by reason."""
    return orphans.groupBy("ref_key", "ref_month", "reason").agg(F.count(F.lit(1)).cast("bigint").alias("n_references"))
