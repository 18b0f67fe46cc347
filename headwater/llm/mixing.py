"""A mixture of sources with target shares of the total size.

Each document gets a hash-random key. The mixture is as large as the scarcest source allows; each source's budget is then a
number of whole epochs and a rest. Documents are sorted by key within their source, in ranges of keys that are equally full
because keys are random; prefix sums over ranges and within them give each document its place, and the rest is cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.scratch import Scratch

#: Documents of a source that one task sorts.
RANGE_DOCS = 250_000


def source_name(source: Column) -> Column:
    """A source in one spelling: lower case, trimmed, words joined by underscores."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s\xA0]+|[\s\xA0]+$", "")), r"[\s\xA0\-_]+", "_"), F.lit(""))


def budgets(targets: DataFrame, totals: DataFrame) -> DataFrame:
    """Whole epochs and rest of the budget of each source that has a share and a size: source, epochs, rest.

    targets: source, target_share, max_repeats; totals: source, size. The total is the greatest of which each source can fill its
    share with max_repeats uses. Shares are taken relative to those of the sources that have any documents.
    """
    usable = targets.join(totals, "source").filter("target_share > 0 and max_repeats > 0 and size > 0")
    most = F.col("max_repeats") * F.col("size")
    # As total = per_share * whole and budget = total * share / whole, the sum of the shares cancels out.
    per_share = usable.agg(F.min(most / F.col("target_share")).alias("per_share")).scalar()
    budget = F.least(F.round(per_share * F.col("target_share")).cast("bigint"), most)
    return usable.select("source", "size", budget.alias("budget")).select("source", F.expr("budget div size").alias("epochs"), F.expr("budget % size").alias("rest"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Uses of each document in the mixture: doc_id, source, size, n_uses (at least 1).

    docs: doc_id, source, size; targets: source, target_share, max_repeats, of which a source counts once, with its greatest share.
    Sources are compared in one spelling. Documents of sources without a target, and with a null doc_id, aren't used; a null size
    counts as 0. Documents aren't cut: the one that the budget ends in is used if most of it is within the budget. Empty tables
    give an empty mixture.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats")).dropna()
    wanted = wanted.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    named = docs.select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size")).filter("doc_id is not null")
    named = scratch.save(named.join(wanted.select("source"), "source", "left_semi"))
    totals = scratch.save(named.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    cuts = budgets(wanted, totals.select("source", "size"))
    most = totals.agg(F.max("n")).first()[0] or 0
    bits = max(0, (most // RANGE_DOCS).bit_length())
    keyed = named.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("range", F.shiftright(F.col("key"), 63 - bits + 1) if bits else F.lit(0).cast("bigint"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "range").agg(F.sum("size").alias("s")).select("source", "range", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("size").over(within)).join(offsets, ["source", "range"]).join(cuts, "source")
    end = F.col("offset") + F.col("upto")
    # Most of the document lies within the rest: its middle does.
    inside = (F.col("rest") > 0) & (2 * end - F.col("size") <= 2 * F.col("rest"))
    uses = (F.col("epochs") + inside.cast("bigint")).cast("int")
    return placed.select("doc_id", "source", "size", uses.alias("n_uses")).filter("n_uses > 0")


def mix_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each source: source, target_share, actual_share, n_documents, n_uses, total_size."""
    by = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_uses").alias("n_uses"), F.sum(F.col("size") * F.col("n_uses")).alias("total_size"))
    whole = by.agg(F.sum("total_size").alias("t")).scalar()
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share").dropna()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = t.join(by, "source", "left").select("source", "target_share", zero("n_documents"), zero("n_uses"), zero("total_size"))
    return out.withColumn("actual_share", F.col("total_size") / F.nullif(whole, F.lit(0)))
