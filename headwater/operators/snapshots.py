"""What changed between full snapshots of a table.

Every key gets an ordinal that it keeps for all deliveries: a block and a position in it, recorded in a registry. A delivery is
then a set of ordinals, held as 64-bit words of a bitmap of which only the words with a bit exist. Beside each word stands the
vector of the compared values of its bits, in their order, so that the value of a bit is found by counting the bits below it.
One delivery AND NOT the one before it gives the additions, the reverse the removals, and the AND of both the common keys, whose
values are compared by position.

``snapshot_changes`` compares all deliveries of a history at once. ``apply_delivery`` takes the registry and the bitmaps of the
last deliveries from the run before, reads the new delivery only, and returns both for the next run. Either works on the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.scratch import Scratch

#: Keys in a block of ordinals. A block is what one task has to sort; when the last block of a scope is full, new ones are opened.
BLOCK_KEYS = 16_384
WORD = 64


def assign_ordinals(keys: DataFrame, scope: list[str], key: list[str], registry: DataFrame | None = None, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """The registry of ordinals (block, position) with the keys that it lacks; further columns of keys are kept with new keys.

    Keys of the registry (an earlier result of this function) keep their ordinals. New keys of a scope go to its last block as
    long as all of them have room there. Else they are spread by hash over as many new blocks as they fill, so that a scope with
    very many keys is numbered in parallel, whenever they come.

    keys: one row per key, without nulls in the key columns. registry: a written table. Result: scope, key, block, position; without a registry, the other
    columns of keys too.
    """
    cols = [*scope, *key]
    if registry is None:
        new = keys
    else:
        registry = registry.select(*cols, "block", "position")
        new = keys.select(*cols).join(registry.select(*cols), cols, "left_anti")
    many = new.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    if registry is not None:
        ends = registry.groupBy(*scope, "block").agg((F.max("position") + 1).alias("_used"))
        ends = ends.groupBy(*scope).agg(F.max(F.struct("block", "_used")).alias("_end"))
        many = many.join(ends, scope, "left").select(*scope, "_n", F.coalesce("_end.block", F.lit(-1)).alias("_last"), F.coalesce("_end._used", F.lit(block_keys)).alias("_used"))
    else:
        many = many.select(*scope, "_n", F.lit(-1).alias("_last"), F.lit(block_keys).alias("_used"))
    fits = F.col("_used") + F.col("_n") <= block_keys
    # Only scopes whose keys need more than their first block have a row here: at most one for every block_keys keys.
    many = many.select(*scope, F.when(fits, F.col("_last")).otherwise(F.col("_last") + 1).alias("_first"), F.when(fits, 1).otherwise(F.ceil(F.col("_n") / block_keys)).cast("int").alias("_blocks"), F.when(fits, F.col("_used")).otherwise(0).alias("_from"))
    many = many.filter("_first > 0 or _blocks > 1 or _from > 0")
    new = new.join(many, scope, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    new = new.withColumn("block", (zero("_first") + F.pmod(F.xxhash64(*key), F.coalesce("_blocks", F.lit(1)))).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*scope, "block").orderBy(*key)) - 1
    new = new.withColumn("position", (rank + zero("_from")).cast("int")).drop("_first", "_blocks", "_from")
    return new if registry is None else registry.unionByName(new)


def _latest(rows: DataFrame, cols: list[str], snapshot: str, value: Column, version: Column) -> DataFrame:
    """The line of each key and delivery that counts: cols, _snap, _value."""
    base = rows.select(*cols, F.col(snapshot).alias("_snap"), value.alias("_value"), version.alias("_version")).dropna(subset=[*cols, "_snap"])
    # Partitioned by key, both the latest version of a line and the list of a key's deliveries need no further shuffle.
    latest = base.repartition(*cols).groupBy(*cols, "_snap").agg(F.max(F.struct("_version", "_value")).alias("_last"))
    return latest.select(*cols, "_snap", F.col("_last._value").alias("_value"))


def _bitmaps(held: DataFrame, scope: list[str]) -> DataFrame:
    """Words of the bitmaps of deliveries: scope, block, _word, _snap, _bits, _vector (the values of the bits, in their order)."""
    at = held.select(*scope, "block", F.expr(f"position div {WORD}").alias("_word"), (F.col("position") % WORD).alias("_bit"), "_snap", "_value")
    entries = F.array_sort(F.collect_list(F.struct("_bit", "_value")))  # at most 64
    return at.groupBy(*scope, "block", "_word", "_snap").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"), F.transform(entries, lambda e: e["_value"]).alias("_vector"))


def _on(bits: Column, kind: str) -> Column:
    """The bits that are set, with the kind of change they stand for."""
    on = F.filter(F.expr(f"sequence(0, {WORD - 1})"), lambda i: F.call_function("getbit", bits, i) == 1)
    return F.transform(on, lambda i: F.struct(i.alias("bit"), F.lit(kind).alias("change_kind")))


def _changes(new: Column, new_vector: Column, old: Column, old_vector: Column) -> Column:
    """Changes from an old word to a new one: AND NOT both ways, and common bits with different values."""

    def value(vector: Column, bits: Column, i: Column) -> Column:
        below = bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), i)))
        return F.get(vector, F.bit_count(below))

    common = F.filter(_on(new.bitwiseAND(old), "changed"), lambda e: ~value(new_vector, new, e["bit"]).eqNullSafe(value(old_vector, old, e["bit"])))
    return F.concat(_on(new.bitwiseAND(F.bitwise_not(old)), "added"), _on(old.bitwiseAND(F.bitwise_not(new)), "removed"), common)


def _named(events: DataFrame, registry: DataFrame, scope: list[str], key: list[str], snapshot: str) -> DataFrame:
    """Events (scope, block, _word, snapshot, _e) with the keys that their ordinals stand for."""
    events = events.filter(F.size("_e") > 0).select(*scope, "block", "_word", snapshot, F.explode("_e").alias("_e"))
    events = events.select(*scope, "block", F.expr(f"cast(_word * {WORD} + _e.bit as int)").alias("position"), snapshot, "_e.change_kind")
    return events.join(registry, [*scope, "block", "position"]).select(*scope, *key, snapshot, "change_kind")


def snapshot_changes(rows: DataFrame, scope: list[str], key: list[str], snapshot: str, value: Column, version: Column, block_keys: int = BLOCK_KEYS, registry: DataFrame | None = None) -> DataFrame:
    """Keys added, removed or changed between each two consecutive deliveries of a scope.

    Consecutive are the deliveries that the scope really has, in the order of ``snapshot``; numbers may have gaps. The first
    delivery of a scope yields nothing. If a delivery holds a key more than once, the row with the greatest ``version`` counts;
    of equal versions, the one with the greatest value. Rows with a null in scope, key or snapshot name no key and are left
    out; a null value is a value like any other. An empty table gives an empty result.

    Values are compared as they are. Keys of the registry, if one is given, keep the ordinals they have there. Result: scope,
    key, snapshot (the later one), change_kind (added, removed, changed).
    """
    cols = [*scope, *key]
    scratch = Scratch(rows.sparkSession, "snapshots")
    # Written once: the lines of each key are read for the numbers of keys and for their ordinals.
    by_key = scratch.save(_latest(rows, cols, snapshot, value, version).groupBy(*cols).agg(F.collect_list(F.struct("_snap", "_value")).alias("_held")))
    if registry is None:
        placed = scratch.save(assign_ordinals(by_key, scope, key, block_keys=block_keys))
        registry = placed.select(*cols, "block", "position")
    else:
        registry = scratch.save(assign_ordinals(by_key, scope, key, registry, block_keys))
        placed = by_key.join(registry, cols)
    deliveries = placed.select(*scope, F.explode("_held._snap").alias("_snap")).distinct()
    order = Window.partitionBy(*scope).orderBy("_snap")
    deliveries = deliveries.select(*scope, "_snap", F.lag("_snap").over(order).alias("_before"), F.lead("_snap").over(order).alias("_after"))
    held = placed.select(*scope, "block", "position", F.explode("_held").alias("_h")).select(*scope, "block", "position", F.col("_h._snap").alias("_snap"), F.col("_h._value").alias("_value"))
    # Partitioned by block, the bitmaps and the words before and after need no further shuffle.
    bitmaps = _bitmaps(held.repartition(*scope, "block"), scope).join(deliveries, [*scope, "_snap"])
    word = [*scope, "block", "_word"]
    in_word = Window.partitionBy(*word).orderBy("_snap")
    prev_is_adjacent = F.lag("_snap").over(in_word).eqNullSafe(F.col("_before"))
    pairs = bitmaps.select(
        *word, "_snap", "_before", "_after", "_bits", "_vector",
        F.when(prev_is_adjacent, F.lag("_bits").over(in_word)).otherwise(F.lit(0).cast("bigint")).alias("_old_bits"),
        F.when(prev_is_adjacent, F.lag("_vector").over(in_word)).alias("_old_vector"),
        F.lead("_snap").over(in_word).eqNullSafe(F.col("_after")).alias("_stays"),
    )
    against_old = F.when(F.col("_before").isNotNull(), _changes(F.col("_bits"), F.col("_vector"), F.col("_old_bits"), F.col("_old_vector")))
    # A word that the next delivery lacks altogether has no row there; all its keys were removed.
    gone = F.when(F.col("_after").isNotNull() & ~F.col("_stays"), _on(F.col("_bits"), "removed"))
    both = F.array(F.struct(F.col("_snap").alias("at"), against_old.alias("e")), F.struct(F.col("_after").alias("at"), gone.alias("e")))
    events = pairs.select(*word, F.explode(both).alias("_x")).select(*word, F.col("_x.at").alias(snapshot), F.col("_x.e").alias("_e"))
    return _named(events, registry, scope, key, snapshot)


class Delivered(NamedTuple):
    """What a delivery left: its changes, and what the next one needs. Write all three before the next delivery is applied."""

    changes: DataFrame
    registry: DataFrame
    last: DataFrame


def apply_delivery(rows: DataFrame, scope: list[str], key: list[str], snapshot: str, value: Column, version: Column, registry: DataFrame | None = None, last: DataFrame | None = None, block_keys: int = BLOCK_KEYS) -> Delivered:
    """The changes that new deliveries bring, from the registry and the last bitmaps of the run before; None on the first run.

    rows: one delivery of each scope that has a new one, later than the scope's last; scopes without one keep theirs. Earlier
    deliveries aren't read again. Rules for repeated lines, nulls and the first delivery of a scope are those of
    ``snapshot_changes``, and so are the changes.
    """
    cols = [*scope, *key]
    scratch = Scratch(rows.sparkSession, "delivery")
    lines = scratch.save(_latest(rows, cols, snapshot, value, version))
    registry = scratch.save(assign_ordinals(lines.select(*cols), scope, key, registry, block_keys))
    new = scratch.save(_bitmaps(lines.join(registry, cols), scope))
    if last is None:
        last = new.limit(0)
    arrived = new.select(*scope, F.col("_snap").alias(snapshot)).distinct()
    seen = last.select(*scope).distinct()
    word = [*scope, "block", "_word"]
    old = last.select(*word, F.col("_bits").alias("_old_bits"), F.col("_vector").alias("_old_vector"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    both = new.drop("_snap").join(old, word, "full").join(arrived, scope).join(seen, scope)
    events = both.select(*word, snapshot, _changes(zero(F.col("_bits")), F.col("_vector"), zero(F.col("_old_bits")), F.col("_old_vector")).alias("_e"))
    kept = last.join(arrived.select(*scope), scope, "left_anti")
    return Delivered(_named(events, registry, scope, key, snapshot), registry, scratch.save(kept.unionByName(new)))


def canonical_types(rows: DataFrame, data_type: str, synonyms: DataFrame, into: str = "_type") -> DataFrame:
    """Rows with a data type in one spelling: in lower case and without spaces, its name (without length) as synonyms have it.

    synonyms: spelling, type_name; nulls are left out, of several names of a spelling the least counts. Length, precision and
    scale belong to the type: with numeric for decimal, "NUMERIC (10, 2)" and "decimal(10,2)" are the same. A null type stays null.
    """
    tight = lambda c: F.lower(F.regexp_replace(c, r"[\s\xA0]+", ""))
    names = synonyms.select(tight("spelling").alias("_spelling"), tight("type_name").alias("_name")).dropna().groupBy("_spelling").agg(F.min("_name").alias("_name"))
    named = rows.withColumn("_tight", tight(data_type)).withColumn("_base", F.regexp_replace("_tight", r"\(.*?\)", ""))
    named = named.join(names, F.col("_base") == F.col("_spelling"), "left")
    return named.withColumn(into, F.concat(F.coalesce("_name", "_base"), F.regexp_extract("_tight", r"(\(.*?\))", 1))).drop("_tight", "_base", "_spelling", "_name")
