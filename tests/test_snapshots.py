import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from headwater.operators.snapshots import apply_delivery, assign_ordinals, canonical_types, snapshot_changes
from headwater.scratch import Scratch

SCHEMA = "db string, snap int, k string, v string, at timestamp, change_kind string"


def changes(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = snapshot_changes(df, ["db"], ["k"], "snap", F.col("v"), F.col("at"), **kw)
    return sorted(tuple(r) for r in out.select("db", "k", "snap", "change_kind").collect())


def brute(rows):
    held = {}
    for db, snap, k, v, at, _ in rows:
        if None in (db, snap, k):
            continue
        lines = held.setdefault(db, {}).setdefault(snap, {})
        if k not in lines or (at, v or "") > lines[k]:
            lines[k] = (at, v or "")
    out = []
    for db, snaps in held.items():
        order = sorted(snaps)
        for a, b in zip(order, order[1:]):
            old, new = snaps[a], snaps[b]
            out += [(db, k, b, "added") for k in new.keys() - old.keys()]
            out += [(db, k, b, "removed") for k in old.keys() - new.keys()]
            out += [(db, k, b, "changed") for k in old.keys() & new.keys() if old[k][1] != new[k][1]]
    return sorted(out)


def test_against_brute_force(spark):
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    rows = []
    for db in ("hot", "a", "b"):
        for snap in rng.sample(range(1, 7), 4):
            for i in range(300 if db == "hot" else 20):
                if rng.random() < 0.7:
                    for _ in range(rng.choice([1, 1, 2])):
                        rows.append((db, snap, f"k{i}", rng.choice(["int", "date"]), t0 + timedelta(seconds=rng.randint(0, 10**6)), "x"))
    rows += [(None, 1, "k", "int", t0, None), ("a", None, "k", "int", t0, None), ("a", 1, None, "int", t0, None)]
    assert changes(spark, rows, block_keys=64) == brute(rows)
    registry = assign_ordinals(spark.createDataFrame([("hot", f"k{i}") for i in range(100, 0, -1)], "db string, k string"), ["db"], ["k"], block_keys=64)
    assert changes(spark, rows, block_keys=64, registry=registry) == brute(rows)
    df, state, found = spark.createDataFrame(rows, SCHEMA), (None, None), []
    for n in range(1, 7):
        out = apply_delivery(df.filter(F.col("snap") == n), ["db"], ["k"], "snap", F.col("v"), F.col("at"), *state, block_keys=64)
        found += [tuple(r) for r in out.changes.select("db", "k", "snap", "change_kind").collect()]
        state = (out.registry, out.last)
    assert sorted(found) == brute(rows)


def test_gap_null_value_and_emptied_word(spark):
    t = datetime(2024, 1, 1)
    rows = [("d", 1, "x", None, t, ""), ("d", 4, "x", "int", t, ""), ("d", 4, "y", None, t, ""), ("d", 5, "y", None, t, ""), ("e", 1, "only", "int", t, "")]
    assert changes(spark, rows) == [("d", "x", 4, "changed"), ("d", "x", 5, "removed"), ("d", "y", 4, "added")]


def test_empty_table(spark):
    assert changes(spark, []) == []


def test_ordinals_persist(spark):
    keys = spark.createDataFrame([("d", f"k{i}") for i in range(50)], "db string, k string")
    first = assign_ordinals(keys, ["db"], ["k"], block_keys=16)
    before = {(r.db, r.k): (r.block, r.position) for r in first.collect()}
    assert len(set(before.values())) == 50
    more = spark.createDataFrame([("d", f"k{i}") for i in range(40, 70)] + [("new", "k1")], "db string, k string")
    after = {(r.db, r.k): (r.block, r.position) for r in assign_ordinals(more, ["db"], ["k"], registry=first, block_keys=16).collect()}
    assert all(after[k] == v for k, v in before.items())
    assert len({v for k, v in after.items() if k[0] == "d"}) == 70
    # Few keys fill the last block, more than it has room for open new ones.
    small = assign_ordinals(spark.createDataFrame([("d", "a")], "db string, k string"), ["db"], ["k"], block_keys=16)
    save = Scratch(spark, "test").save
    small = save(assign_ordinals(spark.createDataFrame([("d", "b"), ("d", "c")], "db string, k string"), ["db"], ["k"], registry=save(small), block_keys=16))
    assert {(r.k, r.block, r.position) for r in small.collect()} == {("a", 0, 0), ("b", 0, 1), ("c", 0, 2)}
    grown = assign_ordinals(keys, ["db"], ["k"], registry=small, block_keys=16).collect()
    assert len({(r.block, r.position) for r in grown}) == 53 and {r.block for r in grown if r.k.startswith("k")} <= {1, 2, 3, 4}


def test_types(spark):
    syn = spark.createDataFrame([("numeric", "decimal"), ("Character Varying", "varchar"), (None, "x"), ("numeric", "zzz")], "spelling string, type_name string")
    df = spark.createDataFrame([("NUMERIC (10, 2)",), ("decimal(10,2)",), ("Character  Varying(5)",), ("varchar(6)",), (None,)], "t string")
    got = {r.t: r["_type"] for r in canonical_types(df, "t", syn).collect()}
    assert got == {"NUMERIC (10, 2)": "decimal(10,2)", "decimal(10,2)": "decimal(10,2)", "Character  Varying(5)": "varchar(5)", "varchar(6)": "varchar(6)", None: None}
