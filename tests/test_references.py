from datetime import datetime

from headwater.operators.references import orphan_references, orphan_report

REFS, LIVES = "origin string, record_id long, ref_key string, ref_at timestamp, reason string", "ref_key string, starts timestamp, ends timestamp, ref_at string"
D = lambda m, d=1: datetime(2024, m, d)


def run(spark, refs, lives, **kw):
    out = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES), **kw)
    return sorted((r.origin, r.record_id, r.ref_key, r.reason, r.ref_month) for r in out.collect())


def test_reasons_ends_and_lifetimes(spark):
    lives = [("t", D(2), D(4), ""), ("t", D(6), None, ""), ("t", D(6), None, ""), ("u", D(9), None, ""), (None, D(1), None, ""), ("old", None, D(2), "")]
    refs = [("o", i, "t", D(m), None) for i, m in enumerate((1, 2, 3, 4, 6))]
    refs += [("o", 10, "u", D(8), ""), ("o", 10, "u", D(8), ""), ("o", 11, "gone", D(3), ""), ("o", 12, "old", D(1), ""), ("o", 13, "old", D(2), ""), ("o", 14, None, D(1), ""), ("o", 15, "u", None, "")]
    want = [("o", 0, "t", "later", "2024-01"), ("o", 3, "t", "deleted", "2024-04"), ("o", 10, "u", "later", "2024-08"), ("o", 11, "gone", "missing", "2024-03"), ("o", 13, "old", "deleted", "2024-02")]
    assert run(spark, refs, lives) == want
    assert run(spark, refs, lives, heavy_share=0.0) == want  # all keys heavy
    assert run(spark, refs, lives, heavy_share=1.0) == want  # none
    assert run(spark, refs, lives, heavy_share=0.0, max_lifetimes=1) == want  # all heavy, t with too many lifetimes to be broadcast


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("o", 1, "k", D(1), "")], []) == [("o", 1, "k", "missing", "2024-01")]


def test_report(spark):
    df = spark.createDataFrame([("a", 1, "k", "missing", "2024-01"), ("b", 2, "k", "missing", "2024-01")], "origin string, record_id long, ref_key string, reason string, ref_month string")
    assert [tuple(r) for r in orphan_report(df).collect()] == [("k", "2024-01", "missing", 2)]
