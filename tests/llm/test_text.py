import collections
import random

import pytest
from pyspark.sql import functions as F

from headwater.llm import canonical, matching, mixing, packing, splitting, subjects, tokens


# ---- matching
REF = [("raw_customer_snapshot", "bronze"), ("raw_customer_snapshot", "crm"), ("dim_policy_entry", "crm"), ("fact_quota_audit", "fin"), ("agg_store_balance", "gold"), ("agg_score_balance", "gold")]


def test_matching(spark):
    ref = spark.createDataFrame([(f"{s}.{t}", s, t, "lake", "x") for t, s in REF], "qualified_name string, schema_name string, table_name string, database_name string, value string")
    want = {
        "CRM.Dim_Policy_Entry": "crm.dim_policy_entry", "[lake].[fin].[fact_quota_audit]": "fin.fact_quota_audit", "other.fin.fact_quota_audit": None, "crm.dim_polcy_enrty AS t": "crm.dim_policy_entry",
        "policy_entry_dim": "crm.dim_policy_entry", "tblFactQuotaAudit": "fin.fact_quota_audit", "fin..fact quota audit WITH (NOLOCK)": "fin.fact_quota_audit", "raw_customer_snapshot": None, "bronze.raw_cust_snap": "bronze.raw_customer_snapshot",
        "rawcustsnap": None, "crmx": None, "crm.rawcustsnap": "crm.raw_customer_snapshot", "fin.fact_quota_entry": None, "gold.agg_store_balance;": "gold.agg_store_balance", "gold.agg_stroe_balance": "gold.agg_store_balance", "#fact_quota_audit": None,
        "": None, "   ": None, "fin.fact_puppet_audit": None, "x" * 3000: None, "erp.dim_policy_entry": None, "crm .dim_policy_entry ": "crm.dim_policy_entry",
    }
    vals = spark.createDataFrame([(v,) for v in [*want, None, "crmx"]], "value string")
    got = {r.value: r.qualified_name for r in matching.match_names(vals, ref).collect()}
    assert got == want


def test_matching_of_long_names(spark):
    letters = "abcdefghij"
    words = [f"{letters[i // 100]}{letters[i // 10 % 10]}{letters[i % 10]}xx" for i in range(120)]
    long = "w" + "y" * 2000 + "z"
    ref = spark.createDataFrame([("s." + "_".join(words), "s", "_".join(words), "d"), (f"s.{long}", "s", long, "d"), ("s.few", "s", "_".join(words[:9]), "d"), ("s.none", "s", None, "d"), ("s.empty", "s", "", "d")], "qualified_name string, schema_name string, table_name string, database_name string")
    vals = spark.createDataFrame([("s." + "-".join(words),), ("s." + "".join(words[:9]),), ("_".join(words[:-1]),), (f"S.{long.upper()}",)], "value string")
    got = {r.value: r.qualified_name for r in matching.match_names(vals, ref).collect()}
    assert got == {"s." + "-".join(words): "s." + "_".join(words), "s." + "".join(words[:9]): "s.few", "_".join(words[:-1]): None, f"S.{long.upper()}": f"s.{long}"}
    assert matching.match_names(vals, ref.limit(0)).filter("qualified_name is not null").count() == 0
    assert matching.match_names(vals.limit(0), ref).count() == 0


def test_pigeonhole_finds_all_pairs(spark):
    rng = random.Random(3)
    forms = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(40)]
    values = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    v = spark.createDataFrame([("s", x) for x in set(values)], "scope string, v string")
    f = spark.createDataFrame([("s", x) for x in set(forms)], "scope string, f string")
    got = {(r.v, r.f) for r in matching.pigeonhole_pairs(v, f, 2).collect()}
    lev = v.crossJoin(f.drop("scope")).select("v", "f", F.levenshtein("v", "f").alias("d")).collect()
    assert got == {(r.v, r.f) for r in lev if r.d <= 2 and (len(r.f) > 2 or r.d == 0)}


# ---- canonical
SAME = [
    'SELECT a.x, b.y FROM s.t a JOIN u b ON a.k = b.k WHERE (a.n > 1.5 AND a.m = \'OPEN\')',
    "select  A.[X]\n,\tB.[Y]\nfrom S.T A join U B on A.K=B.K where A.N>1.5 and A.M = open;",
    'Select b."y" , a."x" From "s"."t" a Join u b On a.k = b.k Where a.n > 1.5 And a.m = \'Open\' ; ',
]
OTHER = [SAME[0].replace("1.5", "15"), SAME[0].replace("1.5", "-1.5"), SAME[0].replace(">", ">="), SAME[0].replace("a.x, b.y", "a.x, b.y, b.y"), SAME[0].replace("a.k = b.k", "b.k = a.k"), SAME[0].replace("SELECT", "SELECT DISTINCT")]


def test_fields():
    keys = [tuple(sorted(canonical.query_fields(q))) for q in SAME]
    assert len(set(keys)) == 1
    assert len({tuple(sorted(canonical.query_fields(q))) for q in OTHER} | set(keys)) == len(OTHER) + 1
    same = lambda a, b: sorted(canonical.query_fields(a)) == sorted(canonical.query_fields(b))
    assert same("select f(a, b), c from t", "select c, f(a, b) from t") and not same("select f(a, b) from t", "select f(b, a) from t")
    assert same("select x from (select a, b from t) q", "select x from (select b, a from t) q")
    assert not same("select a, b from t union select c from u", "select a from t union select b, c from u")


def test_same_queries(spark):
    rows = [(i + 10, q) for i, q in enumerate(SAME)] + [(10, SAME[0]), (50, SAME[1]), (60, ""), (61, ""), (70, None), (None, "x"), (80, "select " + "a, " * 20000 + "b from t")]
    got = {(r.id, r.first_key, r.copies) for r in canonical.same_queries(spark.createDataFrame(rows, "id int, sql string"), "id", "sql").collect()}
    assert got == {(10, 10, 4), (11, 10, 4), (12, 10, 4), (50, 10, 4), (60, 60, 2), (61, 60, 2), (80, 80, 1)}
    assert canonical.same_queries(spark.createDataFrame([], "id int, sql string"), "id", "sql").count() == 0


# ---- splitting
def check_pieces(text, limit=100, overlap=10):
    ps = splitting._pieces(text, limit, overlap)
    assert "".join(p["piece"][p["overlap"] :] for p in ps) == text
    assert all(len(p["piece"]) <= limit and p["overlap"] <= overlap for p in ps)
    assert all(text[p["start"] : p["start"] + len(p["piece"])] == p["piece"] for p in ps)
    longest = max(len(x) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    assert any(p["is_forced"] for p in ps) == (longest > limit)
    return ps


def test_pieces_round_trip():
    rng = random.Random(5)
    for _ in range(400):
        line = lambda: "".join(rng.choice("abc ;.é") for _ in range(rng.choice([3, 20, 60, 99, 100, 101, 230])))
        check_pieces(rng.choice(["\n", "\r\n"]).join(line() for _ in range(rng.randint(1, 8))))
    check_pieces("x" * 1000)
    check_pieces(("y" * 100 + "\r\n") * 5)
    assert splitting._pieces(None, 100, 10) == [] and len(check_pieces("")) == 1


def test_cuts_between_statements():
    text = "\n".join(f"UPDATE t{i} SET a = 1\nWHERE b = {i};" for i in range(12))
    for p in check_pieces(text, 100, 20)[:-1]:
        assert p["piece"].rstrip().endswith(";")


# ---- tokens
def test_token_counts(spark):
    c = tokens.TokenCounter(tokens.vocabulary_path())
    rng = random.Random(6)
    bits = ["a", " ", "  ", "\n", "\t", "b1", "_", "é", "²", "12", "'s", "...", "　", "ß", "\x1c", "end."]
    for _ in range(1500):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert c.count(x) == len(c.encoding.encode_ordinary(x)), repr(x)
    df = spark.createDataFrame([("hello world",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens.token_count(F.col("t"))).collect()] == [len(c.encoding.encode_ordinary("hello world")), 0, 0]


# ---- packing
def one_by_one(items, cap):
    rooms = []
    for s in sorted(items, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit)[1]] -= s
        else:
            rooms.append(cap - s)
    return sorted(rooms)


def test_pack_equals_one_by_one(spark):
    rng = random.Random(7)
    items = [rng.randint(1, 40) for _ in range(300)] + [7] * 150 + [0, 0, 95]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(items)] + [(None, 5, 1), (999, None, 1)], "id long, size int, container int")
    packing.GROUP_ITEMS, before = 40, packing.GROUP_ITEMS
    try:
        rows = packing.pack(df, "id", "size", 40).collect()
    finally:
        packing.GROUP_ITEMS = before
    assert collections.Counter(r["id"] for r in rows) == collections.Counter([*range(len(items)), 452, 452, 999])
    assert sorted((r["part"], r["start"], r["size"]) for r in rows if r["id"] == 452) == [(0, 0, 40), (1, 40, 40), (2, 80, 15)]
    used = collections.Counter()
    for r in rows:
        used[r["container"]] += r["size"]
    parts = [s for s in items[:450] if s] + [40, 40, 15]
    assert sorted(40 - u for u in used.values()) == one_by_one(parts, 40)
    assert sorted(used) == list(range(len(used)))
    assert packing.pack(df.limit(0), "id", "size", 40).count() == 0


@pytest.mark.parametrize("capacity", [2**20 - 1, 2**20, 2_000_000, 2**30])
def test_pack_into_large_containers(spark, capacity):
    items = [capacity, capacity // 2 + 1, capacity // 2, capacity // 3, capacity // 3, 5, 5, capacity + 7]
    rows = packing.pack(spark.createDataFrame(list(enumerate(items)), "id long, size long"), "id", "size", capacity).collect()
    used = collections.Counter()
    for r in rows:
        used[r["container"]] += r["size"]
    assert sum(used.values()) == sum(items) and max(used.values()) <= capacity
    assert sorted(capacity - u for u in used.values()) == one_by_one([*items[:7], capacity, 7], capacity)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 1)], "id long, size long"), "id", "size", 2**31)


# ---- mixing
def test_mix_shares_and_repeats(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["Big", "big ", "BIG", "small-one", "other", None]), rng.randint(0, 50)) for i in range(4000)]
    docs += [(None, "big", 9), (5000, "big", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, targets)
    rows = m.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert max(r.n_uses for r in rows if r.source == "small_one") <= 3 and {r.n_uses for r in rows if r.source == "big"} == {1}
    rep = {r.source: r for r in mixing.mix_report(m, targets).collect()}
    assert abs(rep["big"].actual_share - 5 / 9) < 0.002 and abs(rep["small_one"].actual_share - 4 / 9) < 0.002 and rep["absent"].total_size == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df, targets).collect()))
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


# ---- subjects
def make_docs(n, seed):
    rng = random.Random(seed)
    words = {"sport": ["match", "goal", "coach", "stadium"], "law": ["court", "judge", "verdict", "statute"], "energy": ["grid", "turbine", "voltage", "meter"]}
    out = []
    for _ in range(n):
        has = rng.sample(sorted(words), rng.choice([1, 1, 2]))
        lines = [f"The {rng.choice(words[s])}Table step reads {rng.choice(words[s]).upper()}_ID and writes back." for s in has for _ in range(4)]
        aside = rng.choice([s for s in words if s not in has])
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), f"Not to be mixed up with the {rng.choice(words[aside])} feed.")
        out.append(("\n".join(lines), has))
    return out


def test_subjects_on_held_out(spark):
    areas = {"sport": "matches and goals", "law": "courts", "energy": "power"}
    model = subjects.fit([(t, dict.fromkeys(s, 1)) for t, s in make_docs(500, 1)], areas)
    test = make_docs(200, 2)
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(test)] + [(900, "", "x"), (901, None, "x"), (None, "goal", "x"), (902, "goal " * 30000, "x")], "doc_id long, text string, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.classify(df, model, "doc_id", "text").collect()}
    assert not {d for d, _ in got} & {900, 901, None}
    want = {(i, s) for i, (_, has) in enumerate(test) for s in has}
    found = {x for x in got if x[0] < 900}
    assert len(found & want) / len(want) > 0.97 and len(found & want) / len(found) > 0.95


def test_subjects_without_labels():
    m = subjects.fit([], {"a": "alpha words", "b": ""})
    assert m.weights.shape == (2, subjects.DIM)


@pytest.mark.parametrize("name", ["p6_found"])
def test_query_equals_sql(spark, name):
    from headwater.llm.queries import QUERIES
    from headwater.llm.sql import ORACLE_SQL
    from tests.helpers import DATA, duck_rows, rows_of

    assert rows_of(QUERIES[name](spark, DATA)) == duck_rows(ORACLE_SQL[name])
