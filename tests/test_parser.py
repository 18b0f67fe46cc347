import pytest
from pyspark.sql import functions as F

from headwater.operators import cleaning, lexer, lineage
from headwater.operators.parser import parse_statement


def cols(sql):
    return [(c.name, c.transform, c.resolved) for c in parse_statement(sql).columns]


def test_aggregate_insert():
    st = parse_statement("INSERT INTO gold.metrics (cid, revenue, avg_value, src) SELECT f.CustomerID, SUM(f.LineTotal), CASE WHEN COUNT(DISTINCT f.OrderID) > 0 THEN SUM(f.LineTotal) / COUNT(DISTINCT f.OrderID) ELSE 0 END, 1 FROM silver.SalesFact f GROUP BY f.CustomerID")
    assert (st.kind, st.subtype, st.target, st.sources) == ("INSERT", "INSERT_SELECT", "gold.metrics", ["silver.SalesFact"])
    assert [(c.name, c.transform) for c in st.columns] == [("cid", "direct"), ("revenue", "aggregate"), ("avg_value", "aggregate"), ("src", "literal")]
    assert st.columns[2].resolved == [("silver.SalesFact", "OrderID"), ("silver.SalesFact", "LineTotal")]


def test_ctes_resolve_to_stored_tables():
    sql = "CREATE VIEW v AS WITH a AS (SELECT o.city, SUM(o.amount) AS total FROM orders o GROUP BY o.city), b AS (SELECT city AS c, total AS t FROM a) SELECT b.c AS city, b.t / 2 AS half FROM b JOIN dim.geo g ON g.city = b.c"
    st = parse_statement(sql)
    assert st.sources == ["orders", "dim.geo"] and [c[0] for c in st.ctes] == ["a", "b"]
    assert cols(sql) == [("city", "direct", [("orders", "city")]), ("half", "arithmetic", [("orders", "amount")])]
    assert st.columns[1].sources == [("b", "t", "b")]


def test_update_from_merge_delete():
    st = parse_statement("UPDATE t SET t.total = s.amount * 2, flag = 'x' FROM sales.target t JOIN stage s ON s.id = t.id")
    assert st.target == "sales.target" and st.sources == ["stage"] and [(c.name, c.transform) for c in st.columns] == [("total", "arithmetic"), ("flag", "literal")]
    st = parse_statement("MERGE INTO d USING (SELECT id, v FROM src) s ON d.id = s.id WHEN MATCHED THEN UPDATE SET d.v = s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v)")
    assert (st.kind, st.target, st.sources) == ("MERGE", "d", ["src"])
    assert [(c.name, c.transform, c.resolved) for c in st.columns] == [("v", "merge_update", [("src", "v")]), ("id", "merge_insert", [("src", "id")]), ("v", "merge_insert", [("src", "v")])]
    assert parse_statement("DELETE FROM a WHERE id IN (SELECT id FROM b)").sources == ["b"]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT x.a::numeric(10,2) AS a FROM x", [("a", "cast", [("x", "a")])]),
        ("SELECT TOP 5 [my col] AS c FROM [s].[t]", [("c", "direct", [("s.t", "my col")])]),
        ("SELECT a, b FROM t UNION ALL SELECT c, d FROM u", [("a", "direct", [("t", "a"), ("u", "c")]), ("b", "direct", [("t", "b"), ("u", "d")])]),
        ("SELECT ROW_NUMBER() OVER (PARTITION BY k ORDER BY d DESC) AS rn FROM t", [("rn", "window_function", [("t", "k"), ("t", "d")])]),
        ("SELECT DATEDIFF(day, a, b) AS n FROM t", [("n", "date_function", [("t", "a"), ("t", "b")])]),
        ("SELECT COALESCE(p, 'none') p2, (SELECT MAX(z) FROM u) m FROM t", [("p2", "coalesce", [("t", "p")]), ("m", "subquery", [("u", "z")])]),
    ],
)
def test_items(sql, want):
    assert cols(sql) == want


def test_dialect_tails():
    st = parse_statement("INSERT INTO t (a) SELECT a FROM s ON CONFLICT (a) DO NOTHING RETURNING a, b")
    assert st.subtype == "UPSERT" and st.returning == ["a", "b"] and st.sources == ["s"]
    assert parse_statement("SELECT a INTO #tmp FROM s").target == "#tmp"
    assert [c.name for c in parse_statement("CREATE TABLE x (a INT, b DECIMAL(10,2), PRIMARY KEY (a))").columns] == ["a", "b"]


@pytest.mark.parametrize("junk", ["", ";", "((((", "SELECT", "WITH a AS (", "'open", "INSERT INTO", "MERGE", "UPDATE SET", "SELECT , FROM ,", "é" * 50, "SELECT a FROM t WHERE x = 'it''s -- no'"])
def test_never_raises(junk):
    parse_statement(junk)


def test_splitting():
    sql = "CREATE PROCEDURE p AS BEGIN UPDATE a SET b = 'x;y'; DELETE FROM c; END;\n-- a;b\nSELECT 1;\nINSERT INTO t (a)\nSELECT a FROM s\nUPDATE q SET z = 1"
    assert [s.split()[0] for s in lexer.statements(sql)] == ["CREATE", "SELECT", "INSERT", "UPDATE"]
    assert lexer.without_comments("a '--x' -- y\n/* z */b") == "a '--x' \nb"


def test_analyze(spark):
    rows = [("f.sql", "USE db\nGO\nCREATE VIEW s.v AS SELECT a.x FROM s.a a\nGO\nCREATE PROCEDURE s.p AS BEGIN EXEC sp_executesql @q; END"), ("empty.sql", ""), ("null.sql", None)]
    st = lineage.analyze(spark.createDataFrame(rows, "file_path string, sql_text string"), "mssql").cache()
    got = {(r.object_kind, r.object_name, r.target_table, r.is_dynamic) for r in st.collect()}
    assert got == {("VIEW", "s.v", "s.v", False), ("PROCEDURE", "s.p", "s.p", True)}
    assert [tuple(r) for r in lineage.table_edges(st).select("src_table", "dst_table", "is_self_edge").collect()] == [("s.a", "s.v", False)]
    assert lineage.merged_columns(lineage.column_defs(st), lineage.column_edges(st)).select("sources", "confidence").first().asDict() == {"sources": ["s.a.x"], "confidence": 1.0}
    assert lineage.summary(st).first().total_statements == 2


def test_text_rules(spark):
    df = spark.createDataFrame([("SELECT * INTO #a FROM ##g g, t WHERE x = 1",)], "t string")
    assert df.select(cleaning.temp_names(F.col("t"), "tsql")).first()[0] == ["##g", "#a"]
    assert df.select(cleaning.is_valid_statement(F.col("t"), "tsql"), cleaning.normalize(F.lit(" a \n b ; ;"))).first()[1] == "a b;"
    assert spark.range(1).select(cleaning.fuzzy("c.t", F.lit("a_C_x.y_T"))).first()[0]
