from pyspark.sql import functions as F

from headwater.operators import lexer, lineage, routines
from headwater.operators.parser import parse_statement
from headwater.plans.registry import QUERIES
from tests.helpers import DATA


def facts(spark, *bodies):
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "name string, definition string")
    return [r for r in routines.routine_facts(df).orderBy("name").collect()]


def test_reads_of_deleted_and_listed_tables(spark):
    a, b, c, d = facts(
        spark,
        "CREATE PROCEDURE p AS BEGIN SELECT x FROM dw.t; DELETE FROM dw.t WHERE k IN (SELECT k FROM s); DELETE FROM only_gone; END",
        "CREATE PROCEDURE p AS BEGIN INSERT INTO o SELECT 1 FROM a x, b AS y, (SELECT 1 FROM c) z, d JOIN e ON e.i = d.i AND f(1, 2) = 3, g ORDER BY h, i; SELECT EXTRACT(YEAR FROM day), j FROM [k].[l]; DELETE FROM m USING n, q WHERE 1 = 1; END",
        "CREATE FUNCTION f() RETURNS int AS $$ BEGIN EXECUTE 'DELETE FROM x WHERE k IN (SELECT k FROM y)'; SELECT 'taken FROM nowhere'; END $$",
        None,
    )
    assert a.reads == ["dw.t", "s"] and a.writes == ["dw.t", "only_gone"]
    assert b.reads == ["a", "b", "c", "d", "e", "g", "k.l", "n", "q"]
    assert c.reads == ["y"] and d.reads == []


def test_column_references_and_outputs_count_for_complexity(spark):
    head = "CREATE PROCEDURE dbo.p (@a INT, @n INT OUTPUT) AS BEGIN"
    a, b = facts(
        spark,
        f"{head} INSERT INTO dw.o (x, y) SELECT s.x, t.y FROM stg.s1 s JOIN t ON t.k = s.k\nUPDATE u SET u.v = s.v FROM dw.u u JOIN s2 s ON 1 = 1\nDELETE FROM d WHERE d.k = 1 END",
        f"{head} IF EXISTS (SELECT 1 FROM a x WHERE x.k = @a) BEGIN MERGE INTO d USING s ON d.k = s.k WHEN MATCHED THEN UPDATE SET v = CASE WHEN s.v > 0 THEN 1 ELSE s.w END; END; SET @n = 1; END",
    )
    assert a.column_refs == ["dw.o.x", "dw.o.y", "stg.s1.x", "t.y", "t.k", "stg.s1.k", "dw.u.v", "s2.v"] and a.n_outputs == 1 and a.n_parameters == 2
    assert b.column_refs == ["a.k", "d.k", "s.k", "s.v", "s.w"]
    parts = a.n_statements * 0.5 + 2 * 0.3 + len(a.reads) * 0.2 + len(a.writes) * 0.5 + 8 * 0.1 + len(a.temps) * 0.4 + len(a.calls) * 0.6 + 1 * 0.4
    assert a.complexity == round(parts, 2)


def test_routines_stay_whole():
    declared = " ".join(f"v{i} NUMBER := {i};" for i in range(150))
    long = f"CREATE OR REPLACE PROCEDURE p IS {declared} BEGIN INSERT INTO a SELECT 1 FROM b; END"
    nested = "CREATE PROCEDURE p IS PROCEDURE q IS BEGIN DELETE FROM a; END; x NUMBER; BEGIN q; DELETE FROM b; END"
    package = "CREATE PACKAGE BODY k AS PROCEDURE f; x NUMBER; PROCEDURE p IS BEGIN DELETE FROM a; END; FUNCTION q RETURN NUMBER IS BEGIN RETURN 1; END; BEGIN DELETE FROM c; END k"
    spec = "CREATE PACKAGE k AS PROCEDURE f(a NUMBER); x NUMBER; END k"
    for text in (long, nested, package, spec):
        assert lexer.statements(f"{text};\nSELECT 1 FROM t;", "oracle") == [text, "SELECT 1 FROM t"]
    bare = "CREATE PROC p AS SELECT a INTO #t FROM b; INSERT INTO c SELECT a FROM #t; DELETE FROM d"
    assert lexer.statements(bare, "tsql") == [bare]
    assert lexer.statements("CREATE MACRO m AS (SELECT 1 FROM a;); CREATE PROCEDURE p() BEGIN DELETE FROM b; END;", "teradata") == ["CREATE MACRO m AS (SELECT 1 FROM a;)", "CREATE PROCEDURE p() BEGIN DELETE FROM b; END"]
    assert lexer.statements("CREATE FUNCTION f() RETURNS int AS $$ BEGIN RETURN 1; END $$ LANGUAGE plpgsql; SELECT 1 FROM t; DO $$ BEGIN END $$;", "postgres")[1] == "SELECT 1 FROM t"


def test_bodies_of_routines_have_lineage(spark):
    proc = "CREATE PROCEDURE s.p AS BEGIN IF EXISTS (SELECT 1 FROM flags) BEGIN WITH c AS (SELECT a, b FROM src) INSERT INTO dst (x) SELECT a + b FROM c; UPDATE t SET t.v = u.w FROM t JOIN u ON u.k = t.k; END; DELETE FROM old WHERE k IN (SELECT k FROM gone) END"
    func = "CREATE FUNCTION s.f() RETURNS TABLE AS RETURN (SELECT q.m AS n FROM q)"
    st = lineage.analyze(spark.createDataFrame([("f.sql", f"{proc}\nGO\n{func}")], "file_path string, sql_text string"), "tsql").cache()
    assert {(r.src_table, r.dst_table) for r in lineage.table_edges(st).collect()} == {
        *((x, "s.p") for x in ("flags", "src", "u", "gone")), ("src", "dst"), ("u", "t"), ("gone", "old"), ("flags", "s.p"), ("q", "s.f"),
    }
    got = {(r.src_table, r.src_column, r.dst_table, r.dst_column) for r in lineage.column_edges(st, resolved=True).collect()}
    assert {("src", "a", "dst", "x"), ("src", "b", "dst", "x"), ("u", "w", "t", "v"), ("q", "m", "s.f", "n")} <= got
    assert [r.name for r in lineage.cte_table(st).collect()] == ["c"] and lineage.summary(st).first().total_statements == 2


def test_deep_and_recursive_ctes_end_at_stored_tables():
    deep = "WITH c0 AS (SELECT x FROM t)" + "".join(f", c{i} AS (SELECT x FROM c{i - 1})" for i in range(1, 60)) + " SELECT x FROM c59"
    assert parse_statement(deep).columns[0].resolved == [("t", "x")]
    loop = "WITH RECURSIVE r AS (SELECT x FROM t UNION ALL SELECT r.x FROM r) SELECT x FROM r"
    assert parse_statement(loop).columns[0].resolved == [("t", "x")]


def test_variables_are_no_targets():
    sql = "CREATE PROCEDURE p IS v NUMBER(3); BEGIN SELECT a INTO v FROM t; SELECT a, b INTO x, y FROM u; SELECT a INTO made FROM w; SELECT a INTO #tmp FROM made m; END"
    assert [(b.target, b.sources) for b in parse_statement(sql).body] == [(None, ["t"]), (None, ["u"]), ("made", ["w"]), ("#tmp", ["made"])]
    sql = "CREATE PROC p AS BEGIN\nMERGE INTO a USING b ON a.k = b.k WHEN MATCHED THEN UPDATE SET a.v = b.v WHEN NOT MATCHED THEN INSERT (k) VALUES (b.k)\nDELETE FROM c WHERE k IN (SELECT k FROM d)\nEND"
    assert [(b.kind, b.target, b.sources) for b in parse_statement(sql).body] == [("MERGE", "a", ["b"]), ("DELETE", "c", ["d"])]


def test_parser_runs_over_all_definitions(spark):
    n = {r.statement_type: r.n for r in QUERIES["routine_statement_types"](spark, DATA).groupBy("statement_type").agg(F.sum("n_statements").alias("n")).collect()}
    assert n["CREATE"] == spark.read.parquet(f"{DATA}/catalog_procedures.parquet").filter("definition is not null").select("procedure_id", "definition", "dialect").distinct().count() and n["INSERT"] > 0 and "ERROR" not in n
    assert QUERIES["routine_table_edges"](spark, DATA).filter("src_table is null or dst_table is null").isEmpty()
