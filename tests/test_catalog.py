import datetime

import pytest
from pyspark.sql import functions as F

from headwater.functions import execute, udtf
from headwater.main import run_metadata
from headwater.operators import catalog, lineage, reports, routines
from headwater.sources import catalogs, corpus
from headwater.streaming.scripts import lineage_stream

TABLES = [("db", "dbo", "Orders", 10), ("db", "crm", "Customer", 5), ("db", "erp", "Customer", 7), ("db", "crm", "[Only One]", 1)]
COLUMNS = [("dbo", "Orders", "id", "int", False, 1), ("dbo", "Orders", "amount", "money", True, 2), ("crm", "Customer", "id", "int", False, 1), ("crm", "Customer", "city", "varchar", True, 2)]


@pytest.fixture()
def frames(spark):
    t = spark.createDataFrame(TABLES, "database_name string, schema_name string, table_name string, row_count long")
    c = spark.createDataFrame(COLUMNS, "schema_name string, table_name string, column_name string, data_type string, is_nullable boolean, ordinal_position int")
    return t, c


def test_names(spark, frames):
    t, _ = frames
    refs = spark.createDataFrame([("orders",), ("DBO.Orders",), ("customer",), ("[db].[crm].[customer]",), ("db..only one",), ("nowhere",), (None,), ("",)], "ref string")
    got = {r.ref: (r.qualified_name, r.resolved_by) for r in catalog.resolve_names(refs, "ref", t).collect()}
    assert got == {"orders": ("dbo.orders", "default"), "DBO.Orders": ("dbo.orders", "schema"), "customer": (None, None), "[db].[crm].[customer]": ("crm.customer", "full"), "db..only one": ("crm.only one", "database"), "nowhere": (None, None), None: (None, None), "": (None, None)}
    assert {r.table_name: r.qualified_names for r in catalog.disambiguation(t).filter("not is_unique").collect()} == {"customer": ["crm.customer", "erp.customer"]}
    text = spark.createDataFrame([(1, "x [crm].[Customer] y ORDERS customer"), (2, ""), (3, None)], "k int, body string")
    assert {(r.k, r.qualified_name) for r in catalog.references_in_text(text, "body", t).collect()} == {(1, "crm.customer"), (1, "dbo.orders")}


def test_assembly_keys_and_statistics(spark, frames):
    t, c = frames
    ix = spark.createDataFrame([("dbo.orders", 1, "K", "id", 1), ("dbo.orders", 4, "P", "b", 2), ("dbo.orders", 4, "P", "a", 1), ("crm.customer", 1, "K", "id", 1), ("crm.customer", 2, "K", "city", 1)], "table_name string, index_number int, index_type string, column_name string, position int")
    keys = catalog.primary_keys(ix)
    assert {r.table_name: r["columns"] for r in keys.collect()} == {"dbo.orders": ["a", "b"], "crm.customer": ["id"]}
    fk = spark.createDataFrame([("dbo", "orders", "fk1", "id", "crm.Customer", "id")], "schema_name string, table_name string, constraint_name string, column_name string, referenced string, referenced_column string")
    a = {r.qualified_name: r for r in catalog.assemble(t, c, keys, fk).collect()}
    assert [x.column_name for x in a["dbo.orders"]["columns"]] == ["id", "amount"] and a["dbo.orders"].primary_key == ["a", "b"] and a["dbo.orders"].foreign_keys[0].referenced == "crm.customer"
    assert a["erp.customer"]["columns"] == [] and a["erp.customer"].foreign_keys == [] and len(a) == 4
    sizes = spark.createDataFrame([("a", 1, 2, 9), ("a", 3, 4, None), ("b", 5, 6, 8)], "table_name string, current_bytes long, peak_bytes long, approximate_rows long")
    got = {tuple(r) for r in catalog.statistics(sizes, spark.createDataFrame([("a", 7)], "table_name string, row_count long")).collect()}
    assert got == {("a", 4, 6, 7, True), ("b", 5, 6, 8, False)}
    one = spark.range(1).select(catalog.backfill_header(F.lit("function"), F.lit("s"), F.lit("F(VARCHAR)"), F.lit("F(VARCHAR, NUMBER) RETURN VARCHAR"), F.lit("SELECT 1")), catalog.backfill_header(F.lit("procedure"), F.lit("s"), F.lit("p"), F.lit("()"), F.lit(" create procedure p() as x"))).first()
    assert list(one) == ["CREATE FUNCTION s.F(VARCHAR, NUMBER) RETURNS VARCHAR AS SELECT 1", " create procedure p() as x"]
    assert catalog.synthetic_statements(t, 2).count() == 2


def test_catalog_resolves_columns(spark, frames):
    _, c = frames
    st = lineage.analyze(spark.createDataFrame([("v", "CREATE VIEW dbo.v AS SELECT amount, city, id FROM dbo.orders o JOIN crm.customer c ON c.id = o.id")], "file_path string, sql_text string")).cache()
    edges = lineage.column_edges(st, resolved=True)
    assert {r.src_table for r in edges.collect()} == {"unknown"}
    full = catalog.resolve_unknown(edges, lineage.table_edges(st), c.select(F.concat_ws(".", "schema_name", "table_name").alias("table_name"), "column_name"))
    rows = {r.src_column: r for r in catalog.enrich_edges(full, c).collect()}
    assert (rows["amount"].src_table, rows["city"].src_table, rows["id"].src_table) == ("dbo.orders", "crm.customer", "unknown")
    assert rows["amount"].src_type == "money" and rows["amount"].src_nullable and rows["amount"].src_exists and not rows["id"].src_exists and not rows["city"].dst_table_exists


def test_description_as_json(spark, tmp_path):
    text = '{"database": "db", "tables": [{"schema": "dbo", "name": "a", "columns": [{"name": "x", "data_type": "int", "is_nullable": true}]}], "views": [{"schema_name": "dbo", "view_name": "v", "definition": "CREATE VIEW dbo.v AS SELECT x FROM dbo.a"}], "procedures": [{"schema_name": "dbo", "procedure_name": "p", "definition": "CREATE PROCEDURE dbo.p AS BEGIN INSERT INTO dbo.t (y) SELECT x FROM dbo.v; END"}, {"schema_name": "sys", "procedure_name": "q", "definition": "CREATE PROCEDURE sys.q AS BEGIN DELETE FROM dbo.a; END"}]}'
    (tmp_path / "m1.json").write_text("{}")
    (tmp_path / "m2.json").write_text(text)
    frames = catalogs.description(spark, str(tmp_path / "m*.json"))
    assert frames["columns"].first().asDict() == {"database_name": "db", "schema_name": "dbo", "table_name": "a", "column_name": "x", "data_type": "int", "is_nullable": True, "ordinal_position": 1}
    out = run_metadata(spark, frames, "tsql")
    assert {(r.src_table, r.dst_table) for r in out["table_edges"].collect()} == {("dbo.a", "dbo.v"), ("dbo.v", "dbo.t"), ("dbo.v", "dbo.p")}
    assert {(r.src_column, r.src_type) for r in out["column_edges_enriched"].filter("src_exists").collect()} == {("x", "int")}
    assert catalogs.description(spark, preloaded={"a": 1}) == {"a": 1} and catalogs.description(spark, preloaded={"a": 1}, fresh=lambda: {"b": 2}, force_refresh=True) == {"b": 2}
    assert all("/database_name=" in p or p for p in catalogs.write_description({"tables": frames["tables"].drop("columns")}, str(tmp_path / "out")))
    assert spark.read.json(str(tmp_path / "out" / "enhanced_metadata" / "tables")).first().database_name == "db"


def test_retries(spark):
    waits, tries = [], []

    def read():
        tries.append(1)
        if len(tries) < 4:
            raise RuntimeError("Connection reset by peer")
        return "done"

    assert catalogs.with_retries(read, sleep=waits.append) == "done" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(RuntimeError):
        catalogs.with_retries(lambda: (_ for _ in ()).throw(RuntimeError("no such table")), sleep=waits.append)
    asked = []
    out = catalogs.extract(spark, "postgresql", "h", 1, "db", ["tables", "views"], read=lambda s, d, h, p, b, q, **k: asked.append(q) or s.range(1))
    assert set(out) == {"tables", "views"} and len(asked) == 2 and out["tables"].first().database_name == "db"
    lines = spark.createDataFrame([("s", "p", "PROCEDURE", 2, "BEGIN NULL; END;"), ("s", "p", "PROCEDURE", 1, "PROCEDURE p IS\n")], "schema_name string, routine_name string, routine_type string, line int, text string")
    assert catalogs.sources_as_definitions(lines).first().definition == "CREATE PROCEDURE p IS\nBEGIN NULL; END;"


ROUTINES = [
    ("dbo.a", "CREATE PROCEDURE dbo.a (@n INT) AS BEGIN EXEC dbo.b; UPDATE t SET t.x = s.y FROM t JOIN s ON s.k = t.k; SELECT k INTO #tmp FROM s; END"),
    ("dbo.b", "CREATE PROCEDURE dbo.b AS BEGIN EXEC @rc = dbo.c 1; INSERT INTO t (x) SELECT SUM(y) FROM s; END"),
    ("dbo.c", "CREATE PROCEDURE dbo.c AS BEGIN EXEC dbo.b; END"),
    ("dbo.f", "CREATE FUNCTION dbo.f (@a INT) RETURNS INT AS BEGIN DECLARE @x INT; EXECUTE dbo.f; RETURN 1; END"),
    ("dbo.bad", None),
]


def test_reports(spark):
    facts = routines.routine_facts(spark.createDataFrame(ROUTINES, "name string, definition string")).cache()
    edges = {tuple(r) for r in reports.typed_edges(facts).collect()}
    assert {("dbo.a", "dbo.b", "procedure_call"), ("dbo.f", "dbo.f", "function_call"), ("dbo.a", "t", "table_write"), ("dbo.a", "#tmp", "table_create"), ("dbo.a", "t.x", "column_update"), ("dbo.b", "t.x", "column_write"), ("dbo.b", "s.y", "column_read"), ("t.x", "t", "column_of")} <= edges
    assert {r.first: (r.chain, r.n_links) for r in reports.call_chains(facts).collect()} == {"dbo.b": ("dbo.b > dbo.c > dbo.b", 2), "dbo.f": ("dbo.f > dbo.f", 1)}
    assert {r.name for r in reports.orphan_procedures(facts).collect()} == {"dbo.a"}
    assert {r.name: (r.level, r.is_circular) for r in reports.call_order(facts).collect()} == {"dbo.a": (0, False), "dbo.b": (None, True), "dbo.c": (None, True), "dbo.f": (0, False), "dbo.bad": (0, False)}
    use = {r.table_name: (r.read_count, r.write_count, r.n_procedures) for r in reports.table_usage(facts).collect()}
    assert use["s"] == (2, 0, 2) and use["t"] == (1, 2, 2)
    assert {r.column_ref: (r.n_read_by, r.n_written_by) for r in reports.column_access(facts).collect()}["t.x"] == (1, 2)
    assert {r.kind: (r.n_routines, r.success_rate) for r in reports.executable_summary(facts).collect()} == {"PROCEDURE": (3, "100.00%"), "FUNCTION": (1, "100.00%"), "": (1, "100.00%")}
    assert reports.top_complex(facts, 1).first().name == "dbo.b" and reports.weighted_complexity(facts).filter("name = 'dbo.b'").first().weighted_complexity == 2 + 10
    sub = {r.dst for r in reports.routine_subgraph(reports.typed_edges(facts), "DBO.B").collect()}
    assert sub == {"dbo.b", "dbo.c", "t", "s"}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert {r.node for r in reports.expand(e, spark.createDataFrame([("b",)], "node string")).collect()} == {"c"} and {r.node for r in reports.expand(e, spark.createDataFrame([("b",)], "node string"), False).collect()} == {"a"}
    assert [(r.node, r.layer, r.place) for r in reports.layers(e).orderBy("layer").collect()] == [("a", 0, 1), ("b", 1, 1), ("c", 2, 1), ("d", 3, 1)]
    have = spark.createDataFrame([("t", "Ab", 1), ("t", "ab", 2), ("t", "[c d]", 3)], "table_name string, column_name string, ordinal int")
    want = spark.createDataFrame([("T", "ab"), ("t", "AB"), ("t", "c d"), ("t", "z")], "table_name string, column_name string")
    assert {(r.table_name, r.column_name): r.ordinal for r in reports.find_columns(want, have).collect()} == {("T", "ab"): 2, ("t", "AB"): 1, ("t", "c d"): 3, ("t", "z"): None}
    empty = routines.routine_facts(spark.createDataFrame([], "name string, definition string"))
    assert reports.typed_edges(empty).count() == 0 and reports.call_chains(empty).count() == 0 and reports.executable_catalog(empty).count() == 0


def test_functions_run(spark):
    at = datetime.datetime(2024, 1, 31, 10)
    df = spark.createDataFrame([(3, None, "a,b", at, datetime.datetime(2024, 3, 1))], "i int, n int, s string, a timestamp, b timestamp")
    c, call = F.col, execute.call
    got = df.select(
        call("IFF", c("i") > 2, F.lit("y"), F.lit("n")), call("DECODE", c("i"), F.lit(1), F.lit("one"), F.lit(3), F.lit("three"), F.lit("?")), call("NVL2", c("n"), F.lit(1), F.lit(2)), call("ZEROIFNULL", c("n")), call("SPLIT_PART", c("s"), F.lit(","), F.lit(2)), call("DATEDIFF", "month", c("a"), c("b")),
        call("DATEDIFF", "day", c("a"), c("b")), call("DATEADD", "day", c("i"), c("b")).cast("string"), call("ARRAY_SIZE", call("ARRAY_CONSTRUCT_COMPACT", c("i"), c("n"))), call("BITXOR", c("i"), F.lit(5)), call("EDITDISTANCE", c("s"), F.lit("ab")), call("GREATEST", c("i"), F.lit(9)), call("ISNULL", c("n"), F.lit(4)), call("LEN", c("s")), call("TRY_TO_DOUBLE", c("s")),
    ).first()
    assert list(got) == ["y", "three", 2, 0, "b", 2, 30, "2024-03-04 00:00:00", 1, 6, 1, 9, 4, 3, None]
    with pytest.raises(NotImplementedError):
        call("ST_AREA", c("s"))


def test_table_functions(spark):
    udtf.register(spark)
    assert [r.statement for r in spark.sql("SELECT * FROM split_statements('SELECT 1 FROM a; SELECT 2 FROM b', 'oracle') ORDER BY ord").collect()] == ["SELECT 1 FROM a", "SELECT 2 FROM b"]
    assert [tuple(r) for r in spark.sql("SELECT target_table, column_name, src_table, src_column FROM parse_statement('INSERT INTO t (x) SELECT a FROM s')").collect()] == [("t", "x", "s", "a")]


def test_stream_writes_each_script_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("SELECT x INTO t FROM s")
    (tmp_path / "in" / "b.txt").write_text("no script")
    for _ in range(2):
        lineage_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.target_table for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["t"]


def test_first_files_and_history(spark, tmp_path):
    for n in "cab":
        (tmp_path / f"{n}.sql").write_text(n)
    assert sorted(r.sql_text for r in corpus.read_corpus(spark, str(tmp_path), max_files=2).collect()) == ["a", "b"]
    long = "SELECT something FROM somewhere WHERE a_long_condition = 1"
    rows = [(1, long, 5, datetime.datetime(2024, 5, 1)), (2, long, 9, datetime.datetime(2024, 1, 1)), (3, "SELECT 1", 9, datetime.datetime(2024, 5, 1)), (4, long.replace("somewhere", "sys.tables"), 9, datetime.datetime(2024, 5, 1)), (5, long, None, datetime.datetime(2024, 5, 1)), (6, long, 7, None)]
    h = spark.createDataFrame(rows, "id int, t string, n int, at timestamp")
    now = F.lit(datetime.datetime(2024, 5, 2))
    assert [r.id for r in corpus.history_top(h, "t", "n", "at", "id", now=now).collect()] == [1, 5]
