"""A small corpus of scripts in the five dialects, for queries whose results are written down by hand in ``corpus_golden``."""

SCRIPTS = {
    ("tsql", "load.sql"): """USE warehouse
GO
SET NOCOUNT ON;
-- staging; not a statement
SELECT o.OrderID, o.Amount * o.Qty AS Total, c.City INTO #stage FROM dbo.Orders AS o INNER JOIN dbo.Customers c ON c.CustomerID = o.CustomerID WHERE o.Status = 'open; paid';
INSERT INTO mart.CityTotals (City, Total, Loads)
SELECT s.City, SUM(s.Total), COUNT(DISTINCT s.OrderID) FROM #stage s GROUP BY s.City
UPDATE t SET t.Total = t.Total + d.Delta, t.Changed = GETDATE() FROM mart.CityTotals t JOIN dbo.Deltas d ON d.City = t.City
go 2
MERGE INTO mart.Dim AS d USING (SELECT Id, Name FROM dbo.Source) AS s ON d.Id = s.Id
WHEN MATCHED THEN UPDATE SET d.Name = s.Name
WHEN NOT MATCHED THEN INSERT (Id, Name) VALUES (s.Id, s.Name);
DELETE FROM mart.Old WHERE Id IN (SELECT Id FROM dbo.Gone);
GO
CREATE TRIGGER dbo.trg_orders ON dbo.Orders AFTER INSERT AS BEGIN INSERT INTO dbo.Audit (OrderID, At) SELECT i.OrderID, GETDATE() FROM inserted i; END
""",
    ("tsql", "routines.sql"): """CREATE PROCEDURE dbo.main_load (@from DATE, @rows INT = 0 OUTPUT) AS
BEGIN
  EXEC dbo.step_one @from;
  EXEC @rc = dbo.step_two;
  DELETE FROM mart.Facts;
  INSERT INTO mart.Facts (Id, Value) SELECT f.Id, f.Value / 2 FROM mart.Facts f JOIN dbo.Raw r ON r.Id = f.Id;
END
GO
CREATE PROC dbo.step_one @from DATE AS SELECT a, b INTO #t FROM dbo.Raw; EXEC dbo.step_two; UPDATE dbo.Log SET Text = 'DELETE FROM dbo.Never' WHERE Day = @from
GO
CREATE PROCEDURE dbo.step_two AS BEGIN DECLARE @sql NVARCHAR(200) = N'INSERT INTO dbo.Made (x) SELECT y FROM dbo.Dyn'; EXEC sp_executesql @sql; EXEC dbo.step_one; END
GO
CREATE FUNCTION dbo.rate (@a DECIMAL(10,2), @b DECIMAL(10,2)) RETURNS DECIMAL(10,4) AS BEGIN RETURN @a / NULLIF(@b, 0); END
GO
CREATE FUNCTION dbo.top_cities (@n INT) RETURNS TABLE AS RETURN (SELECT City, Total FROM mart.CityTotals)
""",
    ("postgres", "load.sql"): """SET search_path TO app;
CREATE TEMP TABLE tmp_days AS SELECT day, sum(n) AS n FROM app.visits GROUP BY day;
WITH RECURSIVE tree AS (SELECT id, boss FROM app.staff WHERE boss IS NULL UNION ALL SELECT s.id, s.boss FROM app.staff s JOIN tree t ON t.id = s.boss) SELECT id FROM tree;
INSERT INTO app.totals (day, n) SELECT day, n FROM tmp_days ON CONFLICT (day) DO UPDATE SET n = excluded.n RETURNING day, n;
CREATE MATERIALIZED VIEW app.daily AS SELECT v.day::date AS day, v.info->>'src' AS src, row_number() OVER (PARTITION BY v.day ORDER BY v.n) AS r FROM app.visits v;
CREATE FUNCTION app.f(a integer DEFAULT 1, OUT b text) RETURNS TABLE (x int, y text) AS $$ BEGIN DELETE FROM app.old; RETURN QUERY SELECT id, name FROM app.staff; END; $$ LANGUAGE plpgsql;
""",
    ("oracle", "load.sql"): """SET SERVEROUTPUT ON
INSERT ALL INTO sales_a (id, amount) VALUES (id, amount * 2) INTO sales_b (id) VALUES (id) SELECT s.id, s.amount FROM sales_raw s;
CREATE GLOBAL TEMPORARY TABLE gtt_x (id NUMBER(10), note VARCHAR2(20)) ON COMMIT DELETE ROWS;
SELECT e.name, d.title FROM emp e, dept d WHERE e.dept = d.id (+);
SELECT DECODE(x, 1, 'a', 'b') AS k FROM dual;
CREATE OR REPLACE TRIGGER trg_items AFTER INSERT ON items FOR EACH ROW BEGIN UPDATE heads SET total = total + :NEW.amount WHERE id = :NEW.head_id; END;
/
BEGIN INSERT INTO log_t (msg) SELECT msg FROM queue_t; END;
/
""",
    ("teradata", "load.sql"): """.LOGON prod/user
DATABASE sales;
CREATE VOLATILE MULTISET TABLE vt_days AS (SELECT sale_day, amount FROM sales.facts) WITH DATA ON COMMIT PRESERVE ROWS;
SEL store_id, amount FROM sales.facts QUALIFY ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY amount DESC) = 1;
INSERT INTO sales.best SELECT * FROM vt_days SAMPLE 10;
UPD sales.best SET amount = ZEROIFNULL(amount);
REPLACE VIEW sales.v AS LOCKING ROW FOR ACCESS SELECT b.amount AS total FROM sales.best b;
COLLECT STATISTICS ON sales.best;
CREATE MACRO sales.m (d DATE) AS (DELETE FROM sales.best WHERE sale_day = :d;);
""",
    ("snowflake", "load.sql"): """USE DATABASE raw;
COPY INTO raw.events FROM @landing/events FILE_FORMAT = (TYPE = JSON);
CREATE OR REPLACE TABLE raw.flat AS SELECT e.id, f.value:name::string AS name FROM raw.events e, LATERAL FLATTEN(input => e.payload) f;
SELECT e.payload:user.city AS city FROM raw.events e QUALIFY ROW_NUMBER() OVER (PARTITION BY e.id ORDER BY e.ts) = 1;
CREATE SECURE VIEW raw.v AS SELECT id, IFF(name IS NULL, 'none', name) AS name FROM raw.flat;
SELECT id FROM raw.flat AT (OFFSET => -60);
CREATE OR REPLACE PROCEDURE raw.refresh() RETURNS STRING LANGUAGE SQL AS $$ BEGIN EXECUTE IMMEDIATE 'INSERT INTO raw.log (id) SELECT id FROM raw.flat'; RETURN 'ok'; END; $$;
CREATE TASK raw.nightly WAREHOUSE = w SCHEDULE = '60 MINUTE' AS INSERT INTO raw.kept SELECT * FROM raw.flat;
""",
}
