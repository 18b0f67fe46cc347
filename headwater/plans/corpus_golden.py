"""Results of the queries on the corpus of scripts, written down and checked by reading the scripts; nothing here is computed."""

# fmt: off
GOLDEN = {
    "corpus_statements": """SELECT CAST(file_path AS VARCHAR) AS file_path, CAST(ord AS INTEGER) AS ord, CAST(stmt_ord AS INTEGER) AS stmt_ord, CAST(object_kind AS VARCHAR) AS object_kind, CAST(statement_type AS VARCHAR) AS statement_type, CAST(subtype AS VARCHAR) AS subtype, CAST(target AS VARCHAR) AS target, CAST(sources AS VARCHAR) AS sources, CAST(n_body AS INTEGER) AS n_body, CAST(is_dynamic AS BOOLEAN) AS is_dynamic FROM (VALUES
('oracle/load.sql', 0, 0, 'STATEMENT', 'INSERT', 'INSERT_ALL', 'sales_a', 'sales_raw', 1, false),
('oracle/load.sql', 0, 1, 'STATEMENT', 'CREATE', 'CREATE_GLOBAL_TEMP_TABLE', 'gtt_x', '', 0, false),
('oracle/load.sql', 0, 2, 'STATEMENT', 'SELECT', '-', '-', 'emp,dept', 0, false),
('oracle/load.sql', 0, 3, 'STATEMENT', 'SELECT', '-', '-', '', 0, false),
('oracle/load.sql', 0, 4, 'TRIGGER', 'CREATE', 'CREATE_TRIGGER', 'trg_items', 'items', 1, false),
('oracle/load.sql', 0, 5, 'STATEMENT', 'COMMAND', 'PLSQL_BLOCK', '-', 'queue_t', 1, false),
('postgres/load.sql', 0, 0, 'STATEMENT', 'CREATE', 'CTAS', 'tmp_days', 'app.visits', 0, false),
('postgres/load.sql', 0, 1, 'STATEMENT', 'SELECT', 'RECURSIVE_CTE', '-', 'app.staff', 0, false),
('postgres/load.sql', 0, 2, 'STATEMENT', 'INSERT', 'UPSERT', 'app.totals', 'tmp_days', 0, false),
('postgres/load.sql', 0, 3, 'MATERIALIZED_VIEW', 'CREATE', 'CREATE_MATERIALIZED_VIEW', 'app.daily', 'app.visits', 0, false),
('postgres/load.sql', 0, 4, 'FUNCTION', 'CREATE', 'CREATE_FUNCTION', 'app.f', 'app.staff', 2, false),
('snowflake/load.sql', 0, 0, 'STATEMENT', 'COMMAND', 'COPY_INTO', 'raw.events', '@landing', 0, false),
('snowflake/load.sql', 0, 1, 'STATEMENT', 'CREATE', 'CTAS', 'raw.flat', 'raw.events', 0, false),
('snowflake/load.sql', 0, 2, 'STATEMENT', 'SELECT', 'QUALIFY', '-', 'raw.events', 0, false),
('snowflake/load.sql', 0, 3, 'VIEW', 'CREATE', 'CREATE_VIEW', 'raw.v', 'raw.flat', 0, false),
('snowflake/load.sql', 0, 4, 'STATEMENT', 'SELECT', 'TIME_TRAVEL', '-', 'raw.flat', 0, false),
('snowflake/load.sql', 0, 5, 'PROCEDURE', 'CREATE', 'CREATE_PROCEDURE', 'raw.refresh', 'raw.flat', 1, true),
('snowflake/load.sql', 0, 6, 'TASK', 'CREATE', 'CREATE_TASK', 'raw.nightly', 'raw.flat', 1, false),
('teradata/load.sql', 0, 0, 'STATEMENT', 'CREATE', 'CTAS', 'vt_days', 'sales.facts', 0, false),
('teradata/load.sql', 0, 1, 'STATEMENT', 'SELECT', 'QUALIFY', '-', 'sales.facts', 0, false),
('teradata/load.sql', 0, 2, 'STATEMENT', 'INSERT', 'INSERT_SELECT', 'sales.best', 'vt_days', 0, false),
('teradata/load.sql', 0, 3, 'STATEMENT', 'UPDATE', '-', 'sales.best', '', 0, false),
('teradata/load.sql', 0, 4, 'VIEW', 'CREATE', 'CREATE_VIEW', 'sales.v', 'sales.best', 0, false),
('teradata/load.sql', 0, 5, 'MACRO', 'CREATE', 'CREATE_MACRO', 'sales.m', '', 1, false),
('tsql/load.sql', 1, 0, 'STATEMENT', 'SELECT', 'SELECT_INTO', '#stage', 'dbo.Orders,dbo.Customers', 0, false),
('tsql/load.sql', 1, 1, 'STATEMENT', 'INSERT', 'INSERT_SELECT', 'mart.CityTotals', '#stage', 0, false),
('tsql/load.sql', 1, 2, 'STATEMENT', 'UPDATE', '-', 'mart.CityTotals', 'dbo.Deltas', 0, false),
('tsql/load.sql', 2, 0, 'STATEMENT', 'MERGE', 'MERGE', 'mart.Dim', 'dbo.Source', 0, false),
('tsql/load.sql', 2, 1, 'STATEMENT', 'DELETE', '-', 'mart.Old', 'dbo.Gone', 0, false),
('tsql/load.sql', 3, 0, 'TRIGGER', 'CREATE', 'CREATE_TRIGGER', 'dbo.trg_orders', 'dbo.Orders', 1, false),
('tsql/routines.sql', 0, 0, 'PROCEDURE', 'CREATE', 'CREATE_PROCEDURE', 'dbo.main_load', 'mart.Facts,dbo.Raw', 2, false),
('tsql/routines.sql', 1, 0, 'PROCEDURE', 'CREATE', 'CREATE_PROCEDURE', 'dbo.step_one', 'dbo.Raw', 2, false),
('tsql/routines.sql', 2, 0, 'PROCEDURE', 'CREATE', 'CREATE_PROCEDURE', 'dbo.step_two', 'dbo.Dyn', 1, true),
('tsql/routines.sql', 3, 0, 'FUNCTION', 'CREATE', 'CREATE_FUNCTION', 'dbo.rate', '', 0, false),
('tsql/routines.sql', 4, 0, 'FUNCTION', 'CREATE', 'CREATE_FUNCTION', 'dbo.top_cities', 'mart.CityTotals', 1, false)
) g(file_path, ord, stmt_ord, object_kind, statement_type, subtype, target, sources, n_body, is_dynamic)""",
    "corpus_column_edges": """SELECT CAST(file_path AS VARCHAR) AS file_path, CAST(dst_table AS VARCHAR) AS dst_table, CAST(dst_column AS VARCHAR) AS dst_column, CAST(transform_type AS VARCHAR) AS transform_type, CAST(src_table AS VARCHAR) AS src_table, CAST(src_column AS VARCHAR) AS src_column FROM (VALUES
('oracle/load.sql', 'heads', 'total', 'arithmetic', 'heads', 'total'),
('oracle/load.sql', 'heads', 'total', 'arithmetic', 'items', 'amount'),
('oracle/load.sql', 'log_t', 'msg', 'direct', 'queue_t', 'msg'),
('oracle/load.sql', 'sales_a', 'amount', 'arithmetic', 'sales_raw', 'amount'),
('oracle/load.sql', 'sales_a', 'id', 'direct', 'sales_raw', 'id'),
('oracle/load.sql', 'sales_b', 'id', 'direct', 'sales_raw', 'id'),
('postgres/load.sql', 'app.daily', 'day', 'cast', 'app.visits', 'day'),
('postgres/load.sql', 'app.daily', 'r', 'window_function', 'app.visits', 'day'),
('postgres/load.sql', 'app.daily', 'r', 'window_function', 'app.visits', 'n'),
('postgres/load.sql', 'app.daily', 'src', 'jsonb_operation', 'app.visits', 'info'),
('postgres/load.sql', 'app.f', 'id', 'direct', 'app.staff', 'id'),
('postgres/load.sql', 'app.f', 'name', 'direct', 'app.staff', 'name'),
('postgres/load.sql', 'app.totals', 'day', 'direct', 'tmp_days', 'day'),
('postgres/load.sql', 'app.totals', 'n', 'direct', 'tmp_days', 'n'),
('postgres/load.sql', 'tmp_days', 'day', 'direct', 'app.visits', 'day'),
('postgres/load.sql', 'tmp_days', 'n', 'aggregate', 'app.visits', 'n'),
('snowflake/load.sql', 'raw.flat', 'id', 'direct', 'raw.events', 'id'),
('snowflake/load.sql', 'raw.flat', 'name', 'variant_access', 'raw.events', 'payload:name'),
('snowflake/load.sql', 'raw.kept', '*', 'direct', 'raw.flat', '*'),
('snowflake/load.sql', 'raw.log', 'id', 'direct', 'raw.flat', 'id'),
('snowflake/load.sql', 'raw.v', 'id', 'direct', 'raw.flat', 'id'),
('snowflake/load.sql', 'raw.v', 'name', 'conditional', 'raw.flat', 'name'),
('teradata/load.sql', 'sales.best', '*', 'direct', 'vt_days', '*'),
('teradata/load.sql', 'sales.best', 'amount', 'conditional', 'sales.best', 'amount'),
('teradata/load.sql', 'sales.v', 'total', 'direct', 'sales.best', 'amount'),
('teradata/load.sql', 'vt_days', 'amount', 'direct', 'sales.facts', 'amount'),
('teradata/load.sql', 'vt_days', 'sale_day', 'direct', 'sales.facts', 'sale_day'),
('tsql/load.sql', '#stage', 'City', 'direct', 'dbo.Customers', 'City'),
('tsql/load.sql', '#stage', 'OrderID', 'direct', 'dbo.Orders', 'OrderID'),
('tsql/load.sql', '#stage', 'Total', 'arithmetic', 'dbo.Orders', 'Amount'),
('tsql/load.sql', '#stage', 'Total', 'arithmetic', 'dbo.Orders', 'Qty'),
('tsql/load.sql', 'dbo.Audit', 'OrderID', 'direct', 'dbo.Orders', 'OrderID'),
('tsql/load.sql', 'mart.CityTotals', 'City', 'direct', '#stage', 'City'),
('tsql/load.sql', 'mart.CityTotals', 'Loads', 'aggregate', '#stage', 'OrderID'),
('tsql/load.sql', 'mart.CityTotals', 'Total', 'aggregate', '#stage', 'Total'),
('tsql/load.sql', 'mart.CityTotals', 'Total', 'arithmetic', 'dbo.Deltas', 'Delta'),
('tsql/load.sql', 'mart.CityTotals', 'Total', 'arithmetic', 'mart.CityTotals', 'Total'),
('tsql/load.sql', 'mart.Dim', 'Id', 'merge_insert', 'dbo.Source', 'Id'),
('tsql/load.sql', 'mart.Dim', 'Name', 'merge_insert', 'dbo.Source', 'Name'),
('tsql/load.sql', 'mart.Dim', 'Name', 'merge_update', 'dbo.Source', 'Name'),
('tsql/routines.sql', '#t', 'a', 'direct', 'dbo.Raw', 'a'),
('tsql/routines.sql', '#t', 'b', 'direct', 'dbo.Raw', 'b'),
('tsql/routines.sql', 'dbo.Made', 'x', 'direct', 'dbo.Dyn', 'y'),
('tsql/routines.sql', 'dbo.top_cities', 'City', 'direct', 'mart.CityTotals', 'City'),
('tsql/routines.sql', 'dbo.top_cities', 'Total', 'direct', 'mart.CityTotals', 'Total'),
('tsql/routines.sql', 'mart.Facts', 'Id', 'direct', 'mart.Facts', 'Id'),
('tsql/routines.sql', 'mart.Facts', 'Value', 'arithmetic', 'mart.Facts', 'Value')
) g(file_path, dst_table, dst_column, transform_type, src_table, src_column)""",
    "corpus_table_edges": """SELECT CAST(file_path AS VARCHAR) AS file_path, CAST(src_table AS VARCHAR) AS src_table, CAST(dst_table AS VARCHAR) AS dst_table, CAST(is_self_edge AS BOOLEAN) AS is_self_edge FROM (VALUES
('oracle/load.sql', 'items', 'heads', false),
('oracle/load.sql', 'items', 'trg_items', false),
('oracle/load.sql', 'queue_t', 'log_t', false),
('oracle/load.sql', 'sales_raw', 'sales_a', false),
('oracle/load.sql', 'sales_raw', 'sales_b', false),
('postgres/load.sql', 'app.staff', 'app.f', false),
('postgres/load.sql', 'app.visits', 'app.daily', false),
('postgres/load.sql', 'app.visits', 'tmp_days', false),
('postgres/load.sql', 'tmp_days', 'app.totals', false),
('snowflake/load.sql', '@landing', 'raw.events', false),
('snowflake/load.sql', 'raw.events', 'raw.flat', false),
('snowflake/load.sql', 'raw.flat', 'raw.kept', false),
('snowflake/load.sql', 'raw.flat', 'raw.log', false),
('snowflake/load.sql', 'raw.flat', 'raw.nightly', false),
('snowflake/load.sql', 'raw.flat', 'raw.refresh', false),
('snowflake/load.sql', 'raw.flat', 'raw.v', false),
('teradata/load.sql', 'sales.best', 'sales.v', false),
('teradata/load.sql', 'sales.facts', 'vt_days', false),
('teradata/load.sql', 'vt_days', 'sales.best', false),
('tsql/load.sql', '#stage', 'mart.CityTotals', false),
('tsql/load.sql', 'dbo.Customers', '#stage', false),
('tsql/load.sql', 'dbo.Deltas', 'mart.CityTotals', false),
('tsql/load.sql', 'dbo.Gone', 'mart.Old', false),
('tsql/load.sql', 'dbo.Orders', '#stage', false),
('tsql/load.sql', 'dbo.Orders', 'dbo.Audit', false),
('tsql/load.sql', 'dbo.Orders', 'dbo.trg_orders', false),
('tsql/load.sql', 'dbo.Source', 'mart.Dim', false),
('tsql/routines.sql', 'dbo.Dyn', 'dbo.Made', false),
('tsql/routines.sql', 'dbo.Dyn', 'dbo.step_two', false),
('tsql/routines.sql', 'dbo.Raw', '#t', false),
('tsql/routines.sql', 'dbo.Raw', 'dbo.main_load', false),
('tsql/routines.sql', 'dbo.Raw', 'dbo.step_one', false),
('tsql/routines.sql', 'dbo.Raw', 'mart.Facts', false),
('tsql/routines.sql', 'mart.CityTotals', 'dbo.top_cities', false),
('tsql/routines.sql', 'mart.Facts', 'dbo.main_load', false),
('tsql/routines.sql', 'mart.Facts', 'mart.Facts', true)
) g(file_path, src_table, dst_table, is_self_edge)""",
    "corpus_ctes": """SELECT CAST(file_path AS VARCHAR) AS file_path, CAST(name AS VARCHAR) AS name, CAST(columns AS VARCHAR) AS columns, CAST(sources AS VARCHAR) AS sources FROM (VALUES
('postgres/load.sql', 'tree', 'id,boss', 'app.staff')
) g(file_path, name, columns, sources)""",
    "corpus_registry": """SELECT CAST(table_name AS VARCHAR) AS table_name, CAST(n_scripts AS INTEGER) AS n_scripts, CAST(definition_types AS VARCHAR) AS definition_types, CAST(depends_on_count AS BIGINT) AS depends_on_count, CAST(referenced_by_count AS BIGINT) AS referenced_by_count, CAST(is_temp AS BOOLEAN) AS is_temp FROM (VALUES
('#stage', 1, 'REFERENCE,SELECT', 2, 1, true),
('#t', 1, 'SELECT', 1, 0, true),
('@landing', 1, 'REFERENCE', 0, 1, true),
('app.daily', 1, 'CREATE', 1, 0, false),
('app.f', 1, 'CREATE,SELECT', 1, 0, false),
('app.old', 1, 'DELETE', 0, 0, false),
('app.staff', 1, 'REFERENCE', 0, 1, false),
('app.totals', 1, 'INSERT', 1, 0, false),
('app.visits', 1, 'REFERENCE', 0, 2, false),
('dbo.audit', 1, 'INSERT', 1, 0, false),
('dbo.customers', 1, 'REFERENCE', 0, 1, false),
('dbo.deltas', 1, 'REFERENCE', 0, 1, false),
('dbo.dyn', 1, 'REFERENCE', 0, 2, false),
('dbo.gone', 1, 'REFERENCE', 0, 1, false),
('dbo.log', 1, 'UPDATE', 0, 0, false),
('dbo.made', 1, 'INSERT', 1, 0, false),
('dbo.main_load', 1, 'CREATE', 2, 0, false),
('dbo.orders', 1, 'REFERENCE', 0, 3, false),
('dbo.rate', 1, 'CREATE', 0, 0, false),
('dbo.raw', 1, 'REFERENCE', 0, 4, false),
('dbo.source', 1, 'REFERENCE', 0, 1, false),
('dbo.step_one', 1, 'CREATE', 1, 0, false),
('dbo.step_two', 1, 'CREATE', 1, 0, false),
('dbo.top_cities', 1, 'CREATE,SELECT', 1, 0, false),
('dbo.trg_orders', 1, 'CREATE', 1, 0, false),
('gtt_x', 1, 'CREATE', 0, 0, true),
('heads', 1, 'UPDATE', 1, 0, false),
('items', 1, 'REFERENCE', 0, 2, false),
('log_t', 1, 'INSERT', 1, 0, false),
('mart.citytotals', 2, 'INSERT,REFERENCE,UPDATE', 2, 1, false),
('mart.dim', 1, 'MERGE', 1, 0, false),
('mart.facts', 1, 'DELETE,INSERT,REFERENCE', 1, 1, false),
('mart.old', 1, 'DELETE', 1, 0, false),
('queue_t', 1, 'REFERENCE', 0, 1, false),
('raw.events', 1, 'COMMAND,REFERENCE', 1, 1, false),
('raw.flat', 1, 'CREATE,REFERENCE', 1, 5, false),
('raw.kept', 1, 'INSERT', 1, 0, false),
('raw.log', 1, 'INSERT', 1, 0, false),
('raw.nightly', 1, 'CREATE', 1, 0, false),
('raw.refresh', 1, 'CREATE', 1, 0, false),
('raw.v', 1, 'CREATE', 1, 0, false),
('sales.best', 1, 'DELETE,INSERT,REFERENCE,UPDATE', 1, 1, false),
('sales.facts', 1, 'REFERENCE', 0, 1, false),
('sales.m', 1, 'CREATE', 0, 0, false),
('sales.v', 1, 'CREATE', 1, 0, false),
('sales_a', 1, 'INSERT', 1, 0, false),
('sales_b', 1, 'INSERT', 1, 0, false),
('sales_raw', 1, 'REFERENCE', 0, 2, false),
('tmp_days', 1, 'CREATE,REFERENCE', 1, 1, true),
('trg_items', 1, 'CREATE', 1, 0, false),
('vt_days', 1, 'CREATE,REFERENCE', 1, 1, true)
) g(table_name, n_scripts, definition_types, depends_on_count, referenced_by_count, is_temp)""",
    "corpus_summary": """SELECT CAST(measure AS VARCHAR) AS measure, CAST(value AS VARCHAR) AS value FROM (VALUES
('complex_routines', '0'),
('dynamic_statements', '2'),
('failed_routines', '0'),
('parse_errors', '0'),
('parse_success_rate', '100.0%'),
('total_calls', '4'),
('total_columns', '56'),
('total_ctes', '1'),
('total_files', '6'),
('total_routines', '10'),
('total_statements', '35'),
('total_targets', '26')
) g(measure, value)""",
    "corpus_features": """SELECT CAST(dialect AS VARCHAR) AS dialect, CAST(feature AS VARCHAR) AS feature, CAST(n_statements AS BIGINT) AS n_statements FROM (VALUES
('oracle', 'DECODE', 1),
('oracle', 'DUAL_TABLE', 1),
('oracle', 'ORACLE_OUTER_JOIN', 1),
('oracle', 'PLSQL_BLOCK', 2),
('postgres', 'JSONB', 1),
('postgres', 'RECURSIVE_CTE', 1),
('postgres', 'RETURNING', 1),
('postgres', 'UPSERT', 1),
('postgres', 'WINDOW', 1),
('snowflake', 'COPY_INTO', 1),
('snowflake', 'DYNAMIC_SQL', 1),
('snowflake', 'LATERAL_FLATTEN', 1),
('snowflake', 'QUALIFY', 1),
('snowflake', 'STAGE_REFERENCE', 1),
('snowflake', 'TIME_TRAVEL', 1),
('snowflake', 'VARIANT_ACCESS', 2),
('teradata', 'MULTISET', 1),
('teradata', 'QUALIFY', 1),
('teradata', 'SAMPLE', 1),
('tsql', 'DYNAMIC_SQL', 1)
) g(dialect, feature, n_statements)""",
    "corpus_temp_tables": """SELECT CAST(file_path AS VARCHAR) AS file_path, CAST(table_name AS VARCHAR) AS table_name, CAST(n_uses AS BIGINT) AS n_uses FROM (VALUES
('oracle/load.sql', 'gtt_x', 0),
('postgres/load.sql', 'tmp_days', 1),
('teradata/load.sql', 'vt_days', 1),
('tsql/load.sql', '#stage', 1),
('tsql/routines.sql', '#t', 0)
) g(file_path, table_name, n_uses)""",
    "corpus_batches": """SELECT CAST(file_path AS VARCHAR) AS file_path, CAST(ord AS INTEGER) AS ord, CAST(first_word AS VARCHAR) AS first_word FROM (VALUES
('tsql/load.sql', 0, 'USE'),
('tsql/load.sql', 1, 'SET'),
('tsql/load.sql', 2, 'MERGE'),
('tsql/load.sql', 3, 'CREATE'),
('tsql/routines.sql', 0, 'CREATE'),
('tsql/routines.sql', 1, 'CREATE'),
('tsql/routines.sql', 2, 'CREATE'),
('tsql/routines.sql', 3, 'CREATE'),
('tsql/routines.sql', 4, 'CREATE')
) g(file_path, ord, first_word)""",
    "corpus_routines": """SELECT CAST(name AS VARCHAR) AS name, CAST(kind AS VARCHAR) AS kind, CAST(n_parameters AS INTEGER) AS n_parameters, CAST(n_outputs AS INTEGER) AS n_outputs, CAST(return_type AS VARCHAR) AS return_type, CAST(output_columns AS VARCHAR) AS output_columns, CAST(reads AS VARCHAR) AS reads, CAST(writes AS VARCHAR) AS writes, CAST(creates AS VARCHAR) AS creates, CAST(temps AS VARCHAR) AS temps, CAST(calls AS VARCHAR) AS calls FROM (VALUES
('app.f', 'FUNCTION', 2, 1, 'TABLE (x int, y text)', 'x,y', 'app.staff', 'app.old', '', '', ''),
('dbo.main_load', 'PROCEDURE', 2, 1, '-', '', 'dbo.raw,mart.facts', 'mart.facts', '', '', 'dbo.step_one,dbo.step_two'),
('dbo.rate', 'FUNCTION', 2, 0, 'DECIMAL(10,4)', '', '', '', '', '', ''),
('dbo.step_one', 'PROCEDURE', 1, 0, '-', '', 'dbo.raw', 'dbo.log', '#t', '#t', 'dbo.step_two'),
('dbo.step_two', 'PROCEDURE', 0, 0, '-', '', 'dbo.dyn', 'dbo.made', '', '', 'dbo.step_one'),
('dbo.top_cities', 'FUNCTION', 1, 0, 'TABLE', 'City,Total', 'mart.citytotals', '', '', '', ''),
('dbo.trg_orders', 'TRIGGER', 0, 0, '-', '', 'dbo.orders', 'dbo.audit', '', '', ''),
('raw.refresh', 'PROCEDURE', 0, 0, 'STRING', '', 'raw.flat', 'raw.log', '', '', ''),
('sales.m', 'MACRO', 1, 0, '-', '', '', 'sales.best', '', '', ''),
('trg_items', 'TRIGGER', 0, 0, '-', '', 'items', 'heads', '', '', '')
) g(name, kind, n_parameters, n_outputs, return_type, output_columns, reads, writes, creates, temps, calls)""",
    "corpus_routine_columns": """SELECT CAST(name AS VARCHAR) AS name, CAST(operation AS VARCHAR) AS operation, CAST(column_ref AS VARCHAR) AS column_ref FROM (VALUES
('app.f', 'READ', 'app.staff.id'),
('app.f', 'READ', 'app.staff.name'),
('dbo.main_load', 'READ', 'mart.facts.id'),
('dbo.main_load', 'READ', 'mart.facts.value'),
('dbo.main_load', 'WRITE', 'mart.facts.id'),
('dbo.main_load', 'WRITE', 'mart.facts.value'),
('dbo.step_one', 'READ', 'dbo.log.text'),
('dbo.step_one', 'READ', 'dbo.raw.a'),
('dbo.step_one', 'READ', 'dbo.raw.b'),
('dbo.step_one', 'UPDATE', 'dbo.log.text'),
('dbo.step_one', 'WRITE', 'dbo.log.text'),
('dbo.step_two', 'READ', 'dbo.dyn.y'),
('dbo.step_two', 'WRITE', 'dbo.made.x'),
('dbo.top_cities', 'READ', 'mart.citytotals.city'),
('dbo.top_cities', 'READ', 'mart.citytotals.total'),
('dbo.trg_orders', 'READ', 'dbo.orders.orderid'),
('dbo.trg_orders', 'WRITE', 'dbo.audit.at'),
('dbo.trg_orders', 'WRITE', 'dbo.audit.orderid'),
('raw.refresh', 'READ', 'raw.flat.id'),
('raw.refresh', 'WRITE', 'raw.log.id'),
('trg_items', 'READ', 'heads.total'),
('trg_items', 'READ', 'items.amount'),
('trg_items', 'UPDATE', 'heads.total'),
('trg_items', 'WRITE', 'heads.total')
) g(name, operation, column_ref)""",
    "corpus_routine_edges": """SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(edge_type AS VARCHAR) AS edge_type FROM (VALUES
('app.f', 'app.old', 'table_write'),
('app.f', 'app.staff', 'table_read'),
('app.f', 'app.staff.id', 'column_read'),
('app.f', 'app.staff.name', 'column_read'),
('dbo.main_load', 'dbo.raw', 'table_read'),
('dbo.main_load', 'dbo.step_one', 'procedure_call'),
('dbo.main_load', 'dbo.step_two', 'procedure_call'),
('dbo.main_load', 'mart.facts', 'table_read'),
('dbo.main_load', 'mart.facts', 'table_write'),
('dbo.main_load', 'mart.facts.id', 'column_read'),
('dbo.main_load', 'mart.facts.id', 'column_write'),
('dbo.main_load', 'mart.facts.value', 'column_read'),
('dbo.main_load', 'mart.facts.value', 'column_write'),
('dbo.step_one', '#t', 'table_create'),
('dbo.step_one', 'dbo.log', 'table_write'),
('dbo.step_one', 'dbo.log.text', 'column_read'),
('dbo.step_one', 'dbo.log.text', 'column_update'),
('dbo.step_one', 'dbo.log.text', 'column_write'),
('dbo.step_one', 'dbo.raw', 'table_read'),
('dbo.step_one', 'dbo.raw.a', 'column_read'),
('dbo.step_one', 'dbo.raw.b', 'column_read'),
('dbo.step_one', 'dbo.step_two', 'procedure_call'),
('dbo.step_two', 'dbo.dyn', 'table_read'),
('dbo.step_two', 'dbo.dyn.y', 'column_read'),
('dbo.step_two', 'dbo.made', 'table_write'),
('dbo.step_two', 'dbo.made.x', 'column_write'),
('dbo.step_two', 'dbo.step_one', 'procedure_call'),
('dbo.top_cities', 'mart.citytotals', 'table_read'),
('dbo.top_cities', 'mart.citytotals.city', 'column_read'),
('dbo.top_cities', 'mart.citytotals.total', 'column_read'),
('dbo.trg_orders', 'dbo.audit', 'table_write'),
('dbo.trg_orders', 'dbo.audit.at', 'column_write'),
('dbo.trg_orders', 'dbo.audit.orderid', 'column_write'),
('dbo.trg_orders', 'dbo.orders', 'table_read'),
('dbo.trg_orders', 'dbo.orders.orderid', 'column_read'),
('raw.refresh', 'raw.flat', 'table_read'),
('raw.refresh', 'raw.flat.id', 'column_read'),
('raw.refresh', 'raw.log', 'table_write'),
('raw.refresh', 'raw.log.id', 'column_write'),
('sales.m', 'sales.best', 'table_write'),
('trg_items', 'heads', 'table_write'),
('trg_items', 'heads.total', 'column_read'),
('trg_items', 'heads.total', 'column_update'),
('trg_items', 'heads.total', 'column_write'),
('trg_items', 'items', 'table_read'),
('trg_items', 'items.amount', 'column_read')
) g(src, dst, edge_type)""",
    "corpus_call_chains": """SELECT CAST(first AS VARCHAR) AS first, CAST(chain AS VARCHAR) AS chain, CAST(n_links AS INTEGER) AS n_links FROM (VALUES
('dbo.step_one', 'dbo.step_one > dbo.step_two > dbo.step_one', 2)
) g(first, chain, n_links)""",
    "corpus_call_order": """SELECT CAST(name AS VARCHAR) AS name, CAST(level AS INTEGER) AS level, CAST(is_circular AS BOOLEAN) AS is_circular FROM (VALUES
('app.f', 0, false),
('dbo.main_load', 0, false),
('dbo.rate', 0, false),
('dbo.step_one', -1, true),
('dbo.step_two', -1, true),
('dbo.top_cities', 0, false),
('dbo.trg_orders', 0, false),
('raw.refresh', 0, false),
('sales.m', 0, false),
('trg_items', 0, false)
) g(name, level, is_circular)""",
    "corpus_orphans": """SELECT CAST(name AS VARCHAR) AS name FROM (VALUES
('dbo.main_load'),
('raw.refresh')
) g(name)""",
    "corpus_complexity": """SELECT CAST(name AS VARCHAR) AS name, CAST(weighted_complexity AS BIGINT) AS weighted_complexity FROM (VALUES
('app.f', 2),
('dbo.main_load', 5),
('dbo.step_one', 2),
('dbo.trg_orders', 3),
('trg_items', 3)
) g(name, weighted_complexity)""",
}
