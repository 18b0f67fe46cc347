"""SQL for the queries of ``lineage_queries``, for a comparison in another engine."""

from headwater.functions import rules
from headwater.plans.corpus_sql import clean

_LINKS = f"""WITH RECURSIVE raw AS (SELECT table_name AS t, unnest(depends_on) AS p FROM table_info),
links AS (SELECT DISTINCT {clean("p")} AS src, {clean("t")} AS dst FROM raw WHERE {clean("p")} <> {clean("t")}),
nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links),
"""
#: Nodes on a circle or behind one, and the longest way to each of the others.
_LEVELS = (
    _LINKS
    + """inner_nodes AS (SELECT dst AS n FROM links INTERSECT SELECT src FROM links),
reach(a, b) AS (SELECT src, dst FROM links WHERE src IN (SELECT n FROM inner_nodes) UNION SELECT r.a, l.dst FROM reach r JOIN links l ON l.src = r.b WHERE l.dst IN (SELECT n FROM inner_nodes)),
core AS (SELECT DISTINCT a AS node FROM reach WHERE a = b),
circular(node) AS (SELECT node FROM core UNION SELECT l.dst FROM circular c JOIN links l ON l.src = c.node),
up(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT dst FROM links) UNION SELECT l.dst, u.level + 1 FROM up u JOIN links l ON l.src = u.node WHERE l.dst NOT IN (SELECT node FROM circular))
"""
)
_FEATURES = " UNION ALL ".join(
    f"SELECT '{d}' AS dialect, '{tag}' AS tag, count(*) AS n_documents FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for d in ("postgres", "teradata") for tag, p in rules.FEATURES[d]
)
_CALLS = "SELECT unnest(regexp_extract_all(lower(query_sql_text), '([a-z_]\\w*)\\(', 1)) AS fn FROM query_history"
_FAMILIES = ", ".join(f"('{k.lower()}', '{v}')" for k, v in rules.FAMILY_OF.items())
_DEDUP_STATEMENTS = "(SELECT * FROM statement_lineage QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY loaded_at) = 1)"
_DEDUP_COLUMNS = "(SELECT * FROM column_lineage QUALIFY row_number() OVER (PARTITION BY lineage_id ORDER BY loaded_at) = 1)"
_SOURCES = f"""SELECT DISTINCT query_text_id, {clean("t")} AS table_name FROM (SELECT query_text_id, unnest(regexp_extract_all(query_sql_text, '(?i)\\b(?:from|join)[\\s\\xA0]+([^\\s\\xA0,;()]+)', 1)) AS t FROM query_history)"""


def _kind(dialect: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(definition, '{p}') THEN '{k}'" for k, p in rules.OBJECTS[dialect]) + f" ELSE 'STATEMENT' END AS kind_{dialect}"


ORACLE_SQL = {
    "strip_comments": "SELECT doc_id, length(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '--[^\\n]*', '', 'g')) AS n_left FROM documents",
    "split_batches": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ord, length(p) AS n_chars FROM (
SELECT doc_id, trim(unnest(string_split(text, chr(10) || chr(10))), ' ') AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents) WHERE p <> ''""",
    "normalize_whitespace": "SELECT DISTINCT query_text_id, regexp_replace(trim(regexp_replace(query_sql_text, '\\s+', ' ', 'g'), ' '), '[; ]+$', '') || ';' AS sql_text FROM query_history",
    "classify_documents": "SELECT DISTINCT procedure_id, " + ", ".join(_kind(d) for d in rules.DIALECTS) + " FROM catalog_procedures WHERE definition IS NOT NULL",
    "valid_statements": f"""SELECT upper(regexp_extract(trim(text, ' '), '^(\\w+)', 1)) AS first_word, count(*) AS n_documents FROM documents
WHERE length(trim(text, ' ')) >= 10 AND (regexp_matches(trim(text, ' '), '(?i)^(?:{"|".join(rules.STATEMENT_STARTS["tsql"])})\\b') OR regexp_matches(trim(text, ' '), '(?is)^DECLARE\\s+@\\w+\\s+(?:AS\\s+)?TABLE\\b')
  OR regexp_matches(trim(text, ' '), '(?is)^IF\\b.*\\b(?:SELECT|INSERT|UPDATE|DELETE|MERGE|CREATE)\\b')) GROUP BY 1""",
    "function_kinds": """SELECT CASE WHEN regexp_matches(definition, '(?i)\\bRETURNS\\s+(?:@\\w+\\s+)?(?:TABLE|SETOF)\\b') THEN 'TABLE_FUNCTION' WHEN regexp_matches(definition, '(?i)\\bRETURNS?\\s+\\w+') THEN 'SCALAR_FUNCTION' ELSE 'FUNCTION' END AS function_kind,
count(*) AS n_routines FROM (SELECT DISTINCT procedure_id, definition FROM catalog_procedures WHERE definition IS NOT NULL) GROUP BY 1""",
    "clean_stats": "SELECT lang, source, count(*) AS n_documents, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_chars FROM documents GROUP BY lang, source",
    "temp_names": f"""SELECT DISTINCT statement_id, {clean("t")} AS table_name FROM (SELECT statement_id, unnest(source_tables) AS t FROM statement_lineage)
WHERE regexp_matches(string_split({clean("t")}, '.')[-1], '{rules.TEMP_NAME["tsql"]}')""",
    "feature_counts": _FEATURES,
    "regex_sources": _SOURCES,
    "parsed_sources": _SOURCES,
    "statement_types": "SELECT 'SELECT' AS statement_type, count(*) AS n_statements, CAST(0 AS BIGINT) AS n_errors FROM (SELECT DISTINCT query_text_id, query_sql_text FROM query_history)",
    "statement_kinds": f"SELECT dialect, statement_type, count(*) AS n, CAST(sum(CASE WHEN is_dynamic THEN 1 ELSE 0 END) AS BIGINT) AS n_dynamic, count(parse_error) AS n_errors FROM {_DEDUP_STATEMENTS} GROUP BY dialect, statement_type",
    "confidence_scores": f"""WITH c AS (SELECT * FROM {_DEDUP_COLUMNS} WHERE target_table IS NOT NULL AND target_column IS NOT NULL),
b AS (SELECT lower(target_table) AS table_key, lower(target_column) AS column_key, count(DISTINCT transform_type) AS nt, max(CASE WHEN transform_type = 'direct' THEN 1 ELSE 0 END) AS dr, bool_or(is_aggregate) AS ag, count(DISTINCT file_path) AS ns FROM c GROUP BY 1, 2),
s AS (SELECT lower(target_table) AS table_key, lower(target_column) AS column_key, unnest(source_columns) AS s FROM c),
t AS (SELECT table_key, column_key, count(DISTINCT lower(concat_ws('.', s.table_name, s.column_name))) AS k, max(CASE WHEN s.cte_reference IS NOT NULL THEN 1 ELSE 0 END) AS cte FROM s GROUP BY 1, 2)
SELECT table_key, column_key, round((CASE WHEN dr = 1 THEN 1.0::DOUBLE WHEN nt > 2 THEN 0.7::DOUBLE WHEN ag THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN coalesce(k, 0) > 5 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN coalesce(cte, 0) = 1 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN ns > 1 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END), 2) AS confidence FROM b LEFT JOIN t USING (table_key, column_key)""",
    "cte_expand": f"""WITH c AS (SELECT lineage_id, statement_id, lower(s.cte_reference) AS cte FROM (SELECT lineage_id, statement_id, unnest(source_columns) AS s FROM column_lineage) WHERE s.cte_reference IS NOT NULL),
t AS (SELECT DISTINCT statement_id, {clean("t")} AS table_name FROM (SELECT statement_id, unnest(source_tables) AS t FROM statement_lineage))
SELECT DISTINCT lineage_id, cte, table_name FROM c JOIN t USING (statement_id) WHERE cte <> table_name""",
    "usage_inversion": "SELECT lower(t) AS temp_table, count(DISTINCT statement_id) AS n_statements, min(statement_id) AS first_statement FROM (SELECT statement_id, unnest(temp_tables) AS t FROM statement_lineage) GROUP BY 1",
    "catalog_summary": f"SELECT database_name, count(DISTINCT {clean('table_schema')} || '/' || {clean('table_name')}) AS n_tables, count(DISTINCT snapshot_no) AS n_deliveries, count(*) AS n_lines FROM catalog_columns GROUP BY 1",
    "system_filter": f"""SELECT s AS table_schema, count(*) AS n_tables FROM (SELECT DISTINCT {clean("table_schema")} AS s, {clean("table_name")} AS n FROM catalog_tables)
WHERE s NOT IN ({", ".join(f"'{x}'" for x in rules.SYSTEM_SCHEMAS)}) AND NOT regexp_matches(n, '{rules.SYSTEM_PREFIX}') GROUP BY s""",
    "dependencies": _LINKS.rstrip(",\n") + " SELECT src AS source_table, dst AS target_table FROM links",
    "exec_levels": "SELECT 'r' || n_regionkey AS node, CAST(0 AS INTEGER) AS level FROM nation UNION SELECT 'n' || n_nationkey, 1 FROM nation UNION SELECT 'c' || c_custkey, 2 FROM customer",
    "table_levels": _LEVELS + "SELECT node, CAST(max(level) AS INTEGER) AS level FROM up GROUP BY node",
    "circular_tables": _LEVELS + "SELECT DISTINCT node FROM circular",
    "bfs_levels": _LINKS
    + """start AS (SELECT min(src) AS s FROM links WHERE src NOT IN (SELECT dst FROM links)),
walk(node, depth) AS (SELECT s, 0 FROM start UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN links l ON l.src = w.node WHERE w.depth < 5)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""",
    "adjacency": _LINKS + "o AS (SELECT src AS node, count(*) AS n FROM links GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM links GROUP BY 1) SELECT node, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM nodes LEFT JOIN o USING (node) LEFT JOIN i USING (node)",
    "orphan_tables": "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "graph_export": f"""SELECT DISTINCT * FROM (SELECT {clean("target_table")} AS src, {clean("t")} AS dst, 'DEPENDS_ON' AS edge_type FROM (SELECT target_table, unnest(source_tables) AS t FROM statement_lineage)
UNION ALL SELECT file_path, {clean("target_table")}, 'WRITES' FROM statement_lineage) WHERE src IS NOT NULL AND dst IS NOT NULL""",
    "connected_nodes": "SELECT n_nationkey AS node FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> n_regionkey UNION SELECT n_regionkey FROM nation WHERE n_nationkey <> n_regionkey UNION SELECT n_nationkey FROM nation)",
    "focus_one_hop": _LINKS + "f AS (SELECT min(node) AS n FROM nodes) SELECT src, dst FROM links, f WHERE src = n OR dst = n",
    "component_sizes": _LINKS
    + """both_ways AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
cc(a, b) AS (SELECT node, node FROM nodes UNION SELECT cc.a, w.b FROM cc JOIN both_ways w ON w.a = cc.b)
SELECT component, count(*) AS n_tables FROM (SELECT a, min(b) AS component FROM cc GROUP BY a) GROUP BY component""",
    "fuzzy_search": "SELECT qualified_name FROM table_disambiguation WHERE regexp_matches(qualified_name, '(?i)c.*s.*t.*s.*u.*m') OR regexp_matches(qualified_name, '(?i)i.*n.*v.*h.*i.*s.*t')",
    "top_dependencies": _LINKS
    + "o AS (SELECT src AS node, count(*) AS n FROM links GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM links GROUP BY 1) SELECT node AS table_name, coalesce(i.n, 0) AS depends_on_count, coalesce(o.n, 0) AS referenced_by_count FROM nodes LEFT JOIN o USING (node) LEFT JOIN i USING (node) ORDER BY 2 DESC, 1 LIMIT 10",
    "schema_object_split": "SELECT full_name, string_split(lower(full_name), '.')[-2] AS schema_name, string_split(lower(full_name), '.')[-1] AS object_name FROM table_disambiguation",
    "medallion_silver": "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, upper(c_mktsegment) AS segment, coalesce(c_name, 'N/A') AS c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "medallion_gold": """SELECT o_custkey, count(DISTINCT o_orderkey) AS total_orders, CAST(sum(l_quantity) AS BIGINT) AS total_quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) AS total_revenue,
min(CAST(o_orderdate AS DATE)) AS first_order, max(CAST(o_orderdate AS DATE)) AS last_order FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""",
    "medallion_kpi_cte": """WITH sales AS (SELECT c_nationkey AS k, COUNT(DISTINCT o_orderkey) AS n_orders, SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
returned AS (SELECT c_nationkey AS k, COUNT(*) AS n_returns FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' GROUP BY c_nationkey)
SELECT s.k AS nation_key, s.n_orders, CAST(s.total AS DOUBLE) AS total_sales, COALESCE(r.n_returns, 0) AS n_returns, ROUND(COALESCE(r.n_returns, 0) / CAST(s.n_orders AS DOUBLE), 4) AS return_ratio FROM sales s LEFT JOIN returned r ON s.k = r.k""",
    "set_ops": """WITH s AS (SELECT s_nationkey AS k FROM supplier), c AS (SELECT c_nationkey AS k FROM customer)
SELECT k, 'union' AS op FROM (SELECT k FROM s UNION SELECT k FROM c) UNION ALL SELECT k, 'intersect' FROM (SELECT k FROM s INTERSECT SELECT k FROM c) UNION ALL SELECT k, 'except' FROM (SELECT k FROM c EXCEPT SELECT k FROM s)""",
    "window_rank": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "lateral_top1": """WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1)
SELECT o_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""",
    "function_families": f"SELECT c.fn, f.family, count(*) AS n_calls FROM ({_CALLS}) c JOIN (VALUES {_FAMILIES}) f(fn, family) ON c.fn = f.fn GROUP BY 1, 2",
}

_SCRIPT_USES = f"""u AS (SELECT DISTINCT file_path, {clean("t")} AS t, 'R' AS a FROM (SELECT file_path, unnest(source_tables) AS t FROM statement_lineage) UNION SELECT DISTINCT file_path, {clean("target_table")}, 'W' FROM statement_lineage)"""
_LAST = f"""last AS (SELECT database_name, max(snapshot_no) AS snapshot_no FROM catalog_columns WHERE table_schema IS NOT NULL AND table_name IS NOT NULL AND column_name IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY 1),
cols AS (SELECT database_name, {clean("table_schema")} AS s, {clean("table_name")} AS t, {clean("column_name")} AS c, data_type, is_nullable, loaded_at, ordinal_position FROM catalog_columns JOIN last USING (database_name, snapshot_no)
  WHERE table_schema IS NOT NULL AND table_name IS NOT NULL AND column_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY database_name, {clean("table_schema")}, {clean("table_name")}, {clean("column_name")} ORDER BY loaded_at DESC NULLS LAST, data_type DESC NULLS LAST, is_nullable DESC NULLS LAST, ordinal_position DESC NULLS LAST) = 1)"""
_FORMS = f"""tabs AS (SELECT DISTINCT {clean("database_name")} AS d, {clean("schema_name")} AS s, {clean("table_name")} AS t FROM table_disambiguation),
forms AS (SELECT form, min(s || '.' || t) AS q, count(DISTINCT d || '.' || s || '.' || t) AS n, min(rank) AS rank FROM (
  SELECT d || '.' || s || '.' || t AS form, 1 AS rank, d, s, t FROM tabs UNION ALL SELECT s || '.' || t, 2, d, s, t FROM tabs UNION ALL SELECT d || '..' || t, 3, d, s, t FROM tabs UNION ALL SELECT t, 4, d, s, t FROM tabs) GROUP BY form)"""

ORACLE_SQL |= {
    "register_tables": f"""WITH s AS (SELECT statement_id, file_path, statement_type, {clean("target_table")} AS dst, source_tables FROM {_DEDUP_STATEMENTS}),
e AS (SELECT DISTINCT file_path, {clean("t")} AS src, dst FROM (SELECT file_path, dst, unnest(source_tables) AS t FROM s WHERE dst IS NOT NULL) WHERE {clean("t")} IS NOT NULL AND {clean("t")} <> dst),
u AS (SELECT dst AS table_name, file_path, statement_type FROM s WHERE dst IS NOT NULL UNION SELECT src, file_path, 'REFERENCE' FROM e),
a AS (SELECT table_name, CAST(count(DISTINCT file_path) AS INTEGER) AS n_scripts, array_to_string(list_sort(list_distinct(list(statement_type))), ',') AS definition_types FROM u GROUP BY 1)
SELECT table_name, n_scripts, definition_types, (SELECT count(DISTINCT src) FROM e WHERE dst = table_name) AS depends_on_count, (SELECT count(DISTINCT dst) FROM e WHERE src = table_name) AS referenced_by_count FROM a""",
    "merge_columns": f"""WITH c AS (SELECT * FROM {_DEDUP_COLUMNS} WHERE target_table IS NOT NULL AND target_column IS NOT NULL),
b AS (SELECT lower(target_table) AS table_key, lower(target_column) AS column_key, array_to_string(list_sort(list_distinct(list(transform_type))), ',') AS transforms, count(DISTINCT transform_type) AS nt, coalesce(bool_or(transform_type = 'direct'), false) AS dr,
  bool_or(is_aggregate) AS is_aggregate, bool_or(is_calculated) AS is_calculated, count(DISTINCT file_path) AS n_scripts, count(*) AS n_definitions, CAST(least(count(DISTINCT expression), 10) AS INTEGER) AS n_expressions FROM c GROUP BY 1, 2),
s AS (SELECT lower(target_table) AS table_key, lower(target_column) AS column_key, unnest(source_columns) AS s FROM c),
t AS (SELECT table_key, column_key, count(DISTINCT concat_ws('.', s.table_name, s.column_name)) AS k, bool_or(s.cte_reference IS NOT NULL) AS cte FROM s GROUP BY 1, 2)
SELECT table_key, column_key, transforms, is_aggregate, is_calculated, n_scripts, n_definitions, CAST(coalesce(k, 0) AS INTEGER) AS n_sources, n_expressions,
  round((CASE WHEN dr THEN 1.0::DOUBLE WHEN nt > 2 THEN 0.7::DOUBLE WHEN is_aggregate THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN coalesce(k, 0) > 5 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN coalesce(cte, false) THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN n_scripts > 1 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END), 2) AS confidence FROM b LEFT JOIN t USING (table_key, column_key)""",
    "lineage_summary": f"""SELECT count(*) AS total_statements, count(DISTINCT file_path) AS total_files, count(DISTINCT {clean("target_table")}) AS total_targets, CAST(0 AS BIGINT) AS total_columns, count(parse_error) AS parse_errors, count(*) FILTER (is_dynamic) AS dynamic_statements, CAST(0 AS BIGINT) AS total_ctes,
printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (parse_error IS NULL) / count(*)) AS parse_success_rate FROM {_DEDUP_STATEMENTS}""",
    "usage_report": f"WITH {_SCRIPT_USES} SELECT t AS table_name, count(*) FILTER (a = 'R') AS read_count, count(*) FILTER (a = 'W') AS write_count, count(*) AS total_count, count(DISTINCT file_path) AS n_routines FROM u WHERE t IS NOT NULL GROUP BY t",
    "access_matrix": f"WITH {_SCRIPT_USES} SELECT t AS table_name, CAST(count(*) FILTER (a = 'R') AS INTEGER) AS n_read_by, CAST(count(*) FILTER (a = 'W') AS INTEGER) AS n_written_by FROM u WHERE t IS NOT NULL GROUP BY t",
    "history_top": """SELECT query_text_id, count_executions FROM (SELECT * FROM query_history QUALIFY row_number() OVER (PARTITION BY query_text_id ORDER BY loaded_at) = 1)
WHERE length(query_sql_text) >= 50 AND NOT regexp_matches(lower(query_sql_text), '\\b(?:sys|information_schema|pg_catalog|dbc)\\.') AND last_execution_time >= TIMESTAMP '2025-01-01' - INTERVAL 365 DAY ORDER BY count_executions DESC NULLS LAST, query_text_id LIMIT 1000""",
    "name_disambiguation": f"""WITH {_FORMS.split("forms AS")[0].rstrip().rstrip(",")} SELECT t AS table_name, count(DISTINCT s) AS n_schemas, count(DISTINCT s) = 1 AS is_unique, array_to_string(list_sort(list(DISTINCT s || '.' || t)), ',') AS qualified_names FROM tabs GROUP BY t""",
    "name_resolution": f"""WITH {_FORMS}, r AS (SELECT DISTINCT {clean("t")} AS ref FROM (SELECT unnest(source_tables) AS t FROM statement_lineage))
SELECT ref, CASE WHEN x.q IS NOT NULL AND f.rank IS NULL OR x.q IS NOT NULL AND f.rank > 2 THEN x.q ELSE f.q END AS resolved, CASE WHEN x.q IS NOT NULL AND (f.rank IS NULL OR f.rank > 2) THEN 'default' WHEN f.rank = 1 THEN 'full' WHEN f.rank = 2 THEN 'schema' WHEN f.rank = 3 THEN 'database' WHEN f.rank = 4 THEN 'name' END AS resolved_by
FROM r LEFT JOIN forms f ON f.form = ref AND f.n = 1 LEFT JOIN forms x ON x.form = 'dbo.' || ref AND NOT contains(ref, '.') AND x.n = 1 AND x.rank = 2 WHERE ref IS NOT NULL""",
    "column_map": f"WITH {_LAST} SELECT c AS column_name, count(DISTINCT s || '.' || t) AS n_tables, count(DISTINCT lower(data_type)) AS n_types, count(DISTINCT s || '.' || t) = 1 AS is_unique FROM cols GROUP BY c",
    "edge_enrichment": f"""WITH known AS (SELECT concat_ws('.', {clean("referenced_schema")}, {clean("referenced_table")}) AS t, {clean("referenced_column")} AS c, min(delete_action) AS ty FROM foreign_keys WHERE referenced_table IS NOT NULL GROUP BY 1, 2),
e AS (SELECT {clean("x.table_name")} AS st, {clean("x.column_name")} AS sc, {clean("target_table")} AS dt FROM (SELECT unnest(source_columns) AS x, target_table FROM {_DEDUP_COLUMNS}) WHERE x.cte_reference IS NULL AND x.table_name IS NOT NULL)
SELECT st IN (SELECT t FROM known) AS src_table_exists, k.t IS NOT NULL AS src_exists, coalesce(k.ty, '-') AS src_type, coalesce(dt IN (SELECT t FROM known), false) AS dst_table_exists, count(*) AS n_edges FROM e LEFT JOIN known k ON k.t = st AND k.c = sc GROUP BY 1, 2, 3, 4""",
    "key_assembly": f"""WITH {_LAST}, n AS (SELECT s || '.' || t AS q, count(DISTINCT c) AS n FROM cols GROUP BY 1),
f AS (SELECT * FROM foreign_keys QUALIFY row_number() OVER (PARTITION BY fk_id ORDER BY loaded_at) = 1),
k AS (SELECT concat_ws('.', {clean("schema_name")}, {clean("table_name")}) AS q, count(DISTINCT (constraint_name, {clean("column_name")}, {clean("referenced_schema")}, {clean("referenced_table")}, {clean("referenced_column")})) AS n, array_to_string(list_sort(list(DISTINCT {clean("column_name")})), ',') AS key_columns FROM f GROUP BY 1)
SELECT qualified_name, CAST(coalesce(n.n, 0) AS INTEGER) AS n_columns, CAST(coalesce(k.n, 0) AS INTEGER) AS n_keys, coalesce(key_columns, '') AS key_columns
FROM (SELECT DISTINCT concat_ws('.', {clean("table_schema")}, {clean("table_name")}) AS qualified_name FROM catalog_tables) LEFT JOIN n ON n.q = qualified_name LEFT JOIN k ON k.q = qualified_name""",
    "text_references": f"""WITH {_FORMS.replace("table_disambiguation", "(SELECT 'db' AS database_name, table_schema AS schema_name, table_name FROM catalog_tables)")}, p AS (SELECT DISTINCT procedure_id, definition FROM catalog_procedures WHERE definition IS NOT NULL),
w AS (SELECT procedure_id, unnest(regexp_extract_all(definition, '((?:\\[[^\\]\\n]+\\]|"[^"\\n]+"|`[^`\\n]+`|[A-Za-z_#@][\\w$#@]*)(?:\\.(?:\\[[^\\]\\n]+\\]|"[^"\\n]+"|`[^`\\n]+`|[A-Za-z_#@][\\w$#@]*))*)', 1)) AS n FROM p)
SELECT DISTINCT procedure_id, q AS qualified_name FROM w JOIN forms ON forms.form = {clean("w.n")} AND forms.n = 1""",
    "virtual_source_nodes": f"""WITH {_LAST}, known AS (SELECT s || '.' || t AS node, count(DISTINCT c) AS n FROM cols GROUP BY 1),
e AS (SELECT {clean("t")} AS src, {clean("target_table")} AS dst FROM (SELECT unnest(source_tables) AS t, target_table FROM statement_lineage)), named AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, CAST(1 AS INTEGER) AS in_catalog, n AS n_columns FROM known UNION ALL SELECT node, 0, 0 FROM named WHERE node IS NOT NULL AND node NOT IN (SELECT node FROM known)""",
    "expand_right": _LINKS.rstrip(",\n") + " SELECT DISTINCT dst AS node FROM links WHERE src NOT IN (SELECT dst FROM links) AND dst IN (SELECT dst FROM links)",
    "expand_left": _LINKS.rstrip(",\n") + " SELECT DISTINCT src AS node FROM links WHERE dst NOT IN (SELECT src FROM links)",
    "graph_layers": """WITH n AS (SELECT DISTINCT 'r' || lpad(CAST(n_regionkey AS VARCHAR), 9, '0') AS node, 0 AS layer FROM nation UNION SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), 1 FROM nation UNION SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 2 FROM customer)
SELECT node, CAST(layer AS INTEGER) AS layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY node) AS INTEGER) AS place FROM n""",
    "column_index": f"""WITH {_LAST}, have AS (SELECT concat_ws('.', database_name, s, t) AS t, c, min(ordinal_position) AS o FROM cols GROUP BY 1, 2),
want AS (SELECT DISTINCT concat_ws('.', database_name, {clean("table_schema")}, {clean("table_name")}) AS table_name, trim(column_name, ' ') AS column_name FROM catalog_columns WHERE snapshot_no = 1 AND table_schema IS NOT NULL AND table_name IS NOT NULL AND column_name IS NOT NULL)
SELECT table_name, column_name, o AS ordinal FROM want LEFT JOIN have ON lower(t) = lower(table_name) AND c = lower(regexp_replace(column_name, '[\\[\\]"`]', '', 'g'))""",
    "hovered_column": f"""WITH e AS (SELECT DISTINCT lower(x.table_name) AS src_table, lower(x.column_name) AS src_column, lower(target_table) AS dst_table, lower(target_column) AS dst_column FROM (SELECT unnest(source_columns) AS x, target_table, target_column FROM {_DEDUP_COLUMNS}) WHERE x.table_name IS NOT NULL AND x.column_name IS NOT NULL AND target_table IS NOT NULL AND target_column IS NOT NULL),
top AS (SELECT dst_table AS t, dst_column AS c FROM e GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)
SELECT e.* FROM e, top WHERE dst_table = t AND dst_column = c OR src_table = t AND src_column = c""",
    "routine_subgraph": "SELECT * FROM (VALUES ('dbo.main_load', 'dbo.step_two', 'procedure_call'), ('dbo.step_one', 'dbo.step_two', 'procedure_call'), ('dbo.step_two', 'dbo.step_one', 'procedure_call'), ('dbo.step_two', 'dbo.dyn', 'table_read'), ('dbo.step_two', 'dbo.made', 'table_write')) g(src, dst, edge_type)",
    "function_calls": """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class, CASE p_brand WHEN 'Brand#11' THEN 'a' WHEN 'Brand#12' THEN 'b' ELSE 'other' END AS brand_code, split_part(p_type, ' ', 1) AS first_word, CAST(p_size & 12 AS INTEGER) AS bits, length(p_name) AS name_length, greatest(p_size, 10) AS at_least_ten,
levenshtein(p_brand, 'Brand#11') AS distance, md5(p_name) AS name_md5, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS brand, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded, CASE WHEN p_type IS NOT NULL THEN 'y' ELSE 'n' END AS has_type, TRY_CAST(p_brand AS DOUBLE) AS no_number FROM part""",
    "date_functions": """SELECT o_orderkey, date_diff('month', o_orderdate, TIMESTAMP '2000-02-29') AS months, date_diff('day', o_orderdate, TIMESTAMP '2000-02-29') AS days, date_diff('year', o_orderdate, TIMESTAMP '2000-02-29') AS years, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month,
last_day(o_orderdate) AS month_end, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start FROM orders""",
}

#: Texts of routines without comments and with empty literals, and their names by pattern.
_BODIES = r"""WITH p AS (SELECT DISTINCT CAST(procedure_id AS VARCHAR) AS name, regexp_replace(regexp_replace(regexp_replace(definition, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), chr(39) || '[^' || chr(39) || ']*' || chr(39), '0', 'g') AS body FROM catalog_procedures WHERE definition IS NOT NULL) """
ORACLE_SQL |= {
    "routine_writes": _BODIES + r"""SELECT DISTINCT name, lower(regexp_replace(t, '[\[\]"`]', '', 'g')) AS table_name FROM (SELECT name, unnest(regexp_extract_all(body, '(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO|TRUNCATE\s+TABLE)\s+([\w.\[\]"`#]+)', 1)) AS t FROM p) WHERE lower(t) <> 'set'""",
    "routine_calls": _BODIES + r"""SELECT DISTINCT name, lower(regexp_replace(t, '[\[\]"`]', '', 'g')) AS called FROM (SELECT name, unnest(regexp_extract_all(body, '(?i)\b(?:EXEC|EXECUTE|CALL|PERFORM)\s+([\w.\[\]"`]+)', 1)) AS t FROM p) WHERE NOT regexp_matches(t, '(?i)^(?:sp_|xp_|fn_|immediate$|as$|on$|function$|procedure$)')""",
}
