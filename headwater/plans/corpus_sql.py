"""The queries of ``corpus_queries`` as plain SQL, written independently of the operators, for a comparison in another engine."""

_CLEAN = r"nullif(regexp_replace(regexp_replace(lower(regexp_replace({0}, '[\[\]\"`]', '', 'g')), '^[\s\xA0]+|[\s\xA0]+$', '', 'g'), '[\s\xA0]*\.[\s\xA0]*', '.', 'g'), '')"


def clean(x: str) -> str:
    return _CLEAN.replace("{0}", x)


ORACLE_SQL = {
    "p1_found": f"""
WITH raw AS (
  SELECT database_name, snapshot_no, {clean("table_schema")} AS table_schema, {clean("table_name")} AS table_name,
         {clean("column_name")} AS column_name, loaded_at, lower(regexp_replace(data_type, '[\\s\\xA0]', '', 'g')) AS t
  FROM catalog_columns),
typed AS (
  SELECT r.*, coalesce(lower(regexp_replace(s.type_name, '[\\s\\xA0]', '', 'g')), regexp_replace(t, '\\(.*?\\)', '', 'g')) || regexp_extract(t, '\\(.*?\\)') AS ty
  FROM raw r LEFT JOIN type_synonyms s ON lower(regexp_replace(s.spelling, '[\\s\\xA0]', '', 'g')) = regexp_replace(t, '\\(.*?\\)', '', 'g')),
latest AS (
  SELECT database_name, snapshot_no, table_schema, table_name, column_name, ty FROM typed
  WHERE database_name IS NOT NULL AND snapshot_no IS NOT NULL AND table_schema IS NOT NULL AND table_name IS NOT NULL AND column_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY database_name, snapshot_no, table_schema, table_name, column_name ORDER BY loaded_at DESC, ty DESC) = 1),
pairs AS (
  SELECT database_name, snapshot_no, lag(snapshot_no) OVER (PARTITION BY database_name ORDER BY snapshot_no) AS before
  FROM (SELECT DISTINCT database_name, snapshot_no FROM latest)),
cur AS (SELECT l.*, p.before FROM latest l JOIN pairs p USING (database_name, snapshot_no) WHERE p.before IS NOT NULL),
old AS (SELECT l.*, p.snapshot_no AS after FROM latest l JOIN pairs p ON p.database_name = l.database_name AND p.before = l.snapshot_no)
SELECT coalesce(c.database_name, o.database_name) AS database_name, coalesce(c.table_schema, o.table_schema) AS table_schema,
       coalesce(c.table_name, o.table_name) AS table_name, coalesce(c.column_name, o.column_name) AS column_name,
       coalesce(c.snapshot_no, o.after) AS snapshot_no,
       CASE WHEN o.after IS NULL THEN 'added' WHEN c.snapshot_no IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN old o ON c.database_name = o.database_name AND c.snapshot_no = o.after AND c.table_schema = o.table_schema
  AND c.table_name = o.table_name AND c.column_name = o.column_name
WHERE o.after IS NULL OR c.snapshot_no IS NULL OR c.ty IS DISTINCT FROM o.ty""",
    "p2_found": f"""
WITH RECURSIVE links0 AS (SELECT {clean("table_name")} AS child, unnest(CASE WHEN len(depends_on) > 0 THEN depends_on ELSE [NULL] END) AS p FROM table_info),
links AS (SELECT child, {clean("p")} AS parent FROM links0),
edges AS (SELECT DISTINCT child, parent FROM links WHERE child IS NOT NULL AND parent IS NOT NULL AND child <> parent),
nodes AS (SELECT child AS node FROM links WHERE child IS NOT NULL UNION SELECT parent FROM links WHERE parent IS NOT NULL),
routes(root, node, n) AS (
  SELECT node, node, 0 FROM nodes WHERE node NOT IN (SELECT child FROM edges)
  UNION
  SELECT r.root, e.child, r.n + 1 FROM routes r JOIN edges e ON e.parent = r.node WHERE r.n < 400),
inner_nodes(node) AS (SELECT child FROM edges INTERSECT SELECT parent FROM edges),
reach(a, b) AS (
  SELECT parent, child FROM edges WHERE parent IN (SELECT node FROM inner_nodes)
  UNION
  SELECT r.a, e.child FROM reach r JOIN edges e ON e.parent = r.b WHERE e.child IN (SELECT node FROM inner_nodes)),
mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a)
SELECT 'route' AS case_kind, node AS table_name, root AS root_name, CAST(min(n) AS INTEGER) AS n_links FROM routes GROUP BY node, root
UNION ALL
SELECT 'cycle', a, min(b), CAST(count(*) AS INTEGER) FROM mutual GROUP BY a""",
    "p5_found": f"""
WITH own AS (
  SELECT statement_id, {clean("n")} AS n FROM (SELECT statement_id, unnest(list_concat(coalesce(cte_names, []), coalesce(temp_tables, []))) AS n FROM statement_lineage)),
refs AS (
  SELECT 'statement_lineage' AS origin, statement_id AS record_id, statement_id, {clean("t")} AS ref_table, analyzed_at AS seen_at
  FROM (SELECT statement_id, analyzed_at, unnest(source_tables) AS t FROM statement_lineage)
  UNION ALL
  SELECT 'column_lineage', lineage_id, statement_id, {clean("s.table_name")}, analyzed_at
  FROM (SELECT lineage_id, statement_id, analyzed_at, unnest(source_columns) AS s FROM column_lineage) WHERE s.cte_reference IS NULL
  UNION ALL
  SELECT 'foreign_keys', fk_id, NULL, CASE WHEN {clean("referenced_table")} IS NOT NULL THEN concat_ws('.', {clean("referenced_schema")}, {clean("referenced_table")}) END, captured_at FROM foreign_keys),
real_refs AS (
  SELECT DISTINCT origin, record_id, ref_table, seen_at FROM refs r
  WHERE ref_table IS NOT NULL AND seen_at IS NOT NULL AND record_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM own o WHERE o.statement_id = r.statement_id AND o.n = r.ref_table)),
lives AS (SELECT concat_ws('.', {clean("table_schema")}, {clean("table_name")}) AS k, create_date AS b, drop_date AS e FROM catalog_tables),
judged AS (
  SELECT r.origin, r.record_id, r.ref_table, r.seen_at, count(l.k) AS n,
         count(*) FILTER (l.k IS NOT NULL AND (l.b IS NULL OR l.b <= r.seen_at) AND (l.e IS NULL OR r.seen_at < l.e)) AS alive,
         count(*) FILTER (l.k IS NOT NULL AND l.b > r.seen_at) AS later
  FROM real_refs r LEFT JOIN lives l ON l.k = r.ref_table GROUP BY 1, 2, 3, 4)
SELECT DISTINCT origin, record_id, ref_table, CASE WHEN n = 0 THEN 'missing' WHEN later = n THEN 'later' ELSE 'deleted' END AS reason,
       strftime(seen_at, '%Y-%m') AS ref_month
FROM judged WHERE alive = 0""",
}
ORACLE_SQL["p1_deliveries"] = ORACLE_SQL["p1_found"]
ORACLE_SQL["p5_report"] = (
    "SELECT ref_table, ref_month, reason, count(*) AS n_references FROM (" + ORACLE_SQL["p5_found"] + ") GROUP BY ref_table, ref_month, reason"
)
#: Ways of the fewest links, all of them, of which the alphabetically first counts; and all that depends on each table.
_EDGES = ORACLE_SQL["p2_found"].split("routes(root")[0]
ORACLE_SQL["p2_paths"] = (
    _EDGES
    + """routes(root, node, n) AS (
  SELECT node, node, 0 FROM nodes WHERE node NOT IN (SELECT child FROM edges)
  UNION
  SELECT r.root, e.child, r.n + 1 FROM routes r JOIN edges e ON e.parent = r.node WHERE r.n < 400),
best AS (SELECT root, node, min(n) AS n FROM routes GROUP BY root, node),
ways(root, node, n, names) AS (
  SELECT root, node, 0, [node] FROM best WHERE n = 0
  UNION
  SELECT w.root, e.child, w.n + 1, list_append(w.names, e.child) FROM ways w JOIN edges e ON e.parent = w.node JOIN best b ON b.root = w.root AND b.node = e.child AND b.n = w.n + 1)
SELECT node AS table_name, root AS root_name, CAST(n AS INTEGER) AS n_links, array_to_string(min(names), ' > ') AS path FROM ways GROUP BY root, node, n"""
)
ORACLE_SQL["p2_dependents"] = (
    _EDGES
    + """inner_nodes(node) AS (SELECT child FROM edges INTERSECT SELECT parent FROM edges),
walks(a, b, n) AS (
  SELECT parent, child, 1 FROM edges
  UNION
  SELECT w.a, e.child, w.n + 1 FROM walks w JOIN edges e ON e.parent = w.b WHERE w.n < 60)
SELECT a AS table_name, b AS dependent_name, CAST(min(n) AS INTEGER) AS n_links FROM walks GROUP BY a, b"""
)
