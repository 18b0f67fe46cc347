"""SQL for those queries of this package that plain SQL can express on whole tables."""

ORACLE_SQL = {
    "p6_found": """
WITH d AS (SELECT procedure_id, max(definition) AS t FROM catalog_procedures WHERE length(definition) > (SELECT limit_value FROM size_limits WHERE limit_name = 'definition_chars') GROUP BY procedure_id),
l AS (SELECT procedure_id, unnest(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM d)
SELECT procedure_id, CAST(max(CASE WHEN length(line) > (SELECT limit_value FROM size_limits WHERE limit_name = 'definition_chars') THEN 1 ELSE 0 END) AS INTEGER) AS forced_cut
FROM l GROUP BY procedure_id""",
}
