"""Rule tables per dialect: noise, objects, features, statement starts, temporary names, function families.

Patterns are read by both Python and Java, so they use no look-behind and no back references.
"""

from __future__ import annotations

DIALECTS = ("tsql", "postgres", "oracle", "teradata", "snowflake")
#: Other names of dialects that callers may use.
ALIASES = {"mssql": "tsql", "mysql": "tsql", "sqlite": "tsql", "sqlserver": "tsql", "pgsql": "postgres", "postgress": "postgres", "postgresql": "postgres"}
DEFAULT_SCHEMA = {"tsql": "dbo", "postgres": "public", "oracle": "", "teradata": "", "snowflake": "public"}


def dialect_of(name: str) -> str:
    """The dialect a name stands for."""
    d = ALIASES.get(name.lower(), name.lower())
    if d not in DIALECTS:
        raise ValueError(f"unknown dialect {name}; known are {', '.join(DIALECTS)}")
    return d


_LINE = r"(?im)^[ \t]*(?:{0})\b[^\n;]*;?[ \t]*$"
#: Statements that carry no lineage, from their first word to the end of the line or the semicolon.
NOISE = {
    "tsql": [("use", _LINE.format(r"USE")), ("set_option", _LINE.format(r"SET\s+(?:NOCOUNT|XACT_ABORT|ANSI_\w+|QUOTED_IDENTIFIER|ARITHABORT|CONCAT_NULL_YIELDS_NULL)")), ("print", _LINE.format("PRINT"))],
    "postgres": [
        ("settings", _LINE.format(r"SET\s+(?:SESSION\s+|LOCAL\s+)?\w+\s*(?:=|TO)|SHOW|RESET")),
        ("extension", _LINE.format(r"(?:CREATE|DROP)\s+EXTENSION")),
        ("transaction", r"(?im)^[ \t]*(?:BEGIN(?:\s+TRANSACTION|\s+WORK)?|COMMIT|ROLLBACK|SAVEPOINT\s+\w+|START\s+TRANSACTION)[ \t]*;[ \t]*$"),
        ("maintenance", _LINE.format(r"VACUUM|ANALYZE|LISTEN|NOTIFY")),
    ],
    "oracle": [
        ("sqlplus", _LINE.format(r"SET\s+(?:SERVEROUTPUT|ECHO|FEEDBACK|VERIFY|LINESIZE|PAGESIZE|DEFINE|TERMOUT)|PROMPT|SPOOL|WHENEVER|EXIT|REM")),
        ("transaction", _LINE.format(r"COMMIT|ROLLBACK|SAVEPOINT")),
        ("session", _LINE.format(r"ALTER\s+SESSION")),
        ("admin", _LINE.format(r"ANALYZE|GRANT|REVOKE|EXPLAIN\s+PLAN")),
        ("slash", r"(?m)^[ \t]*/[ \t]*$"),
    ],
    "teradata": [
        ("bteq", r"(?im)^[ \t]*\.[A-Z]+\b[^\n]*$"),
        ("transaction", r"(?im)^[ \t]*(?:BT|ET)[ \t]*;[ \t]*$"),
        ("load_tools", _LINE.format(r"(?:BEGIN|END)\s+(?:LOADING|MLOAD|EXPORT)|LOGTABLE|LOGON|LOGOFF")),
        ("statistics", _LINE.format(r"COLLECT\s+STAT(?:S|ISTICS)?")),
        ("session", _LINE.format(r"DATABASE|HELP|SHOW|SET\s+SESSION|SET\s+QUERY_BAND|DIAGNOSTIC|EXPLAIN")),
    ],
    "snowflake": [("use", _LINE.format(r"USE")), ("session", _LINE.format(r"ALTER\s+SESSION")), ("show", _LINE.format(r"SHOW|DESC(?:RIBE)?"))],
}

_NAME = r"((?:[\w$#@]+|\"[^\"]+\"|\[[^\]]+\]|`[^`]+`)(?:\s*\.\s*(?:[\w$#@]+|\"[^\"]+\"|\[[^\]]+\]|`[^`]+`))*)"
_CREATE = r"(?is)^\s*(?:CREATE(?:\s+OR\s+(?:REPLACE|ALTER))?|REPLACE|ALTER)\s+"
#: Kinds of objects in the order in which they are tried.
OBJECTS = {
    "tsql": [("PROCEDURE", _CREATE + r"PROC(?:EDURE)?\s+" + _NAME), ("FUNCTION", _CREATE + r"FUNCTION\s+" + _NAME), ("VIEW", _CREATE + r"VIEW\s+" + _NAME), ("TRIGGER", _CREATE + r"TRIGGER\s+" + _NAME)],
    "postgres": [
        ("FUNCTION", _CREATE + r"FUNCTION\s+" + _NAME),
        ("PROCEDURE", _CREATE + r"PROCEDURE\s+" + _NAME),
        ("MATERIALIZED_VIEW", _CREATE + r"MATERIALIZED\s+VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _NAME),
        ("VIEW", _CREATE + r"(?:TEMP(?:ORARY)?\s+)?(?:RECURSIVE\s+)?VIEW\s+" + _NAME),
        ("TRIGGER", _CREATE + r"(?:CONSTRAINT\s+)?TRIGGER\s+" + _NAME),
    ],
    "oracle": [
        ("PACKAGE_BODY", _CREATE + r"(?:(?:NON)?EDITIONABLE\s+)?PACKAGE\s+BODY\s+" + _NAME),
        ("PACKAGE", _CREATE + r"(?:(?:NON)?EDITIONABLE\s+)?PACKAGE\s+" + _NAME),
        ("PROCEDURE", _CREATE + r"(?:(?:NON)?EDITIONABLE\s+)?PROCEDURE\s+" + _NAME),
        ("FUNCTION", _CREATE + r"(?:(?:NON)?EDITIONABLE\s+)?FUNCTION\s+" + _NAME),
        ("TRIGGER", _CREATE + r"(?:(?:NON)?EDITIONABLE\s+)?TRIGGER\s+" + _NAME),
        ("MATERIALIZED_VIEW", _CREATE + r"MATERIALIZED\s+VIEW\s+" + _NAME),
        ("VIEW", _CREATE + r"(?:(?:NO\s+)?FORCE\s+)?(?:(?:NON)?EDITIONABLE\s+)?VIEW\s+" + _NAME),
        ("TYPE_BODY", _CREATE + r"TYPE\s+BODY\s+" + _NAME),
        ("TYPE", _CREATE + r"TYPE\s+" + _NAME),
    ],
    "teradata": [("PROCEDURE", _CREATE + r"PROCEDURE\s+" + _NAME), ("MACRO", _CREATE + r"MACRO\s+" + _NAME), ("FUNCTION", _CREATE + r"(?:SPECIFIC\s+)?FUNCTION\s+" + _NAME), ("VIEW", _CREATE + r"(?:RECURSIVE\s+)?VIEW\s+" + _NAME), ("TRIGGER", _CREATE + r"TRIGGER\s+" + _NAME)],
    "snowflake": [
        ("PROCEDURE", _CREATE + r"(?:SECURE\s+)?PROCEDURE\s+" + _NAME),
        ("FUNCTION", _CREATE + r"(?:SECURE\s+)?FUNCTION\s+" + _NAME),
        ("MATERIALIZED_VIEW", _CREATE + r"(?:SECURE\s+)?MATERIALIZED\s+VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _NAME),
        ("VIEW", _CREATE + r"(?:SECURE\s+)?(?:RECURSIVE\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _NAME),
        ("TASK", _CREATE + r"TASK\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _NAME),
        ("STREAM", _CREATE + r"STREAM\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _NAME),
        ("PIPE", _CREATE + r"PIPE\s+" + _NAME),
        ("STAGE", _CREATE + r"(?:TEMPORARY\s+)?STAGE\s+" + _NAME),
        ("FILE_FORMAT", _CREATE + r"FILE\s+FORMAT\s+" + _NAME),
        ("SEQUENCE", _CREATE + r"SEQUENCE\s+" + _NAME),
        ("MASKING_POLICY", _CREATE + r"MASKING\s+POLICY\s+" + _NAME),
        ("ROW_ACCESS_POLICY", _CREATE + r"ROW\s+ACCESS\s+POLICY\s+" + _NAME),
        ("TAG", _CREATE + r"TAG\s+" + _NAME),
        ("DYNAMIC_TABLE", _CREATE + r"DYNAMIC\s+TABLE\s+" + _NAME),
        ("EXTERNAL_TABLE", _CREATE + r"EXTERNAL\s+TABLE\s+" + _NAME),
    ],
}

#: Feature tags (the tags are fixed values) and how they are recognised.
FEATURES = {
    "tsql": [("TOP_N", r"(?i)\bSELECT\s+(?:DISTINCT\s+)?TOP\b"), ("APPLY", r"(?i)\b(?:CROSS|OUTER)\s+APPLY\b"), ("WINDOW", r"(?i)\bOVER\s*\("), ("PIVOT", r"(?i)\bPIVOT\s*\("), ("NOLOCK", r"(?i)\bNOLOCK\b"), ("TABLE_VARIABLE", r"(?i)\bDECLARE\s+@\w+\s+(?:AS\s+)?TABLE\b"), ("DYNAMIC_SQL", r"(?i)\bsp_executesql\b|\bEXEC(?:UTE)?\s*\(")],
    "postgres": [("ARRAY", r"(?i)\bARRAY\s*\[|\bunnest\s*\(|\barray_\w+\s*\("), ("JSONB", r"(?i)\bjsonb?_\w+\s*\(|->>?|#>>?|::\s*jsonb?\b"), ("WINDOW", r"(?i)\bOVER\s*\("), ("UPSERT", r"(?i)\bON\s+CONFLICT\b"), ("RETURNING", r"(?i)\bRETURNING\b"), ("RECURSIVE_CTE", r"(?i)\bWITH\s+RECURSIVE\b"), ("LATERAL", r"(?i)\bLATERAL\b")],
    "oracle": [
        ("CONNECT_BY", r"(?i)\bCONNECT\s+BY\b"), ("PIVOT", r"(?i)\bPIVOT\s*(?:XML\s*)?\("), ("UNPIVOT", r"(?i)\bUNPIVOT\b"), ("MODEL", r"(?i)\bMODEL\b[\s\S]*\bDIMENSION\s+BY\b"), ("FLASHBACK", r"(?i)\bAS\s+OF\s+(?:TIMESTAMP|SCN)\b"),
        ("VERSIONS_BETWEEN", r"(?i)\bVERSIONS\s+BETWEEN\b"), ("MERGE", r"(?i)\bMERGE\s+INTO\b"), ("DATABASE_LINK", r"(?i)\b[A-Z]\w*@[A-Z]\w*"), ("ORACLE_OUTER_JOIN", r"\(\s*\+\s*\)"), ("DUAL_TABLE", r"(?i)\bFROM\s+DUAL\b"), ("DECODE", r"(?i)\bDECODE\s*\("),
        ("KEEP", r"(?i)\bKEEP\s*\("), ("WITHIN_GROUP", r"(?i)\bWITHIN\s+GROUP\b"), ("PLSQL_BLOCK", r"(?i)\bBEGIN\b[\s\S]*\bEND\b"),
    ],
    "teradata": [
        ("QUALIFY", r"(?i)\bQUALIFY\b"), ("SAMPLE", r"(?i)\bSAMPLE\s+[0-9.]"), ("TOP_N", r"(?i)\bSEL(?:ECT)?\s+TOP\b"), ("TD_OUTER_JOIN", r"\(\s*\+\s*\)"), ("COLLECT_STATISTICS", r"(?i)\bCOLLECT\s+STAT"), ("VOLATILE_TABLE", r"(?i)\bVOLATILE\s+TABLE\b"),
        ("GLOBAL_TEMP_TABLE", r"(?i)\bGLOBAL\s+TEMPORARY\s+TABLE\b"), ("MULTISET", r"(?i)\bMULTISET\b"), ("NAMED", r"(?i)\(\s*NAMED\b"), ("TITLE", r"(?i)\(\s*TITLE\b"), ("FORMAT", r"(?i)\(\s*FORMAT\b"), ("EXEC_MACRO", r"(?i)\bEXEC(?:UTE)?\s+[A-Z]"), ("CALL_PROC", r"(?i)\bCALL\s+[A-Z]"),
    ],
    "snowflake": [
        ("LATERAL_FLATTEN", r"(?i)\bFLATTEN\s*\("), ("PARSE_JSON", r"(?i)\bPARSE_JSON\s*\("), ("VARIANT_ACCESS", r"(?i)\b[A-Z_]\w*:[A-Z_]"), ("OBJECT_CONSTRUCT", r"(?i)\bOBJECT_CONSTRUCT"), ("ARRAY_CONSTRUCT", r"(?i)\bARRAY_CONSTRUCT"), ("TIME_TRAVEL", r"(?i)\b(?:AT|BEFORE)\s*\(\s*(?:TIMESTAMP|OFFSET|STATEMENT|STREAM)\s*=>"),
        ("CHANGES", r"(?i)\bCHANGES\s*\("), ("QUALIFY", r"(?i)\bQUALIFY\b"), ("MATCH_RECOGNIZE", r"(?i)\bMATCH_RECOGNIZE\b"), ("COPY_INTO", r"(?i)\bCOPY\s+INTO\b"), ("STAGE_REFERENCE", r"(?i)(?:FROM|INTO)\s+@"), ("PIVOT", r"(?i)\bPIVOT\s*\("), ("UNPIVOT", r"(?i)\bUNPIVOT\s*\("), ("CONNECT_BY", r"(?i)\bCONNECT\s+BY\b"),
        ("SAMPLE", r"(?i)\b(?:TABLE)?SAMPLE\b"), ("GENERATOR", r"(?i)\bGENERATOR\s*\("), ("RESULT_SCAN", r"(?i)\bRESULT_SCAN\s*\("), ("DYNAMIC_SQL", r"(?i)\bEXECUTE\s+IMMEDIATE\b|\bIDENTIFIER\s*\("), ("WINDOW_FRAME", r"(?i)\b(?:ROWS|RANGE)\s+BETWEEN\b"),
    ],
}

#: Subtypes of statements by what they use, the first that fits, where the statement's form gives none.
SUBTYPES = {
    "tsql": [],
    "postgres": [("RECURSIVE_CTE", r"(?i)\bWITH\s+RECURSIVE\b")],
    "oracle": [("PLSQL_BLOCK", r"(?is)^\s*(?:DECLARE\b.*\bBEGIN\b|BEGIN\b)")],
    "teradata": [("QUALIFY", r"(?i)\bQUALIFY\b"), ("SAMPLE", r"(?i)\bSAMPLE\s+[0-9.]"), ("RECURSIVE_CTE", r"(?i)\bWITH\s+RECURSIVE\b")],
    "snowflake": [
        ("LATERAL_FLATTEN", r"(?i)\bFLATTEN\s*\("), ("PARSE_JSON", r"(?i)\bPARSE_JSON\s*\("), ("CONSTRUCT_OBJECT", r"(?i)\b(?:OBJECT|ARRAY)_CONSTRUCT"), ("TIME_TRAVEL", r"(?i)\b(?:AT|BEFORE)\s*\(\s*(?:TIMESTAMP|OFFSET|STATEMENT|STREAM)\s*=>"),
        ("CHANGES", r"(?i)\bCHANGES\s*\("), ("RESULT_SCAN", r"(?i)\bRESULT_SCAN\s*\("), ("QUERY_METADATA", r"(?i)\bLAST_QUERY_ID\s*\("), ("QUALIFY", r"(?i)\bQUALIFY\b"), ("MATCH_RECOGNIZE", r"(?i)\bMATCH_RECOGNIZE\b"),
        ("COPY_INTO", r"(?i)\bCOPY\s+INTO\b"), ("STAGE_REFERENCE", r"(?i)(?:FROM|INTO)\s+@"), ("PIVOT", r"(?i)\bPIVOT\s*\("), ("UNPIVOT", r"(?i)\bUNPIVOT\s*\("), ("CONNECT_BY", r"(?i)\bCONNECT\s+BY\b"), ("SAMPLE", r"(?i)\b(?:TABLE)?SAMPLE\b"),
        ("GENERATOR", r"(?i)\bGENERATOR\s*\("), ("GEOSPATIAL", r"(?i)\bST_\w+\s*\(|\bTO_GEO(?:GRAPHY|METRY)\s*\("), ("EXTERNAL_TABLE", r"(?i)\bEXTERNAL\s+TABLE\b"), ("SECURE_VIEW", r"(?i)\bSECURE\s+VIEW\b"), ("STREAM_CHECK", r"(?i)\bSYSTEM\$STREAM_HAS_DATA\s*\("),
        ("MASKING_POLICY", r"(?i)\bMASKING\s+POLICY\b"), ("ROW_ACCESS_POLICY", r"(?i)\bROW\s+ACCESS\s+POLICY\b"),
    ],
}
#: Classes of transformation that a dialect names otherwise.
TRANSFORM_NAMES = {
    "postgres": {"case": "case_statement", "arithmetic": "calculation"},
    "oracle": {"arithmetic": "calculated", "case": "calculated", "concat": "calculated", "cast": "calculated", "coalesce": "calculated", "substring": "calculated", "function": "calculated", "merge_update": "merge", "merge_insert": "merge"},
}

#: Words a statement with lineage may start with.
_STARTS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "WITH", "CREATE", "ALTER", "DROP", "TRUNCATE"]
STATEMENT_STARTS = {
    "tsql": [*_STARTS, "EXEC", "EXECUTE"],
    "postgres": [*_STARTS, "CALL", "COPY", "REFRESH"],
    "oracle": [*_STARTS, "CALL", "EXECUTE", "BEGIN"],
    "teradata": [*_STARTS, "SEL", "INS", "UPD", "DEL", "REPLACE", "LOCK", "LOCKING", "CALL", "EXEC"],
    "snowflake": [*_STARTS, "COPY", "PUT", "GET", "CALL", "EXECUTE", "LET"],
}

#: Names that are temporary by their spelling.
TEMP_NAME = {
    "tsql": r"^(?:#|@|temp_|tmp_|staging_|stg_)",
    "postgres": r"^(?:#|@|temp_|tmp_|staging_|stg_)",
    "oracle": r"^(?:#|@|temp_|tmp_|staging_|stg_|work_|wrk_|gtt_)",
    "teradata": r"^(?:#|@|temp_|tmp_|staging_|stg_|work_|wrk_|vt_|vol_)",
    "snowflake": r"^(?:#|@|temp_|tmp_|staging_|stg_)|(?:_temp|_tmp|_staging|_stg)$",
}
#: Names that statements declare as temporary.
TEMP_OBJECT = {
    "tsql": r"(?:^|[^#\w])(##?\w+)",
    "postgres": r"(?i)\bCREATE\s+(?:LOCAL\s+|GLOBAL\s+)?TEMP(?:ORARY)?\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)",
    "oracle": r"(?i)\bCREATE\s+(?:GLOBAL|PRIVATE)\s+TEMPORARY\s+TABLE\s+([\w.\"$#]+)",
    "teradata": r"(?i)\bCREATE\s+(?:MULTISET\s+|SET\s+)?(?:VOLATILE|GLOBAL\s+TEMPORARY)\s+(?:MULTISET\s+|SET\s+)?TABLE\s+([\w.\"]+)",
    "snowflake": r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?|TRANSIENT)\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)",
}
#: Schemas and name prefixes of the systems themselves.
SYSTEM_SCHEMAS = ["sys", "information_schema", "pg_catalog", "pg_toast", "dbc", "syslib", "sysudtlib", "system", "account_usage", "guest", "db_owner"]
SYSTEM_PREFIX = r"^(?:sp_|fn_|dt_|xp_)"

#: Families of functions, and the built-in of Spark where there is one.
FUNCTION_FAMILIES = {
    "json_parse": ["PARSE_JSON", "TO_JSON", "TO_VARIANT", "TRY_PARSE_JSON"],
    "object_construct": ["OBJECT_CONSTRUCT", "OBJECT_CONSTRUCT_KEEP_NULL"],
    "array_construct": ["ARRAY_CONSTRUCT", "ARRAY_CONSTRUCT_COMPACT"],
    "flatten": ["FLATTEN"],
    "array_aggregate": ["ARRAY_AGG", "OBJECT_AGG", "ARRAYAGG", "OBJECTAGG", "JSONB_AGG", "STRING_AGG"],
    "semi_structured_access": ["GET", "GET_PATH", "OBJECT_KEYS", "ARRAY_SIZE", "ARRAY_SLICE"],
    "geospatial": ["TO_GEOGRAPHY", "TO_GEOMETRY"],
    "aggregate": ["SUM", "COUNT", "AVG", "MIN", "MAX", "COUNT_BIG"],
    "window_function": ["ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE", "CUME_DIST", "PERCENT_RANK"],
    "conditional": ["IFF", "NULLIF", "ZEROIFNULL", "NULLIFZERO", "NVL", "NVL2", "DECODE", "IFNULL", "COALESCE", "GREATEST", "LEAST", "ISNULL"],
    "date_function": ["DATEADD", "DATEDIFF", "DATE_TRUNC", "TIME_SLICE", "CONVERT_TIMEZONE", "TIMESTAMPADD", "TIMESTAMPDIFF", "DATE_PART", "DAYOFWEEK", "DAYOFYEAR", "WEEKOFYEAR", "LAST_DAY", "NEXT_DAY", "PREVIOUS_DAY", "ADD_MONTHS", "GETDATE", "CURRENT_DATE", "SYSDATE", "YEAR", "MONTH", "DAY", "DATEPART"],
    "string_function": ["SPLIT_PART", "STRTOK", "STRTOK_TO_ARRAY", "SPLIT", "REGEXP_REPLACE", "REGEXP_SUBSTR", "REGEXP_COUNT", "REGEXP_INSTR", "TRIM", "LTRIM", "RTRIM", "LPAD", "RPAD", "REPEAT", "REVERSE", "TRANSLATE", "INITCAP", "SOUNDEX", "EDITDISTANCE", "UPPER", "LOWER", "SUBSTR", "SUBSTRING", "CONCAT", "REPLACE", "LENGTH", "LEN", "CHARACTERS", "BYTES"],
    "conversion": ["CAST", "CONVERT", "TRY_CAST", "TRY_CONVERT", "TRY_TO_NUMBER", "TRY_TO_DECIMAL", "TRY_TO_DOUBLE", "TRY_TO_DATE", "TRY_TO_TIMESTAMP", "TRY_TO_BINARY", "TRY_TO_BOOLEAN", "TO_CHAR", "TO_VARCHAR", "TO_NUMBER", "TO_DECIMAL", "TO_DOUBLE", "TO_DATE", "TO_TIMESTAMP", "TO_TIME", "TO_BINARY", "TO_BOOLEAN"],
    "hash_encrypt": ["HASH", "MD5", "MD5_HEX", "SHA1", "SHA1_HEX", "SHA2", "SHA2_HEX", "ENCRYPT", "DECRYPT", "ENCRYPT_RAW", "DECRYPT_RAW", "HASHROW", "HASHAMP", "HASHBUCKET"],
    "advanced_aggregate": ["LISTAGG", "MEDIAN", "MODE", "PERCENTILE_CONT", "PERCENTILE_DISC", "STDDEV", "STDDEV_POP", "STDDEV_SAMP", "VARIANCE", "VAR_POP", "VAR_SAMP", "CORR", "COVAR_POP", "COVAR_SAMP", "REGR_SLOPE", "REGR_INTERCEPT", "APPROX_COUNT_DISTINCT", "HLL", "APPROX_PERCENTILE", "APPROX_TOP_K", "MINHASH"],
    "bitwise": ["BITAND", "BITOR", "BITXOR", "BITNOT", "BITSHIFTLEFT", "BITSHIFTRIGHT"],
    "system_function": ["CURRENT_USER", "CURRENT_ROLE", "CURRENT_WAREHOUSE", "CURRENT_DATABASE", "CURRENT_SCHEMA", "CURRENT_SESSION", "CURRENT_STATEMENT"],
    "table_function": ["GENERATOR", "RESULT_SCAN", "VALIDATE", "INFER_SCHEMA", "SPLIT_TO_TABLE", "STRTOK_SPLIT_TO_TABLE"],
    "random": ["RANDOM"],
}
FAMILY_OF = {name: family for family, names in FUNCTION_FAMILIES.items() for name in names}
#: Built-ins of Spark under another name.
SPARK_FUNCTION = {"TO_VARIANT": "to_variant_object", "ARRAYAGG": "array_agg", "OBJECT_KEYS": "map_keys", "ARRAY_SIZE": "size", "ARRAY_SLICE": "slice", "GET_PATH": "variant_get", "GET": "element_at", "DATEADD": "timestampadd", "DATEDIFF": "timestampdiff", "IFF": "if", "ISNULL": "ifnull", "EDITDISTANCE": "levenshtein", "LEN": "length", "CHARACTERS": "length", "BYTES": "octet_length", "HASH": "xxhash64", "HLL": "approx_count_distinct", "GETDATE": "current_timestamp", "SYSDATE": "current_timestamp", "STRTOK": "split_part", "MD5_HEX": "md5", "SHA1_HEX": "sha1", "SHA2_HEX": "sha2", "COUNT_BIG": "count", "BITSHIFTLEFT": "shiftleft", "BITSHIFTRIGHT": "shiftright", "RANDOM": "rand"}
