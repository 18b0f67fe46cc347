"""From SQL text to statements: comments, noise, batches, kinds of objects, temporary names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions import rules
from headwater.operators import lexer

BLOCK_COMMENT, LINE_COMMENT = r"(?s)/\*.*?\*/", r"--[^\n]*"
GO_LINE = r"(?im)^[ \t]*GO(?:[ \t]+\d+)?[ \t]*\r?$"
MIN_STATEMENT = 10


def strip_comments(text: Column) -> Column:
    """Text without /* */ and -- comments, by patterns alone; also cuts what looks like a comment within a literal."""
    return F.regexp_replace(F.regexp_replace(text, BLOCK_COMMENT, ""), LINE_COMMENT, "")


def strip_comments_exactly(text: Column) -> Column:
    """Text without comments, literals and dollar-quoted bodies kept as they are."""

    @F.pandas_udf("string")
    def strip(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else lexer.without_comments(t))

    return strip(text)


def strip_noise(text: Column, dialect: str) -> Column:
    """Text without statements that carry no lineage."""
    for _, pattern in rules.NOISE[rules.dialect_of(dialect)]:
        text = F.regexp_replace(text, pattern, "")
    return text


def normalize(text: Column) -> Column:
    """Text on one line, single blanks, ending in one semicolon."""
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.concat(F.regexp_replace(F.trim(flat), r"[; ]+$", ""), F.lit(";"))


def split_batches(df: DataFrame, text: str = "sql_text", pattern: str = GO_LINE) -> DataFrame:
    """One row per batch between separator lines, numbered from 0 within its text; empty batches don't count."""
    parts = F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")
    keep = [c for c in df.columns if c not in (text, "ord", "content")]
    return df.select(*keep, F.posexplode(parts).alias("ord", "content"))


def split_statements(df: DataFrame, text: str = "content", dialect: str = "tsql") -> DataFrame:
    """One row per statement, numbered from 0 within its text. Semicolons in literals, comments, brackets, dollar-quoted and
    BEGIN ... END bodies don't split; a new statement may also start at a statement word at the start of a line."""
    d = rules.dialect_of(dialect)

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [] if t is None else lexer.statements(t, d))

    keep = [c for c in df.columns if c not in (text, "stmt_ord", "statement")]
    return df.select(*keep, F.posexplode(split(F.col(text))).alias("stmt_ord", "statement"))


def object_kind(text: Column, dialect: str) -> Column:
    """Kind of object that a batch creates, the first that fits; STATEMENT for all others."""
    kind = F.lit("STATEMENT")
    for name, pattern in reversed(rules.OBJECTS[rules.dialect_of(dialect)]):
        kind = F.when(text.rlike(pattern), F.lit(name)).otherwise(kind)
    return kind


def object_name(text: Column, dialect: str) -> Column:
    """Name of the object that a batch creates, or null."""
    found = F.lit(None).cast("string")
    for _, pattern in reversed(rules.OBJECTS[rules.dialect_of(dialect)]):
        found = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(found)
    return F.regexp_replace(found, r"[\[\]\"`]", "")


def is_valid_statement(text: Column, dialect: str) -> Column:
    """Whether a statement may carry lineage: long enough and starting with one of the dialect's words. Of declarations only
    table variables count, of IF blocks those that hold a statement."""
    t = F.trim(text)
    starts = "|".join(rules.STATEMENT_STARTS[rules.dialect_of(dialect)])
    table_variable = t.rlike(r"(?is)^DECLARE\s+@\w+\s+(?:AS\s+)?TABLE\b")
    block = t.rlike(r"(?is)^IF\b.*\b(?:SELECT|INSERT|UPDATE|DELETE|MERGE|CREATE)\b")
    return (F.length(t) >= MIN_STATEMENT) & (t.rlike(rf"(?i)^(?:{starts})\b") | table_variable | block)


def function_kind(text: Column) -> Column:
    """TABLE_FUNCTION, SCALAR_FUNCTION or FUNCTION by what it says to return."""
    table = text.rlike(r"(?i)\bRETURNS\s+(?:@\w+\s+)?(?:TABLE|SETOF)\b")
    return F.when(table, "TABLE_FUNCTION").when(text.rlike(r"(?i)\bRETURNS?\s+\w+"), "SCALAR_FUNCTION").otherwise("FUNCTION")


def temp_names(text: Column, dialect: str) -> Column:
    """Distinct temporary names in a text, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rules.TEMP_OBJECT[rules.dialect_of(dialect)]), F.lit(1)), lambda x: F.lower(x))))


def is_temp_name(name: Column, dialect: str) -> Column:
    return F.lower(name).rlike(rules.TEMP_NAME[rules.dialect_of(dialect)])


def feature_tags(text: Column, dialect: str) -> Column:
    """Tags of the dialect's features that a text uses, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(tag)) for tag, p in rules.FEATURES[rules.dialect_of(dialect)]]))


def subtype(text: Column, parsed: Column, dialect: str) -> Column:
    """Subtype of a statement: what its form says, else the first of the dialect's rules that its text fits."""
    d = rules.dialect_of(dialect)
    found = F.lit(None).cast("string")
    for name, pattern in reversed(rules.SUBTYPES[d]):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return F.coalesce(F.when(parsed == "MINUS", "EXCEPT").otherwise(parsed), found)


def transform_name(transform: Column, dialect: Column) -> Column:
    """A class of transformation by the name that the dialect's reports have for it."""
    for d, names in rules.TRANSFORM_NAMES.items():
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        transform = F.when(dialect == d, F.coalesce(F.try_element_at(known, transform), transform)).otherwise(transform)
    return transform


def is_dynamic(text: Column, dialect: str) -> Column:
    """Whether a text runs SQL that it builds itself."""
    pattern = {
        "tsql": r"(?i)\bsp_executesql\b|\bEXEC(?:UTE)?\s*\(",
        "postgres": r"(?i)\bEXECUTE\b[\s\S]*(?:\$|\bquote_|\bformat\s*\()",
        "oracle": r"(?i)\bEXECUTE\s+IMMEDIATE\b|\bDBMS_SQL\b",
        "teradata": r"(?i)\bSysExecSQL\b|\bEXECUTE\s+IMMEDIATE\b",
        "snowflake": r"(?i)\bEXECUTE\s+IMMEDIATE\b|\bIDENTIFIER\s*\(",
    }[rules.dialect_of(dialect)]
    return text.rlike(pattern)


def is_user_object(schema: Column, name: Column) -> Column:
    """Whether an object is none of the system's own."""
    return ~F.lower(F.coalesce(schema, F.lit(""))).isin(rules.SYSTEM_SCHEMAS) & ~F.lower(name).rlike(rules.SYSTEM_PREFIX)


def fuzzy(pattern: str, name: Column) -> Column:
    """Whether the letters of a pattern occur in a name in this order, in any case."""
    import re

    return name.rlike("(?i)" + ".*".join(re.escape(c) for c in pattern))
