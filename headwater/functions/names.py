"""Names of tables and columns as Spark expressions: quoting, case, blanks, schema parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may quote a name, and what counts as a blank (also the no-break space).
QUOTES = r"[\[\]\"`]"
BLANK = r"[\s\xA0]"


def clean_name(name: Column) -> Column:
    """A name without quotes, in lower case, without blanks at the ends or round its dots; null where nothing is left.

    >>> clean_name(F.lit(' [Gold] . "Sales" '))  # gold.sales
    """
    bare = F.lower(F.regexp_replace(name, QUOTES, ""))
    tight = F.regexp_replace(bare, rf"^{BLANK}+|{BLANK}+$|{BLANK}*(\.){BLANK}*", "$1")
    return F.nullif(tight, F.lit(""))


def qualified(schema: Column, table: Column) -> Column:
    """schema.table of two cleaned parts, or the table alone where there is no schema; null without a table."""
    t = clean_name(table)
    return F.when(t.isNotNull(), F.concat_ws(".", clean_name(schema), t))


def schema_of(name: Column, default: str = "dbo") -> Column:
    """The schema part of a dotted name (the part before the last one), or the default."""
    parts = F.split(clean_name(name), r"\.")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit(default))


def object_of(name: Column) -> Column:
    """The last part of a dotted name."""
    return F.try_element_at(F.split(clean_name(name), r"\."), F.lit(-1))
