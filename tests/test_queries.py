import pytest

from headwater.plans.registry import ORACLE_SQL, QUERIES
from tests.helpers import DATA, duck_rows, rows_of

NAMES = ["p1_found", "p1_deliveries", "p5_found", "merge_columns", "confidence_scores", "name_resolution", "parsed_sources", "medallion_gold", "p2_paths", "register_tables", "access_matrix", "text_references", "column_map", "function_calls", "routine_writes", "corpus_statements", "corpus_column_edges", "corpus_routines"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, DATA)) == duck_rows(ORACLE_SQL[name])


def test_every_sql_has_a_query():
    assert not ORACLE_SQL.keys() - QUERIES.keys()
