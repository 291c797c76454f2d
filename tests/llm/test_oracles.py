"""Every query with SQL against DuckDB, over whole tables."""

import duckdb
import pytest

from tests.conftest import SF
from tonefold.llm.queries import ORACLES, QUERIES


def test_the_rest_cannot_be_said_in_sql():
    assert set(QUERIES) - set(ORACLES) == {"op2_url_filter", "op3_language_id", "op4_score_texts", "op7_media_copies", "op8_pack_sequences"}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = base.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())
