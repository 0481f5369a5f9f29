"""The registered queries against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["normalize_arabic", "simple_search", "token_types", "search_page1", "search_counts", "search_batch", "fuzzy_adaptive_cutoff", "highlight_parts"]


def key(row):
    return tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"select {quoted} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(key(r) for r in df.select(*columns).collect()) == sorted(map(key, want))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
