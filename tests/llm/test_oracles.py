"""The corpus queries against their SQL, through DuckDB."""

import os

import duckdb
import pytest

from marlstone.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, sf, name, size):
    folder = f"{os.path.dirname(sf)}/{size}"
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, folder).toArrow(), db.execute(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    plain = lambda rows: sorted(repr(tuple(r[c] for c in columns)) for r in rows.to_pylist())
    assert plain(got) == plain(want)
