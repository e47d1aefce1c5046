"""Comparison of a query with its SQL in DuckDB over the same tables."""

from pathlib import Path

import duckdb


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: None if v is None or v != v else (bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v))
    return frame.sort_values(list(frame.columns), na_position="last").reset_index(drop=True)


def check(spark, sf, query, sql):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = normal(query(spark, sf).toPandas()), normal(con.execute(sql).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        differ = ~((got[c] == want[c]) | (got[c].isna() & want[c].isna()))
        assert not differ.any(), (c, got[differ].head(3).to_dict("records"), want[differ].head(3).to_dict("records"))
