"""Results of a query and of its SQL, made comparable."""

import math
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else str(v)


def both(spark, query, sql):
    """Sorted rows of the query and of the SQL over the small tables, by sorted column names."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if (DATA / f"{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, other = query(spark, str(DATA)), con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str), sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=str)
