"""Compare a query with its SQL as the driver does: rows sorted, columns by name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return None if v != v else round(v, 9)
        return v

    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr(tuple(map(plain, r))) for r in values.itertuples(index=False, name=None))


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    mine, theirs = query(spark, sf).toPandas(), con.execute(sql).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert rows(mine, columns) == rows(theirs, columns)
    return len(mine)
