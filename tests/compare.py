"""Row-for-row comparison of a Spark result with DuckDB's."""

from pyspark.sql import DataFrame


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df: DataFrame, duck, sql: str) -> None:
    r = duck.sql(sql)
    names = sorted(r.columns)
    assert names == sorted(df.columns)
    at = [r.columns.index(n) for n in names]
    theirs = sorted(repr(tuple(plain(row[i]) for i in at)) for row in r.fetchall())
    ours = sorted(repr(tuple(plain(v) for v in row)) for row in df.select(*names).collect())
    assert ours == theirs
