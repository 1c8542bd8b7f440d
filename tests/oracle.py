"""Runs a query in Spark and its SQL in DuckDB, and compares rows as multisets."""

from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, int | float) or hasattr(v, "dtype"):
        return round(float(v), 6)
    return str(v)


def duck(sql: str, sf: str = SF) -> tuple[list[str], Counter]:
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = db.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(value(r[i]) for i in order) for r in out.fetchall())


def compare(df, sql: str, sf: str = SF) -> None:
    names, want = duck(sql, sf)
    assert sorted(df.columns) == names
    got = Counter(tuple(value(r[n]) for n in names) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
