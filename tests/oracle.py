"""Compare a query with its SQL: columns by name, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sources competitors articles article_classifications news_events event_articles event_groups watch_people".split()


def connect(folder: str):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 4)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else str(v)


def difference(df, con, sql: str) -> str:
    """Empty if they agree, else what differs."""
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    at = [names.index(c) for c in df.columns]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in got.fetchall())
    ours = Counter(tuple(map(_plain, r)) for r in df.collect())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
