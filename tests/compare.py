"""Order-free comparison of two pandas tables."""

import datetime

import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:10]
    if isinstance(v, float) and v == int(v) if isinstance(v, float) and abs(v) < 1e15 else False:
        return int(v)
    return v


def rows(df):
    names = sorted(df.columns)
    return sorted(repr([plain(v) for v in r]) for r in df[names].itertuples(index=False, name=None))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y), (len(x), len(y))
    assert x == y, [(i, j) for i, j in zip(x, y) if i != j][:3]
