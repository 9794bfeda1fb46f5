"""Equal rows whatever their order, columns by name."""

import pandas as pd


def rows(df: pd.DataFrame) -> list[str]:
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in plain.itertuples(index=False, name=None))


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    assert [p for p in zip(x, y) if p[0] != p[1]][:3] == []
