"""Comparing results."""


def same_rows(a, b) -> bool:
    """Whether two pandas frames hold the same rows, in any order and numeric types."""
    import pandas as pd

    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)

    def one(v):
        if v is None or (not isinstance(v, (list, str)) and pd.isna(v)):
            return "~"
        if isinstance(v, str) or str(v) in ("True", "False"):
            return str(v)
        return f"{float(v):.6g}"

    rows = lambda f: sorted(tuple(one(v) for v in r) for r in f[columns].astype(object).itertuples(index=False))
    return rows(a) == rows(b)
