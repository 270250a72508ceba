"""Helpers of the tests."""


def rows(df, *cols):
    """Sorted tuples of a result."""
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
