"""Small helpers of the tests."""


def rows(df, *columns):
    """Sorted plain tuples of a small result."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)
