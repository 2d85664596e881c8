"""What several test modules use."""


def rows(df):
    """All rows as a sorted list of tuples; NULL sorts first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
