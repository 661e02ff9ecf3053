"""What tests do with result rows."""


def values(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
