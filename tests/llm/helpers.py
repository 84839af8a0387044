def rows(df, *columns):
    """Sorted tuples of a frame."""
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
