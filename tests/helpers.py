"""What tests share."""


def rows(df, *columns):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
