"""Helpers on result frames that several test modules share."""


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]
