"""Helpers of the tests. Not in conftest, a name that every test folder may have."""

import datetime as dt

START = dt.datetime(2024, 1, 1, 10)


def at(minutes: float) -> dt.datetime:
    """A time some minutes after the start."""
    return START + dt.timedelta(minutes=minutes)


def in_order(tuples):
    """Tuples sorted by the text of their values."""
    return sorted(tuples, key=lambda r: tuple((v is None, str(v)) for v in r))


def rows(df, *columns):
    """Rows as sorted tuples."""
    return in_order(tuple(r) for r in (df.select(*columns) if columns else df).collect())
