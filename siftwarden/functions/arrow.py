"""Arrow columns from Python values."""

from __future__ import annotations

import pyarrow as pa


def text_array(values: list[str | None]) -> pa.Array:
    """A string column. Half surrogate pairs, which JSON escapes can hold and UTF-8 cannot,
    become U+FFFD."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([None if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())
