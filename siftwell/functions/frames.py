"""Helpers for pandas frames inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """The frame with extension-typed columns as plain objects, which Spark converts also when empty."""
    odd = [c for c in frame.columns if not isinstance(frame[c].dtype, np.dtype)]
    return frame.assign(**{c: frame[c].to_numpy(dtype=object, na_value=None) for c in odd}) if odd else frame


def empty(names: list[str]) -> pd.DataFrame:
    """No rows, with columns of objects: the one empty type that fits every Spark type."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
