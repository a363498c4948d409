"""What operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


class Result:
    """An operator with its lazy result in ``table``.

    Ranks over whole tables need their input counted first; such operators have ``_make``, which is
    called when ``table`` is first asked for.
    """

    index: list[str] = []
    _make: Callable[[], DataFrame]

    @functools.cached_property
    def table(self) -> DataFrame:
        return self._make()

    @functools.cached_property
    def df(self) -> Any:
        """The result as pandas, collected once; operators over customers carry their keys as index."""
        frame = self.table.toPandas()
        return frame.set_index(self.index) if self.index else frame


def listed(value: str | list[str] | None, name: str = "group_col") -> list[str]:
    """A column name, a list of them or none, as a list."""
    if value is None:
        return []
    if isinstance(value, str):
        return [value]
    if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
        raise TypeError(f"{name} must be a column name or a list of column names")
    if not value:
        raise ValueError(f"{name} must not be empty")
    return list(value)
