"""User functions in Arrow batches: a row predicate, a text filter, a name mapper."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql.functions import pandas_udf


def predicate(f: Callable[[str], bool]):
    @pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def text_filter(f: Callable[[str], str]):
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def name_mapper(f: Callable[[str], list[str]]):
    @pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run
