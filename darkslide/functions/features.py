"""Named column functions that name what they need, so that a set of them can be asked for by name.

A feature adds one column of its own name. There is nothing to schedule: once features are columns, Spark orders and
prunes them as any others."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    name: str
    needs: tuple[str, ...]
    column: Callable[[], Column]


FEATURES: dict[str, Feature] = {}


def feature(name: str, *needs: str, registry: dict[str, Feature] = FEATURES) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Register a column function under a name, with the columns or features that it reads."""

    def put(f: Callable[[], Column]) -> Callable[[], Column]:
        if name in registry:
            raise ValueError(f"feature {name} exists already")
        registry[name] = Feature(name, needs, f)
        return f

    return put


def with_features(df: DataFrame, *names: str, registry: dict[str, Feature] = FEATURES) -> DataFrame:
    """df with the named features and those that they need. A column that is there already is taken as it is; what is neither a column nor a
    feature, or needs itself, is an error."""
    wanted = list(names)
    for n in wanted:  # grows while it is read
        if n in registry:
            wanted += [x for x in registry[n].needs if x not in wanted]
    left = [n for n in wanted if n not in df.columns]
    while left:
        ready = [n for n in left if n in registry and all(x in df.columns for x in registry[n].needs)]
        if not ready:
            raise ValueError(f"no way to make {sorted(left)}")
        df = df.withColumns({n: registry[n].column() for n in ready})
        left = [n for n in left if n not in ready]
    return df


def vectorized(df: DataFrame, source: str, load: Callable[[], Callable[[list], np.ndarray]], out: str = "vec", rows: int = 256) -> DataFrame:
    """df with a vector of each value of `source` from a user's own model. load() is called once per task and gives a function from a
    list of at most `rows` values to a matrix with a row for each. Null values have no vector."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            result = pd.Series([None] * len(part), dtype=object)
            known = np.flatnonzero(part.notna())
            for at in range(0, len(known), rows):
                some = known[at : at + rows]
                for i, v in zip(some, np.asarray(model(part.iloc[some].tolist()), np.float32), strict=True):
                    result.iat[i] = v
            yield result

    return df.withColumn(out, run(source))
