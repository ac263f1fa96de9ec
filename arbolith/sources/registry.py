"""Names for what users plug in: normalisers, rewards, metrics, samplers, formatters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.functions.parsing import span_weights
from arbolith.functions.scalars import format_reward, stated_reward
from arbolith.operators.sampling import sample_exactly, weighted_top
from arbolith.operators.selection import hermes_calls, react_calls


class Registry:
    """A dict that refuses to overwrite by accident."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def add(self, name: str, exist_ok: bool = False) -> Callable[[Any], Any]:
        def keep(f: Any) -> Any:
            if name in self.entries and not exist_ok:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.entries[name] = f
            return f

        return keep

    def __getitem__(self, name: str) -> Any:
        if name not in self.entries:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self.entries)}")
        return self.entries[name]


#: DataFrame -> DataFrame; Column(s) -> Column; DataFrame -> one-row DataFrame; DataFrame -> DataFrame.
normalisers, rewards, metrics, samplers = (Registry(k) for k in ("normaliser", "reward", "metric", "sampler"))
#: Column -> Column of weighted spans; (name, arguments) Columns -> Column of the call's text.
loss_scales, dialects = Registry("loss scale"), Registry("dialect")
#: Which turns of a chat count, whatever the loss scale.
STRATEGIES = ("default", "last_round", "all")

loss_scales.add("base")(lambda text: F.array(F.struct(text.alias("content"), F.lit(1.0).alias("weight"))))
loss_scales.add("react")(lambda text: span_weights(text, {"Action:": (2.0, 2.0), "Action Input:": (2.0, 2.0), "Thought:": (1.0, 1.0), "Observation:": (2.0, 0.0)}))
dialects.add("react")(react_calls)
dialects.add("hermes")(lambda name, arguments: hermes_calls(F.array(F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": '), F.coalesce(arguments, F.lit("{}")), F.lit("}")))))
rewards.add("format")(format_reward)
rewards.add("stated")(stated_reward)
samplers.add("exactly")(sample_exactly)
samplers.add("weighted")(weighted_top)


def loss_scale_of(text: str) -> tuple[str, str]:
    """(strategy, loss scale) of 'strategy', 'scale' or 'strategy+scale'; 'default' and 'base' where one is left out."""
    head, plus, rest = text.partition("+")
    if plus:
        return head, rest
    return (head, "base") if head in STRATEGIES else ("default", head)


class Mean:
    """A metric over several tables: sums and counts are kept, one row collected per update."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.total, self.count = 0.0, 0

    def update(self, df: DataFrame, value: Column) -> None:
        """Nulls and NaN are left out."""
        x = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
        row = df.agg(F.sum(x).alias("s"), F.count(x).alias("n")).first()
        self.total, self.count = self.total + (row["s"] or 0.0), self.count + row["n"]

    def compute(self) -> float | None:
        return self.total / self.count if self.count else None


metrics.add("mean")(Mean)


def vectorised_reward(f: Callable[..., list[float]]) -> Callable[..., Column]:
    """A list function over completions as a Column function: Arrow batches, not rows."""

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(f(*[c.tolist() for c in cols]), dtype="float64")

    return lambda *cols: run(*cols)


def formatted(df: DataFrame, f: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """Rows through a user's function of a dict, None dropping the row; in batches, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [r for r in map(f, frame.to_dict("records")) if r is not None]
            yield pd.DataFrame(kept) if kept else pd.DataFrame(columns=[c.split()[0] for c in schema.split(",")])

    return df.mapInPandas(run, schema)
