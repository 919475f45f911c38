"""Declarative steps of the bronze (clean), silver (join, aggregate) and gold (encode, scale) layers, compiled to lazy
DataFrames. Fitted values are kept beside the steps, so the same plan scores new rows without fitting again."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, joins, transforms, windows

LAYERS = ("bronze", "silver", "gold")


@dataclass
class Step:
    layer: str
    action: str
    params: dict = field(default_factory=dict)
    fitted: dict | None = None

    def __post_init__(self):
        if self.layer not in LAYERS:
            raise ValueError(f"layer {self.layer} is none of {LAYERS}")
        if self.action not in ACTIONS:
            raise ValueError(f"action {self.action} is none of {sorted(ACTIONS)}")


Apply = Callable[[DataFrame, Step, dict[str, DataFrame]], DataFrame]
ACTIONS: dict[str, Apply] = {}


def action(name: str) -> Callable[[Apply], Apply]:
    def deco(f: Apply) -> Apply:
        ACTIONS[name] = f
        return f

    return deco


@action("cast")
def _cast(df, step, sources):
    """Values that don't convert become null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as {t})") for c, t in step.params["types"].items()})


@action("drop")
def _drop(df, step, sources):
    return df.drop(*step.params["columns"])


@action("filter")
def _filter(df, step, sources):
    return df.where(step.params["condition"])


@action("consistent")
def _consistent(df, step, sources):
    return df.withColumns({c: transforms.consistent(F.col(c), step.params.get("case", "lower")) for c in step.params["columns"]})


@action("impute")
def _impute(df, step, sources):
    if step.fitted is None:
        step.fitted = cleaning.fit_fill(df, step.params["strategies"], step.params.get("constants"))
    return cleaning.fill(df, step.fitted, step.params.get("indicator", False))


@action("outliers")
def _outliers(df, step, sources):
    if step.fitted is None:
        step.fitted = {c: list(b) for c, b in cleaning.outlier_bounds(df, step.params["columns"], step.params.get("method", "iqr")).items()}
    return cleaning.treat_outliers(df, {c: tuple(b) for c, b in step.fitted.items()}, step.params.get("treatment", "cap"))


@action("deduplicate")
def _deduplicate(df, step, sources):
    keep = {"first": cleaning.keep_first, "last": cleaning.keep_last}[step.params.get("keep", "last")]
    return keep(df, step.params["keys"], step.params["order"])


@action("join")
def _join(df, step, sources):
    return joins.merge_sources(df, [(sources[step.params["source"]], step.params["on"], step.params.get("how", "left"))])


@action("aggregate")
def _aggregate(df, step, sources):
    p = step.params
    plan = windows.WindowPlan(p["windows"], p["values"])
    return windows.aggregate(df, p["entity"], p["time"], plan, p.get("reference"))


@action("date_parts")
def _date_parts(df, step, sources):
    parts = {f"{c}_{n}": x for c in step.params["columns"] for n, x in transforms.date_parts(F.col(c)).items() if n in step.params.get("parts", (n,))}
    return df.withColumns(parts)


@action("interact")
def _interact(df, step, sources):
    return transforms.interactions(df, [tuple(s) for s in step.params["specs"]])


@action("power")
def _power(df, step, sources):
    return transforms.power(df, step.params["column"], step.params["method"])


@action("encode")
def _encode(df, step, sources):
    p = step.params
    if step.fitted is None:
        step.fitted = asdict(transforms.fit_encoder(df, p["column"], p["kind"], p.get("target"), p.get("order", ())))
    return transforms.Encoder(**step.fitted).transform(df)


@action("scale")
def _scale(df, step, sources):
    if step.fitted is None:
        step.fitted = asdict(transforms.fit_scaler(df, step.params["columns"], step.params.get("method", "standard")))
    return transforms.Scaler(**step.fitted).transform(df)


@dataclass
class Plan:
    steps: list[Step]

    def __post_init__(self):
        order = [LAYERS.index(s.layer) for s in self.steps]
        if order != sorted(order):
            raise ValueError("steps are not in the order bronze, silver, gold")

    def run(self, df: DataFrame, sources: dict[str, DataFrame] | None = None, upto: str = "gold") -> DataFrame:
        """The first run fits what is to be fitted; later ones use that."""
        for s in self.steps:
            if LAYERS.index(s.layer) <= LAYERS.index(upto):
                df = ACTIONS[s.action](df, s, sources or {})
        return df

    def to_json(self) -> str:
        return json.dumps([asdict(s) for s in self.steps], indent=1)

    @staticmethod
    def from_json(text: str) -> Plan:
        return Plan([Step(**s) for s in json.loads(text)])
