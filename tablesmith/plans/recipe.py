"""Declarative recipes: an ordered list of steps, each a DataFrame transform, replayed on any table.

A step names itself with ``action`` or ``type`` and carries its settings under ``params`` or inline.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import level1_clean
from ..operators.dedupe import dedupe
from ..operators.impute import handle_missing_values
from ..operators.outlier import outlier
from ..session import materialize
from ..sources.csv import read_csv_table, write_table

_META = {"type", "params", "timestamp", "operation"}


@dataclass
class Recipe:
    name: str
    steps: list[dict[str, Any]] = field(default_factory=list)
    description: str = ""
    source: dict[str, Any] = field(default_factory=dict)
    target: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)

    def add_step(self, kind: str, /, **params: Any) -> Recipe:
        self.steps.append({"type": kind, "params": params})
        return self

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> Recipe:
        known = {k: data[k] for k in ("steps", "description", "source", "target", "metadata") if data.get(k)}
        return cls(name=data.get("name", "recipe"), **known)

    @classmethod
    def from_yaml(cls, path: str) -> Recipe:
        import yaml

        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle))


def step_parts(step: Mapping[str, Any]) -> tuple[str, dict[str, Any]]:
    """Kind and settings of a step in either layout. Next to ``type``, ``action`` is an ordinary setting."""
    naming = "type" if step.get("type") else "action"
    if not step.get(naming):
        raise ValueError(f"recipe step without action or type: {dict(step)}")
    inline = {k: v for k, v in step.items() if k not in _META and k != naming}
    return step[naming], {**inline, **(step.get("params") or {})}


def _clean(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    options = {**params, **params.get("normalize", {})}
    if "drop_empty_rows" in options:
        options.setdefault("drop_empty", options["drop_empty_rows"])
    accepted = ("trim", "date_fmt", "currency_split", "drop_empty", "preserve_time_cols", "currency_mode", "protect", "date_cols", "date_type", "untyped")
    return level1_clean(df, **{k: options[k] for k in accepted if k in options})


def _dedupe(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    keep = params.get("keep", params.get("keep_policy", "last"))
    return dedupe(df, params.get("keys"), keep, params.get("order_by", ()))


def _impute(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    return handle_missing_values(
        df, params.get("strategies", {}), params.get("drop_threshold", 0.5), params.get("order_by", ()), params.get("partition_by", ())
    )


def _outlier(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    rules = params.get("rules")
    if rules is None:
        settings = {k: v for k, v in params.items() if k not in ("columns", "action", "rules")}
        rules = [{"col": c, **settings} for c in params.get("columns") or []]
    return outlier(df, rules, params.get("action", "clip"), count_changes=False)[0]


STEPS: dict[str, Callable[[DataFrame, dict[str, Any]], DataFrame]] = {
    "clean": _clean,
    "dedupe": _dedupe,
    "impute": _impute,
    "outlier": _outlier,
}


def run_steps(df: DataFrame, steps: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Apply steps in order.

    Imputation and outlier steps measure the table several times, so what comes before them is written
    once to the shared folder and read back column by column.
    """
    stored = True
    for step in steps:
        kind, params = step_parts(step)
        if kind not in STEPS:
            raise ValueError(f"unknown recipe step {kind!r}; known: {sorted(STEPS)}")
        if kind in ("impute", "outlier") and not stored:
            df, stored = materialize(df, "recipe"), True
        df = df.transform(STEPS[kind], params)
        stored = stored and kind in ("impute", "outlier")
    return df


def run_recipe(
    spark: SparkSession, recipe: Recipe, source: str | DataFrame | None = None, target: str | None = None
) -> DataFrame:
    """Run a recipe on its own source or the one given, and write its target if there is one."""
    source = source if source is not None else recipe.source.get("path")
    df = source if isinstance(source, DataFrame) else read_csv_table(spark, source, recipe.source.get("encoding"))
    out = run_steps(df, recipe.steps)
    target = target or recipe.target.get("path")
    if target:
        write_table(out, target)
    return out


def cleaning_recipe(
    name: str,
    currency_split: bool = True,
    date_fmt: str = "YYYY-MM-DD",
    drop_empty: bool = True,
    dedupe_keys: Sequence[str] | None = None,
    keep: str = "first",
    order_by: Sequence[str] = (),
) -> Recipe:
    recipe = Recipe(name).add_step("clean", currency_split=currency_split, date_fmt=date_fmt, drop_empty=drop_empty)
    if dedupe_keys:
        recipe.add_step("dedupe", keys=list(dedupe_keys), keep=keep, order_by=list(order_by))
    return recipe


def imputation_recipe(name: str, strategies: Mapping[str, Any], order_by: Sequence[str] = ()) -> Recipe:
    return Recipe(name).add_step("impute", strategies=dict(strategies), order_by=list(order_by))


def outlier_recipe(name: str, columns: Sequence[str], method: str = "iqr", action: str = "clip") -> Recipe:
    return Recipe(name).add_step("outlier", columns=list(columns), method=method, action=action)
