"""Rule checks over a table and a gate that blocks a write when too few of them hold."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import col, resolve_one
from ..functions.quantiles import as_double
from ..functions.report import count_where, rows_from_aggregates
from ..session import materialize
from .clean import present
from .profile import keys_per_place, value_key


def load_spec(path: str) -> dict[str, Any]:
    """Read a specification from a YAML file (a small driver-side configuration file)."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def _as_list(value: Any) -> list:
    return [value] if isinstance(value, str) else list(value)


#: Place of a check in the specification; the report is in this order.
_PLACE = "__place"
_REPORT = "check string, col string, ok boolean, missing long, fails long, min double, max double, error string"
#: Repeated values that are sent to every task; more are joined through a shuffle, whose hot keys AQE splits.
ROWS_SENT = 100_000


@dataclass
class Rule:
    """One check of a specification. ``broken`` is true on the rows that fail it; ``unique`` needs other rows and has none."""

    place: int
    check: str
    wanted: str
    name: str | None
    broken: Column | None = None
    low: float | None = None
    high: float | None = None

    @property
    def label(self) -> str:
        return f"{self.check}:{self.wanted}"


def read_rules(df: DataFrame, spec: Mapping[str, Any]) -> list[Rule]:
    """The checks of a specification in their order, with the columns of ``df`` that they mean."""
    rules: list[Rule] = []

    def add(check: str, wanted: str, broken: Callable[[str], Column] | None = None, **bounds: Any) -> None:
        name = resolve_one(df.columns, wanted)
        rules.append(Rule(len(rules), check, wanted, name, broken(name) if broken and name is not None else None, **bounds))

    for check in spec.get("checks") or []:
        for wanted in _as_list(check.get("unique", [])):
            add("unique", wanted)
        for wanted in _as_list(check.get("required", [])):
            add("required", wanted, lambda name: ~present(df, name))
        if "regex" in check:
            pattern = check["regex"]["pattern"]
            add("regex", check["regex"]["column"], lambda name: ~F.coalesce(col(name).cast("string"), F.lit("")).rlike(rf"\A(?:{pattern})"))
        if "range" in check:
            low, high = check["range"].get("min"), check["range"].get("max")
            add("range", check["range"]["column"], lambda name: _outside(as_double(df, name), low, high), low=low, high=high)
    return rules


def _outside(value: Column, low: float | None, high: float | None) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (value < F.lit(float(low)))
    if high is not None:
        bad = bad | (value > F.lit(float(high)))
    return F.coalesce(bad, F.lit(False))


def _entry(place: Column, check: str, wanted: Column, ok: Column, **figures: Any) -> dict[str, Column]:
    row = {_PLACE: place.cast("int"), "check": F.lit(check), "col": wanted, "ok": ok}
    for key, kind in (("missing", "long"), ("fails", "long"), ("min", "double"), ("max", "double"), ("error", "string")):
        value = figures.get(key)
        row[key] = value.cast(kind) if isinstance(value, Column) else F.lit(value).cast(kind)
    return row


def validate(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Report with one row per check, in the order of the specification.

    ``unique`` allows one missing value; ``required`` allows none; ``regex`` must match from the start of
    the text (missing counts as empty text; Java dialect); ``range`` skips values that are not numbers, and
    an omitted bound is open.
    """
    rules = read_rules(df, spec)
    if not rules:
        return df.sparkSession.createDataFrame([], _REPORT)
    aggregates: dict[str, Column] = {"rows": F.count(F.lit(1))}
    rows: list[dict[str, Column]] = []
    for rule in rules:
        place, wanted = F.lit(rule.place), F.lit(rule.wanted)
        if rule.name is None:
            error = "col_not_found" if rule.check in ("regex", "range") else None
            rows.append(_entry(place, rule.check, wanted, F.lit(False), error=error))
        elif rule.broken is not None:
            aggregates[f"a{rule.place}"] = count_where(rule.broken)
            fails = F.col(f"a{rule.place}")
            figure = "missing" if rule.check == "required" else "fails"
            rows.append(_entry(place, rule.check, wanted, fails == 0, min=rule.low, max=rule.high, **{figure: fails}))
    unique = [r for r in rules if r.check == "unique" and r.name is not None]
    report = rows_from_aggregates(df, aggregates, rows) if rows else None
    if unique:
        checked = _check_unique(df, unique)
        report = report.unionByName(checked) if rows else checked
    # As many rows as the specification has checks; neither a union nor a join keeps an order by itself.
    return report.orderBy(_PLACE).drop(_PLACE)


def _check_unique(df: DataFrame, unique: list[Rule]) -> DataFrame:
    """Report rows of the ``unique`` checks: equal values are counted before the shuffle, all columns at once."""
    names = list(dict.fromkeys(r.name for r in unique))
    places = [f"c{i}" for i in range(len(names))]
    counted = keys_per_place(df.select(*[col(n) for n in names]), places).groupBy("place").agg(
        F.sum("n").alias("rows"), F.count("key").alias("distinct"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("missing")
    )
    wanted = df.sparkSession.createDataFrame([(r.place, places[names.index(r.name)], r.wanted) for r in unique], f"{_PLACE} int, place string, wanted string")
    ok = F.coalesce((F.col("distinct") + F.col("missing") == F.col("rows")) & (F.col("missing") <= 1), F.lit(True))
    entry = _entry(F.col(_PLACE), "unique", F.col("wanted"), ok)
    return wanted.join(counted, "place", "left").select(*[value.alias(name) for name, value in entry.items()])


def validate_rows(df: DataFrame, spec: Mapping[str, Any], name: str = "violations") -> DataFrame:
    """``df`` with an array of the rules each row breaks, ``check:column`` in the order of the specification.

    A row breaks ``unique`` if another row has its value; missing values are equal to each other there. A rule on a
    column that does not exist is broken by every row. The other rules mean what they mean to :func:`validate`, so a
    check fails exactly if some row breaks it (but for a table without rows).

    Only values that occur twice or more come back to the rows, from a table that is stored once: no window gathers the
    rows of a value, and a value of many rows is one row there.
    """
    rules = read_rules(df, spec)
    names = list(dict.fromkeys(r.name for r in rules if r.check == "unique" and r.name is not None))
    marked, repeats = df, {}
    if names:
        places = [f"c{i}" for i in range(len(names))]
        selected = df.select(*[col(n) for n in names])
        repeated = keys_per_place(selected, places).where("n > 1").select("place", _never_null(F.col("key")).alias("__key"))
        repeated = materialize(repeated, "repeated")
        few = repeated.limit(ROWS_SENT + 1).count() <= ROWS_SENT
        for place, column in zip(places, names):
            values = repeated.where(F.col("place") == place).select(F.col("__key").alias(f"__key_{place}"), F.lit(True).alias(f"__twice_{place}"))
            own = _never_null(value_key(selected, column))
            marked = marked.join(F.broadcast(values) if few else values, own == F.col(f"__key_{place}"), "left").drop(f"__key_{place}")
            repeats[column] = F.col(f"__twice_{place}").isNotNull()
    broken = [F.lit(True) if r.name is None else repeats[r.name] if r.check == "unique" else r.broken for r in rules]
    listed = F.array_compact(F.array(*[F.when(b, F.lit(r.label)) for b, r in zip(broken, rules)])) if rules else F.array().cast("array<string>")
    return marked.select(*[col(c) for c in df.columns], listed.alias(name))


def _never_null(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), key), F.lit(""))


def summarize(report: DataFrame) -> DataFrame:
    """One row: number of checks, passed checks, overall verdict and pass ratio (0 without checks)."""
    return report.agg(
        F.count(F.lit(1)).alias("checks"),
        count_where(F.col("ok")).alias("passed"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"),
    ).withColumn("pass_ratio", F.coalesce(F.try_divide(F.col("passed"), F.col("checks")), F.lit(0.0)))


def gate(df: DataFrame, spec: Mapping[str, Any], threshold: float = 1.0) -> DataFrame:
    """Summary with the decision whether a write may go ahead."""
    return summarize(validate(df, spec)).withColumn("allowed", F.col("pass_ratio") >= F.lit(float(threshold)))


def gated_write(df: DataFrame, spec: Mapping[str, Any], write, threshold: float = 1.0, blocked=None) -> bool:
    """Call ``write(df)`` if the gate opens, else ``blocked(df)`` when given; return the decision.

    The table is computed once, into the shared folder, and both the check and the write read that.
    """
    df = materialize(df, "gated")
    allowed = gate(df, spec, threshold).first()["allowed"]
    if allowed:
        write(df)
    elif blocked is not None:
        blocked(df)
    return allowed
