"""A closed rule language, compiled to Catalyst columns with three-valued logic.

A rule set is a dict with ``parameters`` (name to number), ``features`` (name to {kind, period, source}) and ``conditions`` (name to
expression). Expressions: {"all": [...]}, {"any": [...]}, {"not": x}, or {"op": gt|gte|lt|lte|eq|neq|crosses_above|crosses_below,
"left": operand, "right": operand}. Operands: {"bar": open|high|low|close}, {"quote": bid|ask}, {"feature": name}, {"param": name},
{"value": number}. UNKNOWN is null: a false part decides ``all``, a true part ``any``. An absent condition is false.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.bars import by_instrument, segments
from quotemill.operators.indicators import full, recurrence

MAX_DEPTH, MAX_NODES, MAX_FEATURES, MAX_PARAMETERS, MAX_PERIOD = 32, 512, 128, 128, 10_000
COMPARISONS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b}
KINDS = ("sma", "ema", "rsi", "atr", "rolling_high", "rolling_low")
PRICES = ("open", "high", "low", "close")


class RuleError(ValueError):
    """A rule set that is not well formed; the message starts with the JSON pointer of the fault."""


def identity(rules: dict) -> str:
    """SHA-256 of the canonical JSON of a rule set."""
    return hashlib.sha256(json.dumps(rules, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def validate(rules: dict) -> list[str]:
    """Check a rule set and return its features in an order that has sources first."""
    extra = set(rules) - {"parameters", "features", "conditions"}
    if extra:
        raise RuleError(f"/{sorted(extra)[0]}: unknown field")
    parameters, features, conditions = (rules.get(k, {}) for k in ("parameters", "features", "conditions"))
    if len(features) > MAX_FEATURES or len(parameters) > MAX_PARAMETERS:
        raise RuleError("/: too many features or parameters")
    for name, value in parameters.items():
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise RuleError(f"/parameters/{name}: not a number")
    order: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str, at: str) -> None:
        if name not in features:
            raise RuleError(f"{at}: unknown feature {name}")
        if state.get(name) == 1:
            raise RuleError(f"/features/{name}: depends on itself")
        if state.get(name) == 2:
            return
        state[name] = 1
        f = features[name]
        if set(f) - {"kind", "period", "source"} or f.get("kind") not in KINDS:
            raise RuleError(f"/features/{name}: unknown kind or field")
        if isinstance(f.get("period"), bool) or not isinstance(f.get("period"), int) or not 1 <= f["period"] <= MAX_PERIOD:
            raise RuleError(f"/features/{name}/period: not between 1 and {MAX_PERIOD}")
        source = f.get("source", "close")
        if source not in PRICES:
            visit(source, f"/features/{name}/source")
        state[name] = 2
        order.append(name)

    for name in features:
        visit(name, f"/features/{name}")
    nodes = 0

    def walk(x: dict, at: str, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            raise RuleError(f"{at}: too deep or too many nodes")
        if set(x) == {"not"}:
            return walk(x["not"], f"{at}/not", depth + 1)
        for k in ("all", "any"):
            if set(x) == {k}:
                if not x[k]:
                    raise RuleError(f"{at}/{k}: empty")
                for i, y in enumerate(x[k]):
                    walk(y, f"{at}/{k}/{i}", depth + 1)
                return None
        if set(x) != {"op", "left", "right"} or x["op"] not in {*COMPARISONS, "crosses_above", "crosses_below"}:
            raise RuleError(f"{at}: unknown expression")
        for side in ("left", "right"):
            ((kind, value),) = x[side].items() if len(x[side]) == 1 else (("", None),)
            known = {"bar": PRICES, "quote": ("bid", "ask"), "feature": features, "param": parameters}
            if kind == "value":
                if isinstance(value, bool) or not isinstance(value, (int, float)):
                    raise RuleError(f"{at}/{side}/value: not a number")
            elif kind not in known or value not in known[kind]:
                raise RuleError(f"{at}/{side}: unknown operand")
        return None

    for name, x in conditions.items():
        walk(x, f"/conditions/{name}", 1)
    return order


def _within() -> Window:
    return Window.partitionBy("instrument", "segment").orderBy("start_us")


def with_features(bars: DataFrame, rules: dict) -> DataFrame:
    """Bars with a column f_<name> per feature. A gap, or a bar that was late, starts every feature anew."""
    order = validate(rules)
    d = segments(bars)
    late = (F.col("available_us") != F.col("end_us")).cast("int")
    broken = F.sum(late + F.coalesce(F.lag(late).over(by_instrument()), F.lit(0))).over(by_instrument())
    d = d.withColumn("usable", late == 0).withColumn("segment", F.concat_ws("/", "segment", broken))
    keys = ("instrument", "segment")
    for name in order:
        f = rules["features"][name]
        n, out = f["period"], f"f_{name}"
        x = F.when(F.col("usable"), F.col(f.get("source", "close") if f.get("source", "close") in PRICES else f"f_{f['source']}"))
        w = _within().rowsBetween(-(n - 1), 0)
        before = F.lag("close").over(_within())
        if f["kind"] in ("sma", "rolling_high", "rolling_low"):
            what = {"sma": F.avg, "rolling_high": F.max, "rolling_low": F.min}[f["kind"]]
            source = {"rolling_high": F.col("high"), "rolling_low": F.col("low")}.get(f["kind"], x) if "source" not in f else x
            d = d.withColumn("_x", F.when(F.col("usable"), source)).withColumn(out, full(what("_x").over(w), "_x", n, w)).drop("_x")
        elif f["kind"] == "ema":
            d = recurrence(d.withColumn("_x", x), "_x", out, 2 / (n + 1), n, keys=keys).drop("_x")
        elif f["kind"] == "atr":
            tr = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
            d = recurrence(d.withColumn("_x", tr), "_x", out, 1 / n, n, keys=keys).drop("_x")
        else:
            change = x - F.lag(x).over(_within())
            d = d.withColumn("_c", change).withColumn("_g", F.when(F.col("_c").isNotNull(), F.greatest("_c", F.lit(0.0)))).withColumn("_l", F.when(F.col("_c").isNotNull(), F.greatest(-F.col("_c"), F.lit(0.0))))
            d = recurrence(recurrence(d, "_g", "_mg", 1 / n, n, keys=keys), "_l", "_ml", 1 / n, n, keys=keys)
            value = F.when((F.col("_mg") == 0) & (F.col("_ml") == 0), 50.0).when(F.col("_ml") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("_mg"), F.col("_ml"))))
            d = d.withColumn(out, value).drop("_c", "_g", "_l", "_mg", "_ml")
    return d


def compile_condition(rules: dict, name: str) -> Column:
    """The column of a condition, over the output of with_features."""
    validate(rules)
    contiguous = F.lag("segment").over(by_instrument()) == F.col("segment")

    def operand(x: dict) -> Column:
        ((kind, value),) = x.items()
        if kind == "bar":
            return F.col(value)
        if kind == "quote":
            return F.col(f"{value}_close")
        if kind == "feature":
            return F.col(f"f_{value}")
        return F.lit(float(rules["parameters"][value] if kind == "param" else value))

    def expression(x: dict) -> Column:
        if "not" in x:
            return ~expression(x["not"])
        for k in ("all", "any"):
            if k in x:
                out = expression(x[k][0])
                for y in x[k][1:]:
                    out = out & expression(y) if k == "all" else out | expression(y)
                return out
        a, b = operand(x["left"]), operand(x["right"])
        if x["op"] in COMPARISONS:
            return COMPARISONS[x["op"]](a, b)
        a0, b0 = F.lag(a).over(by_instrument()), F.lag(b).over(by_instrument())
        crossed = (a0 <= b0) & (a > b) if x["op"] == "crosses_above" else (a0 >= b0) & (a < b)
        return F.when(contiguous, crossed)

    conditions = rules.get("conditions", {})
    return expression(conditions[name]) if name in conditions else F.lit(False)


def signals(bars: DataFrame, rules: dict) -> DataFrame:
    """Per bar the three-valued conditions ``long`` and ``short`` and what they say together."""
    d = with_features(bars, rules).withColumn("long", compile_condition(rules, "long")).withColumn("short", compile_condition(rules, "short"))
    ready = F.lit(True)
    for name in rules.get("features", {}):
        ready = ready & F.col(f"f_{name}").isNotNull()
    said = F.when(~F.col("usable"), "unusable_bar").when(~ready, "warming_up").when(F.col("long") & F.col("short"), "conflict").when(F.col("long"), "long").when(F.col("short"), "short").otherwise("none")
    return d.withColumn("signal", said)
