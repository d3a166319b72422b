"""A small language for features over o h l c v, compiled to window expressions.

Arithmetic (+ - * /), unary signs, numbers, and shift rolling_mean rolling_std rolling_min rolling_max ewm
zscore rank log abs sign clip. Window lengths are whole numbers from 1. Anything else is refused, before
any data is read.
"""

from __future__ import annotations

import ast
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.folds import running, smoothed
from tidebar.functions.rolling import back, full, last, zscore

#: Names of the columns, and how many arguments each function takes.
COLUMNS = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
WINDOWED = {"shift", "rolling_mean", "rolling_std", "rolling_min", "rolling_max", "ewm", "zscore", "rank"}
PLAIN = {"log": 1, "abs": 1, "sign": 1, "clip": 3}


class Refused(ValueError):
    """The text is not in the language."""


def parsed(text: str) -> ast.expr:
    try:
        tree = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise Refused(str(e)) from e
    _check(tree)
    return tree


def _number(node: ast.expr) -> bool:
    return isinstance(node, ast.Constant) and type(node.value) in (int, float)


def _value(node: ast.expr) -> float | None:
    if _number(node):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and _number(node.operand):
        return -node.operand.value
    return None


def _check(node: ast.expr) -> None:
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
        _check(node.left)
        _check(node.right)
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        _check(node.operand)
    elif isinstance(node, ast.Name) and node.id in COLUMNS or _number(node):
        return
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        name, args = node.func.id, node.args
        if name in WINDOWED:
            if len(args) != 2 or not _number(args[1]) or type(args[1].value) is not int or args[1].value < 1:
                raise Refused(f"{name} takes an expression and a whole number from 1")
            _check(args[0])
        elif name in PLAIN and len(args) == PLAIN[name]:
            if name == "clip" and (_value(args[1]) is None or _value(args[2]) is None):
                raise Refused("clip takes two numbers")
            _check(args[0])
        else:
            raise Refused(f"no such function: {name} with {len(args)} arguments")
    else:
        raise Refused(f"not allowed: {ast.dump(node)[:80]}")


class _Compiler:
    """Every window's argument becomes a column of its own first, as windows do not nest."""

    def __init__(self, bars: DataFrame):
        self.df, self.names = bars, (f"_e{i}" for i in itertools.count())

    def kept(self, value: Column) -> str:
        name = next(self.names)
        self.df = self.df.withColumn(name, value)
        return name

    def of(self, node: ast.expr) -> Column:
        if isinstance(node, ast.BinOp):
            a, b = self.of(node.left), self.of(node.right)
            if isinstance(node.op, ast.Div):
                return a / F.when(b != 0, b)
            return a + b if isinstance(node.op, ast.Add) else a - b if isinstance(node.op, ast.Sub) else a * b
        if isinstance(node, ast.UnaryOp):
            return -self.of(node.operand) if isinstance(node.op, ast.USub) else self.of(node.operand)
        if isinstance(node, ast.Name):
            return F.col(COLUMNS[node.id])
        if isinstance(node, ast.Constant):
            return F.lit(float(node.value))
        name, args = node.func.id, node.args
        x = self.of(args[0])
        if name == "log":
            return F.when(x > 0, F.ln(x))
        if name == "abs":
            return F.abs(x)
        if name == "sign":
            return F.signum(x)
        if name == "clip":
            return F.when(x.isNotNull(), F.greatest(F.lit(float(_value(args[1]))), F.least(F.lit(float(_value(args[2]))), x)))
        column, n = self.kept(x), args[1].value
        if name == "ewm":
            return F.col(self._ewm(column, n))
        out = {
            "shift": lambda: back(column, n), "rolling_mean": lambda: full(F.avg, column, n), "rolling_std": lambda: full(F.stddev_pop, column, n),
            "rolling_min": lambda: full(F.min, column, n), "rolling_max": lambda: full(F.max, column, n), "zscore": lambda: zscore(column, n, None),
            "rank": lambda: F.when(F.count(column).over(last(n)) == n, F.size(F.filter(F.collect_list(column).over(last(n)), lambda e: e <= F.col(column))) / F.lit(n)),
        }[name]()
        return F.col(self.kept(out))

    def _ewm(self, column: str, span: int) -> str:
        """Null until `span` values are there; nulls between add nothing."""
        name, alpha = next(self.names), 2 / (span + 1)

        def step(state: Column, row: Column) -> Column:
            return F.struct(smoothed(state["y"], row[column], alpha).alias("y"), (state["n"] + row[column].isNotNull().cast("int")).alias("n"))

        x = running(self.df, ["ticker"], ["idx"], {"y": None, "n": 0}, "`y`: double, `n`: int", step, name)
        self.df = x.withColumn(name, F.when(F.col(f"{name}.n") >= span, F.col(f"{name}.y")))
        return name


def feature(bars: DataFrame, text: str, name: str) -> DataFrame:
    """ticker, idx and the feature."""
    c = _Compiler(bars)
    value = c.of(parsed(text))
    return c.df.select("ticker", "idx", F.when(~F.isnan(value), value).alias(name))


def proposal_problems(bars: DataFrame, text: str, name: str, warm_up: int = 252, least_finite: float = 0.99) -> list[str]:
    """Why a proposed feature is refused; empty if it is not."""
    if not name.isidentifier():
        return ["not an identifier"]
    try:
        x = feature(bars, text, name)
    except Refused as e:
        return [str(e)]
    r = x.where(F.col("idx") >= warm_up).agg(F.count(F.lit(1)).alias("n"), F.count(name).alias("k"), F.stddev_pop(name).alias("sd")).first()
    out = []
    if not r.n or r.k / r.n < least_finite:
        out.append("too few finite values")
    if r.sd is None or r.sd < 1e-12:
        out.append("constant")
    return out
