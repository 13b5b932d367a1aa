"""The expression language: JSON documents of signals become stages of Spark columns.

An expression is a tree of {"op": ...} nodes. Documents are checked and named on the driver (they are small), then planned:
every distinct kernel node with its numbers filled in is one column, made once. Kernels with a fixed window are native
window columns, one projection a stage; kernels that depend on their own past share one grouped map a stage. Everything
between is inlined, and Catalyst prunes, folds and pushes down as in any query.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import nulls
from tidemark.operators import recursive
from tidemark.operators import windows as w

# Names and limits of the language.
PRICES = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}
STREAMS = ("funding", "fundroc", "fundzscore", "fundaccel", "fundmom", "basis", "oi", "lsr", "mvrv", "activeaddr", "txcnt", "nvt", "exnetflow", "stablesupply")
CLOCK = ("hourutc", "dowutc")
FIXED_WINDOW = {"sma": w.sma, "wma": w.wma, "stdev": w.stdev, "highest": w.highest, "lowest": w.lowest, "lag": w.lag, "roc": w.roc, "zscore": w.zscore, "slope": w.slope, "pctrank": w.pctrank, "median": w.median, "effratio": w.effratio}
OF_BARS = ("atr", "adx", "choppiness", "rangepos")
OWN_PAST = ("ema", "rsi", "atr", "adx")
ARITHMETIC = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": nulls.safe_div, "min2": nulls.min2, "max2": nulls.max2}
UNARY = {"abs": F.abs, "neg": lambda a: -a, "log": nulls.log, "sign": F.signum, "sqrt": nulls.sqrt}
COMPARE = {"gt": nulls.gt, "lt": nulls.lt}
CROSS = {"crossover": lambda a, b, pa, pb: (pa <= pb) & (a > b), "crossunder": lambda a, b, pa, pb: (pa >= pb) & (a < b)}
LOGIC = {"and": lambda a, b: a & b, "or": lambda a, b: a | b}
COMMUTE = {"add", "mul", "min2", "max2", "and", "or"}
KERNELS = (*FIXED_WINDOW, *(k for k in OWN_PAST if k not in OF_BARS), *OF_BARS)
MOST_NODES, MOST_DEPTH, MOST_PARAMS, MOST_PERIOD = 48, 10, 6, 500
CHILDREN = ("src", "period", "a", "b")
SIGNALS = ("longEntry", "longExit", "shortEntry", "shortExit")


class ExpressionError(ValueError):
    pass


def children(node: dict) -> Iterator[dict]:
    return (node[k] for k in CHILDREN if node.get(k))


def walk(node: dict) -> Iterator[dict]:
    yield node
    for c in children(node):
        yield from walk(c)


def kind(node: dict, params: dict, depth: int = 0) -> str:
    """num or bool; raises ExpressionError for whatever isn't well formed."""
    if depth > MOST_DEPTH:
        raise ExpressionError("deeper than the limit")
    if not isinstance(node, dict) or not isinstance(node.get("op"), str):
        raise ExpressionError("not a node")
    op = node["op"]

    def need(what: str, *keys: str) -> None:
        for k in keys:
            if kind(node.get(k), params, depth + 1) != what:
                raise ExpressionError(f"{op} needs {what} as {k}")

    if op == "price":
        if node.get("field") not in PRICES:
            raise ExpressionError(f"no price {node.get('field')}")
    elif op == "const":
        if isinstance(node.get("value"), bool) or not isinstance(node.get("value"), int | float) or abs(node["value"]) == float("inf") or node["value"] != node["value"]:
            raise ExpressionError("not a finite constant")
    elif op == "param":
        if node.get("name") not in params:
            raise ExpressionError(f"no parameter {node.get('name')}")
    elif op in KERNELS:
        need("num", "src")
        if not isinstance(node.get("period"), dict) or node["period"].get("op") not in ("const", "param"):
            raise ExpressionError(f"{op} needs a constant or parameter as period")
        need("num", "period")
    elif op in ARITHMETIC:
        need("num", "a", "b")
    elif op in UNARY:
        need("num", "a")
    elif op in COMPARE or op in CROSS:
        need("num", "a", "b")
        return "bool"
    elif op in LOGIC or op == "not":
        need("bool", *(("a", "b") if op in LOGIC else ("a",)))
        return "bool"
    elif op not in STREAMS and op not in CLOCK:
        raise ExpressionError(f"no operator {op}")
    return "num"


def problems(doc: dict) -> list[str]:
    """What is wrong with a strategy document; empty if nothing."""
    out, params, risk = [], doc.get("params") or {}, doc.get("risk") or {}
    if len(params) > MOST_PARAMS:
        out.append("too many parameters")
    for name, p in params.items():
        if not p["min"] <= p["default"] <= p["max"]:
            out.append(f"parameter {name}: default out of bounds")
        if p["max"] > 10 * MOST_PERIOD:
            out.append(f"parameter {name}: bound too large")
    for name in SIGNALS:
        if node := doc.get(name):
            try:
                if kind(node, params) != "bool":
                    out.append(f"{name} is not a condition")
                if (n := sum(1 for _ in walk(node))) > MOST_NODES:
                    out.append(f"{name}: {n} nodes")
            except ExpressionError as e:
                out.append(f"{name}: {e}")
    if not doc.get("longEntry") or not doc.get("longExit"):
        out.append("longEntry and longExit are needed")
    if bool(doc.get("shortEntry")) != bool(doc.get("shortExit")):
        out.append("shortEntry and shortExit belong together")
    if not 0 < risk.get("volTargetAnnual", 0) <= 1:
        out.append("volTargetAnnual is not in (0, 1]")
    if not 0 < risk.get("maxLeverage", 0) <= 5:
        out.append("maxLeverage is not in (0, 5]")
    if doc.get("tf") not in (None, "1h", "4h", "1d"):
        out.append("tf is not 1h, 4h or 1d")
    if len(doc.get("hypothesis") or "") < 10:
        out.append("no hypothesis")
    return out


def _short(x: float) -> str:
    """A number to three significant digits, as JSON writes numbers."""
    y = float(f"{x:.3g}")
    return str(int(y)) if y == int(y) and abs(y) < 1e21 else repr(y)


def _plain(x) -> str:
    return "-" if x is None else str(int(x)) if float(x) == int(x) else repr(float(x))


def canonical(node: dict, order: dict[str, int] | None) -> str:
    """One text for equal expressions: arguments that commute in order, parameters by first use, numbers to three digits.

    order: collects the parameters' numbers; None leaves numbers and parameters out, for families.
    """
    op = node["op"]
    if op == "price":
        return f"price:{node['field']}"
    if op == "const":
        return "#" if order is None else f"c:{_short(node['value'])}"
    if op == "param":
        return "P" if order is None else f"p{order.setdefault(node['name'], len(order))}"
    if op in STREAMS or op in CLOCK:
        return op
    parts = [canonical(c, order) for c in children(node)]
    return f"{op}({','.join(sorted(parts) if op in COMMUTE and len(parts) == 2 else parts)})"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def exact_text(doc: dict) -> str:
    order: dict[str, int] = {}
    parts = [canonical(doc[s], order) if doc.get(s) else "-" for s in SIGNALS]
    bounds = sorted(f"p{order[k]}[{_plain(p['min'])},{_plain(p['max'])}]" for k, p in (doc.get("params") or {}).items() if k in order)
    r = doc["risk"]
    risk = "/".join(_plain(r.get(k)) for k in ("stopAtrMult", "trailAtrMult", "trailActivate", "trailOffset", "volTargetAnnual", "maxLeverage"))
    return "|".join([*parts, ";".join(bounds), f"risk:{risk}", f"tf:{doc.get('tf') or '1h'}"])


def exact_hash(doc: dict) -> str:
    return _digest(exact_text(doc))


def family_text(doc: dict) -> str:
    return "|".join(canonical(doc[s], None) if doc.get(s) else "-" for s in SIGNALS)


def family_hash(doc: dict) -> str:
    return _digest(family_text(doc))


def defaults(doc: dict) -> dict[str, float]:
    return {k: p["default"] for k, p in (doc.get("params") or {}).items()}


def scalar(node: dict, params: dict[str, float]) -> float:
    return float(node["value"] if node["op"] == "const" else params[node["name"]])


def lookback(node: dict, params: dict[str, float]) -> int:
    """The most rows before the current one that an expression looks at, nested windows added up."""
    own = w.period(scalar(node["period"], params)) if node["op"] in KERNELS else 1 if node["op"] in CROSS else 0
    return own + max((lookback(c, params) for c in children(node)), default=0)


@dataclass
class Plan:
    """Kernel columns by stage, and the way to make each."""

    params: dict[str, float]
    names: dict[str, str] = field(default_factory=dict)
    native: list[dict[str, Column]] = field(default_factory=list)
    grouped: list[dict[str, tuple]] = field(default_factory=list)

    def _stage(self, n: int) -> None:
        while len(self.native) < n:
            self.native.append({})
            self.grouped.append({})

    def _made(self, key: str, stage: int, column: Column | None, call: tuple | None) -> tuple[Column, int]:
        self._stage(stage)
        name = self.names.setdefault(key, f"k{len(self.names)}")
        if column is not None:
            self.native[stage - 1].setdefault(name, column)
        else:
            self.grouped[stage - 1].setdefault(name, call)
        return F.col(name), stage

    def key(self, node: dict) -> str:
        own = {k: v for k, v in node.items() if k not in CHILDREN}
        if node["op"] == "param":
            own = {"op": "const", "value": float(self.params[node["name"]])}
        elif node["op"] == "const":
            own = {"op": "const", "value": float(node["value"])}
        elif node["op"] in OF_BARS:
            return json.dumps([own, self.key(node["period"])])
        return json.dumps([own, *[self.key(c) for c in children(node)]], sort_keys=True)

    def column(self, node: dict) -> tuple[Column, int]:
        """The node's column over the columns of stages up to the number given with it."""
        op = node["op"]
        if op == "price":
            return F.col(PRICES[node["field"]]), 0
        if op in ("const", "param"):
            return F.lit(scalar(node, self.params)), 0
        if op == "hourutc":
            return F.hour("ts").cast("double"), 0
        if op == "dowutc":
            return (F.dayofweek("ts") - 1).cast("double"), 0
        if op in STREAMS:
            return F.coalesce(F.col(op), F.lit(0.0)), 0
        if op in KERNELS:
            return self._kernel(node)
        own = [self.column(c) for c in children(node)]
        stage, args = max(s for _, s in own), [c for c, _ in own]
        if op in ARITHMETIC:
            return ARITHMETIC[op](*args), stage
        if op in UNARY:
            return UNARY[op](*args), stage
        if op in COMPARE:
            return COMPARE[op](*args), stage
        if op in LOGIC:
            return LOGIC[op](*args), stage
        if op == "not":
            return ~args[0], stage
        was = [w.lag(a, 1) for a in args]
        return self._made(self.key(node), stage + 1, F.coalesce(CROSS[op](*args, *was), F.lit(False)), None)

    def _kernel(self, node: dict) -> tuple[Column, int]:
        op, n, key = node["op"], scalar(node["period"], self.params), self.key(node)
        if op == "choppiness":
            _, stage = self._made("true range", 1, w.true_range(), None)
            return self._made(key, stage + 1, w.choppiness(w.period(n, 2), self.names["true range"]), None)
        if op == "rangepos":
            return self._made(key, 1, w.rangepos(w.period(n, 2)), None)
        if op in ("atr", "adx"):
            return self._made(key, 1, None, (op, ("h", "l", "c"), w.period(n, 2 if op == "adx" else 1)))
        source, stage = self.column(node["src"])
        if op in FIXED_WINDOW:
            return self._made(key, stage + 1, FIXED_WINDOW[op](source, w.period(n)), None)
        named, stage = self._made("source " + self.key(node["src"]), stage + 1, source.cast("double"), None)
        return self._made(key, stage + 1, None, (op, (self.names["source " + self.key(node["src"])],), w.period(n)))

    def run(self, bars: DataFrame, outputs: dict[str, Column], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
        own = bars
        for native, grouped in zip(self.native, self.grouped, strict=True):
            if native:
                own = own.withColumns(native)
            if grouped:
                own = recursive.apply(own, {name: recursive.of(op, *inputs, n=n) for name, (op, inputs, n) in grouped.items()}, by)
        return own.withColumns(outputs).select(*bars.columns, *outputs)


def evaluate(bars: DataFrame, expressions: dict[str, dict], params: dict[str, float] | None = None) -> DataFrame:
    """bars with a column for each named expression."""
    plan = Plan(params or {})
    outputs = {name: plan.column(node)[0] for name, node in expressions.items()}
    return plan.run(bars, outputs)


def signals_of_many(bars: DataFrame, doc: dict, many: list[dict[str, float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row of bars for each parameter set, numbered by config from 0, with the document's conditions.

    One plan for all: a kernel with the same numbers in several sets is made once, and all share the exchange by symbol.
    keep: columns of bars that rows carry besides symbol, ts, i and prices.
    """
    plan, wanted, outputs = Plan({}), [s for s in SIGNALS if doc.get(s)], {}
    for k, own in enumerate(many):
        plan.params = {**defaults(doc), **own}
        outputs |= {f"{s}_{k}": plan.column(doc[s])[0] for s in wanted}
    made = plan.run(bars, outputs)
    rows = [F.struct(F.lit(k).alias("config"), *[(F.col(f"{s}_{k}") if s in wanted else F.lit(False)).alias(s) for s in SIGNALS]) for k in range(len(many))]
    return made.select("symbol", "ts", "i", "o", "h", "l", "c", *keep, F.inline(F.array(*rows)))


def signals(bars: DataFrame, doc: dict, params: dict[str, float] | None = None) -> DataFrame:
    """bars with the document's conditions (false where it has none) and atr14."""
    wanted = {s: doc[s] for s in SIGNALS if doc.get(s)}
    atr = {"op": "atr", "src": {"op": "price", "field": "close"}, "period": {"op": "const", "value": 14}}
    out = evaluate(bars, {**wanted, "atr14": atr}, {**defaults(doc), **(params or {})})
    return out.withColumns({s: F.lit(False) for s in SIGNALS if s not in wanted})


def with_funding(bars: DataFrame, stamps: DataFrame, keys: DataFrame) -> DataFrame:
    """bars with the streams made of funding stamps (ts, event_id, rate): level, changes, z and sum of the last 21.

    The streams are made once, along the stamps, which are one ordered series; each key then gets a copy to join as of.
    """
    from pyspark.sql import Window

    from tidemark.operators import joins

    o = Window.partitionBy(F.lit(1)).orderBy("ts", "event_id")
    last = o.rowsBetween(-20, 0)
    own = stamps.withColumn("fundroc", F.coalesce(F.col("rate") - F.lag("rate").over(o), F.lit(0.0)))
    own = own.withColumn("fundaccel", F.when(F.row_number().over(o) > 2, F.col("fundroc") - F.lag("fundroc").over(o)).otherwise(0.0))
    sd = F.stddev_pop("rate").over(last)
    z = F.when((F.count("rate").over(last) >= 10) & (sd > nulls.EPS), (F.col("rate") - F.avg("rate").over(last)) / sd).otherwise(0.0)
    own = own.withColumns({"fundzscore": z, "fundmom": F.sum("rate").over(last), "funding": F.col("rate")})
    names = ["funding", "fundroc", "fundaccel", "fundzscore", "fundmom"]
    return joins.asof_backward(bars, joins.for_each_key(own, keys), names, ["symbol"], ["event_id"]).fillna(0.0, names)
