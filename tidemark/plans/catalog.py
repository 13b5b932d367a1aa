"""Producers of strategy documents: a signal catalogue, seeded sampling, mutation, crossover, and choice by posterior."""

from __future__ import annotations

import copy
import random

from tidemark.plans import expr


def const(v: float) -> dict:
    return {"op": "const", "value": v}


def price(name: str) -> dict:
    return {"op": "price", "field": name}


def ind(op: str, src: dict, n: float | dict) -> dict:
    return {"op": op, "src": src, "period": n if isinstance(n, dict) else const(n)}


def two(op: str, a: dict, b: dict) -> dict:
    return {"op": op, "a": a, "b": b}


CLOSE = price("close")
#: Named numeric signals, each one expression.
SIGNALS: dict[str, dict] = {
    "roc_short": ind("roc", CLOSE, 5), "roc_mid": ind("roc", CLOSE, 20), "roc_long": ind("roc", CLOSE, 60), "zscore": ind("zscore", CLOSE, 20), "slope": ind("slope", CLOSE, 20), "rsi": ind("rsi", CLOSE, 14), "rank": ind("pctrank", CLOSE, 50), "efficiency": ind("effratio", CLOSE, 20),
    "strength": ind("adx", CLOSE, 14), "chop": ind("choppiness", CLOSE, 14), "place": ind("rangepos", CLOSE, 20), "trend_gap": two("sub", two("div", CLOSE, ind("sma", CLOSE, 50)), const(1)), "volatility": two("div", ind("stdev", CLOSE, 20), CLOSE), "volume_z": ind("zscore", price("volume"), 20),
    "funding": {"op": "funding"}, "funding_z": {"op": "fundzscore"}, "funding_sum": {"op": "fundmom"}, "funding_change": {"op": "fundroc"}, "basis": {"op": "basis"}, "open_interest": {"op": "oi"}, "taker_ratio": {"op": "lsr"},
}


def document(name: str, enter: dict, leave: dict, why: str, params: dict | None = None, **risk: float) -> dict:
    return {"name": name, "hypothesis": why, "tf": "1d", "longEntry": enter, "longExit": leave, "params": params or {}, "risk": {"volTargetAnnual": 0.3, "maxLeverage": 2.0, **risk}}


def used_signals(doc: dict) -> set[str]:
    """Catalogue entries whose operator and input a document has."""
    shape = lambda n: (n["op"], expr.canonical(n.get("src") or {"op": "const", "value": 0}, None))
    own = {shape(n) for s in expr.SIGNALS if doc.get(s) for n in expr.walk(doc[s])}
    return {name for name, node in SIGNALS.items() if any(shape(n) in own for n in expr.walk(node) if n["op"] not in ("const", "price"))}


#: Families of return sources, by the operators that speak for them.
FAMILIES = {"trend": {"crossover", "roc", "slope", "adx", "highest"}, "reversion": {"zscore", "rsi", "pctrank", "lowest", "rangepos"}, "carry": {"funding", "fundzscore", "fundmom", "fundroc", "fundaccel", "basis"}, "positioning": {"oi", "lsr"}, "volatility": {"stdev", "atr", "choppiness", "effratio"}, "value": {"mvrv", "nvt", "activeaddr", "txcnt", "exnetflow", "stablesupply"}, "calendar": {"hourutc", "dowutc"}}


def family(doc: dict) -> str:
    """The family with most operators in the document's entries; the first of equals."""
    ops = [n["op"] for s in ("longEntry", "shortEntry") if doc.get(s) for n in expr.walk(doc[s])]
    score = {name: sum(op in own for op in ops) for name, own in FAMILIES.items()}
    best = max(score, key=lambda k: score[k])
    return best if score[best] else "other"


def sample(rng: random.Random) -> dict:
    """A random document: one or two signals compared with thresholds or their own averages."""

    def condition(up: bool) -> dict:
        name = rng.choice([k for k in SIGNALS if not k.startswith(("funding", "basis", "open", "taker"))])
        node = copy.deepcopy(SIGNALS[name])
        other = ind("sma", copy.deepcopy(node), rng.choice([10, 20, 40])) if rng.random() < 0.5 else const(round(rng.uniform(-1, 1), 2))
        return two("gt" if up else "lt", node, other)

    enter = condition(True) if rng.random() < 0.5 else two("and", condition(True), condition(rng.random() < 0.7))
    return document(f"sampled {rng.randrange(10**6)}", enter, condition(False), "sampled from the catalogue of signals")


def mutate(doc: dict, rng: random.Random) -> dict:
    """One change: a constant scaled, a period changed, an average for another, or a condition denied."""
    out = copy.deepcopy(doc)
    nodes = [n for s in expr.SIGNALS if out.get(s) for n in expr.walk(out[s])]
    node = rng.choice(nodes)
    if node["op"] == "const":
        node["value"] = round(node["value"] * rng.uniform(0.7, 1.4), 4) if node["value"] else rng.choice([-0.1, 0.1])
    elif node["op"] in ("sma", "ema", "wma", "median"):
        node["op"] = rng.choice([k for k in ("sma", "ema", "wma", "median") if k != node["op"]])
    elif node["op"] in expr.KERNELS and node["period"]["op"] == "const":
        node["period"] = const(max(2, min(expr.MOST_PERIOD, round(node["period"]["value"] * rng.uniform(0.6, 1.6)))))
    elif node["op"] in ("gt", "lt"):
        node["op"] = "lt" if node["op"] == "gt" else "gt"
    out["name"] = f"{doc['name']} changed"
    return out


def cross(a: dict, b: dict) -> dict:
    """The entries of one document with the exits and risk of another."""
    own = {k: copy.deepcopy(v) for k, v in a.items() if k in ("longEntry", "shortEntry", "tf")}
    rest = {k: copy.deepcopy(v) for k, v in b.items() if k in ("longExit", "shortExit", "risk")}
    out = {**own, **rest, "params": {**b["params"], **a["params"]}, "name": f"{a['name']} with exits of {b['name']}", "hypothesis": a["hypothesis"]}
    if bool(out.get("shortEntry")) != bool(out.get("shortExit")):
        out.pop("shortEntry", None)
        out.pop("shortExit", None)
    return out


def folded(doc: dict) -> dict:
    """The document with parameters that it doesn't declare as constants."""
    out = copy.deepcopy(doc)
    for s in expr.SIGNALS:
        for n in expr.walk(out[s]) if out.get(s) else ():
            if n["op"] == "param" and n["name"] not in out["params"]:
                n.clear()
                n.update(const(1.0))
    return out


def choose(stats: dict[str, tuple[int, int]], rng: random.Random, worst: bool = False) -> str:
    """A recipe by a draw from each one's Beta posterior of (successes, attempts); the least promising if worst."""
    draws = {k: rng.betavariate(1 + s, 1 + max(0, n - s)) for k, (s, n) in sorted(stats.items())}
    return (min if worst else max)(draws, key=lambda k: draws[k])
