"""Accounts stepped forward by arriving bars, by the kind of their candidate, as keyed state behind a watermark.

A feed is long: a row for each bar of each symbol that a candidate trades, with the candidate's own parameters (FEED).
Bars wait in state until the watermark passes their time; a timer then steps the account through them in order. So bars
that come late, but within the watermark, and bars that come again change nothing. replayed() gives the same steps of a
table.

A step: the weights held earn the move since the last close, pay funding and, above 1, are lost where the low passes the
margin; then each symbol's target is decided from its bars up to now, and changes of over `BAND` are traded at a cost. An
account whose equity falls below a limit from its top of the last 1, 7 or 30 days is halted: flat, with no steps any more.

Nulls: a bar without a close, a symbol or a time isn't one; without a low the close counts, without a rate 0; a bar
without an index value leaves the target of the kinds that need one as it was.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Bars of a symbol that an account remembers, the least change of weight that is traded, margin and yearly cost of borrowing.
KEEP, BAND, MARGIN, BORROW = 3000, 0.02, 0.005, 0.10
#: Bars of the cycle leg's average.
LONG = 200
#: Days and greatest falls of the limits.
LIMITS = ((1, "daily", -0.05), (7, "weekly", -0.10), (30, "monthly", -0.20))
DAY_MS = 86_400_000
DECAY, WARM = 0.94, 500

#: kind: trend, implied, blend or coins. x: the index that implied (volatility) and blend (valuation) read.
FEED = "candidate string, kind string, signal string, n int, z_n int, edge double, share double, lever double, coins int, vol double, cost double, idle double, symbol string, ts timestamp, h double, l double, c double, rate double, x double"
PLAN = ("kind", "signal", "n", "z_n", "edge", "share", "lever", "coins", "vol", "cost", "idle")
PLAN_KINDS = "kind string, signal string, n int, z_n int, edge double, share double, lever double, coins int, vol double, cost double, idle double"
STEPS = "candidate string, ts timestamp, ret double, equity double, weight double, trades int, halted boolean, reason string"
COLUMNS = [c.split()[0] for c in STEPS.split(", ")]
BAR = ("h", "l", "c", "rate", "x")


def _past_z(x: list[float], n: int, least: int = 20) -> float:
    """The newest value against the n before it."""
    past = np.array(x[-n - 1 : -1])
    return 0.0 if len(past) < least else (x[-1] - past.mean()) / max(past.std(), 1e-6)


def _mean(x: list[float], n: int) -> float:
    return math.fsum(x[-n:]) / n if len(x) >= n else math.nan


def _chop(bars: list[tuple], n: int = 14) -> float:
    """Choppiness of the last n bars; NaN before there are n + 1."""
    if len(bars) < n + 1:
        return math.nan
    h, low, c = np.array(bars[-n - 1 :], dtype=float)[:, :3].T
    ranges = np.maximum(h[1:] - low[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(low[1:] - c[:-1]))).sum()
    spread = h[1:].max() - low[1:].min()
    return 100 * math.log10(ranges / spread) / math.log10(n) if spread > 1e-12 and ranges > 0 else 50.0


def _variance(c: list[float]) -> float:
    own = np.array(c[-WARM - 2 :])
    r2 = (own[1:] / own[:-1] - 1)[::-1] ** 2  # the newest first
    if not len(r2):
        return 0.0
    parts = (1 - DECAY) * DECAY ** np.arange(len(r2))
    parts[-1] = DECAY ** (len(r2) - 1)
    return float(r2 @ parts)


class Account:
    """What an account remembers, and how a bar of each of its symbols steps it."""

    def __init__(self, plan: tuple, equity: float = 1.0, last: int = -1, halted: bool = False, reason: str | None = None) -> None:
        self.plan = dict(zip(PLAN, plan, strict=True))
        self.equity, self.last, self.halted, self.reason = equity, last, halted, reason
        self.held: dict[str, tuple[float, float]] = {}  # weight and last close by symbol
        self.bars: dict[str, list[tuple]] = {}  # (h, l, c, x), the newest last
        self.legs: dict[str, tuple[int, float, int]] = {}  # mode and weight of blend's first leg, and bars seen
        self.tops: list[tuple[int, float]] = []  # equity of the last 30 days

    def target(self, symbol: str, weight: float) -> float:
        p, bars = self.plan, self.bars[symbol]
        need = {"trend": p["n"], "coins": max(p["n"], WARM + 2), "blend": max(p["n"], LONG + 1)}.get(p["kind"], 1)
        c = [b[2] for b in bars[-need:]]
        if p["kind"] == "trend":
            return p["lever"] if c[-1] > _mean(c, p["n"]) else 0.0
        if p["kind"] == "coins":
            mean = _mean(c, p["n"])
            up = weight > 0 and not c[-1] < mean
            up = up or (c[-1] > mean and _chop(bars) < p["edge"])
            var = _variance(c)
            return min(1.0, p["vol"] / math.sqrt(365 * var) if var > 1e-12 else 1.0) if up else 0.0
        if bars[-1][3] is None:
            return weight
        if p["kind"] == "implied":
            gap = float(p["signal"].startswith("gap"))
            known = islice((b[3] - gap * b[4] for b in reversed(bars) if b[3] is not None), p["z_n"] + 1)
            x = [*known][::-1]
            z = _past_z(x, p["z_n"])
            return float(z > p["edge"] if p["signal"].endswith("high") else z < -p["edge"])
        return self.blend(symbol, c)

    def blend(self, symbol: str, c: list[float], n_long: int = LONG, buy: float = 0.0, sell: float = 0.6, days: int = 90, sell_step: float = 0.06) -> float:
        """share of the cycle leg, which reads yesterday's valuation and long average, and the rest of the trend leg."""
        mode, leg, seen = self.legs.get(symbol, (0, 0.0, 0))
        n, i = self.plan["n"], seen
        if i > max(n, n_long) + 2:
            known = (1 - 1 / b[3] for b in islice(reversed(self.bars[symbol]), 1, None) if b[3] is not None and b[3] > 0)
            value, up = next(known, 0.0), c[-1] >= _mean(c[:-1], n_long)
            step = 1 / max(1, round(days / 30 * 4))
            mode = -1 if value >= sell and leg > 0 else 1 if value <= buy and leg < 1 else mode
            if mode < 0:
                leg = max(0.0, leg - (sell_step if up else 2 * step))
            elif mode > 0:
                leg = 1.0 if up else min(1.0, leg + step)
            if (mode < 0 and leg <= 1e-9) or (mode > 0 and leg >= 1 - 1e-9):
                mode = 0
            out = self.plan["share"] * leg + (1 - self.plan["share"]) * float(c[-1] >= _mean(c, n))
        else:
            out = 0.0
        self.legs[symbol] = mode, leg, seen + 1
        return out

    def step(self, ms: int, bars: dict[str, tuple]) -> tuple | None:
        """Steps through the bars (h, l, c, rate, x) of one time by symbol: ret, equity, weight, trades, halted, reason."""
        if self.halted or ms <= self.last:
            return None
        p, ret, trades = self.plan, 0.0, 0
        lever = p["lever"] if p["kind"] == "coins" else 1.0
        part = lever / max(1, p["coins"])
        for symbol, (h, low, c, rate, x) in sorted(bars.items()):
            own = self.bars.setdefault(symbol, [])
            rv = self.realised(own, c)
            own.append((h, low, c, x, rv))
            del own[:-KEEP]
            weight, was = self.held.get(symbol, (0.0, 0.0))
            moved = weight * (c / was - 1) if weight and was > 0 else 0.0
            exposed = lever * weight
            ret += part * (moved - weight * rate)
            if p["kind"] == "blend":
                ret += max(0.0, 1 - weight) * p["idle"] / 365
            if p["kind"] in ("trend", "coins") and exposed > 1 and was > 0 and low / was - 1 <= -(1 / exposed - MARGIN):
                lost = -(1 / exposed - MARGIN)
                ret = lost if p["kind"] == "trend" else ret + lost / max(1, p["coins"]) - part * moved
                self.held[symbol] = 0.0, c
                trades += 1
                continue
            to = self.target(symbol, weight)
            if abs(to - weight) > BAND:
                ret -= part * abs(to - weight) * p["cost"]
                trades, weight = trades + 1, to
            self.held[symbol] = weight, c
        if lever > 1 and any(abs(w) > 1e-6 for w, _ in self.held.values()):
            ret -= (lever - 1) * BORROW / 365
        self.equity, self.last = self.equity * (1 + ret), ms
        for days, name, most in LIMITS:
            fall = self.equity / max([self.equity, *(e for t, e in self.tops if t >= ms - days * DAY_MS)]) - 1
            if fall < most:
                self.halted, self.reason = True, f"{name} fall"
                self.held = {s: (0.0, c) for s, (_, c) in self.held.items()}
                break
        self.tops = [t for t in self.tops if t[0] >= ms - 30 * DAY_MS] + [(ms, self.equity)]
        return ret, self.equity, sum(w for w, _ in self.held.values()), trades, self.halted, self.reason

    def realised(self, bars: list[tuple], close: float) -> float:
        """Percent a year over up to n + 1 of the returns up to this close, 0 with 5 or fewer."""
        if self.plan["kind"] != "implied" or not self.plan["signal"].startswith("gap"):
            return 0.0
        c = np.array([*(b[2] for b in bars[-self.plan["n"] - 1 :]), close])
        r = c[1:] / c[:-1] - 1
        return float(r.std() * math.sqrt(365) * 100) if len(r) > 5 else 0.0


class Forward(StatefulProcessor):
    """Accounts in state: the plan and the account as values, what is held and what waits as maps, recent bars and tops as lists."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", PLAN_KINDS)
        self.account = handle.getValueState("account", "equity double, last long, halted boolean, reason string")
        self.held = handle.getMapState("held", "symbol string", "weight double, close double")
        self.legs = handle.getMapState("legs", "symbol string", "mode int, leg double, seen long")
        self.recent = handle.getListState("recent", "symbol string, h double, l double, c double, x double, rv double")
        self.tops = handle.getListState("tops", "ms long, equity double")
        self.waiting = handle.getMapState("waiting", "ms long, symbol string", "h double, l double, c double, rate double, x double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.account.get()[1] if self.account.exists() else -1
        times = set()
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                ms = int(row.ts.value // 1_000_000)
                if ms <= last:
                    continue
                self.plan.update(tuple(_plain(getattr(row, c)) for c in PLAN))
                self.waiting.updateValue((ms, row.symbol), tuple(_plain(getattr(row, c)) for c in BAR))
                times.add(ms)
        for ms in times:
            self.handle.registerTimer(ms)
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        due: dict[int, dict[str, tuple]] = {}
        for (ms, symbol), bar in self.waiting.iterator():
            if ms <= now:
                due.setdefault(ms, {})[symbol] = bar
        if not due:
            return
        own = self.load()
        out = []
        for ms in sorted(due):
            if (done := own.step(ms, due[ms])) is not None:
                out.append((key[0], pd.Timestamp(ms, unit="ms"), *done))
            for symbol in due[ms]:
                self.waiting.removeKey((ms, symbol))
        self.store(own)
        yield pd.DataFrame(out, columns=COLUMNS)

    def load(self) -> Account:
        own = Account(self.plan.get(), *(self.account.get() if self.account.exists() else ()))
        own.held = {s[0]: tuple(v) for s, v in self.held.iterator()}
        own.legs = {s[0]: tuple(v) for s, v in self.legs.iterator()}
        for symbol, *bar in self.recent.get():
            own.bars.setdefault(symbol, []).append(tuple(bar))
        own.tops = [tuple(t) for t in self.tops.get()]
        return own

    def store(self, own: Account) -> None:
        self.account.update((own.equity, own.last, own.halted, own.reason))
        for s, v in own.held.items():
            self.held.updateValue((s,), v)
        for s, v in own.legs.items():
            self.legs.updateValue((s,), v)
        self.recent.put([(s, *b) for s, bars in own.bars.items() for b in bars])
        self.tops.put(own.tops)

    def close(self) -> None:
        pass


def _plain(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else v.item() if hasattr(v, "item") else v


def _ready(feed: DataFrame) -> DataFrame:
    own = feed.where(F.col("c").isNotNull() & F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    own = own.withColumns({"l": F.coalesce("l", "c"), "h": F.coalesce("h", "c"), "rate": F.coalesce("rate", F.lit(0.0)), **{c: F.coalesce(c, F.lit(0)) for c in ("n", "z_n", "coins")}})
    return own.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FEED.split(", ")])


def stepped(feed: DataFrame, late: str = "5 days") -> DataFrame:
    """The steps of a streaming feed, each once its time can't change any more: bars up to `late` behind still count.

    The session needs the RocksDB provider of state stores, see `ROCKS`.
    """
    return _ready(feed).withWatermark("ts", late).groupBy("candidate").transformWithStateInPandas(Forward(), STEPS, "append", "eventTime")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def replayed(feed: DataFrame) -> DataFrame:
    """The steps of a table: a candidate is a group, its bars as long as its history. Of a bar that is there repeatedly, one counts."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, out = None, []
        rows = pdf.sort_values("ts", kind="stable").itertuples(index=False)
        for ts, same in groupby(rows, lambda r: r.ts):
            now = list(same)
            own = own or Account(tuple(_plain(getattr(now[0], c)) for c in PLAN))
            if (done := own.step(int(ts.value // 1_000_000), {r.symbol: tuple(_plain(getattr(r, c)) for c in BAR) for r in now})) is not None:
                out.append((key[0], ts, *done))
            if own.halted:
                break
        return pd.DataFrame(out, columns=COLUMNS)

    return _ready(feed).groupBy("candidate").applyInPandas(run, STEPS)
