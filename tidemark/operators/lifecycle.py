"""A candidate's life after its birth: identity and validity of sleeve documents, stages, summaries, deployments, monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages of a candidate that lives, and of one that waits for a worker.
ALIVE = ("incubating", "eligible", "champion", "sealed_passed")
WAITING = ("queued", "gauntlet")
#: By kind of sleeve its fields with the lowest and highest value allowed.
BOUNDS: dict[str, dict[str, tuple[float, float]]] = {
    "xsection": {"topK": (1, 20), "rebalEvery": (1, 60), "lookback": (5, 400)},
    "ivsleeve": {"zWin": (20, 400), "thresh": (0, 2)},
    "onchainsleeve": {"zWin": (20, 400), "thresh": (0, 2)},
    "blend": {"smaWin": (20, 400), "maWin": (50, 400)},
    "block": {"smaWin": (20, 400), "chopThr": (30, 70)},
}


def digest(*parts: Column, length: int = 24) -> Column:
    """The identity of a document: the beginning of a hash of its parts as a JSON array; NULL is a part like any other."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, length)


def faults(kind: str, fields: dict[str, Column], **rules: Column) -> Column:
    """Names of the fields out of their bounds, and of the further rules that don't hold; NULL never holds."""
    checks = {name: fields[name].between(*BOUNDS[kind][name]) for name in BOUNDS[kind]} | rules
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def symbol_of(document: Column, default: str) -> Column:
    """A JSON document's symbol, else that of its first coin, else the default, also where the text isn't JSON."""
    return F.coalesce(F.get_json_object(document, "$.symbol"), F.get_json_object(document, "$.coins[0].symbol"), F.lit(default))


def distinct_configs(configs: DataFrame, params: tuple[str, ...], order: str, by: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """The first of the configurations that are equal when rounded. Equal ones merge before the shuffle."""
    key = [F.round(p, digits).alias(f"_{p}") for p in params]
    rest = [c for c in configs.columns if c not in by]
    return configs.groupBy(*by, *key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def widest(params: DataFrame, by: tuple[str, ...], n: int = 6) -> DataFrame:
    """The n parameters (by, name, min, max, default) of each document with the widest range for their default; ties by name."""
    wide = (F.col("max") - F.col("min")) / F.greatest(F.lit(1e-9), F.abs("default"))
    return params.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(wide), "name"))).where(F.col("_r") <= n).drop("_r")


def alive_by_name(candidates: DataFrame, names: DataFrame) -> DataFrame:
    return candidates.where(F.col("stage").isin(*ALIVE)).join(names.select("name").distinct(), "name", "left_semi")


def without_family(rows: DataFrame, families: DataFrame, family: str = "family") -> DataFrame:
    """The table without the rows of some families; a row without a family stays."""
    return rows.join(families.select(family).distinct(), family, "left_anti")


def watchable(accounts: DataFrame, candidates: DataFrame, first_source: str, first_symbol: str, key: str = "id") -> DataFrame:
    """Accounts whose candidate is known, with its place in the list: the first source's on the first symbol, its others, the rest; by name.

    priority is 0, 1 or 2, so that readers of a part of the list needn't sort all of it.
    """
    first = F.coalesce(F.col("source") == first_source, F.lit(False))
    priority = F.when(first & (F.col("symbol") == first_symbol), 0).when(first, 1).otherwise(2)
    return accounts.join(candidates, key).withColumn("priority", priority).orderBy("priority", "name", key)


def ranking(rows: DataFrame, *scores: str, alive: str = "alive", tie: str = "id") -> DataFrame:
    """The living first, then by each score; a row without a score comes after those with one."""
    return rows.orderBy(F.desc(alive), *[F.desc_nulls_last(s) for s in scores], tie)


def users_own(candidates: DataFrame, source: str, metrics: str = "metrics", flag: str = "$.userStrategy") -> DataFrame:
    """Incubating rows of a source, or that their metrics mark as a user's."""
    marked = F.coalesce(F.get_json_object(metrics, flag).cast("double") == 1, F.lit(False))
    return candidates.where((F.col("stage") == "incubating") & (F.coalesce(F.col("source") == source, F.lit(False)) | marked))


def with_fallback(stored: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Stored summaries, and the computed one wherever none is stored; cached tells which.

    computed is lazy: filters on the key that a reader sets reach it.
    """
    missing = computed.join(stored.select(key), key, "left_anti").withColumn("cached", F.lit(False))
    return stored.select(*computed.columns).withColumn("cached", F.lit(True)).unionByName(missing)


def latest_known(rows: DataFrame, column: str, at: str, among: int, columns: tuple[str, ...], tie: str = "id") -> DataFrame:
    """Of the `among` newest rows the one updated last that has the column."""
    recent = rows.orderBy(F.desc("created"), F.desc(tie)).limit(among).where(F.col(column).isNotNull())
    return recent.agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("r")).where("r is not null").select("r.*")


def deployments(existing: DataFrame, asked: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """New deployments of known candidates that have none and a symbol of their own or asked for: defaults set, weights within 0 and 1.

    asked: key, capital, and, each of them nullable, max_weight, band, max_daily_loss, max_drawdown, asked_symbol. Of requests for
    one candidate the one with the least capital counts.
    """
    one = asked.groupBy(key).agg(F.min(F.struct("capital", *[c for c in asked.columns if c not in (key, "capital")])).alias("r")).select(key, "r.*")
    own = one.join(existing.select(key), key, "left_anti").join(candidates.select(key, "name", "symbol"), key)
    own = own.withColumn("symbol", F.coalesce("asked_symbol", "symbol")).where("symbol is not null")
    return own.select(
        key, "name", "symbol", F.lit("dryrun").alias("mode"), "capital",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("max_weight", F.lit(1.0)))).alias("max_weight"),
        F.coalesce("band", F.lit(0.02)).alias("band"), F.coalesce("max_daily_loss", F.lit(6.0)).alias("max_daily_loss"), F.coalesce("max_drawdown", F.lit(25.0)).alias("max_drawdown"),
        F.col("capital").alias("equity"), F.col("capital").alias("peak"),
    )


def recorded(deployed: DataFrame, runs: DataFrame, key: str = "id") -> DataFrame:
    """Deployments after their runs (key, ts, equity, halt): the last equity, the highest ever, halted for good if any run says so."""
    after = runs.groupBy(key).agg(F.max_by("equity", "ts").alias("_equity"), F.max("equity").alias("_peak"), F.coalesce(F.bool_or("halt"), F.lit(False)).alias("_halt"))
    own = deployed.join(after, key, "left")
    changed = {"equity": F.coalesce("_equity", "equity"), "peak": F.greatest("peak", F.coalesce("_peak", "peak")), "mode": F.when(F.col("_halt"), "halted").otherwise(F.col("mode"))}
    return own.withColumns(changed).select(*deployed.columns)


def stale(rows: DataFrame, limits: DataFrame, now: Column, kind: str = "kind", at: str = "ts") -> DataFrame:
    """Kinds (limits: kind, hours) whose newest row is older than their limit, with its age in hours; one that has no row at all has none."""
    newest = rows.groupBy(kind).agg(F.max(at).alias("newest"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3.6e9
    own = F.broadcast(limits).join(newest, kind, "left").withColumn("age", age)
    return own.where(F.col("age").isNull() | (F.col("age") > F.col("hours"))).select(kind, "age")


def reaped(candidates: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """The table after rows that wait for more than some days have failed."""
    stuck = F.col("stage").isin(*WAITING) & (F.col("created") < now - F.expr(f"interval {days} days"))
    return candidates.withColumns({"failed_stage": F.when(stuck, "S0-stale").otherwise(F.col("failed_stage")), "stage": F.when(stuck, "failed").otherwise(F.col("stage"))})


def graduated(incubating: DataFrame, min_days: float, slack: float = 0.5) -> DataFrame:
    """next and why of incubating rows (days, halted, live, p5, diversifies): failed if halted, kept until their time has come.

    Then eligible if the live ratio is at most `slack` below the back-test's 5th percentile or the row diversifies the book; else failed.
    """
    band = F.coalesce("p5", F.lit(0.0)) - slack
    halted, early = F.coalesce("halted", F.lit(False)), ~F.coalesce(F.col("days") >= min_days, F.lit(False))
    good, book = F.coalesce(F.col("live") >= band, F.lit(False)), F.coalesce("diversifies", F.lit(False))
    why = F.when(halted, "halted").when(early, "early").when(good, "band").when(book, "book").otherwise("below")
    following = F.when(halted, "failed").when(early, "incubating").when(good | book, "eligible").otherwise("failed")
    return incubating.withColumns({"band": band, "next": following, "why": why})


def promoted(eligible: DataFrame, champion: DataFrame, beat: float = 1.1, score: str = "composite", tie: str = "id") -> DataFrame:
    """The best eligible row if it beats the champion's score by the ratio, or if there is no champion. Both sides become one row before they meet."""
    best = eligible.where(F.col(score).isNotNull()).agg(F.max_by(F.struct(tie, score), F.struct(F.col(score), -F.col(tie))).alias("b"))
    bar = champion.agg(F.count("*").alias("n"), F.coalesce(F.max(score), F.lit(0.0)).alias("bar"))
    met = best.where("b is not null").crossJoin(F.broadcast(bar))
    return met.where((F.col("n") == 0) | (F.col(f"b.{score}") >= F.col("bar") * beat)).select("b.*")


def degraded(champions: DataFrame, returns: DataFrame, least: int = 24 * 14, slack: float = 1.0, per_year: float = 365 * 24, key: str = "id") -> DataFrame:
    """Champions (key, p5, halted) whose ratio over more than `least` of their returns is more than `slack` below their 5th percentile."""
    sd = F.stddev_pop("ret")
    live = returns.groupBy(key).agg(F.count("ret").alias("n"), F.when(sd > 1e-12, F.avg("ret") / sd * F.sqrt(F.lit(per_year))).otherwise(0.0).alias("live")).where(F.col("n") > least)
    return champions.where(~F.coalesce("halted", F.lit(False))).join(live, key).where(F.col("live") < F.coalesce("p5", F.lit(0.0)) - slack).select(key, "live")


def signal_weights(ranked: DataFrame, families: dict[str, str]) -> DataFrame:
    """By family of leaf (family by the beginning of a signal's name): 1 + the highest |ir| of its signals that aren't redundant.

    A family without any is 1; without any signal of any family there is no row.
    """
    family = F.coalesce(*[F.when(F.startswith(F.col("signal"), F.lit(begin)), F.lit(name)) for begin, name in families.items()])
    best = ranked.where(~F.coalesce("redundant", F.lit(False))).groupBy(family.alias("family")).agg(F.max(F.abs(F.coalesce("ir", F.lit(0.0)))).alias("best")).where("family is not null")
    all_of = ranked.sparkSession.createDataFrame([(f,) for f in sorted(set(families.values()))], "family string")
    some = best.agg(F.count("*").alias("some")).where("some > 0")
    return F.broadcast(all_of).join(best, "family", "left").crossJoin(F.broadcast(some)).select("family", (1 + F.coalesce("best", F.lit(0.0))).alias("weight"))


def ranking_text(ranked: DataFrame, n: int = 10, native: str = "native") -> DataFrame:
    """One row: the n signals of the highest |ir| that aren't redundant, a numbered line for each."""
    top = ranked.where(~F.coalesce("redundant", F.lit(False)) & F.col("ir").isNotNull() & ~F.isnan("ir")).orderBy(F.desc(F.abs("ir")), "signal").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("ir")), "signal"))
    line = F.concat(place.cast("string"), F.lit(". "), F.col("signal"), F.when(F.col(native), " (native)").otherwise(""), F.lit(": IR "), F.format_string("%.2f", F.col("ir")))
    lines = top.select(place.alias("k"), line.alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def orthogonality(pairs: DataFrame, by: tuple[str, ...] = ("signal",), least: int = 10) -> DataFrame:
    """By signal of (by, other, x, y): the other with the highest |rank correlation| over the pairs where both are there, 0 under `least` pairs.

    Ties go to the first name; where all are 0 there is no other.
    """
    own = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    group = [*by, "other"]
    for c in ("x", "y"):
        own = own.withColumn(f"_{c}", F.rank().over(Window.partitionBy(*group).orderBy(c)) + (F.count("*").over(Window.partitionBy(*group, c)) - 1) / 2)
    corr = own.groupBy(*group).agg(F.when(F.count("*") >= least, F.coalesce(F.nanvl(F.corr("_x", "_y"), F.lit(None)), F.lit(0.0))).otherwise(0.0).alias("corr"))
    top = corr.groupBy(*by).agg(F.count("*").alias("others"), F.min(F.struct((-F.round(F.abs("corr"), 12)).alias("a"), "other")).alias("t"))
    return top.select(*by, "others", (-F.col("t.a")).alias("max_corr"), F.when(F.col("t.a") < 0, F.col("t.other")).alias("nearest"))


def curve_stats(curves: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """total, cagr, max_dd and calmar of equity curves (by, ts, eq) that begin at 1."""
    so_far = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max("eq").over(so_far)
    own = curves.withColumn("dd", F.when(top > 0, F.col("eq") / top - 1).otherwise(0.0))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    out = own.groupBy(*by).agg(F.max_by("eq", "ts").alias("last"), F.least(F.min("dd"), F.lit(0.0)).alias("max_dd"), F.greatest(F.lit(0.01), (seconds(F.max("ts")) - seconds(F.min("ts"))) / (365 * 86_400)).alias("years"))
    out = out.select(*by, (F.col("last") - 1).alias("total"), F.when(F.col("last") > 0, F.pow("last", 1 / F.col("years")) - 1).otherwise(-1.0).alias("cagr"), "max_dd")
    return out.withColumn("calmar", F.when(F.col("max_dd") < 0, F.col("cagr") / F.abs("max_dd")).otherwise(0.0))


def held_over(prices: DataFrame, curves: DataFrame, by: tuple[str, ...] = ("id",), price: str = "c") -> DataFrame:
    """(by, ts, eq): prices above 0 within the times of a curve, over the first of them."""
    span = curves.groupBy(*by).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    own = prices.where((F.col(price) > 0) & ~F.isnan(price)).join(F.broadcast(span) if not by else span, list(by)).where(F.col("ts").between(F.col("_a"), F.col("_b")))
    return own.select(*by, "ts", (F.col(price) / F.first(price).over(Window.partitionBy(*by).orderBy("ts"))).alias("eq"))


def benchmark(prices: DataFrame, now: Column, by: tuple[str, ...] = ("symbol",), years: int = 6, least: int = 50, most: int = 300) -> DataFrame:
    """(by, ts, c): closes above 0 of the last years, about `most` of them and the last; none under `least`."""
    recent = prices.where((F.col("c") > 0) & ~F.isnan("c") & (F.col("c") < float("inf")) & (F.col("ts") >= now - F.expr(f"interval {365 * years} days")))
    order = Window.partitionBy(*by)
    own = recent.withColumns({"_k": F.row_number().over(order.orderBy("ts")) - 1, "_n": F.count("*").over(order)}).where(F.col("_n") >= least)
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    return own.where((F.col("_k") % step == 0) | (F.col("_k") == F.col("_n") - 1)).select(*by, "ts", "c")


def run_options(rows: DataFrame, slips: dict[str, float], per_year: dict[str, float], fee: float = 5.0, slip: float = 4.0, rows_a_year: float = 8760.0) -> DataFrame:
    """rows with fee_bps, slip_bps and per_year by symbol and tf; what isn't listed has the default."""
    table = lambda d, key, name: rows.sparkSession.createDataFrame(list(d.items()), f"{key} string, {name} double")
    own = rows.join(F.broadcast(table(slips, "symbol", "slip_bps")), "symbol", "left").join(F.broadcast(table(per_year, "tf", "per_year")), "tf", "left")
    return own.withColumns({"fee_bps": F.lit(fee), "slip_bps": F.coalesce("slip_bps", F.lit(slip)), "per_year": F.coalesce("per_year", F.lit(rows_a_year))})


def hold_stream(daily: DataFrame, funding: Column, start: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, ts, ret): always long after row `start`, funding paid; 0 up to there."""
    o = Window.partitionBy(*by).orderBy("ts")
    own = daily.withColumn("_r", F.coalesce(F.col("c") / F.lag("c").over(o) - 1, F.lit(0.0)))
    return own.select(*by, "ts", F.when(F.row_number().over(o) - 1 > start, F.col("_r") - F.coalesce(funding, F.lit(0.0))).otherwise(0.0).alias("ret"))


def payload(bars: DataFrame, overlays: tuple[str, ...], n: int = 800, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """By series its last n points (ts, c, overlays) as one array, oldest first: rows are cut before they are gathered."""
    own = bars.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts")))).where(F.col("_k") <= n)
    return own.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ts", "c", *overlays))).alias("points"))
