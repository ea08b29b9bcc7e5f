"""Metrics, calibration, drift and stability over prediction rows (variant, symbol, trade_date, p, y, baseline_p, next_return)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import rnd
from ..sources.scratch import stored


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def metric_block(p: str = "p", y: str = "y", base: str = "baseline_p") -> list[Column]:
    """n, accuracy (p >= 0.5), Brier, log-loss, mean p, positive rate and the deltas against the baseline."""
    pc, yc, bc = F.col(p), F.col(y).cast("double"), F.col(base)
    brier = lambda q: (q - yc) * (q - yc)
    right = lambda q: ((q >= 0.5) == (yc == 1)).cast("double")
    return [
        F.count("*").alias("n"), rnd(F.avg(right(pc))).alias("accuracy"), rnd(F.avg(brier(pc))).alias("brier"), rnd(F.avg(log_loss(pc, yc))).alias("log_loss"),
        rnd(F.avg(pc)).alias("mean_p"), rnd(F.avg(yc)).alias("positive_rate"), rnd(F.avg(right(pc)) - F.avg(right(bc))).alias("accuracy_delta"),
        rnd(F.avg(brier(pc)) - F.avg(brier(bc))).alias("brier_delta"),
    ]


def metric_tables(preds: DataFrame, *keys: str) -> DataFrame:
    """The metric block for every value of the keys and pooled over each, in one pass; pooled keys are null."""
    return preds.cube(*keys).agg(*metric_block()) if len(keys) == 1 else preds.rollup(*keys).agg(*metric_block())


def binned(preds: DataFrame, bins: int, p: str = "p") -> DataFrame:
    """With column bin: floor(p * bins), the last one closed."""
    return preds.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int"))


def reliability(preds: DataFrame, bins: int, *keys: str) -> DataFrame:
    """n, mean p, observed rate, difference, absolute error and mean return for each bin; empty bins are kept with n = 0."""
    g = binned(preds, bins).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), rnd(F.avg("p")).alias("mean_p"), rnd(F.avg(F.col("y").cast("double"))).alias("rate"),
        rnd(F.avg("p") - F.avg("y")).alias("difference"), rnd(F.abs(F.avg("p") - F.avg("y"))).alias("abs_error"), rnd(F.avg("next_return")).alias("mean_return"),
    )
    every = preds.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) if keys else preds.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(g, [*keys, "bin"], "left").fillna(0, ["n"])


def expected_calibration_error(preds: DataFrame, bins: int, *keys: str) -> DataFrame:
    g = binned(preds, bins).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("e"))
    return g.groupBy(*keys).agg(rnd(F.sum(F.col("n") * F.col("e")) / F.sum("n")).alias("ece"))


def time_slices(preds: DataFrame, time: str = "trade_date", recent_days: int = 730) -> DataFrame:
    """Rows once for each slice they belong to: all, thirds by distinct time, the last days, and years. Ranks are taken on the distinct times."""
    times = preds.select(time).distinct()  # one row a time
    every = Window.partitionBy()  # over one row a time
    third = F.concat(F.lit("third_"), (F.floor((F.row_number().over(Window.orderBy(time)) - 1) * 3 / F.count("*").over(every)) + 1).cast("string"))
    recent = F.when(F.datediff(F.max(time).over(every), F.col(time)) < recent_days, F.lit("recent"))
    names = F.array_compact(F.array(F.lit("all"), third, recent, F.concat(F.lit("year_"), F.year(time).cast("string"))))
    return preds.join(F.broadcast(times.withColumn("names", names)), time).select("*", F.explode("names").alias("slice")).drop("names")


def quintiles(preds: DataFrame, factor: str, edges_from: DataFrame | None = None, k: int = 5) -> DataFrame:
    """With column q (1..k): how many of the interior edges (of ``edges_from``, else the rows themselves) the value reaches."""
    e = exact_quantiles(edges_from if edges_from is not None else preds, factor, [i / k for i in range(1, k)])
    reached = sum((F.col(factor) >= F.col(f"e{i}")).cast("int") for i in range(1, k))
    return preds.crossJoin(F.broadcast(e)).withColumn("q", (reached + 1).cast("int")).drop(*[f"e{i}" for i in range(1, k)])


def cost_sensitivity(preds: DataFrame, cost: float = 0.001) -> DataFrame:
    """For each variant and symbol: long where p >= 0.5; gross, turnover with the first entry, and net after cost."""
    w = Window.partitionBy("variant", "symbol").orderBy("trade_date")
    pos = (F.col("p") >= 0.5).cast("int")
    x = preds.withColumn("pos", pos).withColumn("moved", F.abs(F.col("pos") - F.lag("pos", 1, 0).over(w)))
    g = x.groupBy("variant", "symbol").agg(F.sum(F.col("pos") * F.col("next_return")).alias("gross"), F.sum("moved").alias("turnover"))
    return g.select("variant", "symbol", rnd("gross").alias("gross"), "turnover", rnd(F.col("gross") - cost * F.col("turnover")).alias("net"))


def performance(curve: DataFrame, key: str, order: str, value: str, per_year: int = 252) -> DataFrame:
    """total, volatility, sharpe, max_drawdown and win_rate of equity curves."""
    w = Window.partitionBy(key).orderBy(order)
    x = curve.withColumn("r", F.col(value) / F.lag(value).over(w) - 1).withColumn("peak", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sd = F.stddev_pop("r")
    return x.groupBy(key).agg(
        rnd(F.max_by(value, order) / F.min_by(value, order) - 1).alias("total"), rnd(sd * F.sqrt(F.lit(float(per_year))), 6).alias("volatility"),
        rnd(F.when(sd > 0, F.avg("r") / sd * F.sqrt(F.lit(float(per_year)))), 6).alias("sharpe"), rnd(F.min(F.col(value) / F.col("peak") - 1)).alias("max_drawdown"),
        rnd(F.avg((F.col("r") > 0).cast("double"))).alias("win_rate"),
    )


def performance_full(curve: DataFrame, key: str, order: str, value: str, per_year: int = 252) -> DataFrame:
    """``performance`` with the annualised return, the Calmar ratio and the number of observations; null where they are not defined."""
    w = Window.partitionBy(key).orderBy(order)
    x = curve.withColumn("r", F.col(value) / F.lag(value).over(w) - 1).withColumn("peak", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sd = F.stddev_pop("r")
    g = x.groupBy(key).agg(
        (F.max_by(value, order) / F.min_by(value, order) - 1).alias("total"), (F.count("r") / float(per_year)).alias("years"), sd.alias("sd"), F.avg("r").alias("m"),
        F.min(F.col(value) / F.col("peak") - 1).alias("dd"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win"), F.count("*").alias("observations"),
    )
    annual = F.when((F.col("years") > 0) & (F.col("total") > -1), F.pow(1 + F.col("total"), F.try_divide(F.lit(1.0), F.col("years"))) - 1)
    g = g.withColumn("annual", annual)
    root = F.sqrt(F.lit(float(per_year)))
    return g.select(
        key, rnd("total").alias("total"), rnd("annual", 6).alias("annual"), rnd(F.col("sd") * root, 6).alias("volatility"), rnd(F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * root), 6).alias("sharpe"),
        rnd("dd").alias("max_drawdown"), rnd(F.when(F.col("dd") < 0, F.col("annual") / F.abs("dd")), 6).alias("calmar"), rnd("win").alias("win_rate"), "observations",
    )


def evaluate_oos(preds: DataFrame) -> DataFrame:
    """Accuracy and Brier score of each variant and symbol, with total and drawdown of the curve that holds where p >= 0.5."""
    w = Window.partitionBy("variant", "symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    x = preds.withColumn("equity", F.product(1 + F.when(F.col("p") >= 0.5, F.col("next_return")).otherwise(0.0)).over(w)).withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    y = F.col("y").cast("double")
    return x.groupBy("variant", "symbol").agg(
        rnd(F.avg(((F.col("p") >= 0.5) == (y == 1)).cast("double"))).alias("accuracy"), rnd(F.avg((F.col("p") - y) * (F.col("p") - y))).alias("brier"),
        rnd(F.max_by("equity", "trade_date") - 1, 6).alias("total"), rnd(F.min(F.col("equity") / F.col("peak") - 1), 6).alias("max_drawdown"),
    )


def align(a: DataFrame, b: DataFrame, keys: list[str], by: str = "symbol") -> DataFrame:
    """Whether two models' rows are the same rows with the same outcomes, for each value of ``by``."""
    j = a.select(*keys, F.col("y").alias("ya")).join(b.select(*keys, F.col("y").alias("yb")), keys, "full")
    return j.groupBy(by).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("ya") == F.col("yb"), F.lit(False))).alias("aligned"), F.count_if(F.col("ya").isNull() | F.col("yb").isNull()).alias("unmatched"))


def ranks(df: DataFrame, columns: list[str], ties: list[str]) -> DataFrame:
    """``df`` with r_<column> for each: its place in the order of that column, then of ``ties``.

    Rows are dealt by range, sorted there and written with their range and place (so that they hold for both uses), and counted by range: no task
    holds a whole column, and rows travel once a column."""
    for c in columns:
        dealt = df.repartitionByRange(c, *ties).sortWithinPartitions(c, *ties).withColumn("__id", F.monotonically_increasing_id())  # range x 2^33 + place
        part = stored(dealt, "ranges").withColumns({"__part": F.shiftright("__id", 33), "__nth": F.col("__id").bitwiseAND(F.lit(2**33 - 1)) + 1}).drop("__id")
        counts = part.groupBy("__part").agg(F.count("*").alias("__n"))
        before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
        df = part.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(f"r_{c}", F.col("__nth") + F.col("__before")).drop("__part", "__nth", "__before")
    return df


def exact_quantiles(df: DataFrame, column: str, at: list[float], prefix: str = "e") -> DataFrame:
    """One row of linear quantiles e1, e2, ... of a whole column (``whole_quantiles`` of one column)."""
    found = whole_quantiles(df, [column], at)[column]
    return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{prefix}{i} double" for i in range(1, len(at) + 1)))


def whole_quantiles(df: DataFrame, columns: list[str], at: list[float], accuracy: int = 20000) -> dict[str, list[float | None]]:
    """The exact linear quantiles of whole columns; None for a column without values.

    Sketches bracket each quantile, one pass counts what lies below a bracket and the distinct values inside (about 4 / accuracy of the rows), and
    the two ranks beside a quantile are read from their running counts. Should a sketch miss, its bracket is widened and that column counted
    again; whole columns are neither shuffled nor gathered. Rows are read twice: store what is dear to compute."""
    out: dict[str, list[float | None]] = {}
    todo, eps = list(columns), 2 / accuracy
    while todo:
        shares = [s for q in at for s in (max(q - eps, 0.0), min(q + eps, 1.0))]
        x = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(todo)])
        one = x.agg(*[f(f"c{k}").alias(f"{n}{k}") for k in range(len(todo)) for n, f in (("n", F.count), ("e", lambda c: F.percentile_approx(c, shares, accuracy)))]).first()
        wanted = []  # column, quantile, bracket, first rank, second rank, fraction
        for k, c in enumerate(todo):
            out[c] = [None] * len(at)
            for i, q in enumerate(at if one[f"n{k}"] else ()):
                place = (one[f"n{k}"] - 1) * float(q)
                low = int(place // 1)
                lo = float("-inf") if shares[2 * i] == 0 else one[f"e{k}"][2 * i]
                hi = float("nan") if shares[2 * i + 1] == 1 else one[f"e{k}"][2 * i + 1]  # not a number is the largest value
                wanted.append((k, i, lo, hi, low + 1, min(low + 2, one[f"n{k}"]), place - low))
        if not wanted:
            break
        hits = F.array_compact(F.array(*[F.when(F.col(f"c{k}") <= F.lit(hi), F.struct(F.lit(j).alias("j"), F.when(F.col(f"c{k}") >= F.lit(lo), F.col(f"c{k}")).alias("v"))) for j, (k, _, lo, hi, *_) in enumerate(wanted)]))
        counts = x.select(F.inline(hits)).groupBy("j", "v").agg(F.count("*").alias("n"))  # v is null below the bracket
        run = F.sum("n").over(Window.partitionBy("j").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("upto", run)
        ends = F.broadcast(df.sparkSession.createDataFrame([(j, *w[4:6]) for j, w in enumerate(wanted)], "j int, a long, b long"))
        beside = lambda r: F.max(F.when((F.col("upto") >= F.col(r)) & (F.col("upto") - F.col("n") < F.col(r)), F.struct(F.col("v").alias("v"))))
        got = {r["j"]: r for r in counts.join(ends, "j").groupBy("j").agg(beside("a").alias("a"), beside("b").alias("b")).collect()}
        missed = set()
        for j, (k, i, *_, f) in enumerate(wanted):
            a, b = (got[j][s]["v"] if j in got and got[j][s] else None for s in ("a", "b"))
            if a is None or b is None:
                missed.add(todo[k])
            else:
                out[todo[k]][i] = a + (b - a) * f
        todo, eps = [c for c in todo if c in missed], eps * 10
    return out


def redundancy(df: DataFrame, factors: list[str], ties: list[str], close: float = 0.85) -> DataFrame:
    """Pearson and Spearman correlation of every pair of factors, and whether the pair falls into one cluster."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    r = ranks(stored(df.select(*factors, *ties), "factors"), factors, ties)  # the ranges are sampled first: what they read is computed once
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("pearson"), F.corr(f"r_{a}", f"r_{b}").alias("spearman")) for a, b in pairs]
    x = r.agg(F.array(*each).alias("e")).select(F.inline("e"))
    return x.select("a", "b", rnd("pearson", 6).alias("pearson"), rnd("spearman", 6).alias("spearman"), (F.abs("pearson") >= close).alias("cluster_pair"))


def mean_shift(ref: DataFrame, now: DataFrame, column: str, alarm: float = 2.0) -> DataFrame:
    """Absolute shift of the mean in population deviations of the reference."""
    a = ref.agg(F.avg(column).alias("m0"), F.stddev_pop(column).alias("s0"))
    b = now.agg(F.avg(column).alias("m1"))
    shift = F.when(F.col("s0") > 0, F.abs(F.col("m1") - F.col("m0")) / F.col("s0")).otherwise(0.0)
    return a.crossJoin(b).select(rnd(shift, 6).alias("shift"), (shift >= alarm).alias("alarm"))


def population_stability(ref: DataFrame, now: DataFrame, column: str, bins: int = 10, floor: float = 1e-6, alarm: float = 0.2) -> DataFrame:
    """Index over equal-width bins of the reference range, right-closed; values outside go to the end bins."""
    edges = F.broadcast(ref.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    place = F.coalesce(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))  # a constant reference has one bin
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(place * bins))).cast("int")
    side = lambda df, name: df.crossJoin(edges).groupBy(b.alias("bin")).agg(F.count("*").alias(name))
    every = ref.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    x = every.join(side(ref, "a"), "bin", "left").join(side(now, "b"), "bin", "left").fillna(0, ["a", "b"])
    whole = x.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    x = x.crossJoin(F.broadcast(whole)).select(F.greatest(F.col("a") / F.col("ta"), F.lit(floor)).alias("pa"), F.greatest(F.col("b") / F.col("tb"), F.lit(floor)).alias("pb"))
    return x.agg(rnd(F.sum((F.col("pb") - F.col("pa")) * F.ln(F.col("pb") / F.col("pa"))), 6).alias("psi")).withColumn("alarm", F.col("psi") >= alarm)


def winsorize(df: DataFrame, column: str, by: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Clipped to the group's linearly interpolated quantiles, as column ``w``."""
    q = df.groupBy(*by).agg(F.percentile(column, F.lit(lo)).alias("__lo"), F.percentile(column, F.lit(hi)).alias("__hi"))
    return df.join(q, by).withColumn("w", F.least(F.greatest(F.col(column), F.col("__lo")), F.col("__hi"))).drop("__lo", "__hi")


def zscore(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(x - mean) / population deviation within the group, 0 where that is 0, as column ``z``."""
    q = df.groupBy(*by).agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return df.join(q, by).withColumn("z", F.when(F.col("__s") > 1e-12, (F.col(column) - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair; 0 where a side is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rnd(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])))


def decorrelate(df: DataFrame, columns: list[str], most: float = 0.9) -> list[str]:
    """Columns kept in the given order: each correlates below ``most`` with all kept before it."""
    r = {(x["a"], x["b"]): abs(x["r"]) for x in correlations(df, columns).collect()}
    kept: list[str] = []
    for c in columns:
        if all(r.get((k, c), 0.0) < most for k in kept):
            kept.append(c)
    return kept


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, missing, mean, sd, min, q25, median, q75, max of each column; quantiles by ranges, so no task holds a column."""
    df = stored(df.select(*columns), "profile")  # read once a column
    out = None
    found = whole_quantiles(df, columns, [0.25, 0.5, 0.75])
    for c in columns:
        one = df.agg(F.lit(c).alias("name"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), rnd(F.avg(c)).alias("mean"), rnd(F.stddev_pop(c), 6).alias("sd"), rnd(F.min(c)).alias("least"), rnd(F.max(c)).alias("most"))
        one = one.select("*", *[rnd(F.lit(v).cast("double")).alias(n) for n, v in zip(("q25", "median", "q75"), found[c])])
        out = one if out is None else out.unionByName(one)
    return out


def bucket_report(df: DataFrame, column: str, label: str, k: int, by: str) -> DataFrame:
    """Within each group sorted by the column, k slices from b * n // k: n, mean and positive rate."""
    w = Window.partitionBy(by).orderBy(column, "trade_date")
    x = df.withColumn("i", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(Window.partitionBy(by)))
    b = F.floor((F.col("i") * k + k - 1) / F.col("m"))  # the b with floor(b m / k) <= i < floor((b + 1) m / k)
    return x.withColumn("b", F.least(b, F.lit(k - 1)).cast("int")).groupBy(by, "b").agg(F.count("*").alias("n"), rnd(F.avg(column)).alias("mean"), rnd(F.avg(label)).alias("rate"))


def normalize_frame(df: DataFrame, columns: list[str], by: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Columns cut at their quantiles within each group, then in population deviations from its mean; 0 where they are constant."""
    w = Window.partitionBy(*by)
    for c in columns:
        df = df.withColumn("__lo", F.percentile(c, F.lit(lo)).over(w)).withColumn("__hi", F.percentile(c, F.lit(hi)).over(w)).withColumn(c, F.least(F.greatest(c, "__lo"), F.col("__hi")))
        sd = F.stddev_pop(c).over(w)
        df = df.withColumn(c, F.when(sd > 1e-12, (F.col(c) - F.avg(c).over(w)) / sd).otherwise(0.0)).drop("__lo", "__hi")
    return df


def train_scaler(train: DataFrame, test: DataFrame, columns: list[str], by: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """``test`` with its columns cut at the bounds and scaled by the mean and deviation that ``train`` gives, group by group; groups without training rows go."""
    ends = train.groupBy(*by).agg(*[F.percentile(c, F.lit(q)).alias(f"__{n}_{c}") for c in columns for n, q in (("lo", lo), ("hi", hi))])
    cut = lambda df: df.join(ends, by).withColumns({c: F.least(F.greatest(F.col(c), F.col(f"__lo_{c}")), F.col(f"__hi_{c}")) for c in columns})
    fit = cut(train).groupBy(*by).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    x = cut(test).join(fit, by)
    x = x.withColumns({c: F.when(F.col(f"__sd_{c}") > 0, (F.col(c) - F.col(f"__mu_{c}")) / F.col(f"__sd_{c}")).otherwise(0.0) for c in columns})
    return x.drop(*[f"__{n}_{c}" for c in columns for n in ("lo", "hi", "mu", "sd")])


def correlation_clusters(df: DataFrame, columns: list[str], close: float = 0.85) -> DataFrame:
    """cluster and members: each column not yet in a group opens one with all columns at least ``close`` in absolute correlation. Only the matrix reaches the driver."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.abs(F.corr(a, b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
    near = {p: row[f"c{k}"] for k, p in enumerate(pairs)}
    groups, seen = [], set()
    for a in columns:
        if a not in seen:
            own = [b for b in columns if a == b or (near[a, b] or 0.0) >= close]
            seen.update(own)
            groups.append((len(groups), own))
    return df.sparkSession.createDataFrame(groups, "cluster int, members array<string>")
