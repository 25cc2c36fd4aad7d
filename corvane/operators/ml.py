"""Training panels, walk-forward ridge and logistic models, information coefficients, validation and explanation."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.perf import correlation
from corvane.functions.xs import by_name, pct_rank, places
from corvane.sources import registry as trials
from corvane.work import cut

# fixed values: feature, family, expected sign of the composites, then fields of the raw ranks and their families
FEATURES = [("value", "value", 1), ("quality", "quality", 1), ("growth", "growth", 1), ("garp", "growth", 1), ("discipline", "discipline", 1), ("momentum", "momentum", 1), ("low_vol", "risk", 1), ("size", "risk", 1), ("factor", "momentum", 0), ("macro_tilt", "macro", 0), ("macro_fit", "macro", 0), ("analyst", "analyst_proxy", 0)]
RAW = [("pe", "value"), ("pb", "value"), ("ev_ebit", "value"), ("fcf_yield", "value"), ("roe", "quality"), ("roic", "quality"), ("gross_margin", "quality"), ("earnings_vol", "risk"), ("debt_equity", "risk"), ("interest_coverage", "risk"), ("revenue_growth", "growth"), ("eps_growth", "growth"), ("growth_stability", "growth"), ("accruals", "discipline"), ("net_issuance", "issuance"), ("asset_growth", "discipline")]
BASE = [f for f, _, _ in FEATURES]
EXTENDED = BASE + [f"f_{c}" for c, _ in RAW]


def registry(spark) -> DataFrame:
    """M5: every feature with family, expected sign (0: none), source, age its input may have, history it needs, and
    whether it stands in for data that aren't there."""
    rows = [(f, fam, s, "derived", 45 if fam in ("value", "quality", "growth", "discipline") else 0, 252 if fam in ("momentum", "risk") else 0, fam == "analyst_proxy") for f, fam, s in FEATURES]
    rows += [(f"f_{c}", fam, 1, "sec", 45, 365, False) for c, fam in RAW]
    return spark.createDataFrame(rows, "feature string, family string, sign int, source string, lag_days int, min_history_days int, is_proxy boolean")


def labels(prices: DataFrame, horizon: int = 126) -> DataFrame:
    """M2: forward return over calendar rows, its excess over the date's mean and whether it beats the median."""
    w = Window.partitionBy("ticker").orderBy("date")
    df = prices.withColumn("fwd_return", F.lead("close", horizon).over(w) / F.col("close") - 1).where(F.col("fwd_return").isNotNull())
    return df.select(F.col("date").alias("as_of"), "ticker", "fwd_return")


def label_figures(rows: DataFrame) -> DataFrame:
    """Of the known forward returns of each date (as_of, fwd_return): their number, mean and median, a row a date."""
    def run(group: pa.Table) -> pa.Table:
        x = group.column("fwd_return").to_numpy()
        return pa.table({"as_of": group.column("as_of")[:1], "__n": [len(x)], "__mean": [float(x.mean())], "__mid": [float(np.median(x))]})

    known = rows.where("fwd_return is not null").select("as_of", F.col("fwd_return").cast("double"))
    return known.groupBy("as_of").applyInArrow(run, f"as_of {dict(rows.dtypes)['as_of']}, __n long, __mean double, __mid double")


def training_panel(features: DataFrame, figures: DataFrame, names: list[str], least: int = 5) -> DataFrame:
    """M3, M4: features with neutral 50 for missing ones and their forward return, its excess over the date's mean and
    whether it beats the median (see label_figures, of the same rows); dates of fewer than `least` names go. For a
    point-in-time panel the features come from eligible members alone, see panel.eligible."""
    df = features.where("fwd_return is not null").join(F.broadcast(figures.where(F.col("__n") >= least)), "as_of")  # a row a date
    df = df.fillna(50.0, subset=names)
    return df.withColumns({"fwd_excess": F.col("fwd_return") - F.col("__mean"), "outperform": (F.col("fwd_return") > F.col("__mid")).cast("int")}).drop("__n", "__mean", "__mid")


def holdout_split(panel: DataFrame, share: float = 0.15) -> DataFrame:
    """M6: adds `part`: holdout for the last round(n * share) dates, one at least."""
    dates = panel.select("as_of").distinct()
    k = F.row_number().over(Window.orderBy(F.desc("as_of")))
    n = dates.count()
    dates = dates.withColumn("part", F.when(k <= max(1, round(n * share)), "holdout").otherwise("research"))
    return panel.join(dates, "as_of")


def gram(panel: DataFrame, names: list[str], target: str = "fwd_excess") -> DataFrame:
    """Sums of each date from which every expanding fold's ridge follows: n, x, xx', y, xy, as one array. A task adds up
    products of whole batches, a row for each of its dates is all that leaves it; nulls count as 0."""
    k = len(names)
    upper = np.triu_indices(k)
    types = dict(panel.dtypes)

    def partly(batches):
        sums: dict = {}
        for b in batches:
            z = np.stack([np.ones(b.num_rows)] + [pa.compute.fill_null(b.column(c), 0.0).to_numpy(zero_copy_only=False) for c in (*names, target)], axis=1)
            dates = b.column("as_of").dictionary_encode()
            which = dates.indices.to_numpy()
            order = np.argsort(which, kind="stable")
            edges = np.searchsorted(which[order], np.arange(len(dates.dictionary) + 1))
            z = z[order]
            for day, i, j in zip(dates.dictionary.to_pylist(), edges, edges[1:], strict=False):
                sums[day] = sums.get(day, 0.0) + z[i:j].T @ z[i:j]
        if sums:
            rows = [np.concatenate([m[0, : k + 1], m[1 : k + 1, 1 : k + 1][upper], m[0, k + 1 :], m[1 : k + 1, k + 1]]).tolist() for m in sums.values()]
            yield pa.RecordBatch.from_pydict({"as_of": pa.array(list(sums), type=dates.type.value_type), "sums": pa.array(rows, type=pa.list_(pa.float64()))})

    n = 2 + 2 * k + k * (k + 1) // 2
    some = panel.select("as_of", *[F.col(c).cast("double") for c in (*names, target)]).where("as_of is not null").mapInArrow(partly, f"as_of {types['as_of']}, sums array<double>")
    return some.groupBy("as_of").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(n)]).alias("sums"))


def _ridge(s: np.ndarray, k: int, alpha: float):
    n, x = s[0], s[1 : 1 + k]
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = s[1 + k : 1 + k + k * (k + 1) // 2]
    xx = xx + np.triu(xx, 1).T
    y, xy = s[-k - 1], s[-k:]
    mean = x / n
    sd = np.sqrt(np.maximum(np.diag(xx) / n - mean**2, 0))
    sd[sd < 1e-12] = 1.0
    c = (xx - n * np.outer(mean, mean)) / np.outer(sd, sd)
    w = np.linalg.solve(c + alpha * np.eye(k), (xy - y * mean) / sd)
    return w, y / n, mean, sd


def walk_forward(panel: DataFrame, names: list[str], target: str = "fwd_excess", alpha: float = 10.0, min_train: int = 12, blocks: int = 5, purge: int = 1, sums: DataFrame | None = None) -> DataFrame:
    """Coefficients of every fold: fold, first, last (its test dates), coef, mean, sd, intercept, n_train.
    sums: those of gram(), where they are there already.

    Dates after the first min_train are tested in `blocks` runs; a fold trains on the dates before the purged gap. One
    pass over the panel sums each date, the folds are sums of those sums: rows a date, solved in one small group."""
    k = len(names)
    schema = "fold int, first date, last date, intercept double, n_train long, coef array<double>, mean array<double>, sd array<double>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("as_of").reset_index(drop=True)
        total, n = np.cumsum(np.stack(pdf["sums"].to_list()), axis=0), len(pdf)
        size = max(1, math.ceil((n - min_train) / blocks))
        rows = []
        for f, b in enumerate(range(min_train, n, size) if n > min_train + 1 else ()):
            cut = b - purge - 1
            if cut < 0 or total[cut][0] < 30:
                continue
            w, icept, mean, sd = _ridge(total[cut], k, alpha)
            rows.append((f, pdf.as_of[b], pdf.as_of[min(b + size, n) - 1], float(icept), int(total[cut][0]), w.tolist(), mean.tolist(), sd.tolist()))
        return pd.DataFrame(rows, columns=["fold", "first", "last", "intercept", "n_train", "coef", "mean", "sd"])

    return (gram(panel, names, target) if sums is None else sums).groupBy(F.lit(1).alias("one")).applyInPandas(solve, schema)


def final_fit(panel: DataFrame, names: list[str], target: str = "fwd_excess", alpha: float = 10.0, sums: DataFrame | None = None) -> DataFrame:
    """One row of a feature for the model of all dates."""
    k = len(names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w, icept, mean, sd = _ridge(np.sum(np.stack(pdf["sums"].to_list()), axis=0), k, alpha)
        return pd.DataFrame({"feature": names, "coef": w, "mean": mean, "sd": sd, "intercept": icept})

    return (gram(panel, names, target) if sums is None else sums).groupBy(F.lit(1).alias("one")).applyInPandas(solve, "feature string, coef double, mean double, sd double, intercept double")


def predict_folds(panel: DataFrame, folds: DataFrame, names: list[str]) -> DataFrame:
    """Out-of-sample predictions."""
    j = _tested(panel, folds)
    return j.select("fold", "as_of", "ticker", "fwd_return", "fwd_excess", "outperform", sum((F.col(c) * F.col("__w")[i] for i, c in enumerate(names)), F.col("__b")).alias("pred"))


def _tested(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of the folds' test dates with the fold's weights of plain features, __w, and what is added to them, __b."""
    w = F.zip_with("coef", "sd", lambda c, s: c / s)
    b = F.col("intercept") - F.aggregate(F.zip_with(w, "mean", lambda x, m: x * m), F.lit(0.0), lambda a, v: a + v)
    own = folds.select("fold", "first", "last", w.alias("__w"), b.alias("__b"))
    return panel.join(F.broadcast(own), F.col("as_of").between(F.col("first"), F.col("last")))  # as many rows as blocks


def _wide(model: DataFrame, names: list[str]) -> DataFrame:
    """The model's feature rows as one row: __coef, __mean, __sd in the order of names, null for one it doesn't have."""
    of = lambda n, c: F.max(F.when(F.col("feature") == n, F.col(c)))
    return model.agg(*[F.array(*[of(n, c) for n in names]).alias(f"__{c}") for c in ("coef", "mean", "sd")], F.max("intercept").alias("__intercept"))


def predict(features: DataFrame, model: DataFrame, names: list[str], logistic: bool = False) -> DataFrame:
    """Raw score and its rank, from the model's feature rows."""
    j = features.fillna(50.0, subset=names).crossJoin(F.broadcast(_wide(model, names)))  # an aggregate: one row
    term = [F.coalesce((F.col(c) - F.col("__mean")[i]) / F.col("__sd")[i] * F.col("__coef")[i], F.lit(0.0)) for i, c in enumerate(names)]
    raw = j.select("as_of", "ticker", (sum(term, F.lit(0.0)) + F.col("__intercept")).alias("raw"))
    raw = raw.withColumn("raw", 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("raw")))))) if logistic else raw
    return raw.withColumn("ml_alpha", pct_rank(F.col("raw"), "as_of"))


def logistic_fit(panel: DataFrame, names: list[str], l2: float = 1.0) -> DataFrame:
    """M9 by spark.ml's optimizer, on standardised features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = panel.agg(*[f(c).alias(f"{p}{c}") for c in names for p, f in (("m_", F.avg), ("s_", F.stddev_pop))], F.count("*").alias("n")).first()
    sd = {c: stats[f"s_{c}"] or 1.0 for c in names}
    z = panel.select(F.col("outperform").cast("double").alias("label"), *[((F.col(c) - stats[f"m_{c}"]) / sd[c]).alias(c) for c in names])
    fit = LogisticRegression(regParam=l2 / max(stats.n, 1), standardization=False, maxIter=200, tol=1e-10).fit(VectorAssembler(inputCols=names, outputCol="features").transform(z))
    return panel.sparkSession.createDataFrame([(c, float(w), float(stats[f"m_{c}"]), float(sd[c]), float(fit.intercept)) for c, w in zip(names, fit.coefficients, strict=True)], "feature string, coef double, mean double, sd double, intercept double")


def fold_dates(panel: DataFrame, min_train: int = 12, blocks: int = 5, purge: int = 1) -> DataFrame:
    """Fold, first, last (test dates) and cutoff: a fold trains on the dates before its cutoff. As walk_forward."""
    days = panel.select("as_of").distinct().withColumn("i", F.row_number().over(Window.orderBy("as_of")) - 1)  # one row a date
    n = days.count()
    size = max(1, math.ceil((n - min_train) / blocks))
    starts = list(range(min_train, n, size)) if n > min_train + 1 else []
    spark = panel.sparkSession
    marks = spark.createDataFrame([(f, b, min(b + size, n) - 1, max(b - purge, 0)) for f, b in enumerate(starts)], "fold int, b int, e int, c int")
    at = lambda x, name: days.select(F.col("i").alias(x), F.col("as_of").alias(name))
    return marks.join(at("b", "first"), "b").join(at("e", "last"), "e").join(at("c", "cutoff"), "c").select("fold", "first", "last", "cutoff")


def logistic_walk_forward(panel: DataFrame, names: list[str], target: str = "outperform", l2: float = 1.0, min_train: int = 12, blocks: int = 5, purge: int = 1, rounds: int = 25, least: int = 30) -> DataFrame:
    """M9, M10 for the classification task, in the form of walk_forward: each fold's logistic regression on features
    standardised by its own training rows, with a penalty of l2 / 2 on the squared coefficients and none on the intercept.

    Iteratively reweighted least squares: an iteration is one grouped pass for all folds at once, whose weighted sums of
    products are added up where the rows are; the few coefficients are solved here. Folds with under `least` training
    rows, or whose rows have one label alone, fall out."""
    k = len(names)
    folds = {r.fold: r for r in fold_dates(panel, min_train, blocks, purge).collect()}  # as many rows as blocks
    spark = panel.sparkSession
    schema = "fold int, first date, last date, intercept double, n_train long, coef array<double>, mean array<double>, sd array<double>"
    if not folds:
        return spark.createDataFrame([], schema)
    few = spark.createDataFrame([(f, r.cutoff) for f, r in folds.items()], "fold int, cutoff date")
    rows = panel.join(F.broadcast(few), F.col("as_of") < F.col("cutoff")).select("fold", F.col(target).cast("double").alias("__y"), *names)
    stats = rows.groupBy("fold").agg(F.count("*").alias("n"), F.avg("__y").alias("share"), F.array(*[F.avg(c) for c in names]).alias("mean"), F.array(*[F.stddev_pop(c) for c in names]).alias("sd"))
    stats = {r.fold: r for r in stats.collect() if r.n >= least and 0 < r.share < 1}
    if not stats:
        return spark.createDataFrame([], schema)
    mean = {f: np.array(r["mean"]) for f, r in stats.items()}
    sd = {f: np.where(np.array(r["sd"]) < 1e-12, 1.0, np.array(r["sd"])) for f, r in stats.items()}
    beta, still = {f: np.zeros(k + 1) for f in stats}, set(stats)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    for _ in range(rounds):
        now = spark.createDataFrame([(f, beta[f].tolist(), mean[f].tolist(), sd[f].tolist()) for f in sorted(still)], "fold int, __b array<double>, __m array<double>, __s array<double>")
        x = [F.lit(1.0).alias("__x0")] + [((F.col(c) - F.col("__m")[i]) / F.col("__s")[i]).alias(f"__x{i + 1}") for i, c in enumerate(names)]
        z = rows.join(F.broadcast(now), "fold").select("fold", "__y", "__b", *x)
        z = z.withColumn("__p", 1 / (1 + F.exp(-sum((F.col(f"__x{i}") * F.col("__b")[i] for i in range(k + 1)), F.lit(0.0)))))
        z = z.withColumn("__w", F.col("__p") * (1 - F.col("__p"))).withColumn("__r", F.col("__y") - F.col("__p"))
        sums = z.groupBy("fold").agg(F.array(*[F.sum(F.col("__w") * F.col(f"__x{i}") * F.col(f"__x{j}")) for i, j in pairs]).alias("h"), F.array(*[F.sum(F.col("__r") * F.col(f"__x{i}")) for i in range(k + 1)]).alias("g"))
        for r in sums.collect():  # a row of a fold
            h = np.zeros((k + 1, k + 1))
            for v, (i, j) in zip(r.h, pairs, strict=True):
                h[i, j] = h[j, i] = v
            ridge = l2 * np.diag([0.0, *[1.0] * k])
            step = np.linalg.solve(h + ridge, np.array(r.g) - ridge @ beta[r.fold])
            beta[r.fold] = beta[r.fold] + step
            if np.abs(step).max() < 1e-10:
                still.discard(r.fold)
        if not still:
            break
    out = [(f, folds[f].first, folds[f].last, float(beta[f][0]), int(stats[f].n), beta[f][1:].tolist(), mean[f].tolist(), sd[f].tolist()) for f in sorted(stats)]
    return spark.createDataFrame(out, schema)


def classify_folds(panel: DataFrame, folds: DataFrame, names: list[str]) -> DataFrame:
    """Out-of-sample probabilities of logistic_walk_forward's folds, as `pred`."""
    return predict_folds(panel, folds, names).withColumn("pred", 1 / (1 + F.exp(-F.col("pred"))))


def accuracy(oos: DataFrame) -> DataFrame:
    """Share of probabilities on the side of their label, and the number of rows."""
    return oos.agg(F.avg(((F.col("pred") >= 0.5).cast("int") == F.col("outperform")).cast("double")).alias("oos_accuracy"), F.count("*").alias("n"))


def rolling_folds(panel: DataFrame, names: list[str], target: str = "fwd_excess", alpha: float = 10.0, every: int = 6, lookback_days: int | None = None, first: int = 12, purge: int = 7, least: int = 30) -> DataFrame:
    """A ridge model refitted at every `every`-th date from the `first`-th on, in the form of walk_forward; it
    scores the dates up to the next refit. It trains on the dates at least `purge` before it and, with lookback_days, not
    older than these. One pass sums each date; a window's sums are differences of running sums, so a refit costs no more
    than its solution. Refits with under `least` rows are left out: the model before scores their dates too."""
    k = len(names)
    schema = "fold int, first date, last date, intercept double, n_train long, coef array<double>, mean array<double>, sd array<double>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("as_of").reset_index(drop=True)
        total, days, rows = np.cumsum(np.stack(pdf["sums"].to_list()), axis=0), pd.to_datetime(pdf.as_of), []
        for b in range(first, len(pdf), every):
            end = b - purge - 1
            start = -1 if lookback_days is None else int((days < days[b] - pd.Timedelta(days=lookback_days)).sum()) - 1
            if end <= start:
                continue
            sums = total[end] - (total[start] if start >= 0 else 0)
            if sums[0] < least:
                continue
            w, icept, mean, sd = _ridge(sums, k, alpha)
            rows.append([len(rows), pdf.as_of[b], pdf.as_of.iloc[-1], float(icept), int(round(sums[0])), w.tolist(), mean.tolist(), sd.tolist()])
        for a, z in zip(rows, rows[1:], strict=False):
            a[2] = max(d for d in pdf.as_of if d < z[1])
        return pd.DataFrame(rows, columns=["fold", "first", "last", "intercept", "n_train", "coef", "mean", "sd"])

    return gram(panel, names, target).groupBy(F.lit(1).alias("one")).applyInPandas(solve, schema)


def _ic(a: np.ndarray, b: np.ndarray) -> float | None:
    """The correlation of two columns' ranks; None under three rows, or where either doesn't vary."""
    if len(a) < 3:
        return None
    x, y = (places(v, True) for v in (a, b))
    x, y = x - x.mean(), y - y.mean()
    both = math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))
    return float(x @ y) / both if both > 0 else None


def ic_by_date(df: DataFrame, score: str, target: str = "fwd_return", keys: list[str] = ()) -> DataFrame:
    """Rank correlation of each date; null under three rows. Both columns of a date move and are ranked once."""
    own = ["as_of", *keys]
    both = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    both = both.select(*own, *[F.col(c).cast("double").alias(n) for c, n in ((score, "__a"), (target, "__b"))])

    def run(group: pa.Table) -> pa.Table:
        a, b = (group.column(c).to_numpy() for c in ("__a", "__b"))
        return pa.table({**{c: group.column(c)[:1] for c in own}, "ic": pa.array([_ic(a, b)], pa.float64()), "n": pa.array([len(a)], pa.int64())})

    return both.groupBy(*own).applyInArrow(run, ", ".join(f"{c} {t}" for c, t in both.dtypes[: len(own)]) + ", ic double, n long")


def ic_summary(ics: DataFrame, keys: list[str] = (), lags: int = 0) -> DataFrame:
    """Mean, deviation, ratio, t, hit rate, and Newey and West's t with a Bartlett kernel."""
    keys = list(keys)
    x = ics.where(F.col("ic").isNotNull() & ~F.isnan("ic"))
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    w = whole.orderBy("as_of")
    x = x.withColumn("__d", F.col("ic") - F.avg("ic").over(whole))
    for k in range(1, lags + 1):
        x = x.withColumn(f"__d{k}", F.col("__d") * F.lag("__d", k).over(w))
    n = F.count("ic")
    lrv = F.sum(F.col("__d") ** 2) / n
    for k in range(1, lags + 1):
        lrv = lrv + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__d{k}"), F.lit(0.0)) / n
    mean, sd = F.avg("ic"), F.stddev_samp("ic")
    return x.groupBy(*keys).agg(mean.alias("mean_ic"), sd.alias("std_ic"), F.try_divide(mean, sd).alias("ir"), (F.try_divide(mean, sd) * F.sqrt(n)).alias("t"), F.avg((F.round("ic", 10) > 0).cast("double")).alias("hit_rate"), n.alias("n_dates"), F.when(lrv > 0, F.try_divide(mean, F.sqrt(F.greatest(lrv, F.lit(0.0)) / n))).alias("t_nw"), (n / (lags + 1)).alias("n_effective"))


def sidak(summary: DataFrame, trials: int, t: str = "t_nw") -> DataFrame:
    """P-values for the best of `trials` variants and the t they amount to; on a table of a few rows."""

    @F.pandas_udf("struct<p_adj: double, t_adj: double>")
    def adjust(ts: pd.Series) -> pd.DataFrame:
        rows = []
        for v in ts:
            if v is None or math.isnan(v):
                rows.append((None, None))
                continue
            p = 1 - (1 - math.erfc(abs(v) / math.sqrt(2))) ** trials
            low, high = 0.0, 40.0
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) > p else (low, mid)
            rows.append((p, math.copysign(low, v)))
        return pd.DataFrame(rows, columns=["p_adj", "t_adj"])

    return summary.withColumn("__a", adjust(F.col(t))).select("*", "__a.p_adj", "__a.t_adj").drop("__a")


def confidence(summary: DataFrame) -> DataFrame:
    """How far the one row of summary (t_adj, mean_ic), see sidak, supports scores: one row, 0 to 1."""
    sure = F.when(F.coalesce(F.col("mean_ic") > 0, F.lit(False)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t_adj") - 1) / 2))).otherwise(0.0)
    return summary.agg(F.coalesce(F.max(sure), F.lit(0.0)).alias("confidence"))


def evidence_gate(scores: DataFrame, summary: DataFrame) -> DataFrame:
    """Scores drawn to 50 as far as the one row of summary (t_adj, mean_ic), see sidak, doesn't support them."""
    return scores.crossJoin(F.broadcast(confidence(summary))).withColumn("gated", 50 + F.col("confidence") * (F.col("ml_alpha") - 50))  # an aggregate: one row


def fit_quality(oos: DataFrame) -> DataFrame:
    """M14."""
    m = oos.crossJoin(F.broadcast(oos.agg(F.avg("fwd_excess").alias("__m"))))  # an aggregate: one row
    return m.agg((1 - F.sum((F.col("fwd_excess") - F.col("pred")) ** 2) / F.sum((F.col("fwd_excess") - F.col("__m")) ** 2)).alias("r2"), F.avg(((F.col("pred") > 0).cast("int") == F.col("outperform")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def explained(features: DataFrame, model: DataFrame, reg: DataFrame, names: list[str]) -> DataFrame:
    """M21, a row a name and date: parts (feature, family, raw_value, z_value, contribution of each), intercept, total and
    rank_in_universe; names with a null feature are left out. Parts lie in their row, so only totals are ordered."""
    families = {r.feature: r.family for r in reg.select("feature", "family").collect()}  # a row a feature
    j = features.dropna(subset=names).crossJoin(F.broadcast(_wide(model, names)))  # an aggregate: one row
    z = {c: (F.col(c) - F.col("__mean")[i]) / F.col("__sd")[i] for i, c in enumerate(names)}
    part = [F.when(F.col("__coef")[i].isNotNull(), F.struct(F.lit(c).alias("feature"), F.lit(families[c]).alias("family"), F.col(c).cast("double").alias("raw_value"), z[c].alias("z_value"), (z[c] * F.col("__coef")[i]).alias("contribution"))) for i, c in enumerate(names) if c in families]
    j = j.select("as_of", "ticker", F.col("__intercept").alias("intercept"), F.filter(F.array(*part), lambda p: p.isNotNull()).alias("parts"))
    j = j.withColumn("total", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["contribution"]) + F.col("intercept"))
    return j.withColumn("rank_in_universe", F.rank().over(Window.partitionBy("as_of").orderBy(F.desc(F.round("total", 10)))))


def contributions(features: DataFrame, model: DataFrame, reg: DataFrame, names: list[str]) -> DataFrame:
    """Coef * z of each feature, a row a feature, see explained."""
    long = explained(features, model, reg, names).withColumn("p", F.explode("parts"))
    return long.select("as_of", "ticker", "p.feature", "p.family", "p.raw_value", "p.z_value", "p.contribution", "intercept", "total", "rank_in_universe")


def family_rollup(local: DataFrame, families: list[str]) -> DataFrame:
    """M22."""
    return local.groupBy("as_of", "ticker", "intercept", "total").pivot("family", families).agg(F.sum("contribution"))


def top_contributors(local: DataFrame, n: int = 3, positive: bool | None = None) -> DataFrame:
    """M23."""
    rows = local if positive is None else local.where(F.col("contribution") > 0 if positive else F.col("contribution") < 0)
    place = F.row_number().over(Window.partitionBy("as_of", "ticker").orderBy(F.round(F.abs("contribution"), 10).desc(), "feature"))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def coefficient_stability(folds: DataFrame, model: DataFrame, names: list[str]) -> DataFrame:
    """M24."""
    each = folds.select("fold", F.posexplode("coef").alias("i", "c")).withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1))
    j = each.join(model.select("feature", "coef"), "feature")
    return j.groupBy("feature").agg(F.avg("c").alias("mean_coef"), F.stddev_pop("c").alias("std_coef"), F.avg((F.signum("c") == F.signum("coef")).cast("double")).alias("sign_share"), F.first("coef").alias("coef"))


def permutation_importance(panel: DataFrame, folds: DataFrame, names: list[str], groups: dict[str, list[str]], repeats: int = 3, seed: int = 7) -> DataFrame:
    """Mean fall of the information coefficient when a group's features are exchanged within each date; the order
    comes from a hash of (seed, repeat, group, ticker). Predictions are sums, so a group's part of them is what changes
    hands: one pass over groups and repeats."""
    terms = [F.col(c) * F.col("__w")[i] for i, c in enumerate(names)]
    j = _tested(panel, folds).select("as_of", "ticker", F.col("fwd_excess").cast("double").alias("fwd_excess"), sum(terms, F.col("__b")).alias("pred"), F.array(*terms).alias("terms"))
    own = panel.sparkSession.createDataFrame([(g, [float(c in cs) for c in names]) for g, cs in groups.items()], "feature_group string, own array<double>")
    part = sum((F.col("terms")[i] * F.col("own")[i] for i in range(len(names))), F.lit(0.0))
    rows = j.crossJoin(F.broadcast(own)).select("as_of", "ticker", "fwd_excess", "pred", "feature_group", part.alias("part"))  # a row a group
    # rows move once, by date and group; repeats are made where they lie
    rows = rows.where("pred is not null and fwd_excess is not null").repartition("as_of", "feature_group")
    seeds = [seed + r for r in range(repeats)]
    rows = rows.withColumns({f"__h{r}": F.xxhash64(F.lit(r), "feature_group", "ticker") for r in seeds})

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("ticker")
        pred, part, y = (group.column(c).to_numpy() for c in ("pred", "part", "fwd_excess"))
        # a row takes the part of that whose place by hash is its own by ticker
        mixed = (pred - part + part[np.argsort(group.column(f"__h{r}").to_numpy(), kind="stable")] for r in seeds)
        keys = {c: pa.repeat(group.column(c)[0], len(seeds)) for c in ("as_of", "feature_group")}
        return pa.table({**keys, "repeat": pa.array(seeds, pa.int32()), "ic": pa.array([_ic(x, y) for x in mixed], pa.float64())})

    ics = rows.groupBy("as_of", "feature_group").applyInArrow(run, f"as_of {dict(rows.dtypes)['as_of']}, feature_group string, repeat int, ic double")
    base = ic_by_date(predict_folds(panel, folds, names), "pred", "fwd_excess").select("as_of", F.col("ic").alias("base"))
    ics = ics.join(F.broadcast(base), "as_of")  # a row a date
    return ics.groupBy("feature_group", "repeat").agg(F.avg(F.col("base") - F.col("ic")).alias("drop")).groupBy("feature_group").agg(F.avg("drop").alias("importance"), F.count("*").alias("repeats"))


def single_feature_ic(panel: DataFrame, reg: DataFrame, names: list[str], lags: int = 0) -> DataFrame:
    """One pass over all features."""
    long = panel.unpivot(["as_of", "ticker", "fwd_return"], names, "feature", "x")
    s = ic_summary(ic_by_date(long, "x", keys=["feature"]), ["feature"], lags)
    return s.join(reg.select("feature", "family", "sign"), "feature").withColumn("as_expected", (F.col("sign") == 0) | (F.signum("mean_ic") == F.col("sign")))


def ic_breakdown(oos: DataFrame, part: str, lags: int = 0) -> DataFrame:
    """The summary of each part's information coefficients, dates apart. oos needs the column `part`, such as a
    year, a sector or a regime's label; rows without one are left out."""
    own = oos.where(F.col(part).isNotNull())
    return ic_summary(ic_by_date(own, "pred", keys=[part]), [part], lags)


def global_explain(panel: DataFrame, names: list[str], regimes: DataFrame | None = None, lags: int = 0) -> dict[str, DataFrame]:
    """The tables of coefficient stability, importance by family, single features' coefficients and the breakdowns
    by year and, with regimes (as_of, regime), by regime."""
    spark = panel.sparkSession
    reg = registry(spark)
    sums = cut(gram(panel, names), "sums")  # a row a date
    folds, model = cut(walk_forward(panel, names, sums=sums), "folds"), final_fit(panel, names, sums=sums)
    families: dict[str, list[str]] = {}
    for f, fam, _ in FEATURES + [(f"f_{c}", fam, 1) for c, fam in RAW]:
        if f in names:
            families.setdefault(fam, []).append(f)
    oos = predict_folds(panel, folds, names)
    out = {"coefficient_stability": coefficient_stability(folds, model, names), "importance_by_family": permutation_importance(panel, folds, names, families), "single_feature_ic": single_feature_ic(panel, reg, names, lags), "ic_by_year": ic_breakdown(oos.withColumn("year", F.year("as_of")), "year")}
    if regimes is not None:
        out["ic_by_regime"] = ic_breakdown(oos.join(regimes.select("as_of", "regime"), "as_of", "left"), "regime")
    return out


CHECKS = "spec_id string, family string, spec string, mean_ic double, t_nw double, n_dates long, forced boolean, at timestamp"


def holdout_check(panel: DataFrame, names: list[str], spec: dict, family: str, log: str, share: float = 0.15, lags: int = 0, force: bool = False) -> DataFrame:
    """Fits on the research dates and scores the holdout once for a specification: spec_id, mean_ic, t_nw, n_dates,
    already_checked. Who first claims the specification in the folder `log` scores it; all others get what was written
    there, or nulls while it is not written yet or if that check broke off. force scores it again, which is written as
    well and as forced."""
    spark, key = panel.sparkSession, trials.spec_id(spec, family)
    mine = trials.create(spark, f"{log}/claims/{key}.json", {"spec_id": key, "at": trials.now()})
    if mine or force:
        parts = holdout_split(panel, share)
        model = final_fit(parts.where("part = 'research'"), names)
        scored = predict(parts.where("part = 'holdout'").select("as_of", "ticker", *names), model, names).join(panel.select("as_of", "ticker", "fwd_return"), ["as_of", "ticker"])
        found = ic_summary(ic_by_date(scored, "raw"), lags=lags).first()
        own = {c: found[c] for c in ("mean_ic", "t_nw", "n_dates")} if found else {}
        trials.create(spark, f"{log}/checks/{key}-{trials.now().replace(':', '')}.json", {"spec_id": key, "family": family, "spec": json.dumps(spec, sort_keys=True), **own, "forced": not mine, "at": trials.now()})
    done = trials.records(spark, f"{log}/checks", CHECKS).where(F.col("spec_id") == key).orderBy(F.desc("at")).limit(1)
    asked = spark.createDataFrame([(key, not (mine or force))], "spec_id string, already_checked boolean")
    return asked.join(done, "spec_id", "left").select("spec_id", "mean_ic", "t_nw", "n_dates", "already_checked")


def write_model(model: DataFrame, metrics: DataFrame, path: str, **metadata: str) -> None:
    """A model as two tables: its rows (feature, coef, mean, sd, intercept), and one row of its metrics (one row)
    and metadata."""
    model.write.mode("overwrite").parquet(f"{path}/rows")
    metrics.withColumns({k: F.lit(v) for k, v in metadata.items()}).write.mode("overwrite").parquet(f"{path}/about")


def read_model(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows, as predict() takes them, and the row of metrics and metadata."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/about")


# fixed values: what is said of a family that helps and of one that hurts, by its feature's percentile
PHRASES = [
    ("value", "cheap on valuation", "expensive on valuation"), ("quality", "strong on profitability", "weak on profitability"), ("growth", "growing well", "growing slowly"), ("momentum", "in a strong price trend", "in a weak price trend"),
    ("risk", "low-risk on volatility and size", "higher-risk on volatility and size"), ("macro", "well-matched to today's market regime", "poorly matched to today's market regime"), ("issuance", "returning capital to shareholders", "diluting shareholders"),
    ("discipline", "disciplined with capital", "loose with capital"), ("analyst_proxy", "favoured by the fundamentals-based analyst proxy", "disfavoured by the fundamentals-based analyst proxy"), ("sector", "well-positioned within its sector", "weak within its sector"), ("interaction", "supported by a combined signal", "held back by a combined signal"),
]
# fixed values: words that the house's style doesn't use
UNWANTED = ("delve", "tapestry", "robust", "pivot", "seamless")


def _whole(x) -> Column:
    return F.bround(x, 0).cast("int").cast("string")


def reasons(local: DataFrame, confidence: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """as_of, ticker, rank_in_universe, reason, style_ok: in words, where a name stands among those of its date, the
    two families that help most, the one that hurts most, and how far the model is to be trusted (confidence: one row).
    local: as of explained() or contributions(); the former has all parts of a name in its row, so none of them moves.

    A family is said by its feature of the largest contribution: by that feature's percentile in bands, or, where facts
    (as_of, ticker and raw fields) know the field behind it, by the figure itself. style_ok: no long dash and none of the
    unwanted words."""
    keys = ["as_of", "ticker"]
    if "parts" not in local.columns:
        local = local.groupBy(*keys, "rank_in_universe").agg(F.collect_list(F.struct("feature", "family", F.col("raw_value").cast("double").alias("raw_value"), F.col("contribution").cast("double").alias("contribution"))).alias("parts"))
    fields = ("net_issuance", "asset_growth", "pe", "pb", "roe")
    df = local.select(*keys, "rank_in_universe", "parts", F.count("*").over(Window.partitionBy("as_of")).alias("__n"))
    if facts is not None:
        df = df.join(by_name(facts.select(*keys, *[F.col(c).alias(f"r_{c}") for c in fields])), keys, "left")

    def of(family: Column) -> Column:
        own = F.filter("parts", lambda p: p["family"].eqNullSafe(family))
        top = F.array_max(F.transform(own, lambda p: F.struct(F.round(F.abs(p["contribution"]), 10).alias("size"), p["feature"].alias("feature"), p["raw_value"].alias("raw_value"))))
        total = F.aggregate(own, F.lit(0.0), lambda a, p: a + p["contribution"])
        return F.struct(F.round(total, 10).alias("size"), family.alias("family"), total.alias("c"), top.alias("top"))

    df = df.withColumn("families", F.transform(F.array_distinct(F.transform("parts", lambda p: p["family"])), of)).drop("parts")
    first = lambda sign: F.array_sort(F.transform("families", lambda f: F.struct((f["size"] * sign).alias("k"), f["family"].alias("family"), f["c"].alias("c"), f["top"].alias("top"))))
    df = df.withColumns({"__up": F.slice(first(-1), 1, 2), "__down": F.slice(first(1), 1, 1)}).drop("families")
    df = df.withColumns({n: F.when(test(F.get(side, F.lit(i))["c"]), F.get(side, F.lit(i))) for n, side, i, test in (("a", "__up", 0, lambda c: c > 0), ("b", "__up", 1, lambda c: c > 0), ("d", "__down", 0, lambda c: c < 0))}).drop("__up", "__down")

    def said(pick: str) -> Column:
        family, c, p = F.col(f"{pick}.family"), F.col(f"{pick}.c"), F.col(f"{pick}.top.raw_value")
        plain = F.regexp_replace(family, "_", " ")
        known = lambda i: F.coalesce(*[F.when(family == f[0], f[i]) for f in PHRASES])
        good, bad = F.coalesce(known(1), F.concat(F.lit("favourable on "), plain)), F.coalesce(known(2), F.concat(F.lit("unfavourable on "), plain))
        band = F.when((p >= 85) | (p <= 15), "clearly ").otherwise("somewhat ")
        words = F.concat(band, F.when(p >= 50, good).otherwise(bad), F.lit(" (percentile "), _whole(p), F.lit(")"))
        if facts is not None:
            up = lambda x: F.when(x >= 0, "up ").otherwise("down ")
            r = {c: F.col(f"r_{c}") for c in fields}
            over = F.lit("% over the trailing year")
            figures = {"net_issuance": F.concat(F.lit("share count "), up(r["net_issuance"]), _whole(F.abs(r["net_issuance"]) * 100), over), "asset_growth": F.concat(F.lit("total assets "), up(r["asset_growth"]), _whole(F.abs(r["asset_growth"]) * 100), over), "pe": F.when(r["pe"] > 0, F.concat(F.lit("trades at "), F.format_string("%.1f", F.bround(r["pe"], 1)), F.lit("x earnings"))), "pb": F.when(r["pb"] > 0, F.concat(F.lit("trades at "), F.format_string("%.1f", F.bround(r["pb"], 1)), F.lit("x book value"))), "roe": F.concat(F.lit("posts a "), _whole(r["roe"] * 100), F.lit("% return on equity"))}
            field = F.regexp_replace(f"{pick}.top.feature", "^f_", "")
            figure = F.coalesce(*[F.when((field == n) & r[n].isNotNull(), x) for n, x in figures.items()])
            words = F.when(figure.isNotNull(), F.concat(figure, F.lit(" ("), F.when(c > 0, good).otherwise(bad), F.lit(")"))).otherwise(words)
        return F.when(family.isNotNull(), words)

    df = df.crossJoin(F.broadcast(confidence.select(F.col("confidence").alias("sure"))))  # one row
    one = df.withColumn("pct", 100.0 * (1 - (F.col("rank_in_universe") - 1) / F.greatest(F.lit(1), F.col("__n") - 1)))
    pct, sure = F.col("pct"), F.format_string("%.2f", F.bround("sure", 2))
    place = F.when(pct >= 80, F.concat("ticker", F.lit(" sits in the model's top "), _whole(100 - pct), F.lit("% (score "), _whole(pct), F.lit(")."))).when(pct <= 20, F.concat("ticker", F.lit(" sits in the model's bottom "), _whole(pct), F.lit("% (score "), _whole(pct), F.lit(")."))).otherwise(F.concat("ticker", F.lit(" lands near the middle of the pack (score "), _whole(pct), F.lit(").")))
    trust = F.when(F.col("sure") <= 0.05, F.concat(F.lit("Model confidence is "), sure, F.lit(", so this view doesn't change the portfolio."))).when(F.col("sure") < 0.5, F.concat(F.lit("Model confidence is only "), sure, F.lit(", so this view carries limited weight.")))
    plainly = lambda pick: F.regexp_replace(f"{pick}.family", "_", " ")
    text = F.concat_ws(" ", place, F.concat(F.lit("The biggest push comes from "), plainly("a"), F.lit(": it's "), said("a"), F.lit(".")), F.concat(F.lit("It also helps that the stock is "), said("b"), F.lit(".")), F.concat(F.lit("The drag is "), plainly("d"), F.lit(": it's "), said("d"), F.lit(".")), trust)
    return one.select(*keys, "rank_in_universe", text.alias("reason")).withColumn("style_ok", ~F.contains("reason", F.lit("\u2014")) & ~F.lower("reason").rlike("|".join(UNWANTED)))


def view(scores: DataFrame, summary: DataFrame, local: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row a name: raw and gated score, the gate's confidence, rank and reason. scores as of predict(), summary
    as of sidak(), local as of explained(); names without contributions have no reason."""
    gated = evidence_gate(scores, summary)
    said = by_name(reasons(local, confidence(summary), facts))
    return gated.select("as_of", "ticker", F.col("ml_alpha").alias("raw_score"), F.col("gated").alias("score"), "confidence", (F.col("confidence") <= 0.05).alias("gated_off")).join(said, ["as_of", "ticker"], "left")
