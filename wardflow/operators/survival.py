"""Survival analysis (ops V1-V7): administrative censoring, horizon labels,
a ridge-penalised Cox proportional-hazards fit, survival at a horizon, hazard
ratios and cohort summaries.

The Cox fit is Newton's method on the partial likelihood with Efron's (default) or
Breslow's treatment of ties. A step has two passes over the rows, both plain
aggregates. The first sums ``w = exp(x.b)`` and ``w x`` per distinct time, for all
rows and for events; the two-level ``prefix_sum`` turns them into risk-set totals.
With d events at a time, Efron's risk set of event l lacks the part l/d of the
events' own weight; the sums over l of its reciprocal, of l/d times it and of its
squares are computed per time, in a loop over l. They give each time's term of the
information and two hazards: H(t) for all rows and B(t) for the events themselves.
Rows look up their time's hazards without moving by time (``join_per_key``), so a
time that many rows share, such as an administrative horizon, is no single task.
The second pass uses that the sum over event times of the R2 terms is the sum over
rows of ``w (H(T) - e B(T)) x x'``, so no p x p value per time or row exists. Few
covariates are summed as columns, many (over ``COLUMNS``) as one matrix per task.
Only the summed gradient and information reach the driver. Covariates are standardised first
(sample standard deviation; stable ``exp``); coefficients are reported on the
original scale. The penalty is ``penalizer / 2 * |b|^2`` on the standardised scale,
added to the mean negative log-likelihood.
A missing covariate counts as 0 everywhere: in the fit, in the baseline hazard
and in scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.operators.scan import float_bin, join_per_key, last_value, prefix_sum

# with more covariates than this, x x' is summed as one matrix per task instead of as columns
COLUMNS = 12
# cells of time and risk that one task of the concordance counts
CELLS = 250_000


def censor(duration: Column, event: Column, horizon: float) -> tuple[Column, Column]:
    """V1: administrative censoring at ``horizon``: (min(dur, H), event and dur <= H)."""
    return F.least(duration, F.lit(float(horizon))), (event & (duration <= F.lit(float(horizon))))


def horizon_label(duration: Column, event: Column, horizon: float) -> Column:
    """V2: 1 when the event happens by the horizon, else 0 (null duration -> 0)."""
    return F.when(event & (duration <= F.lit(float(horizon))), F.lit(1)).otherwise(F.lit(0))


def valid_durations(df: DataFrame, duration: str) -> DataFrame:
    """keep rows with a non-null, non-NaN duration."""
    return df.filter(F.col(duration).isNotNull() & ~F.isnan(F.col(duration)))


@dataclass
class CoxModel:
    covariates: list[str]
    mean: np.ndarray
    scale: np.ndarray
    beta_std: np.ndarray  # coefficients on the standardised scale
    cov_std: np.ndarray  # inverse of the penalised information, standardised scale
    n: int
    n_events: float
    iterations: int
    converged: bool
    loglik: float

    @property
    def beta(self) -> np.ndarray:
        return self.beta_std / self.scale

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov_std)) / self.scale

    def linear_predictor(self, df_cols: Sequence[Column] | None = None) -> Column:
        """x.b on the standardised scale (the scale the baseline hazard refers to)."""
        terms = [
            ((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(m))) / F.lit(float(s))) * F.lit(float(b))
            for c, m, s, b in zip(self.covariates, self.mean, self.scale, self.beta_std)
        ]
        return sum(terms, F.lit(0.0))


def _summed_arrays(batches: Iterator[pa.RecordBatch], width: int, fn) -> Iterator[pa.RecordBatch]:
    """One row with the sum of the vectors that ``fn`` gives for the batches of a task."""
    total = np.zeros(width)
    for b in batches:
        if b.num_rows:
            total += fn(b)
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])


def _total(df: DataFrame, width: int, fn) -> np.ndarray:
    """Sum over all rows of the vectors that ``fn`` gives per batch; ``width`` numbers reach the driver."""
    parts = df.mapInArrow(lambda it: _summed_arrays(it, width, fn), "v array<double>")
    out = np.zeros(width)
    for r in parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _weight(beta: np.ndarray) -> Column:
    """exp(x.b)."""
    return F.exp(sum((F.get("x", F.lit(i)) * F.lit(float(b)) for i, b in enumerate(beta)), F.lit(0.0)))


def _time_table(data: DataFrame, beta: np.ndarray) -> DataFrame:
    """Per distinct time: the rows' number, summed ``w`` and ``w x`` of the rows (s0, s1) and of the events (d0, d1) ending there, and the events' number."""
    p = range(len(beta))
    rows = data.select("t", "e", "x", _weight(beta).alias("w"))
    return rows.groupBy(F.col("t").alias("__t")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("e").alias("d"), F.sum("w").alias("s0"), F.coalesce(F.sum(F.when(F.col("e"), F.col("w"))), F.lit(0.0)).alias("d0"),
        *[F.sum(F.col("w") * F.get("x", F.lit(i))).alias(f"s1_{i}") for i in p],
        *[F.coalesce(F.sum(F.when(F.col("e"), F.col("w") * F.get("x", F.lit(i)))), F.lit(0.0)).alias(f"d1_{i}") for i in p],
    ).withColumn("__g", F.lit(0))


def efron_sums(d: int, r0: float, d0: float, efron: bool, step: int = 1 << 20) -> np.ndarray:
    """Over the d events of a time, with f = l / d (Breslow: 0) and v = 1 / (r0 - f d0): the sums of -log v, v, f v, v^2, f v^2, f^2 v^2."""
    if not efron:
        return np.array([d * math.log(r0), d / r0, 0.0, d / r0**2, 0.0, 0.0])
    out = np.zeros(6)
    for start in range(0, d, step):
        f = np.arange(start, min(d, start + step)) / d
        left = r0 - f * d0
        v = 1.0 / left
        out += [np.log(left).sum(), v.sum(), (f * v).sum(), (v * v).sum(), (f * v * v).sum(), (f * f * v * v).sum()]
    return out


def _hazards(risk: DataFrame, p: int, efron: bool) -> DataFrame:
    """Per time of ``risk(__t, d, d0, d1, r0, r1, n)``: (__t, n, h, b), the two hazard steps; per task one row whose ``v``
    sums its times' part of the log-likelihood, the events and the information."""
    schema = "__t double, n long, h double, b double, v array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + p * p)
        for batch in batches:
            if not batch.num_rows:
                continue
            t, d, d0, r0 = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            d1, r1 = _matrix(batch.column(3), p), _matrix(batch.column(5), p)
            sums = np.array([efron_sums(int(n), r, own, efron) if n else np.zeros(6) for n, own, r in zip(d, d0, r0)])
            cross = (sums[:, 4, None] * r1).T @ d1
            total[:2] += sums[:, 0].sum(), d.sum()
            total[2:] += ((sums[:, 3, None] * r1).T @ r1 - cross - cross.T + (sums[:, 5, None] * d1).T @ d1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(t), batch.column(6), pa.array(sums[:, 1]), pa.array(sums[:, 2]),
                                              pa.nulls(len(t), pa.list_(pa.float64()))], names=["__t", "n", "h", "b", "v"])
        none = pa.nulls(1, pa.float64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.int64()), none, none, pa.array([total], pa.list_(pa.float64()))],
                                         names=["__t", "n", "h", "b", "v"])

    return risk.select("__t", "d", "d0", "d1", "r0", "r1", "n").mapInArrow(run, schema)


def _row_sums(rows: DataFrame, beta: np.ndarray) -> np.ndarray:
    """Summed e eta, gradient and w (H - e B) x x' of ``rows(e, x, h, b)``."""
    p = len(beta)
    if p > COLUMNS:
        def at_rows(batch: pa.RecordBatch) -> np.ndarray:
            e, x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), _matrix(batch.column(1), p)
            h, b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            eta = x @ beta
            v = np.exp(eta) * (h - e * b)
            return np.concatenate([[(e * eta).sum()], x.T @ (e - v), ((v[:, None] * x).T @ x).ravel()])

        return _total(rows.select("e", "x", "h", "b"), 1 + p + p * p, at_rows)
    e = F.col("e").cast("double")
    rows = rows.select("x", e.alias("e"), _weight(beta).alias("w"), "h", "b").withColumn("v", F.col("w") * (F.col("h") - F.col("e") * F.col("b")))
    x = [F.get("x", F.lit(i)) for i in range(p)]
    got = rows.agg(F.sum(F.col("e") * F.log("w")), *[F.sum(c * (F.col("e") - F.col("v"))) for c in x],
                   *[F.sum(F.col("v") * x[i] * x[j]) for i in range(p) for j in range(i + 1)]).first()
    info = np.zeros((p, p))
    for (i, j), value in zip([(i, j) for i in range(p) for j in range(i + 1)], got[1 + p:]):
        info[i, j] = info[j, i] = value or 0.0
    return np.concatenate([[got[0] or 0.0], [v or 0.0 for v in got[1: 1 + p]], info.ravel()])


def _step_sums(data: DataFrame, beta: np.ndarray, efron: bool, times: int, n: int):
    """Log-likelihood, gradient, information and number of events at ``beta``; ``data`` has ``n`` rows of ``times`` distinct times."""
    p = len(beta)
    cols = ["s0"] + [f"s1_{i}" for i in range(p)]
    table = _time_table(data, beta).persist()  # read by both levels of the prefix sums
    risk = prefix_sum(table, ["__g"], ["__t"], cols, float_bin("__t"), descending=True, prefix="r_")
    risk = risk.select("__t", "n", "d", "d0", F.array(*[f"d1_{i}" for i in range(p)]).cast("array<double>").alias("d1"), F.col("r_s0").alias("r0"),
                       F.array(*[f"r_s1_{i}" for i in range(p)]).cast("array<double>").alias("r1"))
    steps = _hazards(risk, p, efron).persist()
    try:
        at_times = np.zeros(2 + p * p)
        for r in steps.filter("v IS NOT NULL").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
            at_times[r["i"]] = r["x"]
        marks = steps.filter("v IS NULL").select(F.lit(0).alias("__g"), "__t", "n", "h", "b")
        hazard = prefix_sum(marks, ["__g"], ["__t"], ["h"], float_bin("__t"), prefix="H_").select(
            F.col("__t").alias("t"), "n", F.col("H_h").alias("h"), "b")
        rows = _row_sums(join_per_key(data, hazard, "t", "n", times, n).select("e", "x", "h", "b"), beta)
    finally:
        steps.unpersist()
        table.unpersist()
    info = rows[1 + p:].reshape(p, p) - at_times[2:].reshape(p, p)
    return rows[0] - at_times[0], rows[1: 1 + p], (info + info.T) / 2, at_times[1]


def fit_cox(
    df: DataFrame,
    duration: str,
    event: str,
    covariates: Sequence[str],
    *,
    penalizer: float = 0.1,
    max_iter: int = 50,
    tol: float = 1e-9,
    ties: str = "efron",
) -> CoxModel:
    """V3: ridge-penalised Cox PH fit (``ties``: efron or breslow) by Newton steps on Spark."""
    if ties not in ("efron", "breslow"):
        raise ValueError("ties must be 'efron' or 'breslow'")
    xs = list(covariates)
    base = valid_durations(df, duration).filter(F.col(event).isNotNull()).select(
        F.col(duration).cast("double").alias("t"), F.col(event).cast("boolean").alias("e"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(xs)],
    )
    cached = df.is_cached  # then the caller's copy serves every pass
    if not cached:
        base = base.persist()
    stats = base.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m_{i}") for i in range(len(xs))],
                     *[F.stddev_samp(f"x{i}").alias(f"s_{i}") for i in range(len(xs))]).collect()[0]
    n = int(stats["n"])
    mean = np.array([stats[f"m_{i}"] or 0.0 for i in range(len(xs))])
    scale = np.array([(stats[f"s_{i}"] or 0.0) or 1.0 for i in range(len(xs))])
    std = base.select("t", "e", F.array(
        *[(F.col(f"x{i}") - F.lit(float(m))) / F.lit(float(s)) for i, (m, s) in enumerate(zip(mean, scale))]).alias("x"))
    times = std.select("t").distinct().count()
    beta = np.zeros(len(xs))
    converged, it, ll, info, n_events = False, 0, float("nan"), np.eye(len(xs)), 0.0
    try:
        for it in range(1, max_iter + 1):
            ll, grad, info, n_events = _step_sums(std, beta, ties == "efron", times, n)
            # penalised mean objective: ll/n - penalizer/2 |b|^2
            step = np.linalg.solve(info / n + penalizer * np.eye(len(xs)), grad / n - penalizer * beta)
            beta = beta + step
            if np.max(np.abs(step)) < tol:
                converged = True  # the sums of before the last step hold to its size
                break
        else:
            ll, grad, info, n_events = _step_sums(std, beta, ties == "efron", times, n)
    finally:
        if not cached:
            base.unpersist()
    cov = np.linalg.inv(info + n * penalizer * np.eye(len(xs)))
    return CoxModel(xs, mean, scale, beta, cov, n, n_events, it, converged, ll)


def coefficient_table(spark, model: CoxModel, *, alpha: float | None = None) -> DataFrame:
    """V6: covariate, coef, exp(coef) (hazard ratio), se, z, p; optionally only p < alpha."""
    rows = []
    for c, b, s in zip(model.covariates, model.beta, model.se):
        z = b / s if s > 0 else float("nan")
        p = math.erfc(abs(z) / math.sqrt(2.0)) if s > 0 else float("nan")
        if alpha is None or p < alpha:
            rows.append((c, float(b), float(math.exp(b)), float(s), float(z), float(p)))
    schema = T.StructType([T.StructField(n, t) for n, t in [
        ("covariate", T.StringType()), ("coef", T.DoubleType()), ("hazard_ratio", T.DoubleType()),
        ("se", T.DoubleType()), ("z", T.DoubleType()), ("p", T.DoubleType())]])
    return spark.createDataFrame(rows, schema)


def baseline_cumulative_hazard(df: DataFrame, model: CoxModel, duration: str, event: str) -> DataFrame:
    """Breslow H0(t) at each distinct event time (one row per distinct time)."""
    eta = model.linear_predictor()
    times = valid_durations(df, duration).groupBy(F.col(duration).cast("double").alias("__t")).agg(
        F.sum(F.exp(eta)).alias("s0"), F.sum(F.col(event).cast("double")).alias("d")
    ).withColumn("__g", F.lit(0))
    rs = prefix_sum(times, ["__g"], ["__t"], ["s0"], float_bin("__t"), descending=True, inclusive=True, prefix="r_")
    inc = rs.withColumn("__inc", F.when(F.col("d") > 0, F.col("d") / F.col("r_s0")).otherwise(0.0))
    cum = prefix_sum(inc, ["__g"], ["__t"], ["__inc"], float_bin("__t"), inclusive=True, prefix="H_")
    return cum.select(F.col("__t").alias("time"), F.col("H___inc").alias("cum_hazard"))


def baseline_at(df: DataFrame, model: CoxModel, duration: str, event: str, horizon: float) -> float:
    """H0 at the last time <= horizon (0.0 when there is none): one aggregate job,
    one number back to the driver."""
    row = (
        baseline_cumulative_hazard(df, model, duration, event)
        .filter(F.col("time") <= F.lit(float(horizon)))
        .agg(F.max_by("cum_hazard", "time").alias("h0"))
        .collect()[0]
    )
    return float(row["h0"] or 0.0)


def survival_at(df: DataFrame, model: CoxModel, duration: str, event: str, horizon: float,
                *, out: str = "risk") -> DataFrame:
    """V4: predicted event probability by the horizon, ``1 - exp(-H0(h) exp(x.b))``
    clamped to [0, 1]; H0 is taken at the last time <= horizon (0 when none)."""
    h0 = baseline_at(df, model, duration, event, horizon)
    risk = F.lit(1.0) - F.exp(-F.lit(h0) * F.exp(model.linear_predictor()))
    return df.withColumn(out, F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0)))


def hazard_as_of(df: DataFrame, hazard: DataFrame, horizon: str, *, out: str = "cum_hazard") -> DataFrame:
    """Adds ``out``: the last cumulative hazard of ``hazard(time, cum_hazard)`` at or before each row's own ``horizon``.

    Both sides are stacked in time order and the last known value is carried
    forward (two-level ``last_value``): no range join and no collected table. 0
    before the first time, null where the horizon is null.
    """
    rows = df.select("*", F.col(horizon).cast("double").alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast("double").alias("__h"))
    steps = hazard.select(F.col("time").cast("double").alias("__t"), F.lit(0).alias("__kind"), F.col("cum_hazard").cast("double").alias("__h"))
    both = rows.unionByName(steps, allowMissingColumns=True).withColumn("__g", F.lit(0))
    known = both.filter("__t IS NOT NULL AND NOT isnan(__t)")
    filled = last_value(known, ["__g"], ["__t", "__kind"], ["__h"], float_bin("__t"), prefix="__last").filter("__kind = 1")
    missing = both.filter("(__t IS NULL OR isnan(__t)) AND __kind = 1")
    return filled.select(*df.columns, F.coalesce("__last__h", F.lit(0.0)).alias(out)).unionByName(
        missing.select(*df.columns, F.lit(None).cast("double").alias(out)))


def predicted_risk(rows: DataFrame, train: DataFrame, model: CoxModel, duration: str, event: str, horizon: str,
                   *, out: str = "risk") -> DataFrame:
    """V4 on held-out rows: event probability by each row's own ``horizon``, from the baseline hazard of ``train``."""
    base = baseline_cumulative_hazard(train, model, duration, event)
    risk = F.lit(1.0) - F.exp(-F.col("__H0") * F.exp(model.linear_predictor()))
    scored = hazard_as_of(rows, base, horizon, out="__H0")
    return scored.withColumn(out, F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0))).drop("__H0")


def nelson_aalen(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Cumulative hazard without covariates: (time, cum_hazard), the sum of events / rows at risk up to each distinct time."""
    times = valid_durations(df, duration).groupBy(F.col(duration).cast("double").alias("__t")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(event).alias("d")).withColumn("__g", F.lit(0))
    at_risk = prefix_sum(times, ["__g"], ["__t"], ["n"], float_bin("__t"), descending=True, prefix="r_")
    steps = at_risk.withColumn("h", F.col("d") / F.col("r_n"))
    return prefix_sum(steps, ["__g"], ["__t"], ["h"], float_bin("__t"), prefix="H_").select(
        F.col("__t").alias("time"), F.col("H_h").alias("cum_hazard"))


def pairs_inside(rank: np.ndarray, tau: np.ndarray, count: np.ndarray, levels: int) -> int:
    """Twice the concordant pairs (equal ranks half) among cells of ``count`` rows, sorted by the risk's ``rank``; an even ``tau`` is an event."""
    twice = 0
    for level in range(levels):
        bit, key = (tau >> level) & 1, tau >> (level + 1)
        order = np.argsort(key, kind="stable")
        k, r, c = key[order], rank[order], count[order]
        data = np.where(bit[order] == 1, c, 0)
        query = np.where((bit[order] == 0) & (tau[order] % 2 == 0), c, 0)
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        starts = np.flatnonzero(new_key | np.concatenate([[True], r[1:] != r[:-1]]))
        here, asked = np.add.reduceat(data, starts), np.add.reduceat(query, starts)
        below = np.cumsum(here) - here
        below -= np.maximum.accumulate(np.where(new_key[starts], below, 0))
        twice += int((asked * (2 * below + here)).sum())
    return twice


def _cell_pairs(cells: DataFrame, levels: int) -> DataFrame:
    """Per partition of ``cells(__r, __tau, __c)``: its totals per tau (data, query), those of its first and last risk for the
    pairs of a risk that straddles partitions (data: events, query: rows, no tau) and a row with ``twice``, the pairs inside."""
    schema = "tau long, r double, part int, data long, query long, twice long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
        if not columns:
            return
        r, tau, c = (np.concatenate(x) for x in zip(*columns))
        part = TaskContext.get().partitionId()
        risks, rank = np.unique(r, return_inverse=True)
        order = np.argsort(rank, kind="stable")
        rank, tau, c = rank[order], tau[order], c[order]
        events = np.where(tau % 2 == 0, c, 0)
        values, where = np.unique(tau, return_inverse=True)
        rows, asked = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        np.add.at(rows, where, c)
        np.add.at(asked, where, events)
        ends = sorted({0, len(risks) - 1})
        edge = [rank == i for i in ends]
        none = len(ends) + 1
        out = [pa.array(np.concatenate([values, np.zeros(none, np.int64)]), mask=np.arange(len(values) + none) >= len(values)),
               pa.array(np.concatenate([np.zeros(len(values)), risks[ends], [0.0]])),
               pa.array(np.full(len(values) + none, part, np.int32)),
               pa.array(np.concatenate([rows, [events[x].sum() for x in edge], [0]]).astype(np.int64)),
               pa.array(np.concatenate([asked, [c[x].sum() for x in edge], [0]]).astype(np.int64)),
               pa.array(np.concatenate([np.zeros(len(values) + none - 1, np.int64), [pairs_inside(rank, tau, c, levels)]]).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(out, names=["tau", "r", "part", "data", "query", "twice"])

    return cells.select("__r", "__tau", "__c").mapInArrow(run, schema)


def concordance(df: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """V5: Harrell's concordance index, exact, without forming row pairs.

    Comparable pairs are (i, j) with an event at T_i and T_j > T_i, or T_j = T_i
    with j censored; a pair is concordant when risk_i > risk_j and counts 1/2
    when the risks are equal.

    Times are replaced by tau = 2 * dense rank, plus 1 for a censored row, so a
    pair is comparable iff tau_j > tau_i. Rows first collapse to cells of one tau
    and risk, and the cells are range-partitioned by (risk, tau), so that no
    task gets the cells of a frequent time or risk. ``_cell_pairs`` counts the
    pairs inside a partition and leaves its totals per tau. Of a pair from two
    partitions with different risks the lower risk is in the earlier partition,
    so those are running totals over the partitions' numbers: tau_j > tau_i iff
    there is exactly one bit level l where the higher bits agree, tau_i has 0 and
    tau_j has 1, and per (l, tau >> (l + 1)) the earlier partitions' data (bit 1)
    meet the queries (events with bit 0). A risk that straddles partitions adds
    half of its events times its rows in later partitions.
    """
    base = valid_durations(df, duration).filter(F.col(event).isNotNull() & F.col(risk).isNotNull()).select(
        F.col(duration).cast("double").alias("__t"), F.col(event).cast("boolean").alias("__e"),
        F.col(risk).cast("double").alias("__r"),
    )
    times = base.groupBy("__t").agg(F.count(F.lit(1)).alias("__n"), F.count_if("__e").alias("__d")).withColumn(
        "__g", F.lit(0)).withColumn("__one", F.lit(1)).persist()
    size = times.agg(F.count(F.lit(1)).alias("times"), F.sum("__n").alias("n"), F.sum("__d").alias("d")).first()
    n, levels = size["n"] or 0, max(1, math.ceil(math.log2(2 * max(size["times"], 1))))
    ranks = prefix_sum(times, ["__g"], ["__t"], ["__one"], float_bin("__t"), inclusive=False, prefix="tau")
    ranks = ranks.select("__t", "__n", F.col("tau__one").cast("long").alias("__rank"))
    cells = base.groupBy("__t", "__e", "__r").agg(F.count(F.lit(1)).alias("__c"))
    cells = join_per_key(cells, ranks, "__t", "__n", size["times"], n).select(
        "__r", (2 * F.col("__rank") + F.when(F.col("__e"), 0).otherwise(1)).alias("__tau"), "__c")
    # one evaluation: the bounds of the partitions are sampled
    parts = _cell_pairs(cells.repartitionByRange(max(1, math.ceil(n / CELLS)), "__r", "__tau"), levels)
    leveled = parts.select("*", F.explode(F.when(F.col("tau").isNull(), F.array(F.lit(-1))).otherwise(
        F.sequence(F.lit(0), F.lit(levels - 1)))).alias("l"))
    bit = F.call_function("shiftright", F.col("tau"), F.col("l")).bitwiseAND(F.lit(1))
    keyed = leveled.select(
        "l", F.when(F.col("l") < 0, 0).otherwise(F.call_function("shiftright", F.col("tau"), F.col("l") + 1)).alias("k"), "r", "part",
        F.when(F.col("l") < 0, F.col("data")).otherwise(F.col("data") * bit).alias("data"),
        F.when(F.col("l") < 0, F.col("query")).otherwise(F.col("query") * (1 - bit)).alias("query"), "twice")
    totals = keyed.filter("data > 0 OR query > 0 OR twice > 0").groupBy("l", "k", "r", "part").agg(
        F.sum("data").alias("data"), F.sum("query").alias("query"), F.sum("twice").alias("twice"))
    earlier = Window.partitionBy("l", "k", "r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pairs = totals.withColumn("__earlier", F.coalesce(F.sum("data").over(earlier), F.lit(0)))
    twice = F.sum(F.col("twice") + F.col("query") * F.col("__earlier") * F.when(F.col("l") < 0, 1).otherwise(2))
    numerator = pairs.agg(F.when(F.lit(bool(size["d"])), F.coalesce(twice, F.lit(0)) / F.lit(2.0)).alias("num"))
    # comparable pairs: events times rows with a larger tau
    later = prefix_sum(times, ["__g"], ["__t"], ["__n"], float_bin("__t"), descending=True, inclusive=False, prefix="later")
    denominator = later.agg(F.sum(F.col("__d") * (F.col("later__n") + F.col("__n") - F.col("__d"))).alias("den"))
    both_sums = numerator.select("num", F.lit(None).cast("double").alias("den")).unionByName(
        denominator.select(F.lit(None).cast("double").alias("num"), F.col("den").cast("double"))
    ).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return both_sums.select(
        (F.col("num") / F.col("den")).alias("concordance"), F.col("num").alias("concordant_pairs"),
        F.col("den").alias("comparable_pairs"),
    )


def cohort_summary(df: DataFrame, split: str, duration: str, event: str, horizon: float) -> DataFrame:
    """V7: per split: rows, events, events within the horizon."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(event)).alias("n_events"),
        F.sum(horizon_label(F.col(duration), F.col(event), horizon)).alias("n_events_by_horizon"),
        F.lit(float(horizon)).alias("horizon"),
    )
