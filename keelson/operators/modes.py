"""Operating modes: clustering on min-max scaled features, centres in original units, names by rule."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import local_table
from ..functions.columns import null_safe_join
from .exact import SCALE, blocks, fixed, row_sums
from .flags import complete
from .normalize import fit_minmax
from .ordered import written


def _find(features, *words) -> str | None:
    return next((f for f in features if all(w in f.lower() for w in words)), None)


def name_of(cluster: Column, features, prefix="Mode", slow: float = 3.0, slow_power: float = 500.0) -> Column:
    """Mode name from the centre's speed, power and average draft; found by name, not by position."""
    speed, power, draft = _find(features, "speed", "gps"), _find(features, "power", "engine"), _find(features, "draft", "avg")
    label = F.concat(F.lit(f"{prefix}_"), cluster.cast("string"))
    if speed is None or power is None:
        return label
    rest = F.lit("_AtRest") if draft is None else F.when(F.col(draft) > 6.5, "_AtRest_Loaded").otherwise("_AtRest_Unloaded")
    s, p = F.col(speed), F.col(power)
    return F.concat(label, F.when((s < 0.5) & (p < 100), rest).when((s < slow) & (p < slow_power), "_SlowSpeed")
                    .when(s < 10, "_MediumSpeed").otherwise("_HighSpeed"))


def mode_names(centres: DataFrame, features, prefix: str = "Mode") -> DataFrame:
    return centres.withColumn("name", name_of(F.col("cluster_id"), features, prefix))


def mode_names_by_mean(df: DataFrame, features, prefix: str = "Mode") -> DataFrame:
    """Names from the mean of each cluster's rows; here slow means below 5 kn at any power."""
    means = df.groupBy("cluster_id").agg(*[F.avg(f).alias(f) for f in features])
    return means.withColumn("name", name_of(F.col("cluster_id"), features, prefix, 5.0, float("inf")))


@dataclass
class ModeModel:
    """Centres (original units) and the scaling range per feature: a few dozen numbers."""

    features: list
    centres: list            # k lists of d numbers, original units
    lo: list
    hi: list

    def _unit(self, i: int, value: Column | float):
        span = (self.hi[i] - self.lo[i]) or 1.0
        return (value - self.lo[i]) / span

    def distance2(self, k: int) -> Column:
        parts = [self._unit(i, F.col(f)) - self._unit(i, self.centres[k][i]) for i, f in enumerate(self.features)]
        return reduce(lambda a, b: a + b, [p * p for p in parts])

    def assign(self, df: DataFrame, name: str = "cluster_id") -> DataFrame:
        """Nearest centre in scaled space (lowest id on ties); rows with a missing feature get NULL."""
        best = F.array_min(F.array(*[F.struct(self.distance2(k).alias("d"), F.lit(k).alias("k"))
                                     for k in range(len(self.centres))]))
        return df.withColumn(name, F.when(complete(self.features), best["k"]))

    def centre_table(self, spark: SparkSession, prefix: str = "Mode") -> DataFrame:
        ddl = "cluster_id int, " + ", ".join(f"`{f}` double" for f in self.features)
        rows = [(k, *map(float, c)) for k, c in enumerate(self.centres)]
        return mode_names(local_table(spark, rows, ddl), self.features, prefix)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, f, float(self.lo[i]), float(self.hi[i]), [float(c[i]) for c in self.centres]) for i, f in enumerate(self.features)]
        local_table(spark, rows, "i int, feature string, lo double, hi double, centres array<double>").coalesce(1).write.mode(
            "overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ModeModel":
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["i"])     # one row per feature
        return ModeModel([r["feature"] for r in rows], [list(c) for c in zip(*[r["centres"] for r in rows])],
                         [r["lo"] for r in rows], [r["hi"] for r in rows])


SAMPLE = 4_096
HASH = "_hash"


def _scaled_vectors(df: DataFrame, features):
    """(vectors, lo, hi): the complete rows scaled to 0..1 and a hash of each row, stored once and dealt out by that hash.

    The fit reads one aggregated row. A scan of one row group would otherwise keep all later passes in one task.
    """
    key = F.xxhash64("rid") if "rid" in df.columns else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.where(complete(features)).select(*features, key.alias(HASH))
    r = fit_minmax(rows, features).first()
    if r is None or r[0] is None:
        raise ValueError("no complete row to cluster")
    lo, hi = [float(r[f"{f}_lo"]) for f in features], [float(r[f"{f}_hi"]) for f in features]
    unit = rows.select(HASH, *[((F.col(f) - lo[i]) / ((hi[i] - lo[i]) or 1.0)).alias(f) for i, f in enumerate(features)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(unit.repartition(parts, HASH)), lo, hi


def _original_units(centres, lo, hi):
    return [[float(c[i]) * ((hi[i] - lo[i]) or 1.0) + lo[i] for i in range(len(lo))] for c in centres]


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, centres), feature by feature: a row's distances do not depend on the rows beside it."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centres[None, :, j]) ** 2
    return out


def greedy_seeds(sample: np.ndarray, k: int, rng) -> np.ndarray:
    """k rows of the sample: each next one is the best of a few drawn in proportion to the squared distance to those before."""
    trials = 2 + int(math.log(k))
    chosen = sample[rng.integers(len(sample))][None]
    nearest = squared_distances(sample, chosen)[:, 0]
    while len(chosen) < k:
        weight = nearest.sum()
        drawn = rng.choice(len(sample), trials, p=nearest / weight) if weight > 0 else rng.integers(len(sample), size=trials)
        left = np.minimum(nearest[:, None], squared_distances(sample, sample[drawn]))
        best = int(left.sum(axis=0).argmin())
        chosen, nearest = np.vstack([chosen, sample[drawn[best]]]), left[:, best]
    return chosen


def _starts(vectors: DataFrame, features, k: int, seed: int, restarts: int) -> tuple:
    """(seeds of every restart, mean variance of the features) on the SAMPLE rows with the smallest hashes; which rows these are
    does not depend on the layout."""
    rows = vectors.orderBy(HASH, *features).limit(SAMPLE).select(*features).toPandas().to_numpy(dtype=float)
    return [greedy_seeds(rows, k, np.random.default_rng([seed, r])) for r in range(restarts)], float(rows.var(axis=0).mean())


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple:
    """((centres, rows): 1.0 at the nearest centre of every row, the first of equal ones; squared distance to it). The distances are
    those of `squared_distances`, with rows side by side."""
    far = (x[:, 0] - centres[:, 0, None]) ** 2
    for j in range(1, x.shape[1]):
        away = x[:, j] - centres[:, j, None]
        far += np.multiply(away, away, out=away)
    best = far.min(axis=0)
    member = (far == best).astype(float)
    free = 1 - member[0]
    for own in member[1:]:
        own *= free
        free -= own
    return member, best


def _lloyd(vectors: DataFrame, features, starts, max_iter: int, tol: float) -> list:
    """(centres, cost) per start. Each pass over the rows (or their `blocks`) advances every start that has not settled yet, which is
    when the squared moves of its centres add up to `tol` at most."""
    k, d = starts[0].shape
    width, centres, cost, live = k * (d + 1) + 1, [c.copy() for c in starts], [np.inf] * len(starts), list(range(len(starts)))

    def contributions(flat):
        def sums(x):
            whole = np.column_stack([np.ones(len(x)), np.rint(x * SCALE)])      # numbers up to 2**36, so products add exactly
            out = []
            for c in flat:
                member, far = nearest_centres(x, c)
                n, *moments = (member @ whole).astype(np.int64).T
                out += [n << 36, *moments, [fixed(far).sum()]]
            return np.concatenate(out)
        return sums

    for step in range(max_iter + 1):
        found = row_sums(vectors, features, width * len(live), contributions([centres[r] for r in live])).reshape(len(live), width)
        moving = []
        for r, row in zip(live, found):
            cost[r], n, sums = row[-1], row[:k], row[k:-1].reshape(d, k).T
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[r])
            if step < max_iter and ((new - centres[r]) ** 2).sum() > tol:
                centres[r] = new
                moving.append(r)
        live = moving
        if not live:
            break
    return list(zip(centres, cost))


def kmeans_modes(df: DataFrame, features, k: int = 4, seed: int = 42, restarts: int = 10, max_iter: int = 300, tol: float = 1e-4) -> ModeModel:
    """K-Means with restarts, lowest cost wins (the first of equal ones). Starts, sums and result are the same at every layout.

    Starts are greedy seeds on a sample of at most SAMPLE rows chosen by hash; all rows are read in every pass, and one pass
    serves all restarts. A centre without rows stays where it is. `tol` is relative to the variance of the features.
    """
    vectors, lo, hi = _scaled_vectors(df, features)
    starts, variance = _starts(vectors, features, k, seed, restarts)
    fits = _lloyd(written(blocks(vectors, features)), features, starts, max_iter, tol * variance)
    best = min(fits, key=lambda f: f[1])[0]
    return ModeModel(list(features), _original_units(best, lo, hi), lo, hi)


def cluster_summary(df: DataFrame, model: ModeModel, thresholds: DataFrame | None = None, prefix: str = "Mode") -> DataFrame:
    """id, name, count, percentage and centres of every cluster, empty ones included."""
    counts = df.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_t"))
    table = model.centre_table(df.sparkSession, prefix)
    table = table.withColumnsRenamed({f: f"center_{f}" for f in model.features})
    out = table.join(counts, "cluster_id", "left").crossJoin(F.broadcast(total)).na.fill(0, ["count"])
    out = out.withColumn("percentage", F.col("count") / F.col("_t") * 100).drop("_t")
    return out if thresholds is None else null_safe_join(out, thresholds.withColumnRenamed("threshold", "svd_threshold"), ["cluster_id"])


@dataclass
class MixtureModel:
    """Gaussian mixture on scaled features; all parameters are a few hundred numbers on the driver."""

    features: list
    weights: np.ndarray
    means: np.ndarray            # k x d, scaled
    covariances: np.ndarray      # k x d x d
    lo: list
    hi: list
    log_likelihood: float
    iterations: int
    converged: bool
    rows: int
    covariance_type: str = "full"

    def _log_density(self, k: int) -> Column:
        d = len(self.features)
        x = [(F.col(f) - self.lo[i]) / ((self.hi[i] - self.lo[i]) or 1.0) - float(self.means[k][i]) for i, f in enumerate(self.features)]
        inv, (_, logdet) = np.linalg.inv(self.covariances[k]), np.linalg.slogdet(self.covariances[k])
        terms = [float(inv[i][j] * (1 if i == j else 2)) * x[i] * x[j] for i in range(d) for j in range(i, d) if inv[i][j] != 0.0]
        return F.lit(math.log(max(self.weights[k], 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + logdet)) - 0.5 * reduce(lambda a, b: a + b, terms)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """`probabilities` (soft) and `cluster_id` (hard) for rows with all features."""
        logs = df.withColumns({f"_l{k}": self._log_density(k) for k in range(len(self.weights))})
        ls = [F.col(f"_l{k}") for k in range(len(self.weights))]
        logs = logs.withColumn("_m", F.greatest(*ls) if len(ls) > 1 else ls[0])
        e = [F.exp(x - F.col("_m")) for x in ls]
        total = reduce(lambda a, b: a + b, e)
        out = logs.withColumn("probabilities", F.when(complete(self.features), F.array(*[x / total for x in e])))
        out = out.withColumn("cluster_id", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))
        return out.drop("_m", *[f"_l{k}" for k in range(len(self.weights))])

    def mode_model(self) -> ModeModel:
        return ModeModel(self.features, _original_units(self.means, self.lo, self.hi), self.lo, self.hi)

    def scores(self) -> dict:
        """AIC and BIC on the data, with the usual parameter count of the covariance type."""
        k, d = self.means.shape
        cov = {"full": k * d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.covariance_type]
        p = k * d + k - 1 + cov
        return {"aic": 2 * p - 2 * self.log_likelihood, "bic": p * math.log(self.rows) - 2 * self.log_likelihood,
                "converged": self.converged, "n_iter": self.iterations}


def gmm_modes(df: DataFrame, features, k: int = 4, covariance_type: str = "full", seed: int = 42, restarts: int = 5,
              max_iter: int = 200, tol: float = 1e-3) -> MixtureModel:
    """The most likely of several fits by expectation maximisation; one pass over the rows advances all of them.

    Each fit starts from the K-Means centres (20 passes at most) of its own greedy seeds. It has converged when the mean
    log-likelihood changes by less than `tol`. Sums and result are the same at every layout.
    """
    if covariance_type not in ("full", "diag", "spherical"):
        raise ValueError(f"covariance type {covariance_type}")
    features = list(features)
    vectors, lo, hi = _scaled_vectors(df, features)
    n = vectors.count()
    seeds, variance = _starts(vectors, features, k, seed, restarts)
    packed = written(blocks(vectors, features))
    starts = [c for c, _ in _lloyd(packed, features, seeds, 20, 1e-4 * variance)]
    return max(_expectation_maximisation(packed, features, starts, covariance_type, max_iter, tol, n, lo, hi), key=lambda m: m.log_likelihood)


def log_densities(x: np.ndarray, weights, means, covariances) -> np.ndarray:
    """(components, rows): log(weight * density), computed row by row."""
    d, out = x.shape[1], np.empty((len(weights), len(x)))
    for j, (w, m, c) in enumerate(zip(weights, means, covariances)):
        inverse, (_, logdet) = np.linalg.inv(c), np.linalg.slogdet(c)
        away, form = [x[:, a] - m[a] for a in range(d)], np.zeros(len(x))
        for a in range(d):
            for b in range(a, d):
                if inverse[a, b]:
                    term = inverse[a, b] * (1 if a == b else 2) * away[a]
                    form += np.multiply(term, away[b], out=term)
        out[j] = math.log(max(w, 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + logdet + form)
    return out


def _expectation_maximisation(vectors, features, starts, kind, max_iter, tol, n, lo, hi) -> list:
    k, d = starts[0].shape
    last = [d if kind == "full" else a + 1 for a in range(d)]          # the other kinds use the variances alone
    pairs = [(a, b) for a in range(d) for b in range(a, last[a])]
    width = 1 + k * (1 + d + len(pairs))
    state = [(np.full(k, 1.0 / k), c, np.array([np.eye(d) * 0.05] * k)) for c in starts]
    previous, steps, done, live = [-np.inf] * len(starts), [0] * len(starts), [False] * len(starts), list(range(len(starts)))

    def contributions(states):
        def sums(x):
            columns, out = x.T, []
            for weights, means, covariances in states:
                logs = log_densities(x, weights, means, covariances)
                top = logs.max(axis=0)
                share = np.exp(logs - top)
                total = sum(share[j] for j in range(k))
                out.append([fixed(np.clip(top + np.log(total), -1000, 1000)).sum()])
                for j in range(k):
                    r = share[j] / total * SCALE           # whole numbers of at most 2**36 after rounding, so their sums are exact
                    rx = r * columns
                    squares = [np.rint(rx[a] * columns[a:last[a]]).sum(axis=1) for a in range(d)]
                    out.append(np.concatenate([[np.rint(r).sum()], np.rint(rx).sum(axis=1), *squares]))
            return np.concatenate(out).astype(np.int64)
        return sums

    for step in range(1, max_iter + 1):
        found = row_sums(vectors, features, width * len(live), contributions([state[r] for r in live])).reshape(len(live), width)
        moving = []
        for r, row in zip(live, found):
            parts = row[1:].reshape(k, -1)
            mass = np.maximum(parts[:, 0], 1e-10)
            means, covariances = parts[:, 1:1 + d] / mass[:, None], np.empty((k, d, d))
            for at, (a, b) in enumerate(pairs):
                covariances[:, a, b] = covariances[:, b, a] = parts[:, 1 + d + at] / mass - means[:, a] * means[:, b]
            variances = np.maximum(np.diagonal(covariances, axis1=1, axis2=2), 0) + 1e-6
            if kind == "spherical":
                variances = np.repeat(variances.mean(axis=1, keepdims=True), d, axis=1)
            if kind != "full":
                covariances = np.zeros((k, d, d))
            covariances[:, np.arange(d), np.arange(d)] = variances
            state[r], steps[r] = (mass / mass.sum(), means, covariances), step
            done[r] = abs(row[0] / n - previous[r]) < tol
            previous[r] = row[0] / n
            if not done[r]:
                moving.append(r)
        live = moving
        if not live:
            break
    return [MixtureModel(features, *state[r], lo, hi, previous[r] * n, steps[r], done[r], n, kind) for r in range(len(starts))]


def gmm_summary(scored: DataFrame, model: MixtureModel) -> DataFrame:
    """Cluster summary with the mean probability of each cluster's own rows."""
    own = scored.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(
        F.avg(F.get(F.col("probabilities"), F.col("cluster_id"))).alias("avg_probability"))
    return cluster_summary(scored, model.mode_model(), prefix="GMM").join(own, "cluster_id", "left").na.fill(0.0, ["avg_probability"])
