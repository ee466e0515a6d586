"""Reconstruction error of an uncentred truncated SVD, one model per cluster, all clusters in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import null_safe_join
from .ensemble import apply_thresholds, threshold_by_group
from .flags import complete
from .modes import ModeModel, kmeans_modes
from .normalize import fit_minmax, minmax_scale
from .ordered import settled, written

CLUSTER = ("cluster_id",)
UNIT = "_u"          # suffix of scaled feature columns


def gram(df: DataFrame, columns, keys=CLUSTER) -> DataFrame:
    """n, second moments and means per key: d(d+1)/2 + d sums with map-side combine, no row leaves its task."""
    d = len(columns)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i in range(d) for j in range(i, d)],
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)])


NARROW = 16          # beyond this many columns the products are taken by BLAS on Arrow batches


def gram_moments(df: DataFrame, columns, keys=CLUSTER) -> DataFrame:
    """keys, n and `moments` (upper triangle of XᵀX, then the column sums) for any number of columns.

    Narrow tables use built-in sums. For wide ones each task adds up its own d x d products and hands
    on one block per key, so the shuffle carries blocks and never rows.
    """
    d = len(columns)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    if d <= NARROW:
        g = gram(df, columns, keys)
        return g.select(*keys, "n", F.array(*[F.col(f"g_{i}_{j}") for i, j in upper],
                                            *[F.col(f"m_{i}") * F.col("n") for i in range(d)]).alias("moments"))
    pick = np.triu_indices(d)
    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def blocks(batches):
        total = {}
        for pdf in batches:
            for key, part in pdf.groupby(list(keys), dropna=False):
                x = part[list(columns)].to_numpy(dtype=float)
                add = np.concatenate([[len(x)], (x.T @ x)[pick], x.sum(axis=0)])
                total[key] = total.get(key, 0) + add
        for key, m in total.items():
            yield pd.DataFrame({**dict(zip(keys, key)), "at": np.arange(len(m)), "value": m})

    parts = df.select(*keys, *columns).mapInPandas(blocks, f"{key_ddl}, at int, value double")
    summed = parts.groupBy(*keys, "at").agg(F.sum("value").alias("value"))
    whole = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_m"))
    values = F.transform("_m", lambda x: x["value"])
    return whole.select(*keys, values[0].cast("bigint").alias("n"), F.slice(values, 2, len(upper) + d).alias("moments"))


def svd_fit(df: DataFrame, columns, n_components: int = 3, keys=CLUSTER) -> DataFrame:
    """Per key: `v`, the first right singular vectors (k*d numbers, row-wise), and `explained`, their variance shares.

    Keys with fewer than n_components + 1 rows get no model.
    """
    d = len(columns)
    k = min(n_components, d - 1) if d > 1 else 1

    @F.pandas_udf("array<double>")
    def solve(moments: pd.Series) -> pd.Series:
        def one(m):
            n, g = m[0], np.zeros((d, d))
            g[np.triu_indices(d)] = m[1:1 + d * (d + 1) // 2]
            g = np.triu(g) + np.triu(g, 1).T
            mean = np.asarray(m[1 + d * (d + 1) // 2:]) / n
            _, vectors = np.linalg.eigh(g)
            v = vectors[:, ::-1][:, :k].T
            v = v * np.where(v[np.arange(k), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
            total = (np.diag(g) / n - mean ** 2).sum()
            part = np.einsum("ki,ij,kj->k", v, g / n, v) - (v @ mean) ** 2
            return [*v.ravel(), *(part / total if total > 0 else np.zeros(k))]
        return moments.map(one)

    stats = gram_moments(df, columns, keys).where(F.col("n") >= n_components + 1)
    moments = F.concat(F.array(F.col("n").cast("double")), F.col("moments"))
    solved = stats.select(*keys, "n", solve(moments).alias("_s"))
    return solved.select(*keys, "n", F.slice("_s", 1, k * d).alias("v"), F.slice("_s", k * d + 1, k).alias("explained"))


def residual(columns, k: int, v: Column) -> Column:
    """|x|² - Σ (x·v_j)², clamped at 0, with the joined component array `v`."""
    d = len(columns)
    norm = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in columns])
    for j in range(k):
        dot = reduce(lambda a, b: a + b, [F.col(c) * v[j * d + i] for i, c in enumerate(columns)])
        norm = norm - dot * dot
    return F.greatest(norm, F.lit(0.0))


WIDE_NUMBERS = 2_000_000        # components broadcast as one matrix per key; beyond this they are joined to the rows


def _plain(key) -> tuple:
    return tuple(None if pd.isna(k) else k for k in key)


def _block_residual(spark: SparkSession, components: DataFrame, columns, k: int, keys) -> Column | None:
    """`residual` of wide rows by matrix products: the rows of a batch that share a key against that key's broadcast components.

    None if the components of all keys are more than WIDE_NUMBERS numbers.
    """
    most = WIDE_NUMBERS // (k * len(columns))
    found = components.select(*keys, "v").limit(most + 1).collect()
    if len(found) > most:
        return None
    shared = spark.sparkContext.broadcast({_plain(r[:-1]): np.array(r["v"]).reshape(k, -1) for r in found})
    n_keys = len(keys)

    @F.pandas_udf(T.DoubleType())
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series[n_keys:]])
        out = np.full(len(x), np.inf)
        frame = pd.DataFrame({i: s.to_numpy() for i, s in enumerate(series[:n_keys])})
        for key, rows in frame.groupby(list(frame.columns), dropna=False).indices.items():
            v = shared.value.get(_plain(key if isinstance(key, tuple) else (key,)))
            if v is not None:
                out[rows] = np.maximum((x[rows] ** 2).sum(axis=1) - ((x[rows] @ v.T) ** 2).sum(axis=1), 0.0)
        return pd.Series(out)

    return score(*[F.col(c) for c in (*keys, *columns)])


@F.pandas_udf(T.DoubleType())
def _joined_residual(v: pd.Series, *x: pd.Series) -> pd.Series:
    """The same with the components of each row joined to it."""
    rows = np.column_stack([c.to_numpy(dtype=float) for c in x])
    out = np.full(len(rows), np.inf)
    have = np.flatnonzero(v.notna())
    if len(have):
        comps = np.stack(v.iloc[have].to_numpy()).reshape(len(have), -1, rows.shape[1])
        out[have] = np.maximum((rows[have] ** 2).sum(axis=1) - (np.einsum("nd,nkd->nk", rows[have], comps) ** 2).sum(axis=1), 0.0)
    return pd.Series(out)


def svd_score(df: DataFrame, components: DataFrame, columns, n_components: int = 3, name="score_svd", keys=CLUSTER) -> DataFrame:
    """Score every row; keys without a model score +infinity."""
    k = min(n_components, len(columns) - 1) if len(columns) > 1 else 1
    if len(columns) > NARROW:
        score = _block_residual(df.sparkSession, components, columns, k, keys)
        if score is not None:
            return df.withColumn(name, score)
    joined = null_safe_join(df, components.select(*keys, "v"), keys)
    if len(columns) > NARROW:
        return joined.withColumn(name, _joined_residual("v", *[F.col(c) for c in columns])).drop("v")
    return joined.withColumn(name, F.when(F.col("v").isNotNull(), residual(columns, k, F.col("v"))).otherwise(F.lit(float("inf")))).drop("v")


def svd_predict(df: DataFrame, thresholds: DataFrame, score="score_svd", flag="is_svd_anomaly", keys=CLUSTER) -> DataFrame:
    return apply_thresholds(df, thresholds, score, flag, keys)


def explained_variance(components: DataFrame, keys=CLUSTER) -> DataFrame:
    return components.select(*keys, F.posexplode("explained").alias("component", "ratio"))


@dataclass
class ClusteredSVD:
    """Modes, per-cluster scaling, components and thresholds: small tables keyed by cluster."""

    modes: ModeModel
    scaler: DataFrame
    components: DataFrame
    thresholds: DataFrame
    n_components: int = 3
    name: str = "svd"

    @staticmethod
    def fit(df: DataFrame, features, n_clusters: int = 4, n_components: int = 3, percentile: float = 95.0, seed: int = 42,
            restarts: int = 10, modes: ModeModel | None = None) -> "ClusteredSVD":
        modes = modes or kmeans_modes(df, features, n_clusters, seed, restarts)
        rows = written(modes.assign(df.where(complete(modes.features))).select(*CLUSTER, *modes.features))
        scaler = settled(fit_minmax(rows, modes.features, CLUSTER))
        model = ClusteredSVD(modes, scaler, None, None, n_components)
        scaled = model._scale(rows)
        model.components = settled(svd_fit(scaled, model._unit(), n_components))
        scored = svd_score(scaled, model.components, model._unit(), n_components)
        model.thresholds = settled(threshold_by_group(scored.where(F.col("score_svd") < float("inf")), "score_svd", percentile))
        return model

    def _unit(self):
        return [f + UNIT for f in self.modes.features]

    def _scale(self, rows: DataFrame) -> DataFrame:
        return minmax_scale(rows, self.modes.features, CLUSTER, self.scaler, UNIT)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds cluster_id, score_svd and is_svd_anomaly; rows with a missing feature get NULL / NULL / false.

        One wide expression over broadcast parameters: no shuffle, so it also runs on a stream.
        """
        rows = df if "cluster_id" in df.columns else self.modes.assign(df)
        scored = svd_score(self._scale(rows), self.components, self._unit(), self.n_components).drop(*self._unit())
        limit = F.coalesce(F.col("threshold"), F.lit(float("inf")))
        valid = complete(self.modes.features)
        return null_safe_join(scored, self.thresholds, CLUSTER).withColumns({
            "is_svd_anomaly": F.coalesce(valid & (F.col("score_svd") > limit), F.lit(False)),
            "score_svd": F.when(valid, F.col("score_svd"))}).drop("threshold")

    def save(self, spark: SparkSession, path: str) -> None:
        self.modes.save(spark, f"{path}/modes")
        for part in ("scaler", "components", "thresholds"):
            getattr(self, part).coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}")

    @staticmethod
    def load(spark: SparkSession, path: str, n_components: int = 3) -> "ClusteredSVD":
        parts = {p: spark.read.parquet(f"{path}/{p}") for p in ("scaler", "components", "thresholds")}
        return ClusteredSVD(ModeModel.load(spark, f"{path}/modes"), n_components=n_components, **parts)
