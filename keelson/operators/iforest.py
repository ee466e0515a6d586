"""Isolation forest, one per cluster. Trees are built from bounded samples, one task per group of trees."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .flags import complete
from .ensemble import threshold_by_group
from .modes import ModeModel, kmeans_modes
from .normalize import fit_minmax, minmax_scale
from .ordered import durable, settled
from ..functions.columns import null_safe_join

CLUSTER = ("cluster_id",)
UNIT = "_u"
UNROLLED = 200
WALKED = 16_384
NODES = "cluster_id int, tree int, psi int, feature array<int>, split array<double>, left array<int>, right array<int>, depth array<double>"


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2 * (np.log(big - 1) + 0.5772156649) - 2 * (big - 1) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def build_tree(x: np.ndarray, rng: np.random.Generator) -> dict:
    """Random splits down to single rows or depth log2(size); leaves carry depth plus the expected rest."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    out = {k: [] for k in ("feature", "split", "left", "right", "depth")}
    pending = [(np.arange(len(x)), 0, -1, "")]
    while pending:
        rows, depth, parent, side = pending.pop()
        me = len(out["feature"])
        if parent >= 0:
            out[side][parent] = me
        spread = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        leaf = depth >= limit or not len(usable)
        f = -1 if leaf else int(rng.choice(usable))
        lo, hi = (0.0, 0.0) if leaf else (x[rows, f].min(), x[rows, f].max())
        cut = 0.0 if leaf else float(rng.uniform(lo, hi))
        for name, value in (("feature", f), ("split", cut), ("left", -1), ("right", -1),
                            ("depth", depth + float(average_path(len(rows))) if leaf else 0.0)):
            out[name].append(value)
        if not leaf:
            below = x[rows, f] <= cut
            pending += [(rows[~below], depth + 1, me, "right"), (rows[below], depth + 1, me, "left")]
    return out


def draw_samples(scaled: DataFrame, trees: int, max_samples: int, seed: int, at_least: int) -> DataFrame:
    """Every tree's own sample: the `max_samples` rows of the cluster, out of all of them, with the smallest hash of (rid, tree).

    A cut-off that follows from the cluster's row count, ten standard deviations above the sample, leaves a few hundred rows
    of each cluster and tree to rank. The sample does not depend on how the rows are laid out. A row without rid is an error.
    """
    counts = settled(scaled.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least))
    rid = F.coalesce(F.col("rid"), F.raise_error(F.lit("rid is null")).cast("bigint"))
    span = 1 << 40
    most = max_samples + 10 * math.sqrt(max_samples) + 20
    cut = F.ceil(F.lit(float(span)) * F.least(F.lit(1.0), F.lit(most) / F.col("_n")))


    def hashed(tree):
        return F.pmod(F.xxhash64(F.col("_rid"), tree, F.lit(seed)), F.lit(span))

    rows = null_safe_join(scaled, counts, CLUSTER, "inner").withColumn("_rid", rid).withColumn("_cut", cut)
    if trees <= UNROLLED:       # the lambda below is interpreted; nearly no row of a large cluster is drawn at all, which compiled code finds
        rows = rows.where(F.least(*[hashed(F.lit(t)) for t in range(trees)], F.lit(span)) < F.col("_cut"))
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), hashed(t).alias("h"))), lambda d: d["h"] < F.col("_cut"))
    rows = rows.withColumn("_d", F.explode(drawn)).withColumns({"tree": F.col("_d.tree"), "_h": F.col("_d.h")}).drop("_d")
    w = Window.partitionBy(*CLUSTER, "tree").orderBy("_h", "rid")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_samples)


def fit_trees(scaled: DataFrame, columns, trees: int = 100, max_samples: int = 256, seed: int = 42, at_least: int = 10) -> DataFrame:
    """One row per (cluster, tree) with its node arrays; clusters under ten rows get none."""
    drawn = draw_samples(scaled, trees, max_samples, seed, at_least)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        c, t = int(pdf["cluster_id"].iloc[0]), int(pdf["tree"].iloc[0])
        x = pdf.sort_values("rid")[list(columns)].to_numpy(dtype=float)
        return pd.DataFrame([{"cluster_id": c, "tree": t, "psi": len(x), **build_tree(x, np.random.default_rng([seed, c + 1, t]))}])

    return drawn.select("cluster_id", "tree", "rid", *columns).groupBy("cluster_id", "tree").applyInPandas(grow, NODES)


def forest_scorer(spark: SparkSession, trees: DataFrame):
    """Arrow UDF (cluster, features) -> score. The forest is clusters x trees x (2 * samples) nodes, set by
    the parameters and not by the data, so it fits a broadcast variable."""
    forests = {}
    for r in trees.orderBy("cluster_id", "tree").toLocalIterator():
        forests.setdefault(r["cluster_id"], []).append(r)
    packed = {c: {"trees": [walkable(t) for t in ts], "psi": ts[0]["psi"], "levels": math.ceil(math.log2(max(ts[0]["psi"], 2))) + 1}
              for c, ts in forests.items()}
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def score(cluster: pd.Series, *features: pd.Series) -> pd.Series:
        ids, every = cluster.to_numpy(dtype=float, na_value=np.nan), np.column_stack([f.to_numpy(dtype=float) for f in features])
        out = np.zeros(len(ids))
        for c, f in shared.value.items():
            pick = np.flatnonzero(ids == c)
            for at in range(0, len(pick), WALKED):
                rows = pick[at:at + WALKED]
                paths = path_sums(f["trees"], every[rows], f["levels"]) / len(f["trees"])
                out[rows] = 2.0 ** (-paths / max(float(average_path(f["psi"])), 1e-12))
        return pd.Series(out)

    return score


def walkable(tree) -> tuple:
    """(feature, split, children, depth) of a tree's nodes: a row at node k goes on to children[2 * k], or to children[2 * k + 1] above the
    split. A leaf leads to itself."""
    feature, me = np.array(tree["feature"]), np.arange(len(tree["feature"]))
    leaf = feature < 0
    children = np.stack([np.where(leaf, me, tree["left"]), np.where(leaf, me, tree["right"])], axis=1)
    return np.where(leaf, 0, feature), np.array(tree["split"]), children.ravel(), np.array(tree["depth"])


def path_sums(trees: list, x: np.ndarray, levels: int) -> np.ndarray:
    """The summed depths of the leaves that the rows of `x` reach in the trees."""
    flat, first, total = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
    for feature, split, children, depth in trees:
        node = np.zeros(len(x), int)
        for _ in range(levels):
            above = ~(flat.take(feature.take(node) + first) <= split.take(node))
            node = children.take(2 * node + above)
        total += depth.take(node)
    return total


@dataclass
class IsolationForest:
    """Clustered isolation forest; clusters without a forest score 0 and are never flagged."""

    modes: ModeModel
    scaler: DataFrame
    trees: DataFrame
    thresholds: DataFrame | None = None
    name: str = "iforest"

    @staticmethod
    def fit(df: DataFrame, features, n_clusters: int = 4, percentile: float = 95.0, trees: int = 100, max_samples: int = 256,
            seed: int = 42, restarts: int = 10, modes: ModeModel | None = None) -> "IsolationForest":
        modes = modes or kmeans_modes(df, features, n_clusters, seed, restarts)
        rows = modes.assign(df.where(complete(modes.features)))
        scaler = settled(fit_minmax(rows, modes.features, CLUSTER))
        unit = [f + UNIT for f in modes.features]
        scaled = minmax_scale(rows, modes.features, CLUSTER, scaler, UNIT).select("rid", *CLUSTER, *unit)
        model = IsolationForest(modes, scaler, settled(fit_trees(scaled, unit, trees, max_samples, seed)))
        scored = model._score(rows).where(F.col("cluster_id").isin(model._clusters())).select("cluster_id", "score_iforest")
        model.thresholds = settled(threshold_by_group(durable(scored), "score_iforest", percentile))
        return model

    def _clusters(self) -> list[int]:
        return [r[0] for r in self.trees.select("cluster_id").distinct().collect()]

    def _score(self, rows: DataFrame) -> DataFrame:
        unit = [f + UNIT for f in self.modes.features]
        scaled = minmax_scale(rows, self.modes.features, CLUSTER, self.scaler, UNIT)
        udf = forest_scorer(rows.sparkSession, self.trees)
        return scaled.withColumn("score_iforest", udf("cluster_id", *[F.coalesce(F.col(c), F.lit(0.0)) for c in unit])).drop(*unit)

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df if "cluster_id" in df.columns else self.modes.assign(df)
        valid = complete(self.modes.features)
        limit = F.coalesce(F.col("threshold"), F.lit(float("inf")))
        return null_safe_join(self._score(rows), self.thresholds, CLUSTER).withColumns({
            "is_iforest_anomaly": F.coalesce(valid & (F.col("score_iforest") > limit), F.lit(False)),
            "score_iforest": F.when(valid, F.col("score_iforest"))}).drop("threshold")

    def save(self, spark: SparkSession, path: str) -> None:
        self.modes.save(spark, f"{path}/modes")
        for part in ("scaler", "trees", "thresholds"):
            getattr(self, part).coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        parts = {p: spark.read.parquet(f"{path}/{p}") for p in ("scaler", "trees", "thresholds")}
        return IsolationForest(ModeModel.load(spark, f"{path}/modes"), **parts)
