"""Autoencoder per cluster, trained by mini-batches, one step after the other."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import count_where, null_safe_join
from .ensemble import threshold_by_group
from .flags import complete
from .modes import ModeModel, kmeans_modes
from .normalize import fit_minmax, minmax_scale
from .ordered import durable, settled, written

CLUSTER = ("cluster_id",)
UNIT = "_u"


def layer_sizes(d: int, hidden=(16, 8), encoding: int = 3) -> list[int]:
    return [d, *hidden, encoding, *reversed(hidden), d]


def initial_weights(sizes, seed) -> np.ndarray:
    """Uniform in ± 1/sqrt(fan-in), weights and biases of each layer in turn, as one flat vector."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, (a + 1) * b) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])])


def _layers(flat, sizes):
    at, out = 0, []
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def forward(flat, sizes, x):
    """Activations of every layer: ReLU inside, sigmoid at the end."""
    acts, last = [x], len(sizes) - 2
    for i, (w, b) in enumerate(_layers(flat, sizes)):
        z = acts[-1] @ w + b
        acts.append(1 / (1 + np.exp(-np.clip(z, -60, 60))) if i == last else np.maximum(z, 0))
    return acts


def gradient(flat, sizes, x, acts=None) -> np.ndarray:
    """Gradient of the mean squared reconstruction error; `acts` are the activations, if they are known."""
    acts = acts or forward(flat, sizes, x)
    out = acts[-1]
    delta, grads = 2 * (out - x) / x.size * out * (1 - out), []
    for i, (w, _) in reversed(list(enumerate(_layers(flat, sizes)))):
        grads.append(np.concatenate([(acts[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ w.T) * (acts[i] > 0)
    return np.concatenate(grads[::-1])


PARTS = 4
CHUNK_STEPS = 2_048
#: A thousand million rows of a cluster in batches of 32: some 50 epochs of that take days, and more is refused, never cut.
MAX_STEPS = 31_250_000
MAX_RATE = 1e-2


def steps_of(rows: int, batch: int) -> int:
    """Mini-batches per epoch, of `batch` rows each, for any number of rows that is trained on."""
    steps = max(1, round(rows / batch))
    if steps > MAX_STEPS:
        raise ValueError(f"{rows} rows of a cluster in batches of {batch} are over {MAX_STEPS} steps an epoch")
    return steps


def placed(scaled: DataFrame, sizes: dict, batch: int, seed: int) -> DataFrame:
    """The rows of each cluster of `sizes` (cluster -> rows) with `part`, given by a hash of the row's id: PARTS parts for each
    mini-batch of an epoch."""
    part = F.lit(None).cast("int")
    for c, n in sizes.items():
        parts = PARTS * steps_of(n, batch)
        part = F.when(F.col("cluster_id") == c, F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(parts)).cast("int")).otherwise(part)
    return scaled.withColumn("part", part).where(F.col("part").isNotNull())


def chunks(scaled: DataFrame, columns, sizes: dict, batch: int, seed: int, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """(cluster_id, chunk; part, x): the rows of the parts of `chunk_steps` mini-batches as one matrix, with the place of each row's
    part in the chunk."""
    span = PARTS * chunk_steps

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", *columns])
        part, x = (pdf["part"] % span).to_numpy(np.int32), pdf[list(columns)].to_numpy(dtype=float)
        return pd.DataFrame({"cluster_id": [int(pdf["cluster_id"].iloc[0])], "chunk": [int(pdf["chunk"].iloc[0])], "part": [part.tobytes()], "x": [x.tobytes()]})

    rows = placed(scaled, sizes, batch, seed).withColumn("chunk", F.floor(F.col("part") / span).cast("int"))
    return rows.groupBy("cluster_id", "chunk").applyInPandas(gather, "cluster_id int, chunk int, part binary, x binary")


def adam(state, g, rate: float):
    """One Adam step. `state` is (weights, first moment, second moment, steps)."""
    w, m, v, t = state
    t += 1
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    return w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8), m, v, t


def descend(state, sizes, x, ends, rate: float):
    """The state after one step of `adam` on the `gradient` of each mini-batch x[ends[k]:ends[k + 1]], and the loss before each step.

    The same in prepared buffers: columns are rows of a mini-batch, the last row of an activation is one, for the bias, and
    the moments are one vector.
    """
    w, m, v, t = state
    size, last = len(w), len(sizes) - 2
    w, moments, news, spare = w.copy(), np.concatenate([m, v]), np.empty(2 * size), np.empty(size)
    m, v, g, squares, share = moments[:size], moments[size:], news[:size], news[size:], np.repeat([0.1, 0.001], size)
    at, weights, grads = 0, [], []
    for a, b in zip(sizes, sizes[1:]):
        weights.append(w[at:at + (a + 1) * b].reshape(a + 1, b))
        grads.append(g[at:at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    x, held, losses = np.ascontiguousarray(x.T), {}, np.empty(len(ends) - 1)
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        n = int(hi - lo)
        if n not in held:
            ones, deltas = [np.ones((a + 1, n)) for a in sizes], [np.empty((a, n)) for a in sizes]
            held[n] = ones, [o[:-1] for o in ones], deltas, [d.T for d in deltas], [np.empty((a, n), bool) for a in sizes]
        full, acts, deltas, turned, active = held[n]
        acts[0][:] = x[:, lo:hi]
        for i, layer in enumerate(weights):
            z = np.dot(layer.T, full[i], out=acts[i + 1])
            if i < last:
                np.maximum(z, 0, out=z)
        np.maximum(z, -60, out=z)
        np.minimum(z, 60, out=z)
        np.exp(np.negative(z, out=z), out=z)
        z += 1
        np.reciprocal(z, out=z)
        delta = np.subtract(z, acts[0], out=deltas[-1])
        losses[k] = np.vdot(delta, delta) / delta.size
        delta *= z
        delta *= np.subtract(1, z, out=z)
        delta *= 2 / delta.size
        for i in range(last, -1, -1):
            np.dot(full[i], turned[i + 1], out=grads[i])
            if i:
                np.dot(weights[i][:-1], deltas[i + 1], out=deltas[i])
                deltas[i] *= np.greater(acts[i], 0, out=active[i])
        t += 1
        np.multiply(g, g, out=squares)
        news -= moments
        news *= share
        moments += news
        root = (1 - 0.999 ** t) ** 0.5
        np.sqrt(v, out=spare)
        spare += 1e-8 * root
        np.divide(m, spare, out=spare)
        spare *= rate * root / (1 - 0.9 ** t)
        w -= spare
    return (w, m.copy(), v.copy(), t), losses


def epoch_chunks(seed: int, epoch: int, cluster: int, steps: int, chunk_steps: int = CHUNK_STEPS):
    """(chunk, the mini-batch within it that each of its parts goes to), in the order of an epoch: the order of the chunks and the parts
    inside them are dealt anew for every epoch, PARTS parts for each mini-batch."""
    rng = np.random.default_rng([seed, epoch, cluster])
    for chunk in rng.permutation(-(-steps // chunk_steps)):
        yield int(chunk), rng.permutation(PARTS * min(chunk_steps, steps - int(chunk) * chunk_steps)) // PARTS


def epoch_parts(seed: int, epoch: int, cluster: int, steps: int, chunk_steps: int = CHUNK_STEPS) -> list:
    """The parts of each mini-batch of an epoch, as `epoch_chunks` deals them."""
    return [[chunk * chunk_steps * PARTS + int(p) for p in parts] for chunk, dealt in epoch_chunks(seed, epoch, cluster, steps, chunk_steps)
            for parts in np.argsort(dealt, kind="stable").reshape(-1, PARTS)]


def step_rate(rate: float, rows: int, batch: int, steps: int) -> float:
    """The learning rate of `batch` rows, raised with the square root of the mini-batch's size over it, to MAX_RATE at most."""
    return max(rate, min(rate * np.sqrt(max(rows / steps / batch, 1.0)), MAX_RATE))


class Losses(Mapping):
    """cluster -> loss of every training step, read from the stored table when asked for: there are more of them than rows."""

    def __init__(self, clusters, table: DataFrame):
        self.clusters, self.table = list(clusters), table

    def __getitem__(self, cluster) -> list:
        if cluster not in self.clusters:
            raise KeyError(cluster)
        rows = self.table.where((F.col("cluster_id") == cluster) & F.col("losses").isNotNull()).select("at", "losses").orderBy("at").collect()
        return [x for r in rows for x in np.frombuffer(r["losses"]).tolist()]

    def __iter__(self):
        return iter(self.clusters)

    def __len__(self) -> int:
        return len(self.clusters)


def train(scaled: DataFrame, columns, cluster_rows: dict, hidden=(16, 8), encoding: int = 3, epochs: int = 50, batch: int = 32,
          rate: float = 1e-3, seed: int = 42, chunk_steps: int = CHUNK_STEPS) -> tuple[dict, Mapping]:
    """(cluster -> flat weights, cluster -> loss of every step), for the clusters of `cluster_rows` (cluster -> rows).

    Mini-batch training, one Adam step after the other, an epoch reading every row once in batches of about `batch` rows. The
    steps of a network follow from each other, so each cluster is one task. It copies the cluster's chunks to a file of its
    own and reads them in the order of each epoch, so it holds one chunk in memory. Neither the batches nor the sums depend
    on the layout.
    """
    sizes, width, clusters = layer_sizes(len(columns), hidden, encoding), len(columns), list(cluster_rows)
    if not clusters:
        return {}, {}
    length = sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))
    rows_of = {int(c): int(n) for c, n in cluster_rows.items()}

    def fit(batches):
        with tempfile.TemporaryFile() as file:
            places: dict = {}
            for pdf in batches:
                for c, chunk, part, x in zip(pdf["cluster_id"], pdf["chunk"], pdf["part"], pdf["x"]):
                    places.setdefault(int(c), {})[int(chunk)] = file.tell(), len(part), len(x)
                    file.write(part)
                    file.write(x)
            for c, own in places.items():
                at, steps = 0, steps_of(rows_of[c], batch)
                state = initial_weights(sizes, [seed, c + 1]), np.zeros(length), np.zeros(length), 0
                for epoch in range(epochs):
                    for chunk, dealt in epoch_chunks(seed, epoch, c, steps, chunk_steps):
                        if chunk not in own:
                            continue
                        begin, parts, numbers = own[chunk]
                        file.seek(begin)
                        step = dealt[np.frombuffer(file.read(parts), np.int32)]
                        x = np.frombuffer(file.read(numbers)).reshape(-1, width)[np.argsort(step, kind="stable")]
                        ends = np.unique(np.concatenate([[0], np.cumsum(np.bincount(step))]))       # without empty mini-batches
                        state, losses = descend(state, sizes, x, ends, step_rate(rate, rows_of[c], batch, steps))
                        yield pd.DataFrame({"cluster_id": [c], "at": [at], "losses": [losses.tobytes()], "w": [None]})
                        at += 1
                yield pd.DataFrame({"cluster_id": [c], "at": [at], "losses": [None], "w": [state[0].tobytes()]})

    packed = chunks(scaled, columns, rows_of, batch, seed, chunk_steps)
    task = F.array_position(F.array(*[F.lit(c) for c in rows_of]), F.col("cluster_id")).cast("int") - 1
    one_each = packed.repartitionById(len(rows_of), task)
    done = written(one_each.mapInPandas(fit, "cluster_id int, at int, losses binary, w binary"))
    weights = {r["cluster_id"]: np.frombuffer(r["w"]).copy() for r in done.where("w IS NOT NULL").select("cluster_id", "w").collect()}
    return {c: weights[int(c)] for c in clusters}, Losses(clusters, done)


@dataclass
class Autoencoder:
    """Clustered autoencoder; clusters under 50 rows have no network, score 0 and are never flagged."""

    modes: ModeModel
    scaler: DataFrame
    weights: dict
    sizes: list
    thresholds: DataFrame | None = None
    name: str = "autoencoder"
    losses: Mapping | None = None       # of every training step; a loaded model has none

    @staticmethod
    def fit(df: DataFrame, features, n_clusters: int = 4, percentile: float = 95.0, hidden=(16, 8), encoding: int = 3,
            epochs: int = 50, batch: int = 32, rate: float = 1e-3, seed: int = 42, restarts: int = 10, at_least: int = 50,
            modes: ModeModel | None = None) -> "Autoencoder":
        modes = modes or kmeans_modes(df, features, n_clusters, seed, restarts)
        rows = modes.assign(df.where(complete(modes.features)))
        scaler = settled(fit_minmax(rows, modes.features, CLUSTER))
        unit = [f + UNIT for f in modes.features]
        k = len(modes.centres)
        sizes = rows.agg(*[count_where(F.col("cluster_id") == c).alias(str(c)) for c in range(k)]).first()
        clusters = [c for c in range(k) if sizes[str(c)] >= at_least]
        scaled = minmax_scale(rows, modes.features, CLUSTER, scaler, UNIT).select("rid", "cluster_id", *unit)
        weights, losses = train(scaled, unit, {c: sizes[str(c)] for c in clusters}, hidden, encoding, epochs, batch, rate, seed)
        model = Autoencoder(modes, scaler, weights, layer_sizes(len(unit), hidden, encoding), losses=losses)
        scored = model._score(rows).where(F.col("cluster_id").isin(clusters)).select("cluster_id", "score_autoencoder")
        model.thresholds = settled(threshold_by_group(durable(scored), "score_autoencoder", percentile))
        return model

    def _score(self, rows: DataFrame) -> DataFrame:
        unit = [f + UNIT for f in self.modes.features]
        scaled = minmax_scale(rows, self.modes.features, CLUSTER, self.scaler, UNIT)
        shared, sizes = rows.sparkSession.sparkContext.broadcast(self.weights), self.sizes

        @F.pandas_udf("double")
        def error(cluster: pd.Series, *features: pd.Series) -> pd.Series:
            ids, every = cluster.to_numpy(dtype=float, na_value=np.nan), np.column_stack([f.to_numpy(dtype=float) for f in features])
            out = np.zeros(len(ids))
            for c, w in shared.value.items():
                pick = np.flatnonzero(ids == c)
                if len(pick):
                    x = every[pick]
                    out[pick] = ((x - forward(w, sizes, x)[-1]) ** 2).mean(axis=1)
            return pd.Series(out)

        return scaled.withColumn("score_autoencoder", error("cluster_id", *[F.coalesce(F.col(c), F.lit(0.0)) for c in unit])).drop(*unit)

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df if "cluster_id" in df.columns else self.modes.assign(df)
        valid = complete(self.modes.features)
        limit = F.coalesce(F.col("threshold"), F.lit(float("inf")))
        return null_safe_join(self._score(rows), self.thresholds, CLUSTER).withColumns({
            "is_autoencoder_anomaly": F.coalesce(valid & (F.col("score_autoencoder") > limit), F.lit(False)),
            "score_autoencoder": F.when(valid, F.col("score_autoencoder"))}).drop("threshold")

    def save(self, spark: SparkSession, path: str) -> None:
        from ..config import local_table
        self.modes.save(spark, f"{path}/modes")
        for part in ("scaler", "thresholds"):
            getattr(self, part).coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}")
        local_table(spark, [(c, list(map(int, self.sizes)), list(map(float, w))) for c, w in self.weights.items()],
                    "cluster_id int, sizes array<int>, w array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Autoencoder":
        rows = spark.read.parquet(f"{path}/weights").collect()          # one row per cluster
        return Autoencoder(ModeModel.load(spark, f"{path}/modes"), spark.read.parquet(f"{path}/scaler"),
                           {r["cluster_id"]: np.array(r["w"]) for r in rows}, list(rows[0]["sizes"]), spark.read.parquet(f"{path}/thresholds"))
