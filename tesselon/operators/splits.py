"""Balanced split of districts: a deterministic clustering, an objective of seven parts, and a seeded search.

The tables have one row a district and are small by nature; they come to the driver. Candidate splits are drawn there
in one sequence, so that they don't depend on parallelism, and scored by the executors, thousands at once as products
of a candidates x splits x districts membership array with the districts' columns.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")
EXTENSIVE = ("area", "windows", "buildings", "road_length", "pois")
DENSITY = ("building_density", "road_density", "poi_density")


@dataclass(frozen=True)
class Plan:
    counts: tuple[int, int, int] = (15, 5, 5)
    seed: int = 20260723
    candidates: int = 50_000
    context_clusters: int = 5
    spatial_clusters: int = 5
    least_contexts: int = 3
    components: tuple[int, int] = (2, 3)
    weights: dict[str, float] = field(default_factory=lambda: dict(extensive=1.0, density=0.75, category=0.75, landcover=1.0, dem=0.5, context=0.5, spatial=0.5))


def standardized(values: np.ndarray) -> np.ndarray:
    """Columns to mean 0 and population deviation 1; a constant column becomes 0."""
    values = np.asarray(values, float)
    spread = values.std(axis=0)
    return (values - values.mean(axis=0)) / np.where(spread == 0, 1, spread)


def clusters(values: np.ndarray, labels: list[str], k: int, seed: int) -> np.ndarray:
    """Lloyd's clusters from farthest-first centres, numbered by centre. The first centre has the least hash of seed and
    label; equally far rows go by label."""
    x = standardized(values)
    chosen = [min(range(len(labels)), key=lambda i: hashlib.sha256(f"{seed}:{labels[i]}".encode()).hexdigest())]
    while len(chosen) < k:
        far = ((x[:, None] - x[chosen]) ** 2).sum(2).min(1)
        far[chosen] = -1
        chosen.append(min(np.flatnonzero(far >= far.max() - 1e-15).tolist(), key=lambda i: labels[i]))
    centres, own = x[chosen].copy(), np.zeros(len(x), int)
    for _ in range(100):
        new = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        if (new == own).all():
            break
        own = new
        sizes = np.bincount(own, minlength=k)
        if not sizes.all():
            raise ValueError("a cluster became empty")
        centres = np.stack([np.bincount(own, weights=c, minlength=k) for c in x.T], axis=1) / sizes[:, None]
    rank = np.empty(k, int)
    rank[sorted(range(k), key=lambda c: tuple(centres[c]))] = np.arange(k)
    return rank[own]


def entropy(counts: np.ndarray) -> np.ndarray:
    """Shannon entropy, in nats, of each row."""
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1e-300)
    return -(share * np.log(np.where(share > 0, share, 1))).sum(1)


class Objective:
    """Districts as arrays. frame: code, EXTENSIVE, DENSITY, dem_cells, dem_mean, dem_std, x, y; categories, landcover: counts by district."""

    def __init__(self, frame: pd.DataFrame, categories: np.ndarray, landcover: np.ndarray, adjacency: np.ndarray, plan: Plan):
        self.plan, self.codes = plan, [str(c) for c in frame["code"]]
        n = len(frame)
        context = np.column_stack([np.log1p(frame[list(DENSITY)].to_numpy(float)), entropy(landcover), frame["dem_mean"], frame["dem_std"]])
        place = frame[["x", "y"]].to_numpy(float)
        self.context = clusters(context, self.codes, plan.context_clusters, plan.seed)
        self.spatial = clusters(place, self.codes, plan.spatial_clusters, plan.seed + 1)
        away = np.hypot(*(place - place.mean(0)).T)
        self.radial = np.empty(n, int)
        for band, rows in enumerate(np.array_split(sorted(range(n), key=lambda i: (away[i], self.codes[i])), 3)):
            self.radial[rows] = band
        self.adjacency = adjacency
        hot = lambda v: np.eye(int(v.max()) + 1)[v]
        self.hot = {"context": np.eye(plan.context_clusters)[self.context], "spatial": np.eye(plan.spatial_clusters)[self.spatial], "radial": hot(self.radial)}
        self.extensive, self.density = frame[list(EXTENSIVE)].to_numpy(float), frame[list(DENSITY)].to_numpy(float)
        self.area, self.place = self.extensive[:, 0], standardized(place)
        self.counts = {"category": categories.astype(float), "landcover": landcover.astype(float)}
        cells, mean, std = (frame[c].to_numpy(float) for c in ("dem_cells", "dem_mean", "dem_std"))
        self.dem = np.column_stack([cells, cells * mean, cells * (std**2 + mean**2)])

    @staticmethod
    def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = sums[..., 1] / sums[..., 0]
        return mean, np.sqrt(np.maximum(0, sums[..., 2] / sums[..., 0] - mean**2))

    def scores(self, member: np.ndarray) -> dict[str, np.ndarray]:
        """The seven parts, for each candidate. member: candidates x splits x districts, 0 or 1."""
        target = np.array(self.plan.counts) / sum(self.plan.counts)
        size = member.sum(2, keepdims=True)
        out = {"extensive": ((((member @ self.extensive) / self.extensive.sum(0)) / target[:, None] - 1) ** 2).mean((1, 2))}
        weighted = (member @ (self.density * self.area[:, None])) / (member @ self.area)[..., None]
        city = (self.density * self.area[:, None]).sum(0) / self.area.sum()
        out["density"] = (((weighted - city) / np.maximum(city, 1e-9)) ** 2).mean((1, 2))
        for name, counts in self.counts.items():
            share = member @ counts
            total = share.sum(2, keepdims=True)
            share = np.divide(share, total, out=np.zeros_like(share), where=total > 0)
            whole = counts.sum(0) / counts.sum() if counts.sum() > 0 else np.zeros(counts.shape[1])
            out[name] = ((np.abs(share - whole).sum(2) / 2) ** 2).mean(1)
        (mean, std), (city_mean, city_std) = self._moments(member @ self.dem), self._moments(self.dem.sum(0))
        out["dem"] = (np.stack([mean - city_mean, std - city_std], 2) ** 2).mean((1, 2)) / city_std**2
        parts = {name: (((member @ self.hot[name]) / size - self.hot[name].mean(0)) ** 2).mean(2) for name in ("context", "spatial")}
        centre = (member @ self.place) / size
        out["context"] = parts["context"].mean(1)
        out["spatial"] = np.stack([parts["spatial"], (centre**2).sum(2)], 2).mean((1, 2))
        return out

    def components(self, member: np.ndarray) -> np.ndarray:
        """Connected parts of each row of districts, by letting least labels spread between neighbours until none changes."""
        n = member.shape[-1]
        label = np.where(member > 0, np.arange(n), n)
        near = np.where((self.adjacency + np.eye(n)) > 0, 0, n)
        while True:
            new = np.where(member > 0, np.minimum(label, np.maximum(label[..., None, :], near).min(-1)), n)
            if (new == label).all():
                return ((label == np.arange(n)) & (member > 0)).sum(-1)
            label = new

    def feasible(self, member: np.ndarray) -> np.ndarray:
        """Validation and test spread over contexts, places and bands, in few parts; train over contexts."""
        kinds = {name: ((member @ hot) > 0).sum(2) for name, hot in self.hot.items()}
        ok = (kinds["context"] >= self.plan.least_contexts).all(1) & (kinds["spatial"][:, 1:] >= 2).all(1) & (kinds["radial"][:, 1:] >= 2).all(1)
        at = np.flatnonzero(ok)
        parts = self.components(member[at, 1:])
        ok[at] = ((parts >= self.plan.components[0]) & (parts <= self.plan.components[1])).all(1)
        return ok

    def members(self, splits: np.ndarray) -> np.ndarray:
        """candidates x splits x districts from the split number of each district."""
        return (splits[:, None, :] == np.arange(3)[:, None]).astype(float)


def candidates(codes: list[str], plan: Plan) -> np.ndarray:
    """Split number of each district (in order of code) in each seeded shuffle."""
    rng, order = random.Random(plan.seed), sorted(codes)
    at = {c: i for i, c in enumerate(order)}
    numbers = np.repeat(np.arange(3), plan.counts)
    out = np.empty((plan.candidates, len(order)), np.int8)
    for row in out:
        shuffled = order.copy()
        rng.shuffle(shuffled)
        row[[at[c] for c in shuffled]] = numbers
    return out


def search(spark: SparkSession, objective: Objective, block: int = 1000) -> DataFrame:
    """(candidate, score, assignment, and each part): every feasible candidate."""
    order = sorted(range(len(objective.codes)), key=lambda i: objective.codes[i])
    drawn = candidates(objective.codes, objective.plan)
    shared = spark.sparkContext.broadcast(objective)
    blocks = spark.createDataFrame([(k, drawn[k : k + block].tobytes()) for k in range(0, len(drawn), block)], "first long, splits binary")
    names = sorted(objective.plan.weights)

    def run(batches):
        o = shared.value
        for batch in batches:
            for first, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ordered = np.frombuffer(blob, np.int8).reshape(-1, len(order))
                splits = np.empty_like(ordered)
                splits[:, order] = ordered
                member = o.members(splits)
                at = np.flatnonzero(o.feasible(member))
                parts = o.scores(member[at])
                total = sum(o.plan.weights[n] * parts[n] for n in names) if len(at) else np.zeros(0)
                said = ["|".join(f"{o.codes[order[j]]}:{SPLITS[s]}" for j, s in enumerate(row)) for row in ordered[at].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(total), pa.array(said, pa.string()), *(pa.array(parts[n]) for n in names)], ["candidate", "score", "assignment", *names])

    return blocks.repartition(max(1, min(len(drawn) // block, spark.sparkContext.defaultParallelism))).mapInArrow(run, "candidate long, score double, assignment string, " + ", ".join(f"{n} double" for n in names))


def best(found: DataFrame) -> DataFrame:
    """The candidate of least score; of scores within 1e-15 the one of least assignment text."""
    least = found.agg(F.min("score").alias("least"))
    return found.join(F.broadcast(least), F.col("score") <= F.col("least") + 1e-15).drop("least").orderBy("assignment").limit(1)


def assignment(found: DataFrame) -> DataFrame:
    """(code, split) of the best candidate."""
    return best(found).select(F.explode(F.split("assignment", "[|]")).alias("p")).select(F.substring_index("p", ":", 1).alias("code"), F.substring_index("p", ":", -1).alias("split"))


def validate(assigned: DataFrame, plan: Plan) -> DataFrame:
    """(metric, value, expected, ok): rows of each split, repeated and null codes."""
    expected = {**{s: n for s, n in zip(SPLITS, plan.counts)}, "repeated": 0, "null": 0}
    one = assigned.withColumn("n", F.count("*").over(Window.partitionBy("code"))).agg(*(F.count_if(F.col("split") == s).alias(s) for s in SPLITS), F.count_if(F.col("code").isNotNull() & (F.col("n") > 1)).alias("repeated"), F.count_if(F.col("code").isNull() | F.col("split").isNull()).alias("null"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value"), F.lit(e).cast("long").alias("expected"), (F.col(f"`{m}`") == e).alias("ok")) for m, e in expected.items()))).alias("m")).select("m.*")
