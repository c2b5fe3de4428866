"""K-means: parallel seeding by oversampling, then Lloyd steps, each one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.frame import Frame
from quillframe.functions import ieee


def distances(xs: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """Squared distance to each centre, as an array; a missing value counts as 0."""
    xs = [F.coalesce(x, F.lit(0.0)) for x in xs]
    return F.array(*(sum(((x - F.lit(float(c))) * (x - F.lit(float(c))) for x, c in zip(xs, centre, strict=True)), F.lit(0.0)) for centre in centres))


def nearest(xs: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """0-based place of the nearest centre; the first of equals."""
    d = distances(xs, centres)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def lloyd_step(df: DataFrame, names: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """cluster, n, and the new mean of each column: one partial and one final aggregate."""
    at = df.select(nearest([F.col(c) for c in names], centres).alias("cluster"), *names)
    return at.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names))


@dataclass
class KMeansModel:
    names: list[str]
    centres: list[list[float]]  # in raw units
    mean: list[float]
    scale: list[float]
    iterations: int

    def predict(self, f: Frame) -> Column:
        xs = [(ieee.valid(f.columns[c]) - m) / s for c, m, s in zip(self.names, self.mean, self.scale, strict=True)]
        return nearest(xs, [[(v - m) / s for v, m, s in zip(c, self.mean, self.scale, strict=True)] for c in self.centres])


def _recluster(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """k weighted centres of few points: farthest weighted points first, then Lloyd steps."""
    at = [int(weights.argmax())]
    while len(at) < min(k, len(points)):
        d = ((points[:, None] - points[at][None]) ** 2).sum(-1).min(1) * weights
        at.append(int(d.argmax()))
    c = points[at].copy()
    for _ in range(rounds):
        own = ((points[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([np.average(points[own == j], axis=0, weights=weights[own == j]) if (own == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def fit(f: Frame, k: int, columns: Sequence[str] | None = None, epsilon: float = 1e-6, max_iter: int = 100, standardize: bool = True, seed: int = 1, rounds: int = 5) -> KMeansModel:
    """k centres. Constant columns are left out; an empty cluster keeps its centre.

    Seeding starts from one row and adds about 3 k rows a round, each with a
    chance by its squared distance; these few candidates are weighted by the
    rows nearest to them and clustered on the driver.
    """
    names = list(columns or f.names)
    aggs = [g(ieee.valid(f.columns[c])).alias(f"{n}{i}") for i, c in enumerate(names) for n, g in (("m", F.avg), ("s", F.stddev_pop))]
    r = f.rows.df.agg(*aggs).first()
    kept = [i for i in range(len(names)) if r[f"s{i}"]]
    if not kept:
        raise ValueError("no column varies")
    mean = [r[f"m{i}"] if standardize else 0.0 for i in kept]
    scale = [r[f"s{i}"] if standardize else 1.0 for i in kept]
    names = [names[i] for i in kept]
    zs = [f"z{i}" for i in range(len(names))]
    df = f.rows.df.select(*(F.coalesce((ieee.valid(f.columns[c]) - m) / s, F.lit(0.0)).alias(z) for c, m, s, z in zip(names, mean, scale, zs, strict=True)))
    df = df.persist()
    try:
        xs = [F.col(z) for z in zs]
        first = df.orderBy(F.xxhash64(*zs, F.lit(seed))).limit(1).collect()
        found = [list(first[0])]
        for n in range(rounds):
            d = F.array_min(distances(xs, found))
            total = df.agg(F.sum(d)).first()[0]
            if not total:
                break
            chance = F.least(F.lit(1.0), d * F.lit(3.0 * k / total))
            draw = F.pmod(F.xxhash64(*zs, F.lit(seed + 1 + n)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            # the chances add up to 3 k at most, so that is how many rows come, about
            found += sorted(list(x) for x in df.filter(draw < chance).distinct().collect())
        counts = {x["c"]: x["count"] for x in df.select(nearest(xs, found).alias("c")).groupBy("c").count().collect()}
        used = sorted(counts)
        centres = _recluster(np.array([found[c] for c in used]), np.array([counts[c] for c in used], dtype=float), k)
        steps = 0
        for steps in range(1, max_iter + 1):  # noqa: B007
            rows = {x["cluster"]: [x[z] for z in zs] for x in lloyd_step(df, zs, centres.tolist()).collect()}
            new = np.array([rows.get(j, centres[j].tolist()) for j in range(len(centres))])
            moved = np.abs(new - centres).max()
            centres = new
            if moved <= epsilon:
                break
    finally:
        df.unpersist()
    raw = (centres * np.array(scale) + np.array(mean)).tolist()
    return KMeansModel(names, raw, mean, scale, steps)


def score(model: KMeansModel, f: Frame) -> DataFrame:
    """cluster, n, sum of squared distances in standardised units."""
    xs = [(ieee.valid(f.columns[c]) - m) / s for c, m, s in zip(model.names, model.mean, model.scale, strict=True)]
    centres = [[(v - m) / s for v, m, s in zip(c, model.mean, model.scale, strict=True)] for c in model.centres]
    at = f.rows.df.select(model.predict(f).alias("cluster"), F.array_min(distances(xs, centres)).alias("d"))
    return at.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d").alias("sum_sq"))
