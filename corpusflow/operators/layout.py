"""Drawing aids: projection, hulls and spanning trees of small clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project(vectors: DataFrame, dims: int = 3, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, p): principal components, in place of a neighbour embedding. The covariance is summed over all rows; its size is that of a vector squared."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    return PCA(k=dims, inputCol="v", outputCol="p").fit(v).transform(v).select(key, vector_to_array("p").alias("p"))


def hull(points: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull of points in the plane, counter-clockwise."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    if len(order) < 3:
        return order

    def side(seq) -> list[int]:
        out: list[int] = []
        for i in seq:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = points[out[-2]], points[out[-1]], points[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out

    return np.array(side(order)[:-1] + side(order[::-1])[:-1])


def spanning_tree(points: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a shortest tree over all points, grown from the first."""
    n = len(points)
    if n < 2:
        return []
    dist = np.linalg.norm(points - points[0], axis=1)
    near, out = np.zeros(n, int), []
    dist[0] = np.inf
    done = np.zeros(n, bool)
    done[0] = True
    for _ in range(n - 1):
        j = int(np.where(done, np.inf, dist).argmin())
        out.append((int(near[j]), j))
        done[j] = True
        d = np.linalg.norm(points - points[j], axis=1)
        closer = ~done & (d < dist)
        dist[closer], near[closer] = d[closer], j
    return out


def hulls(points: DataFrame, group: str, key: str = "vec_id") -> DataFrame:
    """(group, corner, key): corners of each group's hull from (key, group, x, y); groups are clusters drawn on a screen."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({group: pdf[group].iloc[0], "corner": np.arange(len(at)), key: pdf[key].iloc[at].to_numpy()})

    kinds = dict(points.dtypes)
    return points.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, corner long, {key} {kinds[key]}")


def average_linkage(similar: np.ndarray, cut: float = 0.5) -> list[list[int]]:
    """Groups by average linkage of a 0/1 approval matrix, merged while the mean distance is at most ``cut``; for vocabularies of some thousands."""
    groups = [[i] for i in range(len(similar))]
    d = 1.0 - similar.astype(float)
    np.fill_diagonal(d, np.inf)
    size = np.ones(len(d))
    alive = np.ones(len(d), bool)
    while alive.sum() > 1:
        i, j = divmod(int(d.argmin()), len(d))
        if d[i, j] > cut:
            break
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i] = d[:, i] = row
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        groups[i] += groups[j]
        alive[j] = False
    return [sorted(g) for g, a in zip(groups, alive, strict=True) if a]
