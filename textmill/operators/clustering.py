"""Clusters of a document's chunks by k-means with an elbow rule; one group per document."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_of


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 10) -> tuple[float, np.ndarray]:
    best = (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:  # k-means++
            d = np.min(((x[:, None] - np.array(centres)) ** 2).sum(2), axis=1)
            centres.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
        c, labels = np.array(centres), None
        for _ in range(100):
            d = ((x[:, None] - c) ** 2).sum(2)
            new = d.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            for j in range(k):
                if (labels == j).any():
                    c[j] = x[labels == j].mean(0)
        inertia = float(((x - c[labels]) ** 2).sum())
        if inertia < best[0] - 1e-12:
            best = (inertia, labels)
    return best


def elbow(inertias: list[float], least: int, delta: float) -> int:
    """Number of clusters: the last before a drop under ``delta`` of the first inertia."""
    for i in range(1, len(inertias)):
        if inertias[i - 1] - inertias[i] < delta * inertias[0]:
            return least + i - 1
    return least + len(inertias) - 1


def cluster(chunks: DataFrame, delta: float = 0.05, most: int = 10, least: int = 2, seed: int = 42, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk_idx, cluster_id, k, and the columns to ``carry``) from (key, chunk_idx, mean); ids in first-seen order."""
    carried = list(carry)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        x = np.array(pdf["mean"].tolist(), float)
        labels, k = np.zeros(len(x), int), 1
        if len(x) > least:
            fits = [_lloyd(x, k, np.random.default_rng(seed)) for k in range(least, min(most, len(x) - 1) + 1)]
            k = elbow([f[0] for f in fits], least, delta)
            labels = fits[k - least][1]
        first = {label: i for i, label in enumerate(dict.fromkeys(labels.tolist()))}
        out = pdf[[key, "chunk_idx"]].assign(cluster_id=[first[v] for v in labels.tolist()], k=k)
        return out.astype({"chunk_idx": "int32", "cluster_id": "int32", "k": "int32"}).join(pdf[carried])

    kind = lambda c: f"`{c}` {chunks.schema[c].dataType.simpleString()}"
    schema = ", ".join([kind(key), "chunk_idx int", "cluster_id int", "k int", *map(kind, carried)])
    return chunks.select(key, "chunk_idx", "mean", *[c for c in carried if c != "mean"]).groupBy(key).applyInPandas(one, schema)


def elbow_from(inertias: DataFrame, delta: float = 0.05) -> DataFrame:
    """(id, k) from (id, k, inertia): the elbow rule in expressions."""
    steps = inertias.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "inertia"))).alias("s"))
    weak = F.expr(f"filter(transform(sequence(1, greatest(size(s) - 1, 1)), i -> CASE WHEN i < size(s) AND s[i - 1].inertia - s[i].inertia < {delta}D * s[0].inertia THEN s[i - 1].k END), x -> x is not null)")
    return steps.select("id", F.coalesce(F.get(weak, F.lit(0)), F.expr("s[size(s) - 1].k")).alias("k"))


def build(labelled: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cluster_id, chunks, text, centroid) from (key, chunk_idx, cluster_id, sentences, mean): a cluster's
    members in order, their sentences as one text, and the mean of their vectors."""
    packed = labelled.groupBy(key, "cluster_id").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "sentences", "mean"))).alias("c"))
    text = F.expr("array_join(flatten(transform(c, x -> x.sentences)), ' ')")
    return packed.select(key, "cluster_id", F.expr("transform(c, x -> x.chunk_idx)").alias("chunks"), text.alias("text"), mean_of(F.expr("transform(c, x -> x.mean)")).alias("centroid"))


def cluster_texts(labelled: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cluster_id, text) from (key, chunk_idx, cluster_id, sentences): the sentences of a cluster's chunks in order."""
    packed = labelled.groupBy(key, "cluster_id").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "sentences"))).alias("c"))
    return packed.select(key, "cluster_id", F.expr("array_join(flatten(transform(c, x -> x.sentences)), ' ')").alias("text"))
