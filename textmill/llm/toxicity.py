"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is read in folded lower case as the set of its byte n-grams (several lengths), hashed to
2 ** BITS features. A feature's scale is r = log(p / q), with p and q its smoothed share of
the toxic and of the other training texts; a regularised logistic regression is then
trained on the scaled features. Features seen in fewer than MIN_TEXTS training texts are
dropped. The score is the logistic of bias + sum of the weights of the n-grams present.

Training reads a bounded sample of the labelled texts, whole: of each label about SAMPLE texts,
those with the lowest hash of their id. The bias is shifted by the log of the two labels' sampling
rates, so that the score keeps the labels' natural share at any size. They are written once; tasks count their features slice by slice and sum the counts by RANGES of
features, then list the wanted features of each text, and one task fits the weights to
these lists. No task holds more text than a slice or a single text. The model has at most 2 ** BITS
weights and is broadcast. Scoring reads every text whole, with no shuffle.

Nulls: a null text is an empty one and gets the bias alone; rows without a label or an id
are not trained on. A repeated id trains with each of its texts, a repeated label once, and
labels that contradict each other with both. Without examples of both classes the score is the share
of toxic examples (0 without any). Other columns are never read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import materialise, scratch

BITS, LENGTHS, SAMPLE, MIN_TEXTS, RANGES = 22, (3, 5, 7, 9), 2000, 6, 64
RIDGE, STEPS, ALPHA, LEAST_RATIO = 2.0, 300, 1.0, 1.5


def _clean(column) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with every white space and punctuation mark as one space, and a space before
    and after each text, so that word ends show in n-grams."""
    data, off = textbuf.buffer(column)
    data = textbuf.fold(data)
    letter = np.zeros(256, bool)
    letter[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    is_letter = letter[data]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first mark after a letter
    full = off[:-1] < off[1:]
    keep[off[:-1][full]] |= True
    kept = np.flatnonzero(keep)
    sizes = np.searchsorted(kept, off)
    out = np.full(len(kept) + 2 * (len(off) - 1), 0x20, np.uint8)
    doc = np.searchsorted(off, kept, "right") - 1
    out[np.arange(len(kept)) + 2 * doc + 1] = np.where(is_letter[kept], data[kept], 0x20)
    return out, sizes + 2 * np.arange(len(off))


def _features(column, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and features, each pair once; only features marked in ``wanted``."""
    data, off = _clean(column)
    sums = textbuf.RangeHash(data, 5)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keys = []
    for n in LENGTHS:
        start = np.arange(max(0, len(data) - n + 1))
        hashed = sums(start, start + n) >> np.uint64(64 - BITS)
        good = doc[start] == doc[start + n - 1]
        if wanted is not None:
            good &= wanted[hashed]
        keys.append((doc[start[good]].astype(np.uint64) << np.uint64(BITS)) | hashed[good])
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _parts(batches):
    for batch in batches:
        for part in textbuf.slices(batch, "text"):
            yield part, part.column("toxic").to_numpy(zero_copy_only=False)


COUNTED = "range int, clean binary, toxic binary, n_clean long, n_toxic long"


def _counter(batches):
    """For each range of features the numbers of clean and of toxic texts that have them."""
    seen, texts = np.zeros((2, 1 << BITS), np.int32), [0, 0]
    for part, toxic in _parts(batches):
        row, feature = _features(part.column("text"))
        for label in (0, 1):
            seen[label] += np.bincount(feature[toxic[row] == label], minlength=1 << BITS).astype(np.int32)
            texts[label] += int(np.count_nonzero(toxic == label))
    for i, (clean, toxic) in enumerate(zip(seen[0].reshape(RANGES, -1), seen[1].reshape(RANGES, -1), strict=True)):
        yield pa.RecordBatch.from_pydict({"range": pa.array([i], pa.int32()), "clean": [clean.tobytes()], "toxic": [toxic.tobytes()], "n_clean": [texts[0]], "n_toxic": [texts[1]]})


def _ratios(counts: pa.Table) -> pa.Table:
    """The wanted features of a range and their log-count ratios."""
    seen = [np.sum([np.frombuffer(x, np.int32) for x in counts.column(c).to_pylist()], axis=0) for c in ("clean", "toxic")]
    texts = [sum(counts.column(c).to_pylist()) for c in ("n_clean", "n_toxic")]
    p, q = ((ALPHA + seen[label]) / (2 * ALPHA + texts[label]) for label in (1, 0))
    ratio = np.log(p / q)
    used = np.flatnonzero((seen[0] + seen[1] >= MIN_TEXTS) & (np.abs(ratio) > LEAST_RATIO))  # the others move no score by much
    first = counts.column("range")[0].as_py() * ((1 << BITS) // RANGES)
    return pa.table({"feature": pa.array(used + first, pa.int64()), "ratio": pa.array(ratio[used])})


def _lister(used: np.ndarray):
    """Each text's wanted features, as places in ``used``."""
    wanted = np.zeros(1 << BITS, bool)

    def run(batches):
        wanted[used] = True
        for part, _ in _parts(batches):
            row, feature = _features(part.column("text"), wanted)
            at = np.searchsorted(used, feature).astype(np.int32)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), textbuf.binary([at[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])], ["doc_id", "toxic", "places"])

    return run


def optimise(row: np.ndarray, at: np.ndarray, toxic: np.ndarray, ratio: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights (scales included) and bias of the logistic regression on the pairs of text and feature."""
    n, k, share = len(toxic), len(ratio), float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(k), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    # the last column is the bias, which is not regularised
    row, at, values = np.append(row, np.arange(n)), np.append(at, np.full(n, k)), np.append(ratio[at], np.ones(n))
    penalty = np.append(np.full(k, ridge), 0.0)
    along = np.ones(k + 1)
    for _ in range(15):  # the largest curvature, by power iteration
        along = np.bincount(at, np.bincount(row, along[at] * values, n)[row] * values, k + 1)
        curve = np.linalg.norm(along)
        along /= curve
    step = 1 / (0.3 * curve + ridge)
    weights = np.append(np.zeros(k), np.log(share / (1 - share)))
    before = weights
    for i in range(1, STEPS + 1):  # accelerated gradient descent on the logistic loss
        w = weights + (i - 1) / (i + 2) * (weights - before)
        miss = 1 / (1 + np.exp(-np.bincount(row, w[at] * values, n))) - toxic
        before = weights
        weights = w - step * (np.bincount(at, miss[row] * values, k + 1) + penalty * w)
    return weights[:k] * ratio, float(weights[k])


def _trainer(ratio: np.ndarray):
    def run(batches):
        toxic, places = [np.zeros(0)], [np.zeros(0, np.int32)]
        for batch in batches:
            toxic.append(batch.column("toxic").to_numpy(zero_copy_only=False))
            places += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("places")]
        row = np.repeat(np.arange(len(places) - 1), [len(x) for x in places[1:]])
        weights, bias = optimise(row, np.concatenate(places), np.concatenate(toxic), ratio)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, np.arange(len(ratio))), pa.int64()), pa.array(np.append(bias, weights))], ["place", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights and the bias, from (doc_id, text) and (doc_id, toxic)."""
    with scratch(docs.sparkSession):
        return _fitted(docs, labels)


def _fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    order = F.xxhash64("doc_id")
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").distinct()
    # the hash bound that leaves about SAMPLE of each label, without ordering all in one task
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bound = F.lit(0.0)
    rates = {label: min(1.0, SAMPLE / n) for label, n in counts.items()}
    for label, rate in rates.items():
        bound = F.when(F.col("toxic") == label, rate).otherwise(bound)
    shift = float(np.log(rates.get(0, 1.0) / rates.get(1, 1.0))) if len(rates) > 1 else 0.0
    few = known.where((order.cast("double") / 2.0**64 + 0.5) <= bound)
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")
    rows = materialise(rows.select("doc_id", F.col("toxic").cast("long").alias("toxic"), F.coalesce("text", F.lit("")).alias("text")))
    found = rows.mapInArrow(_counter, COUNTED).groupBy("range").applyInArrow(_ratios, "feature long, ratio double").toPandas().sort_values("feature")
    used, ratio = found.feature.to_numpy(np.int64), found.ratio.to_numpy(float)
    lists = rows.mapInArrow(_lister(used), "doc_id long, toxic long, places binary")
    model = lists.repartition(1).sortWithinPartitions("doc_id", "places").mapInArrow(_trainer(ratio), "place long, weight double").toPandas().sort_values("place")
    if not len(model):  # no texts, so no task
        return used, np.zeros(len(used)), optimise(used, used, np.zeros(0), ratio)[1]
    return used, model.weight.to_numpy(float)[1:], float(model.weight.iloc[0]) + shift


def _scorer(model):
    def run(batches):
        used, weights, bias = model.value
        table, wanted = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool)
        table[used], wanted[used] = weights, True
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                row, feature = _features(batch.column("text"), wanted)
                z = bias + np.bincount(row, table[feature], batch.num_rows)
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(score, 6))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, score double")
