"""Quality rules combined by weak supervision. DataFrame operations only.

Each rule looks at a few features of the whole text and votes good (+1), bad (-1) or
abstains (0). A document's class is hidden; each rule has chances of its own to vote
either way or to abstain, for each class. Expectation-maximisation over the counts of
vote patterns (at most 3 ** number of rules, whatever the corpus) estimates these
accuracies and the share of good documents; the posterior probability of good decides. Base limits come first: a document that fails them
is never kept.

Words are runs without the space and the bytes 0x09 to 0x0D. A word counts as repeated if it
lies in a five-word window that occurs twice or more in the text; windows are compared by
64-bit hashes of their words. Everything is computed in the row of the document, with no
shuffle but that of the pattern counts.

Nulls: a null text counts as empty, fails the base limits and has a posterior like any
other row. An empty table has no patterns; the start values stand. Repeated rows are
judged alike. Other columns pass through ``keep_good`` unchanged.
"""

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, set_apart

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: EM starts from this share of good documents and these chances of each vote, in good and in
#: bad documents; no chance, nor the share, leaves (LEAST, 1 - LEAST), so that no logarithm is of 0.
PRIOR, START = 0.85, {1: (0.6, 0.3), -1: (0.05, 0.35), 0: (0.35, 0.35)}
ROUNDS, LEAST, THRESHOLD = 300, 0.01, 0.5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"


def _dropped(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the feature columns; words and windows stay inside the row."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_t", t)
    df = df.withColumn("_words", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    # an empty list unless there are five words
    df = df.withColumn("_hash", F.expr("""CASE WHEN size(_words) < 5 THEN array() ELSE
        transform(sequence(1, size(_words) - 4), i -> xxhash64(_words[i - 1], _words[i], _words[i + 1], _words[i + 2], _words[i + 3])) END"""))
    # sorted (hash, place) pairs; a place is kept if a neighbour has the same hash
    df = df.withColumn("_pairs", F.expr("CASE WHEN size(_hash) > size(array_distinct(_hash)) THEN sort_array(transform(_hash, (h, i) -> struct(h, i))) END"))
    df = df.withColumn("_places", F.expr("""CASE WHEN _pairs IS NULL THEN array() ELSE array_sort(transform(filter(
        transform(_pairs, (p, j) -> struct(p.i AS i, (j > 0 AND _pairs[greatest(j - 1, 0)].h = p.h) OR (j < size(_pairs) - 1 AND _pairs[least(j + 1, size(_pairs) - 1)].h = p.h) AS twice)), p -> p.twice), p -> p.i)) END"""))
    rep = F.expr("coalesce(aggregate(transform(_places, (p, j) -> CASE WHEN j = size(_places) - 1 THEN 5 ELSE least(5, _places[j + 1] - p) END), 0L, (a, x) -> a + x), 0L)")
    chars = F.length(F.translate("_t", SPACE, "")).cast("long")
    return df.select(
        *[docs[c] for c in docs.columns], F.size("_words").cast("long").alias("n_words"), chars.alias("word_chars"), _dropped(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), rep.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"), F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"), _dropped(F.col("_t"), _UPPER).alias("n_upper"),
        _dropped(F.col("_t"), "0123456789").alias("n_digits"), _dropped(F.col("_t"), "!").alias("n_bang"),
        F.monotonically_increasing_id().alias("_row"),  # keeps the optimiser from repeating all this in a filter pushed below
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """name -> +1, -1 or 0, from the feature columns."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))

    def vote(bad: Column, good: Column | None = None) -> Column:
        votes = F.when(bad, -1)
        return (votes if good is None else votes.when(good, 1)).otherwise(0)

    mean = F.col("word_chars") / n
    return {
        "length": vote(F.col("n_words") < 5, F.col("n_words").between(40, 20_000)),
        "word_length": vote((mean > 7.0) | (mean < 3.0), mean.between(4.2, 6.5)),
        "symbols": vote(F.col("n_symbols") > 0.1 * n),
        "repeated_lines": vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "repeated_windows": vote(F.col("n_repeat_words") > 0.3 * n),
        "upper_case": vote(F.col("n_upper") > 0.3 * chars),
        "exclamations": vote(F.col("n_bang") > 0.5 * n),
        "digits": vote(F.col("n_digits") > 0.4 * chars),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], m: int) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Share of good documents and, for each rule and vote, its chance in good and in bad
    documents. Each step weights the patterns by their posteriors."""
    prior, table = PRIOR, [START] * m
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        good = [n * posterior(p, prior, table) for p, n in patterns]
        was, prior = prior, min(1 - LEAST, max(LEAST, sum(good) / total))
        new = []
        for j in range(m):
            of = {v: [1.0, 1.0] for v in START}  # one pseudo vote of each kind
            for (p, n), x in zip(patterns, good, strict=True):
                of[p[j]][0] += x
                of[p[j]][1] += n - x
            sums = [sum(x[k] for x in of.values()) for k in (0, 1)]
            new.append({v: tuple(min(1 - LEAST, max(LEAST, x[k] / sums[k])) for k in (0, 1)) for v, x in of.items()})
        table = new
        if abs(was - prior) < 1e-9:
            break
    return prior, table


def posterior(pattern: tuple[int, ...], prior: float, table) -> float:
    z = log(prior / (1 - prior)) + sum(log(table[j][v][0] / table[j][v][1]) for j, v in enumerate(pattern))
    return 1 / (1 + exp(-z)) if z > -500 else 0.0


def _voted(df: DataFrame) -> DataFrame:
    return df.withColumns({f"v_{k}": v for k, v in votes().items()})


def learn(featured: DataFrame) -> tuple[float, list]:
    names = [f"v_{k}" for k in votes()]
    counts = _voted(featured).groupBy(*names).count().collect()  # at most 3 ** len(names) rows
    return fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counts), len(names))


def probability(model) -> Column:
    """Posterior as an expression over the feature columns."""
    prior, table = model
    z = F.lit(log(prior / (1 - prior)))
    for (_, v), row in zip(votes().items(), table, strict=True):
        z = z + F.when(v == 1, log(row[1][0] / row[1][1])).when(v == -1, log(row[-1][0] / row[-1][1])).otherwise(log(row[0][0] / row[0][1]))
    return 1 / (1 + F.exp(-z))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, features, base_failed, quality, kept) for every row of ``docs``."""
    featured = materialise(with_features(docs.select("doc_id", "text")).drop("text", "_row"))
    p = F.round(probability(learn(featured)), 6)
    return featured.withColumn("base_failed", base_failed()).withColumn("quality", p).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept. Features are computed once and written with the rows; the
    model reads only their columns back."""
    docs, restored = set_apart(docs, "doc_id", "text")
    featured = materialise(with_features(docs).drop("_row"))
    return restored(featured.where(~base_failed() & (F.round(probability(learn(featured)), 6) >= THRESHOLD)))
