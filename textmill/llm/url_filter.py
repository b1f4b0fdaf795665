"""URL filter: rules first, else a character language-model ratio. DataFrame operations only.

Two smoothed variable-order Markov models, one of the URLs that the rules allow and
one of those that they block, score each other URL. A model of order k backs off by

    p_k(c | context) = (n(context c) + S p_{k-1}(c | shorter context)) / (n(context) + S),

down to a uniform distribution over the symbols; each context length that was seen
adds its share, so the order varies with what was seen. The score is the mean over
the URL's symbols of log p_accepted - log p_rejected. The threshold is calibrated on
a fold of the ruled URLs that the models have not seen: the cut with the highest mean
of the two classes' hit rates.

URLs are read over 42 symbols: a-z, one digit class, thirteen marks and one for the
rest. Each distinct URL is counted and scored once. Only distinct symbol windows get a ratio; a window table of at most
BROADCAST_WINDOWS rows is broadcast (its size is counted first), and a URL's windows are summed where they are made;
with a larger one a row of two hashes and a window is shuffled for each symbol of a distinct URL,
but for the windows that are so common that they are broadcast in any case. Scores go back to the rows by the URL's hashes.

Null or malformed URLs have an empty host and path and no rule; the method still judges
them, but a null or empty URL says nothing: it scores 0 and is allowed. Without ruled URLs of both kinds
in the fold for calibration every other verdict is allow too. A score at the cut is allowed.
Repeated rows are judged alike; other columns are ignored.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise, scratch

#: (host, path, verdict); the longest rule that fits wins.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER, STRENGTH, BROADCAST_WINDOWS, STEPS, SHORT = 4, 2.0, 400_000, 100, 2
MARKS = ":/.?#=&-_%~+"
SYMBOLS = 42
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _ruled(df: DataFrame, rules) -> DataFrame:
    host, path = host_path(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("ruled", verdict)


def _symbols(url: Column) -> Column:
    """The URL as symbols, with ORDER start marks and an end mark around it."""
    text = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    text = F.regexp_replace(text, "[^a-z0-9:/.?#=&_%~+-]", "*")
    return F.concat(F.lit("^" * ORDER), F.translate(text, "123456789", "000000000"), F.lit("$"))


def _windows(df: DataFrame) -> DataFrame:
    """One row per symbol: the window of ORDER + 1 symbols that ends at it."""
    at = F.explode(F.sequence(F.lit(1), F.length("symbols") - ORDER)).alias("at")
    return df.where(F.length("symbols") > ORDER).select("*", at).withColumn("window", F.expr(f"substring(symbols, at, {ORDER + 1})"))


def _log_ratios(windows: DataFrame, counted: DataFrame) -> DataFrame:
    """(window, ratio) for distinct ``windows``; counted: (window, good, bad)."""
    part = F.explode(F.expr(f"transform(sequence(0, {ORDER}), k -> struct(substring(window, {ORDER} - k + 1, k + 1) AS gram, k AS size))"))
    grams = counted.select("good", "bad", part.alias("g")).groupBy("g.gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    grams = materialise(grams)
    context = grams.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("gram")).agg(F.sum("good").alias("good_after"), F.sum("bad").alias("bad_after"))
    seen = materialise(grams.join(context, "gram", "full_outer").na.fill(0))
    need = F.explode(F.expr(f"""flatten(transform(sequence(0, {ORDER}), k -> array(
        struct(substring(window, {ORDER} - k + 1, k + 1) AS gram, k AS size, true AS whole),
        struct(substring(window, {ORDER} - k + 1, k) AS gram, k AS size, false AS whole))))"""))
    rows = windows.select("window", need.alias("n")).select("window", F.col("n.gram").alias("gram"), "n.size", "n.whole")
    # a gram of three symbols or more is sought by a few thousand windows at most, a shorter one by up
    # to all of them; there are fewer than 2,000 of the latter, which are broadcast
    is_short = F.length("gram") <= SHORT
    rows = rows.where(is_short).join(F.broadcast(seen.where(is_short)), "gram", "left").unionByName(rows.where(~is_short).join(seen.where(~is_short), "gram", "left"))
    picked = []
    for k in range(ORDER + 1):
        for kind in ("good", "bad"):
            is_k = F.col("size") == k
            picked += [F.max(F.when(is_k & F.col("whole"), F.col(kind))).alias(f"{kind}_{k}"), F.max(F.when(is_k & ~F.col("whole"), F.col(f"{kind}_after"))).alias(f"{kind}_of_{k}")]
    wide = rows.groupBy("window").agg(*picked).na.fill(0)
    logs = {}
    for kind in ("good", "bad"):
        p = F.lit(1.0 / SYMBOLS)
        for k in range(ORDER + 1):
            p = (F.col(f"{kind}_{k}") + STRENGTH * p) / (F.col(f"{kind}_of_{k}") + STRENGTH)
        logs[kind] = F.log(p)
    return wide.select("window", (logs["good"] - logs["bad"]).alias("ratio"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``."""
    with scratch(pages.sparkSession) as keep:
        return _judged(keep, pages, rules)


def _judged(keep: Callable[[DataFrame], DataFrame], pages: DataFrame, rules) -> DataFrame:
    df = _ruled(pages.select("page_id", "url"), rules)
    raw = F.coalesce("url", F.lit(""))
    df = df.withColumn("fold", F.when(F.col("ruled").isNotNull(), F.pmod(F.crc32(raw), F.lit(5)))).withColumns({"h1": F.xxhash64(raw), "h2": F.xxhash64(F.lit(7), raw)})
    urls = df.groupBy("h1", "h2").agg(F.first(_symbols(F.col("url"))).alias("symbols"), F.first("ruled").alias("ruled"), F.first("fold").alias("fold"), F.count("*").alias("n"))
    urls = materialise(urls)
    fresh = lambda verdict: F.sum(F.when((F.col("ruled") == verdict) & (F.col("fold") > 0), F.col("n")).otherwise(0))
    counted = materialise(_windows(urls.drop("h1", "h2")).groupBy("window").agg(fresh("allow").alias("good"), fresh("block").alias("bad"), F.count("*").alias("n")))
    ratios = materialise(_log_ratios(counted.select("window"), counted.where("good + bad > 0").drop("n")))

    rows = _windows(urls.select("h1", "h2", "symbols")).select("h1", "h2", "window")
    if ratios.count() <= BROADCAST_WINDOWS:
        rows = rows.join(F.broadcast(ratios), "window")
    else:
        rows = join_hot(rows, ratios, counted, counted.agg(F.sum("n")).first()[0] or 0, "window")
    scores = rows.groupBy("h1", "h2").agg(F.round(F.avg("ratio"), 9).alias("score"))
    scores = materialise(urls.select("h1", "h2", "n").join(scores, ["h1", "h2"]))
    blank = raw == ""
    scored = join_hot(df.select("page_id", "host", "path", "rule", "ruled", "fold", "h1", "h2", blank.alias("blank")), scores, scores, scores.agg(F.sum("n")).first()[0] or 0, "h1", "h2")
    scored = keep(materialise(scored.withColumn("score", F.when(F.col("blank"), 0.0).otherwise(F.col("score"))).drop("h1", "h2")))

    one = lambda verdict: F.sum((F.col("ruled") == verdict).cast("long"))
    bins = scored.where("fold = 0").groupBy(F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "score")) * STEPS).cast("long").alias("bin")).agg(one("allow").alias("good"), one("block").alias("bad"))
    least = _cut([(r["bin"], r["good"], r["bad"]) for r in bins.collect()])  # at most 40 * STEPS + 1 bins
    verdict = F.coalesce("ruled", F.when(F.lit(least is None) | F.col("blank") | (F.col("score") >= F.lit(least)), "allow").otherwise("block"))
    return scored.withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "score")


def _cut(bins: list[tuple[int, int, int]]) -> float | None:
    """The score from which a URL is accepted; None if a class has no examples."""
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return None
    bins = sorted(bins)
    rejected, missed, best = 0, 0, (1.0, bins[0][0] - 0.5)
    for (at, g, b), after in zip(bins, [*bins[1:], (bins[-1][0] + 1, 0, 0)], strict=True):
        missed, rejected = missed + g, rejected + b
        best = max(best, ((good - missed) / good + rejected / bad, (at + after[0]) / 2))
    return best[1] / STEPS
