"""Plain versions of the operators, for comparison on small inputs."""

import re
from collections import Counter, defaultdict
from math import log
from zlib import crc32


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def shingle_counts(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in x if i in y)


def classes(rows, threshold=0.8):
    """doc_id -> smallest doc_id of its class, for (doc_id, text) rows."""
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def top(t):
        while parent[t] != t:
            t = parent[t]
        return t

    counts = {t: shingle_counts(t) for t in texts}
    holders = defaultdict(list)
    for t in texts:
        near = Counter(o for g in counts[t] for o in holders[g])
        for o in near:
            if jaccard(counts[t], counts[o]) >= threshold - 1e-12:
                parent[top(t)] = top(o)
        for g in counts[t]:
            holders[g].append(t)
    least = {}
    for i, t in rows:
        k = top(t or "")
        least[k] = min(i, least.get(k, i))
    return {i: least[top(t or "")] for i, t in rows}


def quality_features(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\n\x0b\x0c")]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def kept_bytes(texts, length=200):
    """(number of removed bytes, number of spans, remaining bytes) of each text."""
    out = []
    for t, gone in zip(texts, gone_bytes(texts, length), strict=True):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(x for x, g in zip((t or "").encode(), gone, strict=True) if not g)))
    return out


def kept_text(text, gone):
    """The characters of a text none of whose bytes is removed; gone: removed flags of its bytes."""
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not any(gone[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def gone_bytes(texts, length=200):
    """For each text, a flag for each byte: whether a repeated string covers it."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def plain(text):
    return re.findall(r"[a-z0-9\u0080-\U0010FFFF]+", (text or "").casefold())


def grams(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def leaks(docs, items):
    """(doc_id, item_id) where enough of the five-word shingles of an item are in the text."""
    out = set()
    have = {i: grams(plain(t)) for i, t in docs}
    for j, t in items:
        w = plain(t)
        half = -(-len(w) // 2)
        parts, every = [p for p in (grams(w[:half]), grams(w[half:])) if p], grams(w)
        for i, g in have.items():
            share = [len(p & g) / len(p) for p in parts]
            if parts and (min(share) >= 0.8 or (min(share) >= 0.3 and len(every & g) >= 0.8 * len(every))):
                out.add((i, j))
    return out


def bm25(items, k1=1.2, b=0.75):
    """A function of an item's number and a set of words: the item's score as a share of that with its own words."""
    words = [Counter(plain(t)) for t in items]
    n, mean = len(items), sum(c.total() for c in words) / len(items)
    df = Counter(w for c in words for w in c)
    weight = [{w: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * c.total() / mean)) for w, f in c.items()} for c in words]
    return lambda i, said: sum(x for w, x in weight[i].items() if w in said) / sum(weight[i].values())


def url_scores(urls, ruled, order=4, strength=2.0, symbols=42):
    """The mean log ratio of each URL by two back-off models, one of the allowed and one of the
    blocked URLs outside the fold for calibration."""

    def read(u):
        u = "".join(c.lower() if "A" <= c <= "Z" else c for c in u or "")
        u = re.sub("[1-9]", "0", re.sub("[^a-z0-9:/.?#=&_%~+-]", "*", u))
        return "^" * order + u + "$"

    counts = {}
    for kind in ("allow", "block"):
        n = counts[kind] = Counter()
        for u, r in zip(urls, ruled, strict=True):
            if r == kind and crc32((u or "").encode()) % 5:
                s = read(u)
                for i in range(order, len(s)):
                    for k in range(order + 1):
                        n[s[i - k : i + 1]] += 1
                        n[s[i - k : i], "after"] += 1

    def chance(n, s, i):
        p = 1 / symbols
        for k in range(order + 1):
            p = (n[s[i - k : i + 1]] + strength * p) / (n[s[i - k : i], "after"] + strength)
        return p

    out = []
    for u in urls:
        s = read(u)
        parts = [log(chance(counts["allow"], s, i)) - log(chance(counts["block"], s, i)) for i in range(order, len(s))]
        out.append(sum(parts) / len(parts) if u else 0.0)
    return out


def url_cut(scores, ruled, urls, steps=100):
    """The cut with the highest mean of the two hit rates in the fold for calibration, by trying each."""
    rows = [(round(max(-20.0, min(20.0, x)) * steps), r) for x, r, u in zip(scores, ruled, urls, strict=True) if r and not crc32((u or "").encode()) % 5]
    kinds = Counter(r for _, r in rows)
    if len(kinds) < 2:
        return None
    at = sorted({b for b, _ in rows})
    places = [at[0] - 0.5] + [(a + b) / 2 for a, b in zip(at, [*at[1:], at[-1] + 1], strict=True)]
    rate = lambda c: sum(1 / kinds[r] for b, r in rows if (b >= c) == (r == "allow"))
    return max(places, key=lambda c: (round(rate(c), 9), c)) / steps


def quality_votes(text):
    """The votes of the rules on a text, in the order of their definition."""
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if x.strip(" \t\r\n\x0b\x0c")]
    n, chars = max(1, len(w)), max(1, sum(map(len, w)))
    repeated, symbols = quality_features(text)[4], quality_features(text)[2]
    mean = sum(map(len, w)) / n
    upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ" for c in text)
    bad = [len(w) < 5, mean > 7 or mean < 3, symbols > 0.1 * n, len(lines) - len(set(lines)) > 0.3 * len(lines), repeated > 0.3 * n, upper > 0.3 * chars, text.count("!") > 0.5 * n, sum(c in "0123456789" for c in text) > 0.4 * chars]
    good = [40 <= len(w) <= 20_000, 4.2 <= mean <= 6.5, *[False] * 6]
    return tuple(-1 if b else 1 if g else 0 for b, g in zip(bad, good, strict=True))


def em_posteriors(votes, prior, start, rounds=300, least=0.01):
    """Posterior probabilities of good, by expectation-maximisation over single documents."""
    import numpy as np

    v = np.array(votes)
    chance = {k: {x: [start[x][k]] * v.shape[1] for x in (1, 0, -1)} for k in (0, 1)}  # 0: in good documents

    def posteriors():
        like = []
        for k, share in ((0, prior), (1, 1 - prior)):
            z = np.full(len(v), np.log(share))
            for j in range(v.shape[1]):
                for x in (1, 0, -1):
                    z[v[:, j] == x] += np.log(chance[k][x][j])
            like.append(z)
        return 1 / (1 + np.exp(like[1] - like[0]))

    for _ in range(rounds):
        p = posteriors()
        was, prior = prior, min(1 - least, max(least, p.mean()))
        for k, weight in ((0, p), (1, 1 - p)):
            for j in range(v.shape[1]):
                sums = {x: 1.0 + weight[v[:, j] == x].sum() for x in (1, 0, -1)}
                for x in (1, 0, -1):
                    chance[k][x][j] = min(1 - least, max(least, sums[x] / sum(sums.values())))
        if abs(was - prior) < 1e-9:
            break
    return posteriors()
