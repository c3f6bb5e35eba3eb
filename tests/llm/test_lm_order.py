"""The model of order three against brute force."""

import math
import re
from collections import Counter, defaultdict

from fathomgrid.llm import lm

from .test_lm import TEXTS


def brute(train, texts):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 0]
    grams = lambda w: list(zip([None, None, *w], [None, *w], w))
    tri, big, uni, times = Counter(), Counter(), Counter(), Counter()
    for t in train:
        tri.update(grams(words(t)))
        times.update(words(t))
    for (_, v, w), c in tri.items():
        big[v, w] += c if v is None else 1
    uni.update(w for _, w in big)
    d1, d2, d3 = (lm.discounts(*(sum(c == k for c in x.values()) for k in (1, 2, 3, 4))) for x in (uni, big, tri))
    context = defaultdict(list)
    for (u, v, w), c in tri.items():
        context[u, v].append(c)
    for (v, w), c in big.items():
        context[v].append(c)
    total, size = sum(uni.values()), len(uni)

    def level(c, counts, d, low):
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in counts) * low) / sum(counts) if counts else low

    def p(u, v, w):
        low = max(uni[w] - d1[min(uni[w], 3)], 0) / total + sum(d1[min(c, 3)] for c in uni.values()) / total / (size + 1)
        low = level(big[v, w], context.get(v), d2, low)
        return level(tri[u, v, w], context.get((u, v)), d3, low)

    for u, v in [(None, None), ("the", "cat"), ("zzz", "the")]:
        assert abs(sum(p(u, v, w) for w in uni) + p(u, v, "unseen word") - 1) < 1e-9
    n = sum(times.values())
    for t in texts:
        w = words(t)
        yield sum(math.log10((times[x] + 0.5) / (n + 0.5 * (size + 1))) for x in w), sum(math.log10(p(*g)) for g in grams(w))


def test_trigrams_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = lm.fit(docs.filter("doc_id <> 1 and doc_id <> 6").repartition(3), order=3)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    for i, (base, score) in enumerate(brute([t for i, t in enumerate(TEXTS) if i not in (1, 6)], TEXTS)):
        assert abs(got[i]._base_score - base) < 1e-9 and abs(got[i]._score - score) < 1e-9
