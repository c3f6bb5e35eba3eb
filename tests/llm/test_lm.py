import math
import re
import zlib
from collections import Counter, defaultdict

from fathomgrid.llm import lm

TEXTS = ["the cat sat on the mat", "The cat ate", "", None, "a dog sat on\tthe  cat", "the cat sat on the mat", "new words only here", "on the mat the dog ate the cat\nthe end"]


def brute(train, texts):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 0]
    big = Counter()
    for t in train:
        w = words(t)
        big.update(zip([None, *w], w))
    uni, follows, ctx = Counter(), Counter(), defaultdict(list)
    for (v, w), c in big.items():
        uni[w] += c
        follows[w] += 1
        ctx[v].append(c)
    n, size = sum(uni.values()), len(uni)

    def cut(counts):
        k = [sum(c == i for c in counts) for i in range(1, 5)]
        return lm.discounts(*k)

    d2, d1 = cut(big.values()), cut(follows.values())
    total = sum(follows.values())
    back = sum(d1[min(c, 3)] for c in follows.values()) / total

    def p(v, w):
        low = max(follows[w] - d1[min(follows[w], 3)], 0) / total + back / (size + 1)
        if v not in ctx:
            return low
        c = big[v, w]
        return (max(c - d2[min(c, 3)], 0) + sum(d2[min(x, 3)] for x in ctx[v]) * low) / sum(ctx[v])

    for v in [None, "the", "zzz", *list(ctx)[:3]]:
        assert abs(sum(p(v, w) for w in uni) + p(v, "unseen word") - 1) < 1e-9
    for t in texts:
        w = words(t)
        yield len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (size + 1))) for x in w), sum(math.log10(p(v, x)) for v, x in zip([None, *w], w))


def test_scores_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, score long")
    model = lm.fit(docs.filter("doc_id <> 1 and doc_id <> 6").repartition(3))
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    want = brute([t for i, t in enumerate(TEXTS) if i not in (1, 6)], TEXTS)
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r._n_tokens, r._n_known, r._train_tokens, r.score) == (n, known, total, i)
        assert abs(r._base_score - base) < 1e-9 and abs(r._score - score) < 1e-9


def test_query_learns_and_holds_out(spark, sf_dir):
    rows = lm.op6_kneser_ney(spark, sf_dir).collect()
    assert len(rows) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    seen, held = ([r for r in rows if r.held_out == x] for x in (False, True))
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score for r in seen) / sum(r.n_tokens for r in seen) > sum(r.score for r in held) / sum(r.n_tokens for r in held)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm.fit(none)
    assert lm.score(none, model).count() == 0
    (r,) = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()
    assert r._n_tokens == 3 and r._n_known == 0 and r._score == 0
