"""Whole scores against brute force over all examples; what must not reach a score; calibration on held-out rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import toxicity

R = random.Random(31)
CLEAN = ["".join(R.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
BAD = ["vilest", "foulest", "grotty", "nastier", "cruddy", "meanest"]


def rows(n):
    out = []
    for i in range(n):
        t = [R.choice(CLEAN) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(R.randint(1, 4)):
                t[R.randrange(40)] = R.choice(BAD)
        if i % 17 == 0:
            t[0] = R.choice(BAD)  # some clean ones hold a bad word
        out.append((i, " ".join(t)))
    return out


def brute(model, text):
    """The vote over all examples, sorted by cosine, equal cosines sharing what is left of k."""
    v = lambda terms: {t: model.idf[t] for t in terms}
    dot = lambda a, b: sum(x * b.get(t, 0.0) for t, x in a.items())
    q = v(model.terms(text))
    if not q:
        return model.empty
    found = []
    for terms, y, _ in model.examples:
        e = v(terms)
        c = round(dot(q, e) / math.sqrt(dot(q, q) * dot(e, e)), 9)
        if c > 0:
            found.append((c, y))
    left, total, bad = model.k, 0.0, 0.0
    for c in sorted({c for c, _ in found}, reverse=True):
        alike = [y for d, y in found if d == c]
        n = min(left, len(alike))
        w = c / (1.05 - min(c, 1.0))
        total += n * w
        bad += n * w * sum(alike) / len(alike)
        left -= n
    return (bad + toxicity.SHRINK * model.prior) / (total + toxicity.SHRINK)


@pytest.fixture(scope="module")
def fitted(spark):
    data = rows(600)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in data[:500]], "doc_id long, toxic int")
    return data, docs, labels, toxicity.fit(docs, labels)


def test_scores_equal_brute_force(fitted):
    data, docs, _, model = fitted
    got = {r.doc_id: r._score for r in toxicity.score(docs, model).collect()}
    model.build()
    assert all(abs(got[i] - brute(model, t)) < 1e-6 for i, t in data)
    assert len(set(got.values())) > 20


def test_ids_and_order_change_no_score(spark, fitted):
    data, _, labels, model = fitted
    turned = [(i, t) for i, t in data]
    # the training rows' ids are dealt anew among ids of the same fold
    from zlib import crc32

    fold = lambda i: crc32(str(i).encode()) % 5 == 0
    seen = [i for i, _ in data[:500]]
    new = {}
    for f in (False, True):
        mine = [i for i in seen if fold(i) == f]
        new |= dict(zip(mine, mine[::-1]))
    docs = spark.createDataFrame([(new.get(i, i), t) for i, t in turned][::-1], "doc_id long, text string").repartition(2)
    other = toxicity.fit(docs, spark.createDataFrame([(new[i], int(i % 4 == 0)) for i in seen], "doc_id long, toxic int"))
    a, b = ({t: m.build().score(t)[0] for _, t in data} for m in (model, other))
    assert all(abs(a[t] - b[t]) < 1e-12 for t in a)


def test_held_out_rows_are_calibrated(fitted):
    data, docs, labels, model = fitted
    held = toxicity.score(docs, model).filter(toxicity.held_out(F.col("doc_id")))
    c = toxicity.calibration(held, labels).collect()
    n = sum(r.n for r in c)
    assert n > 80 and sum(r.n * r.brier for r in c) / n < 0.1
    assert sum(r.n * abs(r.score - r.share) for r in c) / n < 0.15
    assert toxicity.calibration(held.limit(0), labels).count() == 0
