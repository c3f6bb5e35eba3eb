"""Every stage of the pipeline over nulls, empty texts, repeated rows, columns of clashing names and an empty table, against brute force."""

import hashlib
import random

import corpus_pipeline
import pytest

from .test_edges import WORD_BPE, brute_fingerprint, brute_substring, words

tokenizers = pytest.importorskip("tokenizers")
R = random.Random(41)
CLASHING = "_words int, _removed int, _spans string, _score double, _evidence int, _size int, _times int, fp int, component string, size int, row int, k int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
MORE = (1, 2, "s", 0.5, 3, 4, 5, 6, "c", 7, 8, 9)


def prose(n):
    return " ".join("".join(R.choice("abcdefgh") for _ in range(6)) for _ in range(n))


BASE, PASSAGE = prose(90), prose(30)
TEXTS = [(1, BASE), (2, BASE), (2, BASE), (3, None), (4, ""), (5, " \n"), (6, prose(40) + " " + PASSAGE), (7, PASSAGE + " " + prose(50)), (8, "word"), (None, prose(60)), (None, None), (9, prose(30000)), (10, prose(20))]
ROWS = [(i, t, None if k % 4 == 0 else "en", [None, "a", "b"][k % 3], None if t is None else len(t), *MORE) for k, (i, t) in enumerate(TEXTS)]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_toxicity(spark, docs, sf_dir):
    got = STAGES["toxicity"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert keyed(got.collect()) == keyed(ROWS)  # nothing here is toxic by those labels


def test_near_dedup(spark, docs, sf_dir):
    got = STAGES["simhash near-dedup"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    fp = [brute_fingerprint(r[1]) for r in ROWS]
    label = list(range(len(fp)))
    for _ in fp:
        for a, x in enumerate(fp):
            for b, y in enumerate(fp):
                if (x ^ y).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for r, c in zip(ROWS, label):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    assert keyed(got.collect()) == keyed(r for r, c in zip(ROWS, label) if r[0] is None or r[0] == least[c])


def test_substring(spark, docs, sf_dir):
    got = STAGES["substring dedup"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    rows = got.collect()
    digest = lambda t: hashlib.sha256(" ".join(words(t)).encode()).hexdigest()
    assert sorted(((r.doc_id, digest(r.text)) for r in rows), key=repr) == sorted(((x[0], x[3]) for x in brute_substring([r[:2] for r in ROWS])), key=repr)
    assert all(tuple(r)[5:] == MORE for r in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_mixing(spark, docs, sf_dir):
    got = STAGES["source mixing"](spark, docs, sf_dir).collect()
    assert {tuple(r) for r in got} <= set(ROWS)
    size = {s: sum(len(words(r[1])) for r in ROWS if r[3] == s) for s in (None, "a", "b")}
    weight = dict(zip(("a", "b", None), (5, 2, 1)))
    left, open_, target = 1.5 * sum(size.values()), set(size), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    for s in size:
        most = max(len(words(r[1])) for r in ROWS if r[3] == s)
        assert abs(sum(len(words(r.text)) for r in got if r.source == s) - target[s]) <= most / 2 + 1
    seen, have = {}, {}
    for r in got:
        seen[tuple(r)] = seen.get(tuple(r), 0) + 1
    for r in ROWS:
        have[r] = have.get(r, 0) + 1
    assert all(n <= 2 * have[r] for r, n in seen.items())


def test_encoding(spark, docs, sf_dir):
    import numpy as np

    t = tokenizers.Tokenizer.from_file(WORD_BPE)
    want = []
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], r[3], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert keyed(STAGES["bpe encoding"](spark, docs, sf_dir).collect()) == keyed(want)


def test_empty_table(spark, sf_dir):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, sf_dir)
        assert got.count() == 0 and (name == "bpe encoding" or got.columns == none.columns)
