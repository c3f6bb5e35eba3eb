"""Discounts by hand, spread contexts, words that share a hash, arrays that are missing."""

import glob
import os
import tempfile

import numpy as np
import pyarrow as pa
import pytest

from fathomgrid.llm import lm

from .test_lm import TEXTS
from .test_lm_order import brute


def test_discounts_by_the_published_formula():
    n1, n2, n3, n4 = 1000, 400, 200, 120
    y = 1000 / 1800
    want = [0, 1 - 2 * y * 400 / 1000, 2 - 3 * y * 200 / 400, 3 - 4 * y * 120 / 200]
    assert np.allclose(lm.discounts(n1, n2, n3, n4), want)
    assert all(0 <= d <= k for n in [(0, 0, 0, 0), (5, 0, 0, 0), (1, 9, 9, 9), (3, 1, 7, 0)] for k, d in enumerate(lm.discounts(*n)))


@pytest.mark.parametrize("many", [0, 2, 4, 10**9])
def test_spread_contexts_change_nothing(many, monkeypatch):
    """Whatever counts as a frequent word, down to every word and none."""
    monkeypatch.setattr(lm, "frequent_from", lambda words, buckets: many)
    train = [t for i, t in enumerate(TEXTS) if i not in (1, 6)]
    model = in_process(train)
    for t, (base, score) in zip(TEXTS, brute(train, TEXTS)):
        h, g, token, n = lm.tokens_of(*text_block(t))
        _, b, p = model.logs(h, g, token, n)
        assert abs(b.sum() - base) < 1e-9 and abs(p.sum() - score) < 1e-9


def text_block(*texts):
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def in_process(train, buckets=3, word_buckets=2):
    """The model counted without Spark, by the same functions."""
    folder = tempfile.mkdtemp()
    batch = pa.RecordBatch.from_arrays([pa.array(train)], ["text"])

    def grouped(f, tables):
        rows = pa.concat_tables([pa.Table.from_batches([t]) if isinstance(t, pa.RecordBatch) else t for t in tables])
        keys = rows.column("bucket").to_pylist()
        return [f(rows.filter(pa.array([x == k for x in keys]))) for k in sorted(set(keys))]

    size = np.zeros(word_buckets + 1, np.int64)
    tokens = 0
    for r in grouped(lm._words(folder), lm._count_words(word_buckets)([batch])):
        size[r.column("bucket")[0].as_py() + 1] = r.column("words")[0].as_py()
        tokens += r.column("tokens")[0].as_py()
    base = np.cumsum(size)
    words = lm.Words(folder, tuple(base.tolist()), tokens)
    out = grouped(lm._trigrams(folder, buckets), lm._count_grams(words, 3, buckets)([batch]))
    out = grouped(lm._bigrams(folder, base), out)
    run, _ = lm._by_word(folder, base)
    rows = grouped(run, out)
    stats = {c: sum(t.column(c)[0].as_py() for t in rows) for c in lm.STATS}
    return lm.Model(words, buckets, stats, frozenset(os.listdir(folder)), 3)


def test_words_that_share_their_first_hash(tmp_path):
    lm._save(str(tmp_path), "word-0", hash=np.array([5, 5, 5, 9], "<u8"), check=np.array([1, 4, 7, 1], "<u8"), count=np.array([3, 2, 8, 6]))
    words = lm.Words(str(tmp_path), (0, 4), 19)
    number, count = words.find(np.array([5, 5, 5, 9, 9], np.uint64), np.array([1, 5, 7, 1, 2], np.uint64))
    assert number.tolist() == [0, lm.UNKNOWN, 2, 3, lm.UNKNOWN] and count.tolist() == [3, 0, 8, 6, 0]


def test_a_missing_array_raises(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = lm.fit(docs, order=3)
    folder = model.words.folder.removeprefix("file:").removeprefix("//")
    for f in glob.glob(f"{folder}/bigram-*"):
        os.remove(f)
    with pytest.raises(Exception, match="bigram"):
        lm.score(docs, model).collect()


def test_more_tokens_than_a_run(monkeypatch):
    """A unit that is counted in several runs gives the counts of the whole."""
    train = [t for t in TEXTS if t]
    whole = in_process(train)
    monkeypatch.setattr(lm, "RUN", 5)
    cut = in_process(train)
    assert cut.stats == whole.stats
