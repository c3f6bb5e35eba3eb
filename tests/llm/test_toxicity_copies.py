"""What the vocabulary's counts cover: exact copies once, verified near copies not, all other labelled texts."""

import random
import zlib
from collections import Counter

import pyarrow as pa

from fathomgrid.llm import toxicity

R = random.Random(11)
IDS = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5]


def prose(n):
    return " ".join("".join(R.choice("abcdefgh") for _ in range(9)) for _ in range(n))


def fitted(spark, rows):
    """The model of (text, toxic) rows, none held out."""
    own = [(i, t, y) for i, (t, y) in zip(IDS, rows)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in own], "doc_id long, text string").repartition(3)
    return toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in own], "doc_id long, toxic int"))


def least(texts):
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array(texts)], ["id", "o", "y", "text"])
    (out,) = toxicity._signed([batch])
    return out.column("s").to_pylist()


def test_texts_with_one_passage_are_all_counted(spark):
    passage = prose(60)
    texts = [f"{prose(50)} {passage}" for _ in range(60)]
    s = least(texts)
    (most, n), *_ = Counter(s).most_common()
    assert n >= 12
    alike = [t for t, x in zip(texts, s) if x == most]
    rows = [(t + " slurword", 1) for t in alike[:8]] + [(t, 0) for t in alike[8:]] + [(prose(60), 0) for _ in range(60)]
    assert len(set(least([t for t, _ in rows[: len(alike)]]))) == 1
    assert any(t.startswith("slur") for t in fitted(spark, rows).vocabulary)


def test_exact_copies_count_once(spark):
    rows = [(prose(40) + " " + prose(3), 1)] * 800 + [(prose(40) + " slurword", 1) for _ in range(9)] + [(prose(40), 0) for _ in range(90)]
    model = fitted(spark, rows)
    assert abs(model.prior - 10 / 100) < 1e-9
    assert any(t.startswith("slur") for t in model.vocabulary)


def test_near_copies_count_once_for_each_label(spark):
    base = prose(200).split()
    near = [" ".join([*base, f"tail{i}"]) for i in range(20)]
    rows = [(t, 1) for t in near[:10]] + [(t, 0) for t in near[10:]] + [(prose(40), 0) for _ in range(38)]
    model = fitted(spark, rows)
    assert abs(model.prior - 1 / 40) < 1e-9
    assert not set(model.vocabulary) & set(base)
