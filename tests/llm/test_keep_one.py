"""Near-dedup of tables where an id stands on rows of different texts."""

import random

from fathomgrid.llm import simhash

R = random.Random(8)


def prose(n):
    return " ".join("".join(R.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_repeated_ids(spark):
    one, two, three = prose(80), prose(80), prose(80)
    rows = [(1, one), (1, one), (5, one), (5, two), (5, two), (7, two), (None, one), (None, three), (None, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    want = [(1, one), (1, one), (5, two), (5, two), (None, one), (None, three), (None, three)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.keep_one(docs).columns == docs.columns
