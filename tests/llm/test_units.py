"""Units of ops 8 and 10: the same rows in other orders, tables laid over themselves, and many exact copies in a partition."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import exchange, mixing, substring, suffix, toxicity

from .test_edges import brute_substring, brute_suffix, by_row

R = random.Random(21)
SCHEMA = "doc_id long, text string"


def prose(n):
    return " ".join("".join(R.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def check(docs):
    rows = [tuple(r) for r in docs.collect()]
    got = by_row(substring.remove_repeats(docs), "_words", "_removed", "_kept_sha256")
    assert got == sorted(brute_substring(rows), key=repr)
    got = by_row(suffix.remove_repeated_bytes(docs), "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")
    assert got == sorted(brute_suffix(rows), key=repr)


def laid(spark, *partitions):
    """A table whose partitions hold these rows in this order."""
    out = None
    for p in partitions:
        part = spark.createDataFrame(p, SCHEMA).coalesce(1)
        out = part if out is None else out.union(part)
    return out


def test_same_rows_in_another_order(spark):
    a, c = prose(300), prose(300)
    rows = [(1, a), (2, a), (3, c)]
    check(laid(spark, rows, [rows[0], rows[2], rows[1]]))


@pytest.mark.parametrize("other", [lambda r: r, lambda r: r[::-1], lambda r: r[3:] + r[:3]])
def test_table_over_itself(spark, other):
    passage = prose(50)
    rows = [(i, prose(40) + (" " + passage if i % 2 else "") + " " + prose(30)) for i in range(8)]
    check(laid(spark, rows, other(rows)))


def test_many_copies_in_a_partition(spark):
    one, two = prose(100), prose(90)
    rows = [(i, one) for i in range(40)] + [(100, two), (101, one + " " + two), (102, prose(80))]
    check(laid(spark, rows, rows[::-1][:5], [(200, two)]))


def test_long_texts(spark):
    passage = prose(400)
    check(laid(spark, [(1, prose(9000) + " " + passage + " " + prose(3000))], [(2, passage), (3, prose(20)), (4, prose(6000) + passage[5:])]))


def test_hot_anchors(spark):
    """A common line in unlike texts: its fragments are spread by further anchors, and nothing is lost."""
    line = prose(25)
    rows = [(i, prose(20) + " " + line + " " + prose(20)) for i in range(60)]
    rows += [(100 + i, rows[i][1][60:] + prose(5)) for i in range(0, 60, 7)]
    docs = laid(spark, rows[:30], rows[30:])
    got = by_row(suffix.remove_repeated_bytes(docs, hot=4), "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")
    assert got == sorted(brute_suffix(rows), key=repr) and any(r[2] for r in got)


def test_spread_keeps_equal_windows_together():
    line = prose(25).encode()
    texts = [prose(20).encode() + line + prose(20).encode() for _ in range(30)]
    texts += [t[:400] for t in texts[:5]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    lo, n, key, _ = suffix.anchors(data, offsets, 200, 64)
    place, size, spread = suffix._spread(data, lo, n, key, 200, 64)
    assert size.sum() == n.sum() and len(place) > len(lo)
    keys = {}
    for p, m, k in zip(place.tolist(), size.tolist(), spread.tolist()):
        for i in range(p, p + m):
            assert keys.setdefault(bytes(data[i : i + 200]), k) == k


def test_merge_of_transforms():
    """Repeated intervals of merged shards against brute force, for many lengths; blocks are in the order of the suffixes."""
    for _ in range(60):
        length = R.choice([1, 2, 3, 5, 8, 9, 13, 24, 50])
        pool = ["".join(R.choice("abc") for _ in range(R.randint(1, 80))) for _ in range(4)]
        shards = [[(R.choice(pool) + R.choice(pool))[: R.randint(1, 120)].encode() for _ in range(R.randint(1, 5))] for _ in range(R.randint(1, 4))]
        bwt = [suffix.transform([np.frombuffer(f, np.uint8) for f in s]) for s in shards]
        lf = suffix.lf_mapping(bwt)
        root, before = suffix.first_rows(lf)
        rows, block = suffix.repeated_intervals(bwt, lf, before, length)
        base = np.cumsum([0, *map(len, bwt)])[:-1]
        end = np.concatenate([b + np.arange(len(s)) for b, s in zip(base, shards)])
        whole = {int(r): f for r, f in zip(root[end], [f for s in shards for f in s])}
        found = [whole[int(root[r])][before[r] : before[r] + length] for r in rows]
        every = [f[i : i + length] for s in shards for f in s for i in range(len(f) - length + 1)]
        assert found == sorted(x for x in every if every.count(x) > 1)
        assert all((x == y) == (p == q) for x, y, p, q in zip(found, found[1:], block, block[1:]))


def test_a_unit_without_its_own_row_is_an_error():
    row = (0, 7, 0, 1, exchange.pack(np.zeros(1, "<u4")))
    with pytest.raises(RuntimeError):
        substring._spans(0, 13, 1)(pa.Table.from_batches([exchange.table([row, row])], exchange.ARROW_ROW))


def test_entries_that_share_64_bits_are_told_apart():
    h, g = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    order, cut = exchange.runs_of(h, g)
    assert [sorted(x) for x in np.split(order, cut[1:])] == [[0, 2], [1], [3]]


NAMES = ["_order", "_bucket", "_src", "_bkt", "_before", "_upto", "_whole", "_k", "_size", "_source_size", "_target", "_times", "row", "size", "k", "o", "s", "b"]


def test_mix_keeps_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(i, prose(i), "ab"[i % 2]) for i in range(1, 30)], "doc_id long, text string, source string")
    docs = docs.select("*", *(F.lit(77 + i).alias(c) for i, c in enumerate(NAMES)))
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id: r for r in docs.collect()}
    assert got.count() > 29 and all(r == kept[r.doc_id] for r in got.collect())
    m = mixing.mix(docs)
    assert all(r["size"] == kept[r.doc_id]["size"] and r._size == r.doc_id for r in m.collect())


def test_keep_clean_keeps_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(i, prose(20), 7.5, "e") for i in range(30)], "doc_id long, text string, _score double, _evidence string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(20)], "doc_id long, toxic int")
    got = toxicity.keep_clean(docs, labels)
    assert got.columns == docs.columns and {(r._score, r._evidence) for r in got.collect()} == {(7.5, "e")}
