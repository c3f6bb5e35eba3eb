"""The codes of the SimHash covering: perfect, and links alike with two blocks and with all."""

import numpy as np
import pytest

from fathomgrid.llm import simhash


def test_codes_are_perfect():
    for code in simhash.ALL_BLOCKS:
        errors, beyond = code.cosets(0)
        assert errors.shape == (code.syndromes, 1) and not beyond.any()
        words = np.random.default_rng(3).integers(0, 1 << code.size, 500).astype(np.uint32)
        assert not code.syndrome(words ^ errors[code.syndrome(words), 0]).any()


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_are_those_of_brute_force(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    rows = list(base)
    for b in base:
        for _ in range(4):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            rows.append(b ^ np.uint64(sum(1 << int(f) for f in flips)))
    # the last block alone, and the bits that have no code
    rows += [base[0] ^ np.uint64(1 << 63 | 1 << 62), base[1] ^ np.uint64(1 << 46 | 1 << 61), np.uint64(0), np.uint64(2**64 - 1)]
    fp = np.unique(np.array(rows, np.uint64).view(np.int64))
    apart = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64))
    u, v = np.nonzero((apart <= distance) & (fp[:, None] < fp[None, :]))
    want = sorted(zip(fp[u].tolist(), fp[v].tolist()))
    table = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    for codes in (None, simhash.TWO_BLOCKS, simhash.ALL_BLOCKS):
        assert sorted((r.u, r.v) for r in simhash.near_links(table, distance, codes=codes).collect()) == want


def test_no_fingerprints(spark):
    none = spark.createDataFrame([], "fp long")
    assert simhash.near_links(none, 2, codes=simhash.ALL_BLOCKS).count() == 0


def test_replicas(spark):
    fp = np.random.default_rng(5).integers(0, 1 << 64, 2000, dtype=np.uint64)
    for codes, most in ((simhash.TWO_BLOCKS, 70), (simhash.ALL_BLOCKS, 230)):
        row, anchor = simhash.anchors_of(fp, 2, codes, [c.cosets(2) for c in codes])
        assert len(row) < most * len(fp) and len(np.unique(np.stack([row, anchor]), axis=1).T) == len(row)
