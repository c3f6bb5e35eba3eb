"""Every operator over nulls, empty and long texts, ties, repeated rows, an empty table and columns of clashing names, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from fathomgrid.llm import bpe, embeddings, lm, mixing, ogg, simhash, substring, suffix, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, spans string, id string, fp string, gone int, _words int, _size int, _score string, _n_tokens int, unit double, th long"
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdeéß") for _ in range(R.randint(1, 7))) for _ in range(400)]
PASSAGE = " ".join(R.choice(VOCAB) for _ in range(60))


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def _make_rows():
    base = prose(80)
    texts = [
        None, "", "   \n\t ", "one", "Two Words", base, base, base.upper(), base + " tail", prose(70) + " " + PASSAGE + " " + prose(5), PASSAGE,
        "\n".join([PASSAGE] * 3), prose(30) + "\t" + PASSAGE, "x" * 700, "ab " * 400, prose(20000), "<|endoftext|> a <|startoftext|>", "ÀÉ ﬁ ½ 你好 🙂" * 20, prose(40),
    ]
    out = [(i + 1, t, ["a", "b", None][i % 3]) for i, t in enumerate(texts)]
    out += [(6, base, "a"), (6, "another text of the same id", "b"), (None, PASSAGE, None), (None, None, None), (100, PASSAGE + "  " + base, "a")]
    return [(i, t, s, "s", "i", "f", 1, 2, 3, "sc", 4, 0.5, 9) for i, t, s in out]


ROWS = _make_rows()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_row(df, *columns):
    return sorted(((r.doc_id, *(getattr(r, c) for c in columns)) for r in df.collect()), key=repr)


def brute_substring(rows, window=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, 1 << 70), 1 << 63 if i is None else i)
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (1 << 63 if i is None else i):
                gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_substring(docs, none):
    got = by_row(substring.remove_repeats(docs), "_words", "_removed", "_kept_sha256")
    assert got == sorted(brute_substring([r[:2] for r in rows()]), key=repr)
    assert any(r[2] for r in got)
    assert substring.remove_repeats(none).count() == 0


def brute_suffix(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    for i, b in data:
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cover[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        yield i, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,gram", [(200, 64), (24, 16)])
def test_suffix(docs, none, length, gram):
    short = docs.filter("text is null or length(text) < 20000")
    got = by_row(suffix.remove_repeated_bytes(short, length, gram), "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")
    want = brute_suffix([r[:2] for r in rows() if r[1] is None or len(r[1]) < 20000], length)
    assert got == sorted(want, key=repr)
    assert suffix.remove_repeated_bytes(none).count() == 0


def test_suffix_pieces(monkeypatch):
    data = np.frombuffer((prose(3000) + PASSAGE + prose(500) + PASSAGE).encode(), np.uint8)
    at = np.array([0, len(data)])
    whole = set(zip(*(x.tolist() for x in _windows(suffix.anchors(data, at, 200, 64)))))
    monkeypatch.setattr(suffix, "PIECE", 1000)
    assert set(zip(*(x.tolist() for x in _windows(suffix._anchored(data, at, 200, 64))))) == whole


def _windows(found):
    lo, n, key, _ = found
    return np.concatenate([np.arange(a, a + b) for a, b in zip(lo, n)]), np.repeat(key, n)


def brute_fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    fp = [(i, brute_fingerprint(t)) for i, t, *_ in rows()]
    label = list(range(len(fp)))
    for _ in fp:
        for a in range(len(fp)):
            for b in range(len(fp)):
                if (fp[a][1] ^ fp[b][1]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, _), c in zip(fp, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, f - (1 << 64) if f >= 1 << 63 else f, least.get(c)) for (i, f), c in zip(fp, label)), key=repr)
    assert by_row(simhash.group_documents(docs), "fp", "component") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _, c in want if i is None or i == c), key=repr)
    assert simhash.keep_one(none).count() == 0


def test_simhash_anchors_lose_no_link(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 200, dtype=np.int64)
    near = np.concatenate([x, *(x ^ (np.int64(1) << r.integers(0, 63, 200)) ^ (np.int64(1) << r.integers(0, 63, 200)) for _ in range(3))])
    near = np.unique(near)
    got = {(a.u, a.v) for a in simhash.near_links(spark.createDataFrame([(int(v),) for v in near], "fp long"), 2).collect()}
    apart = np.bitwise_count(near[:, None] ^ near[None])
    u, v = np.nonzero((apart <= 2) & (near[:, None] < near[None]))
    assert got == {(int(near[a]), int(near[b])) for a, b in zip(u, v)} and len(got) > 300


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(WORD_BPE)
    want = []
    for i, x, *_ in rows():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_row(bpe.encode_documents(docs, WORD_BPE), "_n_tokens", "_ids_sha256", "_decoded_sha256") == sorted(want, key=repr)
    assert bpe.encode_documents(none, WORD_BPE).count() == 0


def test_bpe_cuts_are_certain():
    v = bpe.vocabulary(WORD_BPE)
    cut, last = v.fragments(["zqxj", "the", "é½"])
    assert b"".join(cut) == "zqxjtheé½".encode() and last.sum() == 3
    for f, nxt, end in zip(cut, cut[1:], last):
        if not end:
            assert not v.join[f[-1] << 8 | nxt[0]]


@pytest.mark.parametrize("chunk,overlap", [(32768, 256), (64, 4), (20, 1)])
def test_token_counts(docs, none, chunk, overlap):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(BYTE_BPE)
    some = docs if chunk > 1000 else docs.filter("text is null or length(text) < 5000")
    want = [(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows() if chunk > 1000 or x is None or len(x) < 5000]
    assert by_row(bpe.count_tokens(some, BYTE_BPE, chunk=chunk, overlap=overlap), "_n_tokens") == sorted(want, key=repr)
    assert bpe.count_tokens(none, BYTE_BPE).count() == 0


def test_mixing(docs, none):
    m = mixing.mix(docs).collect()
    assert len(m) == len(rows())
    total = sum(r._size for r in m)
    by = {}
    for r in m:
        assert r._size == len(words(next(t for i, t, s, *_ in rows() if (i, s) == (r.doc_id, r.source) and len(words(t)) == r._size)))
        assert 0 <= r._times <= 2
        by.setdefault(r.source, [r._source_size, r._target, 0, 0])
        by[r.source][2] += r._size * r._times
        by[r.source][3] = max(by[r.source][3], r._size)
    assert abs(sum(x[1] for x in by.values()) - 1.5 * total) < 1e-6
    for size, target, taken, most in by.values():
        assert target <= 2 * size and abs(taken - target) <= most / 2 + 1
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: repr((r.doc_id, r.source, r._size, r._times))
    assert sorted(map(key, m)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).columns == none.columns


def test_water_fill_clamps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(sizes).collect()}
    level = (1.5 * 1510 - 20) / 3
    assert got == {"a": 20.0, "b": pytest.approx(2 * level), "c": pytest.approx(level), None: 0.0}


def test_ogg(docs, none):
    for r in ogg.store_documents(docs).collect():
        back, f = ogg.read(bytes(r._media))
        assert len(back) % 192 == 0 and len(back) == r._payload_bytes >= 192 and back[r._n_bytes :].strip(b" ") == b""
        assert r._payload_sha256 == hashlib.sha256(back).hexdigest() and r._tail_crc32 == zlib.crc32(back[-16:])
        assert f["seconds"] == round(len(back) / 2 / ogg.RATE, 6)
    assert ogg.store_documents(none).count() == 0


def test_ogg_pages():
    def crc(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        return c

    r = random.Random(2)
    packets = [(r.randbytes(n), n) for n in (5, 0, 254, 255, 256, 70_000, 510)]
    for segments in (1, 2, 255):
        pages = ogg.paged(packets, 7, segments)
        assert all(crc(p[:22] + bytes(4) + p[26:]) == int.from_bytes(p[22:26], "little") for p in pages)
        assert ogg.demultiplex(b"".join(pages))[7].packets == [p for p, _ in packets]
    two = ogg.paged(packets, 7) + ogg.paged(packets, 8)
    broken = bytearray(b"".join(two))
    broken[len(two[0]) + 40] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.demultiplex(bytes(broken))
    kept = ogg.demultiplex(bytes(broken), strict=False)
    assert kept[8].packets == [p for p, _ in packets] and kept[7].faults and len(kept[7].packets) < len(packets)


def test_lm(docs, none):
    model = lm.fit(docs)
    got = lm.score(docs, model).collect()
    assert len(got) == len(rows()) and all(np.isfinite(r._score) and r._n_known == r._n_tokens for r in got)
    assert lm.score(none, model).count() == 0


def test_toxicity(spark, none):
    r = random.Random(3)
    bad = ["vile", "foulmouth", "grottyone", "grottytwo"]
    rows_ = []
    for i in range(400):
        t = [r.choice(VOCAB) for _ in range(60)]
        if i % 5 == 0:
            t[r.randrange(60)] = r.choice(bad)
            t[r.randrange(60)] = r.choice(bad)
        rows_.append((i, " ".join(t), "x", 1))
    d = spark.createDataFrame([*rows_, (None, None, "x", 1), (None, "vile grottythree", None, 2), (5, rows_[5][1], "x", 1)], "doc_id long, text string, y string, _i int")
    labels = spark.createDataFrame([*((i, int(i % 5 == 0)) for i in range(300)), (None, 1), (7, None), (7, 0)], "doc_id long, toxic int")
    m = toxicity.fit(d, labels)
    got = toxicity.score(d, m).collect()
    assert len(got) == 403
    known = [x for x in got if x.doc_id is not None]
    assert sum((x._score >= 0.5) == (x.doc_id % 5 == 0) for x in known) >= 0.98 * len(known)
    for x in got:
        assert 0 <= x._score <= 1
    assert next(x for x in got if x.text is None)._score < 0.5
    assert next(x for x in got if x.doc_id is None and x.text)._evidence
    assert toxicity.keep_clean(d, labels).columns == d.columns
    assert toxicity.score(none, m).count() == 0
    assert {x._score for x in toxicity.score(d, toxicity.fit(d, labels.limit(0))).collect()} == {0.0}


def test_index_is_exact():
    r = random.Random(4)
    v = []
    for _ in range(500):
        x = {t: r.random() for t in r.sample(range(60), r.randint(1, 8))}
        n = sum(a * a for a in x.values()) ** 0.5
        v.append({t: a / n for t, a in x.items()})
    v[10] = v[11] = v[12]
    index = toxicity.Index(v, [0] * 500, [None] * 500, block=16)
    for q in v[:60]:
        every = sorted(((-round(sum(a * y.get(t, 0) for t, a in sorted(q.items())), 12), e) for e, y in enumerate(v)))
        assert [(e, s) for e, s in index.nearest(q, 9)] == [(e, -s) for s, e in every[:9] if s < 0]


def test_vectors(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((60, 64)).astype(np.float32)
    near = (base[:20].repeat(3, 0) + 0.02 * r.standard_normal((60, 64))).astype(np.float32)
    rows_ = [(i, [float(a) for a in x], 1) for i, x in enumerate(np.concatenate([base, near, base[:5], base[:5] * 2]))]
    rows_ += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [None] * 64, 1), (1004, [1.0, 2.0], 1), (1005, [2.0, 4.0], 1), (1006, [], 1), (None, [1.0, 2.0], 1), (3, rows_[3][1], 1)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>, n_links int").repartition(3)
    ok = lambda x: x and all(a is not None and np.isfinite(a) for a in x) and any(x)

    def linked(a, b):
        if a[0] is None or b[0] is None or not ok(a[1]) or not ok(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = (np.array(v[1], np.float32).astype(float) for v in (a, b))
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95

    n = len(rows_)
    link = [[i != j and linked(rows_[i], rows_[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(6):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (i, *_), c in zip(rows_, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((x[0], sum(link[i]), least.get(label[i]), x[0] is None or least[label[i]] == x[0]) for i, x in enumerate(rows_)), key=repr)
    got = sorted(((a.vec_id, a.n_links, a.component_id, a.kept) for a in embeddings.near_vectors(df).collect()), key=repr)
    assert got == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_vector_tiles_count_each_link_once(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.standard_normal((1, 64)) + 0.1 * r.standard_normal((300, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.95).sum(1) - 1).tolist()
    monkeypatch.setattr(embeddings, "TILE", 40)
    assert [a.n_links for a in embeddings.near_vectors(df).orderBy("vec_id").collect()] == want
