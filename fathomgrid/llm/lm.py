"""An interpolated modified Kneser-Ney model of order two or three, counted in Spark, kept as sorted hash arrays that workers memory-map.

Counting: one pass counts the words, known by two hashes of different kinds (96 bits); each bucket writes its words as a sorted array,
and a word's place in all of them is its number. A second pass counts each unit's n-grams of numbers, which sort and pack well, and
deals them to buckets by their context, so that a bucket has whole contexts. Contexts of two frequent words (each with a bucket's share of all
tokens or more) may be larger than a bucket: their n-grams are dealt by context and word, and only their sums meet again. Each bucket writes
its contexts, sorted by a hash that is a bijection of their two numbers (so no two contexts share it), with their words and counts, and sends
on what the order below needs. Contexts with one word seen once, most of them, are arrays of their own without counts; a bigram that is a
context too has its count beside it. What reaches the driver is a row for each bucket of words and one of counts of counts and totals.

Scoring is a map: a unit's needles are sorted and looked up in the mapped arrays, so the model may be larger than memory. The arrays
grow with the corpus; nothing is cut off. The driver lists the arrays once they are written: a worker that misses one raises.

The shared folder must be a path on the executors (a mounted share), or one that pyarrow's file systems open: then a
worker fetches the arrays it looks into to its own disk while it runs.
"""

from __future__ import annotations

import atexit
import json
import mmap
import os
import shutil
import struct
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_names, load, new_shared_path, others, ship
from .exchange import BUCKET_BYTES, pack, parts, runs_of, unpack
from .textblocks import LOWER, U, blocks, mix, word_checks, word_hashes, word_spans

UNIT = 8 << 20
#: Tokens of a unit that are counted at once; their own numbers then take 21 bits.
RUN = 1 << 20
#: The end of a text as a word, by its two hashes; the start before a text and words not in the model, by number.
END = mix(np.array([2, 3], U) * U(0xD1B54A32D192ED03))
#: Of a word's second hash 32 bits are kept: words are known by 96.
CHECK = U(0xFFFFFFFF)
START, UNKNOWN = (1 << 32) - 1, (1 << 32) - 2
COLUMNS = ["bucket", "n", "a", "b", "c", "d", "e"]
ROW = "bucket long, n long, a binary, b binary, c binary, d binary, e binary"
ARROW_ROW = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in "abcde")])
SUMS = "total", "n1", "n2", "n3"
COUNTS = {"count", "lone_count", "context_count", "total", "n1", "n2", "n3"}
WORDS = "bucket long, words long, tokens long"
STATS = ["n1", "n2", "n3", "n4", "t1", "t2", "t3", "t4", "bigrams", "k1", "k2", "k3", "k4", "k3plus"]

_open: dict = {}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(*r, *[None] * (len(COLUMNS) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW_ROW.types)], schema=ARROW_ROW) if rows else pa.RecordBatch.from_pylist([], ARROW_ROW)


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack(x))


def _unzip(group: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    return [unpack(d.decompress(b), kind) for b in group.column(column).to_pylist()]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bijection of two numbers of 32 bits."""
    return mix(v.astype(U) << U(32) | w.astype(U))


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values, sorted; the place there of each entry), by a hash table."""
    d = pa.array(h).dictionary_encode()
    values = d.dictionary.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order], rank[d.indices.to_numpy()]


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash and second hash of each distinct word, sorted; the place there of each token, an end after each text; tokens of each text)."""
    low = LOWER[data]
    starts, ends, text = word_spans(low, offsets)
    h, g = (np.concatenate([f(low, starts, ends), END[k : k + 1]]) for k, f in enumerate((word_hashes, word_checks)))
    one, number = numbered(h)
    two = np.empty_like(one)
    two[number] = g
    if (two[number] != g).any():  # two words share their first hash
        order, cut = runs_of(h, g)
        number[order] = np.repeat(np.arange(len(cut)), np.diff(np.concatenate([cut, [len(h)]])))
        one, two = h[order[cut]], g[order[cut]]
    n = np.bincount(text, minlength=len(offsets) - 1)
    token = np.full(len(starts) + len(n), number[-1])
    token[np.arange(len(starts)) + text] = number[:-1]
    return one, two & CHECK, token, n + 1


def before(token: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """The token before each one; start before each text."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[np.cumsum(n) - n] = start
    return out


# ---- arrays in the shared folder ----


def _shortened(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each, and where these are few the larger ones apart with their places; other integers as short as they fit."""
    if x.dtype == np.dtype("<u8"):
        return {name: x}
    if name in COUNTS and (large := np.flatnonzero(x >= 255)).size * 8 < len(x) and len(large):
        return {name: np.minimum(x, 255).astype(np.uint8), f"{name}_at": large.astype("<u4"), f"{name}_large": x[large].astype(np.min_scalar_type(int(x.max())))}
    return {name: x.astype(np.min_scalar_type(int(x.max(initial=0))))}


def _get(own: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """Entries of an array that _save wrote."""
    x = own[name][at].astype(np.int64)
    if f"{name}_at" in own:
        large = np.flatnonzero(x == 255)
        x[large] = own[f"{name}_large"][np.searchsorted(own[f"{name}_at"], at[large])]
    return x


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Writes arrays to one file under a name that is there whole or not at all; a repeated task writes the same again."""
    arrays = {k: y for name_, x in arrays.items() for k, y in _shortened(name_, x).items()}
    head = json.dumps([(k, x.dtype.str, len(x)) for k, x in arrays.items()]).encode()
    head += b" " * (-(len(head) + 8) % 8)
    fs, path = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    fs.create_dir(path)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(struct.pack("<q", len(head)) + head)
        for x in arrays.values():
            f.write(x.tobytes() + bytes(-x.nbytes % 8))
    fs.move(part, f"{path}/{name}")


def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file that is not there is an error."""
    key = folder, name
    if key not in _open:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        path = f"{path}/{name}"
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            if "own" not in _open:
                _open["own"] = tempfile.mkdtemp(prefix="fathomgrid-lm-")
                atexit.register(shutil.rmtree, _open["own"], ignore_errors=True)
            own = os.path.join(_open["own"], f"{abs(hash(folder))}-{name}")
            pyarrow.fs.copy_files(path, own, source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
            path = own
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        (size,) = struct.unpack_from("<q", data)
        at, out = 8 + size, {}
        for k, kind, n in json.loads(data[8 : 8 + size]):
            out[k] = np.frombuffer(data, kind, n, at)
            at += -(-out[k].nbytes // 8) * 8
        _open[key] = out
    return _open[key]


# ---- words ----


def _count_words(buckets: int):
    def run(batches):
        for b in batches:
            for _, data, offsets in blocks(b.column("text"), UNIT):
                h, g, token, _ = tokens_of(data, offsets)
                count = np.bincount(token, minlength=len(h))
                some = count > 0
                h, g, count = h[some], g[some], count[some]
                yield _rows([(k, s.stop - s.start, _zip(h[s]), _zip(g[s].astype("<u4")), _zip(count[s])) for k, s in parts(bucket_of(h, buckets))])

    return run


def _words(folder: str):
    schema = pa.schema([("bucket", pa.int64()), ("words", pa.int64()), ("tokens", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        """Writes a bucket's words, sorted by their hashes, and their counts."""
        bucket = group.column("bucket")[0].as_py()
        h, g, count = (np.concatenate(_unzip(group, c, t)) for c, t in zip("abc", ("<u8", "<u4", "<i8")))
        order, cut = runs_of(h, g)
        count = np.add.reduceat(count[order], cut)
        _save(folder, f"word-{bucket}", hash=h[order[cut]], check=g[order[cut]], count=count)
        return pa.table({"bucket": [bucket], "words": [len(cut)], "tokens": [int(count.sum())]}, schema)

    return run


@dataclass(frozen=True)
class Words:
    """The words' arrays: base has the number of each bucket's first word, and how many there are at its end."""

    folder: str
    base: tuple[int, ...]
    tokens: int

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of words by their hashes, sorted; UNKNOWN and 0 if not in the model."""
        number, count = np.full(len(h), UNKNOWN), np.zeros(len(h), np.int64)
        for k, s in parts(bucket_of(h, len(self.base) - 1)):
            if self.base[k] == self.base[k + 1]:
                continue
            own = _mapped(self.folder, f"word-{k}")
            at = np.searchsorted(own["hash"], h[s])
            while True:  # several words may share the first hash
                inside = np.minimum(at, len(own["hash"]) - 1)
                alike = (at < len(own["hash"])) & (own["hash"][inside] == h[s])
                found = alike & (own["check"][inside] == g[s])
                if not (alike & ~found).any():
                    break
                at = at + (alike & ~found)
            number[s] = np.where(found, inside + self.base[k], UNKNOWN)
            count[s] = np.where(found, _get(own, "count", inside), 0)
        return number, count


# ---- n-grams ----


def _coded(bucket: np.ndarray, u: np.ndarray, v: np.ndarray | None, w: np.ndarray, count: np.ndarray):
    """Rows of n-grams sorted by bucket, context (u, or u and v) and word: each context once with its run."""
    for k, s in parts(bucket):
        new = u[s][1:] != u[s][:-1]
        if v is not None:
            new = new | (v[s][1:] != v[s][:-1])
        cut = np.flatnonzero(np.concatenate([[True], new]))
        first = u[s][cut]
        yield k, s.stop - s.start, _zip(np.diff(first, prepend=0).astype("<u4")), None if v is None else _zip(v[s][cut].astype("<u4")), _zip(np.diff(np.concatenate([cut, [s.stop - s.start]])).astype("<u4")), _zip(w[s].astype("<u4")), _zip(count[s].astype("<i8"))


def _decoded(group: pa.Table, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, count) of a bucket's rows summed up, sorted by the context's hash and the word. Context: one number, or two in 64 bits."""
    runs = _unzip(group, "c", "<u4")
    context = [np.cumsum(x, dtype=np.int64).astype(U) for x in _unzip(group, "a", "<u4")]
    if pairs:
        context = [x << U(32) | y.astype(U) for x, y in zip(context, _unzip(group, "b", "<u4"))]
    context = np.concatenate([np.repeat(x, n) for x, n in zip(context, runs)])
    w, count = np.concatenate(_unzip(group, "d", "<u4")), np.concatenate(_unzip(group, "e", "<i8"))
    order = np.lexsort((w, mix(context)))
    context, w = context[order], w[order]
    cut = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (w[1:] != w[:-1])]))
    return context[cut], w[cut], np.add.reduceat(count[order], cut)


def _count_grams(words: Words, order: int, buckets: int):
    many = frequent_from(words, buckets)

    def run(batches):
        for b in batches:
            for _, data, offsets in blocks(b.column("text"), UNIT):
                h, g, token, n = tokens_of(data, offsets)
                number, times = words.find(h, g)
                number, frequent = np.append(number, START), np.append(times >= many, True)
                one = before(token, n, len(h))
                two = before(one, n, len(h))
                for at in range(0, len(token), RUN):
                    u, v, w = two[at : at + RUN], one[at : at + RUN], token[at : at + RUN]
                    own = None
                    if len(number) > 1 << 21:  # the run's own numbers, in the words' order
                        own, local = np.unique(np.concatenate([u, v, w]), return_inverse=True)
                        u, v, w = local.reshape(3, -1)
                    key = v.astype(U) << U(21) | w.astype(U)
                    if order == 3:
                        key |= u.astype(U) << U(42)
                    key.sort()
                    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    key, count = key[cut], np.diff(np.concatenate([cut, [len(key)]]))
                    u, v, w = ((key >> U(i) & U((1 << 21) - 1)).astype(np.int64) for i in (42, 21, 0))
                    if own is not None:
                        u, v, w = own[u], own[v], own[w]
                    if order == 3:
                        spread = frequent[u] & frequent[v]
                        code = 2 * gram_bucket(pair_hash(number[u], number[v]), number[w], spread, buckets) + spread
                    else:
                        code = 2 * bucket_of(pair_hash(number[v], number[w]), buckets) + 1
                    by = np.argsort(code.astype(np.uint16) if buckets < 1 << 15 else code, kind="stable")
                    u, v, w, count, code = number[u[by]], number[v[by]], number[w[by]], count[by], code[by]
                    yield _rows(list(_coded(code, u, v, w, count) if order == 3 else _coded(code, v, None, w, count)))

    return run


def frequent_from(words: Words, buckets: int) -> float:
    """A word is frequent if it has so many tokens."""
    return max(words.tokens / buckets, 2)


def gram_bucket(context: np.ndarray, w: np.ndarray, spread: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of trigrams by their context's hash, or by that and the word where spread says so."""
    return bucket_of(np.where(spread, mix(context + w.astype(U)), context), buckets)


def _sums(context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first entry, tokens, words seen once, twice, three times or more) of each run of a context."""
    cut = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    return cut, *(np.add.reduceat(x.astype(np.int64), cut) for x in (count, count == 1, count == 2, count >= 3))


def _trigrams(folder: str, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        """Adds up a bucket's trigrams, writes them, and sends on the bigrams that end them and, of contexts that are spread, their sums."""
        bucket, spread = divmod(group.column("bucket")[0].as_py(), 2)
        context, w, count = _decoded(group, True)
        cut, *sums = _sums(context, count)
        total, n1, n2, n3 = sums
        h = mix(context[cut])
        out = [(-5 - s, int((count == k).sum())) for s, k in enumerate([1, 2, 3, 4])]
        if not spread:
            run = np.diff(np.append(cut, len(w)))
            lone = total == 1
            many, kept = ~lone, np.repeat(~lone, run)
            more = {"total": total[many], "n1": n1[many], "n2": n2[many]}
            _save(folder, f"trigram-{bucket}", lone=h[lone], lone_word=w[cut[lone]], context=h[many], start=np.append(0, np.cumsum(run[many])), word=w[kept], count=count[kept], **more)
            out.append((2 * bucket + 1, -1))  # its contexts are there
        else:
            _save(folder, f"spread-{bucket}", context=h, start=np.append(cut, len(w)), word=w, count=count)
            out += [(2 * k, s.stop - s.start, _zip(h[s]), *(_zip(x[s]) for x in sums)) for k, s in parts(bucket_of(h, buckets))]
        # bigrams count the words before them; nothing stands before START, so its bigrams keep their counts
        v = (context & U(0xFFFFFFFF)).astype(np.int64)
        seen = np.where(v == START, count, 1)
        order = np.lexsort((w, v, bucket_of(pair_hash(v, w), buckets)))
        v, w, seen = v[order], w[order], seen[order]
        cut = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
        v, w, seen = v[cut], w[cut], np.add.reduceat(seen, cut)
        out += _coded(2 * bucket_of(pair_hash(v, w), buckets) + 1, v, None, w, seen)
        return pa.Table.from_batches([_rows(out)], ARROW_ROW)

    return run


def _bigrams(folder: str, base: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        """Adds up a bucket's bigrams, writes them, and sends on sums by context and by word; or writes the sums of spread contexts; counts of counts pass."""
        code = group.column("bucket")[0].as_py()
        if code < 0:
            return group
        bucket, bigrams = divmod(code, 2)
        if not bigrams:
            h, *sums = (np.concatenate(_unzip(group, c, t)) for c, t in zip("abcde", ("<u8", *["<i8"] * 4)))
            order = np.argsort(h)
            cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            _save(folder, f"sums-{bucket}", context=h[order][cut], **{k: np.add.reduceat(x[order], cut) for k, x in zip(SUMS, sums)})
            return pa.Table.from_batches([_rows([])], ARROW_ROW)
        sizes = group.column("n").to_numpy()
        group = group.filter(pa.array(sizes >= 0))
        if not group.num_rows:
            return pa.Table.from_batches([_rows([])], ARROW_ROW)
        v, w, count = _decoded(group, False)
        h = pair_hash(v, w)
        order = np.argsort(h)
        grams, counts, beside, rest = h[order], count[order], {}, np.ones(len(h), bool)
        if (sizes < 0).any():
            contexts = _mapped(folder, f"trigram-{bucket}")
            for kind in ("lone", "context"):
                at, found = _places(contexts[kind], grams)
                beside[f"{kind}_count"] = np.zeros(len(contexts[kind]), np.int64)
                beside[f"{kind}_count"][at[found]] = counts[found]
                rest &= ~found
        _save(folder, f"bigram-{bucket}", gram=grams[rest], count=counts[rest], **beside)
        out = [(-1 - s, int((count == k).sum())) for s, k in enumerate([1, 2, 3, 4])]
        cut, *sums = _sums(v, count)
        v = v[cut].astype(np.int64)
        by = np.argsort(v)
        v, sums = v[by], [x[by] for x in sums]
        out += [(2 * k, s.stop - s.start, _zip(v[s]), *(_zip(x[s]) for x in sums)) for k, s in parts(np.searchsorted(base, v, "right") - 1)]
        w, follows = np.unique(w, return_counts=True)
        out += [(2 * k + 1, s.stop - s.start, _zip(w[s].astype("<i8")), _zip(follows[s])) for k, s in parts(np.searchsorted(base, w, "right") - 1)]
        return pa.Table.from_batches([_rows(out)], ARROW_ROW)

    return run


def _by_word(folder: str, base: np.ndarray):
    kinds = ", ".join(f"{c} long" for c in STATS)
    schema = pa.schema([(c, pa.int64()) for c in STATS])

    def run(group: pa.Table) -> pa.Table:
        """Writes the sums of a bucket of words, at the words' places; counts of counts are added up."""
        code = group.column("bucket")[0].as_py()
        stats = dict.fromkeys(STATS, 0)
        if code < 0:
            stats[f"n{-code}" if code > -5 else f"t{-4 - code}"] = sum(group.column("n").to_pylist())
        else:
            bucket, follows = divmod(code, 2)
            v, *sums = (np.concatenate(_unzip(group, c, "<i8")) for c in ("ab" if follows else "abcde"))
            first, size = (base[bucket], base[bucket + 1] - base[bucket]) if bucket < len(base) - 1 else (START, 1)
            dense = [np.zeros(size, np.int64) for _ in sums]
            for x, y in zip(dense, sums):
                np.add.at(x, v - first, y)
            _save(folder, f"{'follows' if follows else 'context'}-{bucket}", **dict(zip(SUMS, dense)))
            if follows:
                stats |= {"bigrams": int(dense[0].sum()), "k3plus": int((dense[0] >= 3).sum())}
                stats |= {f"k{k}": int((dense[0] == k).sum()) for k in (1, 2, 3, 4)}
        return pa.table({c: [stats[c]] for c in STATS}, schema)

    return run, kinds


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D0 = 0, D1, D2, D3+ from counts of counts; where these are too few to tell, k * 0.5 or less, never outside 0 to k."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [k - (k + 1) * y * after / at if at and after else 0.5 * k for k, at, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1))])


def _within(sorted_words: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The place of each w in its sorted stretch [lo, hi); -1 if it is not there."""
    at, stop = lo.copy(), hi.copy()
    open_ = np.flatnonzero(at < stop)
    while len(open_):
        middle = (at[open_] + stop[open_]) >> 1
        less = sorted_words[middle] < w[open_]
        at[open_[less]] = middle[less] + 1
        stop[open_[~less]] = middle[~less]
        open_ = open_[at[open_] < stop[open_]]
    place = np.minimum(at, len(sorted_words) - 1)
    return np.where((at < hi) & (sorted_words[place] == w), place, -1)


def _places(keys: np.ndarray, needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of needles in sorted keys."""
    if not len(keys):
        return np.zeros(len(needles), np.int64), np.zeros(len(needles), bool)
    at = np.minimum(np.searchsorted(keys, needles), len(keys) - 1)
    return at, keys[at] == needles


@dataclass(frozen=True)
class Model:
    """Where the arrays are, which there are, and the totals."""

    words: Words
    buckets: int
    stats: dict
    files: frozenset
    order: int = 2

    def arrays(self, name: str) -> dict[str, np.ndarray] | None:
        """A file's arrays; None if the counting wrote none of this name."""
        return _mapped(self.words.folder, name) if name in self.files else None

    def by_number(self, kind: str, number: np.ndarray) -> list[np.ndarray]:
        """What a kind of array has for each word by number, sorted; 0 for words not in the model."""
        out = [np.zeros(len(number), np.int64) for _ in range(1 if kind == "follows" else 4)]
        base = np.array(self.words.base)
        known = np.flatnonzero(number != UNKNOWN)
        for k, s in parts(np.searchsorted(base, number[known], "right") - 1):
            if (own := self.arrays(f"{kind}-{k}")) is not None:
                at = number[known[s]] - (base[k] if k < len(base) - 1 else START)
                for x, name in zip(out, SUMS):
                    x[known[s]] = _get(own, name, at)
        return out

    def pairs(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(count as a bigram; what it is as a context: 0 none, 1 of one word seen once, 2 another; that word, or its stretch of words and sums) of each sorted pair hash."""
        count, kind = np.zeros(len(q), np.int64), np.zeros(len(q), np.int8)
        own = {k: np.zeros(len(q), np.int64) for k in ("word", "start", "stop", *SUMS)}
        for k, s in parts(bucket_of(q, self.buckets)):
            grams, contexts = self.arrays(f"bigram-{k}"), self.arrays(f"trigram-{k}")
            mine = np.arange(s.start, s.stop)
            if grams is not None:
                at, found = _places(grams["gram"], q[s])
                count[mine[found]] = _get(grams, "count", at[found])
            if contexts is None:
                continue
            for what, name in ((1, "lone"), (2, "context")):
                at, found = _places(contexts[name], q[s])
                at, some = at[found], mine[found]
                kind[some] = what
                if grams is not None:
                    count[some] = _get(grams, f"{name}_count", at)
                if what == 1:
                    own["word"][some] = contexts["lone_word"][at]
                    own["total"][some] = own["n1"][some] = 1
                else:
                    own["start"][some], own["stop"][some] = contexts["start"][at], contexts["start"][at + 1]
                    for x in ("total", "n1", "n2"):
                        own[x][some] = _get(contexts, x, at)
                    own["n3"][some] = own["stop"][some] - own["start"][some] - own["n1"][some] - own["n2"][some]
        return count, kind, own

    def counts_in(self, bucket: np.ndarray, start: np.ndarray, stop: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The count of each word in its context's stretch of a bucket."""
        count = np.zeros(len(w), np.int64)
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket, kind="stable")
        for k, s in parts(bucket[order]):
            own, mine = self.arrays(f"trigram-{k}"), order[s]
            place = _within(own["word"], start[mine], stop[mine], w[mine])
            there = place >= 0
            count[mine[there]] = _get(own, "count", place[there])
        return count

    def spread(self, context: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(count, sums of the context) of trigrams whose contexts are spread."""
        count, sums = np.zeros(len(w), np.int64), [np.zeros(len(w), np.int64) for _ in SUMS]
        bucket = gram_bucket(context, w, np.ones(len(w), bool), self.buckets)
        order = np.lexsort((context, bucket))
        for k, s in parts(bucket[order]):
            if (own := self.arrays(f"spread-{k}")) is not None:
                at, found = _places(own["context"], context[order[s]])
                at, mine = at[found], order[s][found]
                place = _within(own["word"], own["start"][at].astype(np.int64), own["start"][at + 1].astype(np.int64), w[mine])
                there = place >= 0
                count[mine[there]] = _get(own, "count", place[there])
        order = np.argsort(context)
        for k, s in parts(bucket_of(context[order], self.buckets)):
            if (own := self.arrays(f"sums-{k}")) is not None:
                at, found = _places(own["context"], context[order[s]])
                for x, name in zip(sums, SUMS):
                    x[order[s][found]] = _get(own, name, at[found])
        return count, sums

    def mixed(self, counts: str, count: np.ndarray, sums: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """p of the order below, mixed with the discounted share of the n-gram in its context where the model has that context."""
        d = discounts(*(self.stats[f"{counts}{k}"] for k in (1, 2, 3, 4)))
        total, n1, n2, n3 = sums
        tokens = np.maximum(total, 1)
        own = np.maximum(count - d[np.minimum(count, 3)], 0)
        return np.where(total > 0, own / tokens + (d[1] * n1 + d[2] * n2 + d[3] * n3) / tokens * p, p)

    def logs(self, h: np.ndarray, g: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base log10, log10 probability) of each token of a unit (see tokens_of)."""
        s = self.stats
        size, total = self.words.base[-1], self.words.tokens
        number, times = self.words.find(h, g)
        base = np.log10((times + 0.5) / (total + 0.5 * (size + 1)))
        (follows,) = self.by_number("follows", number)
        d = discounts(s["k1"], s["k2"], s["k3"], s["k4"])
        if s["bigrams"]:
            back = (d[1] * s["k1"] + d[2] * s["k2"] + d[3] * s["k3plus"]) / s["bigrams"]
            p = np.maximum(follows - d[np.minimum(follows, 3)], 0) / s["bigrams"] + back / (size + 1)
        else:
            p = np.full(len(h), 1 / (size + 1))
        one = before(token, n, len(h))
        number, frequent = np.append(number, START), np.append(times >= frequent_from(self.words, self.buckets), True)
        # pairs of neighbours: each is a token's bigram and the next one's context; START twice is the first one's
        pair, at = numbered(pair_hash(np.append(number[one], START), np.append(number[token], START)))
        where = np.zeros(len(pair), np.int64)
        where[at[:-1]] = np.arange(len(token))
        v, w = one[where], token[where]
        count, kind, own = self.pairs(pair)
        p = self.mixed("n", count, [x[v] for x in self.by_number("context", number)], p[w])
        p = p[at[:-1]]
        if self.order == 3:
            context = before(at[:-1], n, at[-1])
            count = ((kind == 1)[context] & (own["word"][context] == number[token])).astype(np.int64)
            sums = [own[x][context] for x in SUMS]
            some = np.flatnonzero((kind == 2)[context])
            c = context[some]
            count[some] = self.counts_in(bucket_of(pair, self.buckets)[c], own["start"][c], own["stop"][c], number[token[some]])
            far = np.flatnonzero(frequent[before(one, n, len(h))] & frequent[one])
            count[far], more = self.spread(pair[context[far]], number[token[far]])
            for x, y in zip(sums, more):
                x[far] = y
            p = self.mixed("t", count, sums, p)
        return (times > 0)[token], base[token], np.log10(p)


def fit(texts: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Counts the model of order 2 or 3 from all texts (null: empty, one END). A-Z is lower-cased; words are runs without white space."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = texts.sparkSession
    ship(spark)
    folder = new_shared_path(spark, "lm")
    own = texts.select(F.col(text).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_buckets = max(8, partitions // 4)
    found = own.mapInArrow(_count_words(word_buckets), ROW).groupBy("bucket").applyInArrow(_words(folder), WORDS).collect()  # a row for each bucket
    size = np.zeros(word_buckets + 1, np.int64)
    for r in found:
        size[r.bucket + 1] = r.words
    base = np.cumsum(size)
    if base[-1] >= UNKNOWN:
        raise ValueError("more distinct words than numbers")
    words = Words(folder, tuple(base.tolist()), sum(r.tokens for r in found))
    stats = dict.fromkeys(STATS, 0)
    buckets = max(partitions, words.tokens * 16 // BUCKET_BYTES)
    if words.tokens:
        run, kinds = _by_word(folder, base)
        counted = own.mapInArrow(_count_grams(words, order, buckets), ROW)
        if order == 3:
            counted = counted.groupBy("bucket").applyInArrow(_trigrams(folder, buckets), ROW)
        counted = counted.groupBy("bucket").applyInArrow(_bigrams(folder, base), ROW)
        stats = counted.groupBy("bucket").applyInArrow(run, kinds).agg(*(F.sum(c).alias(c) for c in STATS)).first().asDict()
    return Model(words, buckets, stats, frozenset(list_names(spark, folder)), order)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text, with _n_tokens, _n_known, _train_tokens, _base_score, _score (log10) and _perplexity of each whole text.

    Null text is empty: one END. Words not in the model share the mass of one unknown word; all scores are finite. Other
    columns may hold null and are passed on; repeated rows give repeated rows; an empty table an empty one. A model of
    no texts gives every token probability 1 at the base and 1 / (V + 1) = 1. Arrays of the model that cannot be read raise.
    """
    ship(docs.sparkSession)
    types = {"_n_tokens": "long", "_n_known": "long", "_train_tokens": "long", "_base_score": "double", "_score": "double", "_perplexity": "double"}
    rest = others(docs, text, *types)

    def run(batches):
        for b in batches:
            made: list[list] = [[] for _ in types]
            for _, data, offsets in blocks(b.column(text), UNIT):
                h, g, token, n = tokens_of(data, offsets)
                known, base, p = model.logs(h, g, token, n)
                cut = np.cumsum(n) - n
                total = np.add.reduceat(p, cut)
                for m, x in zip(made, (n, np.add.reduceat(known.astype(np.int64), cut), np.full(len(n), model.words.tokens), np.add.reduceat(base, cut), total, 10 ** (-total / n))):
                    m.append(x)
            made = [np.concatenate(m) if m else np.zeros(0) for m in made]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(m, pa.int64() if t == "long" else pa.float64()) for m, t in zip(made, types.values()))], [*rest, *types])

    kinds = [*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} {t}" for c, t in types.items())]
    return docs.select(*rest, text).mapInArrow(run, ", ".join(kinds))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    out = score(docs.withColumn("held_out", held), fit(docs.filter(~held), order=3))
    return out.toDF(*(c.removeprefix("_") for c in out.columns))


QUERIES = {"op6_kneser_ney": op6_kneser_ney}
ORACLES: dict[str, str] = {}
