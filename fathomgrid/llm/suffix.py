"""Repeated byte strings by merging shard Burrows-Wheeler transforms.

Candidates first, with no loss: the anchor of a window of `length` bytes is the place of its smallest hash of `gram`
bytes, so equal windows have equal anchors, and a window can repeat only if its anchor's hash does. Consecutive windows of one
anchor form a fragment. Equal fragments (compared byte by byte within a unit of texts, by 128 bits of hashes between units) are one
string with a multiplicity, and all of such a string repeats; a fragment whose anchor nothing shares is dropped.

The fragments that share an anchor but differ go to shards: each unit of texts sorts the suffixes of its own fragments, for each bucket
of anchors, once, and ships their multi-string Burrows-Wheeler transform and no text or suffix array. A bucket merges its shards'
transforms by iterative interleave refinement and never turns them back into text or sorts suffixes: the interleave of all shards'
rows is ordered to depth h and cut into blocks of rows that share h symbols; one pass over it in order deals the row that stands s <= h
symbols before each (the LF mapping, s times) to the block that this row has already, which orders the interleave to depth h + s.
Where neighbours part, their common prefix is between the two depths; blocks of one row leave. With s = h the common prefix of `length`
symbols is decided in about log2(length) passes. Blocks of several rows at that depth are the repeated intervals. Places in texts
are distances to the fragments' first rows, by doubling the LF mapping.

An anchor with very many differing fragments (a common line in unlike texts) is spread: its fragments are cut at three further anchors,
under other hashes, and dealt by all four.

Scale: the work is linear in the texts' bytes for the anchors, and in the bytes of differing fragments for the
transforms. Anchors are dealt by hash and equal ones collapse within each unit before the shuffle; no pairs are formed. Texts
meet their fragments and spans by joins that shuffle at every size.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, others, ship
from .exchange import ARROW_ROW, ROW, buckets_for, own_of, pack, parts, table, unpack, unpack_all
from .substring import ARROW_SPANS, NO_ID, SPANS, _answers, _spans, own_row, unit_rows
from .textblocks import BASE, BYTE, U, blocks, mix, powers

UNIT = 4 << 20
PIECE = 1 << 20
PLACE_BITS = 24
FOUND = "id long, th long, spans binary, wanted binary"
ARROW_FOUND = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("spans", pa.binary()), ("wanted", pa.binary())])
WANTED = np.dtype([("lo", "<u4"), ("n", "<u4"), ("key", "<u8"), ("hot", "<u4")])
#: Odd factors of the two content hashes, and their inverses.
FACTORS = [(b, U(pow(int(b), -1, 1 << 64))) for b in (BASE, U(0xA0761D6478BD642F))]
#: Beyond so many differing fragments an anchor's fragments are spread by further anchors.
HOT = 2048
FURTHER = [U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive bytes, by doubling."""
    h, size, out, done = BYTE[data], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = h[: len(data) - k + 1].copy(), size
            else:
                out = out * U(pow(int(BASE), size, 1 << 64)) + h[done : done + len(out)]
                done += size
        if done == k:
            return mix(out)
        h = h[: len(h) - size] * U(pow(int(BASE), size, 1 << 64)) + h[size:]
        size *= 2


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive entries."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, other: np.uint64 | None = None) -> tuple[np.ndarray, ...]:
    """(first window, windows, key, content hashes, two to a row) of each run of windows with one anchor; windows lie within texts. other: anchors under another hash."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros((0, 2), U))
    if len(data) < length:
        return none
    h = gram_hashes(data, gram)
    if other is not None:
        h = mix(h ^ other)
    place = np.arange(len(h), dtype=U)
    low = (h & ~U((1 << PLACE_BITS) - 1)) | place
    at = (sliding_least(low, length - gram + 1) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    n = np.diff(offsets)
    long = n >= length
    inside[offsets[:-1][long]] = 1
    np.add.at(inside, offsets[:-1][long] + n[long] - length + 1, -1)
    good = np.cumsum(inside[: len(at)]) > 0
    begin = np.zeros(len(at), bool)
    begin[offsets[:-1][long]] = True
    new = good & (begin | np.concatenate([[True], (at[1:] != at[:-1]) | ~good[:-1]]))
    lo = np.flatnonzero(new)
    if not len(lo):
        return none
    end = np.flatnonzero(good & np.concatenate([new[1:] | ~good[1:], [True]])) + 1
    stop = end + length - 1
    content = np.empty((len(lo), 2), U)
    prefix = np.zeros(len(data) + 1, U)
    for k, (factor, inverse) in enumerate(FACTORS):
        np.cumsum(BYTE[data] * powers(len(data), factor), out=prefix[1:])
        content[:, k] = mix((prefix[stop] - prefix[lo]) * powers(int(lo[-1]) + 1, inverse)[lo] + (end - lo).astype(U))
    # smallest hashes are small numbers: scrambled, they spread over the buckets
    return lo, end - lo, mix(h[at[lo]]), content


def _pieces(batch: pa.RecordBatch):
    """(rows, ids, th, bytes, offsets) of units of whole texts."""
    ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    th = batch.column("th").to_numpy(zero_copy_only=False)
    for row, data, offsets in blocks(batch.column("text"), UNIT):
        yield slice(row, row + len(offsets) - 1), ids[row : row + len(offsets) - 1], th[row : row + len(offsets) - 1], data, offsets


def _anchored(data, offsets, length, gram, other=None):
    """anchors() over a unit in runs of whole texts of about PIECE bytes; a longer text in pieces that overlap, so that no window is lost or seen twice."""
    found, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        s, e = int(offsets[at]), int(offsets[to])
        if e - s <= 2 * PIECE:
            lo, *rest = anchors(data[s:e], offsets[at : to + 1] - s, length, gram, other)
            found.append((lo + s, *rest))
        else:
            for i in range(s, e - length + 1, PIECE - length + 1):
                part = data[i : min(i + PIECE, e)]
                lo, *rest = anchors(part, np.array([0, len(part)]), length, gram, other)
                found.append((lo + i, *rest))
        at = to
    return tuple(map(np.concatenate, zip(*found)))


def _alike(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from one are those from two, for each pair of places."""
    same = np.ones(len(one), bool)
    for at in range(0, len(one), 4096):
        a, b, n = one[at : at + 4096], two[at : at + 4096], size[at : at + 4096]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(a, n) + step] != data[np.repeat(b, n) + step]
        same[at : at + 4096] = np.add.reduceat(differ, np.cumsum(n) - n, dtype=np.int64) == 0
    return same


def _anchor_rows(length: int, gram: int, buckets: int):
    def run(batches):
        number = count()
        for b in batches:
            for _, ids, th, data, offsets in _pieces(b):
                lo, n, key, content = _anchored(data, offsets, length, gram)
                if not len(lo):
                    continue
                unit, own = unit_rows(next(number), ids, th, np.diff(offsets), buckets)
                order = np.lexsort((content[:, 1], content[:, 0], key))
                k, c = key[order], content[order]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]).any(1)])
                held = np.flatnonzero(~new)
                if not _alike(data, lo[order[held]], lo[order[held - 1]], n[order[held]] + length - 1).all():
                    raise RuntimeError("two fragments share 128 bits of hashes")
                cut = np.flatnonzero(new)
                size = np.diff(np.concatenate([cut, [len(k)]]))
                k, c, several = k[cut], c[cut], size > 1
                first = order[cut]
                bucket = ((k >> U(32)) * U(buckets)) >> U(32)
                # equal fragments of one unit: repeated, whatever the others have
                alike = order[np.repeat(several, size)]
                rows = [own, (unit % buckets, unit, 2, len(lo), pack(lo.astype("<u4")), pack(n.astype("<u4")), pack(key))]
                rows.append((unit % buckets, unit, 3, len(alike), pack(np.sort(alike).astype("<u4"))))
                place = first.astype("<u4") << np.uint32(1) | several
                rows += [(q, unit, 0, s.stop - s.start, pack(k[s]), pack(c[s, 0].copy()), pack(place[s]), pack(c[s, 1].copy())) for q, s in parts(bucket)]
                yield table(rows)

    return run


def _judge(hot: int):
    def run(group: pa.Table) -> pa.Table:
        """Answers each unit: 3, fragments that stand elsewhere too; 4, fragments to compare with others of their anchor; 5, those of an anchor with very many."""
        kind = group.column("kind").to_numpy()
        probe = np.flatnonzero(kind == 0)
        out = [own_row(group, int(i)) for i in np.flatnonzero(kind != 0)]
        if len(probe):
            key, content, place, more = (unpack_all([group.column(c)[int(i)].as_py() for i in probe], t) for c, t in (("a", "<u8"), ("b", "<u8"), ("c", "<u4"), ("d", "<u8")))
            at = np.cumsum([0, *group.column("n").to_numpy()[probe]])
            order = np.lexsort((more, content, key))
            k, c, m = key[order], content[order], more[order]
            new_key = np.concatenate([[True], k[1:] != k[:-1]])
            new = new_key | np.concatenate([[True], (c[1:] != c[:-1]) | (m[1:] != m[:-1])])
            cut = np.flatnonzero(new)
            size = np.diff(np.concatenate([cut, [len(k)]]))
            same = np.repeat(size > 1, size)
            kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
            kinds = np.repeat(kinds, np.diff(np.concatenate([np.flatnonzero(new_key), [len(k)]])))
            for what, chosen in ((3, same), (4, new & (kinds > 1) & (kinds <= hot)), (5, new & (kinds > hot))):
                out += [(b, u, what, n, p) for b, u, _, n, p in _answers(group, probe, at, np.sort(order[chosen]), place >> np.uint32(1))]
        return pa.Table.from_batches([table(out)], ARROW_ROW)

    return run


def _by_text(length: int):
    def run(group: pa.Table) -> pa.Table:
        """For each text of a unit: spans of bytes that repeat for sure, and fragments to compare."""
        kind = group.column("kind").to_numpy()
        own_of(kind)
        cell = lambda c, k: [group.column(c)[int(i)].as_py() for i in np.flatnonzero(kind == k)]
        ids, th, n = (unpack(cell(c, 1)[0], "<i8") for c in "abc")
        lo, windows = (unpack(cell(c, 2)[0], "<u4").astype(np.int64) for c in "ab")
        key = unpack(cell("c", 2)[0], "<u8")
        sure, few, many = (np.unique(unpack_all(cell("a", k), "<u4")).astype(np.int64) for k in (3, 4, 5))
        compare = np.union1d(few, many)
        if not len(sure) and not len(compare):
            return ARROW_FOUND.empty_table()
        stop = np.cumsum(n)
        text = np.searchsorted(stop, lo, "right")
        base = (stop - n)[text]
        spans, wanted = {}, {}
        s, e, t = (lo - base)[sure], (lo - base + windows + length - 1)[sure], text[sure]
        for i, p in parts(t):
            spans[i] = np.stack([s[p], e[p]], 1).astype("<i4").tobytes()
        rows = np.zeros(len(compare), WANTED)
        rows["lo"], rows["n"], rows["key"] = (lo - base)[compare], windows[compare], key[compare]
        rows["hot"] = np.isin(compare, many)
        for i, p in parts(text[compare]):
            wanted[i] = rows[p].tobytes()
        some = sorted({*spans, *wanted})
        return pa.table({"id": [None if ids[i] == NO_ID else int(ids[i]) for i in some], "th": th[some], "spans": [spans.get(i, b"") for i in some], "wanted": [wanted.get(i, b"") for i in some]}, ARROW_FOUND)

    return run


def _prefix_keys(t: np.ndarray) -> np.ndarray:
    """The first 8 symbols of each suffix as one integer; zeros from a fragment's end (symbol 0) on."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    key, alive = np.zeros(len(t), U), np.ones(len(t), bool)
    for j in range(8):
        c = padded[j : j + len(t)]
        key = key << U(8) | np.where(alive, c, 0).astype(U)
        alive &= c != 0
    return key


def _dense(order: np.ndarray, sorted_key: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
    return rank


def fragments_text(fragments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The fragments' bytes plus 1, with 0 after each, and where each ends (its 0)."""
    size = np.array([len(f) + 1 for f in fragments], np.int64)
    end = np.cumsum(size) - 1
    t = np.zeros(int(size.sum()), np.uint8)
    inside = np.ones(len(t), bool)
    inside[end] = False
    t[inside] = np.concatenate(fragments) + np.uint8(1)
    return t, end


def transform(fragments: list[np.ndarray]) -> np.ndarray:
    """The multi-string Burrows-Wheeler transform: symbols are bytes plus 1 (no byte of UTF-8 is 255), 0 stands before a first byte.

    Suffixes are sorted in full; the ends of fragments are told apart by the fragments' order.
    """
    t, end = fragments_text(fragments)
    place = np.arange(len(t))
    of = np.searchsorted(end, place)
    key = _prefix_keys(t)
    order = np.argsort(key, kind="stable")
    rank, h = _dense(order, key[order]), 8
    count = len(fragments)
    while rank.max() < len(t) - 1:
        ahead = place + h
        beyond = ahead > end[of]
        second = np.where(beyond, of, rank[np.minimum(ahead, len(t) - 1)] + count)
        pair = rank * (len(t) + count + 1) + second
        order = np.argsort(pair, kind="stable")
        rank = _dense(order, pair[order])
        h *= 2
    before = t[order - 1]
    before[order == 0] = 0
    return before


def lf_mapping(shards: list[np.ndarray]) -> np.ndarray:
    """For each row of the shards' transforms, one after another, the row of the suffix one symbol longer; its own where a fragment begins."""
    out, base = [], 0
    for bwt in shards:
        order = np.argsort(bwt, kind="stable")
        lf = np.empty(len(bwt), np.int64)
        lf[order] = np.arange(base, base + len(bwt))
        first = bwt == 0
        lf[first] = base + np.flatnonzero(first)
        out.append(lf)
        base += len(bwt)
    return np.concatenate(out)


def first_rows(lf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the whole fragment, symbols before the suffix) of each row's suffix, by doubling."""
    root, before = lf, (lf != np.arange(len(lf))).astype(np.int64)
    while True:
        more = before[root]
        if not more.any():
            return root, before
        root, before = root[root], before + more


def _dealt(target: np.ndarray) -> np.ndarray:
    """The stable order of entries by target, by counting passes over 16 bits each."""
    order = np.argsort((target & 0xFFFF).astype(np.uint16), kind="stable")
    top = int(target.max(initial=0)) >> 16
    while top:
        target = target >> 16
        order = order[np.argsort((target[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        top >>= 16
    return order


def repeated_intervals(shards: list[np.ndarray], lf: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, block) of the suffixes that share their first `length` symbols with another suffix of any shard, in the order of the merged transform.

    The interleave is refined from depth 1 on; a row's block is the number of its run of rows with a common prefix of the depth reached, so
    neighbours have a common prefix of `length` where their blocks are equal, and a shorter one elsewhere.
    """
    symbols = np.concatenate([np.sort(bwt) for bwt in shards])  # the first symbols of each shard's rows
    rows = np.argsort(symbols, kind="stable")  # the interleave at depth 1
    rows = rows[symbols[rows] > 0]
    rows, ids = _together(rows, symbols[rows].astype(np.int64), np.zeros(len(rows), np.int64))
    block = np.full(len(lf), -1, np.int64)
    block[rows] = ids
    h, back = 1, lf
    some: np.ndarray | None = None  # LF as often as the powers of two seen so far that the last step needs
    last = length - (1 << (length - 1).bit_length() - 1) if length > 1 else 0
    while h < length and len(rows):
        if last & h:
            some = back if some is None else back[some]
        s = min(h, length - h)
        step = back if s == h else some
        longer = step[rows]
        on = (before[rows] >= s) & (block[longer] >= 0)
        source, longer = block[rows[on]], longer[on]
        target = block[longer]
        order = _dealt(target)
        block[rows] = -1
        rows, ids = _together(longer[order], target[order], source[order])
        block[rows] = ids
        h += s
        if h < length:
            back = back[back]
    return rows, block[rows]


def _together(rows: np.ndarray, target: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of runs of equal (target, source) with several rows, and each run's number."""
    if not len(rows):
        return rows, target
    new = np.concatenate([[True], (target[1:] != target[:-1]) | (source[1:] != source[:-1])])
    size = np.diff(np.concatenate([np.flatnonzero(new), [len(rows)]]))
    several = np.repeat(size > 1, size)
    return rows[several], np.cumsum(new[several]) - 1


def _spread(data: np.ndarray, place: np.ndarray, n: np.ndarray, key: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(place, windows, key) of the fragments cut where a further anchor changes; equal windows stay under equal keys."""
    for other in FURTHER:
        size = n + length - 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        step = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], size)
        lo, windows, more, _ = _anchored(data[np.repeat(place, size) + step], offsets, length, gram, other)
        of = np.searchsorted(offsets, lo, "right") - 1
        place, n, key = place[of] + lo - offsets[of], windows, mix(key[of] ^ more)
    return place, n, key


def _shards(length: int, gram: int, buckets: int):
    def run(batches):
        number = count()
        for b in batches:
            wanted = b.column("wanted")
            for rows, ids, th, data, offsets in _pieces(b):
                found = [np.frombuffer(wanted[i].as_py(), WANTED) for i in range(rows.start, rows.stop)]
                size = [len(f) for f in found]
                if not sum(size):
                    continue
                base = np.repeat(offsets[:-1], size)
                found = np.concatenate(found)
                unit, own = unit_rows(next(number), ids, th, np.diff(offsets), buckets)
                place, n, key, hot = base + found["lo"], found["n"].astype(np.int64), found["key"], found["hot"] > 0
                if hot.any():
                    more = _spread(data, place[hot], n[hot], key[hot], length, gram)
                    place, n, key = (np.concatenate([x[~hot], y]) for x, y in zip((place, n, key), more))
                bucket = (((key >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                out = [own]
                for k, s in parts(bucket[order]):
                    some = order[s]
                    bwt = transform([data[p : p + m] for p, m in zip(place[some].tolist(), (n[some] + length - 1).tolist())])
                    out.append((k, unit, 0, len(some), pack(bwt), pack(place[some].astype("<u4"))))
                yield table(out)

    return run


def _merge(length: int):
    def run(group: pa.Table) -> pa.Table:
        """Merges a bucket's shards and answers each unit with the places of its windows in repeated intervals."""
        kind = group.column("kind").to_numpy()
        shard = np.flatnonzero(kind == 0)
        out = [own_row(group, int(i)) for i in np.flatnonzero(kind == 1)]
        if len(shard):
            counts = group.column("n").to_numpy()[shard]
            shards = [unpack(group.column("a")[int(i)].as_py(), "u1") for i in shard]
            home = unpack_all([group.column("b")[int(i)].as_py() for i in shard], "<u4").astype(np.int64)
            lf = lf_mapping(shards)
            root, before = first_rows(lf)
            rows, _ = repeated_intervals(shards, lf, before, length)
            # the first rows of a shard are its fragments' ends, in their order
            base = np.cumsum([0, *(len(s) for s in shards)])[:-1]
            end = np.concatenate([b + np.arange(c) for b, c in zip(base, counts)])
            fragment = np.empty(len(lf), np.int64)
            fragment[root[end]] = np.arange(len(end))
            of = fragment[root[rows]]
            where = home[of] + before[rows]
            unit = np.repeat(np.arange(len(shard)), counts)[of]
            order = np.argsort(unit, kind="stable")
            for k, s in parts(unit[order]):
                mine = np.unique(where[order][s]).astype("<u4")
                out.append((0, group.column("unit")[int(shard[k])].as_py(), 0, len(mine), pack(mine)))
        return pa.Table.from_batches([table(out)], ARROW_ROW)

    return run


JOINED = "aggregate(array_sort(collect_set({0})), cast('' as binary), (a, b) -> concat(a, b))"


def repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 64, id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(id, th, spans): for each text that has any, byte spans [start, end) (32-bit little-endian pairs, which may overlap) that cover
    exactly the bytes of windows of `length` bytes that start in another place too, in the same text or another one.

    th: xxhash64 of the text, which tells repeated ids apart. Null and short texts have none. hot: an anchor with more differing
    fragments than this has them spread; the result is the same. Ids are whole numbers.
    """
    if not 8 < gram <= length:
        raise ValueError("8 < gram <= length")
    spark = docs.sparkSession
    ship(spark)
    buckets = buckets_for(docs, text, 1.0)
    own = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    said = own.mapInArrow(_anchor_rows(length, gram, buckets), ROW).groupBy("bucket").applyInArrow(_judge(hot), ROW)
    found = said.groupBy("unit").applyInArrow(_by_text(length), FOUND)
    found = materialize(found.groupBy("id", "th").agg(F.expr(JOINED.format("spans")).alias("spans"), F.expr(JOINED.format("wanted")).alias("wanted")), "anchors")
    w = found.filter("octet_length(wanted) > 0").select(F.col("id").alias("i"), F.col("th").alias("t"), "wanted")
    texts = own.join(w, own.id.eqNullSafe(F.col("i")) & (own.th == F.col("t"))).select("id", "th", "text", "wanted")
    merged = texts.mapInArrow(_shards(length, gram, buckets), ROW).groupBy("bucket").applyInArrow(_merge(length), ROW)
    more = merged.groupBy("unit").applyInArrow(_spans(0, length, 1), SPANS)
    both = found.filter("octet_length(spans) > 0").select("id", "th", "spans").unionByName(more)
    return both.groupBy("id", "th").agg(F.expr(JOINED.format("spans")).alias("spans"))


def _cut(rest: list[str], id: str, text: str):
    def run(batches):
        for b in batches:
            n, removed, count, digest, left, runs = [], [], [], [], [], []
            for t, x in zip(b.column(text), b.column("_fathomgrid_spans")):
                own = (t.as_py() or "").encode()
                pairs = np.frombuffer(x.as_py() or b"", "<i4").reshape(-1, 2)
                kept, at, mine = [], 0, []
                for s, e in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                    if s > at or not mine:
                        kept.append(own[at:s])
                        mine.append([s, e])
                    at = max(at, e)
                    mine[-1][1] = at
                kept = b"".join([*kept, own[at:]])
                n.append(len(own))
                removed.append(len(own) - len(kept))
                count.append(len(mine))
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
                runs.append(mine)
            made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary()), pa.array(runs, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *made], [*rest, "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_kept", "_spans"])

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 64, id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """docs without text, with _n_bytes, _n_removed, _n_spans (maximal removed runs), _kept_sha256, _kept (the remaining bytes) and _spans.

    A byte of the text (UTF-8) goes if a string of `length` bytes covers it that also starts anywhere else; strings are
    judged on the input, and every occurrence goes. What remains may cut a character, so it is binary. Null text: no bytes.
    Repeated rows are places of their own, so they lose what is long enough. Null ids are ids like others. Empty
    table: empty result.
    """
    rest = others(docs, text, "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_kept", "_spans")
    s = materialize(repeated_bytes(docs, length, gram, id, text, hot), "repeats")
    s = s.select(F.col("id").alias("_fathomgrid_i"), F.col("th").alias("_fathomgrid_t"), F.col("spans").alias("_fathomgrid_spans"))
    both = docs.join(s, docs[id].cast("long").eqNullSafe(F.col("_fathomgrid_i")) & (F.xxhash64(docs[text]) == F.col("_fathomgrid_t")), "left")
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]
    kinds += ["_n_bytes long", "_n_removed long", "_n_spans long", "_kept_sha256 string", "_kept binary", "_spans array<array<int>>"]
    return both.select(*(docs[c] for c in rest), docs[text], "_fathomgrid_spans").mapInArrow(_cut(rest, id, text), ", ".join(kinds))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
