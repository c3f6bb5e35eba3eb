"""Substring dedup of word sequences by fixed-block anchors.

A window is `window` consecutive words. Reference blocks are the non-overlapping blocks of (window + 1) // 2 words of each
document, at multiples of that length: any window of any document holds one whole block of that document. All rolling
windows of block length of every document probe the blocks; hits are extended by up to window - block words on either side to
the windows that hold them; the windows' hashes (two of different kinds, 128 bits) say which of them stand in a document with
a smaller id; merged, they are the maximal exact repeats.

Scale: three passes over the texts and no shuffle of texts unless the table of spans is too large to broadcast. Probes
cross the network as sorted 32-bit hashes with 32-bit positions, about five bytes each after compression, dealt to buckets by
hash (see exchange). Work is linear in the words, whatever the size of a group of copies: no pairs are formed.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, others, ship, small_or_shuffled
from .exchange import ARROW_ROW, ROW, bucket_of, buckets_for, own_of, pack, parts, runs_of, table, unit_key, unpack, unpack_all
from .textblocks import blocks, joined, window_hashes, word_checks, word_hashes, word_spans

UNIT = 4 << 20
NO_ID = np.iinfo(np.int64).max
SPANS = "id long, th long, spans binary"
ARROW_SPANS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("spans", pa.binary())])


def _units(batch: pa.RecordBatch, least: int, checks: bool = False):
    """(rows, id, th, words of each text, first word of each text, word hashes, second hashes if wanted) of each unit of a batch."""
    ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    th = batch.column("th").to_numpy(zero_copy_only=False)
    for row, data, offsets in blocks(batch.column("text"), UNIT):
        starts, ends, text = word_spans(data, offsets)
        n = np.bincount(text, minlength=len(offsets) - 1)
        if n.max(initial=0) >= least:
            rows = slice(row, row + len(n))
            yield rows, ids[rows], th[rows], n, np.cumsum(n) - n, word_hashes(data, starts, ends), word_checks(data, starts, ends) if checks else None


def _starts(n: np.ndarray, first: np.ndarray, size: int, least: int) -> np.ndarray:
    """Positions where a run of size words starts within a text of at least `least` words."""
    count = np.where(n >= least, n - size + 1, 0)
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def unit_rows(number: int, ids, th, n, buckets: int):
    """The key of the task's unit of this number, and its own row."""
    key = unit_key(number, ids, th, n)
    return key, (key % buckets, key, 1, len(n), pack(ids), pack(th), pack(n.astype("<i8")))


def _probe(window: int, block: int, buckets: int):
    def run(batches):
        number = count()
        for b in batches:
            for _, ids, th, n, first, h, _ in _units(b, window):
                key, own = unit_rows(next(number), ids, th, n, buckets)
                at = _starts(n, first, block, window)
                hb = window_hashes(h, block)[at]
                aligned = (at - first[np.searchsorted(first, at, "right") - 1]) % block == 0
                order = np.argsort(hb)
                hb, at, aligned = hb[order], at[order], aligned[order]
                # what a unit repeats itself, on a reference block of its own, is answered here and goes on as one entry
                cut = np.flatnonzero(np.concatenate([[True], hb[1:] != hb[:-1]])) if len(hb) else np.zeros(0, int)
                size = np.diff(np.concatenate([cut, [len(hb)]]))
                alike = (size > 1) & np.maximum.reduceat(aligned, cut) if len(cut) else np.zeros(0, bool)
                many = np.repeat(alike, size)
                known = np.sort(at[many]).astype("<u4")
                send = ~many
                send[cut[alike]] = True
                aligned[cut[alike]] = True
                bucket, rest = bucket_of(hb[send], buckets)
                place = (at[send].astype("<u4") << np.uint32(1)) | aligned[send]
                yield table([own, (key % buckets, key, 2, len(known), pack(known)), *((k, key, 0, s.stop - s.start, pack(rest[s]), pack(place[s])) for k, s in parts(bucket))])

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Answers each unit with the places of its probes whose hash is a reference block and stands in another place too."""
    kind = group.column("kind").to_numpy()
    own, probe = np.flatnonzero(kind != 0), np.flatnonzero(kind == 0)
    out = [own_row(group, i) for i in own]
    if len(probe):
        rest = unpack_all([group.column("a")[int(i)].as_py() for i in probe], "<u4")
        place = unpack_all([group.column("b")[int(i)].as_py() for i in probe], "<u4")
        at = np.cumsum([0, *group.column("n").to_numpy()[probe]])
        key = np.sort(rest.astype(np.uint64) << np.uint64(32) | np.arange(len(rest), dtype=np.uint64))
        which = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        value = key >> np.uint64(32)
        cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        size = np.diff(np.concatenate([cut, [len(value)]]))
        good = (size > 1) & np.maximum.reduceat(place[which] & np.uint32(1), cut).astype(bool)
        which = np.sort(which[np.repeat(good, size)])
        out += _answers(group, probe, at, which, place >> np.uint32(1))
    return pa.Table.from_batches([table(out)], ARROW_ROW)


def own_row(group: pa.Table, i: int) -> tuple:
    return tuple(group.column(c)[int(i)].as_py() for c in ARROW_ROW.names)


def _answers(group, rows, at, which, place):
    units = group.column("unit")
    cut = np.searchsorted(which, at)
    for k, i in enumerate(rows):
        if cut[k + 1] > cut[k]:
            mine = np.sort(place[which[cut[k] : cut[k + 1]]]).astype("<u4")
            yield (0, units[int(i)].as_py(), 0, len(mine), pack(mine))


def _spans(before: int, after: int, shorter: int):
    """Joins a unit's answers with its own row: for each text, the runs of [place - before, place + after) within its first n - shorter + 1 places."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        said = np.flatnonzero(kind != 1)
        if (own := own_of(kind)) is None:
            return ARROW_SPANS.empty_table()
        ids, th, n = (unpack(group.column(c)[own].as_py(), "<i8") for c in "abc")
        place = unpack_all([group.column("a")[int(i)].as_py() for i in said], "<u4").astype(np.int64)
        first = np.cumsum(n) - n
        text = np.searchsorted(first + n, place, "right")
        lo = np.maximum(place - before, first[text])
        hi = np.minimum(place + after, first[text] + n[text] - shorter + 1)
        good = lo < hi
        total = int(n.sum())
        step = np.zeros(total + 1, np.int64)
        np.add.at(step, lo[good], 1)
        np.add.at(step, hi[good], -1)
        inside = np.cumsum(step[:-1]) > 0
        # runs must not cross texts: a break is forced before each first word
        begin = np.zeros(total, bool)
        begin[first[n > 0]] = True
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8)]))
        starts = np.flatnonzero(inside & ((edge == 1) | begin))
        nxt = np.ones(total + 1, bool)
        nxt[:-1] = ~inside | begin
        ends = np.flatnonzero(inside & nxt[1:]) + 1
        text = np.searchsorted(first + n, starts, "right")
        base = first[text]
        pairs = np.stack([starts - base, ends - base], 1).astype("<i4")
        cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, int)
        stop = np.concatenate([cut[1:], [len(text)]]) if len(text) else cut
        rows = text[cut]
        return pa.table({"id": [None if x == NO_ID else int(x) for x in ids[rows]], "th": th[rows], "spans": [pairs[s:e].tobytes() for s, e in zip(cut, stop)]}, ARROW_SPANS)

    return run


def _windows(window: int, buckets: int):
    """The hash of each candidate window (spans: where they may start), with its text's id and place."""

    def run(batches):
        number = count()
        for b in batches:
            spans = b.column("spans")
            for rows, ids, th, n, first, h, g in _units(b, window, checks=True):
                key, own = unit_rows(next(number), ids, th, n, buckets)
                at = []
                for i in range(len(n)):
                    for s, e in np.frombuffer(spans[rows.start + i].as_py(), "<i4").reshape(-1, 2).tolist():
                        at.append(np.arange(first[i] + s, first[i] + e))
                at = np.concatenate(at) if at else np.zeros(0, np.int64)
                hw, gw = window_hashes(h, window)[at], window_hashes(g, window)[at]
                order, cut = runs_of(hw, gw)
                hw, gw, at = hw[order], gw[order], at[order]
                own_id = ids[np.searchsorted(first + n, at, "right")]
                # windows that an earlier id of the same unit has too are answered here
                least = np.repeat(np.minimum.reduceat(own_id, cut), np.diff(np.concatenate([cut, [len(hw)]]))) if len(cut) else own_id
                late = own_id > least
                known = np.sort(at[late]).astype("<u4")
                hw, gw, place, own_id = hw[~late], gw[~late], at[~late].astype("<u4"), own_id[~late]
                bucket, _ = bucket_of(hw, buckets)
                yield table([own, (key % buckets, key, 2, len(known), pack(known)), *((k, key, 0, s.stop - s.start, pack(hw[s]), pack(place[s]), pack(own_id[s]), pack(gw[s])) for k, s in parts(bucket))])

    return run


def _later(group: pa.Table) -> pa.Table:
    """Answers each unit with the places of its windows that stand in a text of a smaller id too."""
    kind = group.column("kind").to_numpy()
    own, probe = np.flatnonzero(kind != 0), np.flatnonzero(kind == 0)
    out = [own_row(group, i) for i in own]
    if len(probe):
        h, place, id, g = (unpack_all([group.column(c)[int(i)].as_py() for i in probe], t) for c, t in (("a", "<u8"), ("b", "<u4"), ("c", "<i8"), ("d", "<u8")))
        at = np.cumsum([0, *group.column("n").to_numpy()[probe]])
        order, cut = runs_of(h, g)
        least = np.repeat(np.minimum.reduceat(id[order], cut), np.diff(np.concatenate([cut, [len(h)]])))
        out += _answers(group, probe, at, np.sort(order[id[order] > least]), place)
    return pa.Table.from_batches([table(out)], ARROW_ROW)


def repeated_spans(docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, spans): for each text that has any, the maximal runs of words covered by windows that a smaller id has too.

    spans: pairs of 32-bit little-endian word positions [start, end); th: xxhash64 of the text, which tells repeated ids
    apart. Null texts have no words; null ids come after all others. Texts shorter than a window have no spans. Ids are
    whole numbers; other ids raise as Spark's cast does.
    """
    spark = docs.sparkSession
    ship(spark)
    block = (window + 1) // 2
    buckets = buckets_for(docs, text, 1.5)  # about a sixth of a word a byte, nine bytes each
    own = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    probes = own.mapInArrow(_probe(window, block, buckets), ROW)
    answers = probes.groupBy("bucket").applyInArrow(_shared, ROW)
    near = materialize(answers.groupBy("unit").applyInArrow(_spans(window - block, 1, window), SPANS).dropDuplicates(["id", "th"]), "anchors")
    s = small_or_shuffled(near, F.col("id").alias("i"), F.col("th").alias("t"), "spans")
    candidates = own.join(s, own.id.eqNullSafe(F.col("i")) & (own.th == F.col("t"))).select("id", "th", "text", "spans")
    later = candidates.mapInArrow(_windows(window, buckets), ROW).groupBy("bucket").applyInArrow(_later, ROW)
    return later.groupBy("unit").applyInArrow(_spans(0, window, 1), SPANS).dropDuplicates(["id", "th"])


def _cut(rest: list[str], id: str, text: str):
    def run(batches):
        for b in batches:
            spans = b.column("_fathomgrid_spans")
            texts = b.column(text)
            new, words, removed, digest = texts.to_pylist(), [], [], []
            for row, data, offsets in blocks(texts):
                starts, ends, of = word_spans(data, offsets)
                n = np.bincount(of, minlength=len(offsets) - 1)
                first = np.cumsum(n) - n
                keep = np.ones(len(starts), bool)
                for i in range(len(n)):
                    x = spans[row + i].as_py()
                    for s, e in np.frombuffer(x, "<i4").reshape(-1, 2).tolist() if x else ():
                        keep[first[i] + s : first[i] + e] = False
                left = np.bincount(of[keep], minlength=len(n))
                flat, at, to = joined(data, starts[keep], ends[keep])
                last = np.cumsum(left)
                for i, (k, m) in enumerate(zip(left.tolist(), last.tolist())):
                    mine = flat[at[m - k] : to[m - 1]] if k else b""
                    words.append(int(n[i]))
                    removed.append(int(n[i]) - k)
                    digest.append(hashlib.sha256(mine).hexdigest())
                    if k < n[i]:
                        new[row + i] = mine.decode()
            spans = [[] if x is None else np.frombuffer(x, "<i4").reshape(-1, 2).tolist() for x in spans.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(new, pa.string()), pa.array(words), pa.array(removed), pa.array(digest), pa.array(spans, pa.list_(pa.list_(pa.int32())))], [*rest, text, "_words", "_removed", "_kept_sha256", "_spans"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with, for each row, what is left of its text, and _words, _removed, _kept_sha256, _spans (word positions [start, end)).

    A word goes if a window of so many words covers it whose sequence also starts in a row with a smaller id; windows
    are judged on the input. A text that loses words becomes its kept words joined by one space; others stay as they
    are. The digest is of the kept words joined by one space. Null text: no words. Rows of one id keep what they share;
    null ids come last. Empty table: empty result.
    """
    more = ["_words", "_removed", "_kept_sha256", "_spans"]
    rest = others(docs, text, *more)
    s = materialize(repeated_spans(docs, window, id, text), "repeats")
    s = small_or_shuffled(s, F.col("id").alias("_fathomgrid_i"), F.col("th").alias("_fathomgrid_t"), F.col("spans").alias("_fathomgrid_spans"))
    both = docs.join(s, docs[id].cast("long").eqNullSafe(F.col("_fathomgrid_i")) & (F.xxhash64(docs[text]) == F.col("_fathomgrid_t")), "left")
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]
    kinds += [f"`{text}` string", "_words long", "_removed long", "_kept_sha256 string", "_spans array<array<int>>"]
    return both.select(*(docs[c] for c in rest), docs[text], "_fathomgrid_spans").mapInArrow(_cut(rest, id, text), ", ".join(kinds)).select(*others(docs, *more), *more)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 12), ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM d)),
least_id AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
late AS (SELECT DISTINCT doc_id, p FROM win JOIN least_id USING (k) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM late),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
}
