"""BPE encoding by forced-boundary splitting, decoding, and token counts of huge texts by overlap resynchronisation.

Vocabularies are tokenizers-library .json files given by path; executors must have them at that path. Both operators are
maps over rows: no shuffle, constant memory for each worker (a bounded memo of words), any text whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, others, ship

WHITE = "\t-\r "
#: All letters from U+00C0 to U+0239, whose lower case stays in the range but for U+0130.
LETTER = "A-Za-zÀ-ÖØ-öø-ȹ"
#: Texts of these characters only are cut by the plain patterns below; others by the library's own normaliser and pre-tokenizer.
PLAIN = re.compile("[\x00-\x7f×÷À-ȹ‐-‧‰-⁞€]*")
CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d|"
MEMO = 1 << 18

_loaded: dict = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Words(dict):
    """A bounded memo of two generations: fill(lists of words) sees to it that all of them are in, made many at a time by make(words)."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def fill(self, lists) -> None:
        need = set().union(*lists)
        if len(self) + len(need) > MEMO:  # what has been used since the last time stays at hand
            self.old = dict(self)
            self.clear()
        new = []
        for w in need:
            if w not in self:
                if w in self.old:
                    self[w] = self.old[w]
                else:
                    new.append(w)
        self.update(zip(new, self.make(new)))


class Vocabulary:
    """A tokenizers-library BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        #: for fragments that do not end a word: the same merges, no word end
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges) if self.suffix else self.tok.model)
        self.last = Tokenizer(self.tok.model)
        self.inner.pre_tokenizer = self.last.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.chars = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(self.chars)}
        self.lift = {b: c for b, c in enumerate(self.chars)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.tokens = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]
        self.join = np.frombuffer(self.inside(model["vocab"]), bool)

    def inside(self, vocab) -> bytes:
        """For each byte pair (first * 256 + second), 1 if it stands inside some token: other pairs are certain cuts."""
        out = bytearray(1 << 16)
        for t in vocab:
            t = t.removesuffix(self.suffix) if self.suffix else t
            b = [self.byte[c] for c in t if c in self.byte]
            for x, y in zip(b, b[1:]):
                out[x << 8 | y] = 1
        return bytes(out)

    def fragments(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The words, cut between every two bytes that never stand side by side inside a token, and whether each fragment ends its word."""
        data = np.frombuffer("".join(words).encode(), np.uint8)
        if len(data) == sum(map(len, words)):
            ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum()
        else:
            ends = np.fromiter((len(w.encode()) for w in words), np.int64, len(words)).cumsum()
        cut = np.ones(len(data), bool)
        cut[:-1] = ~self.join[data[:-1].astype(np.uint16) << 8 | data[1:]]
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        stops = np.flatnonzero(cut | last)
        whole = data.tobytes()
        starts = [0, *(stops[:-1] + 1).tolist()]
        return [whole[s:e] for s, e in zip(starts, (stops + 1).tolist())], last[stops]

    def raise_bytes(self, b: bytes) -> str:
        return b.decode("latin-1").translate(self.lift)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers: fragments encoded on their own, then put together."""
        if not words:
            return []
        fragments, last = self.fragments(words)
        ids, at = [], []
        for model, chosen in ((self.inner, np.flatnonzero(~last)), (self.last, np.flatnonzero(last))):
            if len(chosen):
                e = model.encode(self.raise_bytes(b" ".join([fragments[i] for i in chosen])).replace(self.chars[32], " "), add_special_tokens=False)
                ids.append(np.array(e.ids, "<u4"))
                at.append(chosen[np.array(e.word_ids, np.int64)])
        ids, at = np.concatenate(ids), np.concatenate(at)
        ids = ids[np.argsort(at, kind="stable")].tobytes()
        word = np.concatenate([[0], np.cumsum(last)[:-1]])
        stop = 4 * np.cumsum(np.bincount(word[at], minlength=len(words)))
        return [ids[s:e] for s, e in zip([0, *stop[:-1].tolist()], stop.tolist())]

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token, uncut."""
        if not words:
            return []
        flat = " ".join([self.raise_bytes(w.encode()) for w in words])
        return np.bincount(self.last.encode(flat, add_special_tokens=False).word_ids, minlength=len(words)).tolist()

    def by_library(self, text: str) -> list[str]:
        """Pre-tokens as the library's normaliser and pre-tokenizer give them."""
        if self.tok.normalizer is not None:
            text = self.tok.normalizer.normalize_str(text)
        return [bytes(self.byte[c] for c in w).decode() for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Encoder:
    """encode(text) and decode(ids) as the library's with add_special_tokens=False and skip_special_tokens=False."""

    PATTERN = re.compile(f"{CONTRACTION}[{LETTER}]+|[0-9]|[^{WHITE}{LETTER}0-9]+")

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.memo = Words(self.v.encode_words)
        self.as_is = {s: np.array([i], "<u4").tobytes() for s, i in self.v.special.items()}

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            return self.PATTERN.findall(text.lower())
        return self.v.by_library(text)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [[p if p in self.as_is else self.words(p) for p in (self.v.marks.split(t) if self.v.marks and "<|" in t else [t])] for t in texts]
        self.memo.fill([p for parts in cut for p in parts if type(p) is list])
        get = self.memo.__getitem__
        return [b"".join([b"".join(map(get, p)) if type(p) is list else self.as_is[p] for p in parts]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str) -> Encoder:
    if ("encoder", path) not in _loaded:
        _loaded["encoder", path] = Encoder(path)
    return _loaded["encoder", path]


def _kinds(df: DataFrame, names: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names]


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: bool = True) -> DataFrame:
    """docs without text, with _n_tokens, _ids_sha256, _decoded_sha256 and, with keep, _ids (array of int) and _decoded.

    For word-level BPE files with a word-end suffix whose normaliser and pre-tokenizer are those of word_bpe_49k.json.
    Null text is empty: no ids, decoded text empty. Any other column may hold null and is passed on; repeated rows give
    repeated rows; an empty table an empty one. The ids and the decoded text are the library's, byte for byte.
    """
    ship(docs.sparkSession)
    more = ["_n_tokens", "_ids_sha256", "_decoded_sha256", *(["_ids", "_decoded"] if keep else [])]
    rest = others(docs, text, *more)

    def run(batches):
        e = encoder(path)
        for b in batches:
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for ids in (ids for at in range(0, b.num_rows, 64) for ids in e.encode_all([t or "" for t in b.column(text).slice(at, 64).to_pylist()])):
                back = e.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if keep:
                    all_ids.append(np.frombuffer(ids, "<i4"))
                    all_text.append(back)
            made = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            made += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())] if keep else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *made], [*rest, *more])

    kinds = [*_kinds(docs, rest), "_n_tokens long", "_ids_sha256 string", "_decoded_sha256 string", *(["_ids array<int>", "_decoded string"] if keep else [])]
    return docs.select(*rest, text).mapInArrow(run, ", ".join(kinds))


class Counter:
    """Token counts as the library's for byte-level BPE with its usual pre-tokenizer; texts over chunk characters in overlapping chunks.

    The pre-tokenizer scans from left to right and looks ahead only: from a place where a pre-token ends, what follows
    does not depend on what came before. A chunk that starts at such a place has all its pre-tokens but the last (which
    the chunk's end may have cut) as the whole text does. So where a pre-token of one chunk, not its last, and one of the
    next chunk end at the same place in their overlap, that place is a boundary of the whole text, and the counts are
    spliced there. If there is none, the overlap is doubled, and once it is the chunk, the chunk.
    """

    PATTERN = re.compile(f"{CONTRACTION} ?[{LETTER}]+| ?[0-9]+| ?[^{WHITE}{LETTER}0-9]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

    def __init__(self, path: str, chunk: int = 32768, overlap: int = 256):
        if not 0 < overlap < chunk:
            raise ValueError("0 < overlap < chunk")
        self.v = vocabulary(path)
        self.chunk, self.overlap = chunk, overlap
        self.memo = Words(self.v.count_words)

    def words(self, text: str) -> list[str]:
        return self.PATTERN.findall(text) if PLAIN.fullmatch(text) else self.v.by_library(text)

    def offsets(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each pre-token of the chunk ends in the whole text, and its tokens."""
        words = self.words(text)
        self.memo.fill([words])
        ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + at
        return ends, np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def resynchronised(self, text: str) -> int:
        n, size, total, done = len(text), self.chunk, 0, 0
        stop = min(n, size)
        ends, counts = self.offsets(text[:stop], 0)
        while stop < n:
            overlap = self.overlap
            while True:
                start = stop - overlap
                if start <= done:  # nothing left to widen: a longer chunk from the last proven place
                    size *= 2
                    stop = min(n, done + size)
                    ends, counts = self.offsets(text[done:stop], done)
                    break
                to = min(n, start + max(size, 2 * overlap))
                ends2, counts2 = self.offsets(text[start:to], start)
                common = np.intersect1d(ends[:-1], ends2[:-1])
                if len(common):
                    p = int(common[-1])
                    total += int(counts[ends <= p].sum())
                    ends, counts = ends2[ends2 > p], counts2[ends2 > p]
                    done, stop, size = p, to, self.chunk
                    break
                overlap *= 2
        return total + int(counts.sum())

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """Counts of many texts; the words of those that are no longer than a chunk are looked up together."""
        parts = [self.v.marks.split(t) if self.v.marks and "<|" in t else [t] for t in texts]
        flat = [p for x in parts for p in x]
        counts = [1 if p in self.v.special else self.resynchronised(p) if len(p) > self.chunk else -1 for p in flat]
        words = {i: self.words(flat[i]) for i, n in enumerate(counts) if n < 0}
        self.memo.fill(words.values())
        for i, x in words.items():
            counts[i] = sum(map(self.memo.__getitem__, x))
        stop = np.cumsum([0, *map(len, parts)])
        return [sum(counts[s:e]) for s, e in zip(stop[:-1].tolist(), stop[1:].tolist())]


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = 32768, overlap: int = 256) -> DataFrame:
    """docs without text, with _n_tokens: tokens of each whole text (null: empty, 0) as the library counts them.

    For byte-level BPE files with the pre-tokenizer of byte_bpe_50k.json; special strings inside texts are one token, as is
    the library's default. Other columns may hold null and are passed on; repeated rows give repeated rows; an empty
    table an empty one.
    """
    ship(docs.sparkSession)
    rest = others(docs, text, "_n_tokens")

    def run(batches):
        key = ("counter", path, chunk, overlap)
        if key not in _loaded:
            _loaded[key] = Counter(path, chunk, overlap)
        count = _loaded[key].count_all
        for b in batches:
            n = [n for at in range(0, b.num_rows, 64) for n in count([t or "" for t in b.column(text).slice(at, 64).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int64())], [*rest, "_n_tokens"])

    return docs.select(*rest, text).mapInArrow(run, ", ".join([*_kinds(docs, rest), "_n_tokens long"]))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    out = encode_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), path or public_tokenizers.path("word_bpe_49k.json"), keep=False)
    return out.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_ids_sha256").alias("ids_sha256"), F.col("_decoded_sha256").alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    out = count_tokens(docs, path or public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", F.col("_n_tokens").alias("n_tokens"), (F.col("_n_tokens") > 512).alias("over_limit"))


QUERIES = {"op4_bpe_encode_decode": op4_bpe_encode_decode, "op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
