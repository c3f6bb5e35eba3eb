"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, distance-weighted votes.

Terms are lower-case words and their first four and five letters (marked *), and the same with #n where a text has them n
times or more. The vocabulary holds the terms whose share of
toxic training documents is above the prior's beyond chance, so cosines compare what tells, not prose. All such terms of
the toxic texts are in it; beyond max_examples toxic texts, those of so many (drawn by a hash) are. Terms are
counted over all distinct labelled training texts but verified near copies of a counted one with the same label, document
frequencies over all documents. Examples are labelled rows
with at least one term, at most max_examples (drawn by a hash of their text): the index fits a worker, whatever the corpus.
A document without terms is scored by the share of toxic ones among all training rows without terms.

The index has each term's postings in blocks of consecutive examples, with the largest weight in each. A query adds up these maxima to a bound
for each block, visits blocks from the highest bound on, and stops when the bound is below the k-th best cosine:
the k nearest examples are exact, ties by example order included.

Scale: a shuffle of the labelled texts, one of near copies' candidates, one of term counts (pre-aggregated for each batch), bounded
collects. One pass finds the vocabulary's terms in all texts, for document frequencies, examples and, in the query, scores; scoring is a map.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, others, ship, small_or_shuffled
from .textblocks import LOWER, blocks, window_hashes, word_hashes, word_spans

WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5)
LEVELS = (1, 2, 3, 5)
MAX_EXAMPLES = 20_000
#: A term is taken if its toxic documents are so many, its odds so many times the prior's, and if by chance one term or so of all would do as well.
LEAST_DOCS = 3
LEAST_ODDS = 5.0
SHINGLE = 3
#: A near copy is a text whose set of shingles has this Jaccard similarity or more with a kept one's.
NEAR = 0.8
NEIGHBOURS = 15
#: Rows of learn()'s table that a task scores.
ROWS_A_TASK = 16_000
BLOCK = 64
SHRINK = 0.2


def stems(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def levels(counts: dict[str, int]) -> list[str]:
    """Each term, and term#n for each level n that its count reaches."""
    return [t if n == 1 else f"{t}#{n}" for t, c in counts.items() for n in LEVELS if c >= n]


def terms_of(text: str) -> list[str]:
    out: dict[str, int] = {}
    for w, n in Counter(WORD.findall(text.lower())).items():
        for t in stems(w):
            out[t] = out.get(t, 0) + n
    return levels(out)


class Terms:
    """The vocabulary's terms in a text, by number."""

    def __init__(self, vocabulary: list[str]):
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.plain = {t.split("#")[0] for t in vocabulary}
        #: words that neither are nor begin like a term are passed over at once
        self.least = min(PREFIXES)
        self.gate = {t.rstrip("*")[: self.least] for t in self.plain}

    def __call__(self, text: str) -> list[int]:
        n, gate, plain = self.least, self.gate, self.plain
        out: dict[str, int] = {}
        for w in [w for w in WORD.findall(text.lower()) if w[:n] in gate]:
            for t in stems(w):
                if t in plain:
                    out[t] = out.get(t, 0) + 1
        return sorted(i for t in levels(out) if (i := self.number.get(t)) is not None)


def without_longer(terms: list[tuple[str, float]]) -> list[str]:
    """Drops a word or stem if a shorter stem of it is there with no less evidence."""
    at = dict(terms)
    out = []
    for t, z in terms:
        word, _, level = t.partition("#")
        shorter = [word[:n] + "*" for n in PREFIXES if n < len(word.rstrip("*")) or not word.endswith("*") and n == len(word)]
        if not any(at.get(f"{p}#{level}" if level else p, -1.0) >= z for p in shorter):
            out.append(t)
    return out


@dataclass
class Index:
    """Unit vectors of examples in blocks; nearest() is exact."""

    vectors: list[dict[int, float]]
    labels: list[int]
    ids: list[int | None]
    block: int = BLOCK
    postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self):
        by: dict[int, list[tuple[int, float]]] = {}
        for e, v in enumerate(self.vectors):
            for t, x in v.items():
                by.setdefault(t, []).append((e, x))
        for t, rows in by.items():
            at = np.array([e for e, _ in rows])
            weight = np.array([x for _, x in rows])
            blocks, cut = np.unique(at // self.block, return_index=True)
            self.postings[t] = at, weight, blocks, np.concatenate([cut, [len(at)]])
        self.maxima = {t: np.maximum.reduceat(w, cut[:-1]) for t, (_, w, _, cut) in self.postings.items()}
        self.blocks = -(-len(self.vectors) // self.block)

    def nearest(self, query: dict[int, float], k: int, ties: bool = False) -> list[tuple[int, float]]:
        """(example, cosine) of the k examples of the highest cosine above 0, ties in the examples' order; with ties all that are as near as the k-th."""
        terms = [(t, x) for t, x in sorted(query.items()) if t in self.postings]
        bound = np.zeros(self.blocks)
        for t, x in terms:
            bound[self.postings[t][2]] += x * self.maxima[t]
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        for b in order.tolist():
            if bound[b] <= 0 or len(best) >= k and bound[b] < -best[k - 1][0] - 1e-12:
                break
            score = np.zeros(self.block)
            for t, x in terms:
                at, weight, blocks, cut = self.postings[t]
                i = np.searchsorted(blocks, b)
                if i < len(blocks) and blocks[i] == b:
                    s = slice(cut[i], cut[i + 1])
                    score[at[s] - b * self.block] += x * weight[s]
            best += [(-round(float(score[i]), 12), b * self.block + int(i)) for i in np.flatnonzero(score)]
            best.sort()
            if len(best) > k:
                del best[bisect_right(best, best[k - 1][0], key=lambda e: e[0]) if ties else k :]
        return [(e, -s) for s, e in best]


@dataclass
class Model:
    vocabulary: list[str]
    idf: list[float]
    examples: list[tuple[list[int], int, int | None]]
    prior: float
    empty: float
    k: int = NEIGHBOURS

    def build(self) -> Model:
        self.terms = Terms(self.vocabulary)
        unit = [self.unit(v) for v, _, _ in self.examples]
        self.index = Index(unit, [y for _, y, _ in self.examples], [i for _, _, i in self.examples])
        self.memo: dict = {}
        return self

    def unit(self, terms: list[int]) -> dict[int, float]:
        length = math.sqrt(sum(self.idf[t] ** 2 for t in terms))
        return {t: self.idf[t] / length for t in terms}

    def score(self, text: str) -> tuple[float, list[tuple[int | None, float, int]]]:
        """Score and evidence: (id, cosine, label) of the neighbours. A vote weighs cosine / (1.05 - cosine); SHRINK votes are for the prior.

        Examples as near as the k-th share the votes that are left, so no order of the examples reaches a score.
        """
        return self.score_terms(self.terms(text))

    def score_terms(self, counts: list[int]) -> tuple[float, list[tuple[int | None, float, int]]]:
        """score() of a text with these terms."""
        if not counts:
            return self.empty, []
        key = tuple(counts)
        if key not in self.memo:
            if len(self.memo) > 5_000:
                self.memo.clear()
            near = self.index.nearest(self.unit(counts), self.k, ties=True)
            last = near[-1][1] if near else 0.0
            alike = sum(c == last for _, c in near)
            share = (min(self.k, len(near)) - len(near) + alike) / max(alike, 1)
            votes = [(c / (1.05 - min(c, 1.0)) * (share if c == last else 1.0), self.index.labels[e]) for e, c in near]
            total = sum(w for w, _ in votes)
            s = (sum(w * y for w, y in votes) + SHRINK * self.prior) / (total + SHRINK)
            self.memo[key] = min(max(s, 0.0), 1.0), [(self.index.ids[e], c, self.index.labels[e]) for e, c in near[: self.k]]
        return self.memo[key]


def held_out(id) -> F.Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 5 == 0


def _term_counts(batches):
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            every, toxic = Counter(), Counter()
            for t, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist()):
                own = terms_of(t or "")
                every.update(own)
                if y:
                    toxic.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[t] for t in every], pa.int64())], ["term", "n", "toxic"])


def _own_terms(batches):
    """The distinct terms of each batch of texts."""
    for b in batches:
        own = set()
        for t in b.column("text"):
            own.update(terms_of(t.as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string())], ["term"])


def _shingles(texts: pa.Array):
    """(first row, rows, row of each shingle from there, its hash) for each block of texts; texts of fewer words have none."""
    for row, data, offsets in blocks(texts):
        starts, ends, text = word_spans(LOWER[data], offsets)
        h = window_hashes(word_hashes(LOWER[data], starts, ends), SHINGLE)
        whole = text[: len(h)] == text[SHINGLE - 1 :][: len(h)]
        yield row, len(offsets) - 1, text[: len(h)][whole], h[whole]


def _signed(batches):
    """The smallest hash of each text's shingles of words: near copies mostly share it, and so may others."""
    for b in batches:
        s = np.zeros(b.num_rows, np.uint64)
        for row, n, text, h in _shingles(b.column("text")):
            least = np.full(n, np.iinfo(np.uint64).max)
            np.minimum.at(least, text, h)
            # texts too short for a shingle stand for themselves
            own = b.column("o").slice(row, n).to_numpy(zero_copy_only=False).view(np.uint64)
            s[row : row + n] = np.where(least == np.iinfo(np.uint64).max, own, least)
        yield pa.RecordBatch.from_arrays([b.column("o"), b.column("y"), pa.array(s.view(np.int64))], ["o", "y", "s"])


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    for row, n, text, h in _shingles(texts):
        cut = np.searchsorted(text, np.arange(n + 1))
        for i in range(n):
            out[row + i] = np.unique(h[cut[i] : cut[i + 1]])
    return out


def _similar(batches):
    """o of the rows whose text and other have shingle sets of similarity NEAR or more."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            near = []
            for o, x, y in zip(part.column("o").to_pylist(), _sets(part.column("text")), _sets(part.column("other"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and both >= NEAR * (len(x) + len(y) - both):
                    near.append(o)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64())], ["o"])


def _without_copies(train: DataFrame) -> DataFrame:
    """(o, text, y): each text of train once, toxic if any of its rows is, but for near copies of a kept text with the same label.

    Candidates meet their group's first text by the least shingle hash and the label; that text stays, and of the others
    only those go whose whole shingle sets are similar to it.
    """
    texts = materialize(train.groupBy("o").agg(F.max("y").alias("y"), F.first("text").alias("text")), "texts")
    signed = materialize(texts.mapInArrow(_signed, "o long, y int, s long"), "signed")
    first = materialize(signed.groupBy("s", "y").agg(F.min("o").alias("keep"), F.count("*").alias("n")).filter("n > 1").select("s", "y", "keep"), "first")
    pairs = materialize(signed.join(small_or_shuffled(first), ["s", "y"]).filter("o <> keep").select("o", "keep"), "pairs")
    kept = texts.select(F.col("o").alias("keep"), F.col("text").alias("other"))
    both = texts.join(small_or_shuffled(pairs), "o").select("o", "keep", "text").join(kept, "keep").select("o", "text", "other")
    near = materialize(both.mapInArrow(_similar, "o long"), "near")
    return texts.join(small_or_shuffled(near), "o", "left_anti")


def _vectors(vocabulary: list[str]):
    def run(batches):
        terms = Terms(vocabulary)
        for b in batches:
            v = [terms(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("o"), pa.array(v, pa.list_(pa.int32()))], ["id", "o", "t"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> Model:
    """learn() without its table."""
    return learn(docs, labels, id, text, label, max_examples, k)[0]


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> tuple[Model, DataFrame]:
    """The model and a table (id, o, t) of the numbers t of the vocabulary's terms in the text of each row of docs, o the text's hash.

    Learns from the rows of docs with a label whose crc32(id as text) mod 5 is not 0.

    Rows of labels without id or label are passed over; of several labels of an id the largest counts. No training rows:
    a model that scores everything 0. Ids and the order of rows change no score. max_examples bounds the texts that
    the vocabulary and the examples are drawn from, and so what the driver and workers hold; counts cover all rows.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("_i")).agg(F.max(label).cast("int").alias("y"))
    known = materialize(known.filter(~held_out(F.col("_i"))), "labels")
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("o"))
    train = own.join(small_or_shuffled(known), F.col("id") == F.col("_i")).drop("_i")
    rows, toxic = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not rows:
        return Model([], [], [], 0.0, 0.0, k), own.select("id", "o", F.array().cast("array<int>").alias("t"))
    single = _without_copies(train).select("o", "text", "y")
    total, bad = single.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = single.mapInArrow(_term_counts, "term string, n long, toxic long")
    counts = materialize(counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("x")).filter(F.col("n") >= LEAST_DOCS), "terms")
    evidence = math.log(max(counts.count(), 2))
    share, prior = F.col("x") / F.col("n"), bad / total
    miss = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    told = F.col("n") * (share * F.log(share / prior) + miss) if 0 < prior < 1 else F.lit(0.0)
    telling = (F.col("x") >= LEAST_DOCS) & (share * (1 - prior) >= LEAST_ODDS * prior * (1 - share))
    chosen = counts.filter(telling).withColumn("z", told).filter(F.col("z") >= evidence)
    drawn = single.filter("y = 1")
    if bad > max_examples:
        drawn = drawn.filter(F.col("o") <= drawn.select("o").orderBy("o").limit(max_examples).agg(F.max("o")).first()[0])
    of_drawn = drawn.select("text").mapInArrow(_own_terms, "term string").distinct()
    vocabulary = without_longer([(r.term, r.z) for r in chosen.join(of_drawn, "term", "left_semi").orderBy(F.col("z").desc(), "term").collect()])
    terms = materialize(own.mapInArrow(_vectors(vocabulary), "id long, o long, t array<int>"), "vectors")
    df = {r.t: r.n for r in terms.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    every = terms.count()
    idf = [math.log((every + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(vocabulary))]
    vectors = terms.join(small_or_shuffled(known), F.col("id") == F.col("_i")).drop("_i")
    none, none_toxic = vectors.filter(F.size("t") == 0).agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    some = vectors.filter(F.size("t") > 0).orderBy("o", "y", "t", "id").limit(max_examples).collect()
    # examples with the same leading terms side by side: the blocks' bounds are then tight; ids only order evidence of equal examples
    examples = sorted(((list(r.t), r.y, r.id) for r in some), key=lambda e: (e[0], e[1], e[2] or 0))
    return Model(vocabulary, idf, examples, prior, (none_toxic + prior) / (none + 1), k), terms


def score(docs: DataFrame, model: Model, text: str = "text", evidence: bool = True, name: str = "_score") -> DataFrame:
    """docs with _score (0 to 1; name: another name) and, with evidence, _evidence: the neighbours' id, cosine and label.

    Nothing but the text is used. Null and empty texts are texts without terms. Other columns may hold null and are passed
    on; repeated rows give repeated rows; an empty table an empty one.
    """
    return _scored(docs, model, text, evidence, name, lambda m, t: m.score(t or ""))


def score_vectors(table: DataFrame, model: Model, evidence: bool = True, name: str = "_score") -> DataFrame:
    """learn()'s table with the columns of score(): the same scores as the texts', which are not read again.

    Its files are small for the work in them, so rows are dealt to tasks by number, not by bytes.
    """
    tasks = -(-table.count() // ROWS_A_TASK)
    return _scored(table.repartition(max(tasks, 1), *table.columns), model, "t", evidence, name, lambda m, t: m.score_terms(t or []))


def _scored(docs: DataFrame, model: Model, column: str, evidence: bool, name: str, judge) -> DataFrame:
    ship(docs.sparkSession)
    docs = docs.select(*others(docs, name, *(["_evidence"] if evidence else [])))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value.build()
        for b in batches:
            found = [judge(m, t.as_py()) for t in b.column(column)]
            more = [pa.array([s for s, _ in found], pa.float64())]
            if evidence:
                flat = [n for _, e in found for n in e]
                kinds = [("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]
                parts = [pa.array([n[i] for n in flat], kind) for i, (_, kind) in enumerate(kinds)]
                cuts = np.cumsum([0, *(len(e) for _, e in found)], dtype=np.int32)
                more.append(pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(parts, [n for n, _ in kinds])))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, name, *(["_evidence"] if evidence else [])])

    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{name} double", *(["_evidence array<struct<id:bigint,cosine:double,label:int>>"] if evidence else [])]
    return docs.mapInArrow(run, ", ".join(kinds))


def calibration(scored: DataFrame, labels: DataFrame, bins: int = 10, id: str = "doc_id", label: str = "toxic", name: str = "_score") -> DataFrame:
    """(bin, n, score, share, brier): for each of bins equal ranges of the score its rows with a label, their mean score, the share of toxic ones, and the mean squared difference.

    Rows without score or label are passed over; of several labels of an id the largest counts. Calibrated: score and share agree.
    """
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("_i")).agg(F.max(label).cast("double").alias("_y"))
    s = scored.select(F.col(id).alias("_i"), F.col(name).alias("_s")).filter("_s is not null").join(known, "_i")
    at = F.least(F.floor(F.col("_s") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return s.groupBy(at).agg(F.count("*").alias("n"), F.avg("_s").alias("score"), F.avg("_y").alias("share"), F.avg((F.col("_s") - F.col("_y")) * (F.col("_s") - F.col("_y"))).alias("brier"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs scored below threshold, with the columns of docs as they are, whatever their names.

    Null and empty texts are scored like others; repeated rows stay or go together; an empty table gives an empty one.
    """
    mine = "_fathomgrid_score"
    return score(docs, fit(docs, labels), evidence=False, name=mine).filter(F.col(mine) < threshold).select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, table = learn(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    s = score_vectors(table.select(F.col("id").alias("doc_id"), "t"), model)
    told = F.concat_ws(" ", F.transform("_evidence", lambda e: F.concat_ws(":", e["id"].cast("string"), F.format_number(e["cosine"], 4), e["label"].cast("string"))))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), told.alias("evidence"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
