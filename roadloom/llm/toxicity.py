"""Toxicity of texts by a factorization machine over hashed terms.

Terms are the distinct words of a text without the punctuation at their edges, A-Z lower-cased, and their first bytes (so that
forms of one stem share a term), hashed to FEATURES numbers. A term has a weight and a vector of FACTORS numbers; the score is the
logistic function of

    bias + sum_i w_i + sum_(i<j) v_i . v_j

over the terms i, j of the text: what two terms mean together (an insult with a mention of a group, say) is learned from
the texts that hold both, which additive weights can't tell. The sum over pairs is half of |sum_i v_i|^2 - sum_i |v_i|^2, so a text
costs its length.

Counts of terms by label are made in tasks and summed by term; a term gets parameters where at least MIN_ROWS labelled
texts hold it and a likelihood-ratio test ties it to the label (MIN_G). Only those terms of at most MAX_LABELLED labelled texts
(the bound of the sample, chosen by a hash of the id) reach the driver, where the machine is fitted. What is broadcast is bounded by
FEATURES. Every text is scored as a whole, in chunks.

Defined results: null and empty texts, and texts without known terms, score the bias; a null id is like others, but has no
label and isn't held out; labels of unknown or null ids and null labels are ignored, of several for one id the toxic one counts;
repeated rows are scored each; without labels of both kinds every score is the share of toxic ones, 0 without any; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

FEATURES = 1 << 18
FACTORS = 8
MAX_LABELLED = 20_000
MIN_ROWS, MIN_G = 3, 8.0
STEPS, RATE, DECAY = 150, 0.05, 1e-4
#: Bytes of the beginnings of words that are terms beside the words.
STEMS = (4, 5, 6)
CHUNK_BYTES = 1 << 18

#: Letters and digits; bytes beyond ASCII belong to letters.
INNER = np.array([k >= 128 or chr(k).isalnum() for k in range(256)])


def pieces(data: np.ndarray, lo: int, hi: int, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of about `limit` bytes that end at white space; a longer word stays whole."""
    while lo < hi:
        end = min(lo + limit, hi)
        while end < hi:
            spaces = np.flatnonzero(hashing.IS_SPACE[data[end : min(end + limit, hi)]])
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(end + limit, hi)
        yield lo, end
        lo = end


def terms(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray]:
    """Of a run of rows (row, term), distinct and sorted; of all terms or of those that the table `known` marks.

    A long row is read a piece at a time: what is held grows with the number of its distinct terms, at most FEATURES."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if len(offsets) != 2 or hi - lo <= CHUNK_BYTES:
        key = _keys(data, offsets, known, stems)
    else:
        seen = np.zeros(FEATURES, dtype=bool)
        for a, b in pieces(data, lo, hi, CHUNK_BYTES):
            seen[_keys(data, np.array([a, b]), known, stems)] = True
        key = np.flatnonzero(seen)
    return key // FEATURES, key % FEATURES


def _keys(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None, stems: tuple[int, ...]) -> np.ndarray:
    """row * FEATURES + term, distinct and sorted."""
    words = hashing.Words(data, offsets, fold=True)
    place, inner = np.arange(len(words.bytes), dtype=np.int32), INNER[words.bytes]
    first = np.minimum.accumulate(np.where(inner, place, np.int32(len(place)))[::-1])[::-1][words.start]
    end = np.maximum.accumulate(np.where(inner, place, np.int32(-1)))[words.end - 1] + 1
    some = first < words.end
    words.start, words.end = np.where(some, first, words.start), np.where(some, end, words.end)
    whole = words.end
    keys = []
    for stem in (0, *stems):
        words.end = np.minimum(whole, words.start + stem) if stem else whole
        hashes = (hashing.mix(words.hashes(), stem) & np.uint64(FEATURES - 1)).astype(np.int64)
        some = slice(None) if known is None else known[hashes]
        keys.append(words.row[some] * FEATURES + hashes[some])
    return np.unique(np.concatenate(keys))


@dataclass
class Machine:
    """kept: the terms with parameters, sorted."""

    bias: float = -np.inf
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def known(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places of parameters of the terms that have some."""
        at = np.searchsorted(self.kept, term)
        ok = at < len(self.kept)
        ok[ok] = self.kept[at[ok]] == term[ok]
        return row[ok], at[ok]

    def summed(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Of every row the sums of its terms' factors."""
        return np.stack([np.bincount(row, self.factors[at, f], minlength=n) for f in range(self.factors.shape[1])], axis=1) if self.factors.shape[1] else np.zeros((n, 0))

    def scores(self, row: np.ndarray, at: np.ndarray, n: int, summed: np.ndarray | None = None) -> np.ndarray:
        summed = self.summed(row, at, n) if summed is None else summed
        own = np.bincount(row, (self.factors[at] ** 2).sum(1), minlength=n)
        z = self.bias + np.bincount(row, self.weights[at], minlength=n) + 0.5 * ((summed**2).sum(1) - own)
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-z))


def marked(kept: np.ndarray) -> np.ndarray:
    """A table of all terms that marks some."""
    out = np.zeros(FEATURES, dtype=bool)
    out[kept] = True
    return out


def fit(row: np.ndarray, term: np.ndarray, y: np.ndarray, kept: np.ndarray, factors: int = FACTORS, steps: int = STEPS) -> Machine:
    """By Adam on the log loss of the whole sample."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    machine = Machine(float(np.log(share / (1 - share))), kept, np.zeros(len(kept)), np.random.default_rng(7).normal(0, 0.05, (len(kept), factors)))
    row, at = machine.known(row, term)
    moments = [np.zeros_like(x) for x in (machine.weights, machine.weights, machine.factors, machine.factors)]
    for step in range(1, steps + 1):
        summed = machine.summed(row, at, len(y))
        error = (machine.scores(row, at, len(y), summed) - y) / len(y)
        weight = error[row]
        g_w = np.bincount(at, weight, minlength=len(kept)) + DECAY * machine.weights
        pulls = [np.bincount(at, weight * (summed[row, f] - machine.factors[at, f]), minlength=len(kept)) for f in range(factors)]
        g_v = (np.stack(pulls, axis=1) if factors else np.zeros((len(kept), 0))) + DECAY * machine.factors
        for k, (x, g) in enumerate(((machine.weights, g_w), (machine.factors, g_v))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        machine.bias -= 0.5 * float(error.sum())
    return machine


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = hashing.text_bytes(batch.column(1))
        for lo, hi in hashing.row_runs(offsets, CHUNK_BYTES):
            row, term = terms(data, offsets[lo : hi + 1])
            cuts = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(cuts), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), found], ["toxic", "terms"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n, hits: the texts of the task that hold a term, and the toxic ones of them."""
    n, hits = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES, dtype=np.int64)
    for batch in batches:
        size = batch.column(1).value_lengths().to_numpy()
        found = batch.column(1).flatten().to_numpy()
        n += np.bincount(found, minlength=FEATURES)
        hits += np.bincount(found[np.repeat(batch.column(0).to_numpy() == 1, size)], minlength=FEATURES)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(hits[some])], ["term", "n", "hits"])


def association(n: Column, hits: Column, rows: int, toxic: int) -> Column:
    """The likelihood-ratio statistic of holding a term against being toxic."""
    cells = ((hits, n, toxic), (n - hits, n, rows - toxic), (toxic - hits, rows - n, toxic), (rows - toxic - n + hits, rows - n, rows - toxic))
    return 2.0 * sum((F.when(seen > 0, seen * F.log(seen * float(rows) / (a * float(b)))).otherwise(0.0) for seen, a, b in cells), F.lit(0.0))


def labelled(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """toxic, text of at most `bound` labelled documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    ids = docs.select("doc_id").distinct()
    # ids alone are ordered; then their texts are fetched
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # of rows that repeat one is taken: the bound on ids is one on rows
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, factors: int = FACTORS, root: str | None = None) -> Machine:
    spark = docs.sparkSession
    root = root or common.shared_dir(spark)
    sample = common.store(labelled(docs, labels, bound).mapInArrow(_hashed, "toxic int, terms array<int>"), "labelled", root)
    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    if toxic in (0, rows):
        return Machine(np.inf if toxic else -np.inf)
    counts = sample.mapInArrow(_counted, "term long, n long, hits long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    telling = counts.where(F.col("n") >= MIN_ROWS).where(association(F.col("n"), F.col("hits"), rows, toxic) >= MIN_G).select("term")
    kept = np.sort(np.array([r.term for r in telling.collect()], dtype=np.int64))  # at most FEATURES numbers
    shared = spark.sparkContext.broadcast(kept)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).flatten().to_numpy()
            ok = np.isin(found, shared.value)
            cuts = np.concatenate(([0], np.cumsum(ok)))[batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()]
            kept_terms = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found[ok]))
            yield pa.RecordBatch.from_arrays([batch.column(0), kept_terms], ["toxic", "terms"])

    found = sorted(sample.mapInArrow(known, sample.schema).collect(), key=lambda r: (r.toxic, r.terms))  # the same sums for any order of arrival
    sizes = [len(r.terms) for r in found]
    term = np.array([t for r in found for t in r.terms], dtype=np.int64)
    return fit(np.repeat(np.arange(len(found)), sizes), term, np.array([r.toxic for r in found]), kept, factors)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        known = marked(machine.kept)
        for batch in batches:
            data, offsets = hashing.text_bytes(batch.column(1))
            for lo, hi in hashing.row_runs(offsets, CHUNK_BYTES):
                row, at = machine.known(*terms(data, offsets[lo : hi + 1], known))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(machine.scores(row, at, hi - lo))], ["doc_id", "score"])

    return score


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(machine)), f"doc_id {kind}, score double")


def fold() -> Column:
    """True where a row is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by a machine that saw no label of the fold that is held out. Null and empty texts score the
    bias; null ids are scored; repeated rows are scored each; an empty table gives an empty one."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, common.table(spark, sf_dir, "labels").where(~fold()))
    out = scored(docs, machine)
    return out.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
