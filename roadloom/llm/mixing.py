"""Mixing sources to target weights with soft memberships.

Domains are the classes of a labelled table: clean, low quality and toxic. A softmax classifier on hashed
words (without the punctuation at their edges) is fitted on labelled rows (at most MAX_LABELLED of them, chosen by a hash of the id; everything else
covers all rows) and gives every document posteriors p over the domains. Document rates r >= 0 then solve

    minimise  1/2 sum_k (sum_d w_d p_dk r_d / W - t_k)^2 + RIDGE / 2 * sum_d w_d / W * (r_d - 1)^2

(w: tokens of a document, W: all tokens, t: target weights) by projected gradient steps with momentum. A step needs only
the current domain totals; the rate of a document follows from its posterior and the totals of the steps so
far, so a step is one distributed sum of a few numbers over a stored table, and no rates are ever kept. The ridge holds
totals off the targets; what is missing is added to the targets every few steps, until they are met. Targets that no rates
reach (every document's posterior of a domain above its share, say) are reported by a warning and by `mixture`.

Posteriors are the classifier's own, calibrated by a temperature that is chosen on labelled rows held out from a first fit.
Where a target asks for less of a domain than the posteriors of the least suspect documents hold, no rates reach it; what is
solved and told then is the nearest mixture that they reach.

Defined results: null and empty texts have no tokens and the rate their posterior (the class shares) gives; null ids and
repeated rows are rows like others; labels of unknown or null ids are ignored; without labels of two domains or
without tokens every rate is 1; an empty table gives an empty one; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing, toxicity

DOMAINS = ["clean", "low", "toxic"]
TARGETS = {"clean": 0.95, "low": 0.04, "toxic": 0.01}
MAX_LABELLED = 8000
FEATURES = toxicity.FEATURES
#: Bytes of the beginnings of words that are features beside the words.
STEMS = (4,)
RIDGE = 1e-4
#: Features get a weight from this number of labelled rows on, whatever their share, if the likelihood-ratio test of
#: presence against some domain reaches MIN_G (a chance of 1e-4 for one feature).
MIN_ROWS, MIN_G = 3, 15.0
STEPS, TOLERANCE = 200, 1e-4
#: Steps between two corrections of the targets for what the ridge holds back.
PERIOD = 40
#: Every so many labelled rows one is held out to calibrate the posteriors, among these temperatures.
HOLD_OUT, TEMPERATURES = 5, np.geomspace(0.25, 4.0, 33)
CHUNK_BYTES = 1 << 18


def features(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of rows: (row, feature) of distinct hashed words, their beginnings and last bytes, sorted by row, and the
    number of words of each row; of all features or of those that the table `known` marks."""
    row, term = toxicity.terms(data, offsets, known, STEMS)
    words = hashing.Words(data, offsets, fold=True)
    last = (hashing.mix(words.bytes[words.end - 1].astype(np.uint64), 9) & np.uint64(FEATURES - 1)).astype(np.int64)
    some = slice(None) if known is None else known[last]
    key = np.unique(np.concatenate((row * FEATURES + term, words.row[some] * FEATURES + last[some])))
    return key // FEATURES, key % FEATURES, np.diff(words.row_word)


@dataclass
class Steps:
    """The steps of the solver, from which the rate of any document follows."""

    history: list[np.ndarray] = field(default_factory=list)  # domain totals minus targets at each step

    def rates(self, p: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates after the steps so far, or the point ahead of them where the next gradient is taken."""
        r = before = np.ones(len(p))
        t = 1.0
        y = r
        for e in self.history:
            before, r = r, np.maximum(0.0, y - (p @ e + RIDGE * (y - 1)) / (1 + RIDGE))
            new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y = r + (t - 1) / new * (r - before)
            t = new
        return y if ahead else r


@dataclass
class Model(Steps):
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(DOMAINS))))  # kept features x domains
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # the features that have weights, sorted
    temperature: float = 1.0

    def posteriors(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(self.kept, feature)
        known = at < len(self.kept)
        known[known] = self.kept[at[known]] == feature[known]
        row, at = row[known], at[known]
        z = np.stack([np.bincount(row, self.weights[at, k], minlength=n) for k in range(len(self.bias))], axis=1) + self.bias
        z = np.exp((z - z.max(1, keepdims=True)) / self.temperature)
        return z / z.sum(1, keepdims=True)


def association(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_classes: int) -> np.ndarray:
    """Of every feature the largest likelihood-ratio statistic of its presence against one class."""
    n, total = len(y), np.bincount(cols, minlength=FEATURES).astype(float)
    best = np.zeros(FEATURES)
    for k in range(n_classes):
        size = float(np.sum(y == k))
        both = np.bincount(cols, y[rows] == k, minlength=FEATURES)
        g = np.zeros(FEATURES)
        for seen, a, b in (
            (both, total, size), (total - both, total, n - size), (size - both, n - total, size), (n - total - size + both, n - total, n - size)
        ):
            some = seen > 0
            g[some] += 2 * seen[some] * np.log(seen[some] * n / (a[some] * b))
        best = np.maximum(best, g)
    return best


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_classes: int, steps: int = 100, decay: float = 1e-4) -> Model:
    """Softmax regression on indicators of the features that tell classes apart, by Adam on the whole sample."""
    n = len(y)
    kept = np.flatnonzero((np.bincount(cols, minlength=FEATURES) >= MIN_ROWS) & (association(rows, cols, y, n_classes) >= MIN_G))
    keep = np.isin(cols, kept)
    rows, cols = rows[keep], cols[keep]
    at = np.searchsorted(kept, cols)
    prior = np.log((np.bincount(y, minlength=n_classes) + 1) / (n + n_classes))
    model = Model([], np.zeros((len(kept), n_classes)), prior, kept)
    target = np.eye(n_classes)[y]
    m, v = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for step in range(1, steps + 1):
        error = (model.posteriors(rows, cols, n) - target) / n
        g = np.stack([np.bincount(at, error[rows, k], minlength=len(kept)) for k in range(n_classes)], axis=1) + decay * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        model.weights -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        model.bias -= 0.5 * error.sum(0)
    return model


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = hashing.text_bytes(batch.column(1))
        row, feature, _ = features(data, offsets)
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts * 4), pa.py_buffer(feature.astype(np.int32))])
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["domain", "features"])


def labelled(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """domain, text of at most `bound` labelled documents."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max(domain).alias("domain"))
    rows = docs.select("doc_id", "text").join(known, "doc_id", "left_semi").select("doc_id")
    # ids alone are ordered; then their texts are fetched
    chosen = known.join(rows.distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # of rows that repeat one is taken: the bound on ids is one on rows
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.first("domain").alias("domain"), F.min("text").alias("text")).select("domain", "text")


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model | None:
    found = labelled(docs, labels, bound).mapInArrow(_hashed, "domain int, features binary").collect()
    if len({r["domain"] for r in found}) < 2:
        return None
    found.sort(key=lambda r: (r["domain"], r["features"]))  # the same sums for any order of arrival
    sizes = np.array([len(r["features"]) // 4 for r in found])
    cols = np.frombuffer(b"".join(r["features"] for r in found), dtype=np.int32)
    rows, y = np.repeat(np.arange(len(found)), sizes), np.array([r["domain"] for r in found])
    model = fit(rows, cols, y, len(DOMAINS))
    model.temperature = calibrated(rows, cols, y)
    return model


def calibrated(rows: np.ndarray, cols: np.ndarray, y: np.ndarray) -> float:
    """The temperature at which a model fitted on the other rows gives the held out ones the least log loss."""
    out = np.arange(len(y)) % HOLD_OUT == 0
    place = np.where(out, np.cumsum(out), np.cumsum(~out)) - 1
    held = out[rows]
    if len(np.unique(y[~out])) < 2:
        return 1.0
    model = fit(place[rows[~held]], cols[~held], y[~out], len(DOMAINS))
    losses = []
    for model.temperature in TEMPERATURES:
        p = model.posteriors(place[rows[held]], cols[held], int(out.sum()))
        losses.append(-np.log(p[np.arange(len(p)), y[out]] + 1e-12).sum())
    return float(TEMPERATURES[int(np.argmin(losses))])


P = [f"p_{k}" for k in DOMAINS]


def _scorer(shared, other: list[str]):
    """Adds n_tokens and posteriors to other columns."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = toxicity.marked(model.kept)
        for batch in batches:
            names = batch.schema.names
            data, offsets = hashing.text_bytes(batch.column(names.index("text")))
            for lo, hi in hashing.row_runs(offsets, CHUNK_BYTES):
                row, feature, n = features(data, offsets[lo : hi + 1], known)
                p = model.posteriors(row, feature, hi - lo)
                part = batch.slice(lo, hi - lo)
                columns = [*(part.column(names.index(k)) for k in other), pa.array(n, pa.int64()), *(pa.array(p[:, i]) for i in range(len(P)))]
                yield pa.RecordBatch.from_arrays(columns, [*other, "n_tokens", *P])

    return score


def _rater(shared):
    """Adds the rate that the steps give to a row's posteriors."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(batch.schema.names.index(k)).to_numpy() for k in P], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.rates(p))], [*batch.schema.names, "rate"])

    return rate


def _totals(shared):
    """Domain totals of tokens times rate at the point of the next gradient, a row per task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(DOMAINS))
        for batch in batches:
            p = np.stack([batch.column(k + 1).to_numpy() for k in range(len(DOMAINS))], axis=1)
            out += (batch.column(0).to_numpy() * shared.value.rates(p, ahead=True)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], [f"t{k}" for k in range(len(DOMAINS))])

    return sums


def solve(model: Steps, scores: DataFrame, targets: dict[str, float], steps: int = STEPS) -> dict[str, float]:
    """Projected gradient over the stored n_tokens and posteriors; adds the steps. Returns the domains'
    totals at the end, as shares of all tokens; a warning tells if they aren't the targets, which then no rates reach."""
    context = scores.sparkSession.sparkContext
    total = scores.agg(F.sum("n_tokens")).head()[0] or 0
    if not total:
        return {}
    goal = np.array([targets[k] for k in DOMAINS])
    columns = scores.select("n_tokens", *(f"p_{k}" for k in DOMAINS))
    missing, now, last = np.zeros(len(goal)), goal, None
    for step in range(1, steps + 1):
        shared = context.broadcast(Steps(list(model.history)))
        parts = columns.mapInArrow(_totals(shared), ", ".join(f"t{k} double" for k in range(len(DOMAINS))))
        now = np.array(parts.agg(*(F.sum(f"t{k}") for k in range(len(DOMAINS)))).head(), dtype=float) / total
        shared.unpersist()
        if np.abs(now - goal).max() < TOLERANCE:
            break
        if step % PERIOD == 0:
            if last is not None and np.abs(now - last).max() < TOLERANCE:
                break  # no nearer to targets out of reach
            missing, last = missing + now - goal, now
        model.history.append(np.round(now - goal + missing, 12))
    if np.abs(now - goal).max() > 10 * TOLERANCE:
        warnings.warn(f"targets {targets} are out of reach; the nearest mixture is {dict(zip(DOMAINS, now.round(4).tolist(), strict=True))}", stacklevel=2)
    return dict(zip(DOMAINS, now.tolist(), strict=True))


def mixture(weighted_: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """domain, target, share: what the rates of `weighted` make of each domain, of all tokens of the documents."""
    sums = weighted_.agg(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{k}")).alias(k) for k in DOMAINS), F.sum("n_tokens").alias("all"))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("domain"), F.lit(float((targets or TARGETS)[k])).alias("target"), (F.col(k) / F.col("all")).alias("share")) for k in DOMAINS)))
    return sums.select(rows.alias("r")).select("r.*")


def weighted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, bound: int = MAX_LABELLED, kept: list[str] | None = None) -> DataFrame:
    """The documents (or some columns of them) with n_tokens, p_clean, p_low, p_toxic and rate. Texts are read once: posteriors are
    stored beside the columns, and rates follow from them."""
    spark = docs.sparkSession
    names = [c for c in kept or docs.columns if c.lower() not in ("n_tokens", "rate", *P)]
    model = train(docs, labels, bound) or Model()
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", n_tokens long, " + ", ".join(f"{k} double" for k in P)
    text = docs.select(*dict.fromkeys([*names, "text"]))
    scores = common.store(text.mapInArrow(_scorer(spark.sparkContext.broadcast(model), names), fields), "scores")
    steps = Steps()
    if np.any(model.weights):
        solve(steps, scores.select("n_tokens", *P), targets or TARGETS)
    return scores.mapInArrow(_rater(spark.sparkContext.broadcast(steps)), f"{fields}, rate double")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents as often as their rates say: the whole part of the rate, and once more if a hash of the
    row falls into the rest. Columns stay as they are."""
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.floor(F.col("rate") + draw).cast("int")
    out = weighted(common.folded(docs, "doc_id", "text"), labels, targets).withColumn("_times", times).where("_times > 0")
    return common.unfolded(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))), docs)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no tokens; null ids and repeated rows are rows like others."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = weighted(docs, common.table(spark, sf_dir, "labels"), kept=["doc_id"])
    return out.select("doc_id", "n_tokens", *(F.round(f"p_{k}", 6).alias(f"p_{k}") for k in DOMAINS), F.round("rate", 6).alias("rate"))
