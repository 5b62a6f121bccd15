"""The factorization machine: the score against its definition, pairs that additive weights miss, held-out labels."""

import zlib

import numpy as np
import pytest

from roadloom.llm import hashing, toxicity

from .test_operators import DATA, ODD, SCHEMA, clashing

LARGER = DATA.replace("0.001", "0.1")


def test_score_by_all_pairs():
    rng = np.random.default_rng(1)
    kept = np.arange(0, 60, 2)
    machine = toxicity.Machine(-0.3, kept, rng.normal(0, 1, 30), rng.normal(0, 0.4, (30, 5)))
    row, term = np.array([0, 0, 0, 2, 2, 2, 2]), np.array([0, 7, 8, 2, 10, 58, 59])
    found = machine.scores(*machine.known(row, term), 3)
    for k in range(3):
        at = [int(t) // 2 for r, t in zip(row, term, strict=True) if r == k and t % 2 == 0]
        z = machine.bias + sum(machine.weights[i] for i in at) + sum(float(machine.factors[i] @ machine.factors[j]) for i in at for j in at if i < j)
        assert found[k] == pytest.approx(1 / (1 + np.exp(-z)))


def test_gradient_by_differences():
    """A step of the fit goes down the loss: the loss falls, and far."""
    rng = np.random.default_rng(2)
    row, term = np.repeat(np.arange(200), 3), rng.integers(0, 12, 600)
    y = np.array([(0 in t) == (1 in t) for t in term.reshape(-1, 3).tolist()]).astype(int)
    key = np.unique(row * 12 + term)

    def loss(machine):
        p = machine.scores(*machine.known(key // 12, key % 12), 200)
        return -np.mean(np.log(np.where(y == 1, p, 1 - p)))

    losses = [loss(toxicity.fit(key // 12, key % 12, y, np.arange(12), steps=s)) for s in (0, 40, 400)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.15


def pairs(n, seed):
    """Toxic with both words or with neither: no sum of weights fits."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 40, 12)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["vile"] * bool(insult) + ["those"] * bool(group)
        rows.append((k, " ".join(rng.permutation(words)), int(insult == group)))
    return rows


def test_pairs_beyond_additive_weights(spark, monkeypatch):
    rows = pairs(1500, 3)
    monkeypatch.setattr(toxicity, "MIN_G", 0.0)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, toxic int")
    held = {r[0]: r[2] for r in rows if r[0] % 3 == 0}

    def right(factors):
        machine = toxicity.train(docs, labels, factors=factors)
        found = {r.doc_id: r.score for r in toxicity.scored(docs, machine).collect()}
        return np.mean([(found[i] >= 0.5) == y for i, y in held.items()])

    assert right(toxicity.FACTORS) > 0.9
    assert right(0) < 0.65


def test_held_out_labels(spark):
    out = toxicity.op12_toxicity(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    assert {(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out} == {(r.doc_id, r.held_out) for r in out}
    held = [r for r in out if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.01 * len(clean)
    wins = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean)
    assert wins > 0.96 * len(toxic) * len(clean)


def test_labels_are_no_input_of_a_score(spark, tmp_path):
    """Held-out labels changed, languages and ids shuffled among rows: scores stay."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = labels.where(~toxicity.fold())
    machine = toxicity.train(docs, kept)
    other = toxicity.train(docs, labels.withColumn("quality", 1 - labels.quality).where(~toxicity.fold()))
    score = lambda m, d: sorted(r.score for r in toxicity.scored(d, m).collect())
    assert score(machine, docs) == score(other, docs) == score(machine, docs.selectExpr("-doc_id AS doc_id", "text"))


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, None), (12, 0), (99, 1)], "doc_id long, toxic int")
    machine = toxicity.train(clashing(docs), labels)
    out = toxicity.scored(clashing(docs), machine).collect()
    assert sorted(map(str, (r.doc_id for r in out))) == sorted(str(r[0]) for r in ODD) and all(0 <= r.score <= 1 for r in out)
    empty = [r.score for r in out if r.doc_id in (4, 5, 6)]
    assert len(set(empty)) == 1
    assert toxicity.scored(docs.limit(0), machine).count() == 0
    for y in (0, 1):
        one = toxicity.train(docs, labels.where(f"toxic = {y} and doc_id is not null"))
        assert {r.score for r in toxicity.scored(docs, one).collect()} == {float(y)}
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_terms_of_long_texts_in_chunks():
    text = ("Idiot! " + "plain words " * 50) * 900
    data = np.frombuffer(text.encode(), np.uint8)
    row, term = toxicity.terms(data, np.array([0, len(data)]))
    short = np.frombuffer(b"idiot plain words", np.uint8)
    assert set(term.tolist()) == set(toxicity.terms(short, np.array([0, len(short)]))[1].tolist())
    assert [list(x) for x in hashing.row_runs(np.array([0, 5, len(data)]), 10)] == [[0, 1], [1, 2]]


def test_pieces_of_a_long_text_have_its_terms(monkeypatch):
    """White space at, before and after a cut; words longer than a piece; edges of punctuation."""
    rng = np.random.default_rng(5)
    words = ["a", "(bb)", "ccc,", "--", "x" * 300, "\u00e9t\u00e9", "Idiot!", "word"]
    text = "".join(words[k] + " \n\t  "[j : j + 1 + k % 3] for k, j in zip(rng.integers(0, 8, 400), rng.integers(0, 4, 400), strict=True)) + "end"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    whole = toxicity.terms(data, np.array([0, len(data)]))
    for limit in (1, 7, 64, 299, 1000):
        monkeypatch.setattr(toxicity, "CHUNK_BYTES", limit)
        found = list(toxicity.pieces(data, 0, len(data), limit))
        assert found[0][0] == 0 and found[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
        row, term = toxicity.terms(data, np.array([0, len(data)]))
        assert term.tolist() == whole[1].tolist() and set(row.tolist()) == {0}
