"""The Merkle manifest against plain Python, on the table and on odd rows."""

import hashlib
import random
import zlib

import pytest

from roadloom.llm import merkle

from .test_operators import DATA, clashing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_brute_force(rows):
    """rows: (doc_id, text, lang, source, n_chars). Sorted tuples of the result's columns."""

    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def climb(nodes):
        """The top, and for each node its path of (left, right)."""
        paths, owner = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i in range(len(paths)):
                at = owner[i]
                run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                paths[i].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
                owner[i] = at // 8
            nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        return (nodes[0] if nodes else None), paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(groups, key=lambda g: b"" if g is None else b"1" + g.encode())
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    root, tops = climb([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            path, fold = path + top, leaf(r, text)
            for left, right in path:
                fold = h(left + fold + right)
            out.append((r[0], own, trees[g][0], root, h("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in merkle.audited(df).collect()), key=str)


def test_table_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = found(docs)
    assert out == by_brute_force([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()])
    assert {r[-1] for r in out} == {True, False}


def random_rows(n, langs, seed):
    rnd = random.Random(seed)
    return [(i, f"Text {rnd.random()} ÄÖ Z", rnd.choice(langs), "web", 7) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(3, "One", "en", "s", 3)],
        [(3, "ONE", "en", "s", 3), (9, "Two", "de", None, None)],
        random_rows(8, ["en"], 1),
        random_rows(9, ["en"], 2),
        random_rows(65, ["en", "de"], 3),
        random_rows(200, ["en", None, "", "é", "z", "Z"], 4),
        random_rows(150, [f"l{k}" for k in range(90)], 5),
        [(None, None, None, None, None)] * 3 + [(None, "A", "en", "s", 1), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (-5, "NEG", "en", "s", 3), (6, "X" * 300_000, "en", "s", 300_000)],
    ],
)
def test_shapes_by_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(clashing(df)) == by_brute_force(rows)


def test_tampering_is_found_and_levels_are_stored(spark):
    rows = random_rows(600, ["en"], 6)
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in merkle.audited(df).collect()}
    assert all(r.verified == (zlib.crc32(str(i).encode()) % 3 != 0) for i, r in out.items())
    from pyspark.sql import functions as F

    built = merkle.manifest(df.select(merkle.group_name(F.col("lang")).alias("g"), F.col("doc_id").alias("id"), merkle.leaf([F.col(c) for c in merkle.COLUMNS]).alias("node")))
    assert [level.count() for level in built.groups.levels] == [75, 10, 2, 1, 1]
    path = built.proofs().select("x.id", "x.node", "root", merkle.folded(F.col("x.node"), F.col("path")).alias("fold")).collect()
    assert len(path) == 600 and all(r.fold == r.root == out[r.id].root for r in path)
