"""Operators against brute force on odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from roadloom.llm import html_text, induced, metric, mixing, near, packing, quality, sketches, substrings, suffixes, tools, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = " ".join(f"word{k % 37}x{k}" for k in range(120))
ODD = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.replace("word5x5 ", "changed "), "en", "b"),
    (4, None, None, None),
    (5, "", "en", "b"),
    (6, " \n\t ", "xx", "b"),
    (7, "a", "en", "b"),
    (8, "the same words " * 400, "en", "b"),
    (9, "é ü ß 漢字 " * 200 + BASE[:600], "fr", "c"),
    (None, BASE, "en", "c"),
    (11, "x" * 70000, "de", "c"),
    (12, "One, two. Three? " * 3, "en", "c"),
    (12, "One, two. Three? " * 3, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def clashing(df):
    """With columns named like the operators' own."""
    for name in ("n", "_id", "_hash", "kept", "spans", "runs", "rate", "n_tokens", "_times", "cls", "label", "n_words", "_text"):
        df = df.selectExpr("*", f"1 AS {name}")
    return df


def test_suffix_order_by_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(60):
        text = [int(x) for x in rng.integers(1, 4, rng.integers(1, 90))] + [0]
        order, lcp = induced.suffix_order(np.array(text, dtype=np.uint8), 40, memory_bytes=(64, 1 << 20)[trial % 2])
        wanted = sorted(range(len(text)), key=lambda i: text[i:])
        assert [text[i : i + 40] for i in order] == [text[i : i + 40] for i in wanted]
        for k in range(1, len(text)):
            a, b = text[wanted[k - 1] :], text[wanted[k] :]
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(40, common)


def removed_by_brute_force(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover, end = bytearray(len(d)), 0
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[max(end, i) : i + length] = b"\1" * (i + length - max(end, i))
                end = i + length
        out.append((len(d), sum(cover), hashlib.sha256(bytes(x for x, c in zip(d, cover) if not c)).hexdigest()))
    return out


def test_suffix_dedup(docs):
    out = suffixes.remove_repeats(docs, 400)
    found = [(r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()]
    assert sorted(found) == sorted(removed_by_brute_force([r[1] for r in ODD], 400))


def test_suffix_dedup_splits_hot_cores(spark):
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefgh ijkl"), n))
    line, passage, whole = "this very common line stands in many of the documents, wherever one looks for it, as", noise(390), noise(500)
    texts = [noise(450) + line + noise(450) for _ in range(60)] + [noise(int(rng.integers(0, 300))) + passage + noise(90) for _ in range(60)]
    texts += [noise(70) + whole[:300] + line + whole[300:] + noise(40) for _ in range(3)] + [texts[0], texts[70]] + [texts[1][200:800]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[1]), (None, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted(removed_by_brute_force([t for _, t in rows], 400))
    for shard in (3000, 1 << 20):
        out = suffixes.remove_repeats(df, 400, shard_bytes=shard, hot_bytes=shard)
        found = [(r.n_bytes, sum(x.end - x.start for x in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()]
        assert sorted(found) == wanted
    seen = []

    def kept(*args, inner=suffixes.pieces_of):
        seen.append(inner(*args))
        return seen[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffixes, "pieces_of", kept)
        suffixes.remove_repeats(df, 400, shard_bytes=3000, hot_bytes=3000)
    sizes = seen[0][1].selectExpr("core", "at.stop - at.first AS size").groupBy("core").sum("size").collect()
    assert seen[0][3] and max(r[1] for r in sizes) <= 3000


def test_substring_dedup(docs):
    texts = [(r[0] if r[0] is not None else 2**63 - 1, (r[1] or "").encode().split()) for r in ODD]
    first = {}
    for i, w in texts:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    wanted = []
    for i, w in texts:
        cover = [0] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                cover[k : k + 13] = [1] * 13
        wanted.append((len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c).decode()))
    for bound in (substrings.FILTER_BYTES, 0):  # by the filter, and by the join beyond its bound
        for base in (3, 7):
            found = [(r.n_words, r.n_removed, r.kept) for r in substrings.remove_copied(docs, base=base, filter_bytes=bound).collect()]
            assert sorted(found) == sorted(wanted)
    assert substrings.levels(13, 5) == [10, 13] and substrings.levels(3, 5) == [3]


def test_near_dedup_on_odd_rows(docs):
    found = near.components_of(docs).collect()
    assert len(found) == len(ODD)
    head = {(r["_id"], r["n"]): r.head_id for r in found}
    none = 2**63 - 1
    assert head[2, 116] == head[3, 116] == head[none, 116] == 1
    assert head[4, 0] == 4 and head[7, 1] == 7 and head[12, 3] == 12
    kept = near.deduplicated(clashing(docs)).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 4, 5, 6, 7, 8, 9, 11, 12])


def test_near_dedup_links_by_brute_force(spark, sample):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in sample.collect():
        w = WORD.findall((r.text or "").translate(fold))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for r in near.op10_near_dedup(spark, DATA).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))


def test_near_dedup_stage_links_from_80_percent(spark):
    rows = []
    for k in range(40):  # pairs of 200 shingles each; every changed word, far from the others, changes five of them
        words = [f"d{k}w{i}" for i in range(204)]
        rows.append((2 * k, " ".join(words)))
        for i in range(3 + k % 3):
            words[10 + 20 * i] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    share = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.8 <= x < 0.85 for x in share) >= 13 and sum(x < 0.8 for x in share) >= 13
    wanted = sorted([*range(0, 80, 2), *(2 * k + 1 for k, x in enumerate(share) if x < 0.8)])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, DATA).collect()) == wanted


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate((a[:3600], rng.integers(0, 2**63, 400).astype(np.uint64)))
    both = np.concatenate((a, b[3600:]))
    m = 1024
    ra, rb, ru = (sketches.registers(x, np.array([0, len(x)]), m)[0] for x in (a, b, both))
    assert (sketches.merge(ra, rb) == ru).all()
    j = sketches.similarity(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([(ra == rb).sum()]), np.array([4000.0]), np.array([4000.0]))
    assert abs(j[0] - 3600 / 4400) < 0.06


def test_quality_base_measures(docs):
    rows = quality.measure(docs.select("doc_id", "text", "lang"), ["doc_id", "text"]).collect()
    for r in rows:
        text = r.text or ""
        w = WORD.findall(text)
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        cover = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["_n_words"], r["_word_chars"], r["_n_dup_lines"], r["_n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
    assert set(quality.judge(clashing(docs)).columns) == set(clashing(docs).columns)


@pytest.mark.parametrize("odd", [False, True])
def test_quality_query_by_sql(spark, tmp_path, odd):
    folder = DATA
    if odd:
        # most texts hold signs, capitals, digits and other scripts as well; rows repeat and hold nulls
        folder = str(tmp_path)
        signs = "Ärger, {0} Straße #1 ÉTÉ 東京 * <b> The of And, und. DER {1} a b c d e f g h "
        extra = [(k, signs.format(k, "x y " * k) * (k + 4), [None, "fr", "xx", "de"][k % 4], None) for k in range(40)]
        df = spark.createDataFrame(ODD + extra, SCHEMA)
        df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'/*.parquet' if odd else ''}'")
    want = con.execute(quality.OP1_SQL).fetchall()
    found = quality.op1_quality_rules(spark, folder)
    assert found.columns == [c[0] for c in con.description]
    plain = lambda rows: sorted(([*map(str, r[:8]), *(x if x is None else round(x, 5) for x in r[8:])] for r in rows), key=str)
    assert plain(want) == plain(map(tuple, found.collect()))


def test_quality_references_from_elsewhere(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    refs = quality.fitted(docs)
    part = docs.where("doc_id < 40")
    whole = {r["doc_id"]: r for r in quality.measure(docs.select("doc_id", "text", "lang"), ["doc_id"]).collect()}
    alone = quality.measure(part.select("doc_id", "text", "lang"), ["doc_id"], refs).collect()
    # with references given, a verdict doesn't depend on the other documents
    assert alone and all(r == whole[r["doc_id"]] for r in alone)
    none = quality.measure(part.select("doc_id", "text", "lang"), ["doc_id"], {}).collect()
    assert all(r["_class_distance"] is None and r["_word_distance"] is None for r in none)


def test_quality_distance(spark):
    row = spark.range(1).selectExpr("array(3L, 1L, 0L) AS c", "array(0.25D, 0.25D, 0.5D) AS q")
    p, q = [0.75, 0.25, 0.0], [0.25, 0.25, 0.5]
    kl = lambda x, y: sum(a * math.log2(a / b) for a, b in zip(x, y) if a)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    assert abs(row.select(quality.distance(row.c, row.q)).head()[0] - math.sqrt((kl(p, m) + kl(q, m)) / 2)) < 1e-12


def test_packing(docs):
    rows = packing.pack(docs, with_ids=True).collect()
    tokenizer = packing.Encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    wanted = Counter(tuple([*tokenizer.ids(r[1] or ""), 0]) for r in ODD)
    pieces = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        pieces[r.sequence_id].append((r.offset, r.length))
    for own in pieces.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(k) * n for k, n in wanted.items())
    assert packing.complete_bins({6: 2, 4: 2, 5: 2, 3: 1, 7: 1}, 10) and sum(n for _, n in packing.complete_bins({6: 2, 4: 2, 5: 2, 3: 1, 7: 1}, 10)) == 4


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "ü\n", "é" * 100000), (None, "n", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = {r.record_id: r for r in warc.read_archives(warc.archive_pages(df)).collect()}
    assert len(rows) == 6
    assert rows["urn:page:2"].record_type == "response" and rows["urn:page:1"].refers_to == "urn:page:2"
    assert rows["urn:page:none"].refers_to == "urn:page:2" and rows["urn:page:3"].refers_to == "urn:page:4"
    assert bytes(rows["urn:page:5"].payload).decode() == "é" * 100000


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>A &amp; B,  one\n two, three, four and more words here.</p><p>Second paragraph, quite long too, with commas.", "A & B, one two, three, four and more words here.\nSecond paragraph, quite long too, with commas."),
        (
            "<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Text, text, text, text and more text in here.<br>Next</p><div class='comments'><p>Nice, very nice, really nice article, thanks.</p></div></article><footer>Foot</footer>",
            "Title\nText, text, text, text and more text in here. Next",
        ),
        ("<div id=sidebar><p>Side, side, side, side, side, side, side.</p></div><div><p>Main, main, main, main, main, main.</p></div><script>var a='<p>no</p>'</script>", "Main, main, main, main, main, main."),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


PARAGRAPHS = "<p>First paragraph, long enough, with some commas, to read as text.</p><p>Second one, long enough as well, and with commas, too.</p>"
READ = "First paragraph, long enough, with some commas, to read as text.\nSecond one, long enough as well, and with commas, too."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content no-sidebar'>{PARAGRAPHS}</div></body>",
        f"<body><div class='has-sidebar'>{PARAGRAPHS}<div class=sidebar><p>Short side, text that is cut.</p></div></div></body>",
        f"<body><div class='post has-comments'>{PARAGRAPHS}<div class=comments><p>Nice, very nice, really, thanks.</p></div></div></body>",
        f"<body><div class='modal-open'><article>{PARAGRAPHS}</article></div></body>",
        f"<body><div class='modal-open'>{PARAGRAPHS}</div><p>Imprint, address, phone and so on.</p></body>",
        f"<body><form id=aspnetForm><input name=q><button>Go</button><div>{PARAGRAPHS}</div><select><option>One</select></form></body>",
        f"<body><form action=x><p>Write to us, please, in this form.</p></form><article>{PARAGRAPHS}</article></body>",
        f"<body><article>{PARAGRAPHS}</article><div class=related><article><p>Another article, a teaser, cut short.</p></article></div></body>",
        f"<body><article>{PARAGRAPHS}</article><div class=comments>" + "<article><p>Long comment, longer than all that stands above, many words, many.</p></article>" * 9 + "</div></body>",
    ],
)
def test_html_wrappers(page):
    assert html_text.main_text(page).removesuffix("\nImprint, address, phone and so on.") == READ


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    rows += [(900, None), (1000, [1.0] * 7 + [None]), (1100, [float("nan")] * 8), (5, rows[5][1]), (1200, [0.0] * 8), (None, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = metric.top_k(df, df.where("vec_id % 100 = 0"), shard_rows=300).collect()
    ok = [(i if i is not None else 2**63 - 1, [math.floor(1024 * x) for x in v]) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    for q, v in [x for x in ok if x[0] % 100 == 0 and x[0] < 2**62]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:10]
        mine = sorted((r["rank"], r.score, r.vec_id) for r in found if r.query_id == q)
        assert [(-s, None if i == 2**63 - 1 else i) for s, i in best] == [(s, i) for _, s, i in mine]


def test_top_k_opens_few_metric_shards(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 6)) * 10
    # 20 clusters, and a third of all rows with one vector
    x = np.concatenate((centres[np.arange(2000) % 20] + rng.normal(size=(2000, 6)) * 0.2, np.repeat(centres[:1], 1000, 0)))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    root = f"file://{tmp_path}/trees"
    found = metric.top_k(rows, rows.where("vec_id % 100 = 0"), shard_rows=100, root=root).toPandas()
    whole = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 3000, 100):
        s = whole @ whole[q]
        want = [k for k in np.lexsort((np.arange(3000), -s)).tolist() if k != q][:10]
        mine = found[found.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want and mine.score.tolist() == s[want].tolist()
    shards = spark.read.parquet(f"{root}/pages").where("centre IS NOT NULL").count()
    asked = spark.read.parquet(f"{root}/near").count() + spark.read.parquet(f"{root}/far").count()
    assert spark.read.parquet(f"{root}/near").count() == 30 and shards > 25 and asked < 30 * shards / 3


def test_top_k_of_mixed_lengths_and_small_shards(spark):
    rows = [(k, [float((k * 7) % 11), float(k % 5), 1.0][: 1 + k % 3]) for k in range(400)] + [(900, []), (1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = metric.top_k(df, df.where("vec_id % 50 = 0"), k=3, shard_rows=20).collect()
    for q, v in [x for x in rows if x[0] % 50 == 0]:
        best = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:3]
        assert best == sorted((-r.score, r.vec_id) for r in found if r.query_id == q)


def test_mixing_meets_targets(spark, sample):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = mixing.weighted(clashing(sample), labels, {"clean": 0.8, "low": 0.15, "toxic": 0.05}).collect()
    total = sum(r.n_tokens for r in out)
    share = {k: sum(r.n_tokens * r.rate * r[f"p_{k}"] for r in out) / total for k in mixing.DOMAINS}
    assert abs(share["clean"] - 0.8) < 0.02 and abs(share["low"] - 0.15) < 0.02 and min(r.rate for r in out) >= 0
    assert mixing.mixed(sample.limit(0), labels).count() == 0


def test_mixing_classifier_on_held_out_rows(spark):
    labels, docs = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("labels", "documents"))
    model = mixing.train(docs, labels.where("doc_id % 2 = 0"))
    rows = mixing.labelled(docs, labels.where("doc_id % 2 = 1")).mapInArrow(mixing._hashed, "domain int, features binary").collect()
    f = [np.frombuffer(r.features, dtype=np.int32) for r in rows]
    p = model.posteriors(np.repeat(np.arange(len(f)), [len(x) for x in f]), np.concatenate(f), len(f))
    assert np.mean(p.argmax(1) == [r.domain for r in rows]) > 0.85


def test_mixing_classifier_finds_rare_toxic_words(spark):
    labels, docs = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("labels", "documents"))
    rows = docs.join(labels.where("quality is not null and toxic is not null"), "doc_id").select("doc_id", "text", "lang", "toxic").collect()
    model = mixing.train(docs, labels.where("doc_id % 2 = 0"))
    found = defaultdict(list)
    for r in rows:
        if r.doc_id % 2 and r.toxic == 1:
            data = (r.text or "").encode()
            row, feature, _ = mixing.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            found["en" if r.lang == "en" else "other"].append(model.posteriors(row, feature, 1)[0].argmax() == 2)
    assert np.mean(found["en"]) > 0.8 and np.mean(found["other"]) > 0.5


def test_mixing_words_lose_edge_punctuation():
    of = lambda t: set(mixing.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1])
    assert len(of(b"(Word),") & of(b"word")) == 2 and len(of(b"-- word")) == 6


def test_tools(spark):
    schemas = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {}}, "required": ["a"], "additionalProperties": False}}
    calls = [
        (1, "c1", 0, "add", '{"a": 1.0, "b": {"z": 1, "y": [2]}}'),
        (1, "c2", 1, "add", '{"a": {"$ref": "c1"}}'),
        (1, "c3", 2, "add", '{"a": {"$ref": "zz"}}'),
        (1, "c4", 3, "add", '{"a": {"$ref": "c5"}}'),
        (1, "c5", 4, "add", '{"a": {"$ref": "c4"}}'),
        (2, "c1", 0, "add", '{"a": -1}'),
        (2, "c1", 5, "add", '{"a": 2}'),
        (2, "c6", 1, "other", "not json"),
        (2, None, 1, "add", None),
    ]
    results = [(1, "c1", "3"), (1, "c2", "4"), (2, "c9", "stray")]
    out = tools.link(
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"),
        spark.createDataFrame(results, "conv_id long, call_id string, content string"),
        schemas,
    ).collect()
    by = {(r.conv_id, r.call_id, r.status): r for r in out}
    assert len(out) == 10
    assert by[1, "c1", "answered"].json == '{"arguments":{"a":1,"b":{"y":[2],"z":1}},"id":"c1","name":"add","result":"3"}'
    assert (by[1, "c2", "answered"].level, by[1, "c2", "answered"].position) == (1, 1)
    assert (1, "c3", "dangling") in by and (1, "c4", "cyclic") in by and (1, "c5", "cyclic") in by
    assert by[2, "c1", "unanswered"].error == "$.a: range" and (2, "c1", "repeated") in by
    assert by[2, "c6", "unanswered"].error == "not JSON" and (2, None, "orphan") in by and (2, "c9", "orphan") in by
    assert json.loads(by[1, "c2", "answered"].json)["arguments"] == {"a": {"$ref": "c1"}}


def test_tools_report_surplus_results_and_missing_roles(spark, tmp_path):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "y"), (1, 2, None, "z"), (2, 5, "assistant", "p"), (2, 5, "assistant", "q")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = tools.op7_tool_call_linking(spark, str(tmp_path)).collect()
    found = sorted((r.call_id, r.status) for r in rows)
    assert found == [("1:0", "answered"), ("1:0", "repeated"), ("1:2", "roleless"), ("2:4", "orphan"), ("2:4", "orphan")]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_and_empty_tables(spark, docs, k):
    rows = docs.selectExpr("*", "cast(length(text) AS long) AS n_chars")
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, rows.limit(0), DATA).count() == 0
    out = stage(spark, rows, DATA)
    assert k == 4 or out.columns == rows.columns
    if k == 0:  # every odd row is junk to the rules: too short, repeated, or far from its language
        assert out.count() == quality.measure(rows, ["doc_id"]).where(quality.accepted()).count()
    else:
        assert out.count() > 0


def test_pipeline_keeps_clean_text(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert len({r.doc_id for r in out}) > 100
