"""Queries against brute force on whole small tables; bounds, crashes, empty tables and clashing columns."""

import hashlib
import json
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from roadloom.llm import html_text, metric, mixing, near, packing, substrings, suffixes, tools, warc

from .test_operators import DATA, ODD, SCHEMA, clashing, removed_by_brute_force


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def runs_by_brute_force(texts, length):
    """Per text (n_removed, n_spans, what is left)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, dtype=np.int32)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        starts = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        out.append((int(gone.sum()), starts, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def test_suffix_query_by_brute_force(spark, rows):
    found = {r.doc_id: r for r in suffixes.op6_suffix_array_dedup(spark, DATA).collect()}
    assert found.keys() == rows.keys()
    for (i, t), (n, spans, left) in zip(rows.items(), runs_by_brute_force(rows.values(), 400), strict=True):
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len((t or "").encode()), n, spans, hashlib.sha256(left).hexdigest())
        assert r.text == left.decode("utf-8", "replace") or "�" in r.text


def test_suffix_dedup_of_two_lengths(spark, rows):
    docs = spark.createDataFrame([(k, t) for k, t in rows.items()] + ODD_TEXTS, "doc_id long, text string")
    out = suffixes.remove_repeats(clashing(docs), 400, short=240).collect()
    texts = [*rows.values(), *(t for _, t in ODD_TEXTS)]
    wanted = zip(runs_by_brute_force(texts, 400), runs_by_brute_force(texts, 240), strict=True)
    assert sorted((bytes(r.kept), len(r.spans)) for r in out) == sorted((a[2], a[1]) for a, _ in wanted)
    assert sorted(r.rest for r in out) == sorted(x[2].decode("utf-8", "ignore") for x in runs_by_brute_force(texts, 240))


ODD_TEXTS = [(10**6 + k, r[1]) for k, r in enumerate(ODD)]


PLANTS = 12


def test_passages_of_over_50_words_do_not_stay(spark, rows, tmp_path):
    """Passages shorter than a string of 400 bytes stay in `text`, as the contract says, and go from `rest`."""
    rng = random.Random(5)
    texts, passages = list(rows.values()), []
    for k in range(PLANTS):
        passage = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 6))) for _ in range(53))
        assert 240 <= len(passage) < 380
        passages.append(passage)
        for _ in range(2):
            words = [f"own{rng.randrange(10**6)}" for _ in range(120)]
            texts.append(" ".join([*words[:60], passage, *words[60:]]))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in suffixes.op6_suffix_array_dedup(spark, str(tmp_path)).collect()}
    left = [x[2] for x in runs_by_brute_force(texts, 400)]
    assert all(found[k].kept_sha256 == hashlib.sha256(x).hexdigest() for k, x in enumerate(left))
    planted = range(len(texts) - 2 * PLANTS, len(texts))
    assert all(found[k].text == texts[k] and passages[(k - planted[0]) // 2][20:-20] not in found[k].rest for k in planted)
    twice = [x[2] for x in runs_by_brute_force([found[k].text for k in range(len(texts))], suffixes.PASSAGE)]
    assert [found[k].rest for k in range(len(texts))] == [x.decode("utf-8", "ignore") for x in twice]


def test_a_shard_many_times_its_memory_bound(spark):
    rng = np.random.default_rng(7)
    shared = "".join(rng.choice(list("abcd"), 3000))
    texts = ["".join(rng.choice(list("abcd"), 700)) + shared[k * 20 : k * 20 + 900] + "".join(rng.choice(list("abcd"), 600)) for k in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffixes.remove_repeats(df, 400, memory_bytes=4096, shard_bytes=1 << 20)  # arrays, text and queues go to files
    found = [(r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()]
    assert sorted(found) == sorted(removed_by_brute_force(texts, 400))


def test_substring_query_by_brute_force(spark, rows):
    words = {i: (t or "").encode().split() for i, t in rows.items()}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    for r in substrings.op8_substring_dedup(spark, DATA).collect():
        w = words[r.doc_id]
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r.doc_id:
                gone[k : k + 13] = [True] * 13
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256, r.text.encode()) == (len(w), sum(gone), hashlib.sha256(left).hexdigest(), left)


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    from roadloom.llm import hashing

    text = ("some words that go on " * 40000 + "x" * 5000 + " end").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = hashing.Words(data, offsets).hashes()
    monkeypatch.setattr(hashing, "PART_BYTES", 1000)
    assert (hashing.Words(data, offsets).hashes() == whole).all()


def test_near_links_on_a_larger_table(spark):
    """Recall of links: every pair of texts with 85 % in common is in one component, and nothing else joins them."""
    path = "/root/testdata/sf0.01"
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        w = re.findall("[^\x20\x09-\x0d]+", (r.text or "").translate(fold))
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    found = {r.doc_id: r.component_id for r in near.op10_near_dedup(spark, path).collect()}
    assert links and sum(found[a] == found[b] for a, b in links) == len(links)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {i: root(i) for i in sets}


def test_near_in_small_blocks_and_without_margin(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(80)] = f"z{rng.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r["_id"]: r.head_id for r in near.components_of(df).collect()}
    small = {r["_id"]: r.head_id for r in near.components_of(df, margin=None, block_bytes=2000).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(60):
        for b in range(a + 1, 60):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert plain == small == {k: root(k) for k in range(60)}


def test_bin_completion_beats_best_fit():
    for capacity, histogram, best in ((10, {6: 1, 5: 1, 4: 3, 2: 3, 8: 1, 3: 1}, 4), (20, {9: 2, 10: 1, 5: 2, 2: 1, 7: 2, 12: 1, 13: 1}, 4)):
        count = lambda patterns: sum(n for _, n in patterns)
        assert count(packing.best_fit(histogram, capacity)) == best + 1
        for effort in (packing.Effort(), packing.EXACT):
            patterns = packing.complete_bins(histogram, capacity, effort)
            assert count(patterns) == best and all(sum(p) <= capacity for p, _ in patterns)
            used = Counter()
            for p, n in patterns:
                used.update({x: k * n for x, k in Counter(p).items()})
            assert used == Counter(histogram)


def test_packing_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(*(public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("json", "tiktoken")))
    rng = random.Random(5)
    texts = ["", "a<|endoftext|>b", "<|endoftext|>", "tab\tand\n\nlines  ", *(r[1] or "" for r in ODD)]
    texts += ["".join(rng.choice("abc XYZ.,'0123\n\té ü-–“") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for t in texts:
        assert list(encoder.ids(t)) == plain.encode(t, add_special_tokens=False).ids
    assert 50256 in encoder.ids("a<|endoftext|>b")
    docs = spark.createDataFrame(ODD, SCHEMA)
    found = defaultdict(list)
    for r in packing.pack(clashing(docs), with_ids=True).collect():
        found[r.doc_id].append((r.start, r.ids))
    wanted = Counter(tuple([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in ODD if r[0] not in (12,))
    assert Counter(tuple(x for _, ids in sorted(p) for x in ids) for i, p in found.items() if i not in (12,)) == wanted


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_mixing_meets_its_default_targets(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    for r in mixing.mixture(mixing.weighted(docs, labels)).collect():
        assert abs(r.share - r.target) < 0.002


def test_mixing_reports_targets_that_cannot_be_met(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.weighted(docs, labels, {"clean": 0.0, "low": 0.0, "toxic": 1000.0})


@pytest.mark.parametrize("targets", [(0.9, 0.08, 0.02), (0.5, 0.5, 0.0), (0.0, 0.0, 0.7)])
def test_mixing_by_brute_force(spark, targets):
    """No rates come nearer to the targets on the posteriors than those that are returned."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    goal = np.array(targets)
    out = mixing.weighted(docs, labels, dict(zip(mixing.DOMAINS, targets, strict=True))).collect()
    p = np.array([[r[f"p_{k}"] for k in mixing.DOMAINS] for r in out])
    a = p * np.array([r.n_tokens for r in out])[:, None]
    a /= sum(r.n_tokens for r in out)
    rate = np.array([r.rate for r in out])
    plain = np.ones(len(out))
    for _ in range(20_000):  # steps of the plain gradient, without ridge
        plain = np.maximum(0.0, plain - a @ (plain @ a - goal) / np.linalg.norm(a, 2) ** 2)
    assert np.linalg.norm(rate @ a - goal) < np.linalg.norm(plain @ a - goal) + 2e-3


ARTICLE = "<p>First paragraph, long enough, with some commas, to read as text.</p>"
READ = "First paragraph, long enough, with some commas, to read as text."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1>Title</h1><div>{ARTICLE * 3}</div><h2>Sub</h2><ul><li>one</li></ul><div><p>Tail, short.</p></div></article>", f"Title\n{READ}\n{READ}\n{READ}\nSub\none\nTail, short."),
        (f"<div><h1>Title</h1><div class=body>{ARTICLE * 3}</div><table><tr><td>cell</td></tr></table><pre>code</pre><blockquote>quote</blockquote></div>", f"Title\n{READ}\n{READ}\n{READ}\ncell\ncode\nquote"),
        (f"<article><h1>T</h1>{ARTICLE}<div class='related-work'>{ARTICLE}</div><p class='notice-period'>The notice period.</p><div class=related><a href=x>Other</a></div></article>", f"T\n{READ}\n{READ}\nThe notice period."),
        (f"<article>{ARTICLE}<p>1 < 2 and <b>3 &lt; 4</b></p></article>", f"{READ}\n1 < 2 and 3 < 4"),
    ],
)
def test_html_blocks_of_an_article(page, text):
    assert html_text.main_text(f"<html><body><nav>Menu</nav>{page}</body></html>") == text


def test_html_generated_pages():
    """Pages with known articles between known junk."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n)) + ", " + word() + "."
    for _ in range(60):
        blocks = [("h1", line(4))]
        for _ in range(rng.randint(2, 8)):
            blocks.append((rng.choice(["p", "p", "p", "h2", "blockquote", "pre"]), line(rng.randint(6, 40))))
        body = "".join(f"<{t}>{x}</{t}>\n" for t, x in blocks)
        junk = [f"<nav><a href=1>{line(3)}</a></nav>", f"<div class='cookie-banner'><p>{line(20)}</p></div>", f"<aside><p>{line(30)}</p></aside>", f"<div class=comments><p>{line(30)}</p></div>", f"<footer>{line(9)}</footer>", f"<div class=ad>{line(12)}</div>", "<script>var a='<p>x</p>';</script>"]
        rng.shuffle(junk)
        page = f"<html><head><title>x</title></head><body>{''.join(junk[:3])}<article>{body}{junk[3]}</article>{''.join(junk[4:])}</body></html>"
        assert html_text.main_text(page) == "\n".join(x for _, x in blocks)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "text", '<a "' * 100_000, "<!" * 200_000, "<i>" * 50_000 + "</b>" * 50_000])
def test_html_takes_linear_time(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 20


def test_tools_survive_huge_numbers_and_lone_surrogates(spark):
    schemas = {"f": {"type": "object", "properties": {"a": {"type": "integer"}}}}
    calls = [(1, "a", 0, "f", '{"a": ' + "9" * 400 + "}"), (1, "b", 1, "f", '{"a": 1, "s": "\\ud800", "r": {"$ref": "\\ud800"}}'), (1, "c", 2, "f", '{"a": 1e400}')]
    out = tools.link(
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"),
        spark.createDataFrame([], "conv_id long, call_id string, content string"),
        schemas,
    ).collect()
    by = {r.call_id: r for r in out}
    assert by["a"].error is None and "9" * 400 in by["a"].json
    assert "\\ud800" in by["b"].json and by["b"].status == "dangling" and by["c"].error == "not JSON"


def test_tools_order_random_graphs(spark):
    rng = random.Random(8)
    calls = []
    for conv in range(12):
        n = rng.randint(1, 14)
        for k in range(n):
            after = [{"$ref": f"c{rng.randrange(n + 1)}"} for _ in range(rng.choice([0, 0, 1, 2]))]
            calls.append((conv, f"c{k}", k, "f", json.dumps({"after": after})))
    out = tools.link(
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"),
        spark.createDataFrame([], "conv_id long, call_id string, content string"),
        {"f": {"type": "object"}},
    ).collect()
    needs = {(c, i): {x["$ref"] for x in json.loads(a)["after"]} for c, i, _, _, a in calls}
    level = {}
    while True:
        new = {k: max((level[k[0], x] for x in v), default=-1) + 1 for k, v in needs.items() if k not in level and all((k[0], x) in level for x in v)}
        if not new:
            break
        level |= new
    for r in out:
        k = (r.conv_id, r.call_id)
        missing = any((r.conv_id, x) not in needs for x in needs[k])
        assert r.level == level.get(k)
        assert r.status == ("unanswered" if k in level else "dangling" if missing else "cyclic")
    for conv in range(12):
        own = sorted((r.position, r.level, r.call_id) for r in out if r.conv_id == conv)
        assert [p for p, _, _ in own] == list(range(len(own)))
        place = {i: p for p, _, i in own}
        assert all(place[x] < place[i] for (c, i), v in needs.items() if c == conv and (c, i) in level for x in v)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0 and warc.read_archives(warc.archive_pages(pages)).count() == 0
    docs = spark.createDataFrame([], SCHEMA)
    assert substrings.remove_copied(docs).count() == 0 and suffixes.remove_repeats(docs).count() == 0 and packing.pack(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert metric.top_k(vectors, vectors).count() == 0
    calls = spark.createDataFrame([], "conv_id long, call_id string, turn long, name string, arguments string")
    assert tools.link(calls, spark.createDataFrame([], "conv_id long, call_id string, content string"), {}).count() == 0


def test_clashing_columns(spark):
    docs = clashing(spark.createDataFrame(ODD, SCHEMA))
    assert suffixes.remove_repeats(docs).count() == len(ODD) and substrings.remove_copied(docs).count() == len(ODD)
    pages = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS points")
    assert sorted((r.text, r.points) for r in html_text.extract(pages).collect()) == [("", 3), (READ, 3)]
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS dim", "4 AS shard")
    assert metric.top_k(vectors, vectors.where("vec_id = 0"), k=2).count() == 2


PARAGRAPH = "This paragraph is long enough to be read, with a comma, and with another one, so that it counts."


@pytest.mark.parametrize(
    "inner",
    [
        '<p>{p}</p><p>Euler found that <math><mi>e</mi><mo>=</mo><mn>0</mn></math> holds, as is well known by now.</p>',
        '<p>{p}</p><svg><text>Figure words</text></svg><p>{p}</p>',
        '<p>{p}</p><dialog open><p>Words of a dialog.</p></dialog>',
        '<p>{p}</p><p aria-hidden="true">Words for eyes alone.</p>',
        '<p>{p}</p><p style="display:none">Words that open later.</p>',
        '<p>{p}</p><p class="comment">A comment of the author.</p>',
    ],
)
def test_words_of_an_article_stay(inner):
    inner = inner.format(p=PARAGRAPH)
    found = html_text.main_text(f"<html><body><nav><a href='/'>Menu</a></nav><article><h1>Title</h1>{inner}</article><div class='comments'><p>{PARAGRAPH} Reader.</p></div></body></html>")
    wanted = re.sub(r"\s+", "", re.sub("<[^>]*>", "", inner))
    assert re.sub(r"\s+", "", found) == "Title" + wanted


def test_names_that_say_more_than_a_class_word_stay():
    market = f'<div class="market-share"><p>{PARAGRAPH} Market.</p></div>'
    rest = f'<div class="story"><p>{PARAGRAPH} One.</p><p>{PARAGRAPH} Two.</p></div>'
    page = f"<html><body><div id='content'>{rest}{market}<div class='share-bar'><a href='#'>Share</a></div></div><div class='comments'><p>Nice one, reader.</p></div></body></html>"
    found = html_text.main_text(page)
    assert "Market." in found and "One." in found and "Share" not in found and "reader" not in found
