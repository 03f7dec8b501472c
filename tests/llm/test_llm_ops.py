"""Operators against brute force on small fixtures: nulls, empty and long
texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quire.llm import (bpe_codec, components, html_extract, jaccard_join, language_id, license_scan, packing, quality_cnn,
                       quality_rules, sharding, topk_search, vocab)
from quire.llm.common import read_table

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, q string, shard string, rank int, bucket int"


def frame(spark, texts):
    rows = [(i, t, "en", "s", 0, "x", "y", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    base = [word() for _ in range(300)]
    texts = [None, "", " \n\t ", "one", "one two", "ONE two", "a b c", "A b C", "...!?", "12 345", "x" * 40000,
             " ".join(word() for _ in range(6000)), "漢字 𝔸 🙂<|endoftext|>it's   we'll", "a\u0000b"]
    for k in range(40):
        w = list(base)
        for _ in range(k // 3):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 5 + [" ".join(base[:60]) + " " + " ".join(word() for _ in range(r.randint(5, 400))) for _ in range(40)]
    texts += ["same line\nsame line\nother", "w w w w w w w w w w w w"]
    return frame(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def table(df):
    return [r.asDict() for r in df.collect()]


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k,percent,bounds", [(3, 90, {}), (5, 80, {}), (3, 90, {"max_group": 4}), (2, 60, {"max_elements": 900})])
def test_jaccard_join(spark, odd, k, percent, bounds):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in table(jaccard_join.jaccard_components(odd, words=k, percent=percent, **bounds))}
    assert got == brute_components({r["doc_id"]: r["text"] for r in table(odd)}, k, percent)


def test_jaccard_pivots_find_all_links():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(6):
        centre = r.choice(5000, 120, replace=False)
        for k in range(25):
            s = set(centre.tolist())
            for x in r.choice(centre, k, replace=False).tolist():
                s.discard(x)
                s.add(int(r.integers(5000, 10000)))
            sets.append(np.array(sorted(s), dtype=np.uint64))
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            m = len(np.intersect1d(a, sets[j]))
            if 100 * m >= 80 * (a.size + sets[j].size - m):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    root, _ = jaccard_join.link_group(sets, 80)
    assert root.tolist() == [top(i) for i in range(len(sets))]


def test_linked_sets_share_a_region():
    r = np.random.default_rng(9)
    for percent in (80, 90):
        for _ in range(300):
            n = int(r.integers(5, 400))
            a = np.unique(r.integers(0, 2 ** 63, n).astype(np.uint64) * np.uint64(2))
            b = a.copy()
            while True:
                c = np.unique(np.concatenate([np.delete(b, r.integers(b.size)), r.integers(0, 2 ** 63, 1).astype(np.uint64)]))
                m = np.intersect1d(a, c).size
                if 100 * m < percent * (a.size + c.size - m):
                    break
                b = c
            common = np.sort(r.choice(a, min(a.size, int(r.integers(0, a.size + 1))), replace=False))
            if not np.array_equal(a, b):
                assert np.intersect1d(jaccard_join.region_keys(a, percent, common), jaccard_join.region_keys(b, percent, common)).size


def test_keep_one(spark, odd):
    kept = table(jaccard_join.keep_one(odd))
    exp = {c for _, c in brute_components({r["doc_id"]: r["text"] for r in table(odd)}, 5, 80).values()}
    assert {r["doc_id"] for r in kept} == exp and set(kept[0]) == set(odd.columns)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect())
    seen = components.Forest()
    for a, b in edges:
        if a != b:
            seen.join(a, b)
    assert got == {x: seen.root(x) for x in seen.up}


def test_bpe_round_trip(spark, odd):
    tok = vocab.load_tokenizer(vocab.tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in table(odd)}
    for size in (500, bpe_codec.BUNDLE_BYTES):
        got = {r["doc_id"]: r for r in table(bpe_codec.encode_digest(odd, bundle_bytes=size, classes=7))}
        assert set(got) == set(texts)
        for i, t in texts.items():
            ids = tok.encode(t, add_special_tokens=False).ids
            assert got[i]["n_tokens"] == len(ids)
            assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r["doc_id"]: r for r in table(bpe_codec.encode_decode(odd))}
    assert all(full[i]["decoded"] == t and full[i]["ids"] == tok.encode(t, add_special_tokens=False).ids for i, t in texts.items())


def test_bpe_repeated_rows(spark, odd):
    assert bpe_codec.encode_digest(odd.union(odd)).count() == 2 * odd.count()


def test_packing(spark, odd):
    tok = vocab.load_tokenizer(vocab.tokenizer_path())
    rows = table(packing.pack(odd))
    ids = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in table(odd)}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert part.size == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1])
        assert sum(r["length"] for r in own) == len(ids[i])
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1])
        assert sum(r["length"] for r in own) <= 1024
    assert set(by_doc) == set(ids)
    assert len(by_seq) <= 1.05 * sum(map(len, ids.values())) / 1024 + 1


def test_column_generation_reaches_the_bound():
    units, demand = np.array([3, 5, 7]), np.array([40, 30, 20])
    total = sum(x for _, x in packing.solve_patterns(units, demand.astype(float), 15))
    assert total == pytest.approx((units * demand).sum() / 15, rel=1e-3) or total >= (units * demand).sum() / 15
    plan = packing.plan_sequences(units, demand, 15)
    assert (sum(p * t for p, t in plan) == demand).all() and all((p * units).sum() <= 15 for p, _ in plan)


def test_quality_counts(spark, odd):
    for r in table(quality_rules.annotate(odd)):
        text = r["text"] or ""
        w = WORDS.findall(text)
        windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        q = r["q"]
        assert (q["n_words"], q["word_chars"], q["n_repeat_words"], q["n_dup_lines"], q["n_symbols"]) == (
            len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)), sum(text.count(c) for c in "#*$%&|<>"))


def test_binomial_tail_is_exact(spark):
    from math import comb
    rows = [(n, k) for n in (1, 5, 40, 200) for k in range(0, 8) if k <= n * 0.02 + 1]
    df = spark.createDataFrame(rows, "n long, k long").withColumn("p", quality_rules._binomial_tail(F.col("k"), F.col("n"), 0.02))
    for r in df.collect():
        assert r["p"] == pytest.approx(min(1, sum(comb(r["n"], i) * 0.02 ** i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))), rel=1e-9)


def test_risk_control(spark):
    """Clean documents stay, junk over the certified cutoff goes; without labels nothing but the base rule rejects."""
    rows = [(i, " ".join(f"w{i}x{j}" + ("###" if i % 5 == 0 else "") for j in range(50))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    counts = quality_rules.count_table(docs)
    cut = quality_rules.learn_cutoffs(counts, labels)
    assert "0:symbols" in cut
    assert {r["doc_id"]: r["kept"] for r in table(quality_rules.judge(counts, cut))} == {i: i % 5 != 0 for i, _ in rows}
    assert quality_rules.learn_cutoffs(counts, labels.limit(0)) == {}


def test_sharding(spark, odd):
    twice = odd.union(odd.where("doc_id < 30"))
    for size in (3000, 1 << 20):
        got = table(sharding.shard_digest(twice, bucket_bytes=size))
        assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in table(twice))
        count = collections.Counter(r["shard"] for r in got)
        assert max(count.values()) - min(count.get(s, 0) for s in range(24)) <= 1
        for s in count:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
        text = {r["doc_id"]: r["text"] for r in table(odd)}
        assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode())
                   and r["grown_shard"] is None for r in got)
        assert got == table(sharding.shard_digest(twice, bucket_bytes=size))


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_topk(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], "x") for i in range(260)]
    rows += [(1000, None, "x"), (1100, [1.0, None], "x"), (1200, [float("nan")] * 8, "x"), (1300, [float("inf")] * 8, "x"), (None, [0.5] * 8, "x")]
    rows += [(2000 + i, [0.5] * 8, "x") for i in range(120)] + [(7, rows[7][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    ints = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    exp = []
    for q, v in {(i, tuple(v)) for i, v in ints if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:10]
        exp += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for bounds in ({}, {"cell_docs": 50, "cell_queries": 2}):
        assert sorted(map(tuple, topk_search.top_k(df, **bounds).collect())) == sorted(exp)


def test_topk_prunes():
    r = np.random.default_rng(0)
    centres = r.integers(-900, 900, (20, 16))
    docs = np.repeat(centres, 128, axis=0) + r.integers(-9, 9, (2560, 16))
    ids = np.arange(2560)
    best, best_id, scored = topk_search.block_search(ids, docs, ids[::100], docs[::100], 10)
    assert scored < 0.6 * 26 * 20
    s = docs[::100] @ docs.T
    s[np.arange(26), ids[::100]] = np.iinfo(np.int64).min
    assert (best == np.sort(s, axis=1)[:, ::-1][:, :10]).all()


def test_language_id(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(docs, per_language=60, landmarks=40)
    lang = {r["doc_id"]: r["lang"] for r in table(docs)}
    held = [r for r in table(language_id.identify(docs, model)) if r["held_out"]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in held)


def test_language_id_odd(spark, odd, empty):
    model = language_id.train(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in table(language_id.identify(odd, model))}
    assert [got[i] for i in (0, 1, 2, 8, 9)] == ["und"] * 5 and got[3] == "en"
    assert language_id.train(empty) is None
    assert {r["lang_pred"] for r in table(language_id.identify(odd, None))} == {"und"}


def test_string_kernel_is_normalised():
    rows = language_id.presence(["abcabc", "abcabc", "xyz", "", "é" * 3])
    model = language_id.Model(["a"], rows[:1], np.zeros((1, 1)))
    assert model.kernel(rows)[:2, 0] == pytest.approx([1.0, 1.0]) and model.kernel(rows)[2, 0] < 0.5


def test_quality_cnn(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    model = quality_cnn.train(docs, labels, per_class=250, epochs=8)
    truth = {r["doc_id"]: r["quality"] for r in table(labels)}
    held = [(r["score"], truth[r["doc_id"]]) for r in table(quality_cnn.score(docs, model)) if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.9
    got = table(quality_cnn.score(odd, model))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality_cnn.train(empty, labels.limit(0)) == 0.5
    assert quality_cnn.keep_good(odd, 0.9).columns == odd.columns


def test_cnn_chunks_cover_whole_texts():
    for n in (0, 1, 7, 896, 1023, 1024, 1025, 5000):
        starts = quality_cnn.chunk_starts(n)
        seen = {i for s in starts.tolist() for i in range(s, min(s + quality_cnn.CHUNK, n))}
        assert seen == set(range(n))
    net = quality_cnn.Network()
    far = b"a" * 30000
    assert net.score([far])[0] != net.score([far[:-20] + b"#*$%#*$%#*$%#*$%#*$%"])[0]


def test_cnn_is_fitted_on_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i} " * 3000) for i in range(60)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), 99]], "doc_id long, quality int")
    whole = {(f"{i} " * 3000).encode() for i in range(60)} | {b""}
    monkeypatch.setattr(quality_cnn, "fit", lambda samples, epochs: samples)
    held = {str(i) for i in [*range(60), 99] if zlib.crc32(str(i).encode()) % 3 == 1}
    got = quality_cnn.train(docs, labels)
    assert sorted(raw for raw, _ in got) == sorted(raw for raw in whole if (raw.split() or [b"99"])[0].decode() not in held)
    got = quality_cnn.train(docs, labels, sample_bytes=60000)
    assert {raw for raw, _ in got} <= whole and {y for _, y in got} == {0, 1} and sum(len(raw) for raw, _ in got) <= 60000
    assert isinstance(quality_cnn.train(docs, labels, sample_bytes=1), float)  # no text of one class fits


PAGE = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>'
        '<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>One   two<b>three</b>.<br>four<p>Short.</p>'
        '<div class="ad">Buy</div></article><section class="comments"><p>A reader comment that is long enough to look like text.</p></section>'
        '<aside>Side</aside><form><input value=1>Name</form><footer>&copy; foot</footer>')


def test_html(spark):
    cases = {1: PAGE, 2: None, 3: "", 4: "plain\n text", 5: "<p>a<p>b &eacute;&#x41;", 6: "<<>&#xD800;</div></p><p", 7: "<nav>only menu</nav>",
             8: "<div>" * 3000 + "deep" + "</div>" * 3000, 9: "<p>" + "long word " * 50000}
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in cases.items()], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in table(html_extract.extract(df))}
    assert got[1]["text"] == "Head & line One twothree. four Short."
    assert [got[i]["text"] for i in (2, 3, 4, 5, 7, 8)] == ["", "", "plain text", "a b éA", "", "deep"]
    assert got[9]["text"] == ("long word " * 50000).strip() and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_without_article():
    blocks = html_extract.main_blocks(
        '<body><div class="menu"><a>A</a> <a>B</a></div><div id="content"><h1>Title</h1><p>Long text here of the piece with many words in it.</p>'
        '<p>Short.</p><p>Another longer paragraph with <a href=x>a link</a> and more text.</p></div><div class="footer">foot</div>')
    assert blocks == ["Title", "Long text here of the piece with many words in it.", "Short.", "Another longer paragraph with a link and more text."]


LONG = "A paragraph of the piece that is long enough to be read as running text by anybody. "


def test_html_sibling_articles():
    blocks = html_extract.main_blocks(f"<body><div><article><h2>One</h2><p>{LONG * 3}</p><p>{LONG * 2}</p></article><article><h2>Two</h2><p>{LONG * 2}</p>"
                                      f"<p>Short.</p></article></div><div><a href=x>Home</a> <a href=y>About</a></div></body>")
    assert blocks == ["One", (LONG * 3).strip(), (LONG * 2).strip(), "Two", (LONG * 2).strip(), "Short."]


def test_html_teaser_article_beside_a_div():
    blocks = html_extract.main_blocks(f"<body><article><h3><a href=x>Other news</a></h3><p>Read <a href=x>more</a></p></article>"
                                      f"<div><h1>Title</h1><p>{LONG * 4}</p><p>{LONG * 3}</p><p>Short.</p></div></body>")
    assert blocks == ["Title", (LONG * 4).strip(), (LONG * 3).strip(), "Short."]


@pytest.mark.parametrize("tag", ["div", "section", "article"])
def test_html_ratios_decide(tag):
    """The same words, with one tag or many a line: the ratio alone chooses."""
    def page(a, b):
        return f"<body><{tag}><p>{a}</p></{tag}><div>x</div><div>y</div><div>z</div><{tag}><p>{b}</p></{tag}></body>"
    plain = (LONG * 2).strip()
    tagged = " ".join(f"<i>{w}</i>" for w in plain.split())
    assert html_extract.main_blocks(page(plain, tagged)) == [plain] and html_extract.main_blocks(page(tagged, plain)) == [plain]
    assert html_extract.main_blocks(page(plain, plain)) == [plain, plain]


@pytest.mark.parametrize("start,end", [
    ("<div class='layout has-sidebar'>", "</div>"), ("<div class='no-header'>", "</div>"), ("<div class='page widget'>", "</div>"),
    ("<form id='search'>", "</form>"), ("<div class='sidebar'><div class='menu'>", "</div></div>")])
def test_html_wrappers_do_not_hide_the_text(start, end):
    for inner in (f"<article class='post with-comments'><h1>Title</h1><p>{LONG * 3}</p><p>Short.</p></article>",
                  f"<h1>Title</h1><p>{LONG * 3}</p><p>Short.</p>"):
        page = f"<body><nav><a href=x>Home</a></nav>{start}{inner}{end}<div class='ad'>Buy</div><footer>foot</footer></body>"
        assert html_extract.main_blocks(page) == ["Title", (LONG * 3).strip(), "Short."]


def test_html_furniture_words_inside_an_article():
    blocks = html_extract.main_blocks(
        f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p><h2 id='related-work'>Related work</h2><p>{LONG}</p>"
        f"<section id='discussion'><h2>Discussion</h2><p>{LONG * 2}</p></section><div class='ad'>Buy</div><div class='social share'>Tell all</div></article>"
        f"<section class='comments'><article class='comment-body'><p>{LONG * 9}</p></article></section>")
    assert blocks == ["Title", LONG.strip(), "Related work", LONG.strip(), "Discussion", (LONG * 2).strip()]


def test_html_left_out_end_tags():
    for items in ("<p class='ad'>Buy<p>{0}<p>{0}", "<p>{0}<p class=promo>Buy<div><p>{0}</div>", "<ul><li class='promo'>Buy<li>{0}<li>{0}</ul>",
                  "<table><tr><td class=ad>Buy<td>{0}<tr><td>{0}</table>", "<dl><dt class=ad>Buy<dd>{0}<dd>{0}</dl>"):
        assert html_extract.main_blocks(f"<article>{items.format(LONG)}</article>") == [LONG.strip()] * 2
    assert html_extract.main_blocks("<ul><li class=ad>x<ul><li>y</ul>z</ul><p>" + LONG) == [LONG.strip()]


def test_html_nothing_left():
    assert html_extract.main_blocks("<div class=discussion><div class=comment>One.</div><div class=comment>Two.</div></div>") == ["One.", "Two."]
    assert html_extract.main_blocks("<div class=ad>Buy</div><article></article>") == []


def test_smoothing_keeps_constants():
    assert html_extract.smoothed(np.full(9, 3.0)) == pytest.approx(np.full(9, 3.0))
    assert html_extract.high_cluster(np.array([1.0, 1.1, 9.0, 9.5])).tolist() == [False, False, True, True]


def test_licenses(spark, empty):
    texts = [None, "", "Text. Licensed under the Apache License, Version 2.0. More", "Released under the MIT Licence.\nAll rights reserved.",
             "This work is licensed under the GNU General Public License, version 3.", "licensed to nobody", "SPDX-License-Identifier: 0BSD",
             "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
             "that the above copyright notice and this permission notice appear in all copies.", "no cue " * 30000 + "Licensed under CC BY-NC 4.0."]
    got = {r["doc_id"]: r for r in table(license_scan.scan_licenses(frame(spark, texts)))}
    assert [got[i]["licenses"] for i in range(9)] == [[], [], ["Apache-2.0"], ["All-Rights-Reserved", "MIT"], ["GPL-3"], [], ["0BSD"], ["ISC"], ["CC-BY-NC-4.0"]]
    f = got[2]["findings"][0]
    assert texts[2][f["start"]:f["end"]] == "Licensed under the Apache License, Version 2.0."
    assert license_scan.scan_licenses(empty).count() == 0


def gnu(kind, stop, version, later=True, what="program", mark=""):
    text = (f"This {what} is free software{stop[0]} you can redistribute it and/or modify\nit under the terms of the GNU {kind} as published by\n"
            f"the Free Software Foundation{stop[1]} {'either ' if later else ''}version {version} of the License"
            f"{', or' if later else ''}\n{'(at your option) any later version' if later else ''}.\n\n"
            f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.  See the\nGNU {kind} for more details.")
    return "\n".join(mark + x for x in text.split("\n"))


NOTICES = {
    "gpl3": (gnu("General Public License", ":,", "3"), ["GPL-3-or-later"]),
    "gpl2": (gnu("General Public License", ";;", "2", mark=" * "), ["GPL-2-or-later"]),
    "gpl2only": (gnu("General Public License", ";;", "2", later=False), ["GPL-2-only"]),
    "gpl2kernel": ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\n"
                   "published by the Free Software Foundation.", ["GPL-2-only"]),
    "lgpl": (gnu("Lesser General Public License", ";;", "2.1", what="library", mark="# "), ["LGPL-2.1-or-later"]),
    "agpl": (gnu("Affero General Public License", ":,", "3"), ["AGPL-3-or-later"]),
    "mpl": ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
            " * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", ["MPL-2.0"]),
    "apache": ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
               "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
               'writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
               "express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.", ["Apache-2.0"]),
    "bsd": ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
            "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
            "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n"
            "   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be "
            'used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED "AS IS".', ["BSD"]),
    "mit": ('Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\n'
            "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
            "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice "
            "and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n'
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.", ["MIT"]),
    "cc": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License. To view a copy of this license, visit\n"
           "http://creativecommons.org/licenses/by-sa/4.0/.", ["CC-BY-SA-4.0"]),
    "midway": ("Released under the MIT License by Acme.", ["MIT"]),
    "lines": ("Licensed under CC BY-SA 4.0\nAll rights reserved", ["CC-BY-SA-4.0", "All-Rights-Reserved"]),
    "two": ("Code is licensed under the MIT License and text is licensed under CC BY 4.0 unless said otherwise", ["MIT", "CC-BY-4.0"]),
    "later": ("It is released under the terms of the GNU General Public License v3.0 or later, see COPYING", ["GPL-3.0-or-later"]),
    "far": ("word " * 600 + "this work is dedicated to the public domain by " + "word " * 600, ["Public-Domain"]),
}


@pytest.mark.parametrize("name", NOTICES)
@pytest.mark.parametrize("before,after", [("", ""), ("file.c: part of Acme, ", " Some more text"), ("Copyright 2020 Acme\n", "\nint main(void)\n")])
def test_standard_notices(name, before, after):
    notice, licences = NOTICES[name]
    text = before + notice + after
    found = license_scan.scan(text)
    assert [x[0] for x in found] == licences
    assert all(0 <= a < b <= len(text) for _, a, b in found) and all(x[2] <= y[1] for x, y in zip(found, found[1:]))


def test_licenses_overlapping_sentences_count_once():
    words, _ = license_scan.normalise("Licensed under the GNU General Public License, version 2 or any later version; licensed under the licence")
    assert [x[2] for x in license_scan.identify(words)] == ["gpl-grant-later"]


def test_license_lines_of_the_corpus(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    line = re.compile(r"licensed under the GNU General Public License, version [\d.]+\.|Released under the MIT License\.|Licensed under CC BY-NC [\d.]+\."
                      r"|Licensed under the Apache License, Version [\d.]+\.|All rights reserved\.")
    text = {r["doc_id"]: r["text"] or "" for r in table(docs)}
    assert {r["doc_id"]: r["n_findings"] for r in table(license_scan.scan_licenses(docs))} == {i: len(line.findall(t)) for i, t in text.items()}


def test_empty_tables(spark, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert bpe_codec.encode_digest(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert sharding.shard_digest(empty).count() == 0
    assert quality_rules.judge(quality_rules.count_table(empty), {}).count() == 0
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_oracle(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, E.queries()["op3_topk_search"](spark, sf).collect()))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == sorted(con.sql(E.oracle_sql()["op3_topk_search"]).fetchall())


def test_pipeline(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "packing"]
    docs = read_table(spark, SF, "documents")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.schema == docs.schema
    exp = {c for _, c in brute_components({r["doc_id"]: r["text"] for r in table(docs)}, 5, 80).values()}
    assert {r["doc_id"] for r in table(kept)} == exp
    rows = table(corpus_pipeline.run(spark, SF))
    assert {r["doc_id"] for r in rows} <= exp | {r["doc_id"] for r in table(docs)} and len(rows) > 100


def plain_counts(text):
    w = WORDS.findall(text)
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
            "n_repeat_words": len({j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}),
            "n_upper": sum(unicodedata.category(c) == "Lu" for c in text), "n_again": sum(a == b for a, b in zip(w, w[1:]))}


def plain_verdict(text, cut):
    q = plain_counts(text)
    if q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"]:
        return False
    stratum = sum(q["n_words"] >= x for x in quality_rules.STRATA)
    for rule, (num, den, top) in quality_rules.RULES.items():
        step = min(int(quality_rules.STEPS * q[num] / (max(q[den], 1) * top) + 1e-9), quality_rules.STEPS)
        if step >= cut.get(f"{stratum}:{rule}", quality_rules.STEPS + 1):
            return False
    return True


def test_pipeline_run_equals_a_plain_chain(spark):
    """Rule verdicts, scores, brute-force components and pieces that cover exactly the survivors' ids."""
    import corpus_pipeline
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    texts = {r["doc_id"]: r["text"] for r in table(docs)}
    assert len(texts) == docs.count()
    cut = quality_rules.learn_cutoffs(quality_rules.count_table(docs), labels)
    ruled = {i: t for i, t in texts.items() if plain_verdict(t or "", cut)}
    model = quality_cnn.train(docs, labels)
    good = {i: t for i, t in ruled.items() if model.score([(t or "").encode()])[0] >= 0.5}
    left = {c for _, c in brute_components(good, 5, 80).values()}
    assert len(texts) > len(ruled) > len(good) > len(left) > 100
    tok = vocab.load_tokenizer(vocab.tokenizer_path())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in table(corpus_pipeline.run(spark, sf)):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == left
    for i, own in pieces.items():
        ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == ids.size and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == ids.size
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
