"""The methods of operators 1, 2, 5, 7 and 9 against plain, independent
versions, and the faults found in reviews."""

import collections
import random
import re
import zlib
from html import unescape

import numpy as np
import pytest

from quire.llm import bpe_codec, html_extract, language_id, license_scan, packing, quality_cnn, quality_rules, sharding
from quire.llm.common import read_table

SF = "/root/testdata/sf0.01"


# --- op1: string kernel ----------------------------------------------------------

def plain_cells(text):
    """n-gram cells by the stated rule, one gram at a time."""
    folded = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (" " + text.lower() + " ").encode())
    out = set()
    for n, bits in language_id.BITS.items():
        for i in range(len(folded) - n + 1):
            code = folded[i]
            for c in folded[i + 1:i + n]:
                code = (code * 0x01000193 + c) % 2 ** 32
            out.add((n, (code * 0x9E3779B1 % 2 ** 32) >> (32 - bits)))
    return out


def test_kernel_and_prediction_equal_a_plain_version(spark):
    rows = read_table(spark, SF, "documents").where("lang is not null and text is not null").orderBy("doc_id").limit(60).collect()
    texts, langs = [r["text"][:600] for r in rows], [r["lang"] for r in rows]
    model = language_id.fit(language_id.presence(texts), langs, landmarks=12)
    cells = [plain_cells(t) for t in texts]
    each = -(-12 // len(set(langs)))
    chosen = [i for c in sorted(set(langs)) for i in [k for k, x in enumerate(langs) if x == c][:each]]
    plain = np.array([[len(a & cells[j]) / (len(a) * len(cells[j])) ** 0.5 for j in chosen] for a in cells])
    assert model.kernel(language_id.presence(texts)) == pytest.approx(plain, abs=1e-6)
    # ridge regression on Nystroem features, solved in the landmarks' own coordinates
    value, vector = np.linalg.eigh(plain[chosen])
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = plain @ root
    names = sorted(set(langs))
    weight = np.array([len(langs) / (len(names) * langs.count(x)) for x in langs])
    beta = np.zeros((root.shape[1], len(names)))
    for k, c in enumerate(names):  # one-versus-rest, by least squares with the ridge as extra rows
        y = np.where(np.array(langs) == c, 1.0, -1.0)
        a = np.vstack([phi * np.sqrt(weight)[:, None], np.sqrt(language_id.RIDGE) * np.eye(phi.shape[1])])
        beta[:, k] = np.linalg.lstsq(a, np.concatenate([y * np.sqrt(weight), np.zeros(phi.shape[1])]), rcond=None)[0]
    assert model.predict(texts)[0] == [names[i] for i in (phi @ beta).argmax(axis=1)]


# --- op2: main text --------------------------------------------------------------

def plain_article(html):
    """The article of a well-formed page, by regular expressions alone."""
    html = re.sub(r"(?s)<!--.*?-->|<(script|style|noscript)\b.*?</\1>", "", html)
    body = re.search(r"(?s)<article\b[^>]*>(.*)</article>", html).group(1)
    body = re.sub(r'(?s)<(div|aside|p)\b[^>]*class="[^"]*\b(ad|promo|share|related|newsletter)\b[^"]*"[^>]*>.*?</\1>', "\n", body)
    body = re.sub(r"(?s)<(nav|aside|footer|form|button)\b.*?</\1>", "\n", body)
    inline = "a|abbr|b|cite|code|em|i|mark|small|span|strong|sub|sup|u"
    body = re.sub(rf"(?s)</?(?:{inline})\b[^>]*>", "", body)
    parts = [" ".join(unescape(t).split()) for t in re.split(r"(?s)<[^>]*>", body)]
    return " ".join(p for p in parts if p)


def test_extraction_equals_a_plain_version_on_the_table(spark):
    pages = read_table(spark, SF, "pages")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    exp = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    assert len(got) == len(exp) > 200
    assert [i for i in exp if got[i] != exp[i]] == []


@pytest.mark.parametrize("sizes", [(99, 51, 57, 99), (300, 40, 90, 55, 200), (60, 60), (400, 100, 100, 400)])
@pytest.mark.parametrize("around", ["{}", "<nav><a href=x>Home</a></nav>{}<footer>foot</footer>", "<section>{}</section>"])
def test_uneven_paragraphs_in_their_own_boxes_stay(sizes, around):
    words = [("word " * n)[:n].strip() for n in sizes]
    blocks = "".join(f"<div><p>{w}</p></div>" for w in words)
    assert html_extract.main_blocks(f"<body>{around.format(blocks)}</body>") == words


def test_close_clusters_are_one():
    assert html_extract.high_cluster(np.array([4.0, 4.1, 4.6, 4.7]), 1.0).all()
    assert html_extract.high_cluster(np.array([1.0, 1.1, 4.6, 4.7]), 1.0).tolist() == [False, False, True, True]


def test_repeated_pages(spark):
    pages = read_table(spark, SF, "pages").limit(20)
    assert html_extract.extract(pages.union(pages)).count() == 40


# --- op5: risk control -----------------------------------------------------------

def test_clashing_columns_come_back(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), f"q{i}", "yes", True, 1.5) for i in range(50)] + [(50, "few", "q", "no", None, None), (0, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, q string, kept string, base_failed boolean, q_ double")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    got = quality_rules.keep_good(docs, labels)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect())) == rows[:50]
    twice = quality_rules.keep_good(docs.union(docs), labels)
    assert sorted(map(tuple, twice.collect())) == sorted(rows[:50] * 2)
    assert quality_rules.keep_good(docs.limit(0), labels).count() == 0


def test_joint_risk_is_tested_on_the_holdout(spark):
    """Cutoffs equal those of a plain version, and the good documents that all
    rules of a stratum reject together stay within the tested bound."""
    from math import comb
    r = np.random.default_rng(5)
    rows = []
    for i in range(4000):
        n = int(r.choice([40, 300]))
        bad = i % 4 == 0
        words = [f"w{i}x{j}" for j in range(n)]
        for j in range(int(n * (r.uniform(0.1, 0.6) if bad else r.uniform(0, 0.06)))):
            words[j] = words[j] + "##"
        for j in range(1, int(n * (r.uniform(0, 0.5) if bad else r.uniform(0, 0.12)))):
            words[j] = words[j].upper()
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(4000)], "doc_id long, quality int")
    counts = quality_rules.count_table(docs)
    cut = quality_rules.learn_cutoffs(counts, labels)
    rules = list(quality_rules.RULES.items())
    seen = collections.defaultdict(list)
    for x in counts.collect():
        q, i = x["q"], x["doc_id"]
        if q["n_words"] >= 10 and 100 * q["n_repeat_words"] <= 20 * q["n_words"]:
            steps = [min(int(quality_rules.STEPS * q[a] / (max(q[b], 1) * top) + 1e-9), quality_rules.STEPS) for _, (a, b, top) in rules]
            seen[sum(q["n_words"] >= s for s in quality_rules.STRATA)].append((zlib.crc32(str(i).encode()) % 2, i % 4 != 0, steps))
    exp = {}
    for stratum, own in seen.items():
        chosen = {}
        for k in range(len(rules)):
            worth = [(sum(not g for h, g, s in own if not h and s[k] >= c) - quality_rules.GOOD_WEIGHT * sum(g for h, g, s in own if not h and s[k] >= c), c)
                     for c in range(1, quality_rules.STEPS + 1)]
            if max(worth)[0] > 0:
                chosen[k] = max(worth)[1]
        held = [s for h, g, s in own if h and g]
        lowest = quality_rules.STEPS + 1
        for level in range(quality_rules.STEPS, 0, -1):
            errors = sum(any(s[k] >= max(c, level) for k, c in chosen.items()) for s in held)
            p = sum(comb(len(held), e) * quality_rules.RISK ** e * (1 - quality_rules.RISK) ** (len(held) - e) for e in range(errors + 1))
            if p > quality_rules.DELTA / (len(quality_rules.STRATA) + 1):
                break
            lowest = level
        if lowest <= quality_rules.STEPS:
            exp |= {f"{stratum}:{rules[k][0]}": max(c, lowest) for k, c in chosen.items()}
    assert cut == exp and len(cut) >= 3


# --- op7: network ----------------------------------------------------------------

def plain_score(net, raw):
    """Every chunk, window and filter one after the other."""
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    starts = list(range(0, max(len(raw) - (quality_cnn.CHUNK - quality_cnn.STEP), 1), quality_cnn.STEP))
    data = list(raw) + [256] * (starts[-1] + quality_cnn.CHUNK - len(raw))
    wide = quality_cnn.GROUP * quality_cnn.EMBED
    filters = np.vstack([w["filters"][:, :quality_cnn.FILTERS], w["filters"][:, quality_cnn.FILTERS:]])
    pooled = []
    for s in starts:
        best = np.full(quality_cnn.FILTERS, -np.inf)
        for at in range(s, s + quality_cnn.CHUNK - 2 * quality_cnn.GROUP + 1, quality_cnn.GROUP):
            x = np.concatenate([w["embed"][b] for b in data[at:at + 2 * quality_cnn.GROUP]])
            assert x.size == 2 * wide
            best = np.maximum(best, x @ filters)
        pooled.append(np.maximum(best + w["bias"], 0))
    doc = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    h = np.maximum(doc @ w["hidden"] + w["hidden_bias"], 0)
    return 1 / (1 + np.exp(-(h @ w["out"] + w["out_bias"][0])))


def test_scores_equal_a_plain_forward_pass():
    net = quality_cnn.Network(3)
    r = np.random.default_rng(3)
    net.w["bias"] += r.normal(0, 0.1, net.w["bias"].shape).astype(np.float32)
    texts = [b"", b"a", b"some words " * 30, r.bytes(1024), r.bytes(3000), "é漢字 ".encode() * 400]
    assert net.score(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)


def test_a_fit_lowers_the_loss_and_separates():
    r = np.random.default_rng(4)
    good = [(" ".join(r.choice(["the", "and", "with", "from", "this"], 60))).encode() for _ in range(60)]
    bad = [bytes(r.integers(33, 64, 300).tolist()) for _ in range(60)]
    samples = [(t, 1) for t in good] + [(t, 0) for t in bad]
    loss = lambda net: -np.mean([np.log(p if y else 1 - p) for p, (_, y) in zip(np.clip(net.score([t for t, _ in samples]), 1e-9, 1 - 1e-9), samples)])
    net = quality_cnn.fit(samples, epochs=14)
    assert loss(net) < 0.2 < loss(quality_cnn.Network())
    scores = net.score([t for t, _ in samples])
    assert scores[:60].min() > scores[60:].max()


def test_long_rows_are_passed_by():
    rows = [{"hash": i, "doc_id": i, "size": s} for i, s in enumerate((5, 900, 20, 7, 10 ** 9, 30))]
    assert [x["size"] for x in quality_cnn.within(rows, 60)] == [5, 20, 7] and quality_cnn.within(rows[4:5], 60) == []
    assert [x["size"] for x in quality_cnn.within(rows, 62)] == [5, 20, 7, 30]


def test_classifier_on_repeated_and_no_rows(spark):
    docs = read_table(spark, SF, "documents").limit(30)
    net = quality_cnn.Network()
    assert quality_cnn.score(docs.union(docs), net).count() == 60 and quality_cnn.score(docs.limit(0), net).count() == 0


# --- op9: packing ----------------------------------------------------------------

def test_inverse_without_linear_algebra_threads():
    m = np.random.default_rng(1).integers(0, 9, (60, 60)) + 20 * np.eye(60)
    assert packing._inverse(m) @ m == pytest.approx(np.eye(60), abs=1e-9)


def test_patterns_past_the_fresh_inverse(monkeypatch):
    """The size of the query's problem: more than 200 rounds, no LAPACK call."""
    def fail(*_):
        raise AssertionError("threaded inversion")
    monkeypatch.setattr(np.linalg, "inv", fail)
    rounds = []
    monkeypatch.setattr(packing, "_inverse", lambda m, own=packing._inverse: rounds.append(1) or own(m))
    r = np.random.default_rng(2)
    units, demand = np.arange(1, 129), r.integers(1, 400, 128)
    total = sum(x for _, x in packing.solve_patterns(units, demand.astype(float), 256))
    bound = (units * demand).sum() / 256
    assert rounds and bound <= total + 1e-6 <= 1.01 * bound + 1
    plan = packing.plan_sequences(units, demand, 256)
    assert (sum(p * t for p, t in plan) == demand).all() and all((p * units).sum() <= 256 for p, _ in plan)


def test_full_sequences_keep_to_themselves(spark):
    text = "word " * 6000
    rows = packing.pack(spark.createDataFrame([(i, text) for i in range(30)] + [(30, "tail"), (30, "tail")], "doc_id long, text string")).collect()
    own = collections.Counter(r["sequence_id"] for r in rows)
    full = [r for r in rows if r["length"] == 1024]
    assert len(full) >= 150 and all(own[r["sequence_id"]] == 1 and r["offset"] == 0 for r in full) and min(own) >= 0


# --- op6: sharding ---------------------------------------------------------------

def test_equal_rows_are_spread(spark):
    """100,000 equal rows: no bucket holds many of them, all come out, counts
    are at most one apart, slots are gapless, and a second run is the same."""
    docs = spark.range(100_000).selectExpr("7L as doc_id", "'same text' as text").unionByName(
        spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text")).repartition(5)
    rows = sharding._scattered(docs, ["doc_id", "text"], 64, 1, 1000).groupBy("_bucket").count().collect()
    assert sum(r["count"] for r in rows) == 103_000 and max(r["count"] for r in rows) < 1.3 * 103_000 / 64
    out = sharding.shard_digest(docs, bucket_bytes=40_000).select("doc_id", "shard", "slot")
    got = out.collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == 103_000 and sum(r["doc_id"] == 7 for r in got) == 100_001
    assert sorted(map(len, by.values()))[-1] - sorted(map(len, by.values()))[0] <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, got))


def test_the_threshold_takes_the_smallest_hashes(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 10 < 7, 'aa', 'bb') as lang", "concat('text number ', id) as text")
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 7"))
    taken = []
    monkeypatch.setattr(language_id, "fit", lambda bits, langs, landmarks: taken.extend(langs) or bits)
    language_id.train(docs, per_language=50)
    assert collections.Counter(taken) >= collections.Counter({"aa": 50, "bb": 50}) and len(taken) <= 106


# --- op10: further licences ------------------------------------------------------

ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""


@pytest.mark.parametrize("text,names", [
    (ZLIB, ["Zlib"]), (UNLICENSE, ["Unlicense"]), ("Files under the zlib licence: Licensed under the zlib License.", ["Zlib"]),
    ("# This program and the accompanying materials are made\n# available under the terms of the Eclipse Public License 2.0", ["EPL-2.0"]),
    ("Licensed under the Eclipse Public License v1.0.", ["EPL-1.0"]), ("Dedicated under CC0 1.0 Universal.", ["CC0-1.0"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0 OR MIT"]),
    ("Dual licensed under the MIT License and the Apache License 2.0.", ["MIT OR Apache-2.0"]),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ["BSD"]),
    ("Licensed under the MIT License.", ["MIT"]), ("Nothing to declare.", []), (None, [])])
@pytest.mark.parametrize("before,after", [("", ""), ("Copyright 2020 A. Writer\n\n", "\n\nint main() {}")])
def test_further_licences(text, names, before, after):
    found = license_scan.scan(before + text + after if text else text)
    assert [f[0] for f in found] == names
    for _, start, end in found:
        assert 0 <= start < end <= len(before + (text or "") + after)


# --- op4: groups of words --------------------------------------------------------

def test_word_groups_follow_the_bytes():
    mb, tb = 1 << 20, 1 << 40
    assert bpe_codec.plan_groups(0) == bpe_codec.plan_groups(100 * mb) == (bpe_codec.MIN_CLASSES, 1)
    assert bpe_codec.plan_groups(32 * 1000 * mb) == (1000, 1)
    for size in (1, mb, 40_000 * mb, tb, 100 * tb):
        classes, slices = bpe_codec.plan_groups(size)
        assert bpe_codec.MIN_CLASSES <= classes <= bpe_codec.MAX_CLASSES and classes * slices * bpe_codec.CLASS_BYTES >= size
    assert bpe_codec.plan_groups(1000, class_bytes=10, classes=7) == (7, 15)


def test_slices_give_the_same_ids(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "if(id % 7 = 0, null, concat('the word ', id % 5, ' and the rest of ', id, ' \u00e9t\u00e9')) as text")
    one = {r["doc_id"]: r for r in bpe_codec.encode_digest(docs, bundle_bytes=200).collect()}
    many = {r["doc_id"]: r for r in bpe_codec.encode_digest(docs, bundle_bytes=200, classes=3, class_bytes=100).collect()}
    named = {r["doc_id"]: r for r in bpe_codec.encode_digest(docs, bundle_bytes=200, text_bytes=10_000, class_bytes=5, classes=2).collect()}
    assert one == many == named and len(one) == 60 and one[0]["n_tokens"] == 0 and one[1]["n_tokens"] > 5


# --- op10: sentences and full licence texts ---------------------------------------

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

 * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
   the documentation and/or other materials provided with the distribution.
"""
BSD_ADVERT = """ * All advertising materials mentioning features or use of this software must display the following acknowledgement:
   This product includes software developed by Acme.
"""
BSD_NAME = """ * Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT_HEAD = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
MIT_KEEP = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
MIT_TAIL = """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
ISC_TAIL = """.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


@pytest.mark.parametrize("text,name", [
    (BSD_HEAD + BSD_TAIL, "BSD-2-Clause"), (BSD_HEAD + BSD_NAME + BSD_TAIL, "BSD-3-Clause"),
    (BSD_HEAD + BSD_ADVERT + BSD_NAME + BSD_TAIL, "BSD-4-Clause"), (MIT_HEAD + MIT_KEEP + MIT_TAIL, "MIT"), (MIT_HEAD + "." + MIT_TAIL, "MIT-0"),
    (ISC_HEAD + ISC_KEEP + ISC_TAIL, "ISC"), (ISC_HEAD + ISC_TAIL, "0BSD")])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_full_texts_are_one_finding(text, name, mark):
    text = "\n".join(mark + line for line in text.strip().split("\n"))
    full = "Copyright 2020 Acme.\n\n" + text + "\n\nint main() {}"
    (got, start, end), = license_scan.scan_full(full)
    assert got == name and end == 22 + len(text) and full[start:end].lstrip(" *#").startswith(text.lstrip(" *#")[:30])


@pytest.mark.parametrize("text,name", [
    ("Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies\nof this license "
     "document, but changing it is not allowed.", "GPL-3"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Licensed under the EUPL, Version 1.2", "EUPL-1.2"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"), ("Licensed under the Artistic License 2.0", "Artistic-2.0")])
def test_titles_and_notices(text, name):
    assert [f[0] for f in license_scan.scan_full(text)] == [name]


def test_sentences_come_before_runs():
    text = "Do it. Licensed under the MIT License. It is released under the MIT License too; Licensed under the GNU General Public License; version 2 only."
    assert [f[0] for f in license_scan.scan(text)] == ["MIT", "MIT", "GPL-2-only"]
    words, _ = license_scan.normalise("all rights reserved licensed under the mit license")
    assert license_scan.identify(words, [0, 3]) == license_scan.identify(words) == [(0, 3, "reserved"), (3, 8, "mit-notice")]


def test_rules_with_missing_sentences():
    rule = ("a", "b?", "c", "d?")
    assert [license_scan.match_rule(list(x), rule, 0) for x in ("abcd", "abc", "acd", "ac", "ab", "b", "")] == [4, 3, 3, 2, 0, 0, 0]


def brute_identify(words):
    """Longest first over every place and every known sentence."""
    known = {tuple(k.split()): v for k, v in license_scan.SENTENCES.items()}
    sizes = sorted({len(k) for k in known})
    hits = [(n, i, known[tuple(words[i:i + n])]) for i in range(len(words)) for n in sizes if tuple(words[i:i + n]) in known and i + n <= len(words)]
    out, used = [], set()
    for n, i, name in sorted(hits, key=lambda h: (-h[0], h[1])):
        if not used & set(range(i, i + n)):
            used |= set(range(i, i + n))
            out.append((i, i + n, name))
    return sorted(out)


def test_identify_against_brute_force():
    r = random.Random(4)
    pool = [k.split() for k in license_scan.SENTENCES]
    for _ in range(60):
        words = []
        for _ in range(r.randrange(1, 6)):
            part = r.choice(pool)
            words += part[:r.randrange(1, len(part) + 1)] if r.random() < 0.4 else part
            words += ["filler"] * r.randrange(3)
        assert license_scan.identify(words) == brute_identify(words)


def test_many_findings_in_one_text():
    text = "\n".join([MIT_HEAD + MIT_KEEP + MIT_TAIL, ZLIB, "All rights reserved.", BSD_HEAD + BSD_NAME, "and then, as " + MIT_KEEP[40:]] * 300)
    found = license_scan.scan_full(text)
    assert collections.Counter(f[0] for f in found) == {"MIT": 300, "Zlib": 300, "All-Rights-Reserved": 300, "BSD-3-Clause": 300, "unknown:mit-keep": 300}
    assert all(x[2] <= y[1] for x, y in zip(found, found[1:]))
    assert license_scan.scan_full("All rights reserved.\n" * 50_000) == [("All-Rights-Reserved", 21 * i, 21 * i + 20) for i in range(50_000)]
