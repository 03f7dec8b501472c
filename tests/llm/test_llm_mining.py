"""Hard negatives, URL filter and conversation trie against brute force:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing
column names, and the SQL of each query."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
from quire.llm import conversation_trie as trie
from quire.llm import hard_negatives as hard
from quire.llm import url_filter as urls

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name,table", [("op11_hard_negatives", "embeddings"), ("op12_url_filter", "pages"), ("op13_conversation_trie", "conversations")])
def test_sql(spark, name, table):
    got = E.queries()[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    exp = con.sql(E.oracle_sql()[name])
    assert got.columns == exp.columns and rows_of(got) == sorted(exp.fetchall(), key=repr)


# --- hard negatives ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, rank int, anchor string, v string"


def brute_negatives(rows, every, scale=256, positives=5, negatives=10):
    own = sorted({(i, y, tuple(int(np.floor(scale * np.float64(np.float32(x)))) for x in v)) for i, v, y, *_ in rows
                  if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a, label, x in own:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, w)), i, y) for i, y, w in own if i != a]
        for s, p, _ in sorted(t for t in scored if t[2] == label)[:positives]:
            fit = sorted((t, i) for t, i, y in scored if y != label and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(4)
    centres = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.uniform(-0.2, 0.2) for c in centres[i % 5]], r.randrange(4)) for i in range(300)]
    rows += [(400 + i, [0.5] * 6, i % 3) for i in range(60)]  # ties
    rows += [(700, None, 1), (710, [1.0, None], 1), (720, [float("nan")] * 6, 1), (730, [float("inf")] * 6, 1), (740, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    rows += [(750, [0.0] * 6, 1), (760, [], 1), (770, [0.5] * 3, 2), (780, [-0.9] * 6, 9), rows[10], rows[10], (10, [0.4] * 6, 2)]
    return [(*x, 1, "a", "b") for x in rows]


@pytest.mark.parametrize("bounds", [{}, {"cell_docs": 40, "cell_anchors": 3}])
def test_hard_negatives(spark, vectors, bounds):
    got = hard.mine(spark.createDataFrame(vectors, VECTORS), is_anchor=F.col("vec_id") % 10 == 0, **bounds)
    assert rows_of(got) == brute_negatives(vectors, 10)


def test_hard_negatives_odd_tables(spark, vectors):
    assert hard.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard.mine(spark.createDataFrame(vectors[1:9], VECTORS)).count() == 0  # no anchor
    assert hard.mine(spark.createDataFrame(vectors[:1], VECTORS)).count() == 0  # no partner
    hot = [(i, [1.0, 0.0], 7 if i % 3 else 8, 1, "a", "b") for i in range(1500)]  # one vector
    assert rows_of(hard.mine(spark.createDataFrame(hot, VECTORS), low=100, high=100, cell_docs=200)) == sorted(
        [(a, p, k + 1, n, 65536, 65536) for a in range(0, 1500, 100) for p in [i for i in range(1500) if (i % 3 > 0) == (a % 3 > 0) and i != a][:5]
         for k, n in enumerate([i for i in range(1500) if (i % 3 > 0) != (a % 3 > 0)][:10])], key=repr)


def test_confusions(spark):
    df = spark.createDataFrame([(7, 9), (8, 9), (14, None), (None, 3)], "vec_id long, label int")
    assert rows_of(hard.planted_confusions(df)) == sorted([(7, 0), (8, 9), (14, None), (None, 3)], key=repr)


def test_spanning_tree_is_minimal():
    points = np.random.default_rng(1).integers(-50, 50, (40, 3))
    order, parent, edge = hard.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(40)) and parent[0] == -1 and (parent[1:] < np.arange(1, 40)).all()
    at = points[order]
    assert edge[1:] == pytest.approx(np.linalg.norm(at[1:] - at[parent[1:]], axis=1))
    pairs = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(40) for j in range(i))
    up, total = list(range(40)), 0.0

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for d, i, j in pairs:
        if top(i) != top(j):
            up[top(i)] = top(j)
            total += d
    assert edge.sum() == pytest.approx(total)


def test_bounds_leave_out_most_pairs_of_clustered_rows():
    r = np.random.default_rng(0)
    centres = r.integers(-200, 200, (20, 16))
    v = np.repeat(centres, 100, axis=0) + r.integers(-4, 5, (2000, 16))
    ids = np.arange(2000)
    docs = pa.table({"anchor": ids, "vec_id": ids, "label": ids % 2, "v": pa.array(v.tolist(), pa.list_(pa.int64()))})
    order, parent, edge = hard.spanning_tree(v[::10])
    anchors = docs.take(pa.array(np.arange(0, 2000, 10)[order])).append_column("place", pa.array(np.arange(200)))
    anchors = anchors.append_column("parent", pa.array(parent)).append_column("edge", pa.array(edge))
    cell = hard.Cell(docs, anchors)
    best, _ = hard.find_positives(cell, 5)
    assert cell.scored < 0.15 * cell.pairs
    s = v[::10][order] @ v.T
    s[(cell.anchor_labels[:, None] != cell.labels) | (cell.anchor_ids[:, None] == cell.ids)] = np.iinfo(np.int64).min
    assert (best == np.sort(s, axis=1)[:, ::-1][:, :5]).all()


# --- URL filter ----------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "https://Example.ORG/es/1?x=/fr/", "http://a.example.org/en/12#top", "http://example.org/en/2", "http://org",
        "http://org/", "http://notorg/x", "http://x.com/fr/", "http://x.com/fr", "http://x.com?/de/", "http://x.com/de/a://b/c", "://com/de/", "http://com/de/",
        "http://www.free-bets.example.com/en/", "http://bets.org/x", "http://be.ts.com", "http://É.com/de/é", "http://a..com/de/", "http://.com/de/",
        "http://u@x.com:80/de/", "x\ny://a.com\n/de/", "http://" + "a." * 20000 + "com/de/" + "z" * 50000, "http://x.com/" + "y" * 100000, "http://casino"]


def brute_verdict(url, rules, words):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if {w for p in host.split(".") for w in p.split("-")} & set(words) else "allow"


RULES = [*urls.RULES, ("a.example.org", "", "block"), ("example.org", "/en/12", "allow"), ("bets.org", "/", "allow"), ("x.com", "/y", "block")]


def made(spark, rules=RULES, words=urls.BLOCK_WORDS):
    return urls.write_filter(spark.createDataFrame(list(rules), "host string, path string, verdict string"),
                             spark.createDataFrame([(w,) for w in words], "word string"))


def test_url_filter(spark):
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string, verdict string")
    got = sorted(map(tuple, urls.judge(df, made(spark)).collect()))
    assert got == [(i, *brute_verdict(u, RULES, urls.BLOCK_WORDS)) for i, u in enumerate(URLS * 2)]
    assert urls.judge(df.limit(0), made(spark)).count() == 0
    allowed = {r["verdict"] for r in urls.judge(df, made(spark, [], [])).collect()}
    assert allowed == {"allow"}


def test_url_filter_large_list(spark):
    r = random.Random(3)
    name = lambda: ".".join(r.choice(["a", "b", "c", "d", "e", "f"]) for _ in range(r.randint(1, 4)))
    path = lambda: "/" * r.randint(0, 1) and "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 4)))
    rules = {(name(), path()): r.choice(["allow", "block"]) for _ in range(900)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    pages = [(i, f"http://{name()}{path()}") for i in range(2000)]
    double = rules + [(h, p, "allow") for h, p, _ in rules[:200]] + [(None, "/", "block"), ("g", None, "block")]  # block stands before allow
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), made(spark, double, []))
    expected = [(i, *brute_verdict(u, rules, [])) for i, u in pages]
    assert sorted(map(tuple, got.collect())) == expected and len({x[3] for x in expected}) > 200


def test_digest_array_confirms_strings(tmp_path):
    """Entries stored under one digest are told apart by their strings."""
    a, b = "rorg/", "rcom/"
    key = np.array([xxhash.xxh64_intdigest(a, seed=42)], np.uint64).view(np.int64)[0]
    t = pa.table({"key": pa.array([key] * 3), "entry": ["rother/", b, a], "block": [True, True, False], "lengths": [[], [], [1, 2]]},
                 pa.schema([("key", pa.int64()), ("entry", pa.string()), ("block", pa.bool_()), ("lengths", pa.list_(pa.int32()))]))
    import pyarrow.parquet as pq
    pq.write_table(t, tmp_path / "x.parquet")
    urls.lay_out([str(tmp_path / "x.parquet")], str(tmp_path))
    array = urls.DigestArray(str(tmp_path))
    assert isinstance(array.key, np.memmap)
    assert array.find([a, b, "rother/", "", a]).tolist() == [2, -1, -1, -1, 2] and array.lengths(2) == [1, 2]
    swapped = np.array([xxhash.xxh64_intdigest(b, seed=42)], np.uint64).view(np.int64)[0]
    assert swapped != key  # "rcom/" is stored under another digest and is not found by its own


@pytest.mark.parametrize("left", ["nothing", "a folder without its arrays"])
def test_arrays_without_renames(tmp_path, monkeypatch, left):
    """A disk that renames no folder, or a writer that was ended, leaves no
    worker without the arrays (both ended in FileNotFoundError)."""
    import os
    import pyarrow.parquet as pq
    from pyspark import SparkFiles

    def refused(*_):
        raise OSError("no renames here")
    monkeypatch.setattr(os, "rename", refused)
    monkeypatch.setattr(SparkFiles, "getRootDirectory", classmethod(lambda cls: str(tmp_path)))
    t = pa.table({"key": pa.array([5], pa.int64()), "entry": ["wspam"], "block": [True], "lengths": pa.array([[]], pa.list_(pa.int32()))})
    pq.write_table(t, tmp_path / "x.parquet")
    name = f"digests-{left.split()[0]}"
    if left != "nothing":
        (tmp_path / name).mkdir()
    urls.open_array.cache_clear()
    first = urls.open_array(name, ("x.parquet",))
    urls.open_array.cache_clear()  # another worker maps what the first laid out
    second = urls.open_array(name, ("x.parquet",))
    assert [first.entry(0), second.entry(0)] == [b"wspam"] * 2 and isinstance(second.key, np.memmap)


def test_digests_are_sparks(spark):
    texts = ["", "rorg/", "é漢🙂", "x" * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == np.array([xxhash.xxh64_intdigest(t.encode(), seed=urls.SEED) for t in texts], np.uint64).view(np.int64).tolist()


def test_filter_list_is_measured(spark):
    with pytest.raises(ValueError):
        urls.write_filter(urls.rule_table(spark, urls.RULES), urls.word_table(spark, ["spam"]), max_bytes=10)


# --- conversation trie ---------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string, key string"


def brute_trie(rows, rebuilt=True):
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tid = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + len(text.encode()).to_bytes(4, "big")
            convs[c].append((turn is not None, turn or 0, tid, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in convs.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        paths[c] = turns if base == c or not rebuilt else own.get(base, [])[:h] + turns[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()], key=repr)


@pytest.fixture(scope="module")
def turns():
    r = random.Random(8)
    rows = []
    for c in [*range(-12, 60), 10 ** 15, 10 ** 15 + 1]:
        if c % 7 == 3:
            continue  # absent families
        for t in range(r.randint(1, 12)):
            rows.append((c, t if t else r.choice([None, 0]), r.choice(["user", "assistant", None]), r.choice(["a", "", None, "é漢", "b" * 9])))
    rows += [(100, t, "user", "same") for t in range(300)] + [(105, t, "user", "same") for t in range(299)] + [(110, t, "user", "same") for t in range(64)]
    rows += [(115, t, "user", "same") for t in range(128)] + [(120, t, "user", "same") for t in range(300)] + [(120, 300, "user", "other")]
    rows += [(c, 0, "user", "hot") for c in range(200, 400)] + [(c, 1, "user", f"branch {c % 60}") for c in range(200, 400)]
    rows += [(101, 0, "user", "x"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, None, "tie"), (None, 0, "user", "none"), (500, 0, "user", "long " * 40000)]
    return [(*x, "p", "q") for x in rows]


@pytest.mark.parametrize("tree_turns", [1, 50, 100_000])
def test_trie(spark, turns, tree_turns):
    ids = trie.turn_ids(spark.createDataFrame(turns, TURNS))
    assert rows_of(trie.trie(trie.rebuild(ids), tree_turns)) == brute_trie(turns)


def test_trie_as_it_is(spark, turns):
    ids = trie.turn_ids(spark.createDataFrame(turns, TURNS))
    assert rows_of(trie.trie(trie.plain(ids))) == brute_trie(turns, rebuilt=False)


def test_trie_odd_tables(spark):
    assert trie.trie(trie.rebuild(trie.turn_ids(spark.createDataFrame([], TURNS)))).count() == 0
    only = [(c, 0, None, None, "p", "q") for c in (101, 102, 103, 104)]  # turnless, or one empty turn
    got = rows_of(trie.trie(trie.rebuild(trie.turn_ids(spark.createDataFrame(only, TURNS)))))
    assert got == brute_trie(only)


def test_radix_tree_layouts():
    """Every layout, found again, and never more nodes than keys need."""
    r = random.Random(2)
    for n in (3, 4, 5, 16, 17, 48, 49, 200, 256):
        tree = trie.RadixTree()
        first = r.sample(range(256), n)
        ids = {bytes([b]) + r.randbytes(trie.WIDTH - 1) for b in first}
        for k, i in enumerate(sorted(ids, key=lambda x: x[::-1])):
            tree.insert(trie.ROOT, 0, i, k, 1, 0, 0, True)
            tree.insert(trie.ROOT, 0, i + i, k + n, 1, 0, 0, True)
        node = tree.root.child(0)
        assert node.room == next(x for x in (4, 16, 48, 256) if n <= x) and len(node.children()) == n
        assert all(node.child(b) is not None for b in first) and sum(node.child(b) is not None for b in range(256)) == n
        nodes = [x for x in tree.rows() if x[8] is None]
        assert collections.Counter(x[2] for x in nodes) == {0: 1, 1: n, 2: n} and nodes[0][5] == 2 * n
        assert sum(x[8] is not None for x in tree.rows()) == 2 * n
