"""Operator 13: prefix trie of conversations by adaptive radix trees.

A turn's id has a fixed width: the first 16 bytes of the SHA-256 of its role
and text, then the text's UTF-8 length as 4 big-endian bytes.  A conversation
is the byte string of its turns' ids, and tasks put these strings into
adaptive radix trees: a node's children stand in a layout of 4, 16, 48 or 256
places that grows as needed, runs without a branch are compressed into one
node's prefix, and every node adds up what passes through it.  Walking a tree
emits a trie node at each byte depth where a turn ends.  A trie node's key is
a 16-byte hash chained over its turns' ids, so the nodes that several tasks
emit meet in one aggregate per key; hot first turns are already added up in
the trees.

A tree takes at most `tree_turns` turns and is then emitted, and a longer
conversation goes in as segments of `SEGMENT` turns, each below the key that
the one before ended with: memory is bounded for any conversation.  Turns are
ordered by the shuffle's sort and streamed, never collected.

Subtree sums without walking levels: a node belongs to its smallest member,
and a conversation that is the smallest at some depth is so at all greater
depths of its own.  Its own part of the trie is therefore one path with a top;
what that path holds (saved tokens, one leaf) is added once to each node above
the top, by a second pass through the trees, and along the path itself by a
running sum.

Rows: null conv_ids take no part; null roles and texts count as empty; turns
with equal numbers are ordered by their ids; repeated rows are turns each; an
empty table has no nodes; extra columns are not read.  Negative conv_ids are
rebuilt by the remainder that SQL gives.  One conversation's turns are ordered
by one task, with bounded memory.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage

WIDTH = 20
KEY = 16
SEGMENT = 64
TREE_TURNS = 100_000
#: Conversations of a family share the first turns of its first member.
FAMILY = 5
HEADS = 9
ROOT = bytes(KEY)

_TURNS = "conv_id long, depth long, tid binary"
_NODES = "key binary, parent binary, depth long, n_bytes long, low long, n long, saved long, leaves long, ends long"


class Node:
    """A node of an adaptive radix tree.  `prefix` holds the bytes from the
    parent's branch to here; `keys` is None (no child), sorted branch bytes
    (up to 4 or 16 children), an index of 256 places into `kids` (up to 48), or
    empty when `kids` itself has 256 places."""

    __slots__ = ("prefix", "room", "keys", "kids", "low", "n", "saved", "leaves", "ends")

    def __init__(self, prefix: bytes):
        self.prefix, self.room, self.keys, self.kids = prefix, 0, None, None
        self.low, self.n, self.saved, self.leaves, self.ends = None, 0, 0, 0, None

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            if self.room:
                at = bisect_left(self.keys, byte)
                if at < len(self.keys) and self.keys[at] == byte:
                    return self.kids[at]
            return None
        if self.room == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Adds or replaces a child; a full layout grows to the next."""
        if self.room == 48 and self.keys[byte]:
            self.kids[self.keys[byte] - 1] = kid
        elif self.room == 256:
            self.kids[byte] = kid
        elif self.room == 48:
            if len(self.kids) == 48:
                self._grow_256()
                self.kids[byte] = kid
            else:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
        else:
            at = bisect_left(self.keys, byte) if self.room else 0
            if self.room and at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = kid
                return
            if not self.room:
                self.room, self.keys, self.kids = 4, bytearray(), []
            elif len(self.kids) == 16:
                self._grow_48()
                self.put(byte, kid)
                return
            elif len(self.kids) == 4:
                self.room = 16
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)

    def _grow_48(self) -> None:
        index = bytearray(256)
        for at, byte in enumerate(self.keys):
            index[byte] = at + 1
        self.room, self.keys = 48, index

    def _grow_256(self) -> None:
        kids = [self.kids[at - 1] if at else None for at in self.keys]
        self.room, self.keys, self.kids = 256, b"", kids

    def children(self):
        return [k for k in self.kids if k is not None] if self.room else []

    def add(self, conv: int, n: int, saved: int, leaves: int) -> None:
        if n:
            self.low = conv if self.low is None or conv < self.low else self.low
            self.n += n
        self.saved += saved
        self.leaves += leaves

    def split(self, at: int) -> Node:
        """The new upper part of this node, `at` bytes of prefix long."""
        upper = Node(self.prefix[:at])
        upper.low, upper.n, upper.saved, upper.leaves = self.low, self.n, self.saved, self.leaves
        self.prefix = self.prefix[at:]
        upper.put(self.prefix[0], self)
        return upper


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Bytes that `a` and `b` from `at` on have in common."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at:at + n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[at + lo:at + mid]:
            lo = mid
        else:
            hi = mid
    return lo


def chained(key: bytes, tid: bytes) -> bytes:
    """Key of the trie node one turn below `key`."""
    return hashlib.blake2b(key + tid, digest_size=KEY).digest()


class RadixTree:
    """Byte strings: a node key, then turn ids below it."""

    def __init__(self):
        self.root = Node(b"")
        self.depth_of: dict[bytes, int] = {}
        self.turns = 0

    def insert(self, base: bytes, depth: int, ids: bytes, conv: int, n: int, saved: int, leaves: int, end: bool) -> None:
        self.depth_of[base] = depth
        self.turns += 1 + len(ids) // WIDTH
        key = base + ids
        node, at = self.root, 0
        while True:
            node.add(conv, n, saved, leaves)
            if at == len(key):
                break
            kid = node.child(key[at])
            if kid is None:
                kid = Node(key[at:])
                node.put(key[at], kid)
            else:
                common = _shared(kid.prefix, key, at)
                if common < len(kid.prefix):
                    kid = kid.split(common)
                    node.put(key[at], kid)
            node, at = kid, at + len(kid.prefix)
        if end:
            node.ends = node.ends or []
            node.ends.append(conv)

    def rows(self):
        """Trie nodes at the turn-aligned byte depths, then their ends."""
        stack = [(kid, b"", None, 0) for kid in self.root.children()]
        while stack:
            node, held, key, depth = stack.pop()  # bytes since the last turn's end, the key there (None: still in the base)
            held += node.prefix
            at = 0
            if key is None and len(held) >= KEY:
                key, at = held[:KEY], KEY
                depth = self.depth_of[key]
                if depth == 0:
                    yield key, None, 0, 0, node.low, node.n, node.saved, node.leaves, None
            while key is not None and len(held) - at >= WIDTH:
                tid = held[at:at + WIDTH]
                parent, key, depth, at = key, chained(key, tid), depth + 1, at + WIDTH
                yield key, parent, depth, int.from_bytes(tid[-4:], "big"), node.low, node.n, node.saved, node.leaves, None
            for conv in node.ends or ():
                yield key, None, None, None, None, None, None, None, conv
            stack.extend((kid, held[at:], key, depth) for kid in node.children())


def _batches(rows, ddl: str, size: int = 8192):
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    schema = pa.schema([(k, kinds[t]) for k, t in fields])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _records(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _rebuilt(batches):
    """Turns sorted by family, first member, conversation and turn -> the
    rebuilt conversations' turns; depth 0 opens each conversation."""
    def rows():
        family = conv = None
        head: list[bytes] = []
        skip = depth = 0
        for own_family, own, tid in _records(batches):
            if own_family != family:
                family, head, conv = own_family, [], None
            if own != conv:
                conv, depth = own, 0
                yield conv, 0, None
                if conv != family:
                    skip = zlib.crc32(str(conv).encode()) % HEADS
                    for x in head[:skip]:
                        depth += 1
                        yield conv, depth, x
                else:
                    skip = 0
            if conv == family and len(head) < HEADS - 1:
                head.append(tid)
            if skip:
                skip -= 1
            else:
                depth += 1
                yield conv, depth, tid
    yield from _batches(rows(), _TURNS)


def _trees(tree_turns: int, first: bool):
    """Sorted turns -> trie nodes of this task.  The first pass counts members
    and ends; the second adds what a conversation gives to its nodes."""
    def rows(batches):
        tree = RadixTree()
        conv, base, depth, ids, add = None, ROOT, 0, bytearray(), (1, 0, 0)

        def put(end: bool):
            tree.insert(base, depth, bytes(ids), conv, *add, end and first)
        for own, _, tid, *given in _records(batches):
            if own != conv:
                if conv is not None:
                    put(True)
                conv, base, depth, ids, add = own, ROOT, 0, bytearray(), (1, 0, 0) if first else (0, *given)
            if tid is not None:
                if len(ids) == SEGMENT * WIDTH:
                    put(False)
                    for k in range(0, len(ids), WIDTH):
                        base = chained(base, bytes(ids[k:k + WIDTH]))
                    depth, ids = depth + SEGMENT, bytearray()
                ids += tid
            if tree.turns >= tree_turns:
                yield from tree.rows()
                tree = RadixTree()
        if conv is not None:
            put(True)
        yield from tree.rows()

    return lambda batches: _batches(rows(batches), _NODES)


def _end_digests(batches):
    """(key, conv) sorted -> SHA-256 of each key's comma-joined numbers."""
    def rows():
        key, state = None, None
        for own, conv in _records(batches):
            if own != key:
                if key is not None:
                    yield key, state.hexdigest()
                key, state = own, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        if key is not None:
            yield key, state.hexdigest()
    yield from _batches(rows(), "key binary, ends_sha256 string")


def turn_ids(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, tid) of every row."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256)
    tid = F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    return df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), tid.alias("tid"))


def rebuild(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, tid): every conversation starts with the first turns of
    its family's first member, as many as its number's checksum says, and goes
    on with its own turns after as many; sorted within its partition."""
    family = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    dealt = turns.select(family, "conv_id", "turn", "tid").repartition("family").sortWithinPartitions(
        "family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "tid")
    return dealt.select("family", "conv_id", "tid").mapInArrow(_rebuilt, _TURNS)


def plain(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, tid) of the conversations as they are."""
    def run(batches):
        def rows():
            conv, depth = None, 0
            for own, tid in _records(batches):
                if own != conv:
                    conv, depth = own, 0
                    yield conv, 0, None
                depth += 1
                yield conv, depth, tid
        yield from _batches(rows(), _TURNS)
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "tid")
    return dealt.select("conv_id", "tid").mapInArrow(run, _TURNS)


def trie(paths: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """Nodes of the prefix trie of `paths` (conv_id, depth, tid; depth 0 opens
    a conversation; sorted within partitions by conversation and depth)."""
    paths = cut_lineage(paths)
    part = cut_lineage(paths.mapInArrow(_trees(tree_turns, True), _NODES))
    nodes = part.where("n is not null").groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("n_bytes").alias("n_bytes"),
        F.min("low").alias("conv_id"), F.sum("n").alias("n_convs"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                        .withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes")))
    # a conversation's own path: from its top down to its end
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("own").alias("saved"),
                                          (F.max(F.struct("depth", "n_children"))["n_children"] == 0).cast("long").alias("leaves"))
    given = paths.join(owners, "conv_id").where(F.col("depth") < F.col("top")).select("conv_id", "depth", "tid", "saved", "leaves") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_trees(tree_turns, False), _NODES)
    above = given.groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    ends = part.where("ends is not null").select("key", "ends").repartition("key").sortWithinPartitions("key", "ends") \
        .mapInArrow(_end_digests, "key binary, ends_sha256 string")
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = nodes.withColumn("path_saved", F.sum("own").over(so_far)).withColumn("is_top", F.lead("depth").over(up).isNull()) \
        .withColumn("path_leaf", F.first(F.col("n_children") == 0).over(so_far).cast("long"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tops = along.where("is_top").join(parents, "parent", "left")
    rest = along.where("not is_top").withColumn("parent_conv_id", F.col("conv_id"))
    return tops.unionByName(rest).join(above, "key", "left").join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        (F.col("path_leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("path_saved") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE = f"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS turns FROM raw GROUP BY conv_id),
c AS (SELECT conv_id, turns, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d : ord(d)::BIGINT)),
        lambda s, b : list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
          lambda x, z : CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS s FROM own),
h AS (SELECT conv_id, turns, xor(s, 4294967295::BIGINT) % {HEADS} AS h FROM c),
b AS (SELECT h.conv_id, CASE WHEN h.conv_id % {FAMILY} = 0 THEN h.turns
        ELSE list_concat(coalesce(f.turns, [])[1:h.h], h.turns[h.h + 1:]) END AS turns
      FROM h LEFT JOIN own f ON f.conv_id = h.conv_id - h.conv_id % {FAMILY}),
p AS (SELECT conv_id, len(turns) AS n, turns, unnest(range(0, len(turns) + 1)) AS depth FROM b),
m AS (SELECT conv_id, n, depth, turns[1:depth] AS path FROM p),
g AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
t AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON g.path = k.path AND g.depth = k.depth),
u AS (SELECT path, depth, n_children, n_convs, unnest(range(0, depth + 1)) AS d FROM t),
a AS (SELECT path[1:d] AS path, d AS depth, count_if(n_children = 0) AS n_leaves,
        sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].text) END) AS saved_tokens FROM u GROUP BY ALL)
SELECT t.conv_id, t.depth, q.conv_id AS parent_conv_id, t.n_convs, t.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
FROM t JOIN a ON a.path = t.path AND a.depth = t.depth LEFT JOIN g q ON t.depth > 0 AND q.depth = t.depth - 1 AND q.path = t.path[1:t.depth - 1]
"""
