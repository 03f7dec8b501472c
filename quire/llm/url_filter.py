"""Operator 12: URL filter over a sorted digest array.

A filter list holds rules (host, path, verdict) and words that block a host.
Spark turns it into one table of entries, sorted by the 64-bit xxhash of their
full strings, in the shared checkpoint folder; its files are added to the
session, so every executor (a replacement too) fetches its own copy.  The
first task on an executor lays the entries out as flat arrays (digests,
string offsets, strings, verdicts), written in batches of bounded memory, and
all its workers memory-map them.  A page's host and path are cut out in the
JVM; its candidate strings are hashed, looked up together by vectorised binary
search, and a hit counts only if the stored string is the same (equal digests
stand side by side and are tried in turn).

Candidates of a page: its host and every parent domain (as many labels as the
longest rule host has) are looked up as hosts; a known host names the lengths
of its rules' paths, and the page's path cut to each of them is looked up as
a rule.  The longest rule (host and path, then host) decides; without a rule,
a blocked word among the host's words (cut at dots and hyphens) blocks, and
all else is allowed.

The list is a parameter, not data: it is measured before it is shipped, and
one above `MAX_BYTES` is refused.  The pages are read once, without a shuffle,
so a host with a third of all pages is as good as any.

Rows: a null url or one without `://` has an empty host and path, no rule and
is allowed; repeated rows are judged each; rules given twice count once, with
`block` before `allow`; an empty list allows all; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import fcntl
import functools
import os
import re
import string
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir

#: The seed of Spark's xxhash64.
SEED = 42
#: Largest filter list (its strings' bytes) that is laid out on an executor's disk.
MAX_BYTES = 8 << 30
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BLOCK_WORDS = ("ads", "adult", "bets", "betting", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "spam", "warez", "xxx")
_AT_ONCE = 1 << 16


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def word_table(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def entry_table(rules: DataFrame, words: DataFrame) -> DataFrame:
    """(key, entry, block, lengths): one row per rule ("r" host path), per
    host with rules ("h" host; the lengths of its paths) and per word ("w")."""
    own = rules.where("host is not null").select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        (F.col("verdict") == "block").alias("block"))
    none = F.array().cast("array<int>")
    by_rule = own.groupBy(F.concat(F.lit("r"), "host", "path").alias("entry")).agg(F.max("block").alias("block"), none.alias("lengths"))
    by_host = own.groupBy(F.concat(F.lit("h"), "host").alias("entry")).agg(
        F.lit(False).alias("block"), F.sort_array(F.collect_set(F.char_length("path"))).alias("lengths"))  # as many as a path has characters
    by_word = words.where("word is not null").select(F.concat(F.lit("w"), F.lower("word")).alias("entry")).distinct() \
        .select("entry", F.lit(True).alias("block"), none.alias("lengths"))
    rows = by_rule.union(by_host).union(by_word)
    return rows.select(F.xxhash64("entry").alias("key"), "entry", "block", "lengths")


class DigestArray:
    """Memory-mapped entries in the order of their digests."""

    def __init__(self, folder: str):
        at = {k: np.load(f"{folder}/{k}.npy", mmap_mode="r") for k in ("key", "end", "text", "block", "length_end", "length")}
        self.key, self.end, self.text, self.block, self.length_end, self.length = at.values()

    def entry(self, i: int) -> bytes:
        return self.text[self.end[i]:self.end[i + 1]].tobytes()

    def find(self, entries: list[str]) -> np.ndarray:
        """Place of each string, -1 where it is not stored."""
        raw = [e.encode() for e in entries]
        want = np.array([xxhash.xxh64_intdigest(b, seed=SEED) for b in raw], dtype=np.uint64).view(np.int64)
        at = np.searchsorted(self.key, want)
        found = np.full(len(raw), -1, dtype=np.int64)
        open_ = np.arange(len(raw))
        while open_.size:  # equal digests stand side by side
            here = at[open_]
            inside = here < self.key.size
            open_, here = open_[inside], here[inside]
            same = self.key[here] == want[open_]
            open_, here = open_[same], here[same]
            hit = np.array([self.entry(i) == raw[k] for k, i in zip(open_.tolist(), here.tolist())], dtype=bool)
            found[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1
        return found

    def lengths(self, i: int) -> list[int]:
        return self.length[self.length_end[i]:self.length_end[i + 1]].tolist()


def lay_out(files: Sequence[str], folder: str) -> None:
    """Sorted Parquet files -> arrays on disk, a batch of rows at a time."""
    tables = [pq.ParquetFile(f) for f in files]

    def batches(columns):
        for t in tables:
            yield from t.iter_batches(_AT_ONCE, columns=columns)
    n = sum(t.metadata.num_rows for t in tables)
    kind = {"key": np.int64, "block": np.bool_, "end": np.int64, "length_end": np.int64, "text": np.uint8, "length": np.int32}
    size = dict.fromkeys(kind, n) | {"end": n + 1, "length_end": n + 1, "text": 0, "length": 0}
    for b in batches(["entry", "lengths"]):
        size["text"] += sum(len(x.encode()) for x in b.column("entry").to_pylist())
        size["length"] += len(b.column("lengths").flatten())
    out = {}
    for k, dtype in kind.items():
        if size[k]:
            out[k] = np.lib.format.open_memmap(f"{folder}/{k}.npy", "w+", dtype, (size[k],))
        else:  # an empty file cannot be mapped
            np.save(f"{folder}/{k}.npy", np.empty(0, dtype))
    at = chars = held = 0
    for b in batches(None):
        to = at + b.num_rows
        out["key"][at:to], out["block"][at:to] = np.asarray(b.column("key")), b.column("block").to_numpy(zero_copy_only=False)
        for i, (e, lengths) in enumerate(zip(b.column("entry").to_pylist(), b.column("lengths").to_pylist()), at):
            raw = e.encode()
            out["text"][chars:chars + len(raw)] = np.frombuffer(raw, np.uint8)
            if lengths:
                out["length"][held:held + len(lengths)] = lengths
            chars, held = chars + len(raw), held + len(lengths)
            out["end"][i + 1], out["length_end"][i + 1] = chars, held
        at = to
    for a in out.values():
        a.flush()


@functools.lru_cache(maxsize=4)
def open_array(name: str, files: tuple[str, ...]) -> DigestArray:
    """The arrays of an executor, laid out in place by the first worker that
    gets the lock.  A folder without its mark is not whole (its writer was
    ended): the next holder of the lock lays it out again."""
    folder = os.path.join(os.path.abspath(SparkFiles.getRootDirectory()), name)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)  # freed with the file, also if the worker dies
        if not os.path.exists(f"{folder}/whole"):
            lay_out([SparkFiles.get(f) for f in files], folder)
            open(f"{folder}/whole", "w").close()
        return DigestArray(folder)


class Filter:
    """A written list: the names of its files and what bounds its probes."""

    def __init__(self, name: str, files: tuple[str, ...], labels: int, longest_word: int):
        self.name, self.files, self.labels, self.longest_word = name, files, labels, longest_word

    def array(self) -> DigestArray:
        return open_array(self.name, self.files)


def write_filter(rules: DataFrame, words: DataFrame, max_bytes: int = MAX_BYTES) -> Filter:
    """Writes the sorted entries to the shared folder and adds the files to
    the session."""
    spark = rules.sparkSession
    name = f"digests-{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    entry_table(rules, words).orderBy("key", "entry").write.parquet(path)
    entry = F.col("entry")
    kind = F.substring(entry, 1, 1)
    known = spark.read.parquet(path).agg(
        F.sum(F.octet_length(entry)).alias("bytes"), F.max(F.when(kind == "h", F.size(F.split(entry, "\\.")))).alias("labels"),
        F.max(F.when(kind == "w", F.char_length(entry) - 1)).alias("word")).first()
    if (known["bytes"] or 0) > max_bytes:
        raise ValueError(f"the filter list holds {known['bytes']} bytes, more than {max_bytes}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    files = sorted(f.getPath().toString() for f in found or [])
    for f in files:
        spark.sparkContext.addFile(f)
    return Filter(name, tuple(f.rsplit("/", 1)[1] for f in files), known["labels"] or 0, known["word"] or 0)


def judge_batch(hosts: list[str], paths: list[str], array: DigestArray, labels: int, longest_word: int) -> tuple[list, list]:
    """Rule and verdict of each (host, path)."""
    parents: dict[str, list[str]] = {}
    words: dict[str, list[str]] = {}
    for host in dict.fromkeys(hosts):
        parts = host.rsplit(".", labels)
        parts = parts if len(parts) <= labels else parts[1:]
        parents[host] = [".".join(parts[i:]) for i in range(len(parts))] if labels and host else []
        words[host] = [w for w in set(re.split("[.-]", host)) if 0 < len(w) <= longest_word]
    asked = list(dict.fromkeys(["h" + p for ps in parents.values() for p in ps] + ["w" + w for ws in words.values() for w in ws]))
    place = dict(zip(asked, array.find(asked).tolist()))
    known = {h: [(p, array.lengths(place["h" + p])) for p in ps if place["h" + p] >= 0] for h, ps in parents.items()}
    blocked = {h: any(place["w" + w] >= 0 for w in ws) for h, ws in words.items()}
    rows, tried = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        for parent, lengths in known[host]:
            for n in lengths:
                if n <= len(path):
                    rows.append((i, len(parent) + n, len(parent)))
                    tried.append(parent + path[:n])
    best: dict[int, tuple[int, int, int, int]] = {}
    for k, ((i, total, own), at) in enumerate(zip(rows, array.find(["r" + t for t in tried]).tolist())):
        if at >= 0 and (i not in best or (total, own) > best[i][:2]):
            best[i] = (total, own, at, k)
    rule = [tried[best[i][3]] if i in best else None for i in range(len(hosts))]
    verdict = ["block" if (array.block[best[i][2]] if i in best else blocked[h]) else "allow" for i, h in enumerate(hosts)]
    return rule, verdict


def judge(df: DataFrame, filter_: Filter, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    def run(batches):
        for b in batches:
            rule, verdict = judge_batch(b.column("host").to_pylist(), b.column("path").to_pylist(), filter_.array(), filter_.labels, filter_.longest_word)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()),
                                              pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])
    url = F.col(url_col)
    return df.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string")


def _oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    words = ", ".join(f"'{w}'" for w in BLOCK_WORDS)
    return f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS n, page_id,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT n, rule_host || rule_path AS rule, rule_verdict,
             row_number() OVER (PARTITION BY n ORDER BY len(rule_host || rule_path) DESC, len(rule_host) DESC) AS r
      FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict,
       CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT * FROM f WHERE r = 1) USING (n)
"""


ORACLE = _oracle()
