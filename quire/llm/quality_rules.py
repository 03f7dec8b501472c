"""Operator 5: quality rules with risk-controlled thresholds (native).

Every document gets exact counts; every rule is a ratio of them, on a grid of
`STEPS` steps.  Cutoffs are chosen per stratum (text length class: a fixed
number of strata) from the labelled documents (labels.quality 1 = good), whose
ids' checksums put them into two halves:

* On the first half a rule takes the cutoff that rejects most labelled-bad
  documents less `good_weight` times the good ones; ties go to the mildest,
  and a rule that is worth nothing is left out.
* The second half is the holdout.  A stratum's chosen rules are tested
  together: at level s a document is rejected if some rule's step reaches both
  its cutoff and s, and a good document that is rejected by any rule is a
  false rejection.  The hypothesis "the stratum's false rejection rate exceeds
  `risk`" is rejected when the exact binomial tail P(Bin(n, risk) <= errors)
  is at most delta / strata (Bonferroni); levels are tested from the mildest
  on, stopping at the first failure (fixed sequence), and the last level
  passed raises the cutoffs below it.  With confidence 1 - delta every stratum
  loses at most `risk` of its good documents to all its rules together.  A
  stratum where the mildest level fails rejects nothing.

All work is DataFrame expressions inside the scan; the label join moves ids
and steps only, never texts; the thresholds (strata * rules <= 15 by
construction) become literals of the verdict.

Rows: null text counts as empty (no words, base_failed); repeated rows are
kept; an empty table gives no rows; labels that are null or not 0/1 and
repeated labels of a document with both values are not used; without labels
only the base rule rejects.  Extra columns pass through `annotate`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, written

RISK = 0.02
DELTA = 0.1
GOOD_WEIGHT = 20
STEPS = 40
STRATA = (100, 1000)  # words: short, medium, long
_SPACE = "[\\x20\\x09-\\x0D]"

#: rule -> (numerator, denominator, value of the last grid step)
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.4),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 1.0),
    "shouting": ("n_upper", "word_chars", 1.0),
    "few_words": ("n_again", "n_words", 1.0),
}


def _let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it in `body`."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")


def _windows(words: Column, n: int) -> Column:
    last = F.size(words) - n
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words (by position) inside an n-word window that occurs twice or more.

    If all window hashes differ, all windows differ: nothing repeats.  Only
    otherwise are the windows sorted by their words, equal neighbours marked
    and the marked positions' spans added up (each word once)."""
    hashes = F.transform(_windows(words, n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))

    def covered(_) -> Column:
        ordered = F.array_sort(F.transform(_windows(words, n), lambda i: F.struct(
            F.array_join(F.slice(words, i + 1, n), " ").alias("w"), i.alias("i"))))

        def spans(o: Column) -> Column:
            hit = F.filter(o, lambda x, j: (x["w"] == F.get(o, j + 1)["w"]) | ((j > 0) & (x["w"] == F.get(o, j - 1)["w"])))
            starts = F.array_sort(F.transform(hit, lambda x: x["i"]))
            add = F.aggregate(starts, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")), lambda a, s: F.struct(
                (a["sum"] + s + n - F.greatest(a["end"], s)).alias("sum"), (s + n).alias("end")))
            return add["sum"]
        return _let(ordered, spans)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _counted(text_col: str) -> Column:
    """An array with one struct: the counts every rule uses."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def count(words: Column) -> Column:
        joined = F.array_join(words, "")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(joined).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
            _again(words).cast("long").alias("n_again"))
    return F.transform(F.array(words_of(text)), count)


def annotate(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with one struct column `q`: the counts every rule uses."""
    return df.withColumn("q", _counted(text_col)[0])


def _again(words: Column) -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def stratum_of(n_words: Column) -> Column:
    return F.when(n_words < STRATA[0], 0).when(n_words < STRATA[1], 1).otherwise(2)


def _step(q: Column, rule: str) -> Column:
    """Grid step a document reaches under a rule (0: below the first)."""
    num, den, top = RULES[rule]
    return F.least(F.floor(STEPS * q[num] / (F.greatest(q[den], F.lit(1)) * top) + 1e-9), F.lit(STEPS)).cast("int")


def _binomial_tail(errors: Column, n: Column, p: float) -> Column:
    """Exact P(Bin(n, p) <= errors), summed in logarithms by the ratio of
    neighbouring terms; errors above n * p + 1 exceed any level in use."""
    few = errors <= n * p + 1
    terms = F.aggregate(
        F.sequence(F.lit(0), F.when(few, errors).otherwise(0)),
        F.struct((n * math.log(1 - p)).cast("double").alias("log"), F.lit(0.0).alias("sum")),
        lambda a, k: F.struct((a["log"] + F.log((n - k) / (k + 1)) + math.log(p / (1 - p))).alias("log"),
                              (a["sum"] + F.exp(a["log"])).alias("sum")))
    return F.when(few, F.least(terms["sum"], F.lit(1.0))).otherwise(1.0)


def _labelled(counts: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(id, stratum, steps, good, holdout) of the labelled rows that the base
    rule leaves; `steps` holds a row's grid step under every rule."""
    truth = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col(id_col)).agg(
        F.min("quality").alias("good"), F.max("quality").alias("_top")).where("good = _top").select(id_col, "good")
    q = F.col("q")
    steps = F.array(*[_step(q, r) for r in RULES])
    holdout = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 2 == 1
    return counts.where(~base_failed(q)).select(id_col, stratum_of(q["n_words"]).alias("stratum"), steps.alias("steps")).join(truth, id_col) \
        .withColumn("holdout", holdout)


def _from(counts: str, low: Column) -> Column:
    """Rows at step `low` or above, from a map step -> rows."""
    return F.aggregate(F.map_entries(F.col(counts)), F.lit(0).cast("long"),
                       lambda a, e: a + F.when(e["key"] >= low, e["value"]).otherwise(0))


def _by_step(cells: DataFrame, *keys: str) -> DataFrame:
    """Per key: maps step -> rows for good and bad (strata * rules * steps * 2 rows at most come in)."""
    return cells.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("good") == 1, F.struct("step", "n")))).alias("good"),
        F.map_from_entries(F.collect_list(F.when(F.col("good") == 0, F.struct("step", "n")))).alias("bad"))


def candidates(seen: DataFrame, good_weight: float = GOOD_WEIGHT) -> dict[tuple[int, int], int]:
    """(stratum, rule) -> the step worth most on the rows outside the holdout."""
    cells = seen.where("not holdout").select("stratum", F.posexplode("steps").alias("rule", "step"), "good") \
        .groupBy("stratum", "rule", "step", "good").agg(F.count(F.lit(1)).alias("n"))
    worth = F.transform(F.sequence(F.lit(STEPS), F.lit(1), F.lit(-1)), lambda s: F.struct(
        (_from("bad", s) - good_weight * _from("good", s)).alias("worth"), s.alias("step")))
    best = _by_step(cells, "stratum", "rule").select("stratum", "rule", F.array_max(worth).alias("best")).where("best.worth > 0")
    return {(r["stratum"], r["rule"]): r["best"]["step"] for r in best.collect()}  # strata * rules rows


def thresholds(seen: DataFrame, chosen: dict[tuple[int, int], int], risk: float = RISK, delta: float = DELTA) -> dict[int, int]:
    """stratum -> the strictest grid step from which on the joint verdict of
    its chosen rules passes on the holdout; strata where none does are left out."""
    reached = F.lit(0)
    for (stratum, rule), step in sorted(chosen.items()):
        own = F.col("steps")[rule]
        reached = F.greatest(reached, F.when((F.col("stratum") == stratum) & (own >= step), own).otherwise(0))
    cells = seen.where("holdout").groupBy("stratum", reached.alias("step"), "good").agg(F.count(F.lit(1)).alias("n"))
    n = _from("good", F.lit(0))
    level = delta / (len(STRATA) + 1)
    ok = F.transform(F.sequence(F.lit(STEPS), F.lit(1), F.lit(-1)), lambda s: (_binomial_tail(_from("good", s), n, risk) <= level).cast("int"))
    failed = _by_step(cells, "stratum").select("stratum", F.array_position(ok, 0).alias("first"))
    lowest = {r["stratum"]: 1 if r["first"] == 0 else STEPS + 2 - r["first"] for r in failed.collect()}  # one row a stratum
    return {s: step for s, step in lowest.items() if step <= STEPS}


def count_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, q) of every row, written once: both the thresholds and the
    verdicts read it, and the texts are counted a single time."""
    return cut_lineage(annotate(df.select(id_col, text_col), text_col).select(id_col, "q"))


def learn_cutoffs(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", risk: float = RISK, delta: float = DELTA,
                  good_weight: float = GOOD_WEIGHT) -> dict[str, int]:
    """'stratum:rule' -> grid step (at most strata * rules entries)."""
    seen = cut_lineage(_labelled(counts, labels.select(F.col("doc_id").alias(id_col), "quality"), id_col))
    chosen = candidates(seen, good_weight)
    lowest = thresholds(seen, chosen, risk, delta) if chosen else {}
    names = list(RULES)
    return {f"{s}:{names[r]}": max(step, lowest[s]) for (s, r), step in chosen.items() if s in lowest}


def rejects(q: Column, cut: dict[str, int]) -> Column:
    """Whether a rule's cutoff is reached."""
    over = F.lit(False)
    for name, step in sorted(cut.items()):
        stratum, rule = name.split(":")
        over = over | ((stratum_of(q["n_words"]) == int(stratum)) & (_step(q, rule) >= step))
    return over


def judge(counted: DataFrame, cut: dict[str, int]) -> DataFrame:
    """Rows with `q` get base_failed and kept."""
    q = F.col("q")
    return counted.withColumn("base_failed", base_failed(q)).withColumn("kept", ~F.col("base_failed") & ~rejects(q, cut))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that pass, with their columns unchanged.  Texts are
    counted once: the rows that the base rule leaves are written with their
    counts to the shared folder, the cutoffs are learned from the ids and
    counts there, and the verdict reads that table."""
    own = "q"
    while own in df.columns:  # a name that the input does not use
        own += "_"
    q = F.col(own)
    # generated, not filtered: a filter on the counts would make them twice
    counted = written(df.select(*df.columns, F.explode(F.filter(_counted(text_col), lambda x: ~base_failed(x))).alias(own)), "quality")
    cut = learn_cutoffs(counted.select(id_col, q.alias("q")), labels, id_col)
    return counted.where(~rejects(q, cut)).select(*df.columns)
