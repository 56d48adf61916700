"""Quality rules: a decision list learned from labelled statistics (operator 4).

Every text gets counts; from labelled documents sequential covering learns an ordered list of rules,
each a conjunction of thresholds on ratios of the counts.  A rule is grown on one part of the
examples, condition by condition, until it covers no good document there, then pruned on the other
part, and kept if it is right there often enough.  The list is emitted as one conditional expression.

Texts go through DataFrame operations only.  The learner sees at most about ``EXAMPLES`` labelled rows, chosen by
a hash of doc_id; that bound doesn't depend on the size of the table.  Without labels of both kinds
the list is empty and keeps everything.

A null text has no words; an empty table gives an empty result; repeated rows are judged alike; labels
that contradict each other count as bad; columns other than doc_id, text, quality are not looked at,
and ``judged`` carries them along under a struct.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, words

EXAMPLES, PRECISION, CONDITIONS, RULES = 8000, 0.95, 4, 24
#: Beyond so many comparisons, repeated windows are looked up by sorting, not by scanning.
SCAN = 2_000_000


def _count(text: Column, characters: str) -> Column:
    return (F.size(F.split(text, characters, -1)) - 1).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, row (all other columns) and the counts of each whole text."""
    rest = [c for c in docs.columns if c != "doc_id"]
    x = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    x = x.select("doc_id", "row", text_of("row.text").alias("t"))
    x = x.select("doc_id", "row", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n", -1), lambda y: y.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    x = x.select(
        "doc_id", "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("t"), r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _count(F.col("t"), "[A-Z]").alias("n_upper"),
        _count(F.col("t"), "[0-9]").alias("n_digits"),
        _count(F.col("t"), "[!?]").alias("n_marks"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # most texts repeat few windows or none
    ordered = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array("h")).otherwise(F.array().cast("array<bigint>"))
    x = x.withColumn("s", ordered)
    x = x.withColumn("d", F.array_distinct(F.filter("s", lambda e, i: (i > 0) & (F.get("s", i - 1) == e))))
    scanned = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains("d", F.get("h", i)))
    pairs = F.transform("h", lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    x = x.withColumn("o", F.when(F.size("d").cast("long") * F.size("h") > SCAN, F.array_sort(pairs)))
    found = F.filter("o", lambda e, k: ((k > 0) & F.coalesce(F.get("o", k - 1)["e"] == e["e"], F.lit(False))) | F.coalesce(F.get("o", k + 1)["e"] == e["e"], F.lit(False)))
    x = x.withColumn("p", F.when(F.size("d") == 0, F.array().cast("array<int>")).when(F.col("o").isNull(), scanned).otherwise(F.sort_array(F.transform(found, lambda e: e["i"]))))
    covered = F.aggregate(F.transform("p", lambda e, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - e, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, e: a + e)
    return x.withColumn("n_repeat_words", covered).drop("h", "s", "d", "o", "p")


#: What rules put thresholds on, as (name, numerator, denominator); a denominator of 0 counts as 1.
RATIOS = [
    ("symbols_per_word", "n_symbols", "n_words"),
    ("marks_per_word", "n_marks", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("mean_word", "word_chars", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
]


def ratio(name: str) -> Column:
    top, below = next((a, b) for n, a, b in RATIOS if n == name)
    return F.col(top) / F.greatest(F.col(below), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def examples(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and labels (1: bad) of about ``most`` labelled documents, in order of doc_id."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    share = min(1.0, most / max(known.count(), 1))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality")).limit(2 * most)
    stats = counted(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id").cast("long") == F.col("id"), "left_semi"))  # 2 * most rows at most
    rows = stats.join(F.broadcast(picked), F.col("doc_id").cast("long") == F.col("id")).select("id", "quality", *[ratio(n).alias(n) for n, _, _ in RATIOS]).dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: r["id"])
    return np.array([[r[n] for n, _, _ in RATIOS] for r in rows], dtype=float).reshape(-1, len(RATIOS)), np.array([int(r["quality"] == 0) for r in rows])


def _covers(rule: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, sign, limit in rule:
        out &= x[:, k] > limit if sign == ">" else x[:, k] <= limit
    return out


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> list[tuple[int, str, float]]:
    rule: list[tuple[int, str, float]] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most and (y[inside] == 0).any():
        p, n = y[inside].sum(), (1 - y[inside]).sum()
        best = (1e-9, None)
        for k in range(x.shape[1]):
            values = x[inside, k]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, 129)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            order = np.argsort(values, kind="stable")
            bad = np.concatenate([[0], np.cumsum(y[inside][order])])
            below = np.searchsorted(values[order], cuts, side="right")
            for sign, tp, all_ in ((">", p - bad[below], len(values) - below), ("<=", bad[below], below)):
                tn = all_ - tp
                with np.errstate(divide="ignore", invalid="ignore"):  # FOIL's gain
                    gain = np.where(tp > 0, tp * (np.log2(tp / (tp + tn)) - np.log2(p / (p + n))), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (k, sign, float(cuts[gain.argmax()])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _covers(rule[-1:], x)
    return rule


def learn(x: np.ndarray, y: np.ndarray, precision: float = PRECISION, conditions: int = CONDITIONS, rules: int = RULES) -> list[list[tuple[str, str, float]]]:
    """The ordered rules for bad documents, each a list of (ratio, ">" or "<=", threshold)."""
    out = []
    prune = np.arange(len(x)) % 3 == 2
    gx, gy, px, py = x[~prune], y[~prune], x[prune], y[prune]
    while len(out) < rules and gy.sum() >= 3 and (gy == 0).any():
        rule = _grow(gx, gy, conditions)

        def worth(r):
            c = _covers(r, px)
            good = (py[c] == 0).sum()
            return ((py[c] == 1).sum() - good) / c.sum() if c.any() else -1.0

        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        c = _covers(rule, px)
        if not c.any() or py[c].mean() < precision:
            break
        out.append([(RATIOS[k][0], sign, limit) for k, sign, limit in rule])
        g = ~_covers(rule, gx)
        gx, gy, px, py = gx[g], gy[g], px[~c], py[~c]
    return out


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """True: keep.  The first rule that holds decides."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for name, sign, limit in rule:
            holds = holds & (ratio(name) > limit if sign == ">" else ratio(name) <= limit)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """doc_id, row, the counts, base_failed and kept."""
    rules = learn(*examples(docs, labels, most))
    return counted(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    # the row's place keeps the filter above the counts: pushed down, it would inline them into lambdas
    out = judged(docs, labels).withColumn("place", F.monotonically_increasing_id()).filter(F.col("kept") & (F.col("place") >= 0))
    return out.select(*["doc_id" if c == "doc_id" else F.col("row").getField(c).alias(c) for c in docs.columns])
