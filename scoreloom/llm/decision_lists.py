"""Quality rules as learned decision lists.

One pass counts things in every whole text. Their ratios are the statistics that rules speak of, so a rule reads
``symbol_share >= 0.036 and word_length < 5.2``. The list is learned by sequential covering: a rule for the rejected class grows, condition
by condition, by the threshold with the highest information gain on two thirds of the rows, is then pruned to the prefix that does best
on the other third, and joins the list if it is right there in ``PRECISE`` of the cases or more; what it covers goes, and the next one
grows. The first rule that isn't good enough ends the list. A list becomes one ordered Spark conditional expression, which judges all rows where they are.

Learning takes at most ``SAMPLE`` labelled rows (those with the smallest hash of doc_id), fewer than a MB of statistics, on the driver; rows whose
crc32(doc_id) mod 5 is 0 are never learnt from, so they measure accuracy, and neither are rows that fail the base rules. Rows of ``labels`` with a null
label or doc_id are not used; repeated rows count as often as they occur. Without labels of both classes the list is empty and keeps everything.

Words are runs of bytes other than blank and the five controls from tab on. A null text has no words and fails the base rules, as does an empty
one. Texts of any length are counted whole, in time that grows with their length. Equal texts get equal verdicts. Other columns stay, but for those set
here; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import table
from scoreloom.llm.toxicity import held_out, sliced

SAMPLE = 8192
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; words of each 100
PRECISE = 0.9
LEAST_COVERED = 2  # rows of the rejected class that a rule covers where it grew
SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # of a code point's bytes all but the first
_DIGITS, _CAPITALS, _ENDS = b"0123456789", bytes(range(65, 91)), (b".", b"!", b"?", b":", "。".encode(), "…".encode())
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_ended", "n_digits", "n_capitals"]
#: What rules speak of: a statistic is one count over another.
STATISTICS = {
    "symbol_share": ("n_symbols", "word_chars"), "word_length": ("word_chars", "n_words"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"), "line_words": ("n_words", "n_lines"), "ended_share": ("n_ended", "n_lines"), "digit_share": ("n_digits", "word_chars"), "capital_share": ("n_capitals", "word_chars"),
}


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words that stand in a window of three words found twice or more, and distinct words."""
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(at) < 4 or len(ids) == len(at):
        return 0, len(ids)
    _, pair = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    again, covered = times[window] > 1, np.zeros(len(at), bool)
    for k in range(3):
        covered[k : len(at) - 2 + k] |= again
    return int(covered.sum()), len(ids)


def counts(text: bytes | None) -> list[int]:
    """``COUNTS`` of a text in UTF-8."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.translate(None, _BLANK)]
    repeated, distinct = repeated_words(words)
    size = lambda gone: len(text) - len(text.translate(None, gone))
    ended = sum(x.rstrip().endswith(_ENDS) for x in lines)
    return [len(words), len(text) - size(_BLANK + _INNER), size(SYMBOLS), len(lines) - len(set(lines)), repeated, distinct, len(lines), ended, size(_DIGITS), size(_CAPITALS)]


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``COUNTS`` to every row."""
    keep = docs.drop(*COUNTS)
    schema = T.StructType([*keep.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = np.array([counts(x) for x in b.column(text).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in found.T)], names=schema.names)

    return keep.mapInArrow(run, schema)


def statistic(name: str) -> Column:
    over, under = STATISTICS[name]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    bound: float

    def column(self) -> Column:
        return statistic(self.statistic) >= self.bound if self.above else statistic(self.statistic) < self.bound

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(STATISTICS).index(self.statistic)]
        return value >= self.bound if self.above else value < self.bound

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.bound:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that rejects; what none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def keeps(self) -> Column:
        """One conditional expression over ``COUNTS``."""
        return self.rule_number().isNull()

    def rule_number(self) -> Column:
        """The first rule that covers a row, from 1; null if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            every = rule[0].column()
            for c in rule[1:]:
                every = every & c.column()
            out = F.when(every, k) if out is None else out.when(every, k)
        return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))

    def __str__(self) -> str:
        return "\n".join([*(f"if {' and '.join(map(str, r))}: reject" for r in self.rules), "keep"])


def best_condition(x: np.ndarray, y: np.ndarray) -> Condition | None:
    """The threshold between two values of a statistic with the highest gain; of equal gains the first statistic's, widest gap first.

    With p and n rows of the rejected and the other class before, and p' and n' after, the gain is p' (log2 p'/(p'+n') - log2 p/(p+n)).
    """
    p, total = int(y.sum()), len(y)
    best, found = (1e-9, 0.0), None
    for k, name in enumerate(STATISTICS):
        order = np.argsort(x[:, k], kind="stable")
        v, below = x[order, k], np.cumsum(y[order])[:-1]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        gap = (v[cut + 1] - v[cut]) / (v[-1] - v[0])
        for above in (True, False):
            hit = (p - below[cut] if above else below[cut]).astype(float)
            size = (total - cut - 1 if above else cut + 1).astype(float)
            gain = np.where(hit > 0, hit * (np.log2(np.maximum(hit, 1) / size) - np.log2(p / total)), 0)
            top = np.lexsort((-gap, -gain))[0]
            if (round(gain[top], 9), gap[top]) > best:
                best = (round(gain[top], 9), gap[top])
                found = Condition(name, above, float((v[cut[top]] + v[cut[top] + 1]) / 2))
    return found


def covers(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def learn(x: np.ndarray, y: np.ndarray, prune: np.ndarray) -> DecisionList:
    """The list for rows of ``STATISTICS``; y is true where a row is to be rejected, prune where it takes part in pruning instead of growing."""
    rules, open_ = [], np.ones(len(y), bool)
    while True:
        on, off = open_ & ~prune, open_ & prune
        rule: tuple[Condition, ...] = ()
        while y[at := on & covers(rule, x)].any() and not y[at].all():
            more = best_condition(x[at], y[at])
            if more is None:
                break
            rule = (*rule, more)
        scores = []
        for size in range(1, len(rule) + 1):
            hit = covers(rule[:size], x)
            p, n = int((hit & off & y).sum()), int((hit & off & ~y).sum())
            scores.append(((p - n) / max(1, p + n), -size, p, n, int((hit & on & y).sum())))  # of equal ones the shortest prefix
        if not scores:
            break
        _, size, p, n, grown = max(scores)
        if not p or p < PRECISE * (p + n) or grown < LEAST_COVERED:
            break
        rules.append(rule[: -size])
        open_ &= ~covers(rules[-1], x)
    return DecisionList(tuple(rules))


def fit(labels: DataFrame, docs: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Learns to reject what ``label`` marks as 0. Rows that are held out are not used."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", (F.col(label) == 0).alias("label"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "label").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` narrow rows
    names = [F.col("h"), F.col("doc_id"), F.col("label"), *[statistic(s).alias(s) for s in STATISTICS]]
    rows = counted(texts).where(~base_failed()).select(*names).orderBy("h", "doc_id", "label", *STATISTICS).limit(sample).collect()  # also if doc_ids repeat
    x = np.array([r[3:] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return learn(x, np.array([r.label for r in rows], bool), np.array([r.h % 3 == 0 for r in rows], bool))


def judged(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Adds ``COUNTS``, base_failed and kept to every row."""
    out = counted(docs.drop("base_failed", "kept"), text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.keeps())


def op11_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(table(spark, sf_dir, "labels"), docs)
    return judged(docs, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept")
