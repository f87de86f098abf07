"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditional expressions.

Rules are conjunctions of thresholds on text statistics. Each is grown on two thirds of the labelled rows by the
information gain of its next threshold and pruned on the other third; rows it covers leave, and the next rule follows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_sample, held_out, sampled_texts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_bars", "n_long_words", "n_distinct_words")
#: Learned features as Spark SQL over the counts.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "bar_share": "n_bars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "long_word_share": "n_long_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "cast(n_words as double)",
}
_SPACE, _SYMBOLS, _MARKS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"!?;:"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text; null counts as empty."""
    text = text or ""
    raw = text.encode()
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    words = raw.split()  # bytes.split() parts at the six ASCII white-space characters only
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        count, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return (len(words), len(text) - less(_SPACE), less(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), less(_UPPER), less(_DIGITS), less(_MARKS), raw.count(b"|"), sum(len(x) > 30 for x in words), len(set(words)))


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def counts_of(texts: pa.Array) -> pa.Array:
    """A struct of COUNTS for each text: only the texts go to Python, whatever else the rows have."""
    rows = [statistics(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], list(COUNTS))


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The columns of COUNTS and ``row``, a struct of all columns of ``docs``, so that no name can clash."""
    return docs.select(F.struct("*").alias("row"), counts_of(F.col(text_column)).alias("counts")).select("row", "counts.*")


@dataclass(frozen=True)
class Rule:
    """All of the tests (feature, '<=' or '>', threshold) must hold; precision is measured on the pruning rows."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def mask(self, data: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(data.values()))), bool)
        for f, op, x in self.tests:
            out &= data[f] <= x if op == "<=" else data[f] > x
        return out

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {op} {x!r}D" for f, op, x in self.tests)


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> list[tuple[str, str, float]]:
    tests, inside = [], np.ones(len(bad), bool)
    while len(tests) < most_tests and bad[inside].mean() < 1:
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        base, best = np.log2(max(p0, 1e-9) / (p0 + n0)), (1e-9, None)
        for f, x in data.items():
            values = x[inside]
            order = np.argsort(values, kind="stable")
            v, y = values[order], bad[inside][order]
            ends = np.flatnonzero(np.diff(v))
            if not len(ends):
                continue
            p, n = np.cumsum(y)[ends], np.cumsum(~y)[ends]
            for op, p1, n1 in (("<=", p, n), (">", p0 - p, n0 - n)):
                gain = p1 * (np.log2(np.maximum(p1, 1e-9) / np.maximum(p1 + n1, 1)) - base)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (f, op, float((v[ends[i]] + v[ends[i] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        f, op, x = best[1]
        inside &= data[f] <= x if op == "<=" else data[f] > x
    return tests


def learn_rules(data: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, support: int = 5, seed: int = 3) -> list[Rule]:
    """An ordered list of rules for the rows marked ``bad``; the default after the last rule is "good".

    A rule enters only if it is right on at least ``precision`` of the rows it covers (Laplace-corrected, over the
    growing and the pruning rows), and covers ``support`` of them. No rows, or none that are bad: no rules.
    """
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    alive = np.arange(len(bad))
    third = rng.random(len(bad)) < 1 / 3
    while len(rules) < most_rules:
        grow, prune = alive[~third[alive]], alive[third[alive]]
        if not bad[grow].any():
            break
        tests = _grow({f: x[grow] for f, x in data.items()}, bad[grow], most_tests)
        if not tests:
            break
        held = {f: x[prune] for f, x in data.items()}
        scored = []
        for k in range(1, len(tests) + 1):
            m = Rule(tuple(tests[:k]), 0, 0).mask(held)
            p, n = bad[prune][m].sum(), (~bad[prune][m]).sum()
            scored.append(((p - n) / (p + n) if p + n else -1.0, -k, k))
        k = max(scored)[2]
        m = Rule(tuple(tests[:k]), 0, 0).mask({f: x[alive] for f, x in data.items()})
        right, all_ = int(bad[alive][m].sum()), int(m.sum())
        rule = Rule(tuple(tests[:k]), (right + 1) / (all_ + 2), all_)
        if rule.precision < precision or rule.covered < support:
            break
        rules.append(rule)
        alive = alive[~m]
    return rules


def verdict(rules: list[Rule]) -> F.Column:
    """0 if no rule fires, else the number of the first that does, as one ordered conditional expression."""
    if not rules:
        return F.lit(0)
    out = F.when(F.expr(rules[0].sql()), F.lit(1))
    for i, r in enumerate(rules[1:], 2):
        out = out.when(F.expr(r.sql()), F.lit(i))
    return out.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> list[Rule]:
    """Rules from at most ``max_rows`` labelled rows (documented bound; the same rows in every run). Label 0 is bad; null
    labels and ids don't count; of a repeated id the least label and the least text do."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).alias("doc_id")).agg(F.min(label_column).alias("label"))
    chosen = bounded_sample(known, "doc_id", max_rows).persist()
    try:
        rows = sampled_texts(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), chosen, chosen.count())
        got = with_statistics(rows).select(*(F.expr(x).alias(f) for f, x in FEATURES.items()), "row.label").toPandas()
    finally:
        chosen.unpersist()
    got = got.sort_values(list(got.columns)).reset_index(drop=True)
    return learn_rules({f: got[f].to_numpy(float) for f in FEATURES}, got["label"].to_numpy() == 0)


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def judge(docs: DataFrame, rules: list[Rule], text_column: str = "text") -> DataFrame:
    """row (all columns of ``docs``), COUNTS, base_failed, rule (number of the rule that fired, 0: none) and kept."""
    out = with_statistics(docs, text_column).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule for every row.

    A null or empty text has no words and fails the base rules. Repeated rows are judged each by itself. Empty tables
    give an empty result or no learned rules. Other columns of ``docs`` are not read.
    """
    rules = fit(docs, labels, max_rows)
    return judge(docs.select("doc_id", "text"), rules).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule").cast("int").alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor a learned rule rejects, with all their own columns, whatever
    their names. A null or empty text goes; repeated rows and rows without an id are judged each by itself; an empty
    table gives an empty result."""
    return judge(docs, fit(docs, labels, max_rows)).where("kept").select("row.*")
