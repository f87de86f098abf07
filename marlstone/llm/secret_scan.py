"""Secret scan: candidate strings, and a random forest that removes the false positives.

A candidate is a long run of token characters with digits or mixed case, or the value assigned to a credential's name.
The forest sees its length, character transitions, dictionary coverage, whether it looks like a path, and the words around
it. It is trained here on labelled findings: given ones, or else findings in a bounded sample of the documents that a
strict rule labels, with decoys made by rule, half of them stripped of their context so that the value must tell too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, apart, bounded_sample, discard, each_batch, sampled_texts, stash

#: Forms of published key prefixes, and names that credentials are assigned to.
PREFIXED = {"aws": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "google": r"\bAIza[0-9A-Za-z_-]{35}", "stripe": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", "jwt": r"(?<![\w-])eyJ[\w-]{8,}+\.eyJ[\w-]{8,}\.[\w-]{8,}", "private-key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?s:.*?)(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----|\Z)"}
CONTEXT = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "private", "access")
BENIGN = ("sha", "sha1", "sha224", "sha256", "sha384", "sha512", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "id", "etag", "revision", "version", "example", "http", "https", "url", "path", "file", "isbn", "order", "number")
_FORMS = re.compile("|".join(f"(?P<{k.replace('-', '_')}>{v})" for k, v in PREFIXED.items()))
#: A name is read to its end before its sign is looked for, from the name's start only, so that no text is read over and over.
#: It may stand in quotes; a quoted value reaches the closing quote in its line, blanks and all; a scheme's name comes before
#: the value of a header.
_ASSIGNED = re.compile(
    r"(?i)(?<![\w.-])(?=[\w.-]*?(?:token|secret|passw(?:or)?d|passphrase|passcode|pwd|key|access|private|auth|credential))[\w.-]++[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}"
    r"(?P<value>\"(?:(?:bearer|basic)\s)?+[^\"\n]{6,}+\"|'(?:(?:bearer|basic)\s)?+[^'\n]{6,}+'|(?:(?:bearer|basic)\s{1,3})?+[^\s\"',;]{8,})"
)
_SCHEME = re.compile(r"(?i)(?:bearer|basic)\s{1,3}")
#: A scheme's name alone tells what follows, without a header's.
_BEARER = re.compile(r"(?i)(?<![\w-])bearer\s{1,3}(?P<value>[A-Za-z0-9._~+/-]{8,}+=*)")
_RUN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}")
#: What a text must contain for the forms, or for a credential's name, to be looked for.
_FORM_SIGNS = ("AKIA", "ASIA", "gh", "xox", "AIza", "k_live_", "k_test_", "eyJ", "-----BEGIN")
_NAME_SIGNS = ("token", "secret", "passw", "passphrase", "passcode", "pwd", "key", "access", "private", "auth", "credential")
#: How long the usual digests are in hexadecimal, with or without their name, and the form of a UUID.
_DIGEST = re.compile(r"(?i)(?:[a-z0-9]+[-=])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
#: Words joined in a value: by signs, digits or capitals.
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Letter pairs that running text of several languages has most; the rest of a value's pairs speak for chance.
PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie un ge au ue es la qu os".split())
FEATURES = ("length", "entropy", "digit_share", "upper_share", "transitions", "common_pairs", "hex", "coverage", "longest_word", "slashes", "extension", "padding", "distinct_share", "quoted", "assigned", "context_words", "benign_words", "prefixed", "digest_form")


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    kind: str
    value: str
    before: str
    after: str


def _named(low: str) -> bool:
    return any(x in low for x in _NAME_SIGNS)


def findings_in(text: str | None) -> list[Finding]:
    """Candidates in order, each to its end, however long; a private key reaches its END line, or the end of the text if it
    has none. Of overlapping ones, the form of known keys stays before an assignment, that before a plain run."""
    text = text or ""
    spans: list[tuple[str, int, int]] = []
    if any(x in text for x in _FORM_SIGNS):
        spans += [(m.lastgroup.replace("_", "-"), m.start(), m.end()) for m in _FORMS.finditer(text)]
    low = text.lower()
    if ("=" in text or ":" in text) and _named(low):
        for m in _ASSIGNED.finditer(text):
            a, b = m.span("value")
            quoted = text[a] in "\"'"
            a, b = a + quoted, b - quoted
            scheme = _SCHEME.match(text, a, b)
            spans.append(("assigned", scheme.end() if scheme else a, b))
    if "bearer" in low:
        spans += [("assigned", *m.span("value")) for m in _BEARER.finditer(text)]
    if max(map(len, text.split()), default=0) >= 20:
        for m in _RUN.finditer(text):
            v = m[0]
            digits = sum(map(str.isdigit, v))
            if digits and any(map(str.isalpha, v)) and (digits >= 4 or v.lower() != v):
                spans.append(("run", m.start(), m.end()))
    rank = {"run": 2, "assigned": 1}
    kept = apart(sorted(spans, key=lambda s: (rank.get(s[0], 0), s[1], s[2])))
    return [Finding(a, b, kind, text[a:b], text[max(0, a - 40) : a], text[b : b + 30]) for kind, a, b in kept]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def describe(f: Finding, dictionary: frozenset[str]) -> list[float]:
    v, n = f.value, max(1, len(f.value))
    count = Counter(v)
    words = [w.lower() for w in _PART.findall(v)]
    pairs = [v[i : i + 2].lower() for i in range(n - 1) if v[i : i + 2].isalpha()]
    near = {w.lower() for w in _WORD.findall(f.before)[-4:]} | {w.lower() for w in _WORD.findall(f.after)[:1]}
    near |= {p for w in near for p in w.split("_")} | {w.lower() for w in _WORD.findall(re.split("[-=:]", v, maxsplit=1)[0])}  # a value may begin with its own label
    return [
        float(len(v)), -sum(k / n * math.log2(k / n) for k in count.values()), sum(map(str.isdigit, v)) / n, sum(map(str.isupper, v)) / n,
        sum(_kind(a) != _kind(b) for a, b in zip(v, v[1:], strict=False)) / n, sum(p in PAIRS for p in pairs) / max(1, len(pairs)), float(all(c in "0123456789abcdefABCDEF" for c in v)),
        sum(len(w) for w in words if w in dictionary) / n, max((len(w) for w in words), default=0) / n, v.count("/") / n, float(bool(re.search(r"\.[a-z]{1,4}$", v))),
        float(v.endswith("=")), len(count) / n, float(f.before[-1:] in "\"'" and f.after[:1] in "\"'" and bool(f.before)), float(bool(re.search(r"(?i)(=>|:=|=|:)\s{0,3}[\"']?(?:(?:bearer|basic)\s{1,3})?$", f.before))),
        float(sum(w in CONTEXT for w in near)), float(sum(w in BENIGN for w in near)), float(f.kind not in ("run", "assigned")),
        float(bool(_DIGEST.fullmatch(v))),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left, right, probability."""

    trees: list[tuple[np.ndarray, ...]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (feature[at] >= 0).any():
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at], left[at], right[at]))
            total += value[at]
        return total / max(1, len(self.trees))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 8, least: int = 2, seed: int = 9) -> Forest:
    """Bootstrap samples, a random third of the features at each split, Gini impurity."""
    rng, out = np.random.default_rng(seed), []
    tried = max(1, round(x.shape[1] / 3))
    for _ in range(trees):
        pick = rng.integers(0, len(x), len(x))
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, level: int, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, (y[rows].sum() + 0.5) / (len(rows) + 1)])
            if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
                return at
            best = (1e-9, -1, 0.0)
            p = y[rows].mean()
            for f in rng.choice(x.shape[1], tried, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, s = x[rows, f][order], np.cumsum(y[rows][order])
                ends = np.flatnonzero(np.diff(v))
                ends = ends[(ends + 1 >= least) & (len(rows) - ends - 1 >= least)]
                if len(ends):
                    n = ends + 1
                    a, b = s[ends] / n, (s[-1] - s[ends]) / (len(rows) - n)
                    gain = p * (1 - p) - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (gain[i], int(f), float((v[ends[i]] + v[ends[i] + 1]) / 2))
            if best[1] >= 0:
                go = x[rows, best[1]] <= best[2]
                nodes[at][:2] = best[1], best[2]
                nodes[at][2] = split(rows[go], level + 1)
                nodes[at][3] = split(rows[~go], level + 1)
            return at

        split(pick, 0)
        cols = list(zip(*nodes, strict=True))
        out.append((np.array(cols[0], np.int64), np.array(cols[1]), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4])))
    return Forest(out)


def strict_label(f: Finding, dictionary: frozenset[str]) -> int | None:
    """1 or 0 where a strict rule is sure, else None: a published key form, or a high-entropy value assigned to a
    credential's name, is a secret; a value made of dictionary words, or named as a digest or an id, is none."""
    d = dict(zip(FEATURES, describe(f, dictionary), strict=True))
    if d["prefixed"]:
        return 1
    if d["coverage"] > 0.6 or d["benign_words"] and not d["context_words"]:
        return 0
    if d["assigned"] and d["context_words"] and d["entropy"] >= 3 and d["digit_share"] >= 0.1:
        return 1
    return 0 if not d["context_words"] and (d["common_pairs"] > 0.4 or d["digit_share"] < 0.05 or d["entropy"] < 2.5) else None


def decoys(words: list[str], n: int, seed: int = 8) -> list[tuple[Finding, int]]:
    """Findings made by rule: keys in several alphabets and contexts, and look-alikes (digests, paths, ids, placeholders, joined words)."""
    r = np.random.default_rng(seed)
    draw = lambda alphabet, lo, hi: "".join(alphabet[i] for i in r.integers(0, len(alphabet), int(r.integers(lo, hi + 1))))
    word = lambda: words[int(r.integers(len(words)))]
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    out = []
    for _ in range(n):
        name = CONTEXT[int(r.integers(len(CONTEXT)))]
        quote, sign = ("\"", "'", "")[int(r.integers(3))], (" = ", "=", ": ")[int(r.integers(3))]
        random = lambda: (draw("0123456789abcdef", 32, 64), draw(low + up + dig, 20, 48), draw(low + up + dig + "+/", 24, 88), draw(low + dig, 20, 40), draw(up + dig, 20, 40), draw(low + up + dig + "!@#$%&*", 8, 24), draw(low + dig, 8, 16))[int(r.integers(7))]
        value = random()
        out.append((Finding(0, len(value), "assigned", value, f"{word()} {word()} {name}{sign}{quote}", f"{quote} {word()}"), 1))
        benign = BENIGN[int(r.integers(len(BENIGN)))]
        hexes = lambda k: draw("0123456789abcdef", k, k)
        digest = hexes((32, 40, 56, 64, 96, 128)[int(r.integers(6))]) if r.random() < 0.7 else "-".join(hexes(k) for k in (8, 4, 4, 4, 12))
        value, before = (
            (digest, f"{word()} {benign}{sign}{quote}"), (digest, f"{word()} {word()}{(sign, ' ')[int(r.integers(2))]}{quote}"), (random(), f"{word()} {benign}{sign}{quote}"), ("/".join(word() for _ in range(4)) + "/" + draw(dig, 2, 4), f"{word()} {word()} "), ("-".join(word() for _ in range(4)) + draw(dig, 1, 4), f"{word()} {word()} "),
            (draw(dig, 16, 24) + "x", f"{benign} "), (f"your_{name}_here_{draw(dig, 1, 3)}", f"{name}{sign}{quote}"), ("x" * int(r.integers(16, 40)) + "1", f"{name}{sign}{quote}"), (word() + draw("123", 1, 3), f"{name}{sign}{quote}"),
            ("".join(w.capitalize() for w in (word(), word(), word())) + draw(dig, 1, 4), f"{word()} {word()} "),
        )[int(r.integers(10))]
        out.append((Finding(0, len(value), "run", value, before, f"{quote if before.endswith(quote) else ''} {word()}"), 0))
    return out


@dataclass
class Model:
    forest: Forest
    dictionary: frozenset[str]

    def score(self, found: list[Finding]) -> np.ndarray:
        return self.forest.score(np.array([describe(f, self.dictionary) for f in found])) if found else np.zeros(0)


def train(labelled: list[tuple[Finding, int]], dictionary: frozenset[str], seed: int = 9) -> Model:
    """From labelled findings and decoys. Half of the findings come a second time without their context."""
    rng = np.random.default_rng(seed)
    both = labelled + decoys(sorted(dictionary) or ["word"], 800)
    bare = [(Finding(f.start, f.end, "run", f.value, "", ""), y) for f, y in both if rng.random() < 0.5]
    x, y = np.array([describe(f, dictionary) for f, _ in both + bare]), np.array([v for _, v in both + bare], float)
    return Model(grow_forest(x, y), dictionary)


#: Documents that a word of the dictionary is in at least: what fewer have is as likely a part of a key.
LEAST_DOCS = 3


def dictionary_of(docs: DataFrame, most_words: int = BROADCAST_ROWS) -> frozenset[str]:
    """Words of three letters at least that LEAST_DOCS documents have, counted over all documents, whatever their length.

    ``most_words`` is what the broadcast may hold: only if there are more, the least number of documents rises until they fit.
    """
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).where(F.length("w") >= 3)
    counted = stash(words.groupBy("w").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= LEAST_DOCS), "words")
    held, least = 0, None
    for r in sorted(counted.groupBy("docs").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > most_words:
            break
        least = r["docs"]
    out = frozenset(counted.where(F.col("docs") >= least).select("w").toArrow()["w"].to_pylist()) if least else frozenset()
    discard(counted)
    return out


def fit(docs: DataFrame, labelled: DataFrame | None = None, sample_docs: int = 3000, longest: int = 50_000, most_words: int = BROADCAST_ROWS) -> Model:
    """From findings in at most ``sample_docs`` whole texts of at most ``longest`` characters (documented bounds; the same
    in every run), with the dictionary of all documents. ``labelled`` (doc_id, start, end, label) tells which findings are
    secrets: its documents are the sample, and findings that it doesn't name don't count. Without it the strict rule
    labels them. Of a repeated id the least text counts."""
    dictionary = dictionary_of(docs, most_words)
    short = docs.where(F.col("doc_id").isNotNull() & (F.length("text") <= longest)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = (short if labelled is None else labelled.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")).select("doc_id").distinct()
    chosen = bounded_sample(ids, "doc_id", sample_docs)
    found = each_batch(sampled_texts(short, chosen, sample_docs), ["doc_id", "text"], "doc_id long, start long, end long, kind string, value string, before string, after string", _candidates)
    if labelled is None:
        found = found.withColumn("label", F.lit(None).cast("int"))
    else:
        found = found.join(labelled.where("label is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).agg(F.max("label").cast("int").alias("label")), ["doc_id", "start", "end"])
    known = []
    for r in found.toPandas().sort_values(["doc_id", "start"]).itertuples(index=False):
        f = Finding(r.start, r.end, r.kind, r.value, r.before, r.after)
        y = strict_label(f, dictionary) if labelled is None else int(r.label)
        if y is not None:
            known.append((f, y))
    return train(known, dictionary)


def _rows(ids: list, found: list[list[Finding]]) -> list[list]:
    flat = [(i, f) for i, fs in zip(ids, found, strict=True) for f in fs]
    return [[i for i, _ in flat], [f.start for _, f in flat], [f.end for _, f in flat], [f.kind for _, f in flat], [f.value for _, f in flat], [f.before for _, f in flat], [f.after for _, f in flat]]


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = _rows(batch.column(0).to_pylist(), [findings_in(t.as_py()) for t in batch.column(1)])
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "start", "end", "kind", "value", "before", "after"])


def secrets(docs: DataFrame, model: Model | None = None, threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, kind, value_sha256, score, is_secret: one row for each candidate, the false positives too.

    start and end count code points. The value itself isn't returned. Without a model one is fitted, from ``labelled``
    findings (doc_id, start, end, label) where they are given. Null and empty texts have no rows; repeated rows are
    scanned each by itself, one without an id too; an empty table gives an empty result; other columns are not read.
    """
    import hashlib

    model = model or fit(docs, labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [findings_in(t.as_py()) for t in batch.column(1)]
            scores = shared.value.score([f for fs in found for f in fs])
            cols = _rows(batch.column(0).to_pylist(), found)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array([hashlib.sha256(v.encode()).hexdigest() for v in cols[4]], pa.string()), pa.array(scores, pa.float64()), pa.array(scores >= threshold, pa.bool_())], ["doc_id", "start", "end", "kind", "value_sha256", "score", "is_secret"])

    return each_batch(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), ["doc_id", "text"], "doc_id long, start long, end long, kind string, value_sha256 string, score double, is_secret boolean", run)
