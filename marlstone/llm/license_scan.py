"""Fuzzy search for short licence notices.

A notice may differ from the text in k characters. Cut into k + 1 pieces, at least one piece must then occur exactly:
one automaton over all pieces of all notices finds these seeds, and the regex library's bounded-error matching verifies
the window around a seed and tells the edits and the span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import apart, each_batch

#: Phrases whose words must stand consecutively, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, in the form of words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by 4 0": "cc-by",
    "licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "released under the bsd license": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software": "isc",
    "free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 14
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = list(notices.items())
        self.edits = [max(1, len(n) // chars_per_edit) for n, _ in self.notices]
        self.patterns = [regex.compile(rf"(?be)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for (n, _), k in zip(self.notices, self.edits, strict=True)]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for which, ((notice, _), k) in enumerate(zip(self.notices, self.edits, strict=True)):
            at = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(at, at[1:], strict=False):
                seeds.setdefault(notice[a:b], []).append((which, a))
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()
        self._best = lru_cache(1 << 15)(self._search)

    def _search(self, which: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the notice's best match in the window of one seed, which has room for one match only."""
        m = self.patterns[which].search(window)
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None

    def notices_in(self, words: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, score) in characters of the joined words; of overlapping matches the best stays."""
        found, windows = set(), set()
        for end, (size, where) in self.automaton.iter(words):
            for which, offset in where:
                k, start = self.edits[which], end + 1 - size - offset
                window = (which, max(0, start - k), start + len(self.notices[which][0]) + k)
                if window not in windows:
                    windows.add(window)
                    if m := self._best(which, words[window[1] : window[2]]):
                        notice, label = self.notices[which]
                        found.add((label, window[1] + m[0], window[1] + m[1], m[2], 1 - m[2] / len(notice)))
        return apart(sorted(found, key=lambda f: (-f[4], f[1] - f[2], f[1], f[0])))

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode().translate(_WORDS).split()
        joined = b" " + b" ".join(words) + b" "
        blanks = np.zeros(0, np.int64)
        places: list[int] = []
        base = set()
        for phrase, label in BASE.items():
            needle, at = b" " + phrase.encode() + b" ", joined.find(b" " + phrase.encode() + b" ")
            while at >= 0:
                if not len(blanks):
                    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                base.add(label)
                places.append(int(np.searchsorted(blanks, at)))
                at = joined.find(needle, at + 1)
        plain = joined[1:-1].decode()
        notices = self.notices_in(plain)
        score = 1.0 if base else max((f[4] for f in notices), default=0.0)
        # the word of a character: how many blanks stand before it
        gaps = np.cumsum([len(w) + 1 for w in plain.split(" ")]) - 1 if notices else blanks
        word = lambda at: int(np.searchsorted(gaps, at))
        spans = [{"label": f[0], "first_word": word(f[1] + (plain[f[1] : f[1] + 1] == " ")), "last_word": word(f[2] - (plain[f[2] - 1 : f[2]] == " ")), "edits": f[3], "score": f[4]} for f in notices]
        return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {f[0] for f in notices})), "score": score, "spans": spans}


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("score", pa.float64())]))


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    for batch in batches:
        rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)), pa.array([r["spans"] for r in rows], SPANS)], ["doc_id", *names, "spans"])


def license_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row of ``docs``.

    Words are runs of digits, letters a-z after lower-casing A-Z, and anything beyond ASCII. n_base, first_word and
    last_word tell where a base phrase's words stand consecutively; labels joins the base ones with those of notices
    found within their bound of edits; score is 1 with a base label, else that of the best notice, else 0. spans has the
    notices by word. A null or empty text has no words, empty labels and score 0. Repeated rows are scanned each by
    itself; an empty table gives an empty result; other columns are not read.
    """
    schema = f"doc_id long, {COLUMNS}, spans array<struct<label: string, first_word: long, last_word: long, edits: long, score: double>>"
    return each_batch(docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text"), ["doc_id", "text"], schema, _run)

