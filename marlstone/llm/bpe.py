"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a partition's texts lie end to end in one array of symbols, linked both ways. An index maps each
adjacent pair to all positions where it begins. Active pairs are taken in ascending order of rank; merging a pair at all
its positions updates the lists of the neighbouring pairs only. Each text is then the concatenation of its pieces' ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import each_batch

#: Fixed value: the published pattern that splits text before byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are indexed together, and words whose ids a task remembers.
BLOCK_CHARS, WORDS_KEPT = 8_000_000, 600_000
#: A symbol beyond all merges.
SEPARATOR = 65_535
_SPACES, _NONE = re.compile(r" \s"), np.zeros(0, np.int32)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Vocabulary:
    """Ranks of pairs, ids and bytes of tokens, and special tokens that text may hold verbatim."""

    rank_ids: np.ndarray  # vocabulary id of each symbol: bytes are symbols 0 to 255, the merge of rank r makes symbol 256 + r
    parts: list[tuple[int, int]]  # left and right symbol of each merge
    keys: np.ndarray  # sorted left << 16 | right of all merges, and one that is larger than any
    made: np.ndarray  # the symbol that each of keys makes
    token_bytes: list[bytes]
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, text: str) -> Vocabulary:
        spec = json.loads(text)
        pre, model, post = spec["pre_tokenizer"] or {}, spec["model"], spec["decoder"] or {}
        odd = {
            "a normalizer": spec["normalizer"], "another pre-tokenizer": pre.get("type") != "ByteLevel" or not pre.get("use_regex", True), "a prefix space": pre.get("add_prefix_space"), "another decoder": post.get("type") != "ByteLevel",
            "another model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
            "added tokens that match otherwise than verbatim": any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        }
        if found := [k for k, v in odd.items() if v]:
            raise ValueError(f"the vocabulary file asks for {', '.join(found)}: only plain byte-level BPE is read")
        vocab, to_byte = spec["model"]["vocab"], byte_symbols()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            token_bytes[i] = token.encode() if token in special else bytes(to_byte[c] for c in token)
        for token, i in special.items():
            token_bytes[i] = token.encode()
        symbol = {c: b for c, b in to_byte.items()}
        parts = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if left + right in symbol or 256 + rank >= SEPARATOR:
                raise ValueError("two merges make one token, or there are over 65,000: ranks must ascend along a piece and fit 16 bits")
            parts.append((symbol[left], symbol[right]))
            symbol[left + right] = 256 + rank
        rank_ids = np.zeros(SEPARATOR, "<u4")
        for token, i in symbol.items():
            rank_ids[i] = vocab[token]
        keys = np.array([a << 16 | b for a, b in parts] + [1 << 40], np.int64)
        order = np.argsort(keys)
        return cls(rank_ids, parts, keys[order], order + 256, token_bytes, special)

    def splitter(self) -> tuple[regex.Pattern, regex.Pattern | None]:
        names = sorted(self.special, key=len, reverse=True)
        return regex.compile(SPLIT), regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted places where one symbol pairs with itself, the first, third, ... of each run that overlaps."""
    starts = np.ones(len(at), bool)
    starts[1:] = after[at[:-1]] != at[1:]
    begin = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - begin) % 2 == 0]


def merge_pieces(pieces: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces end to end, number of ids of each), for non-empty pieces: one pair occurrence index over all of them."""
    raw = [p.encode() for p in pieces]
    stops = np.cumsum(np.array([len(r) for r in raw]) + 1)  # a separator, part of no pair, follows each piece and stands in front of all
    symbols = np.full(int(stops[-1]) + 1, SEPARATOR, np.int64)
    inner = np.ones(len(symbols), bool)
    inner[0] = inner[stops] = False
    symbols[inner] = np.frombuffer(b"".join(raw), np.uint8)
    after, before = np.arange(1, len(symbols) + 1, dtype=np.int32), np.arange(-1, len(symbols) - 1, dtype=np.int32)
    index: list[list[np.ndarray] | None] = [None] * (256 + len(v.parts))

    def enter(keys: np.ndarray, at: np.ndarray) -> None:
        """Adds the places of those pairs that merge to the index."""
        i = np.searchsorted(v.keys, keys)
        found = v.keys[i] == keys
        if not found.any():
            return
        news, at = v.made[i[found]], at[found]
        if len(news) > 1:
            order = np.argsort(news, kind="stable")
            news, at = news[order], at[order]
            cuts = [0, *(np.flatnonzero(news[1:] != news[:-1]) + 1).tolist(), len(news)]
        else:
            cuts = [0, 1]
        for a, b in zip(cuts, cuts[1:], strict=False):
            new = news[a]
            if index[new] is None:
                index[new] = [at[a:b]]
            else:
                index[new].append(at[a:b])

    enter(symbols[:-1] << 16 | symbols[1:], np.arange(len(symbols) - 1, dtype=np.int32))
    for new in range(256, len(index)):  # ascending ranks; a merge only adds places to higher ones
        places = index[new]
        if places is None:
            continue
        at = places[0] if len(places) == 1 else np.concatenate(places)
        index[new] = None
        left, right = v.parts[new - 256]
        j = after[at]
        held = (symbols[at] == left) & (symbols[j] == right)  # else a merge of lower rank took part of it
        at = at[held]
        if left == right and len(at) > 1:
            at = _alternate(np.sort(at), after)
        if not len(at):
            continue
        j = after[at]
        k, h = after[j], before[at]
        symbols[at], symbols[j] = new, -1
        after[at], before[k] = k, at
        back = symbols[h] != new  # else the place before, merged just now too, enters this pair
        enter(np.concatenate([new << 16 | symbols[k], symbols[h[back]] << 16 | new]), np.concatenate([at, h[back]]))
    alive = (symbols >= 0) & (symbols != SEPARATOR)
    return v.rank_ids[symbols[alive]], np.diff(np.cumsum(alive)[stops], prepend=0)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """Distinct words, numbered as they come, and their ids end to end."""

    def __init__(self, prefix: str):
        self.prefix, self.numbers, self.ids, self.counts = prefix, _Numbers(), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def add(self, words: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int32)


class Encoder:
    """Encodes blocks of texts and remembers the ids of words from block to block.

    A space before anything but white space always begins a piece, so texts are cut there first and only distinct words
    are split into pieces. Texts with white space after a space are split into pieces as they stand.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.pattern, self.special = v.splitter()
        self.forget()

    def forget(self) -> None:
        self.first, self.rest = Words(""), Words(" ")

    def split(self, text: str) -> list[str]:
        if self.special and any(s in text for s in self.v.special):
            return [p for k, part in enumerate(self.special.split(text)) for p in ([part] if k % 2 else self.pattern.findall(part))]
        return self.pattern.findall(text)

    def _merge(self, words: Words) -> None:
        split = [self.split(words.prefix + w) for w in islice(words.numbers, len(words.counts), None)]
        special = self.v.special
        pieces = [p for s in split for p in s]
        plain = [p for p in pieces if p not in special]
        ids, counts = merge_pieces(plain, self.v) if plain else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if len(plain) < len(pieces):  # a special token is one id, whatever its letters merge to
            at, parts, own = iter(np.split(ids, np.cumsum(counts)[:-1])), [], []
            for p in pieces:
                parts.append(np.array([special[p]], "<u4") if p in special else next(at))
                own.append(len(parts[-1]))
            ids, counts = np.concatenate(parts), np.array(own)
        sums, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum([len(s) for s in split])
        words.ids, words.counts = np.concatenate([words.ids, ids]), np.concatenate([words.counts, np.diff(sums[ends], prepend=0)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        cut: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            if _SPACES.search(text):
                cut.append((self.first.add(self.split(text)), _NONE))
            else:
                head, *tail = text.split(" ")
                cut.append((self.first.add([head] if head else []), self.rest.add(tail)))
        for words in (self.first, self.rest):
            if len(words.numbers) > len(words.counts):
                self._merge(words)
        starts = [np.cumsum(w.counts) - w.counts for w in (self.first, self.rest)]
        out = []
        for numbers in cut:
            ids = []
            for words, start, p in zip((self.first, self.rest), starts, numbers, strict=True):
                if len(p):
                    n = words.counts[p]
                    ends = np.cumsum(n)
                    ids.append(words.ids[np.repeat(start[p] - ends + n, n) + np.arange(ends[-1])].tobytes())
            out.append(b"".join(ids))
        if len(self.first.numbers) + len(self.rest.numbers) > WORDS_KEPT:
            self.forget()
        return out


def decode_ids(packed: bytes, v: Vocabulary) -> str:
    """The text of packed ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(v.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def _encoder(vocabulary: str) -> Encoder:
    """Kept from task to task in a Python worker; what it remembers is bounded and follows from the vocabulary alone."""
    return Encoder(Vocabulary.parse(vocabulary))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of about BLOCK_CHARS characters each; a longer text is a block of its own."""
    for batch in batches:
        start, chars, texts = 0, 0, []
        for i, value in enumerate(batch.column(1)):
            texts.append(value.as_py() or "")
            chars += len(texts[-1])
            if chars >= BLOCK_CHARS:
                yield batch.column(0).slice(start, i + 1 - start), texts
                start, chars, texts = i + 1, 0, []
        if texts:
            yield batch.column(0).slice(start), texts


def tokenized(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", with_tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``; with_tokens adds token_ids and decoded.

    A null text counts as empty: no tokens. Repeated rows are encoded each by itself. An empty table gives an empty
    result. Other columns are not read. The vocabulary file is read once, on the driver, and its bounded text (under 2 MB)
    goes to the tasks with the code; the file must be one whose merges each make a token of their own.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(text)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<long>, decoded string" if with_tokens else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        v = encoder.v
        for ids, texts in _blocks(batches):
            packed = encoder.encode(texts)
            decoded = [decode_ids(p, v) for p in packed]
            columns = [ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
            if with_tokens:
                columns += [pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in packed], pa.list_(pa.int64())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return each_batch(docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text"), ["doc_id", "text"], schema, run)
