"""Elements of a JSON array as a text has them, byte by byte: order and blanks of keys, spellings of numbers, escapes."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_TURN = np.zeros(256, np.int8)
_TURN[[ord("["), ord("{")]], _TURN[[ord("]"), ord("}")]] = 1, -1
_MARK = _TURN != 0
_MARK[[ord(","), ord(":")]] = True
_BLANK = b" \t\r\n"


def _quotes(body: np.ndarray) -> np.ndarray:
    """Places of the quotes that begin or end a string: those not behind an odd run of backslashes."""
    quotes, back = np.flatnonzero(body == ord('"')), np.flatnonzero(body == ord("\\"))
    if not len(back) or not len(quotes):
        return quotes
    first = np.r_[True, np.diff(back) != 1]
    start = back[first][np.cumsum(first) - 1]  # where the run of each backslash begins
    at = np.minimum(np.searchsorted(back, quotes - 1), len(back) - 1)
    return quotes[np.where(back[at] == quotes - 1, quotes - start[at], 0) % 2 == 0]


def elements_of(text: bytes | memoryview | pa.Buffer, name: str | None) -> list[bytes] | None:
    """The elements of an array, the text's root or what its root object has under ``name`` (the last, if it is there twice);
    None if there is no such array. The text is taken for JSON: who isn't sure parses it, too."""
    body = np.frombuffer(text, np.uint8)
    quotes = _quotes(body)
    marks = np.flatnonzero(_MARK[body])
    marks = marks[np.searchsorted(quotes, marks) % 2 == 0]  # those outside strings
    kind = body[marks]
    depth = np.cumsum(_TURN[kind], dtype=np.int64)
    begin = 0
    if name is not None:
        begin = len(marks)
        for c in np.flatnonzero((kind == ord(":")) & (depth == 1))[::-1]:
            q = np.searchsorted(quotes, marks[c])
            if q >= 2 and json.loads(body[quotes[q - 2] : quotes[q - 1] + 1].tobytes()) == name:
                begin = c + 1
                break
    if begin >= len(marks) or kind[begin] != ord("["):
        return None
    level = depth[begin]
    ends = np.flatnonzero(depth[begin:] < level)
    if not len(ends):
        return None
    end = begin + ends[0]
    commas = marks[begin:end][(kind[begin:end] == ord(",")) & (depth[begin:end] == level)]
    cuts = zip(np.r_[marks[begin], commas] + 1, np.r_[commas, marks[end]])
    found = [body[a:b].tobytes().strip(_BLANK) for a, b in cuts]
    return [] if found == [b""] else found


@F.arrow_udf(ArrayType(StringType()))
def json_elements(bodies: pa.Array, names: pa.Array) -> pa.Array:
    return pa.array([None if not b.is_valid else elements_of(b.as_buffer(), n.as_py()) for b, n in zip(bodies, names)], pa.list_(pa.string()))
