"""Vietnamese number words to digits."""

from __future__ import annotations

import re
from functools import cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import in_parts

# Digit words with their spoken variants, and the words that multiply.
DIGITS = {"không": 0, "một": 1, "hai": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "lăm": 5, "sáu": 6, "bảy": 7, "bẩy": 7, "tám": 8, "chín": 9}
UNITS = {"mười": "T", "mươi": "t", "trăm": "h"}
SCALES = {"nghìn": 10**3, "ngàn": 10**3, "triệu": 10**6, "tỷ": 10**9, "tỉ": 10**9}
ZERO_FILLERS = ("linh", "lẻ")

_SCALE_SIGN = {10**3: "K", 10**6: "M", 10**9: "G"}
#: One character for each word: a run of number words is a run of signs, and any other word is a dot.
_SIGN = {w: str(d) for w, d in DIGITS.items()} | UNITS | {w: _SCALE_SIGN[n] for w, n in SCALES.items()} | dict.fromkeys(ZERO_FILLERS, "z")
_RUN = re.compile(r"[^.]+")
_NUMERAL = {str(d): d for d in range(10)}
_SCALE = {s: n for n, s in _SCALE_SIGN.items()}


def read_number(signs: str) -> str:
    """Digits of one run of number words, given as signs: a spoken code without multipliers, else a value."""
    if signs.isdigit():
        return signs
    total = group = digits = 0
    for s in signs:
        if s in _NUMERAL:
            digits = 10 * digits + _NUMERAL[s]
        elif s == "t":
            group, digits = group + 10 * digits, 0
        elif s == "h":
            group, digits = group + 100 * digits, 0
        elif s == "T":
            group, digits = group + 10, 0
        elif s in _SCALE:
            total, group, digits = total + _SCALE[s] * (group + digits), 0, 0
    return str(total + group + digits)


def converted(words: list[str]) -> tuple[str, int]:
    """The words joined by spaces with maximal runs of number words as digits, and how many runs were converted.

    Fillers at the end of a run stay words; a lone filler, or a lone "không", is no number.
    """
    n, done, out = 0, 0, []
    for run in _RUN.finditer("".join(map(_SIGN.get, words, repeat(".")))):
        body = run[0].rstrip("z") or "z"
        if body in ("z", "0"):
            continue
        out += words[done : run.start()]
        out.append(read_number(body))
        done = run.start() + len(body)
        n += 1
    return " ".join([*out, *words[done:]]), n


def convert(text: str) -> tuple[str, int]:
    """`converted` of the text's words."""
    return converted(text.split())


@cache
def _udf(fillers: frozenset[str]):
    """Of each text its words but for fillers, converted; how many conversions; and how many fillers there were."""

    def one(text: str | None) -> tuple[str | None, int | None, int | None]:
        if text is None:
            return None, None, None
        words = text.split()
        n_fillers = sum(map(words.count, fillers))
        return *converted([w for w in words if w not in fillers] if n_fillers else words), n_fillers

    def build(texts: list[str | None]) -> pa.Array:
        done = [one(t) for t in texts]
        return pa.StructArray.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["text", "n_conversions", "n_fillers"])

    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_conversions", T.LongType()), T.StructField("n_fillers", T.LongType())]))
    def words_to_digits(texts: pa.Array) -> pa.Array:
        return in_parts(texts, build)

    return words_to_digits


def words_to_digits(text: Column, fillers: tuple[str, ...] = ()) -> Column:
    """Struct (text, n_conversions, n_fillers) of each text, white space squeezed, and words that equal a filler left out
    before; null gives nulls."""
    return _udf(frozenset(fillers))(text)
