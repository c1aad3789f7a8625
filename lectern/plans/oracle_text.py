"""SQL pieces of the oracles that need a rule of written Vietnamese or of resampling. They are stated here anew, from
the rule itself, and take nothing from the operators that they check."""

import random
import unicodedata

# The five tone marks; onsets, nuclei and codas of a syllable; particles that carry meaning.
MARKS = ("\u0300", "\u0301", "\u0303", "\u0309", "\u0323")
ONSETS = "ngh|ng|nh|ph|th|tr|ch|kh|gi|qu|gh|b|c|d|đ|g|h|k|l|m|n|p|q|r|s|t|v|x|y"
NUCLEI = (
    "oai|oay|uao|uay|uôi|ươi|ươu|iêu|yêu|uyu|uya|oeo|uyê|ia|ya|iê|yê|ua|uô|ưa|ươ|oa|oe|uy|uơ|uâ|oă|uê|"
    "ai|ay|ây|ao|au|âu|eo|êu|oi|ôi|ơi|ui|ưi|iu|ưu|a|ă|â|e|ê|i|o|ô|ơ|u|ư|y"
)
CODAS = "ng|nh|ch|c|m|n|p|t"
PARTICLES = "'ạ', 'à', 'ừ', 'ơ', 'dạ', 'vâng', 'nhé', 'nhỉ'"


def _toneless() -> dict[str, str]:
    out = {}
    for code in range(0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        rest = "".join(p for p in parts if p not in MARKS)
        if rest != parts:
            out[chr(code)] = unicodedata.normalize("NFC", rest)
    return out


_SINGLE = {a: b for a, b in _toneless().items() if len(b) == 1}
_GONE = "".join(a for a, b in _toneless().items() if not b)

_PLAIN = f"translate(nfc_normalize(lower(%s)), '{''.join(_SINGLE)}{_GONE}', '{''.join(_SINGLE.values())}')"
_SYLLABLE = f"^(?:{ONSETS})?(?:{NUCLEI})(?:{CODAS})?$"


def shape(token: str) -> str:
    """Whether the token reads as one syllable."""
    return f"regexp_matches(case when strlen({token}) = length({token}) then lower({token}) else {_PLAIN % token} end, '{_SYLLABLE}')"


def draws(k: int, resamples: int = 1000, seed: int = 42) -> str:
    """A CTE draws (b, i): the places that each resample of k segments draws, by Python's own generator."""
    rng = random.Random(seed)
    rows = ", ".join(str([rng.randrange(k) for _ in range(k)]) for _ in range(resamples))
    return f"draws as (select b, unnest(i) as i from (select generate_subscripts(x, 1) as b, unnest(x) as i from (select [{rows}] as x)))"


def twister(count: str, seed: int = 42) -> str:
    """CTEs whose last, `words` (i, y), has at least `count` (a scalar query) words of the Mersenne twister from the state
    that Python's generator starts with, 624 at a time, each block from the one before it."""
    g = lambda u, v, w: f"xor(xor({w}, (({u} & 2147483648) | ({v} & 2147483647)) >> 1), ({v} & 1) * 2567483615)"
    start = list(random.Random(seed).getstate()[1][:624])
    return f"""mt as (
  select 0 as block, {start}::bigint[] as s
  union all
  select block + 1, list_concat(a, b, c, [{g("s[624]", "a[1]", "b[170]")}]) from (
    select *, [{g("s[i]", "s[i + 1]", "b[i - 454]")} for i in range(455, 624)] as c from (
      select *, [{g("s[i]", "s[i + 1]", "a[i - 227]")} for i in range(228, 455)] as b from (
        select *, [{g("s[i]", "s[i + 1]", "s[i + 397]")} for i in range(1, 228)] as a from mt where block * 624 < ({count}))))),
raw as (select (block - 1) * 624 + generate_subscripts(s, 1) as i, unnest(s) as x from mt where block > 0),
t1 as (select i, xor(x, x >> 11) as x from raw), t2 as (select i, xor(x, (x << 7) & 2636928640) as x from t1), t3 as (select i, xor(x, (x << 15) & 4022730752) as x from t2),
words as materialized (select i, xor(x, x >> 18) as y from t3)"""


_LOW = 0xFFFFFFFF


def _times(x: str, factor: int) -> str:
    """x * factor modulo 2^64 over ubigint, in halves of 32 bits."""
    high, low = factor >> 32, factor & _LOW
    carry = f"((({x} & {_LOW}) * {low}::ubigint) >> 32)"
    upper = f"({carry} + ((({x} & {_LOW}) * {high}::ubigint) & {_LOW}) + ((({x} >> 32) * {low}::ubigint) & {_LOW}))"
    return f"((({upper} & {_LOW}) << 32) | ((({x} & {_LOW}) * {low}::ubigint) & {_LOW}))"


def _plus(x: str, y: str) -> str:
    low = f"(({x} & {_LOW}) + ({y} & {_LOW}))"
    return f"((((({x} >> 32) + ({y} >> 32) + ({low} >> 32)) & {_LOW}) << 32) | ({low} & {_LOW}))"


def poisson(table: str, pos: str, resamples: int, seed: int) -> str:
    """A CTE weighted: the rows of a table with b and w, the weight that splitmix64 of place, resample and seed gives."""
    total, term, bounds = 0.0, 2.718281828459045**-1, []
    for n in range(16):
        total += term
        term /= n + 1
        bounds.append(total)
    weight = " + ".join(f"(u > {x!r})::int" for x in bounds)
    return f""", places as (select *, {_times(f'{pos}::ubigint', 0x9E3779B97F4A7C15)} as p from {table}),
resamples as (select b, {_plus(_times('b', 0xD1B54A32D192ED03), f'{seed}::ubigint')} as q from (select unnest(range(1, {resamples + 1}))::ubigint as b)),
x0 as materialized (select places.*, b, {_plus('p', 'q')} as x from places, resamples),
x1 as (select *, xor(x, x >> 30) as y from x0), x2 as materialized (select * exclude (y, x), {_times('y', 0xBF58476D1CE4E5B9)} as x from x1),
x3 as (select *, xor(x, x >> 27) as y from x2), x4 as materialized (select * exclude (y, x), {_times('y', 0x94D049BB133111EB)} as x from x3),
weighted as (select *, {weight} as w from (select *, (xor(x, x >> 31) >> 11) / {1 << 53}.0 as u from x4))"""
