"""Text expressions. Everything here but `nfc` stays inside the JVM.

Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Punctuation that normalisation turns into spaces; the hyphen stays.
PUNCTUATION = ".,!?;:\"'`()[]{}<>/\\|~^*_=+&%$#@…“”‘’–—"
# Marks stripped from the edges of a token, and marks counted as punctuation.
EDGE_MARKS = ".,?!:;\"'()[]…-–—"
COUNTED_MARKS = ".,?!:;"
# Vietnamese particles that carry meaning and are never fillers.
LEXICAL_PARTICLES = ("ạ", "à", "ừ", "ơ", "dạ", "vâng", "nhé", "nhỉ")
# Onsets, nuclei and codas of written Vietnamese syllables without tones.
ONSETS = "ngh ng nh ph th tr ch kh gi qu gh b c d đ g h k l m n p q r s t v x y".split()
NUCLEI = (
    "oai oay uao uay uôi ươi ươu iêu yêu uyu uya oeo uyê ia ya iê yê ua uô ưa ươ oa oe uy uơ uâ oă uê "
    "ai ay ây ao au âu eo êu oi ôi ơi ui ưi iu ưu a ă â e ê i o ô ơ u ư y"
).split()
CODAS = "ng nh ch c m n p t".split()
# Combining acute, grave, hook above, tilde and dot below, the tone marks.
TONES = "̣́̀̉̃"
LABEL = r"\[[^\]\n]{1,40}\]"

_longest_first = lambda parts: "|".join(sorted(parts, key=lambda p: (-len(p), p)))
SYLLABLE = f"^(?:{_longest_first(ONSETS)})?(?:{_longest_first(NUCLEI)})(?:{_longest_first(CODAS)})?$"
#: White space as Python's str.split has it: Unicode's, and the four separators of ASCII.
SPACE = r"[\s\x1C-\x1F]"


def _without_tones(letter: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", letter).translate(dict.fromkeys(map(ord, TONES))))


#: Every letter, of any script, whose decomposition holds a tone mark, and what is left of it; none lies above U+1FFF.
TONED = {c: _without_tones(c) for c in map(chr, range(0x80, 0x2000)) if set(unicodedata.normalize("NFD", c)) & set(TONES)}
#: Letters whose decomposed form has to be composed again before a syllable can be read.
COMPOSED = {unicodedata.normalize("NFD", c): c for c in "ăâêôơưĂÂÊÔƠƯ"}


def lit_sql(text: str) -> str:
    """A SQL string literal of both Spark and DuckDB for text without backslashes."""
    return "'" + text.replace("'", "''") + "'"


#: Texts of an Arrow batch that are Python strings at once.
AT_ONCE = 64


def in_parts(texts: pa.Array, build: Callable[[list], pa.Array]) -> pa.Array:
    """build over AT_ONCE texts at a time: of a batch, whatever its rows, only so many are ever Python strings; the others
    stay in Arrow's buffers."""
    parts = [build(texts.slice(low, AT_ONCE).to_pylist()) for low in range(0, len(texts), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else build([])


@F.arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return in_parts(texts, lambda part: pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in part], pa.string()))


def nfc(text: Column) -> Column:
    """Canonical composition, the one step without a built-in: texts cross to Python in Arrow batches, where composed
    ones are told by a quick check. A test by expression would cost more than the crossing."""
    return _nfc(text)


def strip(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def tokens(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(squeeze(text), " "), lambda t: t != "")


def without(words: Column, fillers: tuple[str, ...]) -> Column:
    """Words that equal no filler; repeats stay, unlike with array_except."""
    return F.filter(words, lambda t: ~t.isin(*fillers)) if fillers else words


#: What can be done with number words.
CONVENTIONS = ("word_to_digit", "as_written")


def folded(words: Iterable[str]) -> tuple[str, ...]:
    """Words as normalised text has them: lower case, composed."""
    return tuple(unicodedata.normalize("NFC", w.lower()) for w in words)


@dataclass(frozen=True)
class Normalizer:
    """One normalisation of both sides of a comparison: composition, case, punctuation, white space, fillers and
    number words, in this order."""

    lowercase: bool = True
    strip_punctuation: bool = True
    filler_tokens: tuple[str, ...] = ()
    number_convention: str = "word_to_digit"

    def __post_init__(self) -> None:
        if self.number_convention not in CONVENTIONS:
            raise ValueError(f"number_convention has to be one of {CONVENTIONS}, not {self.number_convention!r}")
        if clash := set(folded(self.filler_tokens)) & set(LEXICAL_PARTICLES):
            raise ValueError(f"lexical particles can't be fillers: {sorted(clash)}")

    def audited(self, text: Column) -> Column:
        """Struct (text, conversions, fillers_removed)."""
        from lectern.functions.numbers_vi import words_to_digits

        out = nfc(text)
        out = F.lower(out) if self.lowercase else out
        out = F.translate(out, PUNCTUATION, " " * len(PUNCTUATION)) if self.strip_punctuation else out
        fillers = folded(self.filler_tokens)
        if self.number_convention == "word_to_digit":
            # words cross to Python for their numbers in any case, and are split and told from fillers there
            done = words_to_digits(out, fillers)
            return F.struct(done["text"].alias("text"), done["n_conversions"].alias("conversions"), (done["n_fillers"] if fillers else F.lit(0).cast("long")).alias("fillers_removed"))
        out, removed = squeeze(out), F.lit(0).cast("long")
        if fillers:
            words = tokens(out)
            kept = without(words, fillers)
            out, removed = F.array_join(kept, " "), (F.size(words) - F.size(kept)).cast("long")
        conversions = F.lit(0).cast("long")
        return F.struct(out.alias("text"), conversions.alias("conversions"), removed.alias("fillers_removed"))

    def other(self) -> Normalizer:
        """The same with the other number convention, to see how much rates depend on it."""
        (convention,) = set(CONVENTIONS) - {self.number_convention}
        return replace(self, number_convention=convention)

    def __call__(self, text: Column) -> Column:
        return self.audited(text)["text"]


def normalize(text: Column, **options) -> Column:
    return Normalizer(**options)(text)


def audit(texts: DataFrame, normalizer: Normalizer, text: str, *keys: str) -> DataFrame:
    """(keys, conversions, fillers_removed): what normalisation did to the texts. Without any conversion the number
    parser may be broken."""
    done = texts.select(*keys, normalizer.audited(F.col(text)).alias("_done"))
    return done.groupBy(*keys).agg(F.sum("_done.conversions").alias("conversions"), F.sum("_done.fillers_removed").alias("fillers_removed"))


def strip_tone(word: Column) -> Column:
    """The word without tone marks, composed or not; the letters ă â ê ô ơ ư đ stay, whole also where they were decomposed."""
    one = {c: t for c, t in TONED.items() if len(t) == 1}
    none = "".join(c for c, t in TONED.items() if not t)
    out = F.translate(word, "".join(one) + none, "".join(one.values()))
    for pairs in (COMPOSED, {c: t for c, t in TONED.items() if len(t) > 1}):
        for old, new in pairs.items():
            out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(F.octet_length(word) > F.length(word), out).otherwise(word)  # ASCII has no marks


def is_vietnamese_shaped(token: Column) -> Column:
    """Whether the token reads as onset, nucleus and coda of one syllable."""
    return strip_tone(F.lower(token)).rlike(SYLLABLE)


def is_loanword(token: Column) -> Column:
    """Letters only, two or more of them, and not shaped like a syllable."""
    return (F.length(token) > 1) & token.rlike(r"^\p{L}+$") & ~is_vietnamese_shaped(token)


def is_foreign_token(token: Column) -> Column:
    """The wider test of error inspection: not digits only, not shaped like a syllable."""
    return ~token.rlike(r"^\p{Nd}+$") & ~is_vietnamese_shaped(token)


def once(n: Column, test: Column) -> Column:
    """The test of a group's key, tied to the group's count n: a test of the key alone would be moved below the
    aggregate, where it runs for each row rather than once for each distinct key."""
    return F.when(n > 0, test)


def bare(token: Column) -> Column:
    """The token without marks at its edges, in lower case."""
    return F.lower(F.btrim(token, F.lit(EDGE_MARKS)))


def mark_count(text: Column) -> Column:
    """How many of the counted punctuation marks the text holds."""
    return F.length(text) - F.length(F.translate(text, COUNTED_MARKS, ""))


def has_digit(token: Column) -> Column:
    return token.rlike(r"\p{Nd}")


def digit_groups(text: Column) -> Column:
    """Maximal runs of decimal digits, of any script, in order."""
    return F.regexp_extract_all(text, F.lit(r"(\p{Nd}+)"), F.lit(1))


def labels(text: Column) -> Column:
    """Bracketed labels in order, brackets included."""
    return F.regexp_extract_all(text, F.lit(f"({LABEL})"), F.lit(1))


def is_label(text: Column) -> Column:
    """The whole text, less white space around it, is one bracketed label."""
    return strip(text).rlike(f"^{LABEL}\\z")


def review_form(text: Column) -> Column:
    """Lower case without bracketed labels, white space squeezed."""
    return squeeze(F.regexp_replace(F.lower(text), LABEL, " "))


def parent_id(segment_id: Column) -> Column:
    """seg_0001_2 -> seg_0001; other ids as they are."""
    found = F.regexp_extract(segment_id, r"^(seg_\d{4})(?:_\d+)?$", 1)
    return F.when(found != "", found).otherwise(segment_id)


def chunk_number(segment_id: Column) -> Column:
    """seg_0001_2 -> 2; 0 without a chunk."""
    return F.coalesce(F.nullif(F.regexp_extract(segment_id, r"^seg_\d{4}_(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _apart(r: Column, h: Column) -> Column:
    """Both lists, as a struct (r, h), without what is equal at their beginning and at their end: no distance needs it."""
    def differs(p: Column) -> Column:
        found = F.array_position(F.zip_with(p["r"], p["h"], lambda a, b: a.eqNullSafe(b)), False).cast("int")
        return F.struct(p["r"].alias("r"), p["h"].alias("h"), F.when(found > 0, found).otherwise(F.size(p["r"]) + 1).alias("first"))

    def turned(p: Column) -> Column:
        rest = lambda side: F.reverse(F.slice(p[side], p["first"], F.greatest(F.size(p[side]) - p["first"] + 1, F.lit(0))))
        return F.struct(*[rest(side).alias(side) for side in ("r", "h")])

    both = F.array(F.struct(r.alias("r"), h.alias("h")))
    for _ in range(2):  # the beginning, then what was the end
        both = F.transform(F.transform(both, differs), turned)
    return F.get(both, F.lit(0))


def char_edits(ref: Column, hyp: Column) -> Column:
    """Edit distance over code points; equal texts skip the table.

    So do texts with as many words that differ in one word, or whose words' own distances add up to the difference of
    lengths: an alignment word by word takes as many edits as their sum, and none takes fewer than lengths differ. Of others, the
    table is that of what lies between their common words at both ends.
    """
    spaced = lambda words: F.when(F.size(words) > 0, F.concat(F.array_join(words, " "), F.lit(" "))).otherwise("")

    def table(p: Column) -> Column:
        return F.get(F.transform(F.array(_apart(p["r"], p["h"])), lambda q: F.levenshtein(spaced(q["r"]), spaced(q["h"]))), F.lit(0))

    def by_words(p: Column) -> Column:
        step = lambda a, b: F.when(a == b, 0).otherwise(F.levenshtein(a, b))
        start = F.struct(F.lit(0).alias("edits"), F.lit(0).alias("words"))
        added = F.aggregate(F.zip_with(p["r"], p["h"], step), start, lambda acc, n: F.struct((acc["edits"] + n).alias("edits"), (acc["words"] + F.when(n > 0, 1).otherwise(0)).alias("words")))
        told = F.transform(F.array(added), lambda a: F.when((a["words"] == 1) | (a["edits"] == F.abs(F.length(ref) - F.length(hyp))), a["edits"]))
        return F.coalesce(F.when(F.size(p["r"]) == F.size(p["h"]), F.get(told, F.lit(0))), table(p))

    words = F.array(F.struct(F.split(ref, " ").alias("r"), F.split(hyp, " ").alias("h")))
    return F.when(ref == hyp, 0).when(ref.isNotNull() & hyp.isNotNull(), F.get(F.transform(words, by_words), F.lit(0))).cast("long")


#: Words of a pair with one UTF-16 unit each, from 0x4E00 up to the surrogates; further ones take a surrogate pair.
UNIT_WORDS = 0xD800 - 0x4E00
#: Distinct words that a pair of texts can hold: one code point each.
MAX_PAIR_WORDS = UNIT_WORDS + (1 << 20)


def word_edits(ref: Column, hyp: Column) -> Column:
    """Edit distance over words: every distinct word of the pair becomes one code point, and the
    built-in distance compares those.

    Words that both have at their beginning and end are left out of it. Where as many words are left, and none of the
    places that differ has a word that the other side has at such a place, each of them is one edit, and none less can do.
    """
    vocabulary = lambda r, h: F.array_distinct(F.concat(r, h))

    def coded(words: Column, known: Column) -> Column:
        above = lambda n: n - (UNIT_WORDS + 1)
        units = lambda n: F.when(n <= UNIT_WORDS, n + (0x4E00 - 1)).otherwise(F.lit(0xD800DC00) + F.shiftright(above(n), 10) * 0x10000 + above(n).bitwiseAND(0x3FF))
        places = F.transform(words, lambda w: F.array_position(known, w).cast("long"))
        return F.decode(F.unhex(F.array_join(F.transform(places, lambda n: F.hex(units(n))), "")), "UTF-16BE")

    def distance(p: Column) -> Column:
        known = F.when(F.size(p["v"]) > MAX_PAIR_WORDS, F.raise_error(F.lit("too many distinct words in one pair")).cast("array<string>")).otherwise(p["v"])
        return F.levenshtein(coded(p["r"], known), coded(p["h"], known))

    def replaced(p: Column) -> Column:
        other = F.filter(F.zip_with(p["r"], p["h"], lambda a, b: F.when(a != b, F.struct(a.alias("a"), b.alias("b")))), lambda w: w.isNotNull())
        told = F.transform(F.array(other), lambda o: F.when(~F.arrays_overlap(F.transform(o, lambda w: w["a"]), F.transform(o, lambda w: w["b"])), F.size(o)))
        return F.when(F.size(p["r"]) == F.size(p["h"]), F.get(told, F.lit(0)))

    def table(p: Column) -> Column:
        return F.get(F.transform(F.array(F.struct(p["r"].alias("r"), p["h"].alias("h"), vocabulary(p["r"], p["h"]).alias("v"))), distance), F.lit(0))

    words = F.transform(F.array(F.struct(tokens(ref).alias("r"), tokens(hyp).alias("h"))), lambda p: _apart(p["r"], p["h"]))
    return F.when(ref == hyp, 0).when(ref.isNotNull() & hyp.isNotNull(), F.get(F.transform(words, lambda p: F.coalesce(replaced(p), table(p))), F.lit(0))).cast("long")


def speech_rate(text: Column, seconds: Column) -> Column:
    """Characters a second; infinite without a duration, null where it is unknown."""
    return F.when(seconds > 0, F.length(text) / seconds).when(seconds.isNotNull(), F.lit(float("inf")))
