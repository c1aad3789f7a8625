"""Quality rules: a threshold table compiled into one projection of built-in functions.

Measures are Catalyst expressions over one text; a rule bounds one measure from below or
above. `compiled` turns a table of rules into a single column, so the whole verdict runs
inside one scan without a shuffle and without user functions. Shared parts are bound as
lambda variables, so that a filter on the verdict, pushed into the scan, stays one pass.

Words are `[^\\x20\\x09-\\x0D]+`. A text fails the base with fewer than 10 words, or when
more than 20 % of its words lie in 5-word windows that the text holds twice or more.

Defined results: null and empty texts have no words, so they fail the base; ratios over no
words or lines are null, and a null measure breaks no rule; rows that repeat give equal
rows; other columns pass through, but for those with a result column's name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.layout import spread

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: Frequent function words of the corpus's languages.
STOP_WORDS = (
    "the of and to in is that it for as was with be by on not he this are or at from an which a "
    "le la les des du de et un une que qui dans pour sur par est pas au aux en "
    "der die das und den dem ein eine nicht mit sich auf ist im zu von für "
    "el los las y del por con para se no una es su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A text is rejected when the measure lies below low or above high."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measure -> SQL over the counts c of one text.
MEASURES = {
    "words": "c.n_words",
    "mean_word_chars": "c.word_chars / nullif(c.n_words, 0)",
    "symbols_per_word": "c.n_symbols / nullif(c.n_words, 0)",
    "exclamations_per_word": "c.bangs / nullif(c.n_words, 0)",
    # one more than there are: a short text can lack them by chance
    "stop_word_ratio": "(c.stops + 1) / nullif(c.n_words, 0)",
    "duplicate_line_ratio": "c.n_dup_lines / nullif(c.lines, 0)",
    "ellipsis_line_ratio": "c.ellipses / nullif(c.lines, 0)",
    "bullet_line_ratio": "c.bullets / nullif(c.lines, 0)",
}

RULES = (
    Rule("too few words", "words", low=10),
    Rule("short words", "mean_word_chars", low=2),
    Rule("long words", "mean_word_chars", high=20),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("exclamations", "exclamations_per_word", high=0.5),
    Rule("no function words", "stop_word_ratio", low=0.02),
    Rule("repeated lines", "duplicate_line_ratio", high=0.5),
    Rule("cut lines", "ellipsis_line_ratio", high=0.5),
    Rule("lists only", "bullet_line_ratio", high=0.9),
)

RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules")

_SPACE = "[\\\\x20\\\\x09-\\\\x0D]"
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


def let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Words under windows that occur twice or more: windows sorted by hash stand beside their like;
#: the starts of those with a like cover WINDOW words each, less what the next start covers.
_SORTED = "sort_array(transform(windows, (w, i) -> named_struct('w', w, 'i', i)))"
_STARTS = "sort_array(transform(filter(s, (p, j) -> p.w = get(s, j - 1).w or p.w = get(s, j + 1).w), p -> p.i))"
_COVERED = f"aggregate(transform(a, (p, j) -> least({WINDOW}, coalesce(get(a, j + 1) - p, {WINDOW}))), 0L, (t, x) -> t + x)"
_REPEATS = f"case when size(array_distinct(windows)) = size(windows) then 0L else {let('s', _SORTED, let('a', _STARTS, _COVERED))} end"
_WINDOWS = f"case when size(hashes) < {WINDOW} then cast(array() as array<bigint>) else transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({', '.join(f'get(hashes, i + {j})' for j in range(WINDOW))})) end"
_COUNTS = f"""named_struct(
  'n_words', cast(size(words) as long),
  'word_chars', cast(length(array_join(words, '')) as long),
  'n_symbols', cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) as long),
  'n_dup_lines', cast(size(rows) - size(array_distinct(rows)) as long),
  'n_repeat_words', {let('hashes', 'transform(words, w -> xxhash64(w))', let('windows', _WINDOWS, _REPEATS))},
  'lines', size(rows),
  'bangs', length(t) - length(replace(t, '!', '')),
  'stops', size(filter(words, w -> w in ({_STOPS}))),
  'ellipses', size(filter(rows, l -> rtrim(l) like '%...' or rtrim(l) like '%…')),
  'bullets', size(filter(rows, l -> ltrim(l) like '- %' or ltrim(l) like '* %' or ltrim(l) like '•%')))"""


def compiled(rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> Column:
    """The whole judgement as one expression: a struct of the counts, broken_rules, base_failed and kept."""
    broken = []
    for rule in rules:
        value = f"({MEASURES[rule.measure]})"
        sides = [f"{value} < {rule.low}"] * (rule.low is not None) + [f"{value} > {rule.high}"] * (rule.high is not None)
        broken.append(f"case when {' or '.join(sides)} then '{rule.name}' end")
    failed = f"(c.n_words < {MIN_WORDS} or 100 * c.n_repeat_words > {MAX_REPEAT_PERCENT} * c.n_words)"
    names = ", ".join(f"'{n}', c.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    verdict = let("b", f"filter(array({', '.join(broken) or 'cast(null as string)'}), r -> r is not null)", f"named_struct({names}, 'base_failed', {failed}, 'kept', not {failed} and size(b) = 0, 'broken_rules', b)")
    words = f"filter(split(t, '{_SPACE}+'), w -> w <> '')"
    rows = "filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    text = "`" + text_col.replace("`", "``") + "`"
    return F.expr(let("t", f"coalesce(cast({text} as string), '')", let("words", words, let("rows", rows, let("c", _COUNTS, verdict)))))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with the counts, base_failed, kept, and the names of broken rules."""
    plain = docs.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns if c not in RESULT])
    judged = plain.withColumn("_lx_verdict", compiled(rules, text_col))
    return judged.select(*["`" + c.replace("`", "``") + "`" for c in plain.columns], "_lx_verdict.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_SPACE = "[\\x20\\x09-\\x0D]"
_SQL_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as ls from t),
g as (select doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) as gram from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p from r) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
        len(ls) as lines, length(regexp_replace(t, '[^!]', '', 'g')) as bangs,
        len(list_filter(ws, lambda x: x in ({_SQL_STOPS}))) as stops,
        len(list_filter(ls, lambda l: rtrim(l, ' ') like '%...' or rtrim(l, ' ') like '%…')) as ellipses,
        len(list_filter(ls, lambda l: ltrim(l, ' ') like '- %' or ltrim(l, ' ') like '* %' or ltrim(l, ' ') like '•%')) as bullets
      from w left join c using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (n_words < 10
    or word_chars < 2 * n_words or word_chars > 20 * n_words or n_symbols > 0.3 * n_words
    or bangs > 0.5 * n_words or stops + 1 < 0.02 * n_words or n_dup_lines > 0.5 * lines
    or ellipses > 0.5 * lines or bullets > 0.9 * lines) as kept
from b
"""
