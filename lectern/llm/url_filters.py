"""URL filters: host and path rules first, then a weighted vocabulary counted by Aho-Corasick.

A vocabulary term counts where no ASCII letter or digit stands beside it. One strict term
rejects a url, and so do several distinct soft terms, however often each occurs.

Defined results: a null url, or one without `://`, has an empty host and path and no rule
fits it; its terms still count; rows that repeat give equal rows; other columns pass
through, but for those with a result column's name.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms that reject alone, and terms of which SOFT_HITS distinct ones reject.
STRICT = tuple(
    "adult blackjack camgirl camgirls casino cialis darkweb escort escorts fetish hentai hookup keygen malware milf nude nudes onlinecasino payday phishing "
    "porn porno pornstar ransomware roulette sexcam sexchat sportsbook spam striptease viagra warez webcamsex xxx xxxvideo".split()
)
SOFT = tuple(
    "ads affiliate auction bet bets betting bingo bitcoin bonus bonuses buy cash cheap click coupon coupons crack cracked credit crypto deal deals dating "
    "diet discount download earn forex free freebie gamble gambling gift giveaway jackpot keto loan loans lottery lotto money offer offers pharmacy pills poker "
    "prize promo promotion replica rich sale sales serial sexy singles slot slots supplement supplements torrent torrents track tracker traffic unlimited win winner".split()
)
SOFT_HITS = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_ALNUM = frozenset(LOWER + "0123456789")


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for term in terms:
            out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def hits(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Distinct strict and soft terms in the url."""
    if not url:
        return 0, 0
    url = url.translate(_ASCII_LOWER)
    found: tuple[set[str], set[str]] = (set(), set())
    for end, (term, weight) in automaton(strict, soft).iter(url):
        begin = end - len(term)
        if (begin < 0 or url[begin] not in _ALNUM) and (end + 1 == len(url) or url[end + 1] not in _ALNUM):
            found[weight].add(term)
    return len(found[1]), len(found[0])


def _hits_column(strict: tuple[str, ...], soft: tuple[str, ...]):
    @F.pandas_udf("strict long, soft long")
    def count(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(u, strict, soft) for u in urls], columns=["strict", "soft"], dtype="int64")

    return count


def fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, name, prefix = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(prefix)


def url_filters(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, strict_hits, soft_hits."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    plain = pages.select(*[quoted(c) for c in pages.columns if c not in RESULT])
    url = F.coalesce(quoted(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_lx_url, instr(_lx_url, '://') + 3)")).otherwise(F.lit(""))
    out = plain.withColumn("_lx_url", url).withColumn("_lx_rest", rest)
    out = out.withColumn("host", F.translate(F.regexp_extract("_lx_rest", "^([^/?#]*)", 1), UPPER, LOWER)).withColumn("path", F.regexp_extract("_lx_rest", "^[^/?#]*([^?#]*)", 1))
    # at one url, fitting rules are told apart by how much of it they name
    rule = verdict = None
    for r in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        case = fits(r, F.col("host"), F.col("path"))
        rule = F.when(case, r[1] + r[2]) if rule is None else rule.when(case, r[1] + r[2])
        verdict = F.when(case, r[0]) if verdict is None else verdict.when(case, r[0])
    out = out.withColumn("_lx_hits", _hits_column(tuple(strict), tuple(soft))("_lx_url"))
    own = F.when((F.col("_lx_hits.strict") > 0) | (F.col("_lx_hits.soft") >= soft_hits), "block").otherwise("allow")
    none = F.lit(None).cast("string")
    return out.select(*[quoted(c) for c in plain.columns], "host", "path", (none if rule is None else rule).alias("rule"), (own if verdict is None else verdict.otherwise(own)).alias("verdict"), F.col("_lx_hits.strict").alias("strict_hits"), F.col("_lx_hits.soft").alias("soft_hits"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filters(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def _sql_hits(terms) -> str:
    return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::bigint" for t in terms)


def _sql_fits(r) -> str:
    return f"(host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}')"


_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
ORACLE = f"""
with a as (select page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as u, coalesce(url, '') as o from pages),
b as (select page_id, u, case when strpos(o, '://') > 0 then substr(o, strpos(o, '://') + 3) else '' end as rest from a),
c as (select page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from b),
d as (select *, {_sql_hits(STRICT)} as strict_hits, {_sql_hits(SOFT)} as soft_hits from c)
select page_id, host, path,
  case {' '.join(f"when {_sql_fits(r)} then '{r[1]}{r[2]}'" for r in _ORDERED)} end as rule,
  case {' '.join(f"when {_sql_fits(r)} then '{r[0]}'" for r in _ORDERED)}
    when strict_hits > 0 or soft_hits >= {SOFT_HITS} then 'block' else 'allow' end as verdict,
  strict_hits, soft_hits
from d
"""
