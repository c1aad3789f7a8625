"""Corpus-level error rates, retention and error inspection.

A scored frame has one row for each segment: slice columns, `ord` (the order that lists
would have), `ref`, `hyp`. Rates are sums over sums, never means of row rates.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.operators.places import any_larger, in_order, same

#: Rows up to which a slice is sorted as a whole.
WHOLE = 1 << 16
#: Sums of tokens that a task holds before it hands them on: some 30 MB of Python.
HELD = 1 << 18
COUNTS = ("char_edits", "char_ref_len", "word_edits", "word_ref_len")


def counted(pairs: DataFrame, words: bool = True) -> DataFrame:
    """pairs with their edit and length counts."""
    out = pairs.withColumns({"char_edits": tx.char_edits(F.col("ref"), F.col("hyp")), "char_ref_len": F.length("ref").cast("long")})
    if words:
        out = out.withColumns({"word_edits": tx.word_edits(F.col("ref"), F.col("hyp")), "word_ref_len": F.size(tx.tokens(F.col("ref"))).cast("long")})
    return out


def rate(edits: str, length: str, strict: bool = False) -> Column:
    """Sum over sum; null without any length, or an error if strict."""
    total = F.sum(length)
    checked = F.when(total > 0, F.sum(edits) / total)
    return checked.otherwise(F.raise_error(F.lit("no reference length"))) if strict else checked


def score_by(frame: DataFrame, *keys: str, words: bool = True) -> DataFrame:
    """cer, wer, n_segments, char_edits and char_ref_len of each slice, or of all rows without keys."""
    aggregates = [F.count("*").alias("n_segments"), F.sum("char_edits").alias("char_edits"), F.sum("char_ref_len").alias("char_ref_len"), rate("char_edits", "char_ref_len").alias("cer")]
    if words:
        aggregates.append(rate("word_edits", "word_ref_len").alias("wer"))
    return frame.groupBy(*keys).agg(*aggregates)


def with_source(predictions: DataFrame, meetings: DataFrame) -> DataFrame:
    """predictions with their meeting's source, the last one listed; a meeting without one is an error."""
    dim = meetings.groupBy("meeting_id").agg(F.max_by("source", "ord").alias("source"))
    joined = predictions.join(dim, "meeting_id", "left")
    return joined.withColumn("source", F.when(F.col("source").isNull(), F.raise_error(F.concat(F.lit("no source for meeting "), F.coalesce("meeting_id", F.lit("null")))).cast("string")).otherwise(F.col("source")))


def rejoin_chunks(predictions: DataFrame) -> DataFrame:
    """Chunks of one parent segment joined by single spaces, by chunk number and then order."""
    keyed = predictions.select("meeting_id", tx.parent_id(F.col("segment_id")).alias("segment_id"), F.struct(tx.chunk_number(F.col("segment_id")).alias("chunk"), "ord", "ref", "hyp").alias("piece"))
    grouped = keyed.groupBy("meeting_id", "segment_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    joined = lambda side: F.array_join(F.transform("pieces", lambda p: p[side]), " ").alias(side)
    return grouped.select("meeting_id", "segment_id", F.get("pieces", F.lit(0))["ord"].alias("ord"), joined("ref"), joined("hyp"))


def token_counts(frame: DataFrame, text: str, keys: list[str], keep=None) -> DataFrame:
    """(keys, token, n): how often each token of the text column occurs under the keys."""
    out = frame.select(*keys, F.explode(tx.tokens(F.col(text))).alias("token"))
    return (out.where(keep(F.col("token"))) if keep else out).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def _lacking(words: list[str], others: list[str]) -> Counter:
    """How often others has a word less often; what both have at one place cancels out first."""
    if len(words) == len(others):
        apart = [(a, b) for a, b in zip(words, others, strict=True) if a != b]
        words, others = [a for a, _ in apart], [b for _, b in apart]
    return Counter(words) - Counter(others)


def _tokens_schema(key_schema: list[T.StructField], places: bool) -> T.StructType:
    fields = [*key_schema, T.StructField("token", T.StringType()), T.StructField("wanted", T.LongType()), T.StructField("retained", T.LongType())]
    return T.StructType([*fields, T.StructField("place", T.IntegerType())] if places else fields)


def _kept(keys: list[str], key_schema: list[T.StructField], lost: bool):
    """What `retained_tokens` does with a task's batches of (keys, ref, hyp), and its schema."""
    schema = _tokens_schema(key_schema, True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("_ref").to_pylist(), batch.column("_hyp").to_pylist(), strict=True)
            row, token, wanted, retained, place = [], [], [], [], []
            for i, (ref, hyp) in enumerate(sides):
                if ref is None or hyp is None or lost and ref == hyp:
                    continue
                words = ref.split()
                own = Counter(words)
                gone = _lacking(words, hyp.split()) if ref != hyp else ()
                if lost:
                    own = {t: own[t] for t in gone}
                at = dict(zip(reversed(words), range(len(words) - 1, -1, -1), strict=True))  # of equal tokens the first one stays
                row += [i] * len(own)
                token += own
                wanted += own.values()
                retained += [n - gone[t] for t, n in own.items()] if gone else own.values()
                place += [at[t] for t in own]
            out = [batch.column(k).take(pa.array(row, pa.int64())) for k in keys]
            out += [pa.array(token, pa.string()), pa.array(wanted, pa.int64()), pa.array(retained, pa.int64()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows, schema


def _summed(keys: list[str], key_schema: list[T.StructField]):
    """What `retained_sums` does with a task's batches of (keys, ref, hyp, same), and its schema. Sums are held until they are HELD."""
    schema = _tokens_schema(key_schema, False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, Counter] = {}  # by key: how often ref has a token
        short: dict[tuple, Counter] = {}  # and how often hyp lacks it

        def summed(kinds: list[pa.DataType]) -> pa.RecordBatch:
            sizes = [len(own) for own in totals.values()]
            parts = [pa.array(list(totals), pa.struct([(k, kind) for k, kind in zip(keys, kinds, strict=True)])).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))] if keys else []
            token, wanted, retained = [], [], []
            for key, own in totals.items():
                gone = short.get(key)
                token += own
                wanted += own.values()
                retained += [n - gone[t] for t, n in own.items()] if gone else own.values()
            out = [column for part in parts for column in part.flatten()]
            out += [pa.array(token, pa.string()), pa.array(wanted, pa.int64()), pa.array(retained, pa.int64())]
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        for batch in batches:
            of = zip(*[batch.column(k).to_pylist() for k in keys], strict=True) if keys else repeat((), batch.num_rows)
            texts: dict[tuple, list[str]] = {}
            for key, ref, hyp, same in zip(of, *[batch.column(c).to_pylist() for c in ("_ref", "_hyp", "_same")], strict=True):
                if not same and (ref is None or hyp is None):
                    continue
                if key in texts:
                    texts[key].append(ref)
                else:
                    texts[key] = [ref]
                if not same:
                    short.setdefault(key, Counter()).update(_lacking(ref.split(), hyp.split()))
            for key, own in texts.items():
                totals.setdefault(key, Counter()).update(" ".join(own).split())
            kinds = [batch.column(k).type for k in keys]
            if sum(map(len, totals.values())) >= HELD:
                yield summed(kinds)
                totals.clear()
                short.clear()
        if totals:
            yield summed(kinds)

    return rows, schema


def retained_tokens(frame: DataFrame, keys: list[str], lost: bool = False) -> DataFrame:
    """(keys, token, wanted, retained, place): the tokens of ref, how often each row's ref has them, how many of those its
    hyp has too, and where ref has it first. Each row is judged by itself: nothing is shuffled. Whether a token is a
    loanword is left to `retention_by` and `missing_tokens`, which ask once for each distinct token. lost: only tokens
    that hyp has less often."""
    sides = frame.select(*keys, F.col("ref").alias("_ref"), F.col("hyp").alias("_hyp"))
    return sides.mapInArrow(*_kept(keys, [sides.schema[k] for k in keys], lost))


def retained_sums(frame: DataFrame, slices: list[str]) -> DataFrame:
    """(slices, token, wanted, retained): `retained_tokens` without places, added up by slice over a task's batches, up to
    some HELD sums at once. Several tasks may have rows of the same token. Where hyp is ref, it isn't sent to Python."""
    same = F.col("ref").eqNullSafe(F.col("hyp")) & F.col("ref").isNotNull()
    sides = frame.select(*slices, F.col("ref").alias("_ref"), F.when(~same, F.col("hyp")).alias("_hyp"), same.alias("_same"))
    return sides.mapInArrow(*_summed(slices, [sides.schema[k] for k in slices]))


def retention_by(tokens: DataFrame, *slices: str) -> DataFrame:
    """retention, n_candidates and n_retained of each slice of `retained_tokens`, over loanwords; slices without any are left out. tokens may
    as well be `retained_sums` of these slices."""
    counted = tokens.groupBy(*slices, "token").agg(F.sum("wanted").alias("wanted"), F.sum("retained").alias("retained")).where(tx.once(F.col("wanted"), tx.is_loanword(F.col("token"))))
    return counted.groupBy(*slices).agg(F.sum("wanted").alias("n_candidates"), F.sum("retained").alias("n_retained")).withColumn("retention", F.when(F.col("n_candidates") > 0, F.col("n_retained") / F.col("n_candidates")))


def missing_tokens(tokens: DataFrame, top: int | None = None, order: str = "ord") -> DataFrame:
    """(token, missing): loanwords that were lost, most often lost first, of equals the one that was lost first by
    segment and place. tokens: rows of `retained_tokens` with the segments' order among its keys."""
    first = F.min(F.struct(F.col(order).alias("o"), F.col("place").alias("p"))).alias("first")
    lost = tokens.where("wanted > retained").groupBy("token").agg(F.sum(F.col("wanted") - F.col("retained")).alias("missing"), first).where(tx.once(F.col("missing"), tx.is_loanword(F.col("token"))))
    out = lost.orderBy(F.desc("missing"), "first.o", "first.p").limit(top) if top else lost
    return out.drop("first")


def paired(base: DataFrame, candidate: DataFrame, *slices: str, by: str | None = None) -> DataFrame:
    """(slices, pos, base, candidate): rows of either side by position in their slice, where both have as many.

    A slice of more than WHOLE rows is not sorted in one task: its rows get places by ranges. With `by`, a key that both sides share, rows meet on it and no slice has to be sorted as a whole. A slice drops
    out if any key of it is on one side only or repeats.
    """
    counts = F.struct("char_edits", "char_ref_len")
    if by is not None:
        none = F.lit(None).cast("struct<char_edits: bigint, char_ref_len: bigint>")
        keys = [*slices, "pos"]
        key = [*slices, F.col(by).alias("pos")]
        rows = base.select(*key, counts.cast("struct<char_edits: bigint, char_ref_len: bigint>").alias("base"), none.alias("candidate"))
        rows = rows.union(candidate.select(*key, none.alias("base"), counts.cast("struct<char_edits: bigint, char_ref_len: bigint>").alias("candidate")))
        met = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("base", "candidate")], *[F.count(c).alias(f"n_{c}") for c in ("base", "candidate")])
        odd = met.where("n_base <> 1 or n_candidate <> 1").select(*(slices or [F.lit(1).alias("_all")])).distinct()
        met = met.drop("n_base", "n_candidate")
        return met.join(odd, list(slices), "left_anti") if slices else met.withColumn("_all", F.lit(1)).join(odd, "_all", "left_anti").drop("_all")
    tied = ["ord", "char_edits", "char_ref_len"]  # rows of one place in the order of their counts, as in the bootstrap
    if any_larger(base, slices, WHOLE) or any_larger(candidate, slices, WHOLE):
        far = lambda frame, name: in_order(frame.select(*slices, *tied, counts.alias(name)), slices, tied, "pos", f"n_{name}").drop(*tied)
        left, right = far(base, "base").alias("l"), far(candidate, "candidate").alias("r")
        met = left.join(right, same([*slices, "pos"])).where("n_base = n_candidate")
        return met.select(*[F.col(f"l.`{c}`") for c in (*slices, "pos")], "base", "candidate")
    place = Window.partitionBy(*slices).orderBy(*tied)
    all_of = Window.partitionBy(*slices)
    side = lambda frame, name: frame.select(*slices, (F.row_number().over(place) - 1).alias("pos"), F.count("*").over(all_of).alias(f"n_{name}"), counts.alias(name))
    return side(base, "base").join(side(candidate, "candidate"), [*slices, "pos"]).where("n_base = n_candidate").drop("n_base", "n_candidate")


def regression_check(candidate: DataFrame, production: DataFrame) -> DataFrame:
    """One row: segments that both scored, their rates, and whether the candidate is no worse.

    Fails when none is shared or a shared segment's reference differs.
    """
    keys = ["meeting_id", "segment_id"]
    # the text itself need not cross the network to be compared
    last = lambda f, side: f.groupBy(*keys).agg(F.max_by(F.struct(F.md5(F.col("ref").cast("binary")).alias("ref"), "char_edits", "char_ref_len"), "ord").alias(side))
    shared = last(candidate, "c").join(last(production, "p"), keys)
    total = shared.agg(
        F.count("*").alias("n_shared"), F.count_if(F.col("c.ref") != F.col("p.ref")).alias("n_other_ref"),
        F.sum("c.char_edits").alias("ce"), F.sum("c.char_ref_len").alias("cl"), F.sum("p.char_edits").alias("pe"), F.sum("p.char_ref_len").alias("pl"),
    )
    checked = F.when(F.col("n_shared") == 0, F.raise_error(F.lit("no shared segments")).cast("double")).when(F.col("n_other_ref") > 0, F.raise_error(F.lit("references differ")).cast("double"))
    return total.select("n_shared", checked.otherwise(F.col("ce") / F.col("cl")).alias("candidate_cer"), (F.col("pe") / F.col("pl")).alias("production_cer"), (F.col("ce") * F.col("pl") <= F.col("pe") * F.col("cl")).alias("no_regression"))


def ranked_by_edits(frame: DataFrame, top: int | None = None) -> DataFrame:
    """Segments with the most edited characters first, ties in order."""
    out = frame.orderBy(F.desc("char_edits"), "ord")
    return out.limit(top) if top else out


def top_segment_share(frame: DataFrame) -> DataFrame:
    """(segment, edits, share): the segment with the most edits, the first of several, and its share of all, 0 if there are none."""
    first = F.max_by(F.struct("ord", "char_edits"), F.struct(F.col("char_edits"), -F.col("ord"))).alias("top")
    return frame.agg(first, F.sum("char_edits").alias("all_edits")).select(F.col("top.ord").alias("ord"), F.col("top.char_edits").alias("edits"), F.when(F.col("all_edits") > 0, F.col("top.char_edits") / F.col("all_edits")).otherwise(0.0).alias("share"))


def loanword_dropped(frame: DataFrame) -> DataFrame:
    """Segments with foreign tokens in ref, with whether any of them is missing from hyp. Only tokens that hyp lacks
    are judged there, and each test ends with its first hit."""
    # bound once as a lambda variable: a column of tokens would be computed anew inside each use
    both = F.array(F.struct(tx.tokens(F.col("ref")).alias("ref"), tx.tokens(F.col("hyp")).alias("hyp")))
    lost = lambda p: F.exists(F.array_except(p["ref"], p["hyp"]), tx.is_foreign_token)
    dropped = F.get(F.transform(both, lambda p: F.when(lost(p), True).when(F.exists(p["ref"], tx.is_foreign_token), False)), F.lit(0))
    return frame.withColumn("dropped", dropped).where(F.col("dropped").isNotNull())


def digit_mismatch(frame: DataFrame) -> DataFrame:
    """Segments with digits in ref, with whether hyp's digit groups differ."""
    return frame.where(F.size(tx.digit_groups(F.col("ref"))) > 0).withColumn("mismatch", tx.digit_groups(F.col("ref")) != tx.digit_groups(F.col("hyp")))


def length_ratio(frame: DataFrame, *keys: str) -> DataFrame:
    """Characters of hyp over characters of ref, to three places, null without any."""
    return frame.groupBy(*keys).agg(F.round(F.sum(F.length("hyp")) / F.nullif(F.sum(F.length("ref")), F.lit(0)), 3).alias("length_ratio"))


def convention_gap(frame: DataFrame, ref_a: Column, hyp_a: Column, ref_b: Column, hyp_b: Column, *keys: str) -> DataFrame:
    """Rates under two normalisations of the same pairs, and their distance in points, in one scan."""
    edits = lambda r, h: F.sum(tx.char_edits(r, h)) / F.nullif(F.sum(F.length(r)), F.lit(0))
    out = frame.groupBy(*keys).agg(edits(ref_a, hyp_a).alias("cer_a"), edits(ref_b, hyp_b).alias("cer_b"))
    return out.withColumn("delta_pp", F.bround(F.abs(F.col("cer_a") - F.col("cer_b")) * 100, 3))
