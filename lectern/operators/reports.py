"""Decisions and texts over a few result rows, on the driver."""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import distances, scoring, stats
from lectern.operators.checks import IntegrityError
from lectern.operators.places import same

TOLERANCE = 1e-9


def recovered_lambda(scaled_alpha: float, alpha: float) -> float:
    """The weight that an adapter was saved with."""
    return scaled_alpha / alpha


def check_provenance(settings: dict, gate: dict, sweep: Iterable[dict], adapter: dict) -> float:
    """The adapter's weight, if the gate passed, model and rank agree, and the sweep row is the one that the gate scored."""
    weight = recovered_lambda(adapter["lora_alpha"], settings["lora"]["alpha"])
    row = next((r for r in sweep if abs(r["lambda"] - weight) < TOLERANCE), None)
    faults = {
        "the gate did not pass": gate.get("overall_pass") is not True,
        "another base model": adapter["base_model"] != settings["base_model"],
        "another rank": adapter["r"] != settings["lora"]["rank"],
        f"no sweep row for {weight}": row is None,
        "the gate scored another adapter": row is not None and abs(row["ood_cer"] - gate["tier2_ood"]["cer"]) > TOLERANCE,
    }
    if found := [what for what, wrong in faults.items() if wrong]:
        raise IntegrityError("; ".join(found))
    return weight


def rescore_real(candidate: DataFrame, base: DataFrame, bound: float) -> DataFrame:
    """One row from stored prediction chunks alone: cer, its interval, pass, the paired interval and verdict.

    Chunks are rejoined to their parents first; sides with unlike numbers of parents are SKIPPED.
    """
    whole = scoring.counted(scoring.rejoin_chunks(candidate), words=False)
    before = scoring.counted(scoring.rejoin_chunks(base), words=False)
    row = scoring.score_by(whole, words=False).crossJoin(stats.bootstrap_ci(whole))  # one row each
    deltas = stats.bootstrap_delta_ci(scoring.paired(before, whole)).select(F.col("lo").alias("delta_lo"), F.col("hi").alias("delta_hi"))
    out = row.join(deltas, F.lit(True), "left")
    return out.select("n_segments", "cer", "lo", "hi", F.lit(bound).alias("bound"), (F.col("cer") <= bound).alias("pass"), "delta_lo", "delta_hi", F.coalesce(stats.verdict(F.col("delta_lo"), F.col("delta_hi")), F.lit("SKIPPED")).alias("verdict"))


def consensus_cer(a: DataFrame, b: DataFrame, normalizer, *keys: str, tile_side: int = distances.TILE) -> DataFrame:
    """(keys, cer): the rate between two whole transcripts, (keys, ord, text) each, joined in order and normalised; without
    keys one row. Transcripts that one side lacks have no row, an empty reference no rate. Long ones are compared in tiles."""
    whole = lambda f, name: f.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda w: w["text"]), " ").alias(name))
    left, right = whole(a, "ref").alias("l"), whole(b, "hyp").alias("r")  # one row each without keys
    both = left.join(right, same(keys)).select(*[F.col(f"l.`{k}`") for k in keys], normalizer(F.col("ref")).alias("ref"), normalizer(F.col("hyp")).alias("hyp"))
    counts = distances.edits(both, tile_side=tile_side)
    return counts.select(*keys, (F.col("char_edits") / F.nullif(F.length("ref"), F.lit(0))).alias("cer"))


def markdown_table(rows: Iterable[dict], columns: list[str]) -> str:
    """Numbers to four places, missing values as a dash."""
    show = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *(f"| {' | '.join(show(r.get(c)) for c in columns)} |" for r in rows)]) + "\n"


def model_card(name: str, tiers: Iterable[dict], slices: Iterable[dict], settings: dict | None = None, weight: float | None = None, chosen_by: str | None = None, overall: bool | None = None) -> str:
    """The gate's tiers and slices; with settings also what the weights are, with overall the verdict."""
    parts = [f"# {name}\n"]
    if settings is not None:
        lora = settings["lora"]
        facts = {"base model": settings["base_model"], "run": settings["run_id"], "rank": lora["rank"], "alpha": lora["alpha"], "targets": ", ".join(lora.get("target_modules", [])) or None, "weight": weight, "weight chosen by": chosen_by}
        parts.append("".join(f"- {k}: {v}\n" for k, v in facts.items() if v is not None))
    verdict = "" if overall is None else f"\nOverall: **{'PASS' if overall else 'FAIL'}**\n"
    parts.append(f"## Gate\n\n{markdown_table(tiers, ['tier', 'cer', 'bound', 'pass'])}{verdict}")
    parts.append(f"## Slices\n\n{markdown_table(slices, ['source', 'n_segments', 'cer', 'baseline_cer', 'verdict'])}")
    return "\n".join(parts)


#: Measures of a probed draft, as `captions.probe` names them, and how a report words and shows them.
MEASURES = {
    "events": ("events", "{}"), "pieces": ("pieces", "{}"), "timed_pieces": ("pieces with an offset", "{}"),
    "n_words": ("words", "{}"), "multi_token_entries": ("entries of several words", "{}"),
    "lexical_particle_rate": ("particles", "{:.2%}"), "punctuation_per_100_words": ("marks in 100 words", "{:.1f}"),
    "digit_word_rate": ("words with digits", "{:.2%}"), "nonvietnamese_word_rate": ("words of other shape", "{:.2%}"),
    "nonvietnamese_words_per_min": ("words of other shape a minute", "{:.1f}"), "n_labels": ("sound labels", "{}"),
    "first_wpm": ("words a minute, first bucket", "{:.0f}"), "last_wpm": ("words a minute, last bucket", "{:.0f}"),
}


def _decision(row: dict) -> str:
    return "ACCEPT" if row["ok"] else f"REJECT (rule {row['rule']})"


def _section(row: dict) -> str:
    """One recording: its verdict, its tracks, and the measures that it has."""
    lines = [f"## {row.get('title') or row.get('url')}", "", f"- duration: {row['duration'] / 60:.1f} min"]
    lines.append(f"- **{_decision(row)}**" + (f": {row['reason']}" if row.get("reason") else "") + f", track {row.get('track') or 'none'}")
    for name, tracks in (("automatic", row.get("automatic_captions")), ("owner's", row.get("subtitles"))):
        if tracks is not None:
            lines.append(f"- {name} tracks: {', '.join(f'{k} ({tracks[k]})' for k in sorted(tracks)) or 'none'}")
    if row.get("draft_error"):
        lines.append(f"- no draft, so rule 3 and the measures are missing: {row['draft_error']}")
    if row.get("consensus_cer") is not None:
        lines.append(f"- CER against the owner's subtitles: {row['consensus_cer']:.1%}")
    shown = [{"measure": words, "value": form.format(row[c])} for c, (words, form) in MEASURES.items() if row.get(c) is not None]
    if shown:
        lines += ["", markdown_table(shown, ["measure", "value"]).rstrip()]
    for name, of in (("labels", row.get("labels")), ("examples", row.get("examples")), ("words in each try", row.get("attempts")), ("opening", row.get("opening"))):
        if of:
            lines.append(f"- {name}: {of if isinstance(of, str) else ', '.join(map(str, of))}")
    return "\n".join(lines) + "\n"


def probe_report(records: Iterable[dict], failures: Iterable[tuple[str, str]] = ()) -> str:
    """A report on rows of `captions.probe` with titles: how many were accepted, a line for each recording, those that
    could not be probed (name, error), and a section for each of the others. Empty if there is nothing to report."""
    records, failures = list(records), list(failures)
    if not records and not failures:
        return ""
    accepted = sum(r["ok"] for r in records)
    lines = [{"recording": r.get("title") or r.get("url"), "minutes": f"{r['duration'] / 60:.1f}", "verdict": _decision(r), "particles": r.get("lexical_particle_rate"), "first": r.get("first_wpm"), "last": r.get("last_wpm")} for r in records]
    lines += [{"recording": name, "verdict": f"error: {error}"} for name, error in failures]
    head = f"# Captions\n\n{accepted} accepted, {len(records) + len(failures) - accepted} rejected.\n\n{markdown_table(lines, ['recording', 'minutes', 'verdict', 'particles', 'first', 'last'])}"
    return "\n".join([head, *map(_section, records)])


def write_report(text: str, path: str | Path) -> None:
    """An empty report never replaces one that is there."""
    path = Path(path)
    if not text.strip() and path.exists():
        raise IntegrityError(f"nothing to report; {path} stays")
    path.write_text(text, encoding="utf-8")


def replace_json(path: str | Path, value) -> Path:
    """Overwrite a JSON file after copying it beside itself; the first copy is kept. The copy's place is returned."""
    path = Path(path)
    kept = path.with_suffix(path.suffix + ".bak")
    if path.exists() and not kept.exists():
        shutil.copy2(path, kept)
    path.write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
    return kept


def html_page(blocks: DataFrame, title: str) -> str:
    """A review worksheet from `writers.worksheet` rows of one recording."""
    rows = blocks.orderBy("segment_id").collect()  # one recording's segments
    return f"<!doctype html><meta charset='utf-8'><title>{title}</title>\n" + "\n".join(r["html"] for r in rows) + "\n"
