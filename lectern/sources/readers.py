"""Scans. `ord` is the place in file order, `src_file` the file a row came from.

Spark deals files out by size, so order is made explicit: ord is the rank of the row's file
by name, then its split's offset plus its place in its task, which the scan knows itself:
nothing is counted, sorted or shuffled. ord grows with the place, but has gaps;
`in_place_order` closes them by a second pass.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.places import placed
from lectern.sources import quoted, schemas
from lectern.sources.layout import input_bytes


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files that the pattern names, sorted; Spark's own file systems do the listing."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


#: Bits of ord for the place in a file, which is below the file's bytes; the others hold 8 million files.
PLACE_BITS = 40


#: Splits of a scan up to which their counts, some 40 bytes each, are sent to all tasks.
FEW_SPLITS = 1 << 20


def _located(rows: DataFrame) -> DataFrame:
    """A scan with its rows' file (_rank by name, src_file), split (_block) and number in its task (_at).

    A split that is not its file's last fills a task, so that its rows, each of a byte at least, count from 0 and stay
    below the offset of the next split; after a file's last split nothing of that file follows. Where Spark is told to
    pack splits into fewer tasks, this doesn't hold, and the scan is refused.
    """
    if rows.sparkSession.conf.get("spark.sql.files.maxPartitionNum", None):
        raise ValueError("spark.sql.files.maxPartitionNum packs splits into tasks, which hides the order of rows")
    files = sorted(re.sub("^([a-z0-9]+):/+", r"\1:/", f) for f in rows.inputFiles())
    # a local relation, so that its size is known where the join is planned
    ranks = rows.sparkSession.createDataFrame(pa.table({"_path": pa.array(files, pa.string()), "_rank": pa.array(range(len(files)), pa.int64())}))
    path = F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/")
    scan = rows.withColumns({"_path": path, "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id(), "src_file": F.col("_metadata.file_name")})
    return scan.join(ranks, "_path", "left").withColumn("_rank", F.coalesce("_rank", F.lit(0).cast("long"))).drop("_path")


def in_file_order(rows: DataFrame) -> DataFrame:
    """A scan with ord and src_file; ord grows with the place but has gaps, and needs no second pass."""
    in_task = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return _located(rows).withColumn("ord", F.shiftleft("_rank", PLACE_BITS) + F.col("_block") + in_task).drop("_rank", "_block", "_at")


def few_splits(rows: DataFrame) -> bool:
    """Whether a scan has so few splits that a row for each can be sent to all tasks."""
    spark = rows.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return input_bytes(rows) // max(split, 1) + len(rows.inputFiles()) <= FEW_SPLITS


def in_place_order(rows: DataFrame, place: str = "place") -> DataFrame:
    """A scan with src_file and each row's place from 0, dense over files by name and rows in them.

    The scan runs twice: its splits are counted, and prefix sums over the counts give each split's first place. No row
    is sorted or shuffled but the splits' counts, one for each (file, split).
    """
    return placed(_located(rows), "_at", ["_rank", "_block"], place=place, small=few_splits(rows)).drop("_rank", "_block", "_at")


def read_manifests(spark: SparkSession, folder: str, pattern: str = "manifest.*.jsonl", schema: str = schemas.SEGMENT) -> DataFrame:
    """All manifests of a folder in name order; blank lines are passed over, no file is an error."""
    files = _paths(spark, f"{folder}/{pattern}")
    if not files:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    rows = spark.read.schema(schema).json(files)
    return in_file_order(rows)


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.SEGMENT) -> DataFrame:
    return in_file_order(spark.read.schema(schema).json(path))


def read_split(spark: SparkSession, path: str, split: str, schema: str = schemas.SEGMENT) -> DataFrame:
    """One split of a resolved manifest, in its order."""
    return read_jsonl(spark, path, schema).where(F.col("split") == split)


def read_csv(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Header, quoted fields with line breaks, empty cells as null; `strict`: a cell that doesn't parse is an error.
    For sweeps and logs: a file is read by one task. Predictions are read by splits, see `quoted`."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="", mode="FAILFAST" if strict else "PERMISSIVE", enforceSchema=False)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, meeting_id, ref, hyp, ord); empty texts stay empty, not null. Large files are read by many tasks."""
    rows = quoted.read_quoted(spark, path, schemas.PREDICTION, PLACE_BITS)
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("ref", "hyp")}).drop("src_file")


def last_of_key(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, the last in order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("_row")).select(*keys, "_row.*")


def read_rejoined(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with the chunks of a parent segment joined."""
    from lectern.operators.scoring import rejoin_chunks

    return rejoin_chunks(read_predictions(spark, path))


def read_sweep(spark: SparkSession, path: str, percent: bool = False, empty: str = "null") -> DataFrame:
    """Rows of a sweep; slice columns are optional. empty: "null" keeps empty cells as nulls, "error" refuses them."""
    columns = spark.read.csv(path, header=True).columns
    kinds = dict(f.split(" ") for f in schemas.SWEEP.split(", "))
    rows = read_csv(spark, path, ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in columns))
    if empty == "error":
        rows = rows.withColumns({c: F.coalesce(c, F.raise_error(F.lit(f"an empty cell of {c}")).cast("double")) for c in columns})
    return rows.withColumns({c: F.col(c) * 100 for c in columns if c != "lambda"}) if percent else rows


def read_run(spark: SparkSession, run_dir: str) -> tuple[dict, dict, DataFrame]:
    """A run folder's settings, its gate's results and its sweep, where an empty cell is an error."""
    whole = lambda name: json.loads(spark.read.text(f"{run_dir}/{name}", wholetext=True).first()[0])
    return whole("config.json"), whole("metrics/gate_results.json"), read_sweep(spark, f"{run_dir}/metrics/lambda_sweep.csv", empty="error")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Log rows with a loss, learning rate 0 where it is blank; none at all is an error."""
    columns = spark.read.csv(path, header=True).columns
    kinds = dict(f.split(" ") for f in schemas.TRAINING.split(", "))
    rows = read_csv(spark, path, ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in columns)).where("loss is not null")
    if not rows.head(1):
        raise ValueError(f"{path} has no loss rows")
    return rows.withColumn("learning_rate", F.coalesce("learning_rate", F.lit(0.0)))


def training_series(rows: DataFrame, *columns: str) -> DataFrame:
    """(series, step, value): the sparse columns of a log as one long frame."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return rows.selectExpr("step", f"stack({len(columns)}, {pairs}) as (series, value)").where("value is not null").select("series", "step", "value")


def read_trainer_state(spark: SparkSession, run_dir: str, key: str) -> DataFrame:
    """(step, value) of the newest checkpoint's history, newest by number."""
    files = _paths(spark, f"{run_dir}/checkpoint-*/trainer_state.json")
    if not files:
        raise FileNotFoundError(f"no checkpoint in {run_dir}")
    newest = max(files, key=lambda f: int(f.split("/checkpoint-")[1].split("/")[0]))
    state = spark.read.schema(f"log_history array<struct<step: bigint, `{key}`: double>>").json(newest, multiLine=True)
    return state.select(F.explode("log_history").alias("h")).select("h.step", F.col(f"h.`{key}`").alias("value")).where("value is not null")


def read_utterances(spark: SparkSession, path: str, split: str, limit: int | None = None, corpus: str = "utt") -> DataFrame:
    """(segment_id, text, ord) of a parquet corpus with a `sentence` column, named and ordered by place: 0, 1, 2... over
    all files by name. `limit` keeps the first ones."""
    rows = in_place_order(spark.read.parquet(path), "ord")
    rows = rows.where(F.col("ord") < limit) if limit is not None else rows
    return rows.select(F.format_string("%s_%s_%05d", F.lit(corpus), F.lit(split), F.col("ord")).alias("segment_id"), F.col("sentence").alias("text"), "ord")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, text) of `id TEXT` lines, gzip or plain; text in lower case."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.substring_index("value", " ", 1).alias("segment_id"), F.lower(F.trim(F.regexp_replace("value", r"^\S+\s", ""))).alias("text"))


#: What Spark calls a path that is not there, or a file that is not of the format.
UNREADABLE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_TO_READ", "MALFORMED")


def first_route(*routes: Callable[[], DataFrame]) -> DataFrame:
    """The first route whose rows can be read. Only a missing path or another format leads on to the next one; any other
    fault, and the last route's, is raised."""
    for i, route in enumerate(routes):
        try:
            found = route()
            found.head(1)
            return found
        except (FileNotFoundError, PySparkException) as e:
            known = isinstance(e, FileNotFoundError) or any(u in f"{e.getCondition() or ''} {e}" for u in UNREADABLE)
            if not known or i == len(routes) - 1:
                raise
    raise ValueError("no route")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of recordings to take, one for each; ord is the place, 0, 1, 2... over all files and splits."""
    return in_place_order(spark.read.schema(schemas.SOURCE).json(path), "ord")


def read_layouts(spark: SparkSession, layouts: dict[str, str], schema: str = schemas.SEGMENT) -> dict[str, DataFrame]:
    """Manifests of several folder layouts, by name; layouts: name -> pattern of files. The meeting is named by the
    file where a record doesn't say."""
    out = {}
    for name, pattern in layouts.items():
        files = _paths(spark, pattern)
        if not files:
            raise FileNotFoundError(f"no {pattern}")
        rows = in_file_order(spark.read.schema(schema).json(files))
        stem = F.regexp_replace(F.regexp_replace("src_file", r"\.jsonl$", ""), r"^manifest\.", "")
        out[name] = rows.withColumn("meeting_id", F.coalesce("meeting_id", stem))
    return out


def read_documents(spark: SparkSession, path: str, schema: str, key: str = "meeting_id") -> DataFrame:
    """One row for each JSON document, keyed by its file's name without suffix."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn(key, F.regexp_replace("_metadata.file_name", r"\.json3?$", ""))


def read_draft_segments(spark: SparkSession, path: str) -> DataFrame:
    docs = read_documents(spark, path, schemas.DRAFT)
    return docs.select("meeting_id", F.posexplode("segments").alias("ord", "s")).select("meeting_id", "ord", "s.*")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, text) of a JSON object."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, string>")).alias("segment_id", "text"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url").startswith("http"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path), parted at the first two spaces of a line."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    at = F.instr("value", "  ")
    return lines.select(F.substring("value", F.lit(1), at - 1).alias("sha256"), F.substring("value", at + 2, F.length("value")).alias("path"))


def file_hashes(spark: SparkSession, folder: str, skip: str = "CHECKSUMS.txt") -> DataFrame:
    """(path, sha256) of all files below the folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = _paths(spark, folder)[0].rstrip("/") + "/"
    relative = F.replace("path", F.lit(base), F.lit(""))
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256")).where(F.col("path") != skip)
