"""Manifests as a data source and greedy cuts as a table function, so that SQL alone reads and cuts.

`register(spark)` makes both known to a session:

    spark.read.format("manifests").load(folder).createOrReplaceTempView("segments")
    SELECT * FROM greedy_cuts(0.5D, 30.0D, 5.0D, 0.0D, TABLE(SELECT meeting_id, start FROM words) PARTITION BY meeting_id ORDER BY start)
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from lectern.sources import schemas

#: Bytes of a split, which is all that a task holds beside one line that crosses its end.
SPLIT = 1 << 24
#: Bits of ord for the byte where a line begins in its file.
OFFSET_BITS = 40


class Split(InputPartition):
    """Bytes from `low` to before `high` of the file that is `rank`th by name."""

    def __init__(self, path: str, rank: int, low: int, high: int):
        super().__init__(None)
        self.path, self.rank, self.low, self.high = path, rank, low, high


class ManifestReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.equal = schema, options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities on text columns are tested before rows leave the reader; the others are Spark's."""
        texts = {f.name for f in self.schema if isinstance(f.dataType, StringType)}
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in texts and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Split]:
        files, folder = fs.FileSystem.from_uri(self.options["path"])
        pattern, size = self.options.get("pattern", "manifest.*.jsonl"), int(self.options.get("split", SPLIT))
        found = sorted((i for i in files.get_file_info(fs.FileSelector(folder)) if i.is_file and fnmatch.fnmatch(i.base_name, pattern)), key=lambda i: i.path)
        if not found:
            raise FileNotFoundError(f"no {pattern} in {self.options['path']}")
        return [Split(i.path, rank, low, min(low + size, i.size)) for rank, i in enumerate(found) for low in range(0, i.size, size)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the split."""
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        with files.open_input_file(partition.path) as file:
            at = max(partition.low - 1, 0)
            file.seek(at)
            data = file.read(partition.high - at)
            # the last line goes on behind the split
            while not data.endswith(b"\n") and (more := file.read(1 << 16)):
                cut = more.find(b"\n")
                data += more if cut < 0 else more[: cut + 1]
        if partition.low:  # what begins before the split is the split's before it
            first = data.find(b"\n") + 1
            at, data = (at + first, data[first:]) if first else (partition.high, b"")
        lines, places = [], []
        for line in data.split(b"\n"):
            if line.strip() and at < partition.high:
                lines.append(line)
                places.append((partition.rank << OFFSET_BITS) + at)
            at += len(line) + 1
        if not lines:
            return
        wanted = to_arrow_schema(self.schema)
        fields = pa.schema([f for f in wanted if f.name not in ("ord", "src_file")])
        block = b"\n".join(lines) + b"\n"
        rows = pj.read_json(pa.BufferReader(block), pj.ReadOptions(use_threads=False, block_size=len(block)), pj.ParseOptions(explicit_schema=fields, unexpected_field_behavior="ignore"))
        if len(rows) != len(lines):
            raise ValueError(f"{partition.path} has a line that is not one record")
        own = {"ord": pa.array(places, pa.int64()), "src_file": pa.array([partition.path.rsplit("/", 1)[-1]] * len(lines), pa.string())}
        rows = pa.table([own[f.name] if f.name in own else rows[f.name].cast(f.type) for f in wanted], schema=wanted)
        for name, value in self.equal.items():
            rows = rows.filter(pc.equal(rows[name], value))
        yield from rows.to_batches()


class ManifestSource(DataSource):
    """Format "manifests": JSON lines of a folder's files in name order, read by splits, with ord, which grows with the
    place, and src_file. Options: pattern of file names, split in bytes. A folder without such files is an error, a record
    of another shape too; blank lines are passed over. Paths are those that pyarrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return "manifests"

    def schema(self) -> str:
        return f"{schemas.SEGMENT}, ord long, src_file string"

    def reader(self, schema: StructType) -> ManifestReader:
        return ManifestReader(schema, self.options)


class GreedyCuts:
    """The cuts of one recording from its (key, start) rows in order, without holding them: see `timeline.greedy_cuts`.
    The table comes last, behind the least gap, the longest and shortest segment, and the tail, all in seconds.
    The recording ends `tail` seconds after its last word. Rows without a start are passed over."""

    def __init__(self):
        self.key, self.before, self.last, self.n = None, None, 0.0, 0

    def _cut(self, at: float) -> tuple:
        self.last, self.n = at, self.n + 1
        return self.key, self.n - 1, at

    def eval(self, min_gap: float, longest: float, shortest: float, tail: float, word):
        self.longest, self.tail = longest, tail
        key, start = word[0], word[1]
        if start is None:
            return
        self.key = None if key is None else str(key)
        if self.before is not None and start - self.before >= min_gap:
            at = (start + self.before) / 2
            if at - self.last > longest:
                yield self._cut(self.last + longest)
            elif at - self.last >= shortest:
                yield self._cut(at)
        self.before = start

    def terminate(self):
        if self.before is not None:
            end, last, i = self.before + self.tail, self.last, 1
            while last + i * self.longest < end:
                yield self._cut(last + i * self.longest)
                i += 1


def register(spark: SparkSession) -> None:
    """Makes "manifests" and `greedy_cuts` known, and lets Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ManifestSource)
    spark.udtf.register("greedy_cuts", udtf(GreedyCuts, returnType="key string, i int, cut double"))
