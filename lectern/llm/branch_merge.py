"""Three-way merge of two branches of a document table.

The base and what each branch changed are dealt to partitions by a hash of the id; rows that
a branch inserts go by their own id, before anything is merged. A partition's rows come
sorted by id. Run after run of them, cut between ids, is registered as Arrow with a DuckDB
inside the task, which merges it with set-based full joins of the branches' changes and
puts the texts together by ordered string aggregation. A run holds a batch and one id at
most, whatever the partition's size, and nothing is written to the executor's disk.

A branch is a table of BRANCH: `change` (columns that are not null, and edits of lines;
an edit has the line's number in the base, whether it is the gap after the line, and the
text, null for a line that is dropped), `drop` of a row, `add` of a row.

Merging: columns, lines, gaps after lines and whole added rows are merged separately. What
one branch changed, or both alike, is taken and counts one clean; what both changed
otherwise is one conflict, and the right branch's state is taken: insert-insert for gaps and
added rows, edit-delete where one drops a line, edit-edit for the rest. A row that a
branch drops counts alone: one edit-delete conflict if the other branch changes it, else
one clean; it stays only if the right branch changes it.

Defined results: nulls in base columns and texts are empty; a text has one line at least; a
change to what the base has already is none, nor is one of a line that it lacks, of a row
that it lacks, or the addition of a row that it has; rows with a null id are left out; of
base rows that repeat an id the one with the least `made_on` stands, of changes those that
were made on it, of added rows the one with the least `made_on`; other columns take no
part. `made_on` is a hash of the base row, so equal rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import scratch
from lectern.llm.merkle import CRC, CRC_TABLE, quoted
from lectern.sources.layout import spread

#: Bytes of the base table for each partition; bytes of rows that one DuckDB run takes, if ids allow; its memory.
PART_BYTES, RUN_BYTES, MEMORY = 4 << 20, 16 << 20, "1GB"
MOST_PARTS = 1 << 22
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
EDITS = "array<struct<line:int,gap:boolean,text:string>>"
#: Versions of a row as they are shuffled.
BASE, LEFT, RIGHT = 0, 1, 2


def branch_schema(columns: Sequence[str]) -> str:
    return ", ".join(["doc_id long", "kind string", "made_on long", *(f"`{c}` string" for c in columns), "text string", f"edits {EDITS}"])


def base_rows(docs: DataFrame, columns: Sequence[str] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, made_on, columns, text) of a document table, nulls empty."""
    values = [F.coalesce(quoted(c).cast("string"), F.lit("")).alias(c) for c in columns]
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), *values, F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.where("doc_id is not null").select("doc_id", F.xxhash64(*[quoted(c) for c in columns], F.col("text")).alias("made_on"), *[quoted(c) for c in columns], "text")


def _sql(columns: Sequence[str]) -> str:
    """One run's merge over `run` (doc_id, version, kind, made_on, c0.., text, edits), of which each (doc_id, version, kind) has one row."""
    n = range(len(columns))
    values = ", ".join(f"c{i}" for i in n)
    named = "\nunion all ".join(f"select h.doc_id, version, {i} as name, h.c{i} as value from h join b using (doc_id) where h.c{i} is not null and h.c{i} <> b.c{i}" for i in n)
    merged = ", ".join(f"coalesce(any_value(state) filter (name = {i}), '') as s{i}, count(*) filter (name = {i}) > 0 as m{i}" for i in n)
    taken = ", ".join(f"case when gone then null when coalesce(m{i}, false) then s{i} else c{i} end as c{i}" for i in n)
    return f"""
with b as materialized (select doc_id, made_on, {values}, text from run where version = {BASE}),
h as materialized (select run.* from run join b using (doc_id, made_on) where version <> {BASE} and kind = 'change'),
gone as (select doc_id, bool_or(version = {LEFT}) as l, bool_or(version = {RIGHT}) as r from run join b using (doc_id, made_on) where kind = 'drop' group by doc_id),
lines as materialized (select doc_id, unnest(range(len(ls)))::int as line, unnest(ls) as text from (select doc_id, string_split(text, chr(10)) as ls from b)),
edits as (select doc_id, version, unnest(edits) as e from h),
units as materialized (
  select e.doc_id, e.version, e.e.line as line, e.e.gap as gap, e.e.text as text from edits e join lines o on o.doc_id = e.doc_id and o.line = e.e.line
  where case when e.e.gap then e.e.text is not null else e.e.text is distinct from o.text end),
u as materialized (
  select coalesce(l.doc_id, r.doc_id) as doc_id, coalesce(l.line, r.line) as line, coalesce(l.gap, r.gap) as gap,
    l.doc_id is not null as in_l, r.doc_id is not null as in_r, case when r.doc_id is not null then r.text else l.text end as state,
    l.doc_id is not null and r.doc_id is not null and l.text is distinct from r.text as conflict, l.text is null or r.text is null as deletes
  from (select * from units where version = {LEFT}) l full join (select * from units where version = {RIGHT}) r
    on l.doc_id = r.doc_id and l.line = r.line and l.gap = r.gap),
named as materialized ({named}),
k as materialized (
  select coalesce(l.doc_id, r.doc_id) as doc_id, coalesce(l.name, r.name) as name, l.doc_id is not null as in_l, r.doc_id is not null as in_r,
    coalesce(r.value, l.value) as state, l.doc_id is not null and r.doc_id is not null and l.value <> r.value as conflict
  from (select * from named where version = {LEFT}) l full join (select * from named where version = {RIGHT}) r on l.doc_id = r.doc_id and l.name = r.name),
counts as (
  select doc_id, count(*) filter (not conflict) as clean, count(*) filter (conflict and not gap and not deletes) as ee,
    count(*) filter (conflict and not gap and deletes) as ed, count(*) filter (conflict and gap) as ii, bool_or(in_l) as l, bool_or(in_r) as r
  from (select doc_id, conflict, gap, deletes, in_l, in_r from u union all select doc_id, conflict, false, false, in_l, in_r from k) group by doc_id),
texts as (
  select doc_id, string_agg(text, chr(10) order by line, gap) as text from (
    select o.doc_id, o.line, false as gap, case when u.doc_id is null then o.text else u.state end as text
    from lines o left join u on u.doc_id = o.doc_id and u.line = o.line and not u.gap
    union all select doc_id, line, true, state from u where gap) where text is not null group by doc_id),
cols as (select doc_id, {merged} from k group by doc_id),
kept as (
  select b.*, coalesce(g.l, false) or coalesce(g.r, false) as alone, coalesce(case when g.l and g.r then false when g.l then n.r when g.r then n.l end, false) as clash,
    coalesce(g.r or (g.l and not coalesce(n.r, false)), false) as gone, n.clean, n.ee, n.ed, n.ii
  from b left join gone g using (doc_id) left join counts n using (doc_id)),
a as (select * from run where kind = 'add' and doc_id not in (select doc_id from b)),
added as (
  select coalesce(l.doc_id, r.doc_id) as doc_id, {", ".join(f"case when r.doc_id is not null then r.c{i} else l.c{i} end as c{i}" for i in n)},
    case when r.doc_id is not null then r.text else l.text end as text,
    l.doc_id is not null and r.doc_id is not null and ({" or ".join(["l.text is distinct from r.text", *(f"l.c{i} is distinct from r.c{i}" for i in n)])}) as conflict
  from (select * from a where version = {LEFT}) l full join (select * from a where version = {RIGHT}) r on l.doc_id = r.doc_id)
select doc_id, {taken}, case when gone then null else coalesce(t.text, '') end as text,
  case when alone then (not clash)::bigint else coalesce(clean, 0) end as n_clean, case when alone then 0 else coalesce(ee, 0) end as n_edit_edit,
  case when alone then clash::bigint else coalesce(ed, 0) end as n_edit_delete, case when alone then 0 else coalesce(ii, 0) end as n_insert_insert
from kept left join texts t using (doc_id) left join cols using (doc_id)
union all select doc_id, {values}, text, (not conflict)::bigint, 0, 0, conflict::bigint from added
"""


def _once(table: pa.Table) -> pa.Table:
    """The first row of each (doc_id, version, kind) of sorted rows."""
    if table.num_rows < 2:
        return table
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for c in ("doc_id", "version", "kind"):
        values = table.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return table if new.all() else table.filter(pa.array(new))


def _merge(sql: str, schema: pa.Schema, memory: str, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one core, no spilling to the executor's own disk
        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""}) as db:

            def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
                ids = table.column("doc_id").to_numpy()
                rows = max(1, int(len(ids) * run_bytes / max(table.nbytes, 1)))
                low = 0
                while low < len(ids):
                    high = int(np.searchsorted(ids, ids[min(low + rows, len(ids)) - 1], "right"))
                    db.register("run", table.slice(low, high - low))
                    found = db.sql(sql).to_arrow_table()
                    db.unregister("run")
                    yield from found.cast(schema).to_batches()
                    low = high

            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                table = _once(table if held is None else pa.concat_tables([held, table]))
                # the last id may go on in the next batch
                ids = table.column("doc_id").to_numpy()
                cut = int(np.searchsorted(ids, ids[-1]))
                held = table.slice(cut)
                if cut:
                    yield from solved(table.slice(0, cut))
            if held is not None:
                yield from solved(held)

    return run


def merge(base: DataFrame, left: DataFrame, right: DataFrame, columns: Sequence[str] = ("lang", "source"), partitions: int | None = None) -> DataFrame:
    """(doc_id, columns, text, COUNTS) of every id in the base or added by a branch; columns and text are null where the
    row is gone. base: `base_rows`; left and right: `branch_schema`."""
    names = [f"c{i}" for i in range(len(columns))]
    values = [quoted(c).alias(n) for c, n in zip(columns, names, strict=True)]
    rows = base.select("doc_id", F.lit(BASE).alias("version"), F.lit("base").alias("kind"), "made_on", *values, "text", F.lit(None).cast(EDITS).alias("edits"))
    for version, branch in ((LEFT, left), (RIGHT, right)):
        rows = rows.unionByName(branch.where("doc_id is not null").select("doc_id", F.lit(version).alias("version"), "kind", F.coalesce("made_on", F.lit(0)).alias("made_on"), *values, "text", "edits"))
    n = partitions or scratch.parts(base, PART_BYTES)
    # a table without statistics counts as endless: then Spark sets the number
    dealt = (rows.repartition(n, "doc_id") if n <= MOST_PARTS else rows.repartition("doc_id")).sortWithinPartitions("doc_id", "version", "kind", "made_on")
    out = pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in (*names, "text")), *((c, pa.int64()) for c in COUNTS)])
    layout = ", ".join(["doc_id long", *(f"{n} string" for n in (*names, "text")), *(f"{c} long" for c in COUNTS)])
    found = dealt.mapInArrow(_merge(_sql(columns), out, MEMORY, RUN_BYTES), layout)
    return found.select("doc_id", *[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], "text", *COUNTS)


#: What a code does with a text: edits of a column or line, and what it inserts.
MARKS = {1: "!", 2: "?", 3: "!", 4: "?"}


def coded_branch(base: DataFrame, name: str, columns: Sequence[str] = ("lang", "source")) -> DataFrame:
    """The branch that crc32(`name:doc_id:unit`) modulo 7 makes of base rows: 0 drops, 1 and 2 append, 3 and 4 insert."""
    code = lambda unit: F.crc32(F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string"), F.lit(f":{unit}"))) % 7
    edited = [F.when(code(c) == 0, "").when(code(c) == 1, F.concat(quoted(c), F.lit("!"))).when(code(c) == 2, F.concat(quoted(c), F.lit("?"))).alias(c) for c in columns]
    coded = f"transform(split(text, '\\n', -1), (t, i) -> named_struct('line', i, 'text', t, 'code', crc32(concat('{name}:', doc_id, ':', i)) % 7))"
    state = "case e.code when 0 then null when 1 then concat(e.text, '!') when 2 then concat(e.text, '?') when 3 then '!' else '?' end"
    edits = F.expr(f"transform(filter({coded}, e -> e.code < 5), e -> named_struct('line', e.line, 'gap', e.code >= 3, 'text', {state}))").cast(EDITS)
    row = code("row")
    dropped = row == 0
    none = F.lit(None).cast("string")
    change = F.struct("doc_id", F.when(dropped, "drop").otherwise("change").alias("kind"), "made_on", *[F.when(~dropped, e).alias(c) for e, c in zip(edited, columns, strict=True)], none.alias("text"), F.when(~dropped, edits).alias("edits"))
    added = F.when(row.isin(3, 4), F.struct((-1 - F.col("doc_id")).alias("doc_id"), F.lit("add").alias("kind"), "made_on", *[quoted(c) for c in columns], F.when(row == 3, MARKS[3]).otherwise(MARKS[4]).alias("text"), F.lit(None).cast(EDITS).alias("edits")))
    rows = base.select(F.explode(F.filter(F.array(change, added), lambda r: r.isNotNull())).alias("r"))
    return rows.select("r.*")


def op13_branch_merge(spark, sf_dir: str) -> DataFrame:
    base = base_rows(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")))
    merged = merge(base, coded_branch(base, "L"), coded_branch(base, "R"))
    return merged.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), *COUNTS)


def _code(branch: str, unit: str) -> str:
    return f"({CRC.format(f'''('{branch}:' || doc_id || ':' || {unit})''')} % 7)"


def _both(unit: str) -> str:
    return f"{_code('L', unit)} as l, {_code('R', unit)} as r"


def oracle() -> str:
    edit = lambda c, v: f"case {c} when 0 then '' when 1 then {v} || '!' when 2 then {v} || '?' else {v} end"
    line = lambda c, v: f"case {c} when 0 then null when 1 then {v} || '!' when 2 then {v} || '?' else {v} end"
    three = lambda b, l, r: f"case when {r} is distinct from {b} then {r} else {l} end"
    return f"""
with c as materialized ({CRC_TABLE}),
d as materialized (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, {_both("'row'")} from documents, c),
v as (select doc_id, lang as b, {edit(_code("L", "'lang'"), "lang")} as x, {edit(_code("R", "'lang'"), "lang")} as y, 'lang' as name from d, c
  union all select doc_id, source, {edit(_code("L", "'source'"), "source")}, {edit(_code("R", "'source'"), "source")}, 'source' from d, c),
o as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as b from d),
p as materialized (select doc_id, i, b, {_both("i")} from o, c),
n as (select doc_id, i, b, {line("l", "b")} as x, {line("r", "b")} as y from p),
g as (select doc_id, i, case l when 3 then '!' when 4 then '?' end as x, case r when 3 then '!' when 4 then '?' end as y from p),
un as (
  select doc_id, x is distinct from b as cl, y is distinct from b as cr, x is distinct from y as differ, 'ee' as kind from v
  union all select doc_id, x is distinct from b, y is distinct from b, x is distinct from y, case when x is null or y is null then 'ed' else 'ee' end from n
  union all select doc_id, x is not null, y is not null, x is distinct from y, 'ii' from g),
s as (select doc_id, count(*) filter ((cl or cr) and not (cl and cr and differ)) as clean, count(*) filter (cl and cr and differ and kind = 'ee') as ee,
  count(*) filter (cl and cr and differ and kind = 'ed') as ed, count(*) filter (cl and cr and differ and kind = 'ii') as ii, bool_or(cl) as cl, bool_or(cr) as cr from un group by doc_id),
m as (select doc_id, i, 0 as gap, {three("b", "x", "y")} as merged, y as own from n union all select doc_id, i, 1, coalesce(y, x), y from g),
t as (select doc_id, coalesce(string_agg(merged, chr(10) order by i, gap), '') as merged, coalesce(string_agg(own, chr(10) order by i, gap), '') as own from m group by doc_id),
k as (select doc_id, max({three("b", "x", "y")}) filter (name = 'lang') as lang, max({three("b", "x", "y")}) filter (name = 'source') as source,
  max(y) filter (name = 'lang') as own_lang, max(y) filter (name = 'source') as own_source from v group by doc_id)
select d.doc_id, case when d.r = 0 or (d.l = 0 and not cr) then null when d.l = 0 then own_lang else k.lang end as lang,
  case when d.r = 0 or (d.l = 0 and not cr) then null when d.l = 0 then own_source else k.source end as source,
  case when d.r = 0 or (d.l = 0 and not cr) then null when d.l = 0 then sha256(own) else sha256(merged) end as text_sha256,
  case when d.l = 0 and d.r = 0 then 1 when d.l = 0 then (not cr)::bigint when d.r = 0 then (not cl)::bigint else clean end as n_clean,
  case when d.l = 0 or d.r = 0 then 0 else ee end as n_edit_edit,
  case when d.l = 0 and d.r = 0 then 0 when d.l = 0 then cr::bigint when d.r = 0 then cl::bigint else ed end as n_edit_delete,
  case when d.l = 0 or d.r = 0 then 0 else ii end as n_insert_insert
from d join s using (doc_id) join t using (doc_id) join k using (doc_id)
union all
select -1 - doc_id, lang, source, sha256(case when r in (3, 4) then case r when 3 then '!' else '?' end else case l when 3 then '!' else '?' end end),
  (not (l in (3, 4) and r in (3, 4) and l <> r))::bigint, 0, 0, (l in (3, 4) and r in (3, 4) and l <> r)::bigint
from d where l in (3, 4) or r in (3, 4)
"""


ORACLE = oracle()
