"""Merkle manifest of a dataset: a digest of every row, one root for all, and proofs that a row belongs to it.

Leaves of a group (a source) ascend by id. While a level has several nodes, every FAN
consecutive ones become their digest, the last run of a level too when it is shorter; what
remains is the group's subroot. The subroots, in the order of their groups, are the leaves
of one more such tree, whose top is the root.

* A parent is stored as its preimage: its children's digests one after another, 64
  characters each. HEIGHT levels above FAN ** HEIGHT nodes make a block, one row with all
  preimages of its parents; the tops of blocks are the nodes of the next step.
* From the top down each block takes over the preimages above it. A leaf joins its block
  once and has the preimages of all its ancestors.
* In each preimage the leaf's own slot follows from its place. Without that slot the
  preimages are the leaf's siblings, level by level, which is its proof; with another digest
  put into it they fold to the root that this digest would give.

Places are numbered by range partitions and prefix sums over their counts, so no group is
ever sorted in one task.

Defined results: a null value is digested as `-`, any other as byte count, colon and value;
rows with a null id come first in their group, a null group first of all; rows of equal id
are ordered by leaf, so rows that repeat in all columns have leaves of their own, equal in
all but their places; an empty table has no leaves, subroots or root; texts are digested
whole; other columns take no part, whatever their names, and are not returned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import scratch
from lectern.operators.places import placed, task_of
from lectern.sources.layout import spread

#: Children of a node, and levels of a block.
FAN, HEIGHT = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<preimage:string,slot:int>>"


@dataclass(frozen=True)
class Manifest:
    """What is stored of a dataset: `leaves` (tree, place, path and what `leaf_rows` had), `blocks` of parents by step,
    `subroots` (tree, node, path of the subroot, root)."""

    leaves: DataFrame
    blocks: list[DataFrame]
    subroots: DataFrame


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def digest(values: Sequence[Column]) -> Column:
    """H of a row's values: null as `-`, others as byte count, colon and value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in texts]), 256)


def leaf_rows(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", claimed: Mapping[str, Column] | None = None) -> DataFrame:
    """(id, tree, leaf, claimed): one row for each row of docs. `claimed` has columns in place of stored ones: the row as
    somebody claims it to be; without it, the claimed leaf is the leaf."""
    tree = F.when(quoted(group_col).isNull(), "n").otherwise(F.concat(F.lit("s"), quoted(group_col).cast("string")))
    leaf = digest([quoted(c) for c in columns])
    other = digest([(claimed or {}).get(c, quoted(c)) for c in columns])
    return docs.select(quoted(id_col).alias("id"), tree.alias("tree"), leaf.alias("leaf"), (other if claimed else leaf).alias("claimed"))


def _ordered(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """rows with place and depth, the levels above them, in their tree."""
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.materialize(dealt.withColumn("task", task_of("at")), name)
    out = placed(dealt, "at", ["task"], ["tree"], total="size").drop("at", "task")
    depth = F.expr(f"size(filter(array({', '.join(f'{FAN ** k}L' for k in range(40))}), x -> x < size))")
    return out.withColumn("depth", depth).drop("size")


def _block(place: str) -> str:
    return f"{place} div {FAN ** HEIGHT}"


def _step(nodes: DataFrame, base: int) -> DataFrame:
    """(tree, depth, block, preimages by level, top): blocks over nodes (tree, depth, place, node) that have `base` levels below them."""
    groups = nodes.groupBy("tree", "depth", F.expr(_block("place")).alias("block")).agg(F.expr("transform(sort_array(collect_list(struct(place, node))), x -> x.node)").alias("nodes"))
    parents = f"transform(sequence(0, (size(s.nodes) - 1) div {FAN}), i -> array_join(slice(s.nodes, {FAN} * i + 1, {FAN}), ''))"
    levels = f"least({HEIGHT}, depth - {base})"
    climbed = F.expr(f"""aggregate(
        if({levels} > 0, sequence(1, {levels}), cast(array() as array<int>)),
        named_struct('nodes', nodes, 'preimages', cast(array() as array<array<string>>)),
        (s, l) -> named_struct('nodes', transform({parents}, p -> sha2(p, 256)), 'preimages', concat(s.preimages, array({parents}))))""")
    return groups.select("tree", "depth", "block", climbed.alias("c")).select("tree", "depth", "block", "c.preimages", F.col("c.nodes")[0].alias("top"))


def _path(place: str) -> str:
    """The preimages above a place in its block, and its slots in them."""
    powers = f"array({', '.join(str(FAN ** k) for k in range(HEIGHT + 1))})"
    at = f"cast(({place} % {FAN ** HEIGHT}) div {powers}[l + 1] as int)"
    slot = f"cast(({place} div {powers}[l]) % {FAN} as int)"
    steps = f"transform(sequence(0, size(preimages) - 1), l -> named_struct('preimage', preimages[l][{at}], 'slot', {slot}))"
    return f"if(size(preimages) = 0, cast(array() as {_PATH}), {steps})"


def _climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(blocks by step with the path above their tops, the trees' tops) over nodes (tree, depth, place, node)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0  # one row
    blocks: list[DataFrame] = []
    for base in range(0, max(deepest, 1), HEIGHT):
        blocks.append(scratch.materialize(_step(nodes, base), f"{name}-blocks"))
        going = blocks[-1].where(f"depth > {base + HEIGHT}")
        nodes = going.select("tree", "depth", F.col("block").alias("place"), F.col("top").alias("node"))
    tops = [b.where(f"depth <= {(s + 1) * HEIGHT}").select("tree", F.col("top").alias("node")) for s, b in enumerate(blocks)]
    ends = tops[0]
    for more in tops[1:]:
        ends = ends.union(more)
    above = None
    for s in reversed(range(len(blocks))):
        if above is None:
            full = blocks[s].withColumn("above", F.expr(f"cast(array() as {_PATH})"))
        else:
            # the top of a block is a node of the next step
            upper = above.select("tree", F.col("block").alias("upper"), "preimages", F.col("above").alias("higher"))
            joined = blocks[s].withColumnRenamed("preimages", "own").withColumn("upper", F.expr(_block("block"))).join(upper, ["tree", "upper"], "left")
            path = F.expr(f"if(preimages is null, cast(array() as {_PATH}), concat({_path('block')}, higher))")
            full = joined.select("tree", "depth", "block", F.col("own").alias("preimages"), "top", path.alias("above"))
        above = blocks[s] = scratch.materialize(full, f"{name}-paths") if s else full
    return blocks, ends


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of `leaf_rows`."""
    leaves = _ordered(rows, ["tree", "id", "leaf"], "leaves")
    blocks, subroots = _climb(leaves.withColumnRenamed("leaf", "node").select("tree", "depth", "place", "node"), "leaf")
    # one more tree, over the subroots in the order of their groups
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node")
    tops = _ordered(named, ["group"], "subroots")
    upper, root = _climb(tops.select("tree", "depth", "place", "node"), "subroot")
    tops = tops.withColumn("block", F.expr(_block("place"))).join(upper[0].drop("depth", "top"), ["tree", "block"])
    tops = tops.select(F.col("group").alias("tree"), F.col("node").alias("subroot"), F.expr(f"concat({_path('place')}, above)").alias("path"))
    tops = scratch.materialize(tops.crossJoin(F.broadcast(root.select(F.col("node").alias("root")))), "subroots")  # one root
    # the path above a tree's top is joined to its blocks, which are far fewer than its leaves
    lowest = blocks[0].join(tops, "tree").select("tree", "block", "preimages", F.concat("above", "path").alias("above"), "subroot", "root")
    placed_leaves = leaves.withColumn("block", F.expr(_block("place"))).join(lowest, ["tree", "block"])
    path = F.expr(f"concat({_path('place')}, above)").alias("path")
    return Manifest(placed_leaves.select("id", "tree", "place", "leaf", "claimed", path, "subroot", "root"), blocks, tops)


def parents(found: Manifest) -> DataFrame:
    """(tree, level, node, preimage): every parent below the subroots, levels from 1."""
    out = None
    for s, blocks in enumerate(found.blocks):
        rows = blocks.select("tree", "block", F.posexplode("preimages").alias("l", "inside")).select("tree", "block", "l", F.posexplode("inside").alias("i", "preimage"))
        width = F.expr(f"array({', '.join(str(FAN ** (HEIGHT - k - 1)) for k in range(HEIGHT))})[l]")
        rows = rows.select("tree", (F.col("l") + (s * HEIGHT + 1)).alias("level"), (F.col("block") * width + F.col("i")).alias("node"), "preimage")
        out = rows if out is None else out.union(rows)
    return out


def siblings(path: str = "path") -> Column:
    """The siblings' digests along a path, one after another: every preimage without the slot of its own."""
    return F.expr(f"array_join(transform({path}, x -> concat(substring(x.preimage, 1, 64 * x.slot), substring(x.preimage, 64 * x.slot + 65))), '')")


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a digest gives in the place of a path: it takes its slot in each preimage, level by level."""
    return F.expr(f"aggregate({path}, {leaf}, (h, x) -> sha2(concat(substring(x.preimage, 1, 64 * x.slot), h, substring(x.preimage, 64 * x.slot + 65)), 256))")


def proved(found: Manifest) -> DataFrame:
    """(id, tree, place, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf."""
    rows = found.leaves.select("id", "tree", "place", "leaf", "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), folded("claimed").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(tampered, F.expr("replace(text, '\n', '')")).otherwise(F.col("text"))
    rows = scratch.materialize(leaf_rows(docs, claimed={"text": text}), "digests")
    return proved(manifest(rows)).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: crc32 of an ASCII text, byte by byte over the usual table.
CRC_TABLE = "select [list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) for i in range(256)] as t"
CRC = "xor(list_reduce(list_prepend(4294967295, [ascii(c)::bigint for c in string_split({}, '')]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def _levels(nodes: str, walks: str, levels: int, prefix: str) -> str:
    """SQL of the levels above `nodes` (tree, pos, h, cnt) and of `walks` (doc_id, tree, p, f, proof) up to the trees' tops."""
    out, n, w = [], nodes, walks
    for i in range(levels):
        out.append(f"""{prefix}n{i} as materialized (
  select tree, pos // 3 as pos, sha256(string_agg(h, '' order by pos)) as h, (cnt + 2) // 3 as cnt from {n} where cnt > 1 group by tree, pos // 3, cnt
  union all select tree, pos, h, cnt from {n} where cnt = 1)""")
        out.append(f"""{prefix}w{i} as materialized (
  select w.doc_id, w.tree, p // 3 as p, sha256(string_agg(case when n.pos = p then f else n.h end, '' order by n.pos)) as f,
    any_value(proof) || coalesce(string_agg(n.h, '' order by n.pos) filter (n.pos <> p), '') as proof
  from {w} w join {n} n on n.tree = w.tree and n.pos // 3 = p // 3 where n.cnt > 1 group by w.doc_id, w.tree, p
  union all select w.doc_id, w.tree, p, f, proof from {w} w join {n} n on n.tree = w.tree where n.cnt = 1)""")
        n, w = f"{prefix}n{i}", f"{prefix}w{i}"
    return ",\n".join(out)


_VALUE = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in COLUMNS[:4]) + " || {})"
#: Trees of up to 3 ** 12 leaves, and 3 ** 6 of them.
ORACLE = f"""
with c as materialized ({CRC_TABLE}),
d as materialized (select doc_id, case when source is null then 'n' else 's' || source end as tree, {_LEAF.format(_VALUE.format("text"))} as leaf,
  case when {CRC.format("doc_id::varchar")} % 2 = 0 then {_LEAF.format(_VALUE.format("replace(text, chr(10), '')"))} else leaf end as claimed from documents, c),
o as materialized (select *, row_number() over (partition by tree order by doc_id) - 1 as pos, count(*) over (partition by tree) as cnt from d),
leafn as (select tree, pos, leaf as h, cnt from o),
leafw as (select doc_id, tree, pos as p, claimed as f, '' as proof from o),
{_levels("leafn", "leafw", 12, "a")},
subs as materialized (select tree, h, row_number() over (order by tree) - 1 as pos, count(*) over () as cnt from an11),
topn as (select '' as tree, pos, h, cnt from subs),
topw as (select w.doc_id, '' as tree, s.pos as p, w.f, w.proof from aw11 w join subs s using (tree)),
{_levels("topn", "topw", 6, "b")}
select o.doc_id, o.leaf, s.h as subroot, n.h as root, sha256(w.proof) as proof_sha256, w.f as folded_root, w.f = n.h as verified
from o join subs s using (tree) join bw5 w using (doc_id) cross join bn5 n
"""
