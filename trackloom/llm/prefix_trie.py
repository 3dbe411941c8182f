"""The prefix trie of conversations: every distinct sequence of first turns is a node.

Each conversation becomes one string of bytes, 20 a turn: 128 bits of the turn's SHA-256 and the length of its
text. These turn arrays are sorted globally by ranges, equal ones as one entry. Each partition then
sweeps its entries with a stack: the longest common prefix (LCP) with the entry before says which intervals close,
and a closed interval is a node. What a partition cannot close are the nodes along its first and its last entry. These
open stacks, a few rows a partition, are stitched in the order of partitions, which closes them likewise. Nodes then
look up the parents that were open where they were found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import forget, written

#: Bytes of one turn: digest and length of its text.
DIGEST, UNIT = 16, 20
NO_ENDS = hashlib.sha256(b"").hexdigest()
NOBODY = 2**63 - 1


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and units (one hex string a turn, in order of turn, null first, then role and text) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 2 * DIGEST)
    unit = F.concat(digest, F.lpad(F.hex(F.length("text").cast("long")), 2 * (UNIT - DIGEST), "0"))
    ranked = plain.select("conv_id", rank.alias("rank"), unit.alias("unit"))
    listed = ranked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", "unit"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: t["unit"]).alias("units"))


def branched(lists: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Conversations that share first turns: the first h turns of conversation c - c % block, then c's own after its first h; h = crc32(c) % most.

    lists (conv_id, units) is read twice. A base is joined to `block` conversations at most.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = lists.select("conv_id", "units", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    heads = lists.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("units", 1, most - 1).alias("head"))
    units = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.slice("units", F.col("h") + 1, F.size("units")))
    return own.join(heads, "base", "left").select("conv_id", units.alias("units"))


@dataclass
class Open:
    """A node that is not closed yet, with what its closed descendants and its own ends have added."""

    unit: bytes
    owner: int = 0
    low: int = NOBODY
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str = NO_ENDS

    def close(self) -> None:
        """All members are known now."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * int.from_bytes(self.unit[DIGEST:], "big")

    def take(self, child: Open) -> None:
        self.low, self.n = min(self.low, child.low), self.n + child.n
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + child.leaves, self.saved + child.saved

    def merge(self, other: Open) -> None:
        """The same node, as another partition saw it."""
        self.low, self.n = min(self.low, other.low), self.n + other.n
        self.children, self.leaves, self.saved = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        if other.ends != NO_ENDS:
            self.ends = other.ends


def units_of(key: bytes) -> list[bytes]:
    return [key[i : i + UNIT] for i in range(0, len(key), UNIT)]


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


FIELDS = "part int, side int, id long, depth int, unit binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, parent_id long"
NAMES = [f.strip().split(" ")[0] for f in FIELDS.split(",")]
#: Sides of a row: a closed node; an open one on both the first and the last entry, on the first, on the last.
CLOSED, BOTH, FIRST, LAST = range(4)


class Rows:
    """Rows of FIELDS, as columns."""

    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.strip().split(" ")[1]]) for n, f in zip(NAMES, FIELDS.split(","))])

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, *row) -> None:
        self.rows.append(row)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = list(zip(*self.rows))
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types)], schema=self.schema)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one partition from its entries (key, chunk, ids), sorted: FIELDS.

    Closed nodes have their parent's conv_id, or the parent's id where that is open. Holds the closed nodes whose
    parents are open on the stack alone.
    """
    part = TaskContext.get().partitionId()
    made, out = part << 40, Rows()
    path: list[Open] = []  # the stack: nodes along the present entry
    waiting: list[list[tuple]] = []  # by depth: closed children whose parent is on the stack
    first: list[Open] | None = None
    last, units, digest = None, [], None

    def pop(to: int) -> None:
        """Closes the nodes deeper than `to`, but those along the first entry, which the partition before may share."""
        while len(path) - 1 > to:
            depth, node = len(path) - 1, path.pop()
            children = waiting.pop()
            is_open = depth < len(first) and first[depth] is node
            if not is_open:
                node.close()
                path[-1].take(node)
                waiting[-1].append((part, CLOSED, node.owner, depth, node.unit, node.low, node.n, node.children, node.leaves, node.saved, node.ends))
            for child in children:
                out.add(*child, None if is_open else node.low, node.owner if is_open else None)

    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            text = ",".join(map(str, ids)).encode()
            if key == last:
                digest.update(b"," + text)
            else:
                if path:
                    path[-1].ends = digest.hexdigest()
                fresh = units_of(key)
                pop(common(units, fresh)) if path else None
                for unit in [b""] * (not path) + fresh[max(0, len(path) - 1) :]:
                    path.append(Open(unit, made))
                    waiting.append([])
                    made += 1
                if first is None:
                    first = list(path)
                last, units, digest = key, fresh, hashlib.sha256(text)
            path[-1].n += len(ids)
            path[-1].low = min(path[-1].low, ids[0])
            yield from out.batches(1 << 16)
    if not path:
        return
    path[-1].ends = digest.hexdigest()
    for node, children in zip(path, waiting):
        for child in children:
            out.add(*child, None, node.owner)
    shared = sum(a is b for a, b in zip(first, path))
    for side, nodes, begin in ((BOTH, first[:shared], 0), (FIRST, first[shared:], shared), (LAST, path[shared:], shared)):
        for k, node in enumerate(nodes):
            out.add(part, side, node.owner, begin + k, node.unit, node.low, node.n, node.children, node.leaves, node.saved, node.ends, None, None)
    yield from out.batches()


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closes the open nodes of all partitions, sorted by (part, side, depth): FIELDS, with CLOSED rows for nodes and, for every open row,
    a row of side BOTH that names as parent_id the node it became. Memory follows the longest two entries."""
    stack: list[Open] = []
    out = Rows()

    def pop(to: int) -> None:
        while len(stack) - 1 > to:
            depth, node = len(stack) - 1, stack.pop()
            node.close()
            if stack:
                stack[-1].take(node)
            out.add(0, CLOSED, node.owner, depth, node.unit, node.low, node.n, node.children, node.leaves, node.saved, node.ends, None, stack[-1].owner if stack else None)

    def lay(path: list[Open], begin: int) -> None:
        """Puts nodes of depth begin and more on the stack, or adds them to the equal ones there."""
        here = [node.unit for node in stack[begin:]]
        met = common(here, [node.unit for node in path])
        pop(begin + met - 1)
        for k, node in enumerate(path):
            own = node.owner
            if k < met:
                stack[begin + k].merge(node)
            else:
                stack.append(node)
            out.add(0, BOTH, own, begin + k, None, None, None, None, None, None, None, None, stack[begin + k].owner)

    def settle(sides: dict[int, list[Open]]) -> None:
        """One partition: along its first entry, then along its last."""
        both = sides.get(BOTH, [])
        lay(both + sides.get(FIRST, []), 0)
        pop(len(both) - 1)
        lay(sides.get(LAST, []), len(both))

    part, sides = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part and sides:
                settle(sides)
                sides = {}
                yield from out.batches(1 << 16)
            part = row["part"]
            node = Open(row["unit"], row["id"], row["conv_id"], row["n_convs"], row["n_children"], row["n_leaves"], row["saved_tokens"], row["ends_sha256"])
            sides.setdefault(row["side"], []).append(node)
    if sides:
        settle(sides)
        pop(-1)
    yield from out.batches()


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(lists: DataFrame, *, part_bytes: int = 16 << 20) -> DataFrame:
    """The nodes of conversations (conv_id long, distinct and not null; units: what turn_lists gives, may be empty).

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null at the root), n_convs (members), n_children,
    n_leaves (childless nodes in the subtree, itself included), saved_tokens (over the subtree, (n_convs - 1) times the length of the last text),
    ends_sha256 (of the ids of the members that end there, ascending, joined by commas) and turn_key (hex of the last
    turn's digest, null at the root), one row a node. No conversation gives no row. Conversations that are equal
    are members of the same nodes. A turn counts by 128 bits of its SHA-256. A conversation is one row of 20 bytes a turn, so it has
    to fit in a task; part_bytes is about what a partition holds of them. The ids of equal conversations travel in groups of 4,096.
    """
    keyed = lists.select("conv_id", F.unhex(F.array_join("units", "")).alias("key"), F.expr("conv_id div 4096").alias("chunk"))
    entries = written(keyed.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("conv_id")).alias("ids")), "entries")
    size = entries.agg(F.sum(F.length("key") + 8 * F.size("ids"))).first()[0] or 0
    parts = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    swept = written(entries.repartitionByRange(parts, "key").sortWithinPartitions("key", "chunk").mapInArrow(sweep, FIELDS), "swept")
    open_rows = swept.where(F.col("side") != CLOSED).repartition(1).sortWithinPartitions("part", "side", "depth")
    sewn = written(open_rows.mapInArrow(stitch, FIELDS), "stitched")
    forget(entries)

    nodes = sewn.where(F.col("side") == CLOSED).drop("parent_conv_id")
    named = nodes.select(F.col("id").alias("node"), F.col("conv_id").alias("found"))
    seams = nodes.join(named.select(F.col("node").alias("parent_id"), F.col("found").alias("parent_conv_id")), "parent_id", "left")
    became = sewn.where(F.col("side") == BOTH).select(F.col("id").alias("parent_id"), F.col("parent_id").alias("node"))
    inner = swept.where(F.col("side") == CLOSED).join(became.join(named, "node").select("parent_id", "found"), "parent_id", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    key = F.when(F.col("depth") > 0, F.lower(F.hex(F.substring("unit", 1, DIGEST)))).alias("turn_key")
    out = [F.col("depth").cast("long").alias("depth") if c == "depth" else F.col(c) for c in RESULT]
    return inner.select(*out, key).unionByName(seams.select(*out, key))


#: The nodes of `conversations`, branched, in SQL.
SQL = r"""
with table_ as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) r(i)
), convs as (
  select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 6 as h
  from (select distinct conv_id from conversations where conv_id is not null), table_
), turns as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as r
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), rebuilt as (
  select c.conv_id, b.r, b.role, b.text from convs c join turns b on b.conv_id = c.conv_id - c.conv_id % 100 and b.r <= h
  union all
  select c.conv_id, o.r, o.role, o.text from convs c join turns o on o.conv_id = c.conv_id and o.r > h
), lists as (
  select c.conv_id, coalesce(w, []) as w
  from convs c left join (select conv_id, list({'role': role, 'text': text} order by r) as w from rebuilt group by conv_id) using (conv_id)
), nodes as (
  select p, d, min(conv_id) as conv_id, count(*) as n,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(w) = d), '')) as ends
  from (select conv_id, w, d, w[1 : d] as p from (select conv_id, w, unnest(range(0, len(w) + 1)) as d from lists)) group by p, d
), children as (
  select p[1 : d - 1] as p, count(*) as n from nodes where d > 0 group by 1
), sums as (
  select p[1 : k] as p, sum(leaf) as leaves, sum(saved) as saved
  from (
    select n.p, unnest(range(0, d + 1)) as k, (c.n is null)::bigint as leaf, case when d > 0 then (n.n - 1) * length(n.p[d].text) else 0 end as saved
    from nodes n left join children c using (p)
  ) group by 1
)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n as n_convs, coalesce(c.n, 0) as n_children,
  s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, n.ends as ends_sha256
from nodes n join sums s using (p) left join children c using (p) left join nodes u on n.d > 0 and u.p = n.p[1 : n.d - 1]
"""
