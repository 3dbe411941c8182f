"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents that belong to the same set of sources are one pattern; only each pattern's number of words
reaches the driver. The flow sends pattern capacity (first use free, each further pass dearer) to source
quotas. A pattern's documents are then used as often as its flow passes them whole, and the remainder is
taken from documents in seeded hash order while they fit: one histogram of hash ranges per pattern finds the
range where the order is cut, and only that range is sorted. One more document, the nearest in size, closes
what is left.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import WORD, forget, written

#: Hex digits of the hash that name its range.
DIGITS = 3
#: Each time that the documents are gone through for those that still fit what is open: how often they may have
#: been taken again already. Repeating one twice comes last.
LEVELS = (0, 0, 0, 0, 1, 2)


def water_fill(sizes: list[int], weights: list[float], total: int, passes: int) -> list[float]:
    """Targets that share total by weight, none above passes times its size; the excess is shared again."""
    open_, fixed = set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(passes * sizes[i] for i in range(len(sizes)) if i not in open_)
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > passes * sizes[i]}
        if not over:
            for i in open_:
                fixed[i] = level * weights[i]
            break
        for i in over:
            fixed[i] = float(passes * sizes[i])
        open_ -= over
    return fixed


def min_cost_flow(capacity: list[int], members: list[list[int]], quotas: list[int], passes: int) -> list[int]:
    """Words taken of each pattern: successive cheapest paths; the k-th use of a pattern costs k - 1 a word."""
    n, m = len(capacity), len(quotas)
    start, end = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            head[x].append(len(to))
            to.append(y), room.append(z), cost.append(v)

    for p in range(n):
        for k in range(passes):
            arc(start, p, capacity[p], k)
        for s in members[p]:
            arc(p, n + s, passes * capacity[p], 0)
    for s in range(m):
        arc(n + s, end, quotas[s], 0)
    while True:
        best, via, todo = [math.inf] * (n + m + 2), [-1] * (n + m + 2), deque([start])
        best[start] = 0
        while todo:
            a = todo.popleft()
            for e in head[a]:
                if room[e] > 0 and best[a] + cost[e] < best[to[e]]:
                    best[to[e]], via[to[e]] = best[a] + cost[e], e
                    todo.append(to[e])
        if best[end] == math.inf:
            break
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [sum(room[e ^ 1] for e in head[p] if to[e] >= n and to[e] < n + m) for p in range(n)]


def mix(docs: DataFrame, sources: Column | None = None, *, weights: tuple[float, ...] = (1, 2, 3), passes: int = 3, seed: str = "mix", most_patterns: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source).

    sources: an array of source names per row (default: source alone); its first one gives the row's
    source_size and target. Sources stand in code point order with null last and weigh `weights` in turn.
    size: words of the text (null: 0). taken: 0 to passes times size. A null or empty array counts as the
    null source; repeated rows count each; a null doc_id is ordered as empty text; an empty table gives an
    empty table; other columns are ignored. most_patterns bounds what reaches the driver; more is an error.
    """
    spark = docs.sparkSession
    names = F.array("source") if sources is None else sources
    named = F.transform(names, lambda s: F.struct(s.isNull().alias("missing"), F.coalesce(s, F.lit("")).alias("name")))
    none = F.array(F.struct(F.lit(True).alias("missing"), F.lit("").alias("name")))
    pattern = F.when(F.coalesce(F.size(names), F.lit(0)) < 1, none).otherwise(F.array_sort(F.array_distinct(named)))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), key.alias("key"), pattern.alias("members"), F.get(named, F.lit(0)).alias("leading"))
    rows = rows.withColumn("first", F.coalesce("leading", F.get("members", F.lit(0)))).drop("leading")
    sized = written(rows.withColumn("pattern", F.to_json("members")).withColumn("range", F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("int")), "sizes")

    found = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).orderBy("pattern").limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns of sources")
    order = sorted({(m["missing"], m["name"]) for r in found for m in r["members"]})
    at = {s: i for i, s in enumerate(order)}
    totals = [sum(r["size"] for r in found if s in {(m["missing"], m["name"]) for m in r["members"]}) for s in order]
    targets = water_fill(totals, [weights[i % len(weights)] for i in range(len(order))], sum(r["size"] for r in found), passes)
    taken = min_cost_flow([r["size"] for r in found], [[at[m["missing"], m["name"]] for m in r["members"]] for r in found], [math.floor(t + 0.5) for t in targets], passes)
    plan = [(r["pattern"], min(passes, f // r["size"]) if r["size"] else 0, f % r["size"] if r["size"] and f < passes * r["size"] else 0) for r, f in zip(found, taken)]
    plans = spark.createDataFrame(plan, "pattern string, whole long, rest long")
    shares = spark.createDataFrame([(m, n, t, g) for (m, n), t, g in zip(order, totals, targets)], "missing boolean, name string, source_size long, target double")

    used = sized.withColumn("extra", F.lit(0).cast("long"))
    gaps = written(plans.select("pattern", F.col("rest").alias("gap"), "whole").where("gap > 0"), "gaps")
    for level in LEVELS:
        before = used
        used = written(fill(used, gaps, level, passes), "used")
        if before is not sized:
            forget(before)
        gaps = written(used.groupBy("pattern").agg(F.sum(F.col("size") * F.col("extra")).alias("filled")).join(plans, "pattern").select("pattern", (F.col("rest") - F.col("filled")).alias("gap"), "whole").where("gap > 0"), "gaps")

    # What stays open goes to the one other document whose size is nearest, if that helps.
    spare = used.where("extra = 0 and size > 0").select("pattern", "key", "size").join(gaps, "pattern")
    best = spare.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "size")).alias("b"), F.first("gap").alias("gap"))
    one = ["pattern", "key", "size"]
    best = written(best.where("b.off < gap").select("pattern", "b.key", "b.size"), "best")
    same = F.row_number().over(Window.partitionBy(*one).orderBy("doc_id"))  # of equal rows, one
    closing = used.join(best, one).where("extra = 0").withColumn("rank", same)
    chosen = closing.withColumn("extra", (F.col("rank") == 1).cast("long")).select(*used.columns)
    others = used.join(best.withColumn("extra", F.lit(0).cast("long")), [*one, "extra"], "left_anti")
    done = others.unionByName(chosen).select("doc_id", "size", "extra", "pattern", "first.*").join(plans, "pattern").join(shares, ["missing", "name"])
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"))


def fill(used: DataFrame, gaps: DataFrame, level: int, passes: int) -> DataFrame:
    """used with extra one higher for more documents: of those at level that fit a pattern's gap, in hash order, as many as it holds.

    gaps is one row per pattern, whose documents are taken `whole` times besides; none goes beyond passes. The sum up to each hash range finds the range where the gap is full; only
    documents in that range are sorted.
    """
    fits = (F.col("extra") == level) & (F.col("whole") + level < passes) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    open_ = used.join(gaps, "pattern", "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
    ranges = open_.where("fits").groupBy("pattern", "range").agg(F.sum("size").alias("size"), F.first("gap").alias("gap"))
    running = F.sum("size").over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    full = ranges.withColumn("upto", running).where((F.col("upto") > F.col("gap")) & (F.col("upto") - F.col("size") <= F.col("gap")))
    cuts = written(full.select("pattern", F.col("range").alias("cut"), (F.col("gap") - F.col("upto") + F.col("size")).alias("open")), "cuts")
    marked = open_.join(cuts, "pattern", "left")
    inside = F.col("fits") & F.coalesce(F.col("range") == F.col("cut"), F.lit(False))
    clear = marked.where(~inside).withColumn("extra", F.when(F.col("fits") & (F.col("cut").isNull() | (F.col("range") < F.col("cut"))), level + 1).otherwise(F.col("extra")).cast("long"))
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0))
    near = marked.where(inside).withColumn("extra", F.when(upto <= F.col("open"), level + 1).otherwise(level).cast("long"))
    return clear.unionByName(near).select(*used.columns)


#: The same rows for one source per document, in DuckDB SQL.
SQL = (
    r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix', coalesce(doc_id::VARCHAR, ''))) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS s, 1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * s::DOUBLE / w AS c,
         coalesce(sum(3 * s) OVER (ORDER BY 3 * s::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 3 * s::DOUBLE / w DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_w,
         sum(s) OVER () AS t
  FROM src),
level AS (
  SELECT coalesce(arg_min((t - capped)::DOUBLE / open_w, (c, source)) FILTER (c >= (t - capped)::DOUBLE / open_w), 0) AS lam FROM ranked),
aim AS (
  SELECT source, s, w, CASE WHEN lam * w > 3 * s THEN 3.0::DOUBLE * s ELSE lam * w END AS target FROM src, level),
quota AS (
  SELECT *, floor(target + 0.5)::BIGINT AS q FROM aim),
base AS (
  SELECT d.*, a.s, a.target, a.q, CASE WHEN a.s = 0 OR a.q >= 3 * a.s THEN 0 ELSE a.q % a.s END AS gap, 0 AS extra FROM sized d JOIN quota a ON d.source IS NOT DISTINCT FROM a.source),
"""
    + "".join(
        f"""fit{k} AS (SELECT *, extra = {level} AND least(3, q // nullif(s, 0)) + {level} < 3 AND size > 0 AND size <= gap AS fits FROM {f"next{k - 1}" if k else "base"}),
sum{k} AS (SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS upto FROM fit{k}),
next{k} AS (SELECT doc_id, source, size, key, s, target, q, gap - sum(CASE WHEN fits AND upto <= gap THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap, extra + CASE WHEN fits AND upto <= gap THEN 1 ELSE 0 END AS extra FROM sum{k}),
"""
        for k, level in enumerate(LEVELS)
    )
    + f"""last AS (SELECT *, row_number() OVER (PARTITION BY source, key, size, extra) AS same FROM next{len(LEVELS) - 1}),
best AS (SELECT source, min((abs(size - gap), key, size)) AS b, any_value(gap) AS gap FROM last WHERE extra = 0 AND size > 0 AND gap > 0 GROUP BY source)
SELECT doc_id, f.size, s AS source_size, target,
       (CASE WHEN s = 0 THEN 0 ELSE f.size * (least(3, q // s) + extra + CASE WHEN extra = 0 AND coalesce(b.b[1] < b.gap AND b.b[2] = key AND b.b[3] = f.size AND same = 1, false) THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM last f LEFT JOIN best b ON f.source IS NOT DISTINCT FROM b.source
"""
)
