"""Parent-child links of unknown depth to roots, depths, paths and descendants.

Partition-local chains are contracted to the node at which they leave the partition, the
quotient forest of those exits is solved, and the answers are expanded again.

* Rows are range-partitioned by (group, id): a thread stays together unless it is too large
  for one partition, in which case the range splits it. No task ever holds one whole group.
* In a partition, pointer doubling over numpy arrays finds each node's local top, the steps to
  it, and local cycles.
* A top whose parent lies in another partition becomes an edge of the quotient forest. That forest is smaller,
  and is solved the same way: range-partitioned, contracted to the exits of its own partitions, and so on
  until at most ``max_local`` rows are left, which one task solves; the answers are then expanded level by level.
  A level that shrinks by less than a fifth (ids that say nothing about neighbourhood) goes on by
  pointer doubling with joins instead.
* Cycles that cross partitions show up as cycles of the quotient; the fragments on them are
  solved again node by node.
* Partitions hold about ``rows_per_part`` rows, whatever the number of rows.

Defined cases: rows with a null id are ignored; several rows of an id count once (smallest
non-null parent and group, terminal if any row is); a node named as its own parent is a cycle
of length 1; a parent that is null or absent ends the chain there; an empty table gives an
empty result; other columns of the input are neither read nor kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize, partitions

TREE, ORPHAN, CYCLE = "tree", "orphan", "cycle"
_LOCAL = "id string, parent string, terminal boolean, top string, dist bigint, cyc string, path array<string>"


def _jump(par: np.ndarray, w: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(par))
    ptr, dist = np.where(par >= 0, par, at), np.where(par >= 0, w, 0)
    for _ in range(rounds):
        dist = dist + dist[ptr]
        ptr = ptr[ptr]
    return ptr, dist


def solve_arrays(ids: np.ndarray, par: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: index of the node at which its chain ends (on a cycle: the first node on it), the
    steps to it, and the smallest id of the cycle (None where there is none)."""
    n = len(ids)
    rounds = max(1, math.ceil(math.log2(n + 1)) + 1)
    ptr, dist = _jump(par, w, rounds)
    cyc = np.full(n, None, dtype=object)
    looped = par[ptr] >= 0 if n else np.zeros(0, bool)
    if looped.any():
        on = np.unique(ptr[looped])  # a cycle's own nodes are permuted by the jumps, so all of it is hit
        mask = np.zeros(n, bool)
        mask[on] = True
        ptr, dist = _jump(np.where(mask, -1, par), w, rounds)
        rank = np.full(n, n)
        rank[on[np.argsort(ids[on])]] = np.arange(len(on))
        least, p = rank[on], np.searchsorted(on, par[on])
        for _ in range(rounds):
            least, p = np.minimum(least, least[p]), p[p]
        name = np.full(n, None, dtype=object)
        name[on] = np.sort(ids[on])[least]
        cyc = name[ptr]
    return ptr, dist, cyc


def _paths(ids: np.ndarray, par: np.ndarray, dist: np.ndarray, stop: np.ndarray) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in ids]
    for i in np.argsort(dist, kind="stable"):
        out[i] = [ids[i]] if stop[i] or par[i] < 0 else [*out[par[i]], ids[i]]
    return out


def _contract(with_path: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        d = pd.concat(parts, ignore_index=True)
        ids = d["id"].to_numpy(object)
        par = pd.Index(ids).get_indexer(pd.Index(d["parent"].to_numpy(object)))
        par = np.where(d["parent"].isna().to_numpy(), -1, par)
        ptr, dist, cyc = solve_arrays(ids, par, np.ones(len(ids), np.int64))
        out = pd.DataFrame({"id": ids, "parent": d["parent"], "terminal": d["terminal"], "top": ids[ptr], "dist": dist, "cyc": cyc})
        out["path"] = _paths(ids, par, dist, (dist == 0)) if with_path else None
        yield out

    return run


_SOLVED = "top string, end_top string, hops bigint, loop boolean, prefix array<string>"


def _solve_one(with_path: bool):
    """Quotient rows (top, into, w, seg) in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        d = pd.concat(parts, ignore_index=True)
        ids = d["top"].to_numpy(object)
        par = pd.Index(ids).get_indexer(pd.Index(d["into"].to_numpy(object)))
        par = np.where(d["into"].isna().to_numpy(), -1, par)
        w = d["w"].to_numpy(np.int64)
        ptr, dist, cyc = solve_arrays(ids, par, w)
        into = d["into"].to_numpy(object)
        end, hops = np.where(par[ptr] >= 0, None, into[ptr]), dist + w[ptr]
        on_loop = np.array([c is not None for c in cyc], bool)
        out = pd.DataFrame({"top": ids, "end_top": end, "hops": hops, "loop": on_loop & (dist == 0)})
        out["prefix"] = None
        if with_path:
            order = np.argsort(dist, kind="stable")
            seg, pre = d["seg"].to_numpy(object), [None] * len(ids)
            for i in order:
                if not on_loop[i]:
                    pre[i] = [*(pre[par[i]] if par[i] >= 0 else []), *seg[i]]
            out["prefix"] = pre
        out["below"] = on_loop
        yield out

    return run


def _doubling(q: DataFrame, n: int, with_path: bool) -> DataFrame:
    """The same answer by joins alone: log2(n) rounds of ptr -> ptr's ptr, for quotients of any size.

    Paths are joined in a second pass, over chains that end: those in a loop would double forever.
    """
    rounds = max(1, math.ceil(math.log2(n + 1)) + 1)
    inside = q.select(F.col("top").alias("into"), F.lit(True).alias("inside"))
    start = q.join(inside, "into", "left").select(
        "top", F.when(F.col("inside"), F.col("into")).alias("ptr"), "w", F.when(F.col("inside").isNull(), F.col("into")).alias("end_top"), "seg"
    )

    def run(cur: DataFrame, seg: bool) -> DataFrame:
        for _ in range(rounds):
            nxt = cur.select(F.col("top").alias("ptr"), F.col("ptr").alias("p2"), F.col("w").alias("w2"), F.col("end_top").alias("e2"), *([F.col("seg").alias("s2")] if seg else []))
            joined = [F.when(F.col("s2").isNull(), F.col("seg")).otherwise(F.concat("s2", "seg")).alias("seg")] if seg else []
            cur = materialize(
                cur.join(nxt, "ptr", "left").select("top", F.col("p2").alias("ptr"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.coalesce("end_top", "e2").alias("end_top"), *joined), "jump"
            )
            if cur.where("ptr is not null").isEmpty():
                break
        return cur

    cur = run(start.drop("seg"), False)
    on = cur.where("ptr is not null").select(F.col("ptr").alias("top")).distinct().withColumn("on", F.lit(True))
    out = cur.join(on, "top", "left").select("top", "end_top", F.col("w").alias("hops"), F.coalesce("on", F.lit(False)).alias("loop"), F.col("ptr").isNotNull().alias("below"))
    if not with_path:
        return out.withColumn("prefix", F.lit(None).cast("array<string>"))
    ended = run(start.join(cur.where("ptr is null").select("top"), "top", "left_semi"), True)
    return out.join(ended.select("top", F.col("seg").alias("prefix")), "top", "left")


def _contract_quotient(with_path: bool):
    """One partition of quotient rows: to each the local top, the steps and path from it, or that it ends in a local cycle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        d = pd.concat(parts, ignore_index=True)
        ids, into, w = d["top"].to_numpy(object), d["into"].to_numpy(object), d["w"].to_numpy(np.int64)
        par = pd.Index(ids).get_indexer(pd.Index(into))
        par = np.where(d["into"].isna().to_numpy(), -1, par)
        ptr, dist, cyc = solve_arrays(ids, par, w)
        on_loop = np.array([c is not None for c in cyc], bool)
        rel: list = [None] * len(ids)
        if with_path:
            seg = d["seg"].to_numpy(object)
            for i in np.argsort(dist, kind="stable"):
                if not on_loop[i]:
                    rel[i] = [*rel[par[i]], *seg[i]] if par[i] >= 0 else []
        yield pd.DataFrame({"top": ids, "into": into, "w": w, "seg": d["seg"], "up": ids[ptr], "dist": dist, "loop": on_loop & (dist == 0), "below": on_loop, "rel": rel})

    return run


_CONTRACTED = "top string, into string, w bigint, seg array<string>, up string, dist bigint, loop boolean, below boolean, rel array<string>"


def _solve_quotient(q: DataFrame, max_local: int, with_path: bool, rows_per_part: int = 500_000, least_parts: int = 1) -> tuple[DataFrame, bool]:
    """q: (top, into, w, seg). Gives (top, end_top, hops, loop, prefix, below), and whether there is any loop.

    ``loop`` marks a set of rows that is closed under ``into`` and holds every cycle; ``below`` all rows that lead there.
    """
    n = q.count()
    if n <= max_local:
        out = q.coalesce(1).mapInPandas(_solve_one(with_path), _SOLVED + ", below boolean")
    else:
        parts = max(least_parts, -(-n // max(1, min(rows_per_part, max_local))))
        level = materialize(q.repartitionByRange(parts, "top").mapInPandas(_contract_quotient(with_path), _CONTRACTED), "level")
        tops = level.where("dist = 0 and not below")
        if tops.count() > 0.8 * n:
            out = _doubling(q, n, with_path)
        else:
            out = _expand_level(level, tops, max_local, with_path, rows_per_part)
    out = materialize(out, "quotient")
    return out, not out.where("below").isEmpty()


def _expand_level(level: DataFrame, tops: DataFrame, max_local: int, with_path: bool, rows_per_part: int) -> DataFrame:
    target = level.select(F.col("top").alias("into"), F.col("up").alias("to"), F.col("dist").alias("to_dist"), F.col("below").alias("to_below"), F.col("rel").alias("to_rel"))
    tied = materialize(tops.select("top", "into", "w", "seg").join(target, "into", "left"), "tied")
    joined = F.concat("to_rel", "seg") if with_path else F.lit(None).cast("array<string>")
    inner = tied.where("to is not null and not to_below").select("top", F.col("to").alias("into"), (F.col("w") + F.col("to_dist")).alias("w"), joined.alias("seg"))
    answer, _ = _solve_quotient(inner, max_local, with_path, rows_per_part)
    ends = tied.where("to is null").select("top", F.col("into").alias("end_top"), F.col("w").alias("hops"), F.lit(False).alias("loop"), F.col("seg").alias("prefix"), F.lit(False).alias("below"))
    under = tied.where("to_below").select("top", F.lit(None).cast("string").alias("end_top"), F.lit(0).cast("bigint").alias("hops"), F.lit(False).alias("loop"), F.lit(None).cast("array<string>").alias("prefix"), F.lit(True).alias("below"))
    # an answer that ends inside names the fragment it came through; its own top's ``into`` is what lies outside
    solved = ends.unionByName(under).unionByName(_through(answer, tied))
    got = solved.select(F.col("top").alias("up"), "end_top", "hops", F.col("loop").alias("up_loop"), "prefix", F.col("below").alias("up_below"))
    rows = level.where("not below").join(got, "up")
    path = F.concat("prefix", "rel") if with_path else F.lit(None).cast("array<string>")
    open_ = rows.select("top", "end_top", (F.col("hops") + F.col("dist")).alias("hops"), F.col("up_loop").alias("loop"), path.alias("prefix"), F.col("up_below").alias("below"))
    closed = level.where("below").select("top", F.lit(None).cast("string").alias("end_top"), F.col("dist").alias("hops"), "loop", F.lit(None).cast("array<string>").alias("prefix"), "below")
    return open_.unionByName(closed)


def _through(answer: DataFrame, tied: DataFrame) -> DataFrame:
    """Answers over the inner tops end at a top that is no inner row: that one's own row says how it goes on."""
    last = tied.where("to is null or to_below").select(F.col("top").alias("end_top"), F.col("into").alias("own_into"), F.col("w").alias("own_w"), F.col("seg").alias("own_seg"), F.coalesce("to_below", F.lit(False)).alias("own_below"))
    j = answer.join(last, "end_top", "left")
    out = j.select(
        "top", F.when(~F.col("own_below"), F.col("own_into")).alias("end_top"), (F.col("hops") + F.coalesce("own_w", F.lit(0))).alias("hops"), "loop",
        F.when(F.col("own_seg").isNotNull(), F.concat("own_seg", "prefix")).otherwise(F.col("prefix")).alias("prefix"), (F.col("below") | F.coalesce("own_below", F.lit(False))).alias("below"),
    )
    return out


def resolve(nodes: DataFrame, max_local: int = 500_000, with_path: bool = False, parts: int | None = None, rows_per_part: int = 500_000) -> DataFrame:
    """nodes: (id, parent, terminal, grp). Gives (id, root_id, depth, state[, path]).

    ``state`` is ``tree`` (the chain ends at a terminal node), ``orphan`` (it ends at another) or
    ``cycle``; the root of a cycle is its smallest id and the depth counts to the first node on
    it. ``path`` runs from the root (or that first node) to the node itself.
    """
    spark = nodes.sparkSession
    clean = (
        nodes.where("id is not null").groupBy("id")
        .agg(F.min("parent").alias("parent"), F.max(F.coalesce("terminal", F.lit(False))).alias("terminal"), F.min("grp").alias("grp"))
        .withColumn("parent", F.when(~F.col("terminal"), F.col("parent")))
        .withColumn("grp", F.coalesce("grp", "id"))
    )
    parts = parts or max(partitions(spark), -(-nodes.count() // rows_per_part))
    local = materialize(
        clean.repartitionByRange(parts, "grp", "id").select("id", "parent", "terminal").mapInPandas(_contract(with_path), _LOCAL),
        "fragments",
    )
    # exits: tops whose parent is named but lies in no row of the same partition
    exits = local.where("dist = 0 and parent is not null and cyc is null").select(F.col("id").alias("top"), F.col("parent").alias("exit"))
    target = local.select(F.col("id").alias("exit"), F.col("top").alias("into"), F.col("dist").alias("into_dist"), F.col("cyc").alias("into_cyc"), F.col("path").alias("seg"))
    # an absent parent ends the chain at the exit itself: no quotient row
    edges = materialize(exits.join(target, "exit").select("top", "exit", "into", F.col("into_dist"), "into_cyc", "seg"), "edges")
    no_edges = edges.isEmpty()
    pick = [F.col("path")] if with_path else []
    ends = local.where("dist = 0").select(F.col("id").alias("end_top"), F.col("terminal").alias("end_terminal"), F.col("cyc").alias("end_cyc"))
    if no_edges:
        solved = local.select("*", F.col("top").alias("root"), F.col("dist").alias("depth0"), F.col("path").alias("full"))
        done = solved.join(ends.select(F.col("end_top").alias("root"), "end_terminal"), "root", "left")
        return done.select(
            "id", F.coalesce("cyc", "root").alias("root_id"), F.col("depth0").alias("depth"),
            F.when(F.col("cyc").isNotNull(), CYCLE).when(F.col("end_terminal"), TREE).otherwise(ORPHAN).alias("state"), *pick,
        )
    q = edges.select("top", "into", (F.col("into_dist") + 1).alias("w"), "seg")
    answer, loops = _solve_quotient(q, max_local, with_path, rows_per_part)
    found = answer.where("not below").join(ends, "end_top", "left").select(
        "top", "hops", "prefix", F.coalesce("end_cyc", "end_top").alias("end_id"),
        F.when(F.col("end_cyc").isNotNull(), CYCLE).when(F.col("end_terminal"), TREE).otherwise(ORPHAN).alias("end_state"),
    )
    rest = local
    cyclic = None
    if loops:
        cyclic, found2 = _global_cycles(local, edges, answer, max_local, with_path)
        found = found.unionByName(found2)
        rest = local.join(answer.where("loop").select("top"), "top", "left_anti")
    own = ends.select(F.col("end_top").alias("top"), F.col("end_terminal"))
    out = rest.join(found, "top", "left").join(own, "top", "left")
    out = out.select(
        "id",
        F.coalesce("cyc", "end_id", "top").alias("root_id"),
        (F.col("dist") + F.coalesce("hops", F.lit(0))).alias("depth"),
        F.when(F.col("cyc").isNotNull(), CYCLE).when(F.col("end_state").isNotNull(), F.col("end_state")).when(F.col("end_terminal"), TREE).otherwise(ORPHAN).alias("state"),
        *([F.when(F.col("prefix").isNotNull(), F.concat("prefix", "path")).otherwise(F.col("path")).alias("path")] if with_path else []),
    )
    return out if cyclic is None else out.unionByName(cyclic)


def _global_cycles(local: DataFrame, edges: DataFrame, answer: DataFrame, max_local: int, with_path: bool) -> tuple[DataFrame, DataFrame]:
    """Fragments on a cycle of the quotient are solved node by node; what hangs below them starts from those answers."""
    on = answer.where("loop").select("top")
    nodes = local.join(on, "top", "left_semi").select(F.col("id").alias("top"), F.col("parent").alias("into"), F.lit(1).cast("bigint").alias("w"), F.array("parent").alias("seg"))
    nodes = materialize(nodes, "cyclic")
    n = nodes.count()
    if n <= max_local:
        solved = nodes.coalesce(1).mapInPandas(_cycle_one, "id string, root_id string, depth bigint, path array<string>")
    else:
        solved = _cycles_by_joins(nodes, n)
    solved = materialize(solved, "cycles")
    cyclic = solved.select("id", "root_id", "depth", F.lit(CYCLE).alias("state"), *(["path"] if with_path else []))
    # the quotient again, with edges into solved nodes as ends
    under = answer.where("below and not loop").select("top")
    rows = edges.join(under, "top", "left_semi")
    hit = rows.join(solved.withColumnRenamed("id", "exit"), "exit", "left")
    q = hit.select(
        "top", F.when(F.col("root_id").isNull(), F.col("into")).otherwise(F.concat(F.lit("\u0000"), "exit")).alias("into"),
        F.when(F.col("root_id").isNull(), F.col("into_dist") + 1).otherwise(F.col("depth") + 1).alias("w"),
        F.when(F.col("root_id").isNull(), F.col("seg")).otherwise(F.col("path")).alias("seg"), "root_id",
    )
    q = materialize(q, "under")
    again, _ = _solve_quotient(q.drop("root_id"), max_local, with_path)
    roots = solved.select(F.concat(F.lit("\u0000"), "id").alias("end_top"), "root_id")
    found = again.join(roots, "end_top").select("top", "hops", "prefix", F.col("root_id").alias("end_id"), F.lit(CYCLE).alias("end_state"))
    return cyclic, found


def _cycle_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    d = pd.concat(parts, ignore_index=True)
    ids = d["top"].to_numpy(object)
    par = pd.Index(ids).get_indexer(pd.Index(d["into"].to_numpy(object)))
    ptr, dist, cyc = solve_arrays(ids, par, np.ones(len(ids), np.int64))
    yield pd.DataFrame({"id": ids, "root_id": cyc, "depth": dist, "path": _paths(ids, par, dist, dist == 0)})


def _cycles_by_joins(nodes: DataFrame, n: int) -> DataFrame:
    """Distributed twin of :func:`_cycle_one`: which nodes are on cycles, their smallest id, and the steps to them."""
    rounds = max(1, math.ceil(math.log2(n + 1)) + 1)
    cur = nodes.select(F.col("top").alias("id"), F.col("into").alias("ptr"), F.col("top").alias("least"))
    for _ in range(rounds):
        nxt = cur.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("least").alias("l2"))
        cur = materialize(cur.join(nxt, "ptr").select("id", F.col("p2").alias("ptr"), F.least("least", "l2").alias("least")), "jump")
    on = cur.select(F.col("ptr").alias("id")).distinct().join(cur.select("id", "least"), "id").select(F.col("id"), F.col("least").alias("root_id"))
    on = materialize(on, "on")
    walk = nodes.select(F.col("top").alias("id"), F.col("into").alias("ptr")).join(on.select("id"), "id", "left_anti")
    walk = walk.select("id", "ptr", F.lit(1).cast("bigint").alias("depth"), F.array("ptr").alias("path"))
    for _ in range(rounds):
        nxt = walk.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("depth").alias("d2"), F.col("path").alias("x2"))
        walk = materialize(walk.join(nxt, "ptr", "left").select("id", F.coalesce("p2", "ptr").alias("ptr"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.when(F.col("x2").isNotNull(), F.concat("x2", "path")).otherwise(F.col("path")).alias("path")), "walk")
    under = walk.join(on.withColumnRenamed("id", "ptr"), "ptr").select("id", "root_id", "depth", F.concat("path", F.array("id")).alias("path"))
    return on.select("id", "root_id", F.lit(0).cast("bigint").alias("depth"), F.array("id").alias("path")).unionByName(under)


def bare(c: str):
    """An id without its kind prefix, which may be in either case; blank becomes null."""
    x = F.regexp_replace(F.trim(F.col(c)), "^[tT][13]_", "")
    return F.when(x != "", x)


def entry_nodes(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("id"), bare("parent_id").alias("parent"), (F.col("type") == "submission").alias("terminal"), bare("link_id").alias("grp"))


def entry_hierarchy(entries: DataFrame, with_path: bool = True, **kw) -> DataFrame:
    """Every entry with root, depth and state, and its path if asked for."""
    nodes = entry_nodes(entries)
    return resolve(nodes.withColumn("grp", F.when(F.col("terminal"), F.col("id")).otherwise(F.col("grp"))), with_path=with_path, **kw)


def descendant_counts(paths: DataFrame) -> DataFrame:
    """(id, descendants) of every node that has any, from paths; partial counts before the shuffle."""
    up = paths.select(F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("id"))
    return up.groupBy("id").agg(F.count(F.lit(1)).alias("descendants"))


def descendants(paths: DataFrame) -> DataFrame:
    """One row for each pair of a node and a node below it: (id, descendant, steps)."""
    return paths.select(F.col("id").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "id")).where("pos < n - 1").select("id", "descendant", (F.col("n") - 1 - F.col("pos")).cast("bigint").alias("steps"))


def special_entries(entries: DataFrame, deep: int = 10, **kw) -> DataFrame:
    """Entries in trees at ``deep`` or more steps, in orphan trees, and on or under cycles."""
    h = entry_hierarchy(entries, with_path=False, **kw)
    return h.where(f"state <> 'tree' or depth >= {deep}").select("id", "root_id", F.col("depth").cast("bigint").alias("depth"), F.when(F.col("state") == TREE, "deep").otherwise(F.col("state")).alias("state"))
