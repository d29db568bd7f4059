"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and broadcast; every vector is filed under a leaf. A
query walks the tree best bin first: a priority queue holds the unopened nodes by what
their centre and spread promise, and leaves are visited in the order they come out. How many
is found by widening the visits until a set of calibration queries, whose true neighbours
are searched among all rows, reaches the wanted recall.

Equal vectors are searched once: of each distinct vector the k + 1 smallest ids are kept,
which are all that can be among a query's k nearest when ties go to the smaller id. Queries
and vectors meet by groups of neighbouring leaves, cut into blocks on both sides, so no task
holds more than a block of each, however large a leaf is.

Defined results: a vector that is null, zero, of another length than most, or that holds a
null or non-finite component takes no part, nor does a row without id; rows that repeat an
id count as one neighbour and as one query, at the nearest of their vectors; a query that has fewer candidates gets all of them; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorvia.llm.common import cut

#: The sample of the fit: rows, and bytes as doubles.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
BRANCHES, LEAF_ROWS, ROUNDS = 32, 16, 8
CALIBRATION_QUERIES = 200
#: Leaves that share a group, and rows of a block of vectors or queries; queries are scored a few at a time.
GROUP_LEAVES, BLOCK_VECTORS, BLOCK_QUERIES, QUERIES_AT_ONCE = 64, 8192, 4096, 256


@dataclass
class Tree:
    """Nodes in the order they were made; leaves are numbered from left to right."""

    centre: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    n_leaves: int
    held: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest centres."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centre[self.children[node]]
                near = np.argmin((c * c).sum(1) - 2 * (x[rows] @ c.T), axis=1)
                todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        promise = (self.centre @ q + np.sqrt(q @ q) * self.spread).tolist()
        queue = [(-promise[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
            for child in self.children[node]:
                heapq.heappush(queue, (-promise[child], child))

    def chosen(self, q: np.ndarray, n: int, least: int) -> list[int]:
        """The first n leaves, and on until they hold ``least`` rows."""
        out, rows = [], 0
        for leaf in self.visits(q):
            if len(out) >= n and rows >= least:
                break
            out.append(leaf)
            rows += int(self.held[leaf])
        return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        for i in range(k):
            if len(own := x[near == i]):
                c[i] = own.mean(0)
    return near


def grow(x: np.ndarray, seed: int = 7) -> Tree:
    """The tree of a sample; a node's rows are split until few or alike."""
    rng = np.random.default_rng(seed)
    centre, spread, children, leaf = [], [], [], []
    n_leaves = 0

    def add(rows: np.ndarray) -> int:
        nonlocal n_leaves
        node = len(centre)
        c = rows.mean(0)
        centre.append(c)
        spread.append(float(np.sqrt(((rows - c) ** 2).sum(1).mean() / rows.shape[1])))
        children.append([])
        leaf.append(-1)
        if len(rows) > LEAF_ROWS:
            near = k_means(rows, max(2, min(BRANCHES, -(-len(rows) // LEAF_ROWS))), rng)
            parts = [p for i in range(near.max() + 1) if len(p := rows[near == i])]
            if len(parts) > 1:
                children[node] = [add(p) for p in parts]
        if not children[node]:
            leaf[node] = n_leaves
            n_leaves += 1
        return node

    add(x)
    return Tree(np.array(centre), np.array(spread), children, leaf, n_leaves)


def usable(vector: Column) -> Column:
    """Not null, nor zero, nor with a null or non-finite component."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda c: c != 0)


def nearest_ids(scores: np.ndarray, at: np.ndarray, ids: list[np.ndarray], k: int) -> list[tuple[float, int]]:
    """The k best (negative score, id), each id at its best score."""
    out: dict[int, float] = {}
    for s, v in sorted((-s, int(v)) for s, j in zip(scores.tolist(), at.tolist(), strict=True) for v in ids[j][:k]):
        if v not in out:
            out[v] = s
            if len(out) == k:
                break
    return [(s, v) for v, s in out.items()]


def best(q: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int, open_to: np.ndarray | None = None) -> list[tuple[list[int], list[float]]]:
    """For each row of q the k best ids of the rows of x (each with its sorted ids), and scores.

    open_to: which rows of x each row of q looks at; all if not given.
    """
    if not len(x):
        return [([], [])] * len(q)
    sizes, longest = np.sqrt((q * q).sum(1)), float(np.sqrt((x * x).sum(1).max()))
    out = []
    for first in range(0, len(q), QUERIES_AT_ONCE):
        some = slice(first, first + QUERIES_AT_ONCE)
        rough = q[some] @ x.T
        if open_to is not None:
            rough[~open_to[some]] = -np.inf
        # all that tie with the k-th, up to rounding, which grows with the vectors' lengths
        last = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(rough), -np.inf)
        least = np.where(np.isfinite(last), last - 1e-12 * sizes[some] * longest, np.finfo(np.float64).min)
        for i, near in enumerate(rough >= least[:, None]):
            at = np.flatnonzero(near)
            exact = (x[at] * q[first + i]).sum(1)  # the same sum wherever the row lies
            found = nearest_ids(exact, at, ids, k)
            if len(found) < k and len(at) < len(x):  # an id with several vectors takes one place only
                at = np.arange(len(x)) if open_to is None else np.flatnonzero(open_to[first + i])
                found = nearest_ids((x[at] * q[first + i]).sum(1), at, ids, k)
            out.append(([v for _, v in found], [-s for s, _ in found]))
    return out


def stacked(binary: pd.Series | list, kind: str) -> np.ndarray:
    values = list(binary)
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64) if values else np.zeros((0, 0))


def nearest(
    vectors: DataFrame, queries: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, report: dict | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for rows where ``queries`` holds, the k rows with the
    largest inner product among all others found.

    recall: mean share of true neighbours that the calibration queries must find.
    report: gets leaves, visits, the calibrated recall, and the share of all rows that the
    calibration queries' leaves hold.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queries.alias("asks"))
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    # -0.0 equals 0.0
    rows = rows.withColumn("v", F.transform("v", lambda c: F.when(c == 0, 0).otherwise(c).cast("float" if kind == "<f4" else "double")))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = common[0]["dim"] if common else 1
    rows = rows.where(F.size("v") == dim)
    few = max(100, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    # without shuffling vectors: the sample's ids first
    sample = rows.select("id", "v").join(F.broadcast(rows.select("id").orderBy(F.xxhash64("id"), "id").limit(few)), "id", "left_semi").toPandas()
    sample = sample.sort_values("id")
    x = np.stack(sample["v"].to_list()).astype(np.float64) if len(sample) else np.zeros((1, dim))
    tree = grow(x)

    # distinct vectors with their smallest ids; the limit is applied before the shuffle
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = rows.select("id", "v").withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    shared = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1)
                leaf = shared.value.assign(v.astype(np.float64))
                binary = [r.tobytes() for r in v.astype(kind)]
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(binary, pa.binary()), b.column("ids")], ["leaf", "x", "ids"])

    filed = cut(distinct.mapInArrow(file, "leaf int, x binary, ids array<long>"), "ann-leaves")
    counts = {r["leaf"]: r for r in filed.groupBy("leaf").agg(F.sum(F.size("ids")).alias("held"), F.count("*").alias("rows")).collect()}  # as many as leaves
    tree.held = np.array([counts[i]["held"] if i in counts else 0 for i in range(tree.n_leaves)], np.int64)

    # calibration against all rows
    numbered = rows.where("asks").groupBy("v").agg(F.min("id").alias("own")).withColumn("rep", F.monotonically_increasing_id())
    asked = cut(numbered, "ann-queries")  # so that the vectors keep their numbers
    probes = asked.orderBy(F.xxhash64("own"), "own", "rep").limit(CALIBRATION_QUERIES).collect()
    pq = np.array([r["v"] for r in probes], np.float64).reshape(len(probes), -1) if probes else np.zeros((0, dim))
    probe = spark.sparkContext.broadcast(pq)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in probe.value]  # of each probe, the best (-score, id, leaf) so far
        for b in batches:
            v = stacked(b.column("x").to_pylist(), kind)
            ids, leaf = [np.array(i) for i in b.column("ids").to_pylist()], b.column("leaf").to_pylist()
            at: dict[int, list[int]] = {}
            for row, own in enumerate(ids):
                for i in own.tolist():
                    at.setdefault(i, []).append(row)
            for mine, q, (found, score) in zip(held, probe.value, best(probe.value, v, ids, k + 1), strict=True):
                mine += [(-s, i, leaf[max(at[i], key=lambda row: float((v[row] * q).sum()))]) for i, s in zip(found, score, strict=True)]
                mine.sort()
                del mine[k + 1 :]
        out = [(p, -s, i, n) for p, mine in enumerate(held) for s, i, n in mine]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], ["p", "score", "id", "leaf"])

    visits, reached = 1, 1.0
    if len(pq):
        top = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "id"))
        true = filed.mapInArrow(exact, "p int, score double, id long, leaf int").withColumn("n", top).where(F.col("n") <= k + 1).collect()  # probes times k
        wanted: dict[int, list[int]] = {}
        for r in sorted(true, key=lambda r: r["n"]):
            mine = wanted.setdefault(r["p"], [])
            if r["id"] != probes[r["p"]]["own"] and len(mine) < k:
                mine.append(r["leaf"])
        places = [{leaf: n for n, leaf in enumerate(tree.visits(q))} for q in pq]
        ranks = np.array([places[p][leaf] for p, leaves in wanted.items() for leaf in leaves])
        while visits < tree.n_leaves and len(ranks) and (reached := float((ranks < visits).mean())) < recall:
            visits += 1
        reached = float((ranks < visits).mean()) if len(ranks) else 1.0
    if report is not None:
        share = [tree.held[tree.chosen(q, visits, k + 1)].sum() / tree.held.sum() for q in pq]
        report |= {"leaves": tree.n_leaves, "visits": visits, "recall": reached, "visited_rows": float(np.mean(share)) if share else 0.0}
    shared_tree = spark.sparkContext.broadcast(tree)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1)
            out: list[tuple] = []
            for rep, q in zip(b.column("rep").to_pylist(), v, strict=True):
                by_group: dict[int, list[int]] = {}
                for leaf in shared_tree.value.chosen(q.astype(np.float64), visits, k + 1):
                    by_group.setdefault(leaf // GROUP_LEAVES, []).append(leaf)
                out += [(rep, q.astype(kind).tobytes(), g, leaves) for g, leaves in by_group.items()]
            types = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["rep", "q", "grp", "leaves"])

    sent = cut(asked.select("rep", "v").mapInArrow(walk, "rep long, q binary, grp int, leaves array<int>"), "ann-visits")
    n_queries = {r["grp"]: r["count"] for r in sent.groupBy("grp").count().collect()}  # as many as groups
    n_vectors: dict[int, int] = {}
    for leaf, r in counts.items():
        n_vectors[leaf // GROUP_LEAVES] = n_vectors.get(leaf // GROUP_LEAVES, 0) + r["rows"]
    groups = sorted(n_vectors)
    sizes = spark.createDataFrame([(g, -(-n_vectors[g] // BLOCK_VECTORS), -(-n_queries.get(g, 0) // BLOCK_QUERIES)) for g in groups], "grp int, nv int, nq int")
    sizes = F.broadcast(sizes)  # a row for each group of leaves
    v_side = filed.withColumn("grp", F.expr(f"leaf div {GROUP_LEAVES}").cast("int")).join(sizes, "grp").withColumn("vb", F.pmod(F.xxhash64("x"), F.col("nv")).cast("int"))
    v_side = v_side.where("nq > 0").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("grp", "vb", "qb", "leaf", "x", "ids")
    q_side = sent.join(sizes, "grp").withColumn("qb", F.pmod(F.xxhash64("rep"), F.col("nq")).cast("int"))
    q_side = q_side.withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))).select("grp", "vb", "qb", "rep", "q", "leaves")

    def compare(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        q, x, leaf = stacked(asks["q"], kind), stacked(held["x"], kind), held["leaf"].to_numpy()
        ids = held["ids"].to_list()
        # leaves of the group by their numbers from its first; a query sees the rows of those it visits
        wanted = np.zeros((len(q), GROUP_LEAVES), bool)
        for i, leaves in enumerate(asks["leaves"]):
            wanted[i, np.asarray(leaves) % GROUP_LEAVES] = True
        mine = [[(-s, v) for v, s in zip(found, score, strict=True)] for found, score in best(q, x, ids, k + 1, wanted[:, leaf % GROUP_LEAVES])]
        return pd.DataFrame({"rep": asks["rep"], "found": [[v for _, v in m] for m in mine], "score": [[-s for s, _ in m] for m in mine]})

    keys = ["grp", "vb", "qb"]
    partial = q_side.groupBy(*keys).cogroup(v_side.groupBy(*keys)).applyInPandas(compare, "rep long, found array<long>, score array<double>")
    # a negative score first, so that the smallest pair is the nearest with the smallest id
    pairs = F.transform(F.arrays_zip("found", "score"), lambda p: F.struct((-p["score"]).alias("s"), p["found"].alias("id")))
    every = partial.select("rep", F.explode(pairs).alias("p")).groupBy("rep", F.col("p.id").alias("vec_id")).agg(F.min("p.s").alias("s"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("s", "vec_id"))
    near = every.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("rep").agg(F.collect_list(F.struct("vec_id", "s")).alias("near"))
    by_vector = asked.select("rep", "v").join(near, "rep").select("v", "near")
    # an id is as near as the nearest of its vectors
    found = rows.where("asks").select(F.col("id").alias("query_id"), "v").distinct().join(by_vector, "v").select("query_id", F.explode("near").alias("p")).where("p.vec_id <> query_id")
    found = found.groupBy("query_id", F.col("p.vec_id").alias("vec_id")).agg(F.min("p.s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("s", "vec_id")).cast("int")
    return found.select("query_id", rank.alias("rank"), "vec_id", (-F.col("s")).alias("score")).where(F.col("rank") <= k)
