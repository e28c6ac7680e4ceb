"""Approximate nearest neighbours by inner product: an NN-descent graph, searched greedily.

Equal vectors are one node. The graph starts from neighbours inside runs of nodes ordered along several random
directions, and is improved by NN-descent, until fewer than one in a hundred of its entries are new: each node meets
its neighbours and the nodes that have it as a neighbour, their vectors are joined in, all pairs of them with a newcomer
are scored, and each keeps the best found so far. For the graph, vectors get one more component that makes their lengths equal, so that largest inner product and nearest
agree; it is kept, and pairs are scored, as differences, so that a very long vector takes no digits from the others.
Lists are bounded by DEGREE in both directions; a hub's reverse list keeps those with the smallest hash.

A search walks the graph in rounds: all queries' unexpanded candidates are joined to their neighbour lists, whose
vectors (in eight-bit steps, each vector with its own step) stand beside them, and scored; each query keeps its BEAM best candidates, until none of
them is unexpanded. The best are scored anew on the original vectors in double precision, and nodes are replaced by
their members, the smallest ids first.

Edge cases: vectors that are null, zero, of a length other than the most frequent one, or hold a null or non-finite
component take no part; ties go to the smaller id; a query has fewer neighbours only if there are fewer vectors; an
empty table gives an empty result; rows of one id are told apart by their vectors: each is a query and a candidate of its
own, and rows of one id and one vector are one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

DEGREE = 24
BEAM = 256
#: NN-descent ends after so many rounds, settled or not: what it finds is measured as recall, not promised.
ROUNDS = 8
DIRECTIONS = 3
RUN = 400
#: Best candidates that one meeting hands to each of its nodes.
HANDED = 8
#: NN-descent stops when fewer than this share of list entries is new.
SETTLED = 0.01
RESCORED = 48


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rows_of(column: pa.Array, dtype) -> np.ndarray:
    """A matrix of the equally long binary values of a column."""
    if not len(column):
        return np.empty((0, 0), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def with_length(v: Column, dim: int, longest: float) -> Column:
    """The vector as 32-bit floats, with the longest length less the component that brings its own length to that."""

    @F.arrow_udf("binary")
    def extended(lists: pa.Array) -> pa.Array:
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        square = (x * x).sum(axis=1)
        depth = square / (np.sqrt(longest) + np.sqrt(np.maximum(0, longest - square)))
        return pa.array([r.tobytes() for r in np.hstack([x, depth[:, None]]).astype(np.float32)], pa.binary())

    return extended(v)


def closeness(x: np.ndarray) -> np.ndarray:
    """Less half the squared distance of all pairs: the inner product of equally long vectors, but for a constant."""
    half = np.einsum("ij,ij->i", x, x) / 2
    return x @ x.T - half[:, None] - half[None, :]


def along(v: Column, direction: np.ndarray) -> Column:
    @F.arrow_udf("float")
    def product(x: pa.Array) -> pa.Array:
        return pa.array(rows_of(x, np.float32) @ direction if len(x) else np.empty(0, np.float32))

    return product(v)


def first_graph(nodes: DataFrame, dim: int, count: int, degree: int) -> DataFrame:
    """node, other, sim: the nearest others in the node's runs."""
    found = None
    parts = max(1, min(count // (4 * RUN), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for k in range(DIRECTIONS):
        direction = np.random.default_rng(k).standard_normal(dim + 1).astype(np.float32)

        ordered = nodes.withColumn("at", along(F.col("v"), direction)).repartitionByRange(parts, "at").sortWithinPartitions("at", "node")
        own = ordered.select("node", "v").mapInArrow(runs_best(degree), "node long, other long, sim float")
        found = own if found is None else found.unionByName(own)
    return found


def runs_best(degree: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), rows_of(batch.column(1), np.float32)
            for a in range(0, len(ids), RUN):
                own, y = ids[a : a + RUN], x[a : a + RUN]
                sims = closeness(y)
                np.fill_diagonal(sims, -np.inf)
                k = min(degree, len(own) - 1)
                if k < 1:
                    continue
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)), pa.array(own[top].ravel()), pa.array(np.take_along_axis(sims, top, 1).ravel())], ["node", "other", "sim"])

    return best


def kept_best(found: DataFrame, degree: int) -> DataFrame:
    """The degree best others of each node, each once; new unless it was there before."""
    once = found.repartition("node").groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    return once.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= degree).drop("rank")


def both_ways(graph: DataFrame, degree: int) -> DataFrame:
    """node, other, new: the graph and up to degree reverse neighbours of each node."""
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "new")
    rank = Window.partitionBy("node").orderBy(F.desc("new"), F.xxhash64("other", "node"), "other")
    back = back.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= degree).drop("rank")
    return graph.select("node", "other", "new").unionByName(back).groupBy("node", "other").agg(F.max("new").alias("new"))


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores the pairs of each node's company; hands each member its best new ones above its worst neighbour."""
    for batch in batches:
        members = batch.column(0)
        flat = members.flatten()
        if not len(flat):
            continue
        ids, new, worst = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("other", "new", "worst"))
        x = rows_of(flat.field("v"), np.float32)
        ends = np.cumsum([0, *(len(m) for m in members)])
        out = ([], [], [])
        for a, b in zip(ends[:-1], ends[1:]):
            n = b - a
            if n < 2 or not new[a:b].any():
                continue
            sims = closeness(x[a:b])
            fresh = new[a:b]
            sims[~(fresh[:, None] | fresh[None, :])] = -np.inf
            np.fill_diagonal(sims, -np.inf)
            k = min(HANDED, n - 1)
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(sims, top, 1)
            row, col = np.nonzero(best > worst[a:b, None])
            out[0].append(ids[a + row])
            out[1].append(ids[a + top[row, col]])
            out[2].append(best[row, col])
        if out[0]:
            p, q, s = map(np.concatenate, out)
            # Meetings of one batch often find the same pair.
            _, at = np.unique(np.stack([p, q]), axis=1, return_index=True) if len(p) < 200_000 else (None, np.arange(len(p)))
            yield pa.RecordBatch.from_arrays([pa.array(p[at]), pa.array(q[at]), pa.array(s[at])], ["node", "other", "sim"])


def build_graph(nodes: DataFrame, dim: int, count: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """node, other, sim, new: NN-descent over nodes (node long, v binary)."""
    start = first_graph(nodes, dim, count, degree).withColumn("new", F.lit(True))
    graph = saved(kept_best(start, degree), "graph")
    for _ in range(rounds):
        worst = graph.groupBy("node").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        company = both_ways(graph, degree).withColumnRenamed("node", "center")
        carried = nodes.join(worst, "node").withColumnRenamed("node", "other")
        meetings = company.join(carried, "other").groupBy("center").agg(F.sort_array(F.collect_list(F.struct("other", "new", "worst", "v"))).alias("members"))
        found = meetings.select("members").mapInArrow(meet, "node long, other long, sim float").withColumn("new", F.lit(True))
        known = graph.withColumn("new", F.lit(False))
        graph = saved(kept_best(known.unionByName(found), degree), "graph")
        if graph.filter("new").count() <= SETTLED * count * degree:
            break
    return graph


def neighbour_lists(graph: DataFrame, nodes: DataFrame, dim: int, degree: int) -> DataFrame:
    """node, others array<long>, vs binary: each node's neighbours both ways, their vectors in eight-bit steps and, after each, its step."""

    @F.arrow_udf("binary")
    def small(v: pa.Array) -> pa.Array:
        x = rows_of(v, np.float32)[:, :dim] if len(v) else np.empty((0, dim), np.float32)
        step = np.abs(x).max(axis=1, initial=0) / 127
        codes = np.clip(np.rint(x / np.where(step > 0, step, 1)[:, None]), -127, 127).astype(np.int8)
        return pa.array([c.tobytes() + w.tobytes() for c, w in zip(codes, step.astype(np.float32))], pa.binary())

    pairs = both_ways(graph, degree).select("node", "other")
    vectors = nodes.select(F.col("node").alias("other"), small("v").alias("v"))
    lists = pairs.join(vectors, "other").groupBy("node").agg(F.collect_list(F.struct("other", "v")).alias("l"))
    return lists.select("node", F.transform("l", lambda x: x["other"]).alias("others"), F.expr("aggregate(l, X'', (a, x) -> a || x.v)").alias("vs"))


def scored(dim: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            query, worst = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            q = rows_of(batch.column(2), np.float32)[:, :dim]
            others, vs = batch.column(3), batch.column(4)
            ids = others.flatten().to_numpy()
            own = np.frombuffer(b"".join(vs.to_pylist()), np.dtype([("x", np.int8, (dim,)), ("step", np.float32)]))
            sizes = np.diff(np.cumsum([0, *(len(o) for o in others)]))
            row = np.repeat(np.arange(len(query)), sizes)
            sims = np.empty(len(ids), np.float32)
            for a in range(0, len(ids), 100_000):
                sims[a : a + 100_000] = np.einsum("ij,ij->i", own["x"][a : a + 100_000].astype(np.float32), q[row[a : a + 100_000]]) * own["step"][a : a + 100_000]
            keep = sims > worst[row]
            yield pa.RecordBatch.from_arrays([pa.array(query[row[keep]]), pa.array(ids[keep]), pa.array(sims[keep])], ["query", "node", "sim"])

    return score


def search(lists: DataFrame, queries: DataFrame, dim: int, beam: int = BEAM) -> DataFrame:
    """query, node, sim: the beam best nodes found for each query (query long, v binary), which is a node itself.

    Ends when all of each query's best nodes are expanded; each round expands some that never were, so that it ends.
    """
    beams = queries.select("query", F.col("query").alias("node"), F.lit(float("inf")).cast("float").alias("sim"), F.lit(False).alias("expanded"))
    beams = saved(beams, "beam")
    rank = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    while True:
        open_ = beams.filter("not expanded").select("query", "node")
        worst = beams.groupBy("query").agg(F.when(F.count("*") >= beam, F.min("sim")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        asked = open_.join(queries.join(worst, "query"), "query")
        pairs = asked.join(lists, "node").select("query", "worst", "v", "others", "vs")
        found = pairs.mapInArrow(scored(dim), "query long, node long, sim float").withColumn("expanded", F.lit(False))
        merged = beams.withColumn("expanded", F.lit(True)).unionByName(found).repartition("query").groupBy("query", "node").agg(F.max("sim").alias("sim"), F.max("expanded").alias("expanded"))
        beams = saved(merged.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= beam).drop("rank"), "beam")
        if beams.filter("not expanded").isEmpty():
            break
    return beams.select("query", "node", "sim")


def exact(a: str, b: str) -> Column:
    @F.arrow_udf("double")
    def product(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        m, n = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) for c in (x, y))
        return pa.array(np.einsum("ij,ij->i", m, n))

    return product(F.col(a), F.col(b))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each row that is_query holds for."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter("id is not null")
    rows = rows.filter(usable(F.col("vec")))
    most = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    dim = most["dim"] if most else 1
    rows = rows.filter(F.size("vec") == dim)
    # k + 1 members of a class are enough for any query; a hot class is cut in each partition before the shuffle.
    rank = Window.partitionBy("vec").orderBy("id")
    members = rows.select("vec", "id").distinct().withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= k + 1)
    members = saved(members.withColumn("node", F.min("id").over(Window.partitionBy("vec"))), "members")
    firsts = members.filter("place = 1")
    if not firsts.groupBy("node").count().filter("count > 1").isEmpty():
        # A class is numbered by its smallest id; where that is another class's too, by a hash of the id and the vector's place.
        r = F.row_number().over(Window.partitionBy("node").orderBy("vec"))
        numbers = saved(firsts.withColumn("r", r).select("vec", F.when(F.col("r") == 1, F.col("node")).otherwise(F.xxhash64("node", "r")).alias("node")), "classes")
        members = saved(members.drop("node").join(numbers, "vec"), "members")
    heads = members.filter("place = 1").select("node", "vec")
    square = F.aggregate(F.transform("vec", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    facts = heads.agg(F.count("*").alias("n"), F.max(square).alias("longest")).head()
    count, longest = facts["n"], facts["longest"] or 1.0
    nodes = saved(heads.select("node", with_length(F.col("vec"), dim, longest).alias("v")), "nodes")
    graph = build_graph(nodes, dim, count, degree)
    lists = saved(neighbour_lists(graph, nodes, dim, degree), "lists")
    asks = saved(rows.filter("asks").select("id", "vec").distinct().join(heads, "vec").select(F.col("id").alias("query_id"), F.col("node").alias("own")), "queries")
    queries = saved(asks.select(F.col("own").alias("query")).distinct().join(nodes.withColumnRenamed("node", "query"), "query"), "query-nodes")
    found = search(lists, queries, dim, beam)
    # A query's own node counts as found, with its members but the query itself.
    found = found.unionByName(queries.select("query", F.col("query").alias("node"), F.lit(float("inf")).cast("float").alias("sim"))).groupBy("query", "node").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + RESCORED).select("query", "node")
    best = best.join(heads.withColumnRenamed("vec", "x"), "node").join(heads.select(F.col("node").alias("query"), F.col("vec").alias("y")), "query")
    best = best.select("query", "node", exact("x", "y").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    best = saved(best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1), "best")
    pairs = asks.withColumn("query", F.col("own")).join(best, "query").join(members.select("node", "id"), "node").filter((F.col("id") != F.col("query_id")) | (F.col("node") != F.col("own")))
    order = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "id", "node")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
