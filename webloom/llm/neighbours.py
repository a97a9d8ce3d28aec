"""Operator 12: approximate nearest neighbours on an NN-descent graph.

``build`` starts from a few random partitionings: rows sorted by the signs of
random projections are cut into blocks of ``BLOCK`` vectors, and the nearest
ones within a block are first neighbours. Then come rounds of NN-descent as
Spark joins. Every vector is a pivot: a sample of its neighbours and of the
vectors that name it as one (new edges and old ones apart) meets in one row,
and each pair of them with a new edge, neighbours of neighbours, is offered
to the other if it is nearer than its present last neighbour. The ``DEGREE``
nearest stay. Rounds end when few lists change.

``search`` walks the graph from given entry points: each round joins the
nearest unvisited vectors of a query's beam with their edges in both
directions, joins the vectors of what is new, and keeps the ``BEAM`` nearest,
until a beam has nothing left to visit.

Building and walking use half-precision copies of the centred vectors; the
result is ranked by Euclidean distance in double precision on the vectors
as given. Equal vectors are one node of the graph; the result names the
copies with the smallest ids.

Vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without id and vectors whose length is not the most
frequent one (of ties: the smallest). If an id has several vectors, the
smallest in array order counts. An empty table gives no rows. Only the two
named columns are read, so further columns do not matter. Nothing but a
vector's mean, a scale and counts reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import configure
from .base import release, stage

DEGREE = 32        # neighbours kept
TREES = 4          # random partitionings to start from
FIRST = 16         # neighbours that each of them proposes
BLOCK = 2048       # vectors compared with each other in a block
SAMPLE = 16        # new and old members of a pivot
ROUNDS = 6
SETTLED = 0.01     # share of changed neighbours below which rounds end
BEAM = 192         # candidates that a query keeps
VISIT = 64         # of them visited in one round
SEED = 20


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """float32 rows of a binary column of half-precision vectors."""
    _, off, data = col.buffers()
    at = int(np.frombuffer(off, np.int32)[col.offset]) if len(col) else 0
    raw = np.frombuffer(data, np.float16, count=len(col) * dim, offset=at) if len(col) else np.zeros(0, np.float16)
    return raw.reshape(-1, dim).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, np.float16)
    width = rows.shape[1] * 2
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _flat(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all elements, row of each element) of a list column; null lists are empty."""
    counts = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return col.flatten(), np.repeat(np.arange(len(col)), counts)


def _first_of_run(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of the sorted keys differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _rank(rows: np.ndarray) -> np.ndarray:
    """Number of earlier elements of the same (sorted) row."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vec): one usable vector per id, all of one length."""
    kind = "array<float>" if table.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    src = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast(kind).alias("vec"))
    fit = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    src = src.where(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False)))
    size = src.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").head()
    return src.where(F.size("vec") == (size.size if size else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def nodes(points: DataFrame) -> DataFrame:
    """(id, vec, half): each distinct vector under its smallest id, with a
    centred half-precision copy."""
    distinct = stage(points.groupBy("vec").agg(F.min("id").alias("id")), "vectors")
    stats = distinct.select(F.posexplode("vec").alias("at", "x")).groupBy("at") \
        .agg(F.avg("x").alias("mean"), F.max(F.abs("x")).alias("top")).orderBy("at").collect()    # one row per component
    mean = np.array([r.mean for r in stats])
    scale = 2 * max([r.top for r in stats], default=1.0)

    def halved(batches):
        for b in batches:
            vec = b.column(1)
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), vec, _binary((x - mean) / scale if len(x) else x)], names=["id", "vec", "half"])

    out = distinct.select("id", "vec")
    return stage(out.mapInArrow(halved, f"id long, vec {out.schema['vec'].dataType.simpleString()}, half binary"), "nodes")


def _first_graph(points: DataFrame, dim: int, n: int) -> DataFrame:
    """(id, cand, cdist): proposals of all blocks a vector is in."""
    bits = max(0, math.ceil(math.log2(max(1, n / BLOCK))))

    def placed(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            for tree in range(TREES):
                z = x @ np.random.default_rng([SEED, tree]).normal(size=(dim, bits + 1)).astype(np.float32)
                code = ((z[:, :bits] > 0) * (1 << np.arange(bits))[::-1]).sum(axis=1) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(code.astype(np.int64)), pa.array(z[:, bits]),
                                                  b.column(0), b.column(1)], names=["tree", "code", "proj", "id", "half"])

    def nearest(ids: np.ndarray, x: np.ndarray):
        k = min(FIRST, len(ids) - 1)
        if k < 1:
            return
        norm = (x * x).sum(axis=1)
        for lo in range(0, len(ids), 512):
            hi = min(lo + 512, len(ids))
            d = np.maximum(norm[lo:hi, None] + norm[None] - 2 * x[lo:hi] @ x.T, 0)
            d[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            counts = np.full(hi - lo, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), _lists(ids[best].ravel(), counts),
                                              _lists(np.take_along_axis(d, best, 1).ravel(), counts)], names=["id", "cand", "cdist"])

    def blocks(batches):
        held, count, tree = [], 0, None

        def cut(size):
            nonlocal held, count
            ids, x = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held, count = ([(ids[size:], x[size:])], len(ids) - size) if size < len(ids) else ([], 0)
            return nearest(ids[:size], x[:size])

        for b in batches:
            trees, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim)
            for t in np.unique(trees):
                if t != tree and count:
                    yield from cut(count)
                tree = t
                held.append((ids[trees == t], x[trees == t]))
                count += len(held[-1][0])
                while count >= 2 * BLOCK:
                    yield from cut(BLOCK)
        if count:
            yield from cut(count)

    rows = points.select("id", "half").mapInArrow(placed, "tree int, code long, proj float, id long, half binary")
    parts = max(1, TREES * n // (4 * BLOCK))
    dealt = rows.repartitionByRange(parts, "tree", "code", "proj", "id").sortWithinPartitions("tree", "code", "proj", "id")
    found = dealt.select("tree", "id", "half").mapInArrow(blocks, "id long, cand array<long>, cdist array<float>")
    lists = F.collect_list(F.struct("cand", "cdist"))                       # one element per partitioning
    return found.groupBy("id").agg(lists.alias("g")).select(
        "id", F.flatten(F.transform("g", lambda x: x["cand"])).alias("cand"), F.flatten(F.transform("g", lambda x: x["cdist"])).alias("cdist"))


GRAPH = "id long, half binary, nbr array<long>, dist array<float>, fresh array<boolean>"


def _merged(graph: DataFrame, offers: DataFrame) -> DataFrame:
    """``graph`` with the offered (id, cand, cdist) neighbours, nearest first."""
    def run(batches):
        for b in batches:
            (nbr, row), (dist, _), (cand, crow), (cdist, _) = (_flat(b.column(i)) for i in range(2, 6))
            rows, ids = np.concatenate([row, crow]), np.concatenate([nbr.to_numpy(), cand.to_numpy()])
            d = np.concatenate([dist.to_numpy(), cdist.to_numpy()]).astype(np.float32)
            fresh = np.repeat([False, True], [len(row), len(crow)])
            order = np.lexsort((fresh, ids, rows))
            rows, ids, d, fresh = rows[order], ids[order], d[order], fresh[order]
            keep = _first_of_run(rows, ids)
            rows, ids, d, fresh = rows[keep], ids[keep], d[keep], fresh[keep]
            order = np.lexsort((ids, d, rows))
            order = order[_rank(rows[order]) < DEGREE]
            counts = np.bincount(rows[order], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(ids[order], counts), _lists(d[order], counts), _lists(fresh[order], counts)],
                                             names=["id", "half", "nbr", "dist", "fresh"])

    return graph.join(offers, "id", "left").select("id", "half", "nbr", "dist", "cand", "cdist").mapInArrow(run, GRAPH)


def _offers(graph: DataFrame, dim: int, turn: int) -> DataFrame:
    """(id, cand, cdist) from one round: neighbours of neighbours that are
    nearer than the last neighbour."""
    edges = graph.select("id", F.explode(F.arrays_zip("nbr", "fresh")).alias("e")).select("id", F.col("e.nbr").alias("nbr"), F.col("e.fresh").alias("fresh"))
    both = F.explode(F.array(F.struct(F.col("id").alias("pivot"), F.col("nbr").alias("member")),
                             F.struct(F.col("nbr").alias("pivot"), F.col("id").alias("member")))).alias("p")
    lot = F.row_number().over(Window.partitionBy("pivot", "fresh").orderBy(F.xxhash64("pivot", "member", F.lit(turn)), "member"))
    members = edges.select("fresh", both).select("p.*", "fresh").withColumn("lot", lot).where(f"lot <= {SAMPLE}")
    last = F.when(F.size("dist") == DEGREE, F.array_max("dist")).otherwise(F.lit(float("inf")).cast("float"))
    known = graph.select(F.col("id").alias("member"), last.alias("last"), "half")
    rows = members.join(known, "member").groupBy("pivot").agg(F.collect_list(F.struct("member", "fresh", "last", "half")).alias("m"))  # 4 * SAMPLE at most

    def run(batches):
        for b in batches:
            flat, row = _flat(b.column(0))
            member, fresh, last, half = flat.flatten()
            if not len(row):
                continue
            at, width = _rank(row), int(_rank(row).max()) + 1
            shape = (b.num_rows, width)
            ids, new, far = np.full(shape, -1, np.int64), np.zeros(shape, bool), np.full(shape, -np.inf, np.float32)
            here = np.zeros(shape, bool)
            x = np.zeros((*shape, dim), np.float32)
            ids[row, at], new[row, at], far[row, at], here[row, at] = member.to_numpy(), fresh.to_numpy(zero_copy_only=False), last.to_numpy(), True
            x[row, at] = _matrix(half, dim)
            norm = (x * x).sum(axis=2)
            d = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * x @ x.transpose(0, 2, 1), 0)
            good = here[:, :, None] & here[:, None, :] & (ids[:, :, None] != ids[:, None, :]) & (new[:, :, None] | new[:, None, :]) & (d < far[:, :, None])
            p, i, j = np.nonzero(good)
            a, c, dd = ids[p, i], ids[p, j], d[p, i, j]
            order = np.lexsort((c, a))
            order = order[_first_of_run(a[order], c[order])]
            yield pa.RecordBatch.from_arrays([pa.array(a[order]), pa.array(c[order]), pa.array(dd[order])], names=["id", "cand", "cdist"])

    pairs = rows.select("m").mapInArrow(run, "id long, cand long, cdist float").groupBy("id", "cand").agg(F.min("cdist").alias("cdist"))
    near = F.row_number().over(Window.partitionBy("id").orderBy("cdist", "cand"))
    best = pairs.withColumn("near", near).where(f"near <= {DEGREE}")
    return best.groupBy("id").agg(F.collect_list(F.struct("cand", "cdist")).alias("g")).select(
        "id", F.transform("g", lambda x: x["cand"]).alias("cand"), F.transform("g", lambda x: x["cdist"]).alias("cdist"))


def build(points: DataFrame) -> DataFrame:
    """(id, half, nbr, dist, fresh): the neighbour graph of ``nodes``, nearest
    neighbours first, squared distances of the scaled copies."""
    n = points.count()
    dim = (points.select(F.size("vec").alias("dim")).head() or [0])[0]
    empty = points.select("id", "half", F.array().cast("array<long>").alias("nbr"), F.array().cast("array<float>").alias("dist"))
    graph = stage(_merged(empty, _first_graph(points, dim, n)), "graph")
    for turn in range(ROUNDS if n > BLOCK else 0):                       # one block: the first lists are exact
        nxt = stage(_merged(graph, _offers(graph, dim, turn)), "graph")
        release(graph)
        graph = nxt
        changed = graph.select(F.sum(F.size(F.filter("fresh", lambda x: x)))).head()[0] or 0
        if changed <= SETTLED * n * DEGREE:
            break
    return graph


def edges_both_ways(graph: DataFrame) -> DataFrame:
    """(id, nbr): neighbours, and the nearest ``DEGREE`` that name the vector as theirs."""
    flat = graph.select("id", F.explode(F.arrays_zip("nbr", "dist")).alias("e")).select("id", F.col("e.nbr").alias("nbr"), F.col("e.dist").alias("d"))
    near = F.row_number().over(Window.partitionBy("nbr").orderBy("d", "id"))
    back = flat.withColumn("near", near).where(f"near <= {DEGREE}").groupBy(F.col("nbr").alias("id")).agg(F.collect_list("id").alias("back"))
    return graph.select("id", "nbr").join(back, "id", "left") \
        .select("id", F.array_union("nbr", F.coalesce("back", F.array().cast("array<long>"))).alias("nbr"))


STATE = "query long, half binary, ids array<long>, dist array<float>, open array<boolean>, seen array<long>, todo array<long>"


def search(graph: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, ids): up to ``BEAM`` near nodes of every query (query, half,
    entry), a vector prepared like the graph's and the node to start from."""
    edges = stage(edges_both_ways(graph), "edges")
    none = lambda t: F.array().cast(f"array<{t}>")
    now = stage(queries.select("query", "half", none("long").alias("ids"), none("float").alias("dist"), none("boolean").alias("open"),
                               none("long").alias("seen"), F.array("entry").alias("todo")), "beams")
    first = True

    def step(batches):
        for b in batches:
            out = []
            for half, ids, dist, is_open, seen, new in zip(b.column(1).to_pylist(), *(
                    [np.asarray(x.values) for x in b.column(i)] for i in range(2, 6)), b.column(6)):
                q = np.frombuffer(half, np.float16).astype(np.float32)
                cand, raw = new.values.flatten() if len(new) else (pa.array([], pa.int64()), pa.array([], pa.binary()))
                cand = cand.to_numpy()
                d = ((_matrix(raw, len(q)) - q) ** 2).sum(axis=1)
                ids, dist, is_open = np.concatenate([ids, cand]), np.concatenate([dist, d]), np.concatenate([is_open.astype(bool), np.ones(len(cand), bool)])
                best = np.lexsort((ids, dist))[:BEAM]
                ids, dist, is_open = ids[best].astype(np.int64), dist[best].astype(np.float32), is_open[best]
                visit = np.flatnonzero(is_open)[:VISIT]
                is_open[visit] = False
                out.append((ids, dist, is_open, np.concatenate([seen, cand]).astype(np.int64) if len(visit) else ids[:0], ids[visit]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)] + [
                _lists(np.concatenate([o[i] for o in out]), np.array([len(o[i]) for o in out])) for i in range(5)],
                names=["query", "half", "ids", "dist", "open", "seen", "todo"])

    while first or not now.where("size(todo) > 0").isEmpty():
        asked = now.select("query", F.explode("todo").alias("id"))
        # a query visits VISIT nodes of 2 * DEGREE edges at most
        found = asked.join(edges, "id").groupBy("query").agg(F.flatten(F.collect_list("nbr")).alias("cand"))
        if first:       # the entry is a candidate itself
            found = found.join(now.select("query", "todo"), "query", "right").select("query", F.concat("todo", F.coalesce("cand", none("long"))).alias("cand"))
        fresh = found.join(now.select("query", "seen"), "query").select("query", F.explode(F.array_except("cand", "seen")).alias("id"))
        got = fresh.join(graph.select("id", F.col("half").alias("vec")), "id").groupBy("query").agg(F.collect_list(F.struct("id", "vec")).alias("new"))
        nothing = F.array().cast("array<struct<id:bigint,vec:binary>>")
        rows = now.join(got, "query", "left").select("query", "half", "ids", "dist", "open", "seen", F.coalesce("new", nothing).alias("new"))
        nxt = stage(rows.mapInArrow(step, STATE), "beams")
        release(now)
        now, first = nxt, False
    return now.select("query", "ids")


def nearest(table: DataFrame, is_query, top: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row that ``is_query``
    (a predicate on the id) picks, the ``top`` nearest other rows found."""
    configure(table.sparkSession)
    points = stage(vectors(table, vec_id, embedding), "points")
    base = nodes(points)
    graph = build(base)
    asked = points.where(is_query(F.col("id"))).select(F.col("id").alias("query"), "vec")
    asked = stage(asked.join(base.select("vec", "half", F.col("id").alias("entry")), "vec"), "asked")
    found = search(graph, asked.select("query", "half", "entry")).select("query", F.explode("ids").alias("node"))
    # the copies of a vector with the smallest ids, under their node
    each = Window.partitionBy("vec")
    copies = points.withColumn("n", F.row_number().over(each.orderBy("id"))).where(f"n <= {int(top) + 1}") \
        .select(F.min("id").over(each).alias("node"), "id")
    rows = found.join(base.select(F.col("id").alias("node"), F.col("vec").alias("other")), "node") \
        .join(asked.select("query", "vec"), "query")
    square = F.zip_with("vec", "other", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    scored = rows.select("query", "node", F.sqrt(F.aggregate(square, F.lit(0.0), lambda a, x: a + x)).alias("score"))
    named = scored.join(copies, "node").where("id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    return named.withColumn("rank", rank).where(f"rank <= {int(top)}") \
        .select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
