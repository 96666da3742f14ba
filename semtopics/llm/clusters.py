"""Problem 2: clusters of mutually similar records by Markov clustering.

Plan. (1) ``n_nodes`` records (those of lowest id hash) become pivots; then, pass by pass,
records less similar than ``cover`` to every pivot become pivots too, until there are none, so
a small group away from the others owns a pivot however small its share is. Every record joins
its nearest pivot's cell and one pass sums the vectors of each cell (as whole numbers, so the sums
don't depend on partitions). (2) The cells' mean vectors are the nodes of a similarity graph (edges
of cosine at least ``min_similarity``, weighted by the cells' sizes). (3) Markov clustering on it: the
column-stochastic flow matrix, kept as (i, j, v) rows, is squared by a distributed join and
group-by, inflated and pruned until it settles. Attractor rows define the clusters; a column
belongs to the attractor of its strongest flow. (4) A record is a column of its own: its
similarities to the pivots of at least ``min_similarity``, inflated by ``sharpness``, are its flow to
them, which the settled matrix carries on to the attractors; it belongs to the cluster that gets
most of it, with that share as its ``flow``. A cluster's centroid is the mean of its cells weighted
by their flow to its attractor. So the work on records is linear and free of shuffles,
while the graph's size follows the spread of the vectors, not their number; only pivots' vectors
move, and (id, cluster, distance, flow) rows.

Edge cases: null, ragged, non-finite and zero vectors have no direction and give no rows; a
record delivered twice counts once in the result; ties go to the lower cluster number;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotConverged
from ..plans.store import drop_table, materialize


def _unit_rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the usable rows of a batch (id, embedding)."""
    column = batch.column(1)
    ok = np.nan_to_num(np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), dtype=float), nan=-1) == dim
    rows = np.flatnonzero(ok)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 1e-12)
    return rows[good], (x[good] / norm[good, None]).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    at, sim = np.empty(len(x), np.int32), np.empty(len(x), np.float32)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ centres.T
        at[i : i + block] = s.argmax(1)
        sim[i : i + block] = s[np.arange(len(s)), at[i : i + block]]
    return at, sim


#: Coordinates are added up in units of this, so sums are exact in any order (up to 5 * 10**11 rows).
_UNIT = float(2**24)


def cell_sums(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, n, total): numbers of rows and exact sums of unit vectors by nearest pivot."""
    dim = pivots.shape[1]

    def add(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(pivots), np.int64), np.zeros(pivots.shape, np.int64)
        for batch in batches:
            for at, n, x in read(batch):
                np.add.at(count, at, n)
                np.add.at(total, at, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cell", "n", "total"])

    def rows(batch: pa.RecordBatch):
        _, x = _unit_rows(batch, dim)
        for i in range(0, len(x), 8192):
            part = x[i : i + 8192]
            at, _ = _nearest(part, pivots)
            order = np.argsort(at, kind="stable")
            cells, first, n = np.unique(at[order], return_index=True, return_counts=True)
            yield cells, n, np.add.reduceat(np.rint(part[order] * _UNIT).astype(np.int64), first, axis=0)

    def sums(batch: pa.RecordBatch):
        if batch.num_rows:
            yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, dim)

    schema = "cell int, n long, total array<long>"
    parts = vectors.mapInArrow(lambda b: add(b, rows), schema)
    return parts.repartition("cell").mapInArrow(lambda b: add(b, sums), schema)


def place(vectors: DataFrame, id_col: str, pivots: np.ndarray, settled: np.ndarray, centroids: np.ndarray, min_similarity: float, sharpness: float) -> DataFrame:
    """(id, cluster, distance, flow) of every usable row: the cluster that gets most of the row's
    flow, the cosine distance to its centroid and the share of the flow. ``settled`` is pivots x
    clusters: the flow from every pivot to its attractor."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _unit_rows(batch, dim)
            at, share = np.zeros(len(x), np.int32), np.zeros(len(x))
            for i in range(0, len(x), 8192):
                s = x[i : i + 8192] @ pivots.T
                least = np.minimum(s.max(1, keepdims=True), min_similarity)  # the nearest pivot always counts
                flow = np.where(s >= least, np.maximum(s, 1e-6) ** sharpness, 0) @ settled
                at[i : i + 8192] = flow.argmax(1)
                share[i : i + 8192] = flow.max(1) / flow.sum(1)
            sim = np.einsum("ij,ij->i", x.astype(np.float64), centroids[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(at), pa.array(np.maximum(0.0, 1.0 - sim)), pa.array(share)], names=[id_col, "cluster", "distance", "flow"])

    return vectors.mapInArrow(run, f"{id_col} long, cluster int, distance double, flow double")


def uncovered(vectors: DataFrame, id_col: str, pivots: np.ndarray, cover: float, n: int) -> list:
    """The ``n`` usable rows of lowest id hash among those less similar than ``cover`` to every
    pivot, as (id, hash, embedding); each partition sends its own ``n`` lowest at most."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows, x = _unit_rows(batch, dim)
            far = rows[_nearest(x, pivots)[1] < cover]
            part = pa.Table.from_batches([batch.take(pa.array(far))])
            held = part if held is None else pa.concat_tables([held, part])
            if len(held) > n:
                held = held.take(pc.select_k_unstable(held, n, sort_keys=[("h", "ascending"), (id_col, "ascending")]))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    hashed = vectors.select(id_col, "embedding", F.xxhash64(id_col).alias("h"))
    return hashed.mapInArrow(run, hashed.schema).orderBy("h", id_col).limit(n).collect()  # at most n rows


def covering_pivots(vectors: DataFrame, id_col: str, pivots: np.ndarray, cover: float, n: int) -> np.ndarray:
    """``pivots`` and as many more as it takes for every usable row to have one of at least ``cover``."""
    while rows := uncovered(vectors, id_col, pivots, cover, n):
        more = np.array([r.embedding for r in rows], np.float32)
        more /= np.linalg.norm(more.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
        added: list[np.ndarray] = []
        for x in more:
            if not added or (np.array(added) @ x).max() < cover:
                added.append(x)
        pivots = np.concatenate([pivots, np.array(added)])
    return pivots


def similarity_graph(spark, nodes: np.ndarray, sizes: np.ndarray, min_similarity: float) -> DataFrame:
    """(i, j, v) edges of the node graph, with loops: every pair of at least ``min_similarity``."""
    units = (nodes / np.maximum(np.linalg.norm(nodes, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    mass = np.sqrt(sizes / sizes.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.column(0).to_numpy().astype(int)
            sim = units @ units[cols].T
            for k, j in enumerate(cols):
                s = sim[:, k]
                near = np.flatnonzero(s >= min_similarity)
                near = near[near != j]
                i = np.append(near, j).astype(np.int64)
                v = np.append(s[near] * mass[near], mass[j]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), j, np.int64)), pa.array(v)], names=["i", "j", "v"])

    return spark.range(len(nodes)).mapInArrow(run, "i long, j long, v double")


def markov_clusters(edges: DataFrame, inflation: float = 1.6, prune: float = 1e-2, max_iterations: int = 200) -> DataFrame:
    """Markov clustering of a weighted graph (i, j, v): (node, attractor, flow).

    Each step squares the flow matrix by a join on the inner index, raises its entries to
    ``inflation``, drops entries under ``prune`` of their column's largest (a share, so that
    columns with many equal entries keep them all) and rescales the columns. It ends when
    every column is all but idempotent; an error says so if that takes over ``max_iterations``."""
    column = Window.partitionBy("j")
    flow = edges.withColumn("v", F.col("v") / F.sum("v").over(column))
    flow = materialize(flow, "mcl")
    for _ in range(max_iterations):
        a, b = flow.select("i", F.col("j").alias("k"), F.col("v").alias("va")), flow.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
        square = a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))
        blown = square.withColumn("top", F.max("v").over(column)).filter(F.col("v") >= prune * F.col("top")).withColumn("v", F.pow("v", F.lit(inflation)))
        blown = blown.withColumn("v", F.col("v") / F.sum("v").over(column)).select("i", "j", "v")
        older, flow = flow, materialize(blown, "mcl")
        chaos = flow.groupBy("j").agg((F.max("v") - F.sum(F.col("v") * F.col("v"))).alias("c")).agg(F.max("c")).first()[0]
        drop_table(older)
        if chaos is None or chaos < 1e-3:
            break
    else:
        raise NotConverged(f"flow not settled after {max_iterations} steps")
    # attractors that feed one another form one system, named by its lowest number
    attractors = flow.filter((F.col("i") == F.col("j")) & (F.col("v") > 0.01)).select("i")
    ties = flow.filter("v > 0.01").join(attractors, "i").join(attractors.select(F.col("i").alias("j")), "j").select("i", "j")
    ties = materialize(ties.union(ties.select("j", "i")).distinct(), "mcl-ties")
    system = ties.groupBy("i").agg(F.min("j").alias("system"))
    while True:  # the lowest number spreads over each system
        system = materialize(system, "mcl-systems")
        wider = ties.join(system.select(F.col("i").alias("j"), "system"), "j").groupBy("i").agg(F.min("system").alias("wider"))
        moved = materialize(system.join(wider, "i").select("i", F.least("system", "wider").alias("system"), (F.col("wider") < F.col("system")).alias("moved")), "mcl-systems")
        drop_table(system)
        system = moved.select("i", "system")
        if moved.filter("moved").isEmpty():
            break
    strongest = flow.withColumn("rank", F.row_number().over(column.orderBy(F.desc("v"), "i"))).filter("rank = 1")
    return strongest.join(system, "i", "left").select(F.col("j").alias("node"), F.coalesce("system", "i").alias("attractor"), F.col("v").alias("flow"))


def cluster_vectors(vectors: DataFrame, id_col: str, vector_col: str, n_nodes: int = 512, min_similarity: float = 0.6, inflation: float = 1.6, cover: float = 0.7, sharpness: float = 4.0) -> DataFrame:
    """(id, cluster, distance, flow): each record's cluster, its cosine distance to the cluster's centroid
    and the share of its flow that reaches it.

    ``n_nodes`` pivots are sampled, and ``n_nodes`` at most added a pass until every row has one
    of similarity ``cover``; all rows are placed."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).alias("embedding")).filter(F.col(id_col).isNotNull() & F.col("embedding").isNotNull())
    usable = vectors.filter((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    # rows of low id hash, twice as many as needed, so that what is sorted does not grow with the data
    span, n = 1 << 30, vectors.count()
    low = usable.filter(F.pmod(F.xxhash64(id_col), F.lit(span)) < min(span, int(span * 2.0 * n_nodes / max(n, 1)) + span // max(n, 1)))
    sample = low.orderBy(F.xxhash64(id_col), id_col).limit(n_nodes).collect()  # at most n_nodes rows
    dims = [len(r.embedding) for r in sample]
    if not dims:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance double, flow double")
    dim = max(set(dims), key=dims.count)  # vectors of another dimension are ragged
    pivots = np.array([r.embedding for r in {r[id_col]: r for r in sample}.values() if len(r.embedding) == dim], np.float32)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    pivots = covering_pivots(usable, id_col, pivots, cover, n_nodes)
    totals = np.zeros(pivots.shape)
    sizes = np.zeros(len(pivots))
    for r in cell_sums(vectors, pivots).collect():  # one row of dim numbers per pivot
        totals[r.cell], sizes[r.cell] = np.array(r.total) / _UNIT, r.n
    used = np.flatnonzero(sizes)
    totals, sizes = totals[used], sizes[used]
    edges = similarity_graph(spark, totals / sizes[:, None], sizes, min_similarity)
    label, flow = np.arange(len(used)), np.ones(len(used))
    for node, attractor, v in markov_clusters(edges, inflation).collect():  # one row per pivot
        label[node], flow[node] = attractor, v
    while not np.array_equal(label[label], label):  # an attractor that follows a stronger one takes its members along
        label = np.minimum(label[label], label) if np.array_equal(label[label][label], label) else label[label]
    order = sorted(np.unique(label), key=lambda k: (-sizes[label == k].sum(), k))
    settled = np.zeros((len(pivots), len(order)), np.float32)
    settled[used, [order.index(k) for k in label]] = flow
    centroids = np.array([(totals * flow[:, None])[label == k].sum(0) for k in order])
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return place(vectors, id_col, pivots, settled, centroids, min_similarity, sharpness)


def placed_documents(spark, sf_dir: str) -> DataFrame:
    """document_id, cluster, distance, flow, stored topic and the cluster's topic (the stored topic most members have)."""
    placed = cluster_vectors(spark.read.parquet(f"{sf_dir}/assignment_vectors.parquet"), "document_id", "embedding")
    stored = spark.read.parquet(f"{sf_dir}/document_assignments.parquet").filter("included and document_id is not null").select("document_id", F.col("topic").cast("int").alias("stored"))
    # of two vectors of a document the one nearer to its cluster counts
    once = placed.groupBy("document_id").agg(F.min(F.struct("distance", "cluster", "flow")).alias("b")).select("document_id", "b.*")
    rows = materialize(once.join(stored, "document_id"), "p2-placed")
    votes = rows.filter("stored is not null").groupBy("cluster", "stored").agg(F.count("*").alias("n"))
    first = Window.partitionBy("cluster").orderBy(F.desc("n"), "stored")
    topic_of = votes.withColumn("r", F.row_number().over(first)).filter("r = 1").select("cluster", F.col("stored").alias("topic"))
    return rows.join(F.broadcast(topic_of), "cluster")  # one row per cluster


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Documents whose stored topic is missing or is not that of their group."""
    return placed_documents(spark, sf_dir).filter("stored is null or stored <> topic").select("document_id", "topic")


def p2_topics(spark, sf_dir: str) -> DataFrame:
    """Per topic its size and its ten most typical members (lowest distance, then lowest id) with
    the share of their flow that reaches the topic's attractor."""
    rows = placed_documents(spark, sf_dir)
    sizes = rows.groupBy("topic").agg(F.count("*").alias("n_documents"))
    w = Window.partitionBy("topic").orderBy("distance", "document_id")
    # the window keeps ten rows a partition before its shuffle (WindowGroupLimit)
    top = rows.withColumn("representative_rank", F.row_number().over(w)).filter("representative_rank <= 10")
    return top.join(F.broadcast(sizes), "topic").select("topic", "n_documents", "representative_rank", "document_id", F.col("distance").alias("cosine_distance_to_centroid"), "flow")


QUERIES = {"p2_found": p2_found, "p2_topics": p2_topics}
SQL: dict[str, str] = {}
