"""Near-duplicate vectors by NN-descent.

Equal vectors of one label are collapsed to a class first. A neighbour graph starts from random projections:
vectors are sorted by the signs of a few projections, and neighbours in that order are compared. NN-descent
rounds then compare the neighbours of each vector with one another (forward and reverse lists) and keep the
best of each. Edges at the threshold are links. A list that is full of links is saturated: it is
enlarged to all that links reach from it, which is compared exactly in pairs of blocks of fixed size, counting and not
listing the links. An audit takes every vector whose id is divisible by 100 (and, where too few of them have links, by
10) against all rows, in blocks, and compares the links by identity; it holds if the share of links found, and with 95 %
confidence the share of linked vectors that lack none, are what is asked for. While they are less, another round with longer lists and fresh projections follows. Where links are too rare
for the audit to tell, or the rounds run out, every pair of one label is compared in blocks: nothing is left to chance.

Labels must be equal and not null; vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and stand alone; vectors of other widths are never compared. Of neighbours that are equally near the smaller id is kept first; a cosine equal to the threshold links. Repeated rows (same id and vector) each
give a row and count as links of one another. An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.graph import components

THRESHOLD = 0.93
NEIGHBOURS, ORDERS, ROUNDS = 8, 6, 2
#: Vectors compared with one another at a time, in one sorted order and around one vector.
CHUNK, AROUND = 96, 64
BLOCK = 512
RECALL, MOST_ROUNDS = 0.99, 5
#: The audit asks for the vectors whose id this divides, in blocks; AUDIT_LINKED linked ones among them show what the rounds lack.
AUDIT_IDS, AUDIT_BLOCK, AUDIT_LINKED = 100, 2048, 300
#: Comparisons in floating point: a link's cosine may come out this much lower in another summation order.
EDGE = "a long, b long, sim double"


def _unit(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        out = []
        for x in batch.column(2).to_pylist():
            v = np.array(x, np.float64)
            out.append((v / np.sqrt(v @ v)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["node", "kind", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _best_edges(node: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every row, both ends named; sims has -2 where nothing is to be compared."""
    k = min(k, len(node) - 1)
    if k < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    i, j = np.repeat(np.arange(len(node)), k), best.ravel()
    s = sims[i, j]
    real = s > -1.5
    return node[i[real]], node[j[real]], s[real]


def _edge_batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "sim"])


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each vector. Lists are short before: what the rounds send is bounded for each vector."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def initial_edges(vectors: DataFrame, k: int, orders: int = ORDERS, turn: int = 0) -> DataFrame:
    """Neighbours within chunks of several sorted orders; each order, and each turn, uses other random projections."""

    def coded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            rows = batch.column(2).to_pylist()
            for width in {len(x) for x in rows}:
                at = [i for i, x in enumerate(rows) if len(x) == width]
                x = np.frombuffer(b"".join(rows[i] for i in at), np.float64).reshape(len(at), -1)
                planes = np.random.default_rng((20 + width, turn) if turn else 20 + width).standard_normal((x.shape[1], 40 * orders))
                bits = (x @ planes > 0).astype(np.int64)
                part = batch.take(pa.array(at))
                for o in range(orders):
                    code = bits[:, 40 * o : 40 * o + 40] @ (1 << np.arange(39, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), o, np.int32)), pa.array(code), *part.columns], names=["tree", "code", "node", "kind", "v"])

    def compared(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in stream:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            while held.num_rows >= 2 * CHUNK:
                yield chunk(held.slice(0, 2 * CHUNK))
                held = held.slice(CHUNK)  # half of a chunk is seen again with what follows
        if held is not None and held.num_rows:
            yield chunk(held)

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        group = [*zip(rows.column("tree").to_pylist(), rows.column("kind").to_pylist(), strict=True)]
        node, parts, lo = rows.column("node").to_numpy(), [], 0
        v = rows.column("v").combine_chunks()
        for hi in range(1, len(group) + 1):
            if hi == len(group) or group[hi] != group[lo]:
                x = _matrix(v.slice(lo, hi - lo))
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                parts.append(_best_edges(node[lo:hi], sims, k))
                lo = hi
        return _edge_batch(parts)

    order = ["tree", "kind", "code", "node"]  # the node is part of the key: equal codes may be split
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vectors.mapInArrow(coded, "tree int, code long, node long, kind string, v binary").repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(compared, EDGE)


def descend(edges: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """One round: what is around a vector is compared with one another."""
    around = edges.select(F.col("a").alias("v0"), F.col("b").alias("node")).unionByName(edges.select(F.col("b").alias("v0"), F.col("a").alias("node"))).distinct()

    def joined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def of(rows: pa.Table) -> pa.RecordBatch:
            centre, node, v = rows.column("v0").to_numpy(), rows.column("node").to_numpy(), rows.column("v").combine_chunks()
            cuts = np.concatenate([[0], np.nonzero(centre[1:] != centre[:-1])[0] + 1, [len(centre)]])
            parts = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for at in range(lo, hi, AROUND):  # long reverse lists go in pieces
                    end = min(hi, at + AROUND)
                    x = _matrix(v.slice(at, end - at))
                    sims = x @ x.T
                    np.fill_diagonal(sims, -2)
                    parts.append(_best_edges(node[at:end], sims, k))
            return _edge_batch(parts)

        for batch in stream:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            centre = held.column("v0").to_numpy()
            last = int(np.searchsorted(centre, centre[-1]))
            if last:
                yield of(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield of(held)

    found = around.join(vectors.select("node", "v"), "node").repartition("v0").sortWithinPartitions("v0", "node").select("v0", "node", "v").mapInArrow(joined, EDGE)
    return _top(edges.unionByName(found), k)


def _peers(linked: np.ndarray) -> np.ndarray:
    """By row: the first row that links reach from it."""
    peer = np.arange(len(linked))
    while True:
        least = np.minimum(peer, np.where(linked, peer, len(peer)).min(axis=1, initial=len(peer)))
        least = least[least]
        if (least == peer).all():
            return peer
        peer = least


def _cells(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, classes, peer) of every member in every pair of blocks of its root: links with multiplicities, linked
    classes, and a node that links reach from it; the peers connect what the pair's links connect."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    numbered = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    placed = numbered.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "node", "n", "v")

    def count(rows: pa.Table) -> pa.Table:
        x, i = _matrix(rows.column("v").combine_chunks()), rows.column("i").to_numpy()
        node, n, p, q = rows.column("node").to_numpy(), rows.column("n").to_numpy(), rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if p != q:
            linked[i[:, None] == i[None, :]] = False  # pairs within a block have a cell of their own
        some, peer = np.nonzero(linked.any(axis=1))[0], np.arange(len(node))
        among = linked[np.ix_(some, some)]
        peer[some] = some[_peers(among)]
        links, classes = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        links[some], classes[some] = among.astype(np.int64) @ n[some], among.sum(axis=1)
        return pa.table({"node": rows.column("node"), "links": pa.array(links), "classes": pa.array(classes), "peer": pa.array(node[peer])})

    return cells.groupBy("root", "p", "q").applyInArrow(count, "node long, links long, classes long, peer long")


def _exact_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, classes): links of every member of a component, multiplicities counted, from pairs of blocks."""
    return _cells(members, threshold).groupBy("node").agg(F.sum("links").alias("links"), F.sum("classes").alias("classes"))


def _all_links(vectors: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """(node, n, others, classes, root) from every pair of one kind: the square of a kind in work, no recall to ask for."""
    cells = staged(_cells(vectors.withColumnRenamed("kind", "root").join(counts, "node"), threshold), "nn-cells")
    links = cells.groupBy("node").agg(F.sum("links").alias("others"), F.sum("classes").alias("classes"))
    roots = components(cells.filter("node <> peer").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    found = counts.join(links, "node", "left").join(roots, "node", "left")
    return staged(found.select("node", "n", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("root", "node").alias("root")), "nn-links")


def _least_share(good: int, of: int) -> float:
    """What a share of good is at least, with 95 % confidence (Wilson)."""
    if not of:
        return 0.0
    z, p = 1.645, good / of
    return (p + z * z / (2 * of) - z * ((p * (1 - p) + z * z / (4 * of)) / of) ** 0.5) / (1 + z * z / of)


def _missed(vectors: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(node, true, got) for every asked vector with links: its linked classes among all of its kind, and those of them that
    were found, by identity. Asked vectors and rows meet in pairs of blocks; what a task holds does not grow."""
    sizes = vectors.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / AUDIT_BLOCK).cast("int").alias("rows")).join(asked.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / AUDIT_BLOCK).cast("int").alias("queries")), "kind")
    placed = lambda df, own: df.join(sizes, "kind").withColumn("own", F.pmod(F.xxhash64("node"), F.col(own)).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed(asked, "queries").select("kind", F.col("own").alias("q"), each("rows").alias("r"), "node", "v", "root", "dense", "found")
    fresh = [F.col(c).alias(c) for c in ("kind", "node", "v", "root")]  # both sides come from one table
    right = placed(vectors, "rows").select(each("queries").alias("q"), F.col("own").alias("r"), *fresh)

    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"node": np.zeros(0, np.int64), "true": np.zeros(0, np.int64), "got": np.zeros(0, np.int64)}
        if queries.num_rows and rows.num_rows:
            q, node = queries.column("node").to_numpy(), rows.column("node").to_numpy()
            linked = _matrix(queries.column("v").combine_chunks()) @ _matrix(rows.column("v").combine_chunks()).T >= threshold
            linked &= q[:, None] != node[None, :]
            got = linked & (queries.column("root").to_numpy()[:, None] == rows.column("root").to_numpy()[None, :])
            for i in np.nonzero(linked.any(axis=1) & ~queries.column("dense").to_numpy(zero_copy_only=False))[0].tolist():
                got[i] &= np.isin(node, queries.column("found")[i].values.to_numpy())
            some = np.nonzero(linked.any(axis=1))[0]
            out = {"node": q[some], "true": linked[some].sum(axis=1), "got": got[some].sum(axis=1)}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    cells = left.groupBy("kind", "q", "r").cogroup(right.groupBy("kind", "q", "r")).applyInArrow(compare, "node long, true long, got long")
    return cells.groupBy("node").agg(F.sum("true").alias("true"), F.sum("got").alias("got"))


def _audit(vectors: DataFrame, found: DataFrame, both: DataFrame, threshold: float) -> tuple[float, bool | None]:
    """Recall of the links of the asked vectors, by identity, and whether it holds; None where they cannot tell. Asked
    is every class with an id that AUDIT_IDS divides; where too few of them have links, one that a tenth of it divides."""
    recall = 1.0
    rooted = vectors.join(found.select("node", "root", "dense"), "node")
    for chosen in ("coarse", "fine"):
        asked = rooted.filter(chosen)
        lists = both.join(asked.filter("not dense").select(F.col("node").alias("a")), "a").groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("found"))  # under k each
        asked = asked.join(lists, "node", "left").withColumn("found", F.coalesce("found", F.array().cast("array<long>")))
        true, got, whole, linked = _missed(rooted, asked, threshold).agg(F.sum("true"), F.sum("got"), F.count(F.when(F.col("true") == F.col("got"), 1)), F.count(F.lit(1))).first()
        recall = got / true if true else 1.0
        if recall >= RECALL and _least_share(whole, linked) >= RECALL:
            return recall, True
        if linked >= AUDIT_LINKED and min(recall, whole / linked) < RECALL:
            return recall, False
    return recall, None


def near_duplicate_vectors(table: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, recall (of the audit)."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select("vec_id", "label", F.when(whole & finite, F.transform("embedding", lambda x: x.cast("double"))).alias("x"))
    classes = staged(rows.filter("x is not null").groupBy("label", "x").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.max(F.col("vec_id") % AUDIT_IDS == 0).alias("coarse"), F.max(F.col("vec_id") % (AUDIT_IDS // 10) == 0).alias("fine")), "nn-classes")
    kind = F.concat_ws(":", F.col("label").cast("string"), F.size("x").cast("string"))
    vectors = staged(classes.select("node", kind.alias("kind"), "x").mapInArrow(_unit, "node long, kind string, v binary"), "nn-vectors")
    counts = classes.select("node", "n")
    edges = staged(_top(initial_edges(vectors, k), k), "nn-graph")
    holds: bool | None = False
    for round_ in range(MOST_ROUNDS):
        edges = staged(descend(edges, vectors, k), "nn-graph")
        if round_ + 1 < ROUNDS:
            continue
        links = edges.filter(F.col("sim") >= threshold)
        roots = staged(components(links.select("a", "b")), "nn-roots")
        full = links.groupBy("a").count().filter(F.col("count") >= k).select(F.col("a").alias("node"))
        dense = roots.join(full, "node").select("root").distinct()
        members = roots.join(dense, "root").join(vectors, "node").join(counts, "node").select("root", "node", "n", "v")
        exact = staged(_exact_in_blocks(members, threshold), "nn-exact")
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        listed = both.join(counts.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("listed"), F.count(F.lit(1)).alias("listed_classes"))
        found = counts.join(listed, "node", "left").join(exact, "node", "left")
        found = found.select("node", "n", F.coalesce("links", "listed", F.lit(0)).alias("others"), F.coalesce("classes", "listed_classes", F.lit(0)).alias("classes"))
        tied = roots.join(dense.withColumn("dense", F.lit(True)), "root", "left")
        found = staged(found.join(tied, "node", "left").select("node", "n", "others", "classes", F.coalesce("root", "node").alias("root"), F.coalesce("dense", F.lit(False)).alias("dense")), "nn-links")
        recall, holds = _audit(vectors.join(classes.select("node", "coarse", "fine"), "node"), found, both, threshold)
        if holds or holds is None:
            break
        if round_ + 1 == MOST_ROUNDS:
            break
        k *= 2
        edges = staged(_top(edges.unionByName(initial_edges(vectors, k, turn=round_)), k), "nn-graph")
    if not holds:
        found, recall = _all_links(vectors, counts, threshold), 1.0
    per_class = staged(classes.join(found.drop("n", "dense"), "node").select("label", "x", "root", (F.col("others") + F.col("n") - 1).alias("n_links")), "nn-classes")
    known = rows.join(per_class, ["label", "x"], "left")
    component = F.coalesce("root", "vec_id")
    return known.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(recall).alias("recall"))
