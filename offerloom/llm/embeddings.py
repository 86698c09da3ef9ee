"""Near-duplicate vectors: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import pick
from offerloom.llm.graph import components
from offerloom.session import cut_lineage

THRESHOLD = 0.98
#: Distinct vectors a cell should hold, cells in all, rows of a block, and rows the centroids are fitted on.
CELL_ROWS, MOST_CELLS, BLOCK_ROWS, SAMPLE_ROWS, ROUNDS = 1500, 4096, 1024, 50_000, 8


def _usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; starts from evenly spaced rows, so reruns agree."""
    centers = rows[np.linspace(0, len(rows) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = (rows @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centers[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centers


def _centroids(distinct: DataFrame, cell_rows: int, most_cells: int, sample_rows: int) -> dict[tuple, np.ndarray]:
    """Centroids of the largest (label, length) classes, fitted on a bounded sample by hash of the id.

    Classes of at most ``cell_rows`` vectors are one cell; so are classes beyond ``most_cells`` cells in
    all, which only costs them more block products.
    """
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    large = sizes.orderBy(F.desc("n"), "label", "dim").limit(most_cells // 2).collect()
    cells, left, total = {}, most_cells, sum(r.n for r in large)
    for r in large:
        cells[(r.label, r.dim)] = min(-(-r.n // cell_rows), left)
        left -= cells[(r.label, r.dim)]
    cells = {k: n for k, n in cells.items() if n > 1}
    if not cells:
        return {}
    share = min(1.0, sample_rows / total)
    drawn = distinct.where((F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < share * 1_000_003)).orderBy(F.xxhash64("rep")).limit(sample_rows)
    drawn = drawn.select("label", "dim", "vector").toPandas()
    out = {}
    for key, part in drawn.groupby(["label", "dim"]):
        key = (int(key[0]), int(key[1]))
        if key in cells:
            out[key] = spherical_kmeans(_unit(np.array(part["vector"].tolist(), np.float64)), min(cells[key], len(part)))
    return out


def _assigned(distinct: DataFrame, centroids: dict[tuple, np.ndarray], threshold: float) -> DataFrame:
    """``label, dim, cell, guest, rep, copies, vector``: every vector in its own cell, and as a guest
    in every later cell that may hold a partner.

    A partner y lies within chord = sqrt(2 - 2 threshold) of x. If c' is y's nearest centroid and c is
    x's, y is on the far side of the plane between them, so x is at most chord away from that plane:
    (x.c - x.c') / |c - c'| <= chord. Both partners are guests of each other's cell then, so only
    later cells take guests and every pair is compared once.
    """
    chord = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for key, part in frame.groupby(["label", "dim"]):
                centers = centroids.get((int(key[0]), int(key[1])))
                if centers is None:
                    yield pa.RecordBatch.from_pandas(part.assign(cell=0, guest=False), schema=schema, preserve_index=False)
                    continue
                near = _unit(np.array(part["vector"].tolist(), np.float64)) @ centers.T
                own = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T))[own]
                reach = (near[np.arange(len(own)), own][:, None] - near <= chord * apart) & (np.arange(len(centers)) > own[:, None])
                row, cell = np.nonzero(reach)
                both = pd.concat([part.assign(cell=own, guest=False), part.iloc[row].assign(cell=cell, guest=True)])
                yield pa.RecordBatch.from_pandas(both, schema=schema, preserve_index=False)

    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()),
                        ("vector", pa.list_(pa.float64())), ("cell", pa.int32()), ("guest", pa.bool_())])
    return distinct.mapInArrow(run, "label long, dim int, rep long, copies long, vector array<double>, cell int, guest boolean")


def _block_links(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one pair of blocks: how many vectors each one links with, and edges that span the links.

    Rows of side 0 meet rows of side 1; a pair of a block with itself has the same rows on both.
    """
    sides = [frame[frame["side"] == s] for s in (0, 1)]
    if not all(len(s) for s in sides):
        return pd.DataFrame({"rep": [], "n": [], "to": []}).astype("int64")
    raw = [np.array(s["vector"].tolist(), np.float64) for s in sides]
    reps, copies = [s["rep"].to_numpy() for s in sides], [s["copies"].to_numpy() for s in sides]
    products = _unit(raw[0]) @ _unit(raw[1]).T
    linked = products >= threshold
    doubtful = np.nonzero(np.abs(products - threshold) < 1e-9)  # decided by the plain formula
    for i, j in zip(*doubtful):
        x, y = raw[0][i], raw[1][j]
        linked[i, j] = float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))) >= threshold
    same = bool(frame["same"].iloc[0])
    if same:
        np.fill_diagonal(linked, False)
    counts = [linked @ copies[1], linked.T @ copies[0]]
    nodes = np.concatenate(reps)
    at, to = np.nonzero(linked)
    to = to + len(reps[0])
    root = nodes.copy()
    if same:
        at, to = np.concatenate([at, np.arange(len(reps[0]))]), np.concatenate([to, np.arange(len(reps[0])) + len(reps[0])])
    while len(at):  # the smallest id that each node can reach within the block pair
        low = np.minimum(root[at], root[to])
        before = root.copy()
        np.minimum.at(root, at, low)
        np.minimum.at(root, to, low)
        if (root == before).all():
            break
    own = slice(0, len(reps[0])) if same else slice(None)
    n = counts[0] if same else np.concatenate(counts)
    return pd.DataFrame({"rep": nodes[own], "n": n, "to": root[own]}).astype("int64")


def _all_links(assigned: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """``rep, n, to`` of every pair of blocks of a cell.

    Homes meet homes and guests meet homes. A cell of many rows, such as that of a hot label or of
    thousands of near copies, is cut into blocks by hash; each pair of blocks is a task of its own
    with a bounded number of rows, so no cell is gathered in one task.
    """
    sizes = assigned.groupBy("label", "dim", "cell").agg(
        F.sum(F.when(F.col("guest"), 0).otherwise(1)).alias("homes"), F.sum(F.when(F.col("guest"), 1).otherwise(0)).alias("guests"))
    blocks = sizes.select(
        "label", "dim", "cell", F.greatest(F.ceil(F.col("homes") / block_rows), F.lit(1)).cast("int").alias("home_blocks"),
        F.greatest(F.ceil(F.col("guests") / block_rows), F.lit(1)).cast("int").alias("guest_blocks"))
    placed = assigned.join(blocks, ["label", "dim", "cell"])
    placed = placed.withColumn("b", F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("guest"), F.col("guest_blocks")).otherwise(F.col("home_blocks"))).cast("int"))
    homes = F.sequence(F.lit(0), F.col("home_blocks") - 1)
    # a pair is (kind, i, j): 0 for two home blocks i <= j, 1 for guest block i with home block j
    as_home = F.flatten(F.transform(homes, lambda o: F.when(
        o == F.col("b"), F.array(_pair(0, o, o, 0), _pair(0, o, o, 1))).otherwise(F.array(_pair(0, F.least(o, F.col("b")), F.greatest(o, F.col("b")), F.when(F.col("b") < o, 0).otherwise(1))))))
    for_guests = F.transform(F.sequence(F.lit(0), F.col("guest_blocks") - 1), lambda g: _pair(1, g, F.col("b"), 1))
    as_guest = F.transform(homes, lambda h: _pair(1, F.col("b"), h, 0))
    dealt = placed.select("label", "dim", "cell", "rep", "copies", "vector", F.inline(F.when(F.col("guest"), as_guest).otherwise(F.concat(as_home, for_guests))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(same=(frame["kind"] == 0) & (frame["i"] == frame["j"])).sort_values(["side", "rep"], kind="stable")
        return _block_links(frame, threshold)

    return dealt.groupBy("label", "dim", "cell", "kind", "i", "j").applyInPandas(run, "rep long, n long, to long")


def _pair(kind: int, i: Column, j: Column, side) -> Column:
    side = side if isinstance(side, Column) else F.lit(side)
    return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS,
                 block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``.

    Equal vectors of a label collapse to one row with a count before anything is compared. Spherical
    k-means on a bounded sample (``sample_rows``) places the distinct vectors in cells; a vector is
    also compared with the cells across whose boundary a partner may lie, so every link is found.
    Links are counted inside the block products, and only edges that span a block's links leave them.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label, link with nothing; vectors of different length never link. A repeated vec_id is counted
    as a vector of its own, and all its rows carry the smallest of its component. A null vec_id with
    a usable vector takes part and is never the smallest. An empty table gives no rows.
    """
    rows = pick(vectors, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = F.coalesce(_usable(F.col("vector")) & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.transform("vector", lambda x: x + 0.0)))  # -0.0 becomes 0.0
    rows = rows.withColumn("hash", F.when(F.col("vector").isNotNull(), F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("vector").cast("array<string>"), ","))))))
    groups = rows.where("hash is not null").groupBy("hash", "label").agg(
        F.coalesce(F.min("vec_id"), F.lit(2**63 - 1)).alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # two groups may share the smallest id of repeated rows: node ids are made unique by rank of their hash only then
    groups = cut_lineage(groups.select("hash", "label", "rep", "copies", "vector", F.size("vector").cast("int").alias("dim")))
    clash = groups.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    node = F.xxhash64("hash", "rep") if clash else F.col("rep")
    groups = groups.select("hash", node.alias("node"), "rep", "label", "dim", "copies", "vector")
    distinct = groups.select("label", "dim", F.col("node").alias("rep"), "copies", "vector")
    assigned = _assigned(distinct, _centroids(distinct, cell_rows, most_cells, sample_rows), threshold)
    links = cut_lineage(_all_links(assigned, threshold, block_rows))
    counts = links.groupBy("rep").agg(F.sum("n").alias("links"))
    roots = components(links.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    known = groups.select("hash", "node", "rep", "copies").join(counts, groups.node == counts.rep, "left").select(
        "hash", "node", groups.rep.alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = cut_lineage(known.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "hash", "rep", "n_links", F.coalesce("root", "node").alias("root")))
    lowest = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = cut_lineage(known.join(lowest, "root").select(F.col("hash").alias("of"), "n_links", "component_id"))
    out = rows.select("vec_id", "hash").join(known, F.col("hash") == F.col("of"), "left")
    component = F.coalesce(F.nullif(F.col("component_id"), F.lit(2**63 - 1)), F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
