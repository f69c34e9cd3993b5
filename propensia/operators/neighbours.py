"""Exact nearest neighbours of vectors, spread over the cluster.

Points are assigned to pivot cells; every cell is cut into blocks of bounded size.
A first pass inside the own block gives each point an upper bound on its neighbour
distance. The second pass sends a point only to those cells the triangle inequality
cannot exclude at that bound, so the answer is exact whatever the pivots are. The
unit of work is a pair of blocks: no task holds a whole cell, and only the best
candidates of a pair are emitted, never all pairs.

Where the inequality rules out little (vectors without structure), sending points
to cells would move every point to nearly every block. The blocks asked of some
points tell beforehand; then no point is sent: tasks read packs of points beside
packs of points from the written table, and only each point's best leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensia.session import materialise

BLOCK_ROWS = 512
MAX_PIVOTS = 4096
PACK_ROWS = 4096
MOST_COPIES = 16
"""Blocks that a point may be sent to on average; beyond, packs are read side by side."""

ASKED_BLOCKS = 64
"""Blocks whose points tell (about) how many blocks a point has to visit; the answer chooses the way, never a result."""

ROUNDING = 1e-9


def _matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, dtype="<f8").reshape(-1, width)


def _squares(a: np.ndarray, b: np.ndarray, n_codes: int, code_gap: float) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, by the fast expanded form.

    The last ``n_codes`` coordinates are codes that are equal or not; a difference adds ``code_gap``.
    """
    x, y = (a[:, :-n_codes], b[:, :-n_codes]) if n_codes else (a, b)
    out = (x ** 2).sum(1)[:, None] + (y ** 2).sum(1)[None, :] - 2.0 * x @ y.T
    for j in range(1, n_codes + 1):
        out += code_gap * (a[:, -j, None] != b[None, :, -j])
    return out


def _gaps(a: np.ndarray, b: np.ndarray, n_codes: int, code_gap: float) -> np.ndarray:
    """Distances row by row from coordinate differences."""
    x, y = (a[:, :-n_codes], b[:, :-n_codes]) if n_codes else (a, b)
    out = ((x - y) ** 2).sum(1)
    if n_codes:
        out = out + code_gap * (a[:, -n_codes:] != b[:, -n_codes:]).sum(1)
    return np.sqrt(out)


def closest(queries, query_ids, data, data_ids, k, n_codes=0, code_gap=0.0):
    """Per query the k nearest other data rows: (query row, data id, distance).

    Ordered by (distance, id). The fast expanded distance only screens; the kept
    candidates are measured again from coordinate differences.
    """
    rough = _squares(queries, data, n_codes, code_gap)
    scale = 1.0 + (queries ** 2).sum(1)[:, None] + (data ** 2).sum(1)[None, :] if not n_codes else (
        1.0 + (queries[:, :-n_codes] ** 2).sum(1)[:, None] + (data[:, :-n_codes] ** 2).sum(1)[None, :])
    rough[query_ids[:, None] == data_ids[None, :]] = np.inf
    if rough.shape[1] > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
    else:
        limit = np.full((len(queries), 1), np.inf)
    near = (rough <= limit + ROUNDING * scale) & np.isfinite(rough)
    rows, cols = np.nonzero(near)
    distance = _gaps(queries[rows], data[cols], n_codes, code_gap)
    ids = data_ids[cols]
    order = np.lexsort((ids, distance, rows))
    rows, ids, distance = rows[order], ids[order], distance[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = rank < k
    return rows[keep], ids[keep], distance[keep]


def _pivots(points: DataFrame, id_col: str, vec: str, n: int) -> np.ndarray:
    chosen = points.orderBy(F.xxhash64(id_col), id_col).limit(n).select(vec).collect()
    return np.array([r[vec] for r in chosen], dtype="float64")


def nearest_neighbours(
    points: DataFrame, id_col: str, vec: str, k: int = 1, block_rows: int = BLOCK_ROWS, pivots: int = MAX_PIVOTS,
    n_codes: int = 0, code_gap: float = 0.0,
) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest other points, ties by lower id.

    ``id_col`` is a unique bigint, ``vec`` an array of doubles of one width without
    NULLs, its last ``n_codes`` coordinates being codes that only count as equal or
    different (``code_gap`` is the squared distance of a difference). Identical vectors
    are one position in the search, however many there are.
    """
    rows = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    rows = materialise(rows, "points")
    # The k + 1 lowest ids of a position stand for all of its points.
    lowest = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(lowest)).filter(F.col("place") <= k + 1)
    spots = materialise(few.groupBy("vec").agg(F.min("id").alias("spot"), F.sort_array(F.collect_list("id")).alias("low")), "spots")
    near = nearest_positions(spots.select(F.col("spot").alias("id"), "vec"), k, block_rows, pivots, n_codes, code_gap)
    ids = spots.select(F.col("spot").alias("neighbour"), "low")
    others = near.join(ids, "neighbour").select(F.col("id").alias("spot"), F.explode(F.transform("low", _at("distance"))).alias("c"))
    best = Window.partitionBy("spot").orderBy("c")
    others = others.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).groupBy("spot").agg(F.collect_list("c").alias("others"))
    # One list per position: its own lowest ids at distance 0, then the best ones elsewhere.
    listed = spots.join(others, "spot", "left").select(
        "vec", F.concat(F.transform("low", _at(0.0)), F.coalesce("others", F.array().cast("array<struct<distance:double,neighbour:bigint>>"))).alias("list"))
    own = rows.join(listed, "vec").select("id", F.col("list").alias("all"))
    picked = own.select("id", F.slice(F.array_sort(F.filter("all", lambda c: c["neighbour"] != F.col("id"))), 1, k).alias("best"))
    return picked.select("id", F.posexplode("best").alias("rank", "c")).select("id", "c.neighbour", "c.distance", (F.col("rank") + 1).alias("rank"))


def _at(distance):
    """An id as (distance, id)."""
    d = F.col(distance) if isinstance(distance, str) else F.lit(distance)
    return lambda i: F.struct(d.alias("distance"), i.alias("neighbour"))


def nearest_positions(
    points: DataFrame, k: int = 1, block_rows: int = BLOCK_ROWS, pivots: int = MAX_PIVOTS, n_codes: int = 0, code_gap: float = 0.0
) -> DataFrame:
    """(id, neighbour, distance, rank) among distinct vectors (id bigint, vec array<double>) of a written table."""
    spark = points.sparkSession
    # About one block per cell; more cells than blocks only add pairs. More cells than one level of pivots names get a second one.
    wanted = max(1, points.count() // block_rows)
    if wanted > pivots:
        return _best(_two_levels(points, wanted, k, block_rows, pivots, n_codes, code_gap), k)
    centres = _pivots(points, "id", "vec", wanted)
    if not len(centres):
        return spark.createDataFrame([], "id bigint, neighbour bigint, distance double, rank int")
    width = centres.shape[1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype("float64")
            cell = _squares(x, centres, n_codes, code_gap).argmin(1)
            reach = _gaps(x, centres[cell], n_codes, code_gap)
            yield pd.DataFrame({"id": pdf["id"], "cell": cell.astype("int32"), "reach": reach,
                                "blob": [row.tobytes() for row in x]})

    placed = points.mapInPandas(assign, "id bigint, cell int, reach double, blob binary")
    cells = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("reach").alias("inner"), F.max("reach").alias("outer")
    ).collect()  # at most ``pivots`` rows
    n_blocks = {r["cell"]: max(1, -(-r["n"] // block_rows)) for r in cells}
    rings = {r["cell"]: (r["inner"], r["outer"]) for r in cells}
    blocks_of = F.create_map(*[x for c, b in n_blocks.items() for x in (F.lit(c), F.lit(b))])
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.element_at(blocks_of, F.col("cell"))).cast("int"))
    # Blocks travel as single rows of packed coordinates; both passes read the same table.
    packed = materialise(blocked.groupBy("cell", "block").agg(
        F.sort_array(F.collect_list(F.struct("id", "blob"))).alias("rows")
    ).select(
        "cell", "block", F.col("rows.id").alias("ids"), F.col("rows.blob").alias("blobs"),
    ), "blocks")

    known = np.array(sorted(rings), dtype="int32")
    inner = np.array([rings[c][0] for c in known])
    outer = np.array([rings[c][1] for c in known])

    def stack(blobs) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(-1, width)

    n_packed = sum(n_blocks.values())

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Own-block search, then the cells each point of the block must still visit."""
        for pdf in batches:
            for cell, block, ids, blobs in pdf.itertuples(index=False):
                ids = np.asarray(ids, dtype="int64")
                x = stack(blobs)
                rows, _, distance = closest(x, ids, x, ids, k, n_codes, code_gap)
                found = np.bincount(rows, minlength=len(ids))
                bound = np.full(len(ids), np.inf)
                full = found >= k
                worst = np.zeros(len(ids))
                np.maximum.at(worst, rows, distance)
                bound[full] = worst[full]
                to_centre = np.stack([_gaps(x, np.broadcast_to(centres[c], x.shape), n_codes, code_gap) for c in known], axis=1)
                gap = np.maximum(to_centre - outer[None, :], inner[None, :] - to_centre)
                visit = gap <= bound[:, None] + ROUNDING * (1.0 + to_centre)
                target = np.nonzero(visit.any(0))[0]
                who = [np.nonzero(visit[:, j])[0] for j in target]
                yield pd.DataFrame({
                    "cell": known[target], "q_ids": [ids[w] for w in who], "q_blob": [x[w].tobytes() for w in who],
                })

    def visits_of(blocks: DataFrame) -> DataFrame:
        # One join key per block: a crowded cell spreads over as many keys as it has blocks.
        return blocks.mapInPandas(plan, "cell int, q_ids array<bigint>, q_blob binary").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.element_at(blocks_of, F.col("cell")) - 1))
        )

    if _too_many(packed, n_packed, visits_of):
        return _best(_side_by_side(packed, n_packed * block_rows, width, k, n_codes, code_gap), k)
    visits = visits_of(packed)
    pairs = visits.join(packed, ["cell", "block"]).select("q_ids", "q_blob", "ids", "blobs")

    return _best(pairs.mapInPandas(_search(width, k, n_codes, code_gap), _FOUND), k)


_FOUND = "id bigint, neighbour bigint, distance double"


def _search(width: int, k: int, n_codes: int, code_gap: float):
    """The k best of every query point in the block it meets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q_ids, q_blob, ids, blobs in pdf[["q_ids", "q_blob", "ids", "blobs"]].itertuples(index=False):
                q_ids, ids = np.asarray(q_ids, dtype="int64"), np.asarray(ids, dtype="int64")
                rows, near, distance = closest(_matrix(q_blob, width), q_ids, _stack(blobs, width), ids, k, n_codes, code_gap)
                yield pd.DataFrame({"id": q_ids[rows], "neighbour": near, "distance": distance})

    return run


def _too_many(packed: DataFrame, n_packed: int, visits_of) -> bool:
    """Whether the points of about ASKED_BLOCKS blocks have to visit more than MOST_COPIES blocks each."""
    if n_packed <= MOST_COPIES:  # not even all blocks are too many
        return False
    asked = packed.filter(F.pmod(F.xxhash64("ids"), F.lit(-(-n_packed // ASKED_BLOCKS))) == 0)
    points = asked.agg(F.sum(F.size("ids"))).first()[0]
    if not points:
        return False
    return visits_of(asked).agg(F.sum(F.size("q_ids"))).first()[0] > MOST_COPIES * points


def _side_by_side(packed: DataFrame, n_points: int, width: int, k: int, n_codes: int, code_gap: float) -> DataFrame:
    """(id, neighbour, distance) candidates of all pairs of points, without sending a point anywhere.

    Packs of about PACK_ROWS points are written once. A task reads some packs of points that ask and some that answer,
    and emits the k best of each asking point: a few small rows a point, whatever the number of pairs.
    """
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, blobs, held = [], [], 0
        for pdf in batches:
            for own, x in pdf[["ids", "blobs"]].itertuples(index=False):
                if held and held + len(own) > PACK_ROWS:
                    yield pd.DataFrame({"ids": [np.concatenate(ids).tobytes()], "x": [b"".join(blobs)]})
                    ids, blobs, held = [], [], 0
                ids.append(np.asarray(own, dtype="<i8"))
                blobs += list(x)
                held += len(own)
        if held:
            yield pd.DataFrame({"ids": [np.concatenate(ids).tobytes()], "x": [b"".join(blobs)]})

    # Many files at small sizes too, so that the reading tasks are as many as the cores.
    files = max(1, min(1024, -(-n_points // PACK_ROWS)))
    packs = materialise(packed.select("ids", "blobs").repartition(files).mapInPandas(pack, "ids binary, x binary"), "packs")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asking = None
        for pdf in batches:
            for q_ids, q_x, ids, x in pdf[["q_ids", "q_x", "ids", "x"]].itertuples(index=False):
                if asking is None or asking.name != q_ids:
                    if asking is not None:
                        yield asking.found()
                    asking = _Asking(q_ids, _matrix(q_x, width), k, n_codes, code_gap)
                asking.meet(np.frombuffer(ids, "<i8"), _matrix(x, width))
        if asking is not None:
            yield asking.found()

    asks = packs.select(F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    return asks.crossJoin(packs.hint("shuffle_replicate_nl")).mapInPandas(meet, _FOUND)


class _Asking:
    """A pack of points with the k best of each among the packs it has met."""

    def __init__(self, name: bytes, x: np.ndarray, k: int, n_codes: int, code_gap: float):
        self.name, self.ids, self.x, self.k, self.codes = name, np.frombuffer(name, "<i8"), x, k, (n_codes, code_gap)
        self.placed = x[:, : x.shape[1] - n_codes]
        self.squares = (self.placed ** 2).sum(1)
        self.best = np.full((len(x), k), np.inf)
        self.near = np.full((len(x), k), np.iinfo("int64").max)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        placed = x[:, : x.shape[1] - self.codes[0]]
        squares, turned = (placed ** 2).sum(1), -2.0 * placed.T
        room = 1.0 + np.fmax.reduce(squares)
        for a in range(0, len(self.x), BLOCK_ROWS):  # rows of distances in bounded pieces
            part = slice(a, a + BLOCK_ROWS)
            bound = self.best[part, -1]
            who = np.arange(len(bound))
            if np.isfinite(bound).any():
                # Codes only add to a distance: rows that nothing here can better go no further.
                rough = self.placed[part] @ turned
                rough += squares
                lowest = np.fmin.reduce(rough, axis=1) + self.squares[part]
                who = np.flatnonzero(lowest <= bound ** 2 + ROUNDING * (room + self.squares[part]))
            if len(who):
                self._keep(who + a, *closest(self.x[part][who], self.ids[part][who], x, ids, self.k, *self.codes))

    def _keep(self, who: np.ndarray, rows: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        """Merge candidates (row among ``who``, id, distance) ordered by row, distance and id."""
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        best, near = np.full((len(who), self.k), np.inf), np.full((len(who), self.k), np.iinfo("int64").max)
        best[rows, place], near[rows, place] = distance, ids
        best, near = np.concatenate([self.best[who], best], 1), np.concatenate([self.near[who], near], 1)
        order = np.lexsort((near, best))[:, : self.k]
        self.best[who], self.near[who] = np.take_along_axis(best, order, 1), np.take_along_axis(near, order, 1)

    def found(self) -> pd.DataFrame:
        rows, place = np.nonzero(np.isfinite(self.best))
        return pd.DataFrame({"id": self.ids[rows], "neighbour": self.near[rows, place], "distance": self.best[rows, place]})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _stack(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(-1, width)


def _bounds(x: np.ndarray, ids: np.ndarray, k: int, n_codes: int, code_gap: float) -> np.ndarray:
    """Upper bound of each point's k-th neighbour distance, from its own block."""
    rows, _, distance = closest(x, ids, x, ids, k, n_codes, code_gap)
    bound = np.zeros(len(ids))
    np.maximum.at(bound, rows, distance)
    bound[np.bincount(rows, minlength=len(ids)) < k] = np.inf
    return bound


def _to_centres(x: np.ndarray, centres: np.ndarray, n_codes: int, code_gap: float) -> np.ndarray:
    return np.stack([_gaps(x, np.broadcast_to(c, x.shape), n_codes, code_gap) for c in centres], axis=1)


def _reachable(to_centre: np.ndarray, inner: np.ndarray, outer: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which cells the triangle inequality cannot exclude for each point."""
    gap = np.maximum(to_centre - outer[None, :], inner[None, :] - to_centre)
    return gap <= bound[:, None] + ROUNDING * (1.0 + to_centre)


def _two_levels(points: DataFrame, wanted: int, k: int, block_rows: int, pivots: int, n_codes: int, code_gap: float) -> DataFrame:
    """(id, neighbour, distance) candidates by a tree of pivots: cells of about ``block_rows`` points at any number of points.

    The upper level has about the square root of the wanted cells (``pivots`` at most), is broadcast and rules out most of
    the space; the cells below an upper one are a table of their own, joined by the upper cell. Lower pivots are the points
    of an upper cell whose hash is 0 modulo ``block_rows``, so their number grows with the points.
    """
    top = _pivots(points, "id", "vec", max(1, min(pivots, round(wanted**0.5))))
    width = top.shape[1]

    def assign_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()).astype("float64")
                cell = _squares(x, top, n_codes, code_gap).argmin(1)
                yield pd.DataFrame({"id": pdf["id"], "top": cell.astype("int32"), "far": _gaps(x, top[cell], n_codes, code_gap), "blob": [row.tobytes() for row in x]})

    placed = materialise(points.mapInPandas(assign_top, "id bigint, top int, far double, blob binary"), "upper-cells")
    rings = {r["top"]: r for r in placed.groupBy("top").agg(F.count("*").alias("n"), F.min("far").alias("inner"), F.max("far").alias("outer")).collect()}
    known = np.array(sorted(rings), dtype="int32")
    inner, outer = (np.array([rings[c][name] for c in known]) for name in ("inner", "outer"))

    # Lower pivots of an upper cell as one row; an upper cell without one is its own pivot.
    own = placed.filter(F.pmod(F.xxhash64("id"), F.lit(block_rows)) == 0).select("top", F.struct("id", "blob").alias("p"))
    spare = points.sparkSession.createDataFrame([(int(c), top[c].tobytes()) for c in known], "top int, blob binary")
    spare = spare.join(own.select("top").distinct(), "top", "left_anti").select("top", F.struct(F.lit(-1).cast("bigint").alias("id"), "blob").alias("p"))
    lower = own.unionAll(spare).groupBy("top").agg(F.array_sort(F.collect_list("p")).alias("p")).select("top", F.col("p.blob").alias("centres"))
    lower = materialise(lower, "lower-pivots")

    # Points travel in packs of about a block, so a pack meets its pivots once.
    packs_of = F.create_map(*[x for c in known for x in (F.lit(int(c)), F.lit(max(1, -(-rings[c]["n"] // block_rows))))])
    packs = placed.withColumn("pack", F.pmod(F.xxhash64("id", F.lit(1)), F.element_at(packs_of, F.col("top")))).groupBy("top", "pack").agg(
        F.collect_list(F.struct("id", "blob")).alias("rows")).select("top", F.col("rows.id").alias("ids"), F.col("rows.blob").alias("blobs"))

    def assign_low(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, ids, blobs, centres in pdf[["top", "ids", "blobs", "centres"]].itertuples(index=False):
                x, c = _stack(blobs, width), _stack(centres, width)
                cell = _squares(x, c, n_codes, code_gap).argmin(1)
                yield pd.DataFrame({"id": ids, "top": np.int32(t), "low": cell.astype("int32"), "reach": _gaps(x, c[cell], n_codes, code_gap), "blob": list(blobs)})

    placed = materialise(packs.join(lower, "top").mapInPandas(assign_low, "id bigint, top int, low int, reach double, blob binary"), "lower-cells")
    cells = placed.groupBy("top", "low").agg(F.min("reach").alias("inner"), F.max("reach").alias("outer"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    cells = materialise(cells, "cells")
    blocked = placed.join(cells.select("top", "low", "blocks"), ["top", "low"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = materialise(blocked.groupBy("top", "low", "block").agg(F.sort_array(F.collect_list(F.struct("id", "blob"))).alias("rows")).select(
        "top", "low", "block", F.col("rows.id").alias("ids"), F.col("rows.blob").alias("blobs")), "blocks")

    def plan_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, blobs in pdf[["ids", "blobs"]].itertuples(index=False):
                ids, x = np.asarray(ids, dtype="int64"), _stack(blobs, width)
                bound = _bounds(x, ids, k, n_codes, code_gap)
                visit = _reachable(_to_centres(x, top[known], n_codes, code_gap), inner, outer, bound)
                for j in np.flatnonzero(visit.any(0)):
                    who = np.flatnonzero(visit[:, j])
                    yield pd.DataFrame({"top": [known[j]], "q_ids": [ids[who]], "q_blob": [x[who].tobytes()], "bound": [bound[who]]})

    below = cells.groupBy("top").agg(F.sort_array(F.collect_list(F.struct("low", "inner", "outer", "blocks"))).alias("c"))
    below = below.select("top", *[F.col(f"c.{name}").alias(f"c_{name}") for name in ("low", "inner", "outer", "blocks")]).join(lower, "top")

    def plan_low(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, ids, bound = _matrix(row.q_blob, width), np.asarray(row.q_ids), np.asarray(row.bound)
                at = _to_centres(x, _stack(row.centres, width)[np.asarray(row.c_low)], n_codes, code_gap)
                visit = _reachable(at, np.asarray(row.c_inner), np.asarray(row.c_outer), bound)
                for j in np.flatnonzero(visit.any(0)):
                    who = np.flatnonzero(visit[:, j])
                    n = int(row.c_blocks[j])
                    yield pd.DataFrame({"top": np.int32(row.top), "low": np.int32(row.c_low[j]), "block": np.arange(n, dtype="int32"), "q_ids": [ids[who]] * n, "q_blob": [x[who].tobytes()] * n})

    def visits_of(blocks: DataFrame) -> DataFrame:
        visits = blocks.select("ids", "blobs").mapInPandas(plan_top, "top int, q_ids array<bigint>, q_blob binary, bound array<double>").join(below, "top")
        return visits.mapInPandas(plan_low, "top int, low int, block int, q_ids array<bigint>, q_blob binary")

    if _too_many(packed, packed.count(), visits_of):
        return _side_by_side(packed, wanted * block_rows, width, k, n_codes, code_gap)
    pairs = visits_of(packed).join(packed, ["top", "low", "block"])
    return pairs.mapInPandas(_search(width, k, n_codes, code_gap), _FOUND)
