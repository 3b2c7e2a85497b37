"""Near vectors by an epsilon grid order join: sequences of blocks in grid order, joined recursively."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored
from .components import connected_components

#: Blocks of a sequence that one node of the recursion has: the bits of their number.
FAN_BITS = 4
#: Rows of the smallest sequences that are compared whole.
TILE = 64
#: Room for rounding in distances of unit vectors.
SLACK = 1e-9


def units(flat: np.ndarray, width: int) -> np.ndarray:
    """Vectors of length 1, scaled first so that no square overflows or vanishes."""
    x = flat.reshape(-1, width).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int = 8, numbers: int = 1 << 21) -> tuple[int, np.ndarray]:
    """The most common width and its ``dims`` leading principal directions, one a column.

    They are fit on the vectors with the smallest hashes, as many as hold ``numbers`` components: any directions at right
    angles give the same links, good ones skip more.
    """
    common = vectors.groupBy("_width").count().orderBy(F.desc("count"), "_width").first()
    if common is None:
        return 0, np.empty((0, 0))
    width = common["_width"]
    rows = vectors.where(F.col("_width") == width).orderBy(F.xxhash64("embedding"), "embedding").limit(max(1, numbers // width)).select("embedding").collect()
    x = units(np.array([r[0] for r in rows], float), width)
    _, turn = np.linalg.eigh(np.cov(x.T, bias=True).reshape(width, width))
    return width, turn[:, ::-1][:, :dims]


def _placed(vectors: DataFrame, dims: int, eps: float) -> DataFrame:
    """``vectors`` with _at, the leading coordinates (missing ones 0), and _cell, their grid cells."""
    width, axes = principal_axes(vectors, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = batch.column("embedding"), batch.column("_width").to_numpy()
            at = np.zeros((len(sizes), dims))
            for w in np.unique(sizes):
                here = np.flatnonzero(sizes == w)
                x = units(found.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False), int(w))
                led = x @ axes if w == width else x[:, :dims]
                at[here, : led.shape[1]] = led
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dims) for v in (at, np.floor(at / eps).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists[0].cast(pa.list_(pa.float64())), lists[1].cast(pa.list_(pa.int32()))], names=[*batch.schema.names, "_at", "_cell"])

    return vectors.mapInArrow(run, f"{_ddl(vectors)}, _at array<double>, _cell array<int>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _sequenced(vectors: DataFrame, block_rows: int) -> DataFrame:
    """``vectors`` in grid order, with _node (a number for each), _part and _k: the task, and the block of at most ``block_rows`` of one label and width in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, k, held, last = TaskContext.get().partitionId(), 0, -1, block_rows, None
        for batch in batches:
            blocks = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("_width").to_pylist(), strict=True)):
                if held == block_rows or key != last:
                    k, held, last = k + 1, 0, key
                blocks[i] = k
                held += 1
            nodes = (part << 40) + seen + np.arange(batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes), pa.array(np.full(batch.num_rows, part)), pa.array(blocks)], names=[*batch.schema.names, "_node", "_part", "_k"])

    key = ["label", "_width", "_cell", F.xxhash64("embedding")]
    return vectors.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(run, f"{_ddl(vectors)}, _node long, _part long, _k long")


def _apart(dims: int) -> Column:
    """The squared distance of two boxes."""
    gaps = [F.greatest(F.lit(0.0), F.col("_lo_a")[i] - F.col("_hi_b")[i], F.col("_lo_b")[i] - F.col("_hi_a")[i]) for i in range(dims)]
    return sum((g * g for g in gaps), F.lit(0.0))


def _boxes(df: DataFrame, key: list[str | Column], low: str, high: str, dims: int) -> DataFrame:
    return df.groupBy(*key).agg(F.array(*[F.min(F.col(low)[i]) for i in range(dims)]).alias("_lo"), F.array(*[F.max(F.col(high)[i]) for i in range(dims)]).alias("_hi"))


def near_mask(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of two sequences have a cosine of ``least`` or more: the recursion goes on with halves of both, down to tiles.

    Sequences whose boxes of leading coordinates are further apart than the threshold allows are skipped.
    """
    out, most = np.zeros((len(a), len(b)), bool), 2 - 2 * least + SLACK
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        p, q = at_a[i:m], at_b[j:n]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        if gap @ gap > most:
            continue
        if max(m - i, n - j) <= TILE:
            out[i:m, j:n] = a[i:m] @ b[j:n].T >= least
            continue
        rows = [(i, (i + m) // 2), ((i + m) // 2, m)] if m - i > TILE else [(i, m)]
        columns = [(j, (j + n) // 2), ((j + n) // 2, n)] if n - j > TILE else [(j, n)]
        todo += [(*r, *c) for r in rows for c in columns]
    return out


def spanning(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) between the numbers ``a`` of rows and ``b`` of columns that join what the mask joins."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    mask, none = mask[np.ix_(rows, columns)], np.iinfo(np.int64).max
    of_row = a[rows].copy()
    while True:
        of_column = np.where(mask, of_row[:, None], none).min(axis=0, initial=none)
        lower = np.minimum(of_row, np.where(mask, of_column, none).min(axis=1, initial=none))
        if (lower == of_row).all():
            break
        of_row = lower
    members, roots = np.r_[a[rows], b[columns]], np.r_[of_row, of_column]
    keep = members != roots
    return members[keep], roots[keep]


def _linked(pairs: DataFrame, least: float) -> DataFrame:
    """src, dst, n: links that span what is connected within each pair of blocks (n null), and numbers of linked vectors (dst null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                side = []
                for s in ("_a", "_b"):
                    rows = batch.column(f"_rows{s}").slice(r, 1).flatten()
                    n, (node, copies, at, vector) = len(rows), (rows.field(k) for k in range(4))
                    flat = vector.flatten().to_numpy(zero_copy_only=False)
                    side.append((node.to_numpy(), copies.to_numpy(), at.flatten().to_numpy().reshape(n, -1), units(flat, len(flat) // n)))
                (node_a, copies_a, at_a, a), (node_b, copies_b, at_b, b) = side
                mask = near_mask(a, b, at_a, at_b, least)
                if same := node_a[0] == node_b[0]:
                    mask |= mask.T
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                members, roots = spanning(mask, node_a, node_b)
                if same:
                    members, first = np.unique(members, return_index=True)
                    roots = roots[first]
                counts = [(node_a, mask @ copies_b)] if same else [(node_a, mask @ copies_b), (node_b, copies_a @ mask)]
                nodes, n = (np.concatenate(x) for x in zip(*((k[c > 0], c[c > 0]) for k, c in counts), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[members, nodes]), pa.concat_arrays([pa.array(roots), pa.nulls(len(nodes), pa.int64())]), pa.concat_arrays([pa.nulls(len(roots), pa.int64()), pa.array(n)])], names=["src", "dst", "n"]
                )

    return pairs.select("_rows_a", "_rows_b").mapInArrow(run, "src long, dst long, n long")


def near_vectors(vectors: DataFrame, least: float = 0.98, dims: int = 8, block_rows: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows of one label (not null) and width link at a cosine of ``least`` or more, in double precision. n_links counts the others that a row
    links with, copies among them; component_id is the smallest vec_id reachable; kept tells whether that is its own.

    Equal vectors meet before anything is compared and are one vector with a number of copies. Distinct ones are sorted by their grid cells (as wide
    as the largest distance of a link) on the leading principal directions and cut into blocks. Sequences of blocks are joined
    recursively: a pair of sequences goes on to the pairs of its parts, level by level as joins of bounding boxes, and is dropped
    once the boxes are too far apart. What is left are pairs of blocks, one row each, compared in tiles. Only numbers of links and links
    that span a pair's components leave a task.

    Null, empty and zero vectors, and those with a component that is null or not finite, link with nothing, and neither do rows without a label. A
    null vec_id is larger than any other: its component is null only if all its members' ids are. Repeated rows
    are copies like others; other columns are ignored; an empty table gives no rows.
    """
    if not 0 < least < 1:
        raise ValueError("a cosine between 0 and 1 is wanted")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    sound = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    with scratch(vectors.sparkSession) as keep:
        distinct = rows.where(sound).groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first")).withColumn("_width", F.size("embedding"))
        nodes = keep(_sequenced(_placed(keep(distinct), dims, (2 - 2 * least) ** 0.5), block_rows))
        most_k, most_part = nodes.agg(F.max("_k"), F.max("_part")).first()
        digits = -(-int(most_k or 0).bit_length() // FAN_BITS), -(-int(most_part or 0).bit_length() // FAN_BITS)
        nodes = nodes.withColumn("_block", F.shiftleft("_part", digits[0] * FAN_BITS).bitwiseOR(F.col("_k")))
        of = ["label", "_width"]
        blocks = _boxes(nodes, [*of, "_block"], "_at", "_at", dims)
        levels = [keep(blocks)]
        for _ in range(sum(digits)):
            levels.append(_boxes(levels[-1], [*of, F.shiftright("_block", FAN_BITS).alias("_block")], "_lo", "_hi", dims))
        pairs = levels[-1].select(*of, F.col("_block").alias("_a"), F.col("_block").alias("_b"))
        for level in levels[-2::-1]:
            side = {s: level.select(*of, F.shiftright("_block", FAN_BITS).alias(f"_{s}"), F.col("_block").alias(f"_next_{s}"), F.col("_lo").alias(f"_lo_{s}"), F.col("_hi").alias(f"_hi_{s}")) for s in "ab"}
            met = pairs.join(side["a"], [*of, "_a"]).join(side["b"], [*of, "_b"]).where((F.col("_next_a") <= F.col("_next_b")) & (_apart(dims) <= 2 - 2 * least + SLACK))
            pairs = keep(met.select(*of, F.col("_next_a").alias("_a"), F.col("_next_b").alias("_b")))
        held = keep(nodes.groupBy("_block", *of).agg(F.array_sort(F.collect_list(F.struct("_node", "copies", "_at", "embedding"))).alias("_rows")))
        whole = {s: held.select(*of, F.col("_block").alias(f"_{s}"), F.col("_rows").alias(f"_rows_{s}")) for s in "ab"}
        found = keep(_linked(pairs.join(whole["a"], [*of, "_a"]).join(whole["b"], [*of, "_b"]), least))
        roots = connected_components(found.where("dst is not null").select("src", "dst"), keep=keep).withColumnRenamed("node", "_node")
        links = found.where("dst is null").groupBy(F.col("src").alias("_node")).agg(F.sum("n").alias("n"))
        named = nodes.select("_node", "label", "embedding", "copies", "first").join(roots, "_node", "left").join(links, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
        smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
        labels = named.join(smallest, "root").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        labels = stored(labels.withColumn("_found", F.lit(True)))
    out = rows.withColumn("_key", F.when(sound, F.col("embedding"))).join(labels.withColumnRenamed("embedding", "_key"), ["label", "_key"], "left")
    component = F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
