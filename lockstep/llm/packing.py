"""Best-fit packing of token sequences, bounded-space and online."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_slices, utf8
from .tokens import tokenizer

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class BestFitPacker:
    """Places sizes into bins of ``capacity``, each at once, with at most ``open_bins`` bins open.

    A bitset holds which amounts of free space some open bin has; the lowest set bit at or above a
    size is the best fit. If none fits and all bins are open, the fullest one closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        found = held.pop()
        if not held:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The bin for ``size`` and the offset there."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.n_open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, found = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(found)
            self.bits |= 1 << left
            self.n_open += 1
        return found, self.capacity - free


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 1024) -> DataFrame:
    """Tokenise documents, append ``end_id``, cut what is longer than ``capacity``, pack the pieces.

    Every task packs the rows of its own input partition while it reads them, so no row is shuffled;
    a task wastes the bins that it still has open at its end, a fraction of a percent of the sequences
    of a 128 MB partition. Memory is bounded by one Arrow batch and ``open_bins`` counters.

    Returns a row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit),
    sequence_id, offset. A null or empty text is a piece that holds only ``end_id``; a null doc_id
    stays null; repeated rows are packed as often as they come; other columns are ignored; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        packer = BestFitPacker(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tok.encode(utf8(part.column("text"))), strict=True):
                    wide = np.frombuffer(ids, tok.dtype).astype("<u4").tobytes() + end
                    for piece, start in enumerate(range(0, len(wide), 4 * capacity)):
                        cut = wide[start : start + 4 * capacity]
                        found, offset = packer.place(len(cut) // 4)
                        rows.append((doc_id, piece, start // 4, len(cut) // 4, cut, base | found, offset))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids in order of their offsets, doc_ids in that order.

    A sequence holds at most ``capacity`` ids, so that each group is small.
    """
    from pyspark.sql import functions as F

    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("held"))
    ids = F.aggregate(F.col("held.ids"), F.lit(b""), lambda a, x: F.concat(a, x))
    return held.select("sequence_id", ids.alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.offset").alias("offsets"))
