"""Problem 9: put items of varying size into containers of fixed capacity.

Bounded-space online best-fit. A packer keeps at most ``open_bins`` open containers. A bitset has one
bit per amount of free space that some open container has, so the tightest fit for a size is the
lowest set bit at or above it. If nothing fits and the packer is full, the fullest container closes.

An item above the capacity is cut into pieces of the full capacity and a rest; each full piece is a
container of its own, the rest is packed like any item. No other item is ever cut.

Items are dealt into chunks by a hash of their key and their place among the rows, so copies of one key
spread over all chunks; each chunk is packed by one packer in key order. The number of chunks follows
the total size, so each packs thousands of containers, and what its last open containers leave unused
is a fixed small share at every scale; chunks share partitions, whose number is the session's. Places
are kept with the items before packing, so a retry packs alike.

Defined results: items of size 0 or null (null and empty texts) take no room: container and place are
null. Repeated keys are packed as separate items. A null key is an item like any other. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import checkpointed, default_parallelism

CAPACITY = 2048
OPEN_BINS = 64
BINS_PER_CHUNK = 4096


class BestFit:
    """Online best-fit over a bounded number of open containers."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bits = 0  # bit f is set while an open container has f free
        self.by_free: dict[int, list[int]] = {}
        self.filled: dict[int, int] = {}  # open containers: items so far
        self.next_id = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        got = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits ^= 1 << free
        return got

    def put(self, size: int) -> tuple[int, int, int]:
        """Container, place in it (from 0) and offset in it for an item of 1..capacity."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if size == self.capacity:  # full at once, so it is never open
                self.next_id += 1
                return self.next_id - 1, 0, 0
            if len(self.filled) >= self.limit and self.bits:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.filled.pop(self._take(fullest))
            at, free = self.next_id, self.capacity
            self.next_id += 1
            self.filled[at] = 0
        place, offset = self.filled[at], self.capacity - free
        free -= size
        if free:
            self.filled[at] = place + 1
            self.by_free.setdefault(free, []).append(at)
            self.bits |= 1 << free
        else:
            del self.filled[at]
        return at, place, offset


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, bins_per_chunk: int = BINS_PER_CHUNK) -> DataFrame:
    """key, piece_no, token_start, n_tokens, container_id, place and offset of every piece."""
    items = checkpointed(sizes.select(F.col(key).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("seq")))
    total = items.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, -(-total // (capacity * bins_per_chunk)))
    kind = sizes.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece_no int, token_start bigint, n_tokens bigint, container_id bigint, place int, offset int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, chunk = None, None
        for b in batches:
            rows = []
            types = [b.column(0).type, *kinds]
            cols = (b.column(i).to_pylist() for i in (0, 1, 3))
            for i, (k, n, c) in enumerate(zip(*cols, strict=True)):
                if c != chunk:
                    fit, chunk = BestFit(capacity, open_bins), c
                if n <= 0:
                    rows.append((k, 0, 0, 0, None, None, None))
                start = piece = 0
                while n > start:
                    part = min(capacity, n - start)
                    at, place, offset = fit.put(part)
                    rows.append((k, piece, start, part, (c << 32) + at, place, offset))
                    start, piece = start + part, piece + 1
                if rows and (len(rows) >= 8192 or i == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = [key, "piece_no", "token_start", "n_tokens", "container_id", "place", "offset"]
    # a chunk lies whole in one partition and is sorted, so a retry packs the same items in the same order
    dealt = items.withColumn("chunk", F.pmod(F.xxhash64("k", "seq"), F.lit(chunks))).repartition(int(min(chunks, default_parallelism(sizes.sparkSession))), "chunk")
    return dealt.sortWithinPartitions("chunk", "k", "n", "seq").mapInArrow(run, schema)
