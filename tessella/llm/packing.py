"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each document's ids (then id 0) are cut into full windows and one remainder. Remainders are packed in
blocks of `BLOCK` by the largest differencing method: every remainder starts as a partial partition into m
windows; the two partitions with the largest spreads are merged, large sums of one on small sums of the
other, until one is left. Its windows are nearly equal. If one exceeds the capacity, m rises and the block
is packed again. Blocks are runs of the task's own input, so nothing is shuffled and no task grows with
the corpus; a sequence's id holds its partition's number.

Ids are those of the `tokenizers` file. Texts of Latin letters and printable ASCII are encoded by tiktoken
with the same vocabulary, which gives the same ids four times as fast (tested); any other text, and one
that may hold a special token, goes to `tokenizers` itself.

Defined results. Null or empty text: one id, 0. Null id: packed, its pieces have a null id. Repeated rows:
packed each for itself. Empty table: no rows. Very long texts: any number of windows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_slices

CAPACITY = 1024
#: Remainders that are packed together.
BLOCK = 512

#: Texts on which both libraries' patterns agree: Latin letters and printable ASCII.
_PLAIN = re.compile(r"[\t\n -~À-ÖØ-öø-ſ]*")


class Encoder:
    """Ids of texts under a `tokenizers` file, without special tokens added."""

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.same = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return np.array(self.same.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary, ranks)


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the places of `sizes` dealt to at most `windows` windows of nearly equal sums."""
    # A partition: sums of its used windows in falling order, and for each the tree of places in it.
    heap = [(-s, i, np.array([s]), [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, trees_a = heapq.heappop(heap)
        _, _, b, trees_b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - windows)
        pads = windows - len(b)
        if over:
            low = np.zeros(windows, np.int64)
            low[pads:] = b[::-1]
            high = np.zeros(windows, np.int64)
            high[: len(a)] = a
            sums = high + low
            trees: list = [*trees_a, *[None] * (windows - len(a))]
            for k, t in enumerate(reversed(trees_b)):
                trees[pads + k] = t if trees[pads + k] is None else (trees[pads + k], t)
        else:
            sums, trees = np.concatenate([a, b]), trees_a + trees_b
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], [trees[k] for k in order.tolist()]
        spread = int(sums[0] - (sums[-1] if len(sums) == windows else 0))
        heapq.heappush(heap, (-spread, serial, sums, trees))
        serial += 1

    def leaves(tree) -> list[int]:
        out, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack.extend(t)
            else:
                out.append(t)
        return out

    return [leaves(t) for t in heap[0][3]] if heap else []


def packed(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most `capacity`; their number starts at the least possible and rises until all fit."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = differenced(sizes, max(1, windows))
        excess = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in found)
        if not excess:
            return found
        windows += max(1, excess // capacity)


def _packer(vocabulary: str, ranks: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks).ids
        sequence = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rests: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=names)

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for window in packed([r[2] for r in rests], capacity):
                offset = 0
                for i in window:
                    rows.append((*rests[i], sequence, offset))
                    offset += rests[i][2]
                sequence += 1
            rests.clear()
            return batch_of(rows)

        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text)
                    data, n = np.append(ids, np.uint32(0)).astype("<u4").tobytes(), len(ids) + 1
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        piece = (doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n)
                        if length == capacity:
                            rows.append((*piece, sequence, 0))
                            sequence += 1
                        else:
                            rests.append(piece)
                    if len(rests) >= BLOCK:
                        yield flush()
                yield batch_of(rows)
        yield flush()

    return run


def packed_sequences(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A sequence is padded to the capacity, unless its own length is a power of two. `vocabulary` is the
    `tokenizers` file, `ranks` the same vocabulary for tiktoken.
    """
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_packer(vocabulary, ranks, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
