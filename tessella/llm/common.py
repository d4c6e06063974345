"""What the corpus operators share: cutting lineage, and Arrow kernels for words.

The kernels work on whole Arrow string columns (a slice of a few MB at a time), so Python never
loops over words; per-document work is left to each operator.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20

#: ASCII white space of the contracts: [\x20\x09-\x0D]. Everything else belongs to a word.
BLANKS = bytes(range(9, 14)) + b" "


def byte_table(separators: bytes, lower: bool) -> bytes:
    """A bytes.translate table: separators become a blank, A-Z lower case if asked for."""
    out = bytearray(range(256))
    if lower:
        for c in range(ord("A"), ord("Z") + 1):
            out[c] = c + 32
    for c in separators:
        out[c] = 32
    return bytes(out)


CASED = byte_table(BLANKS, lower=False)
LOWERED = byte_table(BLANKS, lower=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; only a local master may make up its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no recomputation.

    Files of a checkpoint that nothing refers to any more go if `spark.cleaner.referenceTracking.cleanCheckpoints` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `stored` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("stage-"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(docs: DataFrame, *stems: str) -> list[str]:
    """Column names that docs doesn't have, one for each stem; case doesn't tell names apart."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows that hold about `limit` bytes of text; one longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < n:
        base = at[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(at, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Row offsets (from 0) and the concatenated UTF-8 of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data and len(offsets) else b""
    return offsets - offsets[0], raw


def words(column: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(first word of each row and the end, word start bytes, word end bytes, words) of a string column."""
    offsets, raw = text_bytes(column)
    inside = np.frombuffer(raw.translate(table), np.uint8) != 32
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    after = before[1:].copy()
    after[:-1] = inside[1:]
    after[-1:] = False
    before = before[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    text = np.frombuffer(raw.translate(table), np.uint8)[inside].tobytes()
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(text)])
    return np.searchsorted(starts, offsets), starts, ends, found


def coded(found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense codes of the words and the distinct words."""
    encoded = found.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def word_hashes(found: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, equal on every machine."""
    codes, distinct = coded(found)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    return hashes[codes] if len(codes) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its `width`-word shingles (A-Z lowered).

    Fewer words: the whole sequence is one shingle. No words or null: empty.
    """
    first, _, _, found = words(column, LOWERED)
    hashes = word_hashes(found)
    grams = hashes.copy()
    for k in range(1, min(width, len(grams))):
        grams[: len(grams) - k] = mix(grams[: len(grams) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h)
            yield whole
        else:
            yield np.zeros(0, np.uint64)
