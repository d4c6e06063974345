"""Line dedup: documents that share rare lines or passages are aligned by patience diff; common blocks leave the later one.

Documents are lines between \n; a line's words are split at ASCII white space.

Pairs. A line of at least `LINE_WORDS` words that at most `RARE` documents hold is rare: every two of its holders are a
pair. Lines that more documents hold pair nobody by themselves; they count through the passages that they are in. For
these a document posts its minimal runs (`minimal_runs`, at most two for each line): the shortest runs of consecutive
lines that reach `block_words` words. A run pairs a document with the run's earliest holder, however many hold it. So a
passage that a third of all documents share makes as many pairs as documents, never their square, and none is left out.

Alignment (`common_blocks`). Lines that occur once in both documents are anchors; their longest increasing run by place is
kept, and each anchor grows over equal neighbours. The lines not yet aligned are aligned again in the same way, as long as a
pass aligns an eighth of them, so that moved blocks are met too. In what is left (lines found more than once, or in reverse
order), minimal runs that both hold count as aligned. Aligned lines that adjoin in the later document are a block; blocks of at least `block_words` words go from the later document (the larger id).

So every run of consecutive lines of `block_words` words or more that any earlier document holds goes. Blocks whose parts
stand apart in the earlier document go if the two documents are a pair. The first occurrence of a line is never deleted.

Pairs of one earlier document are dealt into groups of about `GROUP_LINES` lines, each with one copy of the earlier
document's hashes; only hashes are shuffled here. Texts are shuffled only if more than `BROADCAST_ROWS` documents lose lines.

Defined results. Null text: null, no lines. Empty text: unchanged. Null id: unchanged. Repeated ids: a document is an id
with a text; those of one id aren't aligned with each other, and each is cut by itself. Empty table: no rows. Extra columns
pass through, whatever their names. All lines deleted: empty text, the row stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable, fresh, mix, text_slices

LINE_WORDS = 4
BLOCK_WORDS = 25
#: A line is rare if so many documents hold it, at most.
RARE = 5
#: Lines (a document counts 16 besides its own) that are aligned with one earlier document in one group.
GROUP_LINES = 1 << 13
#: Documents that lose lines are broadcast up to this number and this many deleted blocks, else joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BLOCKS = 50_000, 500_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a line without the blanks at its ends."""
    return xxhash.xxh3_64_intdigest(line.strip(" \t\r\v\f").encode()) - (1 << 63)


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter(map(line_hash, lines), np.int64, len(lines))


def minimal_runs(own: np.ndarray, words: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the shortest run of lines that reaches block_words from each line on, and up to each line.

    Every run of block_words words or more is a union of such runs, and they depend on their own lines only. So
    a line is in a run that another document holds exactly if it is in one of these that the other document has as well.
    """
    at = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    need = max(1, block_words)
    ends = np.searchsorted(at, at[:-1] + need)
    starts = np.searchsorted(at, at[1:] - need, side="right") - 1
    forward, backward = np.flatnonzero(ends <= len(words)), np.flatnonzero(starts >= 0)
    spans = np.unique(np.concatenate([forward * (len(at)) + ends[forward], starts[backward] * len(at) + backward + 1]))
    starts, ends = spans // len(at), spans % len(at)
    lengths = ends - starts
    found = np.zeros(len(spans), np.uint64)
    hashes, width = mix(own.astype(np.int64).view(np.uint64)), 1  # hashes of `width` lines from each line on
    while len(spans) and width <= lengths.max():
        k = np.flatnonzero((lengths >= width) & (lengths < 2 * width))
        found[k] = mix(mix(hashes[starts[k]] * SPREAD + hashes[ends[k] - width]) + lengths[k].astype(np.uint64))
        hashes, width = mix(hashes[:-width] * SPREAD + hashes[width:]), 2 * width
    return found.view(np.int64), starts.astype(np.int32), ends.astype(np.int32)


def _increasing(places: list[int]) -> list[int]:
    """Positions of a longest increasing run of places, by patience piles."""
    tails: list[int] = []  # the smallest end of an increasing run of each length
    tops: list[int] = []
    back = [-1] * len(places)
    for k, place in enumerate(places):
        pile = bisect_left(tails, place)
        back[k] = tops[pile - 1] if pile else -1
        tails[pile : pile + 1] = [place]
        tops[pile : pile + 1] = [k]
    run, k = [], tops[-1] if tops else -1
    while k >= 0:
        run.append(k)
        k = back[k]
    return run[::-1]


class Earlier:
    """A document with which later ones are aligned: its lines, those that occur once, and its minimal runs."""

    def __init__(self, lines: np.ndarray, words: np.ndarray, block_words: int) -> None:
        self.lines, self.block_words = lines.tolist(), block_words
        values, first, times = np.unique(lines, return_index=True, return_counts=True)
        self.values, self.once, self.place = values, times == 1, first
        self.runs = np.unique(minimal_runs(lines, words, block_words)[0])

    def _places(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For lines: whether this document holds them, and the place of those that it holds once (else -1)."""
        if not len(self.values):
            return np.zeros(len(own), bool), np.full(len(own), -1)
        k = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        held = self.values[k] == own
        return held, np.where(held & self.once[k], self.place[k], -1)

    def aligned(self, own: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Which lines of a later document are aligned with this one."""
        held, place = self._places(own)
        done = np.zeros(len(own), bool)
        later = own.tolist()
        while True:
            left = np.flatnonzero(~done & (place >= 0))
            _, first, times = np.unique(own[left], return_index=True, return_counts=True)
            anchors = left[np.sort(first[times == 1])]
            run = anchors[_increasing(place[anchors].tolist())].tolist()
            for i in run:
                if done[i]:
                    continue  # inside the block of the anchor before
                e = int(place[i])
                a = b = 0
                while i - a > 0 and e - a > 0 and not done[i - a - 1] and later[i - a - 1] == self.lines[e - a - 1]:
                    a += 1
                while i + b + 1 < len(later) and e + b + 1 < len(self.lines) and not done[i + b + 1] and later[i + b + 1] == self.lines[e + b + 1]:
                    b += 1
                done[i - a : i + b + 1] = True
            if 8 * (len(left) - (~done & (place >= 0)).sum()) <= len(left):  # few or none: the rest is for the runs
                break
        if words[held & ~done].sum():  # lines that occur more than once
            hashes, starts, ends = minimal_runs(own, words, self.block_words)
            for k in np.flatnonzero(np.isin(hashes, self.runs)).tolist():
                done[starts[k] : ends[k]] = True
        return done

    def blocks(self, own: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the later document's aligned blocks of at least block_words words."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.aligned(own, words), [False]]).astype(np.int8)))
        return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if words[a:b].sum() >= self.block_words]


def common_blocks(earlier: np.ndarray, earlier_words: np.ndarray, later: np.ndarray, later_words: np.ndarray, block_words: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """(start, end) of the blocks that a later document, by line hashes and words of its lines, loses to an earlier one."""
    return Earlier(earlier, earlier_words, block_words).blocks(later, later_words)


def _profiles(block_words: int):
    """Each document's line hashes and word counts in order, and its posts: longer lines and minimal runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                hashes, counts, posts, sizes, n_lines = [], [], [], [0], []
                for text in part.column("text").to_pylist():
                    lines = text.split("\n")
                    own = line_hashes(lines)
                    words = np.fromiter((len(x.encode().split()) for x in lines), np.int32, len(lines))
                    single, found = np.unique(own[words >= LINE_WORDS]), np.unique(minimal_runs(own, words, block_words)[0])
                    posts.append((np.concatenate([single, found]), np.arange(len(single) + len(found)) >= len(single)))
                    hashes.append(own.tobytes()), counts.append(words.tobytes()), sizes.append(len(single) + len(found)), n_lines.append(len(lines))
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*posts, strict=True)], names=["post", "is_run"])
                posted = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), pa.array(n_lines, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary()), posted],
                    names=["doc_id", "version", "n_lines", "lines", "counts", "posted"],
                )

    return run


def _aligned(block_words: int):
    """The blocks that each later document (a group's rows) loses to the group's earlier document."""

    def run(group: pa.Table) -> pa.Table:
        is_earlier = group.column("is_earlier").to_numpy(zero_copy_only=False)
        lines, counts = (group.column(c).to_pylist() for c in ("lines", "counts"))
        views = [(np.frombuffer(x, np.int64), np.frombuffer(n, np.int32)) for x, n in zip(lines, counts, strict=True)]
        earlier = Earlier(*views[int(is_earlier.argmax())], block_words)
        rows, starts, ends = [], [], []
        for k in np.flatnonzero(~is_earlier).tolist():
            for a, b in earlier.blocks(*views[k]):
                rows.append(k), starts.append(a), ends.append(b)
        lost = group.select(["doc_id", "version"]).take(pa.array(rows, pa.int64()))
        return lost.append_column("start", pa.array(starts, pa.int32())).append_column("end", pa.array(ends, pa.int32()))

    return run


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte for each line up to the last deleted one: 1 if the line is in any of a document's blocks."""
    for batch in batches:
        gone, n_gone = [], []
        for blocks in batch.column("blocks"):
            starts, ends = (blocks.values.field(k).to_numpy() for k in (0, 1))
            depth = np.zeros(int(ends.max()) + 1, np.int64)
            np.add.at(depth, starts, 1)
            np.add.at(depth, ends, -1)
            inside = (np.cumsum(depth)[:-1] > 0).astype(np.uint8)
            gone.append(inside.tobytes()), n_gone.append(int(inside.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(gone, pa.binary()), pa.array(n_gone, pa.int64())], names=["doc_id", "version", "gone", "n_gone"])


def document_pairs(profiles: DataFrame) -> DataFrame:
    """Distinct (doc_id, version, n_lines, earlier_id, earlier_version) of documents to be aligned."""
    posted = profiles.select("doc_id", "version", "n_lines", F.inline("posted"))
    # Materialised, so that the joins have plain shuffles on both sides and adaptive execution can split a frequent post.
    firsts = posted.groupBy("post").agg(F.min(F.struct("doc_id", "version")).alias("first"), F.max("doc_id").alias("latest"), F.count("*").alias("holders"))
    firsts = durable(firsts.where(F.col("latest") > F.col("first.doc_id")).select("post", "first", "holders"))
    held = durable(posted.join(firsts, "post").where(F.col("is_run") & (F.col("doc_id") > F.col("first.doc_id")) | ~F.col("is_run") & (F.col("holders") <= RARE)))
    by_run = held.where("is_run").select("doc_id", "version", "n_lines", F.col("first.doc_id").alias("earlier_id"), F.col("first.version").alias("earlier_version"))
    rare = held.where("not is_run").groupBy("post").agg(F.collect_list(F.struct("doc_id", "version", "n_lines")).alias("own"))  # at most RARE each
    both = F.transform(
        "own",
        lambda e: F.transform(
            F.filter("own", lambda d: d.doc_id > e.doc_id),
            lambda d: F.struct(d.doc_id.alias("doc_id"), d.version.alias("version"), d.n_lines.alias("n_lines"), e.doc_id.alias("earlier_id"), e.version.alias("earlier_version")),
        ),
    )
    return by_run.union(rare.select(F.inline(F.flatten(both)))).distinct()


def deleted_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, version (hash of the text), gone (a byte for each line, 1: deleted) and n_gone of documents that lose lines."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    versioned = own.select("doc_id", F.xxhash64("text").alias("version"), "text")
    profile = "doc_id long, version long, n_lines int, lines binary, counts binary, posted array<struct<post long, is_run boolean>>"
    profiles = durable(versioned.mapInArrow(_profiles(block_words), profile).dropDuplicates(["doc_id", "version"]))
    pairs = durable(document_pairs(profiles))
    earlier = ["earlier_id", "earlier_version"]
    salts = durable(pairs.groupBy(*earlier).agg(F.ceil(F.sum(F.col("n_lines") + 16) / GROUP_LINES).cast("int").alias("salts")))
    hashes = profiles.select("doc_id", "version", "lines", "counts")
    salted = pairs.join(salts, earlier).select("doc_id", "version", *earlier, F.pmod(F.xxhash64("doc_id", "version"), F.col("salts")).cast("int").alias("salt"))
    later = salted.join(hashes, ["doc_id", "version"]).withColumn("is_earlier", F.lit(False))
    sources = salts.join(hashes.withColumnsRenamed({"doc_id": "earlier_id", "version": "earlier_version"}), earlier)
    sources = sources.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    sources = sources.select(F.col("earlier_id").alias("doc_id"), F.col("earlier_version").alias("version"), *earlier, "salt", "lines", "counts", F.lit(True).alias("is_earlier"))
    blocks = later.select(sources.columns).union(sources).groupBy(*earlier, "salt").applyInArrow(_aligned(block_words), "doc_id long, version long, start int, end int")
    lost = blocks.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("blocks"))  # no more than the document's own posts
    return lost.mapInArrow(_flags, "doc_id long, version long, gone binary, n_gone long")


def _with_gone(docs: DataFrame, block_words: int) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names: the deleted lines' flags (null: none), their number, the text that stays."""
    names = fresh(docs, "of_doc", "of_version", "gone_flags", "gone_lines", "left_text")
    doc, version, flags, n_gone, rest = names
    gone = durable(deleted_lines(docs, block_words)).select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("gone").alias(flags), F.col("n_gone").alias(n_gone))
    size = gone.agg(F.count("*").alias("n"), F.sum(F.octet_length(flags)).alias("bytes")).first()
    few = size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= 16 * BROADCAST_BLOCKS
    text = F.col("text").cast("string")
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(doc), F.xxhash64(text).alias(version))
    stays = lambda line, i: F.substring(F.col(flags), i + 1, F.lit(1)) != F.lit(b"\x01").cast("binary")
    left = F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")
    joined = keyed.join(F.broadcast(gone) if few else gone, [doc, version], "left")
    return joined.withColumn(rest, F.when(F.col(flags).isNull(), text).otherwise(left)), [flags, n_gone, rest]


def line_dedup_report(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, for each row."""
    out, (_, n_gone, rest) = _with_gone(docs.select("doc_id", "text"), block_words)
    return out.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(n_gone, F.lit(0)).cast("long").alias("n_removed"), F.col(rest).alias("text"))


def drop_repeated_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, their texts without the deleted blocks, and n_chars (if there) as the texts now have."""
    out, (flags, _, rest) = _with_gone(docs, block_words)
    changed = {"text": F.col(rest)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(flags).isNull(), F.col("n_chars")).otherwise(F.length(rest)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
