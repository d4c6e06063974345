"""Byte-level BPE: encoding with character offsets, and decoding, by the `tokenizers` library over Arrow batches.

A file of ranks (base64 bytes and a rank a line) becomes a byte-level BPE model of `tokenizers`: each byte
is written as one printable character, and each token of several bytes gives one merge, of the two parts to which the lower
ranks merge its bytes. A token that lower ranks don't reach has no merge; it is found only as a whole piece, as
with ranks alone. Texts are cut into pieces (matches of `PATTERN`) on whole slices at a time: a table tells letters, numbers
and white space apart, and pieces start where the kind changes, with the pattern's rules for one leading blank, contractions
and the last blank of a run. The table is asked of the library's own regular expressions, so that both agree on every character.
Each distinct piece is merged once, and a worker keeps the ids of up to `MEMO` pieces; ids are then spread back over the texts.

Offsets are characters: a token spans those that hold its bytes, so tokens which share the bytes of one character overlap there.
Decoding puts the bytes of the ids together again before it reads characters, so split characters come out whole; bytes
that are no UTF-8 become U+FFFD in the text and stay as they are in the bytes.

Defined results. Null or empty text: no ids. Null ids, or an id that the vocabulary lacks: null bytes and text. Null doc ids
and repeated rows: each by itself. Very long texts and pieces: encoded whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_bytes, text_slices

OTHER, LETTER, NUMBER, BLANK = range(4)
#: What follows an apostrophe in a contraction of the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: From here on no plane of Unicode has letters, numbers or white space (tags, selectors, private use, or nothing).
LAST_KIND = 0x40000
#: Pieces whose ids a worker keeps; beyond it starts anew.
MEMO = 200_000
#: Ids that are decoded together.
SLICE_IDS = 1 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    printed = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b if b in printed else next(moved)) for b in range(256)]


def merged_parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of a token that merges of lower rank leave."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < limit]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def character_kinds() -> np.ndarray:
    """LETTER, NUMBER, BLANK or OTHER for each code point, by the regular expressions of `tokenizers`."""
    from tokenizers import Regex, pre_tokenizers

    points = np.array([c for c in range(LAST_KIND) if not 0xD800 <= c < 0xE000])
    text, kinds = "".join(map(chr, points.tolist())), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        matched = np.ones(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            matched[a:b] = False
        kinds[points[matched]] = kind
    return kinds


def piece_starts(points: np.ndarray, kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character; `rows` are the places at which texts start (and the end)."""
    n = len(points)
    kind = kinds[points]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[rows] = True
    fence = np.zeros(n + 1, bool)  # texts start here
    fence[rows] = True
    # The last character of a run of white space before something else: a blank joins what follows, any other stands alone.
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~fence[1:n]) if n else np.zeros(0, np.int64)
    start[last] = True
    joins = points[last] == ord(" ")
    start[last[joins] + 1] = False
    # Contractions: an apostrophe at which a piece starts, and letters after it.
    quotes = np.flatnonzero((points == ord("'")) & start[:n])
    row_end = rows[np.searchsorted(rows, quotes, side="right")] if len(quotes) else quotes
    for tail in CONTRACTIONS:
        fits = quotes + len(tail) < row_end
        at = quotes[fits]
        for k, c in enumerate(tail, 1):
            at = at[points[at + k] == ord(c)]
        start[at + 1] = False
        start[at + 1 + len(tail)] = True
    return start[:n]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TokenBytes:
    """The byte table in reverse: the bytes of all tokens, one after another, and where each token's are."""

    def __init__(self, rank_of: dict[bytes, int]) -> None:
        by_id = {r: t for t, r in rank_of.items()}
        count = max(by_id) + 1
        self.known = np.array([i in by_id for i in range(count)])
        self.sizes = np.array([len(by_id.get(i, b"")) for i in range(count)], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(count)), np.uint8)

    def decode(self, ids: pa.ListArray) -> list[bytes | None]:
        """The bytes of each list of ids."""
        rows, flat = ids.offsets.to_numpy(), ids.values
        rows, flat = rows - rows[0], flat.slice(int(rows[0]), int(rows[-1] - rows[0]))
        numbers = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sound = (numbers >= 0) & (numbers < len(self.known))
        sound[sound] = self.known[numbers[sound]]
        numbers = np.where(sound, numbers, 0)
        sizes = np.where(sound, self.sizes[numbers], 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        joined = self.bytes[np.repeat(self.places[numbers] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        wrong = np.concatenate([[0], np.cumsum(~sound)])
        spans = zip(ends[rows[:-1]].tolist(), ends[rows[1:]].tolist(), (wrong[rows[1:]] > wrong[rows[:-1]]).tolist(), ids.is_valid().to_pylist(), strict=True)
        return [joined[a:b] if valid and not bad else None for a, b, bad, valid in spans]


class ByteBpe:
    """Ids of texts under a file of ranks, and their bytes."""

    def __init__(self, ranks: str) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        rank_of = read_ranks(ranks)
        character = byte_characters()
        written = {token: "".join([character[b] for b in token]) for token in rank_of}
        pairs = (merged_parts(token, rank_of) for token in sorted(rank_of, key=rank_of.get) if len(token) > 1)
        merges = [(written[p[0]], written[p[1]]) for p in pairs if len(p) == 2]
        self.tokenizer = Tokenizer(models.BPE({written[t]: r for t, r in rank_of.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kinds = character_kinds()
        self.sizes = TokenBytes(rank_of).sizes
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}  # of a piece; its ids are merged[first[number] : first[number + 1]]
        self.first, self.merged = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces, merged if they are new."""
        if len(self.number) > MEMO:
            self._forget()
        new = [p for p in pieces if p not in self.number]
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
            piece_ends = np.cumsum(np.fromiter((len(p.encode()) for p in new), np.int64, len(new)))
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), piece_ends) + 1
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.first = np.concatenate([self.first, ends + len(self.merged)])
            self.merged = np.concatenate([self.merged, ids])
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, column: pa.Array, offsets: bool = True) -> tuple[np.ndarray, ...]:
        """(first token of each row and the end, ids) of a string column, and with offsets (first characters, ends), counted from the row's first."""
        rows, raw = text_bytes(column)
        octets = np.frombuffer(raw, np.uint8)
        heads = np.flatnonzero((octets & 0xC0) != 0x80)  # bytes at which characters start
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        row_chars = np.searchsorted(heads, rows)
        starts = piece_starts(points, self.kinds, row_chars)
        cuts = np.append(heads[starts], len(raw))
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        codes = self._numbers(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        counts = np.diff(self.first)[codes]
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = self.merged[np.repeat(self.first[codes] - before[:-1], counts) + np.arange(before[-1])]
        # From bytes to characters.
        stop = np.cumsum(self.sizes[ids])
        token_rows = np.searchsorted(stop, rows, side="right")
        token_rows[0] = 0
        if not offsets:
            return token_rows, ids
        character = np.cumsum((octets & 0xC0) != 0x80) - 1
        base = np.repeat(row_chars[:-1], np.diff(token_rows))
        return token_rows, ids, character[stop - self.sizes[ids]] - base, character[stop - 1] + 1 - base


@lru_cache(maxsize=2)
def model(ranks: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(ranks)


@lru_cache(maxsize=2)
def token_bytes(ranks: str) -> TokenBytes:
    """One for each Python worker."""
    return TokenBytes(read_ranks(ranks))


def _ranks(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def id_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows that hold about `SLICE_IDS` ids; one longer list is a run of its own."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_IDS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encoded(docs: DataFrame, ranks: str | None = None, offsets: bool = True) -> DataFrame:
    """doc_id and ids of each row, and, if asked for, the first and end characters of each id as starts and ends."""
    ranks = _ranks(ranks)
    lists = ["ids", "starts", "ends"] if offsets else ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows, *found = model(ranks).encode(part.column("text"), offsets)
                values = [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(v, pa.int32())) for v in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *values], names=["doc_id", *lists])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} array<int>" for c in lists)]))


def decoded(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids, and the bytes (`octets`) and text that they stand for."""
    ranks = _ranks(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in id_slices(batch):
                found = token_bytes(ranks).decode(part.column("ids"))
                texts = [None if b is None else b.decode(errors="replace") for b in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(found, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "octets", "text"])

    ids = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return ids.mapInArrow(run, "doc_id long, ids array<int>, octets binary, text string")


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids of each text and of the bytes that they decode to."""
    return decoded(encoded(docs, ranks, offsets=False), ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("octets", 256).alias("decoded_sha256"),
    )
