"""Periodic runs of words by Kolpakov and Kucherov's method, and texts with the repeats of runs collapsed.

A run is a stretch of consecutive words with smallest period q, of at least max(`LEAST_LENGTH`, `LEAST_EXPONENT` * q) words, that
neither neighbouring word extends with that period. For each text:

1. A suffix automaton, grown word by word, gives the LZ factorisation: each factor is the longest stretch that also
   starts earlier (copies may overlap), or one new word.
2. Main's algorithm finds the runs that cross or touch the border before a factor and end in that factor, from the longest common
   extensions at the border (Z-values). Such a run starts at most twice the last factor's and once this factor's length before it.
3. All other runs lie strictly inside a factor; they are copied from the factor's earlier occurrence.

A text is searched only where runs can be: a run holds each of its triples of consecutive words several times (`least_triples`, by
the least length and exponent), so triples that the text holds less often cut it into stretches that are searched each by itself.
That cut is exact, and it leaves few words of plain prose; a text that is periodic throughout is searched whole. Time and memory
are proportional to the text, up to the sorting of words and triples.

Collapsing drops every word that any run holds after that run's first q words.

Defined results. Null, empty or blank text: no words, no runs, an empty collapsed text. Null ids and repeated rows: each by its text.
Words are compared as they are, case and all. Very long texts: searched whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import CASED, coded, text_slices, words

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: (start, length, period), start and length in words.
Run = tuple[int, int, int]


class SuffixAutomaton:
    """All stretches of the words so far. A state's first edge lies in arrays, further ones in a dictionary of its own."""

    def __init__(self) -> None:
        self.length, self.link, self.first_end = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.word, self.target = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.last = 0

    def step(self, state: int, word: int) -> int:
        """The state that a word leads to, -1 if none."""
        if self.word[state] == word:
            return self.target[state]
        edges = self.more.get(state)
        return edges.get(word, -1) if edges else -1

    def _lead(self, state: int, word: int, target: int) -> None:
        if self.word[state] in (word, -1):
            self.word[state], self.target[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _state(self, length: int, link: int, first_end: int) -> int:
        self.length.append(length), self.link.append(link), self.first_end.append(first_end)
        self.word.append(-1), self.target.append(-1)
        return len(self.length) - 1

    def append(self, word: int) -> None:
        place = self.length[self.last]
        new, parent = self._state(place + 1, 0, place), self.last
        while parent >= 0 and self.step(parent, word) < 0:
            self._lead(parent, word, new)
            parent = self.link[parent]
        if parent >= 0:
            child = self.step(parent, word)
            if self.length[child] == self.length[parent] + 1:
                self.link[new] = child
            else:
                clone = self._state(self.length[parent] + 1, self.link[child], self.first_end[child])
                self.word[clone], self.target[clone] = self.word[child], self.target[child]
                if child in self.more:
                    self.more[clone] = dict(self.more[child])
                self.link[child] = self.link[new] = clone
                while parent >= 0 and self.step(parent, word) == child:
                    self._lead(parent, word, clone)
                    parent = self.link[parent]
        self.last = new


def factors(sequence: list[int]) -> list[tuple[int, int, int]]:
    """The LZ factorisation: (start, end, start of an earlier occurrence, -1 for a new word)."""
    automaton, out = SuffixAutomaton(), []
    start, state, matched = 0, 0, 0
    for place, word in enumerate(sequence):
        # The automaton holds the words before this place, so what it matches also starts before the factor does.
        onward = automaton.step(state, word)
        if onward < 0 and matched:
            out.append((start, place, automaton.first_end[state] - matched + 1))
            start, state, matched = place, 0, 0
            onward = automaton.step(0, word)
        if onward < 0:
            out.append((place, place + 1, -1))
            start = place + 1
        else:
            state, matched = onward, matched + 1
        automaton.append(word)
        if matched and matched <= automaton.length[automaton.link[state]]:
            state = automaton.link[state]  # the last word split the state that holds the match
    if matched:
        out.append((start, len(sequence), automaton.first_end[state] - matched + 1))
    return out


def z_values(sequence: list[int]) -> list[int]:
    """For each place the length of the longest stretch from there that the sequence begins with."""
    n = len(sequence)
    out = [n] * n if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and sequence[k] == sequence[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def border_runs(sequence: list[int], low: int, border: int, high: int, least_length: int, least_exponent: int) -> Iterator[Run]:
    """Runs within [low, high) that cross or touch the border (Main's algorithm); a period may be a multiple of the smallest."""
    before, after = sequence[low:border], sequence[border:high]
    m, n = len(before), len(after)
    most = (m + n) // least_exponent
    if m + n < least_length or not most:
        return
    back, gap = before[::-1], [-1]
    # A run whose first repeat starts at the border or later: `ahead` extends it to the right, `behind` to the left.
    ahead = z_values(after)
    behind = z_values([*back, *gap, *after[: 2 * most][::-1], *back])
    tail = m + 1 + min(n, 2 * most)  # `before` reversed starts here
    for p in range(1, min(most, n) + 1):
        right = ahead[p] if p < n else 0
        left = min(behind[tail - p], m)
        if left + right + p >= max(least_length, least_exponent * p):
            yield border - left, left + right + p, p
    # A run whose last repeat ends at the border or earlier.
    ahead = z_values([*after, *gap, *before, *after])
    behind = z_values(back)
    for p in range(1, min(most, m) + 1):
        right = min(ahead[n + 1 + m - p], n)
        left = behind[p] if p < m else 0
        if left + right + p >= max(least_length, least_exponent * p):
            yield border - p - left, left + right + p, p


def periodic_runs(sequence: list[int], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[Run]:
    """All runs of a sequence of numbers from 0, by start and then period. Exponents below 2 aren't runs."""
    if least_exponent < 2:
        raise ValueError("a run has an exponent of at least 2")
    n, ends = len(sequence), [*sequence, -2]
    whole = [*factors(sequence), (n, n + 1, -1)]  # an end that equals no word, so that runs at the end touch a border
    found: dict[int, dict[int, int]] = {}  # smallest period by start and end
    last = 0  # the length of the factor before
    for start, end, source in whole:
        low = max(0, start - 2 * last - (end - start))
        for at, length, period in border_runs(ends, low, start, end, least_length, least_exponent):
            stop = at + length
            # Runs that go on beyond this factor cross a later border.
            if (stop > n or stop < n and sequence[stop] == sequence[stop - period]) or (at and sequence[at - 1] == sequence[at - 1 + period]):
                continue
            own = found.setdefault(at, {})
            own[stop] = min(own.get(stop, period), period)
        if source >= 0 and found:
            shift = start - source
            for at in range(start + 1, end):
                for stop, period in found.get(at - shift, {}).items():
                    if stop + shift < end:
                        found.setdefault(at, {})[stop + shift] = period
        last = end - start
    return sorted(((at, stop - at, p) for at, own in found.items() for stop, p in own.items()), key=lambda r: (r[0], r[2], r[1]))


def least_triples(least_length: int, least_exponent: int) -> tuple[int, int]:
    """(width, count): each stretch of `width` words in a run occurs at least `count` times in that run; width 3, or 1 if that tells nothing."""
    for width in (3, 2):
        # Beyond this period the count stays at least_exponent - 1.
        count = min((max(least_length, least_exponent * q) - width + 1) // q for q in range(1, least_length + 2 * width + 1))
        if count >= 2:
            return width, count
    return 1, least_exponent


def stretches(codes: np.ndarray, first: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """Stretches of the texts' words, apart from which no run can be; `first` are the texts' first words and the end."""
    width, count = least_triples(least_length, least_exponent)
    n, text = len(codes), np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n < least_length:
        return []
    # Numbers of (text, word, word, word), equal exactly if all are.
    grams = text
    for k in range(width):
        later = np.full(n, -1, np.int64)
        later[: n - k] = codes[k:]
        _, grams = np.unique(grams * (len(codes) + 2) + later + 1, return_inverse=True)
    often = np.bincount(grams)[grams] >= count
    often[n - width + 1 :] = False
    often[: n - width + 1] &= text[: n - width + 1] == text[width - 1 :]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
    # Two texts' stretches never meet, as the last triples of a text reach into the next.
    spans = [(a, b + width - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + width - 1 - a >= least_length] if width > 1 else []
    if width == 1:
        cuts = np.union1d(edge, first)
        spans = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if often[a] and b - a >= least_length]
    return spans


def _scanned(least_length: int, least_exponent: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                first, _, _, found = words(part.column("text"), CASED)
                codes, _ = coded(found)
                runs: list[list[Run]] = [[] for _ in range(part.num_rows)]
                gone = np.zeros(len(codes) + 1, np.int64)  # how many runs drop a word, as steps
                for a, b in stretches(codes, first, least_length, least_exponent):
                    row = int(np.searchsorted(first, a, side="right")) - 1
                    base = a - int(first[row])
                    for start, length, period in periodic_runs(codes[a:b].tolist(), least_length, least_exponent):
                        runs[row].append((base + start, length, period))
                        gone[a + start + period] += 1
                        gone[a + start + length] -= 1
                kept = np.cumsum(gone[:-1]) == 0
                first_kept = np.concatenate([[0], np.cumsum(kept)])[first]
                lists = pa.ListArray.from_arrays(pa.array(first_kept, pa.int32()), found.filter(pa.array(kept)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs], kind),
                        pc.binary_join(lists, " "),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def collapse_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scanned(least_length, least_exponent), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_report(docs: DataFrame) -> DataFrame:
    """Of each row the number of runs, the longest run, and digests of all runs and of the collapsed text.

    Of equally long runs the one that starts first counts, then the one of the smallest period.
    """
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    best = collapse_runs(docs).withColumn("best", F.when(F.size("runs") > 0, longest))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and the text's words, of which those of every tenth document repeat from some place on (by the CRC-32 of its id).

    With h the CRC-32 of the decimal id and g = h // 10: if h % 10 = 0 and there are n > 0 words, each word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). Other rows keep their texts; a null id is planted nowhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                mark = part.column("mark").to_numpy(zero_copy_only=False)
                first, _, _, found = words(part.column("text"), CASED)
                place = np.arange(len(found))
                for row in np.flatnonzero((mark % 10 == 0) & (np.diff(first) > 0)).tolist():
                    n, g = int(first[row + 1] - first[row]), int(mark[row]) // 10
                    a = g % n
                    start = int(first[row]) + a
                    place[start : first[row + 1]] = start + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), found.take(pa.array(place)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_join(lists, " ")], names=["doc_id", "text"])

    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.crc32(doc_id.cast("string")), F.lit(1)).alias("mark"))
    return texts.mapInArrow(run, "doc_id long, text string")
