"""Quality by weak supervision: rules vote or abstain, EM estimates how far to trust each, posteriors decide.

Words stand between ASCII white space. Base signals and the base rule (`base_failed`) are fixed; beyond
them, each of the `rules` votes good (1), bad (-1) or abstains (0). The rules are strict: many good documents get a bad
vote from some rule, so that asking for all of them to pass would lose these. A two-class model in which votes are
independent given the class is fitted by expectation maximisation to the counts of vote patterns over all
documents (at most 3 to the power of the number of rules, so the driver's input is bounded: 59,049). Each rule has its
own accuracy in either class; abstentions tell nothing. Rules that look at the same thing (`FAMILIES`) share one
vote's weight. Prior counts say only which class is the bad one. A document is kept if the base rule holds and its
posterior of being good is at least one half.

Defined results. Null, empty or blank text: no words, base failed, not kept. Repeated rows and null ids:
judged each by its text. Empty table: no rows. Very long texts: exact signals. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import CASED, durable, mix, text_bytes, text_slices, word_hashes, words

WINDOW = 5
ROUNDS = 60
#: Each class is at least this likely.
LEAST_CLASS = 0.005
#: Prior counts as a share of all documents, and the bad votes expected of a rule in a bad and in a good document.
PRIOR_SHARE, PRIOR_BAD, PRIOR_GOOD = 0.002, 0.4, 0.02
#: Rules that vote on the same thing.
FAMILIES = [("repeats", "dup_lines", "distinct")]

SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_stops", "n_distinct"]


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, Column]:
    """The votes as columns over the signals."""
    length, symbols, repeats = _share("word_chars", "n_words"), _share("n_symbols", "n_words"), _share("n_repeat_words", "n_words")
    upper, digits, stops, distinct = _share("n_upper", "n_letters"), _share("n_digits", "word_chars"), _share("n_stops", "n_words"), _share("n_distinct", "n_words")
    copies, line = _share("n_dup_lines", "n_lines"), _share("n_words", "n_lines")
    letters = F.col("n_letters") / F.greatest(F.col("word_chars") - F.col("n_digits"), F.lit(1))  # of what isn't a digit
    return {
        "symbols": _vote(symbols > 0.1, symbols <= 0.01),
        "letters": _vote(letters < 0.92, letters >= 0.95),
        "word_length": _vote((length < 4.5) | (length > 7), (length >= 4.6) & (length <= 6)),
        "repeats": _vote(repeats > 0.1, repeats <= 0.02),
        "dup_lines": _vote(copies > 0.2, copies <= 0.02),
        "distinct": _vote((distinct < 0.3) & (F.col("n_words") >= 30), distinct >= 0.4),
        "upper": _vote(upper > 0.05, upper <= 0.035),
        "digits": _vote(digits > 0.03, digits <= 0.01),
        "stops": _vote((stops < 0.05) | (stops > 0.4), (stops >= 0.1) & (stops <= 0.3)),
        "line": _vote((line < 8) | (line > 400), line >= 15),
    }


def vote_weights(names: list[str]) -> np.ndarray:
    """What each rule's vote weighs: 1, or its part of its family's."""
    return np.array([1 / len(next((f for f in FAMILIES if n in f), (n,))) for n in names])


def _signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    for batch in batches:
        for part in text_slices(batch):
            column = part.column("text")
            offsets, raw = text_bytes(column)
            data = np.frombuffer(raw, np.uint8)

            def summed(flags: np.ndarray) -> np.ndarray:
                upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
                return upto[offsets[1:]] - upto[offsets[:-1]]  # noqa: B023

            head = (data & 0xC0) != 0x80
            blank = ((data >= 9) & (data <= 13)) | (data == 32)
            upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
            first, starts, ends, found = words(column, CASED)
            hashes = word_hashes(found)
            n_words = np.diff(first)
            row = np.repeat(np.arange(len(n_words)), n_words)

            # Windows that are found twice or more in their text, and the words that these cover.
            grams = mix(hashes + mix(row.astype(np.uint64) + np.uint64(1)))
            for k in range(1, WINDOW):
                if len(grams) > k:
                    grams[:-k] = mix(grams[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
            places = np.flatnonzero(np.arange(len(row)) + WINDOW <= first[1:][row]) if len(row) else np.zeros(0, np.int64)
            own = grams[places]
            ordered = np.sort(own)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            hit = places[np.isin(own, twice)] if len(twice) else np.zeros(0, np.int64)
            steps = np.zeros(len(row) + 1, np.int64)
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + WINDOW, -1)
            repeated = np.bincount(row[np.cumsum(steps)[:-1] > 0], minlength=len(n_words)) if len(row) else np.zeros(len(n_words), np.int64)

            # Distinct words of each text.
            distinct = np.fromiter((len(np.unique(hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)), np.int64, len(n_words))
            n_lines, n_dup = [], []
            for text in column.to_pylist():
                own_lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
                n_lines.append(len(own_lines)), n_dup.append(len(own_lines) - len(set(own_lines)))
            stops = np.isin(data[ends - 1], list(b".?!")) if len(ends) else np.zeros(0, bool)
            values = [
                n_words, summed(head & ~blank), summed(symbol[data]), n_dup, repeated, n_lines, summed(upper), summed(upper | lower | ((data >= 0xC3) & head)), summed((data >= 48) & (data <= 57)),
                np.bincount(row[stops], minlength=len(n_words)), distinct,
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.asarray(v, np.int64)) for v in values)], names=["doc_id", *SIGNALS])


def fit_votes(patterns: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Posterior of the good class for each vote pattern (rows of -1, 0, 1), by EM over the counts.

    For each rule that votes, the probability of a bad vote in either class is estimated (its accuracies);
    an abstention tells nothing. Prior counts, worth `PRIOR_SHARE` of the documents, tell the classes apart.
    """
    if not len(patterns):
        return np.zeros(0)
    weights = np.ones(patterns.shape[1]) if weights is None else weights
    share = counts / counts.sum()
    bad_vote, good_vote = (patterns < 0).astype(float), (patterns > 0).astype(float)
    good = (1 + good_vote.sum(axis=1)) / (2 + good_vote.sum(axis=1) + 2 * bad_vote.sum(axis=1))
    for _ in range(ROUNDS):
        logs = []
        for r, expected in ((1 - good, PRIOR_BAD), (good, PRIOR_GOOD)):
            mass = share * r
            prior = np.clip(mass.sum(), LEAST_CLASS, 1 - LEAST_CLASS)
            bad = (mass @ bad_vote + PRIOR_SHARE * expected) / (mass @ (bad_vote + good_vote) + PRIOR_SHARE)
            logs.append(np.log(prior) + bad_vote @ (weights * np.log(bad)) + good_vote @ (weights * np.log(1 - bad)))
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return good


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base signals, base_failed, kept, p_good and the votes for good and for bad of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    votes = rules()
    signals = texts.mapInArrow(_signals, "doc_id long, " + ", ".join(f"{s} long" for s in SIGNALS))
    code = sum(((v.cast("int") + 1) * 3**k for k, v in enumerate(votes.values())), F.lit(0))
    signals = durable(signals.withColumn("pattern", code))
    counts = signals.groupBy("pattern").count().collect()  # at most 3**len(votes) rows
    codes = np.array([r["pattern"] for r in counts], np.int64)
    patterns = np.stack([codes // 3**k % 3 - 1 for k in range(len(votes))], axis=1) if len(codes) else np.zeros((0, len(votes)), np.int64)
    good = fit_votes(patterns, np.array([r["count"] for r in counts], np.float64), vote_weights(list(votes)))
    rows = [(int(c), float(g), int((p > 0).sum()), int((p < 0).sum())) for c, g, p in zip(codes, good, patterns, strict=True)]
    posterior = docs.sparkSession.createDataFrame(rows, "pattern int, p double, votes_good int, votes_bad int")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return signals.join(F.broadcast(posterior), "pattern").select(
        "doc_id", *SIGNALS[:5], base_failed.alias("base_failed"), (~base_failed & (F.col("p") >= 0.5)).alias("kept"), F.round("p", 6).alias("p_good"), "votes_good", "votes_bad"
    )
