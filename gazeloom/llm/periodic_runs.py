"""Operator 11: periodic runs of words by minimizers on several scales.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at
least three periods and at least so many words. Periods below SCALE are found by direct scans: for each lag,
where words that far apart are equal. For longer ones there is a scale for each doubling of a width w, for periods from w to 2w:

- Each place has a fingerprint of the w words from there, made of those of the scale before.
- A place is a minimizer if its fingerprint is the least in some window of w places. In a run of period q >= w the
  windows at distance q are alike, so their minima repeat at distance q.
- Equal minimizers at a distance of w to 2w are seeds. Each is extended to both sides, word by word, to the whole stretch with that lag.

Words with a period of at most w/3 of their own (in a run that a smaller scale has found) would seed every repetition; places of them
take no part. What is left has equal fingerprints more than w/3 apart, so a place has a few seeds at most. A run of
period q isn't made of such places alone: it would have the small period throughout; and the first other place behind them, which holds where they
end, is the minimum of a window within the run's first two periods. So no run is missed, and each found stretch is checked word by word.

The documents of a batch are laid behind one another, with a number of its own between any two, and scanned at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gazeloom.llm.common import labelled_text, release, table, texts, tidy

#: Periods below are found by direct scans; the width of the first scale.
SCALE = 32
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of documents that are scanned at once; a longer document is scanned alone.
BATCH_WORDS = 500_000


class WordNumbers(dict):
    """A number for each word, the same for equal words alone."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def mixed(x):
    """64-bit numbers spread over all 64 bits, each to another."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(marks, width: int):
    """Fingerprints of 2 * width words at each place, from those of width words."""
    import numpy as np

    return mixed(marks[:-width] * np.uint64(0x9E3779B97F4A7C15) + marks[width:])


def slid(values, width: int, least: bool):
    """The least or greatest of each `width` neighbours, width a power of two."""
    import numpy as np

    pick, step = (np.minimum if least else np.maximum), 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def minimizers(marks, width: int, free):
    """Places whose fingerprint is the least of some window of `width` places, among those that are free."""
    import numpy as np

    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    own = np.where(free, marks, top)
    if len(own) < width:
        return np.empty(0, np.int64)
    low = slid(own, width, True)
    edge = np.zeros(width - 1, np.uint64)
    highest = slid(np.concatenate([edge, low, edge]), width, False)  # over the windows that hold each place
    return np.flatnonzero((own == highest) & free)


def seeds(marks, places, width: int):
    """Pairs of places of equal fingerprint, width to 2 * width apart: the first of each and the lag, in order of lag and place."""
    import numpy as np

    own = marks[places]
    order = np.lexsort((places, own))
    places, own = places[order], own[order]
    firsts, lags, ahead = [], [], 1
    while ahead < len(places):
        near = (own[ahead:] == own[:-ahead]) & (places[ahead:] - places[:-ahead] < 2 * width)
        if not near.any():
            break
        far = np.flatnonzero(near & (places[ahead:] - places[:-ahead] >= width))
        firsts.append(places[far])
        lags.append(places[far + ahead] - places[far])
        ahead += 1
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, lag = np.concatenate(firsts), np.concatenate(lags)
    order = np.lexsort((first, lag))
    return first[order], lag[order]


def reach(a, b) -> int:
    """How many leading words of two arrays are equal."""
    import numpy as np

    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : at + step][: n - at] != b[at : at + step][: n - at]
        if differ.any():
            return at + int(np.argmax(differ))
        at, step = at + step, step * 2
    return n


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def has_smaller_period(words, start: int, end: int, lag: int) -> bool:
    """Whether a stretch of at least two lags, with period lag, has a smaller one. It would divide the lag."""
    return any(reach(words[start : end - lag // p], words[start + lag // p : end]) == end - start - lag // p for p in prime_factors(lag))


def find_runs(words, ends, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, scale: int = SCALE) -> list[tuple[int, int, int]]:
    """All runs in documents that are laid behind one another: (start, length, period), in order of start and period.

    words: an array of word numbers, 0 or more. ends: where each document ends; the place there holds a number that occurs once.
    scale: a power of two, at least least_words: then words of a period up to a third of a scale's width always lie in a run. least_periods: at least 3.
    """
    import numpy as np

    if least_periods < 3 or scale < least_words or scale & (scale - 1):
        raise ValueError("find_runs needs three periods or more, and a power of two of at least least_words as scale")
    n = len(words)
    sizes = np.diff(ends, prepend=-1) - 1
    longest = int(sizes.max(initial=0))
    runs: list[tuple[int, int, int]] = []
    short = np.zeros(n + 1, np.int64)  # for each place, the most words from there that a run of a period up to a third of the scale holds
    for lag in range(1, min(scale, longest // least_periods + 1)):
        need = max(least_words, least_periods * lag) - lag
        same = np.flatnonzero(words[:-lag] == words[lag:])
        if len(same) < need:
            continue
        breaks = np.flatnonzero(np.diff(same) != 1)
        first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(same) - 1]])
        for k in np.flatnonzero(last - first + 1 >= need):
            start, end = int(same[first[k]]), int(same[last[k]]) + 1 + lag
            if lag == 1 or not has_smaller_period(words, start, end, lag):
                runs.append((start, end - start, lag))
    # Places of the documents that are long enough for a scale, fingerprints of so many words there.
    marks = mixed(words.astype(np.uint64) * np.uint64(2) + np.uint64(0x632BE59BD9B4E019))
    width = 1
    while least_periods * max(width, scale) <= longest:
        if width < scale:
            marks, width = joined(marks, width), width * 2
            continue
        # Only documents of three widths or more hold runs of this scale; places of others aren't free.
        free = np.repeat(sizes >= least_periods * width, sizes + 1)[: len(marks)]
        for start, length, period in runs:
            if 3 * period <= width <= length:
                free[start : start + length - width + 1] = False
        first, lag = seeds(marks, minimizers(marks, width, free), width)
        covered_lag, covered = 0, 0
        for m, q in zip(first.tolist(), lag.tolist(), strict=True):
            if q == covered_lag and m < covered:
                continue
            right = reach(words[m:], words[m + q :])
            left = reach(words[:m][::-1], words[: m + q][::-1])
            start, end = m - left, m + right + q
            covered_lag, covered = q, m + right
            if end - start >= least_periods * q and end - start >= least_words and not has_smaller_period(words, start, end, q):
                runs.append((start, end - start, q))
        if least_periods * 2 * width > longest:
            break
        marks, width = joined(marks, width), width * 2
    return sorted(runs, key=lambda run: (run[0], run[2]))


def dropped(n: int, runs: list[tuple[int, int, int]]):
    """Which of n words a run contains after its first period."""
    import numpy as np

    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; ties to the smaller start, then period."""
    from fractions import Fraction

    return min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)


def scan(documents: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS):
    """The runs of each of some lists of words."""
    import numpy as np

    at = 0
    while at < len(documents):
        group, total, number = [], 0, WordNumbers()
        while at < len(documents) and (not group or total + len(documents[at]) <= BATCH_WORDS):
            group.append(np.fromiter(map(number.__getitem__, documents[at]), np.int64, len(documents[at])))
            total += len(documents[at]) + 1
            at += 1
        ends = np.cumsum([len(x) + 1 for x in group]) - 1
        # Between documents stand numbers that no word has.
        words = np.concatenate([part for k, x in enumerate(group) for part in (x, [len(number) + k])])
        found: list[list[tuple[int, int, int]]] = [[] for _ in group]
        own = 0
        for start, length, period in find_runs(words, ends, least_words, least_periods):
            while start > ends[own]:
                own += 1
            found[own].append((start - (int(ends[own - 1]) + 1 if own else 0), length, period))
        yield from found


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document as query op11 takes them: some documents, by crc32 of doc_id, repeat a part of themselves to their end. A document without doc_id stays as it is."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


Change = Callable[[int | None, list[bytes]], list[bytes]]


def run_batches(batches, change: Change | None, least_words: int, least_periods: int):
    """For each Arrow batch of doc_id and text: doc_id, the words of each document, and its runs."""
    release()
    for batch in batches:
        names = batch.column("doc_id").to_pylist()
        documents = [text.encode().split() for text in texts(batch.column("text"))]
        if change:
            documents = [change(i, words) for i, words in zip(names, documents, strict=True)]
        yield batch.column("doc_id"), documents, list(scan(documents, least_words, least_periods))


def periodic_runs(docs: DataFrame, change: Change | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Every run of the documents: doc_id, start (number of its first word, from 0), length (in words), period.

    Words are what stands between spaces, tabs, line ends, vertical tabs and form feeds; they are equal if their bytes are. A run has the smallest period of its
    words, at least least_words words (at most 32 may be asked for) and least_periods periods (at least 3), and no neighbouring word extends it. A null or empty text has none. Repeated rows give repeated
    results; a null doc_id stays null; other columns are not read. change: makes other words of a document's (doc_id, words) before. No row is moved.
    """

    def run(batches):
        import pyarrow as pa

        for names, _, found in run_batches(batches, change, least_words, least_periods):
            rows = [(k, *x) for k, runs in enumerate(found) for x in runs]
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([names.take(columns[0]), *columns[1:]], ["doc_id", "start", "length", "period"])

    return labelled_text(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame, change: Change | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Documents with each run cut down to its first period: doc_id, text (kept words joined by one space), n_words, n_dropped. Other rules as in periodic_runs()."""

    def run(batches):
        import pyarrow as pa

        for names, documents, found in run_batches(batches, change, least_words, least_periods):
            kept = [[w for w, gone in zip(words, dropped(len(words), runs), strict=True) if not gone] if runs else words for words, runs in zip(documents, found, strict=True)]
            sizes = [len(x) for x in documents]
            yield pa.RecordBatch.from_arrays(
                [names, pa.array([b" ".join(x).decode() for x in kept], pa.string()), pa.array(sizes, pa.int64()), pa.array([n - len(x) for n, x in zip(sizes, kept, strict=True)], pa.int64())],
                ["doc_id", "text", "n_words", "n_dropped"],
            )

    return labelled_text(docs).mapInArrow(run, "doc_id long, text string, n_words long, n_dropped long")


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@tidy
def digest_runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """The runs and the collapsed text of each document in numbers and digests, one row a document, made in the task that finds the runs.

    Returns doc_id, n_runs; start, length, period and exponent_milli (thousandths of periods, cut) of the run of most periods, null without runs;
    runs_sha256 of the lines `start,length,period` of all; collapsed_sha256 of the kept words joined by one space. A null or empty text has no runs and the
    digests of nothing. Other rules as in periodic_runs().
    """

    def run(batches):
        import pyarrow as pa

        for names, documents, found in run_batches(batches, change, LEAST_WORDS, LEAST_PERIODS):
            rows = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            for words, runs in zip(documents, found, strict=True):
                best = strongest(runs)
                kept = [w for w, gone in zip(words, dropped(len(words), runs), strict=True) if not gone] if runs else words
                for k, v in zip(rows, (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2]), strict=False):
                    rows[k].append(v)
                rows["runs_sha256"].append(hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest())
                rows["collapsed_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([names, *(pa.array(v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in rows.items())], ["doc_id", *rows])

    return labelled_text(docs).mapInArrow(run, DIGEST)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of documents, after some documents were made to repeat a part of themselves."""
    return digest_runs(table(spark, sf_dir, "documents"), plant)
