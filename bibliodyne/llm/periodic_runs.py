"""Periodic runs of words by enumeration of maximal pairs.

A run is a stretch of words with smallest period q, at least four periods (and six words) long, that no neighbouring
word extends. Its first two period starts are a maximal pair: the words after both agree as far as they can
(``match`` words), the words before them differ. So runs are the maximal pairs at a distance d with ``match >= 3 d``
and ``match + d >= 6``, and nothing has to be extended: start, length ``match + d`` and period d can be read off.
Multiples of the smallest period give the same start and length, and go.

Maximal pairs come from the LCP-interval tree of a text's suffixes, bottom up. Every interval has the ordered list of
its positions and their class by the word to the left; pairs are sought between the lists of different children only
(so the words to the right differ) and between different classes only (so those to the left do). An interval with a
match of l words needs partners within l / 3 words. Within that distance all places of one l-word string repeat with one
period, so of the places before a position only the farthest can have another word to its left, and after it there is
one place at most; each position costs two binary searches, smaller lists into larger ones. Intervals of under
five words hold no run, so suffixes whose first four words come once in their text are left out of the tree.

Tasks take texts in blocks of about ``BLOCK_WORDS`` words, which share one suffix sort (prefix doubling, texts kept
apart); a longer text is a block of its own. Texts are not shuffled and no group is gathered.

A null or empty text has no words and no run; very long texts are taken whole; repeated rows give equal rows; a null
doc_id stays null; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bibliodyne.llm.memory import release

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: The least match of a pair: the shortest run less its period.
LEAST_MATCH = LEAST_LENGTH - 1
BLOCK_WORDS = 200_000


def _refined(rank: np.ndarray, at: np.ndarray, second: np.ndarray) -> None:
    """Order the places ``at``, whole classes of equal rank, by ``second`` within their class. A rank is the number of
    places before the class, so places outside keep theirs."""
    first = rank[at]
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new_class = np.concatenate([[True], first[1:] != first[:-1]])
    new_group = new_class | np.concatenate([[True], second[1:] != second[:-1]])
    index = np.arange(len(at))
    class_start = np.maximum.accumulate(np.where(new_class, index, 0))
    group_start = np.maximum.accumulate(np.where(new_group, index, 0))
    rank[at[order]] = first + (group_start - class_start).astype(rank.dtype)


def suffix_tree(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes that share ``LEAST_MATCH`` - 1 words or more with another one of their text, and the matches of
    neighbours (0 at the first). ``words`` are numbers, ``text`` the text of each; no match goes beyond a text."""
    n = len(words)
    # levels[k] ranks the 2**k words from each place on, the end of a text before any word: a string that
    # reaches a text's end is like no other.
    kind = np.int32 if n < 1 << 30 else np.int64
    rank = np.zeros(n, dtype=kind)
    at = np.arange(n)
    _refined(rank, at, text * (int(words.max(initial=0)) + 1) + words)
    levels, reach = [rank], 1
    while True:
        if reach == LEAST_MATCH - 1:
            # From here on only places that are not alone are ranked; those dropped keep a rank of their own.
            at = at[np.bincount(rank, minlength=n)[rank] > 1]
            if not len(at):
                return at, at
            kept = at
        elif reach > LEAST_MATCH:
            at = at[np.bincount(rank[at], minlength=n)[rank[at]] > 1]
            if not len(at):
                break
        after = at + reach
        inside = after < n
        inside[inside] = text[after[inside]] == text[at[inside]]
        second = np.where(inside, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        rank = rank.copy()
        _refined(rank, at, second)
        levels.append(rank)
        reach *= 2
    order = kept[np.argsort(rank[kept])]
    a, b = order[:-1].copy(), order[1:].copy()
    match = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = b < n
        inside &= a < n
        same = np.zeros(len(a), dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        match += same * (1 << k)
        a += same * (1 << k)
        b += same * (1 << k)
    return order, np.concatenate([[0], match])


def maximal_pairs(order: np.ndarray, match: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, second, match) of all maximal pairs with ``second - first <= match / 3`` and a match of ``LEAST_MATCH``
    or more, from sorted suffixes, the matches of neighbours, and the class of the word before each place."""
    stack: list[tuple[int, list[int], int | None]] = []  # match of the open interval, its places, their class if one

    def joined(a: tuple[list[int], int | None], b: tuple[list[int], int | None], size: int, out: list[tuple[int, int, int]]) -> tuple[list[int], int | None]:
        (few, few_class), (many, many_class) = (a, b) if len(a[0]) < len(b[0]) else (b, a)
        one = few_class if few_class == many_class else None
        if one is None:
            window = size // (LEAST_PERIODS - 1)
            for p in few:
                left = bisect_left(many, p - window)
                if left < len(many) and (q := many[left]) < p and before[q] != before[p]:
                    out.append((q, p, size))
                right = bisect_right(many, p)
                if right < len(many) and (q := many[right]) <= p + window and before[q] != before[p]:
                    out.append((p, q, size))
        if len(few) == 1 and few[0] > many[-1]:
            many.append(few[0])
        else:
            many.extend(few)
            many.sort()
        return many, one

    found: list[tuple[int, int, int]] = []
    leaf: tuple[list[int], int | None] | None = None
    for place, size in zip(order.tolist(), [*match[1:].tolist(), 0], strict=True):
        # ``leaf`` is the subtree that ended here; ``size`` is its match with the next suffix.
        leaf = [place], int(before[place])
        while stack and stack[-1][0] > size:
            top, places, one = stack.pop()
            leaf = joined((places, one), leaf, top, found)
        if size >= LEAST_MATCH:
            if stack and stack[-1][0] == size:
                top, places, one = stack.pop()
                stack.append((size, *joined((places, one), leaf, size, found)))
            else:
                stack.append((size, *leaf))
        else:
            stack.clear()
        yield from found
        found.clear()


def runs_of(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each sequence of word numbers, by start and period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    words = np.array([w for t in texts for w in t], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(words):
        return out
    text = np.repeat(np.arange(len(texts)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    order, match = suffix_tree(words, text)
    if not len(order):
        return out
    before = np.concatenate([[-1], words[:-1]])
    before[starts[:-1][sizes > 0]] = -1
    least: dict[tuple[int, int], int] = {}
    for first, second, size in maximal_pairs(order, match, before):
        period = second - first
        if size >= (LEAST_PERIODS - 1) * period and size + period >= LEAST_LENGTH:
            key = first, size + period
            least[key] = min(period, least.get(key, period))
    for (first, length), period in least.items():
        out[text[first]].append((int(first - starts[text[first]]), length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of each run its first period stays, unless another run drops it."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the contract of the query plants in a tenth of the documents."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    times, rest = divmod(n - a, p)
    return words[:a] + root * times + root[:rest]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _blocks(column: pa.Array, ids: pa.Array, plant: bool) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Slices of a batch with their texts' words."""
    start, size, texts = 0, 0, []
    for i in range(len(column)):
        words = (column[i].as_py() or "").encode("utf-8", "surrogatepass").split()
        if size and size + len(words) > BLOCK_WORDS:
            yield start, i, texts
            start, size, texts = i, 0, []
        texts.append(planted(words, ids[i].as_py()) if plant else words)
        size += len(words)
    if texts:
        yield start, len(column), texts


def document_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, runs array of (start, length, period), collapsed): the runs of every text by start and period, and the
    text with each run cut to its first period, words joined by one blank. ``plant`` first repeats a part of some
    documents, as the registered query asks."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for s, e, texts in _blocks(batch.column("text"), ids, plant):
                numbers: dict[bytes, int] = {}
                coded = [[numbers.setdefault(w, len(numbers)) for w in words] for words in texts]
                runs = runs_of(coded)
                listed = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in x] for x in runs], RUNS)
                short = pa.array([collapsed(w, x).decode("utf-8", "surrogatepass") for w, x in zip(texts, runs, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), listed, short], names=["doc_id", "runs", "collapsed"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def runs_table(docs: DataFrame, plant: bool = True) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli (null without a run), runs_sha256 and
    collapsed_sha256 of every document."""
    from pyspark.sql import functions as F

    rows = document_runs(docs, plant)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    longest = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_min(order).alias("m"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(-1000 * F.col("m.l") / F.col("m.period")).cast("long")
    return longest.select("doc_id", "n_runs", F.col("m.start").alias("start"), (-F.col("m.l")).alias("length"), F.col("m.period").alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
