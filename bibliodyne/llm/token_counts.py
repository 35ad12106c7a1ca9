"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The vocabulary is a sentence-piece BPE with byte fallback. Its encoding has a local property: a sequence of
pieces is the encoding of its text exactly if every adjacent pair is the encoding of that pair's text (a merge
across a border would happen in the pair alone, too, since merges elsewhere do not change what stands at the
border). So the encoding of a prefix is that of a shorter prefix and one last piece, and the state of a prefix is
the length of its last piece and its count: ``count[i] = count[i - length] + weight``. A character outside the
vocabulary merges with nothing and weighs its bytes.

No piece holds a blank after another character, so texts fall into units (blanks and the word after them, or one
character that stands in no longer piece) which no merge crosses; counts of a text's prefixes are the sums of the
units before, plus those of the unit's own prefix. A worker remembers the counts of the units it has seen.

``prefix_table`` stores the counts at all prefixes. Questions of truncation and budget (``tokens_at``,
``longest_prefix``) are array expressions over that table: no text is read or encoded again. Counts do not grow with
every character (a longer prefix may close a piece), so the longest prefix within a budget is the last one that fits.

A null text counts as empty: no tokens, one prefix. Texts of any length are counted whole, a batch at a time; a unit of
any length takes time linear in it. Repeated rows give equal rows, a null doc_id stays null, an empty table gives no
rows, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, chain, pairwise
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliodyne.llm.memory import release

#: The character that stands for a blank in pieces.
BLANK = "▁"
LIMIT = 4096
#: Units a worker remembers before it starts over, and the longest one it remembers.
MEMO_UNITS, MEMO_LENGTH = 500_000, 64
#: Texts whose units are counted together.
BLOCK = 512


class Pieces:
    """Pieces with their scores, and where texts may be cut."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in n if not special(i)}
        if any(a != BLANK and b == BLANK for piece in self.score for a, b in pairwise(piece)):
            raise ValueError("a piece holds a blank after another character")
        joined = set(chain.from_iterable(p for p in self.score if len(p) > 1))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined and chr(c) != " ")
        self.units = re.compile(f"[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        # Lengths that a piece may have before a position, by the last characters there, the longest first.
        self.by_two = {p: (2, 1) for p in self.score if len(p) == 2}
        self.by_three: dict[str, tuple[int, ...]] = {}
        for end, size in sorted({(p[-3:], len(p)) for p in self.score if len(p) > 2}):
            self.by_three[end] = (size, *self.by_three.get(end, self.by_two.get(end[1:], (1,))))
        self.made: dict[str, tuple[float, str, str] | None] = {}
        self.adjacent = lru_cache(maxsize=1 << 18)(self._adjacent)

    def merged(self, text: str, border: int = 0) -> list[str] | None:
        """The encoding by its definition: of the adjacent pairs that make a piece the one of the highest score
        merges, the leftmost among equals. None as soon as a merge crosses ``border``."""
        parts = list(text)
        while (best := self._best(parts)) is not None:
            at = best[1]
            if border and sum(map(len, parts[: at + 1])) == border:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _best(self, parts: list[str]) -> tuple[float, int] | None:
        """Score and place of the pair that merges next."""
        found = [(self.score[a + b], -i) for i, (a, b) in enumerate(pairwise(parts)) if a + b in self.score]
        return (max(found)[0], -max(found)[1]) if found else None

    def _made(self, piece: str) -> tuple[float, str, str] | None:
        """Score and halves of the merge that makes a piece, None for a character.

        Only if its merges happen in the order of their scores, which ``_adjacent`` relies on; else an error."""
        if piece not in self.made:
            parts, last = list(piece), None
            while len(parts) > 1 and (best := self._best(parts)) is not None:
                if last is not None and best[0] > last[0]:
                    raise KeyError(piece)
                at = best[1]
                last = best[0], parts[at], parts[at + 1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) > 1:
                raise KeyError(piece)
            self.made[piece] = last
        return self.made[piece]

    def _adjacent(self, a: str, b: str) -> bool:
        """Whether the encoding of ``a + b`` is these two pieces (that of ``b`` is this one, if ``a`` is empty).

        Goes back in time from the two whole pieces: the one made last is replaced by its half at the border. A
        merge across the border must not have been due before it. Of equal scores the left merge comes first."""
        if not a:
            return self.merged(b) == [b]
        try:
            left, right, due, strict = a, b, -np.inf, True
            while True:
                across = self.score.get(left + right)
                if across is not None and (across > due or (across == due and not strict)):
                    return False
                x, y = self._made(left), self._made(right)
                if x is None and y is None:
                    return True
                if y is None or (x is not None and x[0] < y[0]):
                    due, left, strict = x[0], x[2], True
                else:
                    due, right, strict = y[0], y[1], False
        except KeyError:
            return self.merged(a + b, len(a)) == [a, b]

    def states(self, units: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Units, sorted, with the token counts of their prefixes from the empty one on.

        A unit takes over the states of the prefix that it shares with the one before."""
        score, by_three, by_two, adjacent = self.score, self.by_three, self.by_two, self.adjacent
        path, length, count = "", [0], [0]
        for unit in sorted(units):
            shared = len(commonprefix((path, unit)))
            del length[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(unit) + 1):
                sizes = by_three.get(unit[end - 3 : end]) if end > 2 else None
                for size in sizes or by_two.get(unit[max(0, end - 2) : end], (1,)):
                    start = end - size
                    if start < 0 or ((piece := unit[start:end]) not in score and size > 1):
                        continue
                    if adjacent(unit[start - length[start] : start], piece):
                        length.append(size)
                        count.append(count[start] + (1 if piece in score else len(piece.encode("utf-8", "surrogatepass"))))
                        break
                else:
                    raise AssertionError(f"no last piece at {end} of {unit[:80]!r}")
            path = unit
            yield unit, count


class Counts:
    """Token counts of units at their ends (``whole``) or at all prefixes, remembered from block to block."""

    def __init__(self, path: str, whole: bool) -> None:
        self.pieces, self.whole = Pieces(path), whole
        self.known: dict[str, int | np.ndarray] = {}

    def of_texts(self, texts: Iterable[str | None]) -> Iterator[list[int | np.ndarray]]:
        """The counts of each text's units, in order."""
        for block in batched(texts, BLOCK):
            split = [self.pieces.units.findall((" " + t).replace(" ", BLANK)) if t else [] for t in block]
            wanted = set(chain.from_iterable(split))
            if len(self.known) > MEMO_UNITS:
                self.known = {}
            new = wanted.difference(self.known)
            for unit, count in self.pieces.states(new):
                self.known[unit] = count[-1] if self.whole else np.array(count[1:], dtype=np.int32)
            for units in split:
                yield list(map(self.known.__getitem__, units))
            for unit in new:
                if len(unit) > MEMO_LENGTH:
                    del self.known[unit]

    def totals(self, texts: Iterable[str | None]) -> list[int]:
        return [sum(x) for x in self.of_texts(texts)]

    def prefixes(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """For each text the counts at the prefixes of 0, 1, ... characters; one more than characters."""
        for found in self.of_texts(texts):
            before = np.cumsum([0, *(f[-1] for f in found[:-1])])
            counts = np.concatenate([f + b for f, b in zip(found, before, strict=True)]) if found else np.zeros(1)
            # The blank before the text is no prefix of it, and an empty text has no tokens at all.
            counts[0] = 0
            yield counts.astype(np.int32)


@lru_cache(maxsize=4)
def counts(path: str, whole: bool) -> Counts:
    return Counts(path, whole)


def prefix_counts(path: str) -> Column:
    """Token counts at all prefixes of the column ``text``, as an array: element i + 1 is that of i characters."""

    @F.pandas_udf("array<int>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(counts(path, False).prefixes(texts)), dtype=object)
        release()

    return counted("text")


def token_count(path: str) -> Column:
    """Tokens of the whole column ``text``: the count at its last prefix."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counts(path, True).totals(texts), dtype="int64")
        release()

    return counted("text")


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, counts): the token counts at all prefixes of each text."""
    return docs.select("doc_id", prefix_counts(path).alias("counts"))


def tokens_at(counts: Column, characters: Column | int) -> Column:
    """Tokens of the first ``characters`` characters (of the whole text, if it is shorter)."""
    at = characters if isinstance(characters, Column) else F.lit(characters)
    return F.element_at(counts, F.least(F.greatest(at, F.lit(0)) + 1, F.size(counts)).cast("int"))


def longest_prefix(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    # The empty prefix always fits, unless the budget is negative.
    return F.size(counts) - F.array_position(F.reverse(F.transform(counts, lambda c: c <= limit)), True).cast("int")


def truncate(docs: DataFrame, table: DataFrame, budget: int) -> DataFrame:
    """``docs`` (with unique doc_id) with the texts cut to their longest prefix of at most ``budget`` tokens."""
    cuts = table.select(F.col("doc_id").alias("_cut_id"), longest_prefix(F.col("counts"), budget).alias("_cut"))
    met = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("_cut_id")), "left")
    return met.withColumn("text", F.substring("text", F.lit(1), F.coalesce("_cut", F.lit(0)))).drop("_cut_id", "_cut")


def token_table(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count(path).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
