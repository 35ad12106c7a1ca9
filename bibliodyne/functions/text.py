"""Text jobs that need a loop per document: chunking, windows, and surface normalisation.

Each is a map over Arrow batches, so a task holds one batch and a document stays where it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliodyne.functions.scalar import greek_transliterated

# What starts a section, parts paragraphs, and ends a sentence (never before a digit: "Fig. 3").
HEADING = re.compile(r"^#{1,6}\s+.*", re.M)
PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"(?<=[.?!])\s+(?=[A-Za-z(])")
CHUNK = "doi string, chunk_id string, chunk_index int, total_chunks int, section_heading string, char_start int, char_end int, text string"

Piece = tuple[int, int, str]


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    return s, e


def _parts(text: str, s: int, e: int, pattern: re.Pattern[str]) -> list[tuple[int, int]]:
    """Parts of text[s:e] between matches, without outer white space."""
    part, edges = text[s:e], [0]
    for m in pattern.finditer(part):
        edges += [m.start(), m.end()]
    edges.append(len(part))
    trimmed = [_trimmed(text, s + a, s + b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return [p for p in trimmed if p[0] < p[1]]


def _packed(parts: list[tuple[int, int]], limit: int, join: int, split: Callable[[int, int], list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Neighbouring parts together while their lengths, with ``join`` characters between, stay within the
    limit; a part that is longer alone goes through ``split``."""
    out: list[tuple[int, int]] = []
    held, size = None, 0
    for s, e in parts:
        if held and (e - s > limit or size + e - s > limit):
            out.append(held)
            held, size = None, 0
        if e - s > limit:
            out += split(s, e)
        else:
            size += e - s + (join if held else 0)
            held = (held[0], e) if held else (s, e)
    return [*out, held] if held else out


def _sections(text: str) -> list[tuple[str, int, int]]:
    """(heading line, start, end) of bodies that are not blank; a text of headings alone is one body."""
    marks = [(m.group().strip(), m.start(), m.end()) for m in HEADING.finditer(text)]
    starts = [("", 0), *[(h, e) for h, _, e in marks]]
    ends = [*[s for _, s, _ in marks], len(text)]
    found = [(h, *_trimmed(text, s, e)) for (h, s), e in zip(starts, ends, strict=True)]
    return [x for x in found if x[1] < x[2]] or [("", *_trimmed(text, 0, len(text)))]


def chunks_of(text: str | None, limit: int = 1120) -> list[Piece]:
    """(start, end, heading) of chunks: bodies of sections, cut at paragraphs, sentences and then hard where they
    exceed the limit, and merged in order: under one heading up to the limit, across headings up to half
    of it under the heading of the larger part. Each is a slice of the text; a blank text has none."""
    if not text or not text.strip():
        return []
    hard = lambda s, e: [(at, min(at + limit, e)) for at in range(s, e, limit)]
    by_sentence = lambda s, e: _packed(_parts(text, s, e, SENTENCE), limit, 1, hard)
    out: list[Piece] = []
    for heading, start, end in _sections(text):
        bodies = [(start, end)] if end - start <= limit else _packed(_parts(text, start, end, PARAGRAPH), limit, 2, by_sentence)
        for s, e in bodies:
            if out:
                ls, le, last = out[-1]
                if le - ls + e - s <= (limit if heading == last else limit // 2):
                    out[-1] = (ls, e, heading if e - s > le - ls else last)
                    continue
            out.append((s, e, heading))
    return out


def spread(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` dealt by a key if they come in fewer files than there are cores: a file of one row group is one
    task, which Python work would keep to a single core."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(4 * cores, key) if len(docs.inputFiles()) < cores else docs


def chunk_markdown(docs: DataFrame, limit: int = 1120) -> DataFrame:
    """Chunks of ``docs`` (doi, text): offsets are code points, and text[start:end] is the chunk."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doi, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = chunks_of(text, limit)
                rows += [(doi, f"{doi}#chunk-{i}", i, len(found), h, s, e, text[s:e]) for i, (s, e, h) in enumerate(found)]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split(" ")[0] for c in CHUNK.split(", ")])

    return spread(docs.select("doi", "text"), "doi").mapInArrow(split, CHUNK)


def windows_of(text: str | None, size: int) -> list[str]:
    """Consecutive windows of at most ``size``: cut at the last blank line, else line end, in the last tenth
    (200 characters at least) of a window, else hard."""
    text, out, at = text or "", [], 0
    while len(text) - at > size:
        low = at + size - max(200, size // 10)
        cut = -1
        for mark in ("\n\n", "\n"):
            cut = text.rfind(mark, max(at + 1, low), at + size)
            if cut > at:
                cut += len(mark)
                break
        if cut <= at or cut > at + size:
            cut = at + size
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if text[at:] else out


def split_windows(docs: DataFrame, size: int) -> DataFrame:
    """(doi, window, text) of ``docs`` (doi, text); the windows join up to the text."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doi, text in b.itertuples(index=False):
                parts = windows_of(text, size)
                if parts:
                    yield pd.DataFrame({"doi": doi, "window": range(len(parts)), "text": parts})

    return docs.select("doi", "text").mapInPandas(split, "doi string, window int, text string")


#: Words whose final s is not a plural's, and plurals without rule.
NO_PLURAL = frozenset("analysis basis species series physics mathematics statistics gas bus lens plus virus status apparatus genus focus census consensus bias atlas chaos diabetes ethics dynamics kinetics genetics mechanics optics".split())
IRREGULAR = {"children": "child", "mice": "mouse", "men": "man", "women": "woman", "teeth": "tooth", "feet": "foot", "people": "person", "criteria": "criterion", "phenomena": "phenomenon", "bacteria": "bacterium", "matrices": "matrix", "indices": "index", "vertices": "vertex", "hypotheses": "hypothesis", "analyses": "analysis", "bases": "basis", "nuclei": "nucleus"}


def singular(word: str) -> str:
    """Rule-based singular of a lower-case English word; words of three letters or fewer stay."""
    if len(word) <= 3 or word in NO_PLURAL or word.endswith(("ss", "us", "is")):
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("ches", "shes", "xes", "sses", "zes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") else word


#: Surfaces that a worker remembers.
MEMO_SURFACES = 1 << 16


@lru_cache(maxsize=MEMO_SURFACES)
def _finished(surface: str) -> str:
    plain = unicodedata.normalize("NFKD", surface).encode("ascii", "ignore").decode()
    # Only what ends the string is stripped: a stop before a blank stays.
    words = re.sub(r"\s+", " ", re.sub(r"[.,;:!?]+$", "", plain)).strip().split(" ")
    return " ".join([*words[:-1], singular(words[-1])]).strip()


def basic_normalize(rows: DataFrame, column: str, to: str = "normalized") -> DataFrame:
    """Adds the normal form of a surface: lower case, Greek letters in Latin ones, ASCII, no trailing
    punctuation, single blanks, last word singular. Rows stay where they are, and are made once: a worker remembers
    the surfaces it has seen."""

    @F.pandas_udf("string")
    def finish(s: pd.Series) -> pd.Series:
        return s.map(_finished, na_action="ignore")

    # Not taken for deterministic: a filter by the result must not make it once more.
    return rows.withColumn(to, finish.asNondeterministic()(greek_transliterated(F.lower(column))))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Indel similarity 100 * 2 * LCS / (|a| + |b|) of two string columns; two empty strings give 100."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype=float)

    return ratio(a, b)


def indel_ratio(a: str, b: str) -> float:
    """The ratio by bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    lcs = len(a) - v.bit_count()
    return 200.0 * lcs / (len(a) + len(b))
