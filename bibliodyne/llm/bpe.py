"""Byte-level BPE encoding and decoding by depth-first traversal of a word trie.

Merge-list BPE has a local property: a token sequence is the encoding of its bytes exactly if every
adjacent pair of tokens is the encoding of that pair's bytes. The encoding of a prefix is
therefore the encoding of a shorter prefix plus one last token, and a trie node needs to remember
only that last token. Words that share a prefix share the nodes, so its states are computed once.

Every Arrow batch inserts its new distinct words. Sorted words are the trie in depth-first order:
going to the next word pops the path back to the shared prefix and adds the states that the new word asks for,
which keeps one root-to-leaf path in memory however many words there are.

Null and empty texts have no tokens. Long texts are encoded whole. Repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from bibliodyne.llm.memory import release

# Fixed value: the published split pattern of byte-level BPE, the commonest pieces first (no other starts as they do).
SPLIT = regex.compile(r" ?\p{L}++|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+")
#: Distinct words a task remembers before it forgets those that came once, or starts over.
MEMO_WORDS = 250_000
#: Texts of one Arrow batch that are split together; bounds what a batch holds besides its rows.
BLOCK = 128


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, merge ranks, and the added tokens that are cut out of texts first."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = byte_characters()
        as_bytes = lambda s: bytes(table[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.added}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[as_bytes(left), as_bytes(right)] = rank
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (left, right), rank in self.ranks.items():
            self.made.setdefault(left + right, (rank, left, right))
        # Lengths that a token may have before a position, by the last bytes there, the longest first.
        self.by_two = {t: (2, 1) for t in self.ids if len(t) == 2}
        self.by_three: dict[bytes, tuple[int, ...]] = {}
        for end, size in sorted({(t[-3:], len(t)) for t in self.ids if len(t) > 2}):
            self.by_three[end] = (size, *self.by_three.get(end, self.by_two.get(end[1:], (1,))))
        self.text_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.adjacent = lru_cache(maxsize=1 << 17)(self._adjacent)

    def merged(self, data: bytes) -> list[bytes]:
        """BPE by its definition: the lowest-ranked adjacent pair first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 30), i) for i, pair in enumerate(pairwise(parts)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether BPE of ``a + b`` gives these two tokens.

        Goes back in time from the two whole tokens: the one made last is replaced by its half at
        the border. A merge across the border must not have been due before that one. Merges
        of equal rank run from left to right, so a border merge precedes one inside ``b``.
        """
        made, ranks, due = self.made, self.ranks, 1 << 30
        while True:
            if ranks.get((a, b), 1 << 30) < due:
                return False
            x, y = made.get(a), made.get(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[0] > y[0]):
                due, a = x[0], x[2]
            else:
                due, b = y[0] + 1, y[1]

    @lru_cache(maxsize=1 << 17)  # noqa: B019 - vocabularies live as long as their worker
    def whole(self, token: bytes) -> bool:
        """Whether BPE of a token's bytes gives that token."""
        return len(self.merged(token)) == 1


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Bytes of a word up to which states are sought from its end; in longer ones all are made in order.
SHORT = 256


def encode_words(vocab: Vocabulary, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
    """Encode distinct words by walking their trie depth first.

    ``last[d]`` is the last token of the encoding of the current path's first ``d`` bytes, None until it is asked for: a
    word asks for the state at its end, and a state for those before the tokens that may end there.
    """
    ids, adjacent, whole = vocab.ids, vocab.adjacent, vocab.whole
    by_three, by_two, one = vocab.by_three.get, vocab.by_two.get, (1,)
    path, word, last = b"", b"", [b""]

    def state(d: int) -> bytes:
        for size in (by_three(word[d - 3 : d]) if d > 2 else None) or by_two(word[d - 2 if d > 2 else 0 : d], one):
            start = d - size
            if start >= 0 and (token := word[start:d]) in ids and (adjacent(last[start] or state(start), token) if start else whole(token)):
                last[d] = token
                return token
        raise ValueError(f"no token of the vocabulary ends the prefix {word[:d]!r}")

    for word in sorted(words):
        shared, n = 0, len(word)
        for a, b in zip(path, word, strict=False):
            if a != b:
                break
            shared += 1
        last[shared + 1 :] = [None] * (n - shared)
        for d in range(1, n) if n > SHORT else ():
            last[d] or state(d)
        path, d, out = word, n, []
        while d:
            token = last[d] or state(d)
            out.append(ids[token])
            d -= len(token)
        yield word, out[::-1]


class Encoder:
    """Texts to packed ids (little-endian unsigned 32-bit); remembers a bounded number of words."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.memo: dict[str, bytes] = {}
        #: Words of the memo that one block only has had.
        self.fresh: set[str] = set()

    def pieces(self, text: str) -> list[str]:
        if self.vocab.cut is None:
            return SPLIT.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.vocab.cut.split(text)):
            out += [part] if i % 2 else SPLIT.findall(part)
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        words = set().union(*split)
        new = words.difference(self.memo)
        self.fresh -= words
        if new and len(self.memo) + len(new) > MEMO_WORDS:
            # Most words come once; those that came again stay.
            for s in self.fresh:
                del self.memo[s]
            self.fresh = set()
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo, new = {}, words
        self.fresh |= new
        for s in new & self.vocab.added.keys():
            self.memo[s] = pack("<I", self.vocab.added[s])
        for word, out in encode_words(self.vocab, [s.encode() for s in new - self.vocab.added.keys()]):
            self.memo[word.decode()] = pack(f"<{len(out)}I", *out)
        memo = self.memo
        return [b"".join([memo[s] for s in x]) for x in split]

    def forget(self) -> None:
        """Drop the words and pairs of a task that is over: the worker lives on, beside and in other operators."""
        self.memo, self.fresh = {}, set()
        self.vocab.adjacent.cache_clear()
        Vocabulary.whole.cache_clear()
        release()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def decode_ids(vocab: Vocabulary, packed: bytes) -> str:
    table = vocab.text_of
    return b"".join([table[i] for i in np.frombuffer(packed, dtype="<u4").tolist()]).decode("utf-8", "replace")


def _encoded(path: str, texts: pd.Series) -> Iterator[bytes]:
    coder, values = encoder(path), texts.tolist()
    for i in range(0, len(values), BLOCK):
        yield from coder.batch([t or "" for t in values[i : i + BLOCK]])


def encode(text: Column, path: str) -> Column:
    """Column of token ids (array of int) of a text column."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.frombuffer(p, dtype="<u4").astype("int32") for p in _encoded(path, texts)], dtype=object)
        encoder(path).forget()

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Column of texts of a column of token ids; null ids give a null text."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pd.Series([None if x is None else decode_ids(vocab, np.asarray(x, dtype="<u4").tobytes()) for x in batch], dtype=object)

    return texts(ids)


def _per_block(docs: DataFrame, path: str, others: list[str], made: StructType, arrays: Callable[[Vocabulary, list[bytes]], list[pa.Array]]) -> DataFrame:
    """The ``others`` columns of ``docs`` as they are, and the ``made`` ones that ``arrays`` gives for the packed
    ids of a block of texts. Blocks are short, so that the ids of a whole batch are never held at once."""
    schema = StructType([*[docs.schema[c] for c in others], *made.fields])
    names = [*[docs.schema[c].name for c in others], "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                packed = coder.batch([t or "" for t in part.column(len(names) - 1).to_pylist()])
                kept = [part.column(i) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*kept, *arrays(coder.vocab, packed)], names=schema.names)
            part = packed = kept = None
            release()
        batch = None
        coder.forget()

    return docs.select(*[F.col(f"`{c}`") for c in others], F.col("text")).mapInArrow(run, schema)


def bpe_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (needs doc_id, text); each text is
    encoded and its ids decoded again."""

    def digests(vocab: Vocabulary, packed: list[bytes]) -> list[pa.Array]:
        sha = hashlib.sha256
        return [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha(p).hexdigest() for p in packed], pa.string()), pa.array([sha(decode_ids(vocab, p).encode()).hexdigest() for p in packed], pa.string())]

    made = StructType().add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    return _per_block(docs, path, ["doc_id"], made, digests)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the text replaced by ``ids`` (array of int), ``n_tokens`` and the digest of what the
    ids decode to; all other columns stay, but for those of these names."""

    def tokens(vocab: Vocabulary, packed: list[bytes]) -> list[pa.Array]:
        n = np.array([len(p) // 4 for p in packed], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
        return [ids, pa.array(n), pa.array([hashlib.sha256(decode_ids(vocab, p).encode()).hexdigest() for p in packed], pa.string())]

    made = StructType().add("ids", ArrayType(IntegerType())).add("n_tokens", LongType()).add("decoded_sha256", StringType())
    return _per_block(docs, path, [c for c in docs.columns if c not in ("text", *made.names)], made, tokens)
