"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a label: its language. Emission weights come from affixes, character n-grams
and a lexicon of the sampled texts' words; transition weights between the labels of neighbouring words
are learned with them, by gradient ascent on the likelihood (forward-backward on word sequences, part of
them spliced from two languages, so that switches are learned, too). A
text's language is the label with the largest mean posterior over its words, its score that mean, so
a code-switched text scores lower and ``label_words`` gives its labels word by word.

Learning uses at most ``sample_docs`` documents and about ``sample_words`` words per language (documented
parameters; documents are distinct ids chosen by hash, so that reruns agree; with very many languages
``TOTAL_WORDS`` bounds the whole sample). Texts are cut into sequences. Every text is labelled whole: a
word is a run of letters however long, and in scripts without spaces one character. A word's emission
depends on the word alone and is computed once per distinct word that a worker remembers.

A text that is null or has no letter is ``und`` with score 0. If nothing can be learned (no labelled
row), all are ``und``. Repeated rows get equal results, ties go to the first language by code point, an
empty table gives no rows, and columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliodyne.llm.memory import release
from bibliodyne.session import materialize, packed

WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
#: Characters that are words of their own, since their scripts put no spaces between words.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
SPLIT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*|[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
#: Rows of the hashed feature table.
BUCKETS = 1 << 16
MEMO_WORDS = 150_000
#: Words per segment when texts are labelled.
SEGMENT = 48
#: Words per training sequence.
SEQUENCE = 48
UNDETERMINED = "und"
#: Words of all languages together that a model is fitted on at most.
TOTAL_WORDS = 8_000_000
#: Share of the training sequences that are spliced with one of another language.
SPLICED = 0.25


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Feature rows of a lower-cased word: affixes and trigrams of its marked bytes, and whether the lexicon
    has it. The start value of the checksum tells the families apart."""
    b = f"^{word}$".encode()
    rows = [crc32(b[:n], n) % BUCKETS for n in (2, 3, 4)] + [crc32(b[-n:], 16 + n) % BUCKETS for n in (2, 3, 4, 5)]
    rows += [crc32(b[i : i + 3], 64) % BUCKETS for i in range(len(b) - 2)]
    rows.append(crc32(b, 128) % BUCKETS if word in lexicon else crc32(b"", 256) % BUCKETS)
    return rows


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, want_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors (batch, time, label) of padded log emissions, and summed pair posteriors.

    Sequences are scaled at each step, so long ones neither under- nor overflow. Lengths must descend:
    the sequences alive at a step are then the first ones.
    """
    n, steps, labels = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    m = np.exp(transition - transition.max())
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # sequences longer than t
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    for t in range(steps):
        k = alive[t]
        a = e[:k, t] if t == 0 else (alpha[:k, t - 1] @ m) * e[:k, t]
        alpha[:k, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        b = (beta[:k, t + 1] * e[:k, t + 1]) @ m.T
        beta[:k, t] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-300)
    if not want_pairs:
        return post, None
    pairs = np.zeros((labels, labels))
    for t in range(steps - 1):
        k = alive[t + 1]
        joint = alpha[:k, t, :, None] * m[None] * (beta[:k, t + 1] * e[:k, t + 1])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return post, pairs


class Model:
    """Labels, feature weights, transitions and lexicon; small enough to send with a task."""

    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray, lexicon: frozenset[str]) -> None:
        self.labels, self.weights, self.transition, self.lexicon = labels, weights, transition, lexicon

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def emissions(self, words: list[list[str]]) -> list[np.ndarray]:
        """Log emissions (words, labels) per text; remembers a bounded number of distinct words."""
        memo = self.__dict__.setdefault("memo", {})
        new = {w for text in words for w in text}.difference(memo)
        if new and len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = {w for text in words for w in text}
        if new:
            rows = [features(w, self.lexicon) for w in new]
            ends = np.cumsum([0, *map(len, rows)])
            flat = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=ends[-1])
            sums = np.add.reduceat(self.weights[flat], ends[:-1], axis=0)
            memo.update(zip(new, sums, strict=True))
        return [np.array([memo[w] for w in text], dtype=np.float32) for text in words]

    def posteriors(self, words: list[list[str]]) -> list[np.ndarray]:
        """Posteriors (words, labels) of texts with a word each."""
        return segmented_posteriors(self.emissions(words), self.transition)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def segmented_posteriors(emissions: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """The posteriors of ``forward_backward`` for texts of any lengths, in few vector steps.

    Texts are cut into segments. What a segment does to a message is a small matrix, the product of
    its steps; these are combined along each text, and then all segments run at once from the messages
    that reach them. The steps are those within a segment and those between segments of the longest
    text, not the words of the longest text.
    """
    if not emissions:
        return []
    labels = transition.shape[0]
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    counts = np.array([-(-len(emissions[i]) // SEGMENT) for i in order])
    first = np.concatenate([[0], np.cumsum(counts)])
    e = np.zeros((first[-1], SEGMENT, labels))
    valid = np.zeros((first[-1], SEGMENT), dtype=bool)
    for i, at, n in zip(order, first, counts, strict=False):
        x = emissions[i].astype(np.float64)
        e[at : at + n].reshape(-1, labels)[: len(x)] = np.exp(x - x.max(axis=1, keepdims=True))
        valid[at : at + n].reshape(-1)[: len(x)] = True
    m = np.exp(transition - transition.max())
    start = np.zeros(first[-1], dtype=bool)
    start[first[:-1]] = True
    # Products of steps per segment; the first word of a text has no transition, padding does nothing.
    product = np.broadcast_to(np.eye(labels), (first[-1], labels, labels)).copy()
    for t in range(SEGMENT):
        moved = (product.sum(axis=2, keepdims=True) if t == 0 else 0) * start[:, None, None] + (product @ m) * (~start if t == 0 else np.ones_like(start))[:, None, None]
        product = np.where(valid[:, t, None, None], moved * e[:, t, None, :], product)
        product /= product.max(axis=(1, 2), keepdims=True)
    entering, leaving = np.full((first[-1], labels), 1.0 / labels), np.full((first[-1], labels), 1.0 / labels)
    alive = [int(np.searchsorted(-counts, -j, side="left")) for j in range(int(counts.max(initial=0)) + 1)]  # texts with more than j segments
    for j in range(1, len(alive) - 1):
        k = first[: alive[j]] + j
        entering[k] = _scaled((entering[k - 1][:, None, :] @ product[k - 1])[:, 0])
    for j in range(len(alive) - 2, 0, -1):
        k = first[: alive[j]] + j
        leaving[k - 1] = _scaled((product[k] @ leaving[k][:, :, None])[:, :, 0])
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    message = entering
    for t in range(SEGMENT):
        stepped = _scaled(np.where((start & (t == 0))[:, None], 1.0, message @ m) * np.where(valid[:, t, None], e[:, t], 1.0))
        message = alpha[:, t] = np.where(valid[:, t, None], stepped, message)
    message = leaving
    for t in range(SEGMENT - 1, -1, -1):
        beta[:, t] = message
        message = np.where(valid[:, t, None], _scaled((message * np.where(valid[:, t, None], e[:, t], 1.0)) @ m.T), message)
    post = _scaled(alpha * beta + 1e-300)
    out: list[np.ndarray] = [np.zeros(0)] * len(order)
    for i, at, n in zip(order, first, counts, strict=False):
        out[i] = post[at : at + n].reshape(-1, labels)[: len(emissions[i])]
    return out


def words_of(text: str | None) -> list[str]:
    words = WORD.findall(text.lower()) if text else []
    if words and not text.isascii() and UNSPACED.search(text):
        return [x for w in words for x in (SPLIT.findall(w) if UNSPACED.search(w) else [w])]
    return words


def train(texts: list[str], langs: list[str], epochs: int = 4, batch: int = 128, rate: float = 0.3, decay: float = 1e-6, seed: int = 8) -> Model | None:
    """Fit a model to a bounded list of texts with languages (AdaGrad on the mean log likelihood)."""
    labels = sorted(set(langs))
    if not labels:
        return None
    split = [words_of(t) for t in texts]
    counts = Counter(w for x in split for w in x)
    lexicon = frozenset(w for w, n in counts.items() if n >= 5)
    at = {x: i for i, x in enumerate(labels)}
    pieces = [(x[i : i + SEQUENCE], at[y]) for x, y in zip(split, langs, strict=True) for i in range(0, len(x), SEQUENCE)]
    known = {w: np.array(features(w, lexicon)) for w in counts}
    w, t = np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels)))
    gw, gt = np.full(w.shape, 1e-6), np.full(t.shape, 1e-6)
    rng = np.random.default_rng(seed)
    chunks = [(x, [y] * len(x)) for x, y in pieces]
    # Code-switched sequences: the head of one sequence and the tail of another one.
    for i, j in rng.integers(0, max(1, len(pieces)), (int(SPLICED * len(pieces)), 2)):
        (a, y), (b, z) = pieces[i], pieces[j]
        chunks.append((a[: len(a) // 2] + b[len(b) // 2 :], [y] * (len(a) // 2) + [z] * (len(b) - len(b) // 2)))
    for _ in range(epochs if chunks else 0):
        order = rng.permutation(len(chunks))
        for start in range(0, len(order), batch):
            part = sorted((chunks[i] for i in order[start : start + batch]), key=lambda c: -len(c[0]))
            lengths = np.array([len(c[0]) for c in part])
            rows = [known[x] for c, _ in part for x in c]
            ends = np.cumsum([0, *map(len, rows)])
            flat = np.concatenate(rows)
            scores = np.add.reduceat(w[flat], ends[:-1], axis=0)
            padded, mask = np.zeros((len(part), lengths[0], len(labels))), np.arange(lengths[0])[None] < lengths[:, None]
            padded[mask] = scores
            post, pairs = forward_backward(padded, lengths, t, True)
            truth = np.zeros_like(post)
            for j, (_, y) in enumerate(part):
                truth[j, np.arange(lengths[j]), y] = 1
            error = (truth - post)[mask] / lengths.sum()
            grad = np.zeros_like(w)
            np.add.at(grad, flat, np.repeat(error, np.diff(ends), axis=0))
            grad -= decay * w
            seen = np.zeros_like(t)
            for _, y in part:
                np.add.at(seen, (y[:-1], y[1:]), 1)
            step = (seen - pairs) / lengths.sum()
            gw += grad**2
            gt += step**2
            w += rate * grad / np.sqrt(gw)
            t += rate * step / np.sqrt(gt)
    return Model(labels, w.astype(np.float32), t, lexicon)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row's id falls into the held-out fold; rows without id are held out, too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def sample(docs: DataFrame, sample_docs: int = 400, sample_words: int = 120_000) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from: per language the first ``sample_docs`` distinct ids in hash order,
    and of these as many as ``sample_words`` words allow (at least one). An id that is repeated with a
    language gives its smallest text; of a text with more words than that, the first ``sample_words`` are
    learned from. Only these texts reach the driver."""
    from pyspark.sql import Window as W

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    keyed = rows.select("doc_id", "lang", F.pmod(F.xxhash64(F.lit(8), F.col("doc_id").cast("string")), F.lit(1 << 30)).alias("h"))
    # One row a language; it goes to every task, where it leaves a few times the wanted number of ids.
    sizes = materialize(keyed.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")), "langid-sizes")
    labels = sizes.count()
    sample_words = max(1, min(sample_words, TOTAL_WORDS // max(1, labels)))
    near = keyed.join(F.broadcast(sizes), "lang").filter(F.col("h").cast("double") < F.lit(float(1 << 30)) * 4 * sample_docs / F.col("n"))
    ids = near.select("lang", "doc_id", "h").distinct()
    ranked = ids.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= sample_docs)
    chosen = materialize(ranked.select("doc_id", F.col("lang").alias("chosen_lang"), "r"), "langid-ids")
    # At most ``sample_docs`` ids a language.
    picked = rows.join(F.broadcast(chosen), "doc_id").filter(F.col("lang") == F.col("chosen_lang"))
    few = F.when(F.regexp_count("text", F.lit(r"\s+")) < sample_words, F.col("text")).otherwise(F.array_join(F.slice(F.split("text", r"\s+"), 1, sample_words), " "))
    texts = materialize(picked.groupBy("lang", "r").agg(F.min(few).alias("text")).withColumn("words", F.regexp_count("text", F.lit(r"\s+")) + 1), "langid-texts")
    before = F.coalesce(F.sum("words").over(W.partitionBy("lang").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = texts.select("lang", "r", before.alias("before")).filter(F.col("before") < sample_words)
    found = texts.join(F.broadcast(wanted), ["lang", "r"]).select("lang", "r", "text").collect()
    found.sort(key=lambda r: (r.r, r.lang))
    return [r.text for r in found], [r.lang for r in found]


def fit(docs: DataFrame, sample_docs: int = 400, sample_words: int = 120_000, **options: float) -> Model | None:
    return train(*sample(docs, sample_docs, sample_words), **options)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """Struct(lang_pred, score) of a text column, labelled with the model (sent once per executor)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for texts in batches:
            out = [(UNDETERMINED, 0.0)] * len(texts)
            values = texts.tolist()
            for start in range(0, len(values), 256):
                split = [words_of(t) for t in values[start : start + 256]]
                live = [i for i, x in enumerate(split) if x] if crf else []
                for i, post in zip(live, crf.posteriors([split[i] for i in live]) if live else [], strict=True):
                    mean = post.mean(axis=0, dtype=np.float64)
                    best = int(mean.argmax())
                    out[start + i] = (crf.labels[best], min(1.0, float(mean[best] / mean.sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])
        if crf:
            crf.__dict__.pop("memo", None)  # the worker lives on and may run other operators
        release()

    return labelled(F.col(text))


def label_words(model: Model, text: str) -> list[tuple[str, str]]:
    """The words of one text with their most likely language."""
    words = words_of(text)
    if not words:
        return []
    post = model.posteriors([words])[0]
    return [(w, model.labels[i]) for w, i in zip(words, post.argmax(axis=1), strict=True)]


def langid_table(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (needs doc_id, text, lang)."""
    model = fit(docs, **options)
    return docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), predict(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.35, **options: float) -> DataFrame:
    """``docs`` without the rows whose language cannot be told: no letter, or a score below ``least``.

    A short text with a licence line or a key in it has a score near one half and is still told apart, so
    the bound lies below that."""
    model = fit(docs, **options)
    labelled = packed(docs, "text").withColumn("p", predict(docs, model))
    return labelled.filter((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= least)).select("_row.*")
