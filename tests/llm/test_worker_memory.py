"""What operators leave in a Python worker, which lives on beside the tasks of the next ones."""

import pyarrow as pa

from bibliodyne.llm import bpe
from bibliodyne.llm.queries import tokenizer_path


def test_an_encoder_forgets_its_words_when_its_task_is_over(spark, monkeypatch):
    docs, tasks = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: tasks.append(f) or self)
    bpe.encode_documents(docs, tokenizer_path())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], names=["doc_id", "text"])
    made = [r for b in tasks[0](iter([batch, batch])) for r in b.to_pylist()]
    coder = bpe.encoder(tokenizer_path())
    assert [bpe.decode_ids(coder.vocab, b"".join(i.to_bytes(4, "little") for i in r["ids"])) for r in made] == ["some words", ""] * 2
    assert not coder.memo and not coder.vocab.adjacent.cache_info().currsize and not coder.vocab.whole.cache_info().currsize


def test_an_encoder_keeps_words_that_came_again_when_it_is_full(monkeypatch):
    coder, encoded, whole = bpe.Encoder(bpe.vocabulary(tokenizer_path())), [], bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda vocab, words: encoded.extend(words) or whole(vocab, words))
    monkeypatch.setattr(bpe, "MEMO_WORDS", 4)
    for text in (" often once", " often twice", " often thrice", " often fourth"):
        assert bpe.decode_ids(coder.vocab, coder.batch([text])[0]) == text
    assert encoded.count(b" often") == 1 and len(coder.memo) <= 4
    coder.batch([" a b c d e"])
    assert coder.batch([" often"])[0] and len(coder.memo) <= 6


def test_states_are_made_only_where_a_word_asks_for_them(monkeypatch):
    vocab, asked = bpe.vocabulary(tokenizer_path()), []
    adjacent = vocab.adjacent
    monkeypatch.setattr(vocab, "adjacent", lambda a, b: asked.append(b) or adjacent(a, b))
    words = [b" international", b" internationally", b"".join([b"ab"] * 300), bytes(range(256))]
    for word in words:
        assert list(bpe.encode_words(vocab, [word])) == [(word, [vocab.ids[x] for x in vocab.merged(word)])]
    del asked[:]
    list(bpe.encode_words(vocab, words[:2]))
    assert len(asked) < len(words[1])
