"""Token files, trie counts and merge-dropout against the tokenizers' own libraries."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsift.llm import merge_dropout, queries, token_files, trie_counts

WORDS = queries.tokenizer_path("word_bpe_49k.json")
PIECES = queries.tokenizer_path("piece_bpe_32k.model")


def _plain_ids(texts):
    found = Tokenizer.from_file(WORDS).encode_batch(list(texts), add_special_tokens=False)
    return [[*e.ids, 2] for e in found]


def _expected_files(rows):
    """rows: (doc_id, text) in file order."""
    out, start = [], 0
    for (doc, _), ids in zip(rows, _plain_ids(t or "" for _, t in rows)):
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = queries.op1_token_files(spark, small).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == _expected_files(rows)


def test_files_of_odd_documents(spark, odd, nothing):
    path = token_files.write(odd, WORDS)
    got = token_files.read(spark, path).orderBy("start").drop("ids").collect()
    assert [r.doc is None for r in got][:3] == [True, True, False]  # null ids come first
    assert [r.doc for r in got][2:] == sorted(r.doc for r in got if r.doc is not None)
    texts = {}
    for r in odd.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(_expected_files([(0, r.text)])[0][2:])
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        texts[r.doc].remove((r.n_tokens, r.ids_crc32))
    assert not any(texts.values())
    empty = token_files.write(nothing, WORDS)
    assert token_files.read(spark, empty).count() == 0


@pytest.mark.parametrize("vocabulary", [300, 70_000])
def test_grammar_round_trip_and_random_access(vocabulary):
    random = np.random.default_rng(5)
    docs = [random.integers(0, 40, size).astype(np.int64) for size in (0, 1, 2, 5000, 0, 3000)]
    docs += [np.tile([7, 7, 7], 400), np.full(999, 5), np.tile([1, 2, 3, 1, 2], 300)]
    lengths = np.array([d.size for d in docs])
    payload = token_files.compress(np.concatenate(docs), lengths, vocabulary)
    block = token_files.Block(payload)
    assert len(payload) < (2 if vocabulary < 1 << 16 else 4) * lengths.sum()  # the rules pay
    for i, ids in enumerate(docs):
        assert np.array_equal(block.document(i), ids)
        for start, stop in ((0, 1), (3, 17), (ids.size // 2, ids.size), (5, 5)):
            assert np.array_equal(block.part(i, start, stop), ids[start:stop])


@pytest.mark.parametrize("vocabulary", [1000, 60_000])
def test_grammar_leaves_no_pair_twice(vocabulary):
    random = np.random.default_rng(8)
    phrase = random.integers(0, 1000, 700)
    docs = [phrase, np.tile(phrase[:50], 40), np.full(4097, 3), random.integers(0, 900, 60_000), phrase[::-1], phrase]
    docs = [*docs, np.zeros(0, dtype=np.int64), random.integers(0, 30, 20_000)]
    lengths = np.array([d.size for d in docs])
    block = token_files.Block(token_files.compress(np.concatenate(docs), lengths, vocabulary))
    seen = {}
    for i, ids in enumerate(docs):
        assert np.array_equal(block.document(i), ids)
        assert np.array_equal(block.part(i, 3, 40), ids[3:40])
        symbols = block.symbols[block.starts[i] : block.starts[i + 1]].tolist()
        for k, pair in enumerate(zip(symbols, symbols[1:])):
            place = (i, k)
            before = seen.setdefault(pair, place)
            assert before == place or before == (i, k - 1) and pair[0] == pair[1], pair  # in one run they overlap
    assert np.array_equal(block.all()[0], np.concatenate(docs))


def test_words_are_encoded_like_whole_texts():
    encoder = token_files.WordEncoder(WORDS)
    texts = ["", "a\tb\rc\x0bd\x0ce\xa0f g\x1ch", "it's o'k, don't... (ab'!), x.,y", "É, é.", "ΣΑΣ. İx"]
    texts += ["w***\nv$$$ u", "<|startoftext|>x <|STARTOFTEXT|>,", "12,3. a1, 1a, a_b_", "end."]
    ids, lengths = encoder.encode(pa.array([*texts, None]))
    found = np.split(ids, np.cumsum(lengths)[:-1])
    assert [[*f.tolist(), 2] for f in found] == _plain_ids([*texts, ""])


def test_trie_counts_match_plain_segmentation(spark, odd, nothing, small):
    model = trie_counts.Unigrams(PIECES)
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    for rows in (docs, odd.filter("length(text) < 10000 or text is null")):
        got = trie_counts.token_counts(rows, PIECES).collect()
        texts = [r.text or "" for r in rows.select("text").collect()]
        words = [t.encode().split() for t in texts]
        want = [(len(w), sum(model.count("▁" + x.decode()) for x in w)) for w in words]
        assert [(r.n_words, r.n_tokens) for r in got] == want
    assert trie_counts.token_counts(odd, PIECES).count() == odd.count()
    assert trie_counts.token_counts(nothing, PIECES).count() == 0


def test_trie_counts_try_every_segmentation():
    model = trie_counts.Unigrams(PIECES)

    def best(word):
        if not word:
            return (0, 0)
        options = []
        for size in range(1, len(word) + 1):
            score = model.score.get(word[:size])
            if score is None and size == 1:
                rest = best(word[1:])
                options.append((rest[0] + model.unknown, rest[1] - len(word[0].encode())))
            elif score is not None:
                rest = best(word[size:])
                options.append((rest[0] + score, rest[1] - 1))
        return max(options)

    words = ["▁the", "▁thing", "▁things", "▁中x", "▁a😀b", "▁", "▁antidis", "▁zzzzqq", "▁éa"]
    assert model.counts(words).tolist() == [-best(w)[1] for w in words]


def _texts(rows):
    return [r.text or "" for r in rows]


def test_encoding_without_dropout_is_the_models_own(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = merge_dropout.encode(docs, PIECES, dropout=0.0).select("row.text", "ids").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [list(r.ids) for r in rows] == model.encode(_texts(rows))


def test_dropout_varies_and_decodes(spark, odd, nothing, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for rows in (docs, odd):
        found = merge_dropout.decode(merge_dropout.encode(rows, PIECES, dropout=0.3), PIECES)
        lost = found.filter(F.col("decoded") != F.coalesce("row.text", F.lit("")))
        assert found.count() == rows.count() and lost.count() == 0
    once = merge_dropout.encode(docs, PIECES, dropout=0.3)
    again = merge_dropout.encode(docs.repartition(7), PIECES, dropout=0.3)
    assert sorted(map(str, once.select("row.doc_id", "ids").collect())) == sorted(
        map(str, again.select("row.doc_id", "ids").collect())
    )
    ways = {tuple(merge_dropout.Encoder(merge_dropout.Vocabulary(PIECES), 0.3, s, 1).encode([(0, "internationally")])[0]) for s in range(20)}
    assert len(ways) > 3
    assert merge_dropout.encode(nothing, PIECES).count() == 0


def test_steps_together_equal_the_agenda():
    merger = merge_dropout.Merger(merge_dropout.Vocabulary(PIECES), 0.25)
    chunks = [" international", "x", " antidisestablishmentarianism", "中文", "   ", " aaaa", "\n", " the"]
    keys = np.arange(len(chunks), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    flat, width = merger._together(chunks, keys)
    for chunk, key, ids in zip(chunks, keys, np.split(flat, np.cumsum(width)[:-1])):
        assert np.array_equal(ids, merger._by_agenda(chunk, key))


def test_queries_return_whole_tables(spark, small):
    total = spark.read.parquet(f"{small}/documents.parquet").count()
    encoded = queries.op5_merge_dropout(spark, small)
    assert encoded.count() == total and encoded.filter("not lossless").count() == 0
    assert queries.op3_trie_token_counts(spark, small).count() == total
