"""Every occurrence of a word is segmented on its own."""

from logsift.llm import merge_dropout, queries
from tests.llm.conftest import documents

PIECES = queries.tokenizer_path("piece_bpe_32k.model")


def test_every_occurrence_and_every_copy_varies(spark):
    text = " ".join(["internationally"] * 200)
    encoder = merge_dropout.Encoder(merge_dropout.Vocabulary(PIECES), 0.3, 1)
    (ids,) = encoder.encode([(0, text)])
    vocabulary = encoder.merger.v
    ways, word, length = set(), [], 0
    for i in ids.tolist():
        word.append(i)
        length += int(vocabulary.lengths[i])
        if length == len(" internationally"):
            ways.add(tuple(word))
            word, length = [], 0
    assert not word and len(ways) > 10
    rows = [(1, text, "en", "s")] * 3 + [(2, text, "en", "s")] + [(3, None, "en", "s"), (4, "", "en", "s")]
    docs = documents(spark, rows)
    found = merge_dropout.decode(merge_dropout.encode(docs, PIECES, dropout=0.3), PIECES).collect()
    assert len(found) == 6 and all(r.decoded == (r.row.text or "") for r in found)
    assert len({tuple(r.ids) for r in found if r.row.text}) == 4
    again = merge_dropout.encode(docs.repartition(5), PIECES, dropout=0.3).collect()
    assert sorted(tuple(r.ids) for r in found) == sorted(tuple(r.ids) for r in again)
