"""Token counts under a unigram model, with scores shared by the prefixes of a trie.

The distinct words of a batch go into a trie. Its nodes are worked off depth by depth: the best
segmentation of the prefix a node stands for is computed once, however many words share it,
from the pieces that end there, and each word's node stores the number of its tokens. Pieces are
followed through a second trie, that of the vocabulary, so only those that fit cost anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import distinct_words, small_batches

# Scores are whole millionths, so that sums are exact and ties are ties.
UNIT = 1_000_000
# Words of more characters are worked off alone, without a trie.
LONG = 128
# A task forgets the words it has counted when it holds this many.
REMEMBERED = 500_000
# Tokens of a word in the trie are fewer than this; it makes room for ties in the scores.
_MOST = 1 << 12
_ROOT = 0


class Unigrams:
    """The pieces of a model file with Zipf log-probabilities by rank, as a trie of states.

    The file holds merge ranks, not probabilities: the piece of rank r (from 0) gets
    -ln(r + 2.7), the constant left out. An unknown character costs 10 more than the rarest
    piece, counts one token for each of its bytes, and is only used where no piece fits.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [
            i
            for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        ]
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        self.score = {
            model.id_to_piece(i): -round(float(np.log(rank + 2.7)) * UNIT) for rank, i in enumerate(order)
        }
        self.unknown = min(self.score.values(), default=0) - 10 * UNIT
        self.longest = max(map(len, self.score), default=1)
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        states = 1
        for piece, score in self.score.items():
            at = _ROOT
            for c in piece:
                if (at, ord(c)) not in edges:
                    edges[at, ord(c)] = states
                    states += 1
                at = edges[at, ord(c)]
            ends[at] = score
        keys = {(state << 21) | c: to for (state, c), to in edges.items()}
        self.keys = np.array(sorted(keys), dtype=np.int64)
        self.to = np.array([keys[k] for k in self.keys.tolist()], dtype=np.int64)
        self.ends = np.zeros(states, dtype=np.int64)  # 0: no piece ends here
        self.ends[list(ends)] = list(ends.values())

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The state after one more character, or -1."""
        keys = (state << 21) | char
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return np.where(self.keys[at] == keys, self.to[at], -1)

    def count(self, word: str) -> int:
        """Tokens of one word, without a trie: of equal scores the fewer tokens."""
        best: list[tuple[int, int]] = [(0, 0)]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                score = self.score.get(word[start:end])
                if score is not None:
                    options.append((best[start][0] + score, best[start][1] - 1))
            if word[end - 1] not in self.score:
                score, tokens = best[end - 1]
                options.append((score + self.unknown, tokens - len(word[end - 1].encode())))
            best.append(max(options))
        return -best[-1][1]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of every word; equal prefixes are computed once."""
        out = np.zeros(len(words), dtype=np.int64)
        short = []
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self.count(word)
            else:
                short.append(i)
        if short:
            out[short] = self._by_trie([words[i] for i in short])
        return out

    def _by_trie(self, words: list[str]) -> np.ndarray:
        order = np.array(sorted(range(len(words)), key=words.__getitem__))
        sizes = np.array([len(words[i]) for i in order])
        text = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le"), dtype=np.uint32)
        text = text.astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        single = self.step(np.zeros(text.size, dtype=np.int64), text)
        known = (single >= 0) & (self.ends[np.maximum(single, 0)] != 0)
        out = np.zeros(len(words), dtype=np.int64)
        # one row for each word that is longer than the depth; node: the prefix it is at
        row, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        value = np.zeros(1, dtype=np.int64)  # of each node: score * _MOST - tokens
        e_node, e_state, e_value = (np.zeros(0, dtype=np.int64) for _ in range(3))
        depth = 0
        while True:
            ended = sizes[row] == depth
            out[row[ended]] = -value[node[ended]] % _MOST
            row, node = row[~ended], node[~ended]
            if not row.size:
                break
            char = text[first[row] + depth]
            # words are sorted, so rows of one prefix stand together
            new = np.ones(row.size, dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
            parent, letter = node[new], char[new]
            fits = known[first[row[new]] + depth]
            node = np.cumsum(new) - 1
            # pieces under way at the parents, and one that begins there
            e_node = np.append(e_node, np.arange(value.size))
            e_state = np.append(e_state, np.zeros(value.size, dtype=np.int64))
            e_value = np.append(e_value, value)
            by_node = np.argsort(e_node, kind="stable")
            e_node, e_state, e_value = e_node[by_node], e_state[by_node], e_value[by_node]
            begin = np.searchsorted(e_node, parent)
            many = np.searchsorted(e_node, parent, side="right") - begin
            child = np.repeat(np.arange(parent.size), many)
            at = np.arange(child.size) + np.repeat(begin - (np.cumsum(many) - many), many)
            state = self.step(e_state[at], letter[child])
            alive = state >= 0
            e_node, e_state, e_value = child[alive], state[alive], e_value[at[alive]]
            nothing = np.iinfo(np.int64).min
            unknown_bytes = np.select([letter < 0x80, letter < 0x800, letter < 0x10000], [1, 2, 3], 4)
            fallback = value[parent] + self.unknown * _MOST - unknown_bytes
            value = np.where(fits, nothing, fallback)
            ends = self.ends[e_state] != 0
            np.maximum.at(value, e_node[ends], e_value[ends] + self.ends[e_state[ends]] * _MOST - 1)
            depth += 1
        result = np.zeros(len(words), dtype=np.int64)
        result[order] = out
        return result


class Counter:
    """Counts words, remembering those it has met."""

    def __init__(self, unigrams: Unigrams):
        self.unigrams = unigrams
        self.known: dict[str, int] = {}

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words and the tokens of each text; a null text has none."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        words, order, begins = distinct_words(pc.fill_null(texts, ""))
        new = [w for w in words if w not in self.known]
        if new:
            counts = self.unigrams.counts(["▁" + w for w in new])
            self.known.update(zip(new, counts.tolist()))
        tokens = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        ends = np.concatenate([[0], np.cumsum(tokens[order])])[begins]
        return np.diff(begins), np.diff(ends)


def token_counts(
    docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc, n_words, n_tokens) of every row of docs, over its whole text.

    Words are cut at white space (space, U+0009 to U+000D) and begin with the mark of a word start;
    n_tokens adds up the tokens of their best segmentations, of equal ones the shortest. Null and
    empty texts count 0. Rows repeat as they do in docs, other columns don't matter.
    """
    small_batches(docs.sparkSession, 1024)
    slim = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    counts = [T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens")]
    schema = T.StructType([slim.schema["doc"], *counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Unigrams(model))
        for batch in batches:
            found = counter.totals(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(f, pa.int64()) for f in found)], schema.names
            )

    return slim.mapInArrow(run, schema)
