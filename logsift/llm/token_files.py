"""Token ids in files, compressed by Re-Pair grammars that allow random access.

Documents are ordered by id and dealt into shards, one task each. A shard is a run of blocks; a
block is one row of a Parquet table, with the ids of its documents and a payload in this format
(little-endian):

    magic "RPG2", u32 first nonterminal, u32 rules, u32 documents, u32 symbols, u8 symbol bits
    rules x 2 symbols      what each nonterminal stands for, by ascending id
    rules x u32            how many ids each expands to
    (documents + 1) x u32  where each document's symbols begin, and the end
    symbols                the documents, one after the other

Symbols are written as their lower 16 bits, then the higher bits one by one, eight symbols a byte.

Frequent pairs are replaced in rounds, until no pair occurs twice: in each the pairs at least an
eighth as frequent as the most frequent one get nonterminals, and where two overlap the more frequent wins.
Pairs never reach over the end of a document.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import distinct_words, gathered, give_back_memory, row_keys, small_batches
from logsift.session import fresh_folder

MAGIC = b"RPG2"
HEAD = "<4s4IB"
END_ID = 2  # fixed by the contract
# A block closes when it holds this many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
# A round replaces the pairs that occur at least one STEPth as often as the most frequent one.
STEP = 8
# A task forgets the words it has encoded when it holds this many.
REMEMBERED = 250_000
# A word that ends in ASCII punctuation after a letter; an apostrophe may belong to the letters.
_ENDED = re.compile(r"(.*[a-z])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)
# Words of letters that normalisation only lower-cases, one for one: ASCII and Latin-1.
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


# --- encoding ------------------------------------------------------------------------------------


class _Places(dict):
    """Numbers words as they are first met."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


class WordEncoder:
    """The ids of whole texts, from the ids of their distinct words.

    This tokenizer lower-cases, drops white space and never joins over it, nor between a letter and
    the ASCII punctuation that ends a word; so a text's ids are those of such parts in a row. A text
    that may hold a special token's string is encoded as a whole.
    """

    def __init__(self, path: str, vocabulary: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # for words of plain letters, which its normalizer and its splitting leave as they are
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence(
            [WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.size = self.tokenizer.get_vocab_size()
        added = self.tokenizer.get_added_tokens_decoder().values()
        names = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ending[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.marks = {t.content[:2] for t in added}
        self.forget()

    def forget(self) -> None:
        self.known = _Places()
        self.flat = np.zeros(0, dtype=np.int32)
        self.width, self.offset = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def _store(self, places: np.ndarray, ids: np.ndarray, width: np.ndarray) -> None:
        self.width[places] = width
        self.offset[places] = self.flat.size + np.cumsum(width) - width
        self.flat = np.append(self.flat, ids.astype(np.int32))

    def _learn(self) -> None:
        """Encodes the words that have been met since the last time."""
        known, new = self.known, self.known.new
        ended = [(known[m[0]], known[m[1]], known[m[2]]) for m in map(_ENDED.fullmatch, new) if m]
        known.new = []  # stems and endings that are new have joined it, after the words
        composed = {place for place, _, _ in ended}
        rest = [w for w in new if known[w] not in composed]
        room = len(known) - self.width.size
        self.width = np.append(self.width, np.zeros(room, dtype=np.int32))
        self.offset = np.append(self.offset, np.zeros(room, dtype=np.int64))
        plain = list(filter(_LETTERS.fullmatch, rest))
        other = list(set(rest).difference(plain))
        for words, learn, most in ((plain, self._learn_plain, 8192), (other, self._learn_each, 2048)):
            for at in range(0, len(words), most):  # encodings are large objects
                part = words[at : at + most]
                learn(part, np.fromiter(map(known.__getitem__, part), dtype=np.int64, count=len(part)))
        if ended:
            places = np.array(ended, dtype=np.int64)
            ids = gathered(self.flat, self.offset, self.width, places[:, 1:].reshape(-1))
            self._store(places[:, 0], ids, self.width[places[:, 1]] + self.width[places[:, 2]])

    def _learn_each(self, words: list[str], places: np.ndarray) -> None:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [e.ids for e in found]
        flat = np.fromiter((i for one in ids for i in one), dtype=np.int64)
        self._store(places, flat, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))

    def _learn_plain(self, words: list[str], places: np.ndarray) -> None:
        """Words of letters alone, each of which ends with the token that ends it."""
        found = self.plain.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)
        ids = np.array(found[0].ids, dtype=np.int64)
        ends = np.flatnonzero(self.ending[ids]) + 1
        if ends.size == len(words) and ends[-1] == ids.size:
            self._store(places, ids, np.diff(ends, prepend=0))
        else:
            self._learn_each(words, places)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; a null text has none."""
        if len(self.known) > REMEMBERED:
            self.forget()
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), dtype=bool)
        for mark in self.marks:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(marked), "", texts) if marked.any() else texts
        words, order, begins = distinct_words(pc.ascii_lower(plain))
        places = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        if self.known.new:
            self._learn()
        rows = places[order]
        ids = gathered(self.flat, self.offset, self.width, rows)
        ends = np.concatenate([[0], np.cumsum(self.width[rows], dtype=np.int64)])[begins]
        lengths = np.diff(ends)
        if marked.any():
            parts = np.split(ids, ends[1:-1])
            for i in np.flatnonzero(marked).tolist():
                whole = self.tokenizer.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)
                parts[i] = np.array(whole[0].ids, dtype=np.int64)
                lengths[i] = parts[i].size
            ids = np.concatenate(parts)
        return ids, lengths


# --- grammar -------------------------------------------------------------------------------------


def _every_other(at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which of the places at count: every other one of a run of one symbol, where pairs overlap."""
    again = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (pairs[1:] == pairs[:-1])])
    if not again.any():
        return ~again
    here = np.arange(at.size)
    return (here - np.maximum.accumulate(np.where(again, 0, here))) % 2 == 0


def _sorted(pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs in order, and the place each had."""
    low = max(int(pairs.size).bit_length(), 1)
    if 2 * bits + low > 63:
        order = np.argsort(pairs, kind="stable")
        return pairs[order], order
    both = np.sort(pairs << low | np.arange(pairs.size))  # faster than sorting places
    return both >> low, both & ((1 << low) - 1)


def _grammar(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, sizes of the rules, symbols, where each document begins): no pair is left twice.

    A pair that occurs once only is looked at again when a new symbol comes next to it, since it
    can't become more frequent; so later rounds look at few places.
    """
    sym = ids.astype(np.int64)
    doc = np.repeat(np.arange(lengths.size), lengths)
    live = np.append(doc[1:] == doc[:-1], False)[: sym.size]
    bits = int(vocabulary + ids.size).bit_length()  # there are fewer rules than ids
    rules, sizes, count = [np.zeros((0, 2), dtype=np.int64)], np.ones(vocabulary, dtype=np.int64), 0
    while (at := np.flatnonzero(live)).size:
        pairs = (sym[at] << bits) | sym[at + 1]
        counted = _every_other(at, pairs)
        ordered, order = _sorted(pairs, bits)
        at, counted = at[order], counted[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(first) - 1
        counts = np.bincount(group, weights=counted).astype(np.int64)
        live[at] = (counts >= 2)[group]
        by_count = np.argsort(-counts, kind="stable")  # ties to the smaller code
        most = int(counts[by_count[0]])
        chosen = by_count[: np.searchsorted(-counts[by_count], -max(2, most // STEP), side="right")]
        if most < 2:
            break
        rank = np.full(counts.size, counts.size)
        rank[chosen] = np.arange(chosen.size)
        mine = counted & (rank[group] < counts.size)
        at, group = at[mine], group[mine]
        place = np.full(sym.size + 2, counts.size)  # the place at i is held at i + 1
        place[at + 1] = rank[group]
        wins = (place[at + 1] < place[at]) & (place[at + 1] < place[at + 2])
        at, group = at[wins], group[wins]
        pays = np.bincount(group, minlength=counts.size) >= 2
        at, group = at[pays[group]], group[pays[group]]
        used = chosen[pays[chosen]]  # the most frequent pair always is
        rank[used] = np.arange(used.size)
        codes = ordered[first][used]
        new = np.stack([codes >> bits, codes & ((1 << bits) - 1)], axis=1)
        rules.append(new)
        sizes = np.append(sizes, sizes[new].sum(axis=1))
        sym[at] = vocabulary + count + rank[group]
        count += used.size
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        stay = np.ones(sym.size, dtype=bool)
        stay[at + 1] = False
        sym, doc, live = sym[stay], doc[stay], live[stay]
        live &= np.append(doc[1:] == doc[:-1], False)
    starts = np.searchsorted(doc, np.arange(lengths.size + 1))
    return np.concatenate(rules), sizes[vocabulary:], sym, starts


def _packed(symbols: np.ndarray, bits: int) -> bytes:
    """The lower 16 bits of all symbols, then each higher bit of all."""
    planes = [np.packbits((symbols >> bit & 1).astype(np.uint8)) for bit in range(16, bits)]
    return b"".join([(symbols & 0xFFFF).astype("<u2").tobytes(), *[p.tobytes() for p in planes]])


def compress(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> bytes:
    """The payload of a block: ids of all documents in a row, and the length of each."""
    rules, sizes, symbols, starts = _grammar(ids, lengths, vocabulary)
    bits = max(16, int(vocabulary + len(rules)).bit_length())
    head = struct.pack(HEAD, MAGIC, vocabulary, len(rules), lengths.size, symbols.size, bits)
    numbers = [sizes.astype("<u4").tobytes(), starts.astype("<u4").tobytes()]
    return b"".join([head, _packed(rules.reshape(-1), bits), *numbers, _packed(symbols, bits)])


class Block:
    """A payload, opened: gives any document, or any part of one, without the others."""

    def __init__(self, payload: bytes):
        magic, self.first, rules, self.documents, symbols, bits = struct.unpack_from(HEAD, payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = struct.calcsize(HEAD)

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, dtype=dtype, count=n, offset=at)
            at += found.nbytes
            return found

        def unpacked(n: int) -> np.ndarray:
            found = take("<u2", n).astype(np.int64)
            for bit in range(16, bits):
                found |= np.unpackbits(take("u1", -(-n // 8)), count=n).astype(np.int64) << bit
            return found

        self.rules = unpacked(2 * rules).reshape(rules, 2)
        self.sizes = np.append(np.ones(self.first, dtype=np.int64), take("<u4", rules).astype(np.int64))
        self.starts = take("<u4", self.documents + 1).astype(np.int64)
        self.symbols = unpacked(symbols)

    def _ids(self, symbols: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of what the symbols stand for; a rule is opened only if it reaches into them."""
        ends = np.cumsum(self.sizes[symbols])
        stop = int(ends[-1]) if stop is None and ends.size else stop or 0
        out = np.zeros(max(stop - start, 0), dtype=np.int64)
        at = ends - self.sizes[symbols]
        while symbols.size:
            inside = (at < stop) & (at + self.sizes[symbols] > start)
            symbols, at = symbols[inside], at[inside]
            ready = symbols < self.first
            out[at[ready] - start] = symbols[ready]
            at = at[~ready]
            pairs = self.rules[symbols[~ready] - self.first]
            symbols = pairs.reshape(-1)
            at = np.stack([at, at + self.sizes[pairs[:, 0]]], axis=1).reshape(-1)
        return out

    def document(self, i: int) -> np.ndarray:
        return self._ids(self.symbols[self.starts[i] : self.starts[i + 1]])

    def part(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document; only the symbols that reach into them are expanded."""
        symbols = self.symbols[self.starts[i] : self.starts[i + 1]]
        return self._ids(symbols, start, min(stop, int(self.sizes[symbols].sum())))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each document ends in them."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[self.symbols])])
        return self._ids(self.symbols), ends[self.starts]


# --- files ---------------------------------------------------------------------------------------


def write(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> str:
    """Writes the ids of all documents in ascending id order and returns the folder.

    Null ids come first; rows of one id are ordered by a hash of their text. Null texts count as
    empty: only the end id. Rows repeat as they do in docs, other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark, 2048)
    path = path or fresh_folder(spark, "token-ids")
    slim = docs.select(
        F.col(id_column).alias("doc"), row_keys(text_column)[0].alias("tie"), F.col(text_column).alias("text")
    )
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = slim.repartitionByRange(shards, "doc", "tie").sortWithinPartitions("doc", "tie")
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("before", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("docs", T.ArrayType(slim.schema["doc"].dataType)),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size, ids = 0, np.zeros(0, dtype=np.int64)

        def closed() -> pa.RecordBatch:
            nonlocal block, before, names, held, sizes, size
            payload = compress(np.concatenate(held), np.concatenate(sizes), encoder.size)
            own = pa.concat_arrays(names)
            whole = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([before], pa.int64()),
                pa.array([size], pa.int64()),
                whole,
                pa.array([payload], pa.binary()),
            ]
            block, before, names, held, sizes, size = block + 1, before + size, [], [], [], 0
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            ids, lengths = encoder.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            lengths = lengths + 1
            ends = np.cumsum(lengths)
            first = 0
            while first < lengths.size:  # documents until the block is full
                begin = int(ends[first] - lengths[first])
                last = int(np.searchsorted(ends, begin + BLOCK_IDS - size))
                last = min(last + 1, lengths.size)
                names.append(batch.column("doc").slice(first, last - first))
                held.append(ids[begin : ends[last - 1]])
                sizes.append(lengths[first:last])
                size += int(ends[last - 1]) - begin
                first = last
                if size >= BLOCK_IDS:
                    yield closed()
        if held:
            yield closed()
        del encoder, ids
        give_back_memory()

    ordered.mapInArrow(run, schema).write.parquet(path)
    return path


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with start: the ids of all documents before theirs."""
    blocks = spark.read.parquet(path)
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row a shard, and a shard is one task of the writer
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("before"))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32, ids) of every document in the files.

    start counts the ids of all documents before it, ids_crc32 is the checksum of the ids as
    little-endian unsigned 32-bit integers. The end id is part of both. ids are those bytes; without
    them only the digests leave the tasks.
    """
    small_batches(spark, 8)
    blocks = _blocks(spark, path).select("start", "docs", "payload")
    fields = [
        T.StructField("doc", blocks.schema["docs"].dataType.elementType),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends = Block(batch.column("payload")[i].as_py()).all()
                data = memoryview(ids.astype("<u4").tobytes())
                each = [data[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                start = batch.column("start")[i].as_py()
                columns = [
                    batch.column("docs")[i].values,
                    pa.array(start + ends[:-1]),
                    pa.array(np.diff(ends)),
                    pa.array([zlib.crc32(e) for e in each], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(each, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        give_back_memory()

    return blocks.mapInArrow(run, T.StructType(fields))
