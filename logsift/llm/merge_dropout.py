"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Each chunk of a text (the spaces before a word and the word) is merged by an agenda: the candidate
merge of the best score is taken next, the leftmost of equal ones. A candidate is the pair of spans
it joins, and a hash of key and spans decides whether it is skipped. The key is of the document, its
copy and the place of the chunk, so every occurrence of a word has a segmentation of its own. The
decision doesn't depend on order or on chance: segmentations are the same in every run.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import gathered, give_back_memory, row_keys, small_batches

# Chunks that no piece reaches over can be merged on their own: spaces with the Latin letters
# and digits or with the other characters after them, and line ends. Models whose pieces mix the two kinds get the
# wider chunks.
CHUNK = re.compile(" *[0-9A-Za-z\u00c0-\u024f]+| *[^ \n0-9A-Za-z\u00c0-\u024f]+|\n| +")
WIDE_CHUNK = re.compile(r" *[^ \n]+|\n| +")
# Chunks are merged together, step by step, up to this many characters; longer ones one by one.
LONG = 64
# A task forgets the chunks it has merged when it holds this many.
REMEMBERED = 500_000
# A text is encoded in pieces of about this many characters.
PIECE_CHARS = 1 << 20
DROPOUT = 0.1
SEED = 2024
_NONE = np.iinfo(np.int64).max
_SPAN = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads 64-bit keys evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """The pieces of a model file as tables: characters, merges, bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [
            model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
            for i in range(size)
        ]
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        whole = (len(CHUNK.findall(p.replace("▁", " "))) == 1 for p in ids)
        self.chunk = CHUNK if all(whole) else WIDE_CHUNK
        self.byte_ids = np.zeros(256, dtype=np.int32)
        stored = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                stored.append(bytes([value]))
            else:
                stored.append(b"" if special[i] else piece.replace("▁", " ").encode())
        self.lengths = np.array([len(b) for b in stored])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(stored), dtype=np.uint8)
        # spaces are written as ▁ in pieces; the character ▁ itself goes as bytes
        self.characters = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1 and piece != "▁":
                self.characters[ord(piece)] = i
        self.characters[ord(" ")] = ids["▁"]
        # equal scores share a rank; the best comes first
        scores = np.array([model.get_score(i) for i in range(size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = i
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two pieces make, or -1."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), self.pair_keys.size - 1)
        hit = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ids[at], -1)


class Merger:
    """Merges many chunks at a time; every chunk comes with the key of its skips."""

    def __init__(self, vocabulary: Vocabulary, dropout: float):
        self.v = vocabulary
        self.limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        self.never = dropout <= 0

    def skipped(self, key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.never:
            return np.zeros(np.shape(start), dtype=bool)
        # three places of a chunk of any length, each with a multiplier of its own, then one mixing
        with np.errstate(over="ignore"):
            spans = start.astype(np.uint64) * _SPAN[0] + mid.astype(np.uint64) * _SPAN[1]
            return _mix(key + spans + end.astype(np.uint64) * _SPAN[2]) < self.limit

    def merge(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, and how many each has."""
        if max(map(len, chunks)) <= LONG:
            return self._together(chunks, keys)
        sizes = np.array([len(c) for c in chunks])
        runs = np.flatnonzero(np.diff(sizes > LONG, prepend=sizes[0] <= LONG))
        flat, width = [], []
        for start, end in zip(runs, np.append(runs[1:], sizes.size)):
            if sizes[start] <= LONG:
                ids, widths = self._together(chunks[start:end], keys[start:end])
                flat.append(ids)
                width.append(widths)
            else:
                each = [self._by_agenda(chunks[i], keys[i]) for i in range(start, end)]
                flat += each
                width.append(np.array([ids.size for ids in each]))
        return np.concatenate(flat), np.concatenate(width)

    def _spelled(self, text: np.ndarray, sym: np.ndarray, start: np.ndarray) -> dict[int, np.ndarray]:
        """By place: the byte ids of each character that is not in the model."""
        unknown = np.flatnonzero(sym < 0)
        spelled = {}
        for i in unknown.tolist():
            data = chr(int(text[start[i]])).encode("utf-8", "surrogatepass")
            spelled[i] = self.v.byte_ids[np.frombuffer(data, dtype=np.uint8)]
        return spelled

    def _together(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(c) for c in chunks])
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        # narrow numbers: most of the time goes into moving them together
        word = np.repeat(np.arange(len(chunks), dtype=np.int32), sizes)
        sym = self.v.characters[text]
        start = np.arange(text.size, dtype=np.int32)
        end = start + np.int32(1)

        def candidates(at: np.ndarray, sym, word, start, end) -> tuple[np.ndarray, np.ndarray]:
            """Order key and piece of the merges of the symbols at the places with their next."""
            order, piece = np.full(at.size, _NONE), np.full(at.size, -1, dtype=np.int32)
            inner = at < sym.size - 1
            inner[inner] = word[at[inner]] == word[at[inner] + 1]
            i = at[inner]
            made = self.v.merged(sym[i], sym[i + 1])
            own = word[i]
            good = np.flatnonzero(made >= 0)
            i, own, made = i[good], own[good], made[good]
            begin = first[own]
            low = start[i] - begin
            kept = ~self.skipped(keys[own], low, end[i] - begin, end[i + 1] - begin)
            place = np.flatnonzero(inner)[good[kept]]
            order[place] = self.v.rank[made[kept]] * (LONG + 1) + low[kept]
            piece[place] = made[kept]
            return order, piece

        order, piece = candidates(np.arange(sym.size), sym, word, start, end)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while sym.size:
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(order, heads)
            counts = np.diff(np.append(heads, sym.size))
            active = np.repeat(best != _NONE, counts)
            if not active.all():  # chunks without a candidate are finished
                rest = ~active
                done.append((word[rest], sym[rest], start[rest]))
                word, sym, start, end = word[active], sym[active], start[active], end[active]
                order, piece = order[active], piece[active]
                if not sym.size:
                    break
                best, counts = best[best != _NONE], counts[best != _NONE]
            at = np.flatnonzero(order == np.repeat(best, counts))  # one place a chunk
            sym[at] = piece[at]
            end[at] = end[at + 1]
            stay = np.ones(sym.size, dtype=bool)
            stay[at + 1] = False
            moved = at - np.arange(at.size)  # places after the right halves are gone
            word, sym, start, end = word[stay], sym[stay], start[stay], end[stay]
            order, piece = order[stay], piece[stay]
            left = moved[(moved > 0)] - 1
            left = left[word[left] == word[left + 1]]
            for near in (moved, left):
                order[near], piece[near] = candidates(near, sym, word, start, end)
        word = np.concatenate([d[0] for d in done])
        sym = np.concatenate([d[1] for d in done])
        start = np.concatenate([d[2] for d in done])
        by_place = np.argsort(start, kind="stable")
        word, sym, start = word[by_place], sym[by_place], start[by_place]
        spelled = self._spelled(text, sym, start)
        if spelled:
            width = np.ones(sym.size, dtype=np.int64)
            at = np.array(list(spelled))
            width[at] = [s.size for s in spelled.values()]
            place = np.concatenate([[0], np.cumsum(width)])[:-1]
            flat = np.repeat(sym, width)
            for i, ids in spelled.items():
                flat[place[i] : place[i] + ids.size] = ids
            sym, word = flat, np.repeat(word, width)
        return sym.astype(np.int32), np.bincount(word, minlength=len(chunks))

    def _by_agenda(self, chunk: str, key: np.uint64) -> np.ndarray:
        """One chunk with a heap of candidates and linked symbols, for chunks of any length."""
        text = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym = self.v.characters[text].astype(np.int64)
        size = sym.size
        end = np.arange(1, size + 1)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        agenda: list[tuple[int, int, int, int, int]] = []  # rank, start, mid, end, piece
        all_keys = np.full(1, key, dtype=np.uint64)

        def offer(places: np.ndarray) -> None:
            nexts = after[places]
            places, nexts = places[nexts < size], nexts[nexts < size]
            made = self.v.merged(sym[places], sym[nexts])
            good = (made >= 0) & ~self.skipped(all_keys, places, end[places], end[nexts])
            for i, p, m, e in zip(
                places[good].tolist(), made[good].tolist(), end[places[good]].tolist(), end[nexts[good]].tolist()
            ):
                heapq.heappush(agenda, (int(self.v.rank[p]), i, m, e, p))

        offer(np.arange(size))
        gone = np.zeros(size, dtype=bool)
        while agenda:
            _, i, mid, stop, piece = heapq.heappop(agenda)
            if gone[i] or end[i] != mid or after[i] != mid or end[mid] != stop:
                continue  # one of its halves has been merged otherwise
            gone[mid] = True
            sym[i], end[i], after[i] = piece, stop, after[mid]
            if after[i] < size:
                before[after[i]] = i
            near = [i] if before[i] < 0 else [int(before[i]), i]
            offer(np.array(near))
        places = np.flatnonzero(~gone)
        spelled = self._spelled(text, sym[places], places)
        parts = [spelled.get(n, np.array([s])) for n, s in enumerate(sym[places].tolist())]
        return np.concatenate(parts).astype(np.int32)


class Encoder:
    """Encodes texts. Without dropout, or with a number of variants, it remembers the chunks it has merged."""

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int, variants: int | None = None):
        self.merger = Merger(vocabulary, dropout)
        self.dropout, self.seed, self.variants = dropout, seed, max(1, variants or 1)
        self.each = dropout > 0 and variants is None
        self.known: list[dict[str, int]] = []
        self.forget()

    def forget(self) -> None:
        self.known = [{} for _ in range(self.variants)]
        self.held = 0
        self.flat, self.width, self.offset = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def variant(self, doc: object) -> int:
        """Which of the variants the chunks of a document take."""
        if self.dropout <= 0 or self.variants == 1:
            return 0
        return xxhash.xxh64_intdigest(repr(doc).encode(), self.seed) % self.variants

    def _learn(self, pieces: list[tuple[int, list[str]]]) -> None:
        new: list[str] = []
        seeds: list[int] = []
        for variant, chunks in pieces:
            known = self.known[variant]
            unknown = set(chunks).difference(known)
            known.update(zip(unknown, range(self.held + len(new), self.held + len(new) + len(unknown))))
            new += unknown
            seeds += [self.seed + variant] * len(unknown)
        if not new:
            return
        digest = xxhash.xxh64_intdigest
        keys = (digest(c.encode("utf-8", "surrogatepass"), s) for c, s in zip(new, seeds))
        flat, width = self.merger.merge(new, np.fromiter(keys, dtype=np.uint64, count=len(new)))
        self.held += len(new)
        self.offset = np.append(self.offset, self.flat.size + np.cumsum(width) - width)
        self.width = np.append(self.width, width)
        self.flat = np.append(self.flat, flat.astype(np.int64))

    def _encode_each(self, texts: list[tuple[object, str]]) -> list[np.ndarray]:
        """Every chunk of every text by skips of its own, in batches of about PIECE_CHARS characters."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        pieces: list[tuple[int, int]] = []
        chunks: list[str] = []
        keys: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal pieces, chunks, keys, held
            if chunks:
                flat, width = self.merger.merge(chunks, np.concatenate(keys))
                ends = np.cumsum(width)[np.cumsum([many for _, many in pieces]) - 1]
                for (i, _), ids in zip(pieces, np.split(flat, ends[:-1])):
                    found[i].append(ids.astype(np.int32))
            pieces, chunks, keys, held = [], [], [], 0

        for i, (doc, text) in enumerate(texts):
            own = np.uint64(xxhash.xxh64_intdigest(repr(doc).encode("utf-8", "surrogatepass"), self.seed))
            place = 0
            for part in _parts(" " + text) if text else ():
                new = self.merger.v.chunk.findall(part)
                places = np.arange(place, place + len(new), dtype=np.uint64)
                keys.append(_mix(own + places * np.uint64(0x9E3779B97F4A7C15)))
                pieces.append((i, len(new)))
                chunks += new
                place += len(new)
                held += len(part)
                if held > PIECE_CHARS:
                    flush()
        flush()
        empty = np.zeros(0, dtype=np.int32)
        return [np.concatenate(f) if f else empty for f in found]

    def encode(self, texts: list[tuple[object, str]]) -> list[np.ndarray]:
        if self.each:
            with np.errstate(over="ignore"):
                return self._encode_each(texts)
        if self.held > REMEMBERED:
            self.forget()
        found: list[list[np.ndarray]] = [[] for _ in texts]
        pieces: list[tuple[int, int, list[str]]] = []
        held, chunk = 0, self.merger.v.chunk.findall

        def flush() -> None:
            nonlocal pieces, held
            self._learn([(variant, chunks) for _, variant, chunks in pieces])
            for i, variant, chunks in pieces:
                known = self.known[variant]
                rows = np.fromiter(map(known.__getitem__, chunks), dtype=np.int64, count=len(chunks))
                found[i].append(gathered(self.flat, self.offset, self.width, rows).astype(np.int32))
            pieces, held = [], 0
            if self.held > REMEMBERED:
                self.forget()

        for i, (doc, text) in enumerate(texts):
            variant = self.variant(doc)
            for part in _parts(" " + text) if text else ():
                pieces.append((i, variant, chunk(part)))
                held += len(part)
                if held > PIECE_CHARS:
                    flush()
        flush()
        empty = np.zeros(0, dtype=np.int32)
        return [np.concatenate(f) if f else empty for f in found]


def _parts(text: str) -> Iterator[str]:
    """Pieces of a long text, cut where a chunk begins anyway: at a line end, or before spaces."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = text.find("\n", at + PIECE_CHARS)
        space = re.compile(r"(?<=[^ ]) ").search(text, at + PIECE_CHARS)
        cuts = [c for c in (cut, space.start() if space else -1) if c > at]
        if not cuts:
            break
        yield text[at : min(cuts)]
        at = min(cuts)
    yield text[at:]


def encode(
    docs: DataFrame,
    model: str,
    dropout: float = DROPOUT,
    seed: int = SEED,
    variants: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Every row of docs with ids, the pieces of its whole text; columns: row, ids.

    Every chunk is segmented by the document's id and the chunk's place; a number of variants limits
    a chunk to so many segmentations, which is faster. Dropout 0 gives the model's plain encoding, 1
    single characters. A null or empty text has no ids. Characters that are not in the model become
    their bytes. Rows with one id and text are numbered, and segmented each in its own way.
    """
    small_batches(docs.sparkSession)

    def work(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = Encoder(Vocabulary(model), dropout, seed, variants)
        for names, texts in parts:
            rows = [(n, t or "") for n, t in zip(names, texts)]
            yield pd.Series(encoder.encode(rows), dtype=object)
        del encoder
        give_back_memory()

    # annotations of this module are strings; Spark reads them to tell the kind of function
    work.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    run = F.pandas_udf(work, T.ArrayType(T.IntegerType(), False))
    rows = docs.select(F.struct("*").alias("row"), *(k.alias(n) for n, k in zip(("k1", "k2"), row_keys(id_column, text_column))))
    name: Column = F.coalesce(F.col(f"row.`{id_column}`").cast("string"), F.lit(""))
    if dropout > 0 and variants is None:
        hashed = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
        copy = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.xxhash64(*hashed)))
        rows = rows.withColumn("copy", copy)
        name = F.when(F.col("copy") > 1, F.concat(name, F.lit("\0"), F.col("copy").cast("string"))).otherwise(name)
    return rows.select("row", run(name, F.col(f"row.`{text_column}`")).alias("ids"))


def decode(rows: DataFrame, model: str, ids_column: str = "ids") -> DataFrame:
    """Adds decoded: the text the ids stand for, empty for none and for null."""
    small_batches(rows.sparkSession)

    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(model)
        for series in parts:
            texts = []
            for ids in series:
                if ids is None or len(ids) == 0:
                    texts.append("")
                    continue
                data = gathered(v.bytes, v.offsets, v.lengths, np.asarray(ids, dtype=np.int64))
                texts.append(data.tobytes()[1:].decode("utf-8", "replace"))
            yield pd.Series(texts, dtype=object)

    work.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("decoded", F.pandas_udf(work, "string")(ids_column))
