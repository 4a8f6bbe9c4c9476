"""SentencePiece encoding and decoding by batched Viterbi (operator 8).

A text is escaped (spaces become U+2581, one is put in front) and cut before
every run of U+2581; no piece of a vocabulary that splits at white space
crosses such a cut, so the best segmentation of a text is that of its parts.
Distinct parts of equal length advance together: for every end position the
hashes of all substrings ending there probe the sorted hashes of the pieces,
the best score so far plus the piece's score is maximised over the batch, and
the winning length is stored as backpointer.  Ties take the longest last
piece.  A character without a piece costs ten less than the worst piece and is
written as its UTF-8 bytes.  A part of more than ``LONG_PART`` characters
(text without spaces) has hardly a second of its length: there the loops are
turned round.  All substrings of one length are probed at once, and one pass
over the pieces found, by end, stores the same backpointers; merges take the
best pair from a heap.  Work is linear in the part's length (times a logarithm
for merges), the results are the same.

This is the unigram reading of the piece table: the segmentation of largest
total piece score.  A model file of BPE type means something else by its
scores, the order of merges, and no sum of scores gives its segmentation.  For
such files the same batches also advance by merges (``merged``): the pair of
neighbouring symbols with the best piece is joined in every word at once, until
no pair is a piece.  ``encode`` returns both.

Defined results: null and empty texts have no ids; repeated rows are encoded
alike; an empty table gives an empty result; further columns are ignored;
decoding the ids of a text gives the text back (U+2581 itself comes back as a
space); a text of any length, with or without spaces, is encoded whole.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilo.llm.words import mix, sub_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
BATCH_CELLS = 1 << 18      # words times length of one matrix
LONG_PART = 256            # characters from which a part advances on its own
PROBED = 1 << 20           # substrings of a long part that are probed at once
CACHED = 300_000           # parts remembered by a worker
INDEX_BITS = 18            # of the index into the sorted keys
TEXT_BYTES = 2 << 20       # text of one batch
_PART = re.compile(r" *[^ ]+| +")
_LINE_PART = re.compile(r" *[^ \n]+| +|\n")     # where no piece holds a line break
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _prefix_hashes(codes: np.ndarray, power: np.ndarray) -> np.ndarray:
    total = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power[:codes.shape[1]], axis=1, out=total[:, 1:])
    return total


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


class Pieces:
    """Piece table of a SentencePiece model: sorted hashes, scores, byte pieces, decoding table."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        power, inverse = _powers(self.longest + 1)
        keys = np.array([_prefix_hashes(_codes([pieces[i]], len(pieces[i])), power)[0, -1] for i in normal], np.uint64)
        order = np.argsort(keys)
        if len(keys) > 1 and (np.diff(keys[order]) == 0).any():
            raise ValueError("two pieces share a hash")
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        self.scores = np.array(scores, np.float64)[self.ids]
        # Where the keys with given upper bits start; most substrings have none.
        many = np.bincount(self._upper(self.keys), minlength=1 << INDEX_BITS)
        self.first = (np.cumsum(many) - many).astype(np.int32)
        self.some = many > 0
        self.steps = int(many.max(initial=1)) - 1
        self.part = _PART if any("\n" in pieces[i] for i in normal) else _LINE_PART
        self.unknown = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        byte = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.unknown_id = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        self.bytes = [byte.get(b, self.unknown_id) for b in range(256)] if byte else None
        self.text = [p.encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b""
                     for p, k in zip(pieces, kinds)]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        kind = ["byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i)
                else "normal" for i in ids]
        return cls([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], kind)

    @staticmethod
    def _upper(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - INDEX_BITS)).view(np.int64)

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces (positions in ``h``), and their places among the sorted keys."""
        upper = self._upper(h)
        maybe = np.flatnonzero(self.some[upper])
        h = h[maybe]
        at = self.first[upper[maybe]]
        for _ in range(self.steps):
            at = np.minimum(at + (self.keys[at] < h), len(self.keys) - 1)
        known = self.keys[at] == h
        return maybe[known], at[known]

    def encode_parts(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and their number per part, of the best path and in merge order, for parts in order of length."""
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        a = 0
        while a < len(parts):
            length = len(parts[a])
            b = a + 1
            if length > LONG_PART:
                codes = _codes(parts[a:b], length)
                for out, ids in zip(found, self._long(codes)):
                    out.append(ids)
                a = b
                continue
            most = a + max(1, BATCH_CELLS // max(length, 1))
            while b < min(len(parts), most) and len(parts[b]) == length:
                b += 1
            codes = _codes(parts[a:b], length)
            power, inverse = _powers(length + 1)
            total = _prefix_hashes(codes, power)
            found[0].append(self._equal_length(codes, total, inverse))
            found[1].append(self._merged(codes, total, inverse))
            a = b
        none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return [tuple(map(np.concatenate, zip(*x))) if x else none for x in found]

    def _long(self, codes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Best path and merge order of one long part."""
        length = codes.shape[1]
        power, inverse = _powers(length + 1)
        total = _prefix_hashes(codes, power)[0]
        starts, sizes, places = [], [], []
        for size in range(min(self.longest, length), 0, -1):
            for a in range(0, length - size + 1, PROBED):
                b = min(a + PROBED, length - size + 1)
                rows, at = self._probe((total[a + size:b + size] - total[a:b]) * inverse[a:b])
                starts.append(rows + a)
                sizes.append(np.full(len(rows), size, np.int16))
                places.append(at.astype(np.int32))
        start, size, at = map(np.concatenate, (starts, sizes, places))
        return self._long_path(codes, start, size, at), self._long_merged(codes, start, size, at)

    def _long_path(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray,
                   at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = codes.shape[1]
        end = start + size
        order = np.argsort(end, kind="stable")             # at one end the longest piece comes first
        many = np.bincount(end, minlength=length + 1)
        upto = np.cumsum(many)
        back, piece = np.ones(length + 1, np.int16), np.full(length + 1, -1, np.int64)
        recent = [0.0]                                     # best of the last ends, as many as a piece is long
        for a in range(1, length + 1, PROBED):
            b = min(a + PROBED, length + 1)
            lo, hi = upto[a - 1], upto[b - 1]
            chosen = order[lo:hi]
            worth = self.scores[at[chosen]].tolist()
            width, ids = size[chosen].tolist(), self.ids[at[chosen]].tolist()
            ends = (upto[a:b] - lo).tolist()
            m, base = 0, a - len(recent)                   # place of recent[0]
            for e in range(a, b):
                top, step, name, single = -np.inf, 1, -1, False
                for m in range(m, ends[e - a]):
                    s = recent[e - width[m] - base] + worth[m]
                    single |= width[m] == 1
                    if s > top:
                        top, step, name = s, width[m], ids[m]
                m = ends[e - a]
                s = recent[e - 1 - base] + self.unknown    # a single character, where it is better still
                if s > top and not single:
                    top, step, name = s, 1, -1
                recent.append(top)
                back[e], piece[e] = step, name
            recent = recent[-self.longest:]
        place, stops = length, []
        while place > 0:
            stops.append(place)
            place -= int(back[place])
        stop = np.array(stops[::-1], np.int64)
        return self._written(codes, np.zeros(len(stop), np.int64), stop - 1, piece[stop])

    def _long_merged(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray,
                     at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, wide = codes.shape[1], self.longest + 1
        key = start * wide + size
        order = np.argsort(key)
        keys, places = array("q", key[order].tobytes()), array("i", at[order].astype(np.intc).tobytes())
        scores = self.scores

        def worth(a: int, b: int) -> float | None:
            """Score of the piece at [a, b), if it is one."""
            if b - a >= wide:
                return None
            k = a * wide + b - a
            i = bisect_left(keys, k)
            return float(scores[places[i]]) if i < len(keys) and keys[i] == k else None

        pair = size == 2
        heap = list(zip((-scores[at[pair]]).tolist(), start[pair].tolist(), (start[pair] + 2).tolist()))
        heapify(heap)                                      # best score first, then the leftmost
        after, before = array("q", range(1, length + 1)), array("q", range(-1, length - 1))
        symbol = bytearray(b"\x01") * length
        while heap:
            _, i, k = heappop(heap)
            if not symbol[i]:
                continue
            j = after[i]
            if j >= length or after[j] != k:               # a pair that is no more
                continue
            after[i] = k
            symbol[j] = 0
            if k < length:
                before[k] = i
                s = worth(i, after[k])
                if s is not None:
                    heappush(heap, (-s, i, after[k]))
            if i > 0:
                s = worth(before[i], k)
                if s is not None:
                    heappush(heap, (-s, before[i], k))
        first = np.flatnonzero(np.frombuffer(symbol, np.uint8))
        stop = np.frombuffer(after, np.int64)[first]
        key = first * wide + (stop - first)
        sorted_keys = np.frombuffer(keys, np.int64)
        where = np.minimum(np.searchsorted(sorted_keys, key), max(len(sorted_keys) - 1, 0))
        piece = np.full(len(first), -1, np.int64)
        if len(sorted_keys):
            known = (sorted_keys[where] == key) & (stop - first < wide)
            piece[known] = self.ids[np.frombuffer(places, np.intc)[where[known]]]
        return self._written(codes, np.zeros(len(first), np.int64), stop - 1, piece)

    def _equal_length(self, codes: np.ndarray, total: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = codes.shape[1]
        total = np.ascontiguousarray(total.T)            # by place, then word
        n = len(codes)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        back = np.ones((length + 1, n), np.int16)        # length of the last piece
        piece = np.full((length + 1, n), -1, np.int64)   # its id, -1: unknown character
        for end in range(1, length + 1):
            top, length_of, id_of = best[end], back[end], piece[end]
            for size in range(min(self.longest, end), 0, -1):
                start = end - size
                rows, at = self._probe((total[end] - total[start]) * inverse[start])
                score = best[start, rows] + self.scores[at]
                better = score > top[rows]
                rows, at = rows[better], at[better]
                top[rows] = score[better]
                length_of[rows] = size
                id_of[rows] = self.ids[at]
            unknown = best[end - 1] + self.unknown       # a single character, where it is better still
            rows = np.flatnonzero(unknown > top)
            single, _ = self._probe((total[end][rows] - total[end - 1][rows]) * inverse[end - 1])
            rows = np.delete(rows, single)
            top[rows] = unknown[rows]
            length_of[rows] = 1
            id_of[rows] = -1
        # Backpointers, from the end of every word.
        ends = np.zeros((n, length + 1), bool)
        place, rows = np.full(n, length), np.arange(n)
        while len(rows):
            ends[rows, place] = True
            place = place - back[place, rows]
            rows, place = rows[place > 0], place[place > 0]
        row, place = np.nonzero(ends)
        return self._written(codes, row, place - 1, piece[place, row])

    def _merged(self, codes: np.ndarray, total: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = codes.shape

        def worth(rows, start, end):
            """Score of the piece at [start, end) of each row, or -inf."""
            out = np.full(len(rows), -np.inf)
            known, at = self._probe((total[rows, end] - total[rows, start]) * inverse[start])
            out[known] = self.scores[at]
            return out

        every = np.repeat(np.arange(n), max(length - 1, 0))
        first = np.tile(np.arange(length - 1), n)
        score = np.full((n, length), -np.inf)              # of joining the symbol that starts here with the next
        score[:, :length - 1] = worth(every, first, first + 2).reshape(n, length - 1)
        after = np.tile(np.arange(1, length + 1), (n, 1))  # end of the symbol that starts here
        before = np.tile(np.arange(-1, length - 1), (n, 1))  # start of the symbol before
        starts = np.ones((n, length), bool)
        rows = np.arange(n)
        while len(rows):
            i = score[rows].argmax(axis=1)
            go = score[rows, i] > -np.inf
            rows, i = rows[go], i[go]
            if not len(rows):
                break
            j = after[rows, i]
            k = after[rows, j]
            after[rows, i] = k
            starts[rows, j] = False
            score[rows, j] = -np.inf
            score[rows, i] = -np.inf
            more = k < length
            r, a, b = rows[more], i[more], k[more]
            before[r, b] = a
            score[r, a] = worth(r, a, after[r, b])
            left = i > 0
            r, a, b = rows[left], before[rows[left], i[left]], k[left]
            score[r, a] = worth(r, a, b)
        row, start = np.nonzero(starts)
        stop = after[row, start]
        known, at = self._probe((total[row, stop] - total[row, start]) * inverse[start])
        piece = np.full(len(row), -1, np.int64)
        piece[known] = self.ids[at]
        return self._written(codes, row, stop - 1, piece)

    def _written(self, codes: np.ndarray, row: np.ndarray, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and their number per word; an unknown
        character (id -1, at ``place``) is written as its bytes."""
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            chars, which = np.unique(codes[row[lost], place[lost]], return_inverse=True)
            spelled = [self._fallback(chr(c)) for c in chars.tolist()]
            many = np.ones(len(ids), np.int64)
            many[lost] = np.array([len(x) for x in spelled])[which]
            out = np.repeat(ids, many)
            out[out < 0] = np.concatenate([spelled[w] for w in which.tolist()])
            ids, row = out, np.repeat(row, many)
        return ids.astype(np.uint32), np.bincount(row, minlength=len(codes))

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown_id]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.decode("utf-8", "replace").replace(SPACE, " ")[1:]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One table per Python worker and model."""
    return Pieces.load(path)


class Ragged:
    """Rows of ids in one flat array."""

    def __init__(self):
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)

    def append(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.start = np.cumsum(self.size) - self.size

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``rows`` one after the other, and the number of each."""
        size = self.size[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[rows] - (ends - size), size)
        return self.flat[at], size


class Encoder:
    """Ids of texts; the parts of recent texts are remembered, their number is bounded."""

    def __init__(self, table: Pieces):
        self.table = table
        self.row: dict[str, int] = {}
        self.known = [Ragged(), Ragged()]      # best path, merge order

    def texts(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Best-path ids and merge-order ids of every text."""
        parts = [self.table.part.findall(" " + t) if t else [] for t in texts]
        distinct = set().union(*parts) if parts else set()
        new = sorted(distinct.difference(self.row), key=len)
        if len(self.row) + len(new) > CACHED:      # forget all but what this batch needs
            kept = [p for p in distinct if p in self.row]
            rows = np.fromiter(map(self.row.__getitem__, kept), np.int64, len(kept))
            for i, known in enumerate(self.known):
                self.known[i] = Ragged()
                self.known[i].append(*known.take(rows))
            self.row = dict(zip(kept, range(len(kept))))
        for known, found in zip(self.known, self.table.encode_parts([p.replace(" ", SPACE) for p in new])):
            known.append(*found)
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(parts)), np.int64, int(many.sum()))
        border = np.concatenate(([0], np.cumsum(many)))
        out = []
        for known in self.known:
            ids, size = known.take(rows)
            raw = ids.astype("<u4").tobytes()
            at = (4 * np.concatenate(([0], np.cumsum(size)))[border]).tolist()
            out.append([raw[a:b] for a, b in zip(at, at[1:])])
        return out[0], out[1]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, text, ids, merged_ids`` (little-endian unsigned 32-bit ids)."""
    path = path or default_path()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Encoder(pieces(path))
        for batch in sub_batches(batches, limit=TEXT_BYTES):
            ids = worker.texts([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"),
                                              *(pa.array(x, pa.binary()) for x in ids)],
                                             ["doc_id", "text", "ids", "merged_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text string, ids binary, merged_ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``encoded`` plus ``decoded``."""
    path = path or default_path()
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                texts = [table.decode(x or b"") for x in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(texts, pa.string())],
                                                 columns + ["decoded"])

    schema = ", ".join(f"`{c}` {k}" for c, k in encoded.dtypes)
    return encoded.mapInArrow(run, schema + ", decoded string")
