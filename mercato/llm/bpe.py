"""Operator 1: byte-level BPE encoding and decoding.

A text is split into pre-tokens by ``public_tokenizers.PATTERN``.  Two tiers
then look each one up: a minimal perfect hash over the vocabulary resolves the
pre-tokens that are whole tokens, for a batch at a time; the others are merged
by a heap over linked bytes, lowest rank first, once per distinct pre-token of
the batch.  Splitting, hashing and the lookup are numpy over the UTF-8 bytes
of an Arrow batch; the tables (a few MB, as large as the vocabulary file) are
broadcast.

Cases: a null or empty text has no ids; a text is never cut, and a long one is
worked on in pieces that begin at white space behind a visible ASCII character,
where a pre-token always ends; other columns pass through; a column with the
output's name is replaced; repeated rows give repeated results; an empty table
an empty one.  Decoding an id outside the vocabulary fails.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mercato.llm._arrow import (PIECE_BYTES, append_columns, binary_array,
                                list_array, slices, text_view)
from mercato.llm._words import mix

#: Bounded memory of one worker: distinct merged pre-tokens it remembers.
REMEMBERED = 200_000

OTHER, LETTER, NUMBER, WHITE, BLANK = range(5)

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> np.ndarray:
    """The class of every code point: letter, number, blank, white or other."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        table[point] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(point))[0], OTHER)
    table[WHITE_SPACE] = WHITE
    table[0x20] = BLANK
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


# --- the minimal perfect hash -------------------------------------------------

def _words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one little-endian number."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"),
                                           (len(data) + 8,), (1,))


_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _word(words: np.ndarray, start: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    return words[start + 8 * k] & _MASK[np.minimum(length - 8 * k, 8)]


def _hash(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    h = mix(length.astype(np.uint64))
    rows, k = None, 0
    while True:
        if rows is None:
            h = mix(h ^ _word(words, start, length, 0))
        else:
            h[rows] = mix(h[rows] ^ _word(words, start[rows], length[rows], k))
        k += 1
        rows = np.flatnonzero(length > 8 * k) if rows is None else rows[length[rows] > 8 * k]
        if not len(rows):
            return h


class PerfectHash:
    """A minimal perfect hash: n keys, n slots, one displacement per bucket."""

    PROBES = 64

    def __init__(self, hashes: np.ndarray):
        self.n = n = len(hashes)
        self.buckets = max(1, n // 3)
        self.displacement = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if n else []
        parts.sort(key=len, reverse=True)
        for part in parts:
            if len(part) == 1:
                break
            keys, first = hashes[part], 0
            while True:
                tries = np.arange(first, first + self.PROBES, dtype=np.uint64)
                slots = np.sort(self._slot(keys[:, None], tries[None, :]), axis=0)
                good = free[slots].all(0) & (slots[1:] != slots[:-1]).all(0)
                if good.any():
                    found = int(np.argmax(good))
                    self.displacement[bucket[part[0]]] = first + found
                    free[slots[:, found]] = False
                    break
                first += self.PROBES
        # a bucket of one key names its slot itself
        single = np.array([part[0] for part in parts if len(part) == 1], np.int64)
        self.displacement[bucket[single]] = -1 - np.flatnonzero(free)[:len(single)]

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        moved = mix(hashes + displacement * np.uint64(0x9E3779B97F4A7C15))
        return (moved % np.uint64(self.n)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        d = self.displacement[self._bucket(hashes)]
        return np.where(d < 0, -1 - d, self._slot(hashes, np.maximum(d, 0).astype(np.uint64)))


# --- the vocabulary -----------------------------------------------------------

class Vocabulary:
    """Ranks with their perfect hash, the decoding table and the classes."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds all 256 single bytes")
        self.ranks, self.pairs = ranks, pair_ranks(ranks)
        tokens = list(ranks)
        length = np.array([len(t) for t in tokens], np.int64)
        start = np.cumsum(length) - length
        words = _words_of(np.frombuffer(b"".join(tokens), np.uint8))
        hashes = _hash(words, start, length)
        self.perfect = PerfectHash(hashes)
        slot = self.perfect.slots(hashes)
        self.longest = int(length.max())
        self.slot_id = np.empty(len(tokens), np.int64)
        self.slot_id[slot] = list(ranks.values())
        self.slot_length = np.empty(len(tokens), np.int64)
        self.slot_length[slot] = length
        self.slot_word = np.zeros((-(-self.longest // 8), len(tokens)), np.uint64)
        for k in range(len(self.slot_word)):
            rows = np.flatnonzero(length > 8 * k)
            self.slot_word[k, slot[rows]] = _word(words, start[rows], length[rows], k)
        by_id = {rank: token for token, rank in ranks.items()}
        top = max(by_id) + 1
        self.known = np.zeros(top, bool)
        self.known[list(by_id)] = True
        self.id_length = np.array([len(by_id.get(i, b"")) for i in range(top)], np.int64)
        self.id_start = np.cumsum(self.id_length) - self.id_length
        self.id_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)
        self.classes = character_classes()
        #: merged pre-tokens, kept while the Python worker lives
        self.seen: dict[bytes, bytes] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        return cls(read_ranks(path))

    def find(self, words: np.ndarray, start: np.ndarray, length: np.ndarray,
             hashes: np.ndarray) -> np.ndarray:
        """The id of each whole pre-token, -1 where it is not a token."""
        slot = self.perfect.slots(hashes)
        same = self.slot_length[slot] == length
        rows = np.flatnonzero(same)
        for k in range(len(self.slot_word)):
            rows = rows[length[rows] > 8 * k]
            if not len(rows):
                break
            same[rows] &= self.slot_word[k, slot[rows]] == _word(
                words, start[rows], length[rows], k)
        return np.where(same, self.slot_id[slot], -1)


# --- pre-tokens -----------------------------------------------------------------

def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of each character of UTF-8 bytes."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[lead].astype(np.int32)
    for size, low, bits in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        rows = np.flatnonzero((point >= low) & (point < {2: 0xE0, 3: 0xF0, 4: 0x100}[size])
                              & (data[lead] >= low))
        value = point[rows] & bits
        for k in range(1, size):
            value = (value << 6) | (data[lead[rows] + k] & 0x3F)
        point[rows] = -value  # negative: not taken for a lead byte again
    return lead, np.abs(point)


def pretokens(data: np.ndarray, breaks: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions at which the pattern's matches begin.  ``breaks``: where
    texts begin (ascending, 0 first)."""
    lead, point = _code_points(data)
    n = len(lead)
    if not n:
        return lead
    cls = classes[point]
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(lead, breaks)] = True
    opens[n] = True
    kind = np.minimum(cls, WHITE)
    begin = opens[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # a blank joins the visible run behind it ...
    joined = np.zeros(n, bool)
    joined[1:] = (cls[:-1] == BLANK) & (kind[1:] != WHITE) & ~opens[1:n]
    begin &= ~joined
    # ... and the last white character of a run stands apart before a visible one
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~opens[1:n])
    begin[last] = True
    # contractions, where an apostrophe opens a match
    quote = np.flatnonzero((point == 0x27) & begin)
    if len(quote):
        padded = np.concatenate([point, [0, 0, 0]])
        text_end = np.flatnonzero(opens)
        room = text_end[np.searchsorted(text_end, quote, "right")] - quote
        one, two = padded[quote + 1], padded[quote + 2]
        size = np.where((room > 1) & np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(room > 2) & (one == ord(a)) & (two == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        behind = quote + size
        begin[behind[behind < n]] = True
    return lead[begin]


def _cut(data: np.ndarray, offsets: np.ndarray, most: int):
    """Pieces as in ``_words.pieces``, cut at a text's end or at a blank or
    line feed behind a visible ASCII character."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + most, end)
        while to < end:
            text = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            part = data[at:to]
            found = np.flatnonzero(((part[1:] == 0x20) | (part[1:] == 0x0A))
                                   & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
            cut = max(text, at + int(found[-1]) + 1 if len(found) else 0)
            if cut > at:
                to = cut
                break
            to = min(to + most, end)
        yield at, to
        at = to


# --- the second tier ------------------------------------------------------------

def pair_ranks(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes, -1 where it is no token."""
    return [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]


def merge(token: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """The ids of a pre-token: its bytes as a linked list, pairs on a heap,
    the pair of lowest rank (leftmost first) merged until none is a token."""
    n, get = len(token), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # rank[i]: of the pair that begins with the part at i; a heap entry is a
    # rank and a position in one number, and stale if rank[i] has changed
    rank = [pairs[a << 8 | b] for a, b in zip(token, token[1:])]
    rank.append(-1)
    heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)
    while heap:
        low = heapq.heappop(heap)
        i = low & 0xFFFFFFFF
        if rank[i] != low >> 32:
            continue
        j = after[i]
        after[i] = end = after[j]
        rank[j] = rank[i] = -1
        if end < n:
            before[end] = i
            if (r := get(token[i:after[end]], -1)) >= 0:
                rank[i] = r
                heapq.heappush(heap, r << 32 | i)
        if (p := before[i]) >= 0:
            rank[p] = r = get(token[p:end], -1)
            if r >= 0:
                heapq.heappush(heap, r << 32 | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[token[i:after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encodes and decodes Arrow arrays."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.seen = vocabulary.seen

    def _merged(self, token: bytes) -> bytes:
        ids = self.seen.get(token)
        if ids is None:
            ids = array("i", merge(token, self.v.ranks, self.v.pairs)).tobytes()
            if len(token) <= 64 and len(self.seen) < REMEMBERED:
                self.seen[token] = ids
        return ids

    def _piece(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each id's pre-token, id) for the bytes of one piece."""
        start = pretokens(data, breaks, self.v.classes)
        length = np.diff(start, append=len(data))
        words = _words_of(data)
        hashes = _hash(words, start, length)
        ids = self.v.find(words, start, length, hashes)
        missed = np.flatnonzero(ids < 0)
        if not len(missed):
            return start, ids
        _, sample, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
        # pre-tokens of one hash that differ (never seen) get an entry each
        rep = missed[sample]
        odd = np.flatnonzero((length[missed] != length[rep][which])
                             | (words[start[missed]] & _MASK[np.minimum(length[missed], 8)]
                                != (words[start[rep]] & _MASK[np.minimum(length[rep], 8)])[which]))
        which[odd] = len(rep) + np.arange(len(odd))
        rep = np.concatenate([rep, missed[odd]])
        text = data.tobytes()
        parts = [self._merged(text[a:b])
                 for a, b in zip(start[rep].tolist(), (start[rep] + length[rep]).tolist())]
        size = np.array(list(map(len, parts)), np.int64) // 4
        flat = np.frombuffer(b"".join(parts), np.int32)
        begin = np.cumsum(size) - size
        count = np.ones(len(start), np.int64)
        count[missed] = size[which]
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        whole = ids >= 0
        out[at[whole]] = ids[whole]
        n = size[which]
        steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at[missed], n) + steps] = flat[np.repeat(begin[which], n) + steps]
        return np.repeat(start, count), out

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as a list<int32> array."""
        data, offsets = text_view(texts)
        positions, ids = [], []
        for a, b in _cut(data, offsets, PIECE_BYTES):
            low, high = np.searchsorted(offsets, [a + 1, b])
            at, found = self._piece(data[a:b], np.concatenate([[0], offsets[low:high] - a]))
            positions.append(at + a)
            ids.append(found.astype(np.int32))
        at = np.concatenate(positions) if positions else np.zeros(0, np.int64)
        values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return list_array(np.searchsorted(at, offsets), pa.array(values))

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each id list (null: no bytes), as a binary array."""
        out = []
        for row in range(len(ids)):
            values = ids[row].values
            values = (np.zeros(0, np.int64) if values is None
                      else values.to_numpy(zero_copy_only=False).astype(np.int64))
            out.append(b"".join(self._bytes(values[k:k + PIECE_BYTES // 2])
                                for k in range(0, len(values), PIECE_BYTES // 2)))
        return binary_array(out)

    def _bytes(self, ids: np.ndarray) -> bytes:
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.v.known)
                             and self.v.known[ids].all()):
            raise ValueError("an id outside the vocabulary")
        n = self.v.id_length[ids]
        at = np.repeat(self.v.id_start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.v.id_bytes[at].tobytes()


# --- on DataFrames ----------------------------------------------------------------

def broadcast_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's tables on every executor (a few MB)."""
    return spark.sparkContext.broadcast(Vocabulary.read(path))


def encode(df: DataFrame, vocabulary, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with the token ids of column ``text``.  ``vocabulary``: from
    ``broadcast_vocabulary``."""
    def compute(arrays):
        encoder = Encoder(vocabulary.value)
        return [pa.concat_arrays([encoder.encode(x) for x in slices(arrays[0])])]
    return append_columns(df, [text], [T.StructField(ids, T.ArrayType(T.IntegerType()))], compute)


def decode(df: DataFrame, vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the ids in column ``ids``."""
    def compute(arrays):
        return [Encoder(vocabulary.value).decode(arrays[0])]
    return append_columns(df, [ids], [T.StructField(out, T.BinaryType())], compute)


def round_trip(df: DataFrame, vocabulary, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    numbers) and decoded_sha256: encodes each text, decodes the ids, and keeps
    the digests only."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]

    def compute(arrays):
        encoder = Encoder(vocabulary.value)
        count, ids_sha, text_sha = [], [], []
        for texts in slices(arrays[0]):
            ids = encoder.encode(texts)
            values = ids.values.to_numpy().astype("<u4")
            edges = ids.offsets.to_numpy()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                count.append(b - a)
                ids_sha.append(hashlib.sha256(values[a:b]).hexdigest())
                digest = hashlib.sha256()
                for k in range(a, b, PIECE_BYTES // 2):
                    digest.update(encoder._bytes(values[k:min(b, k + PIECE_BYTES // 2)].astype(np.int64)))
                text_sha.append(digest.hexdigest())
        return [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()),
                pa.array(text_sha, pa.string())]

    return append_columns(df, [text], fields, compute)
