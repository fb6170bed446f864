"""Byte-level BPE by prefix dynamic programming."""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import ChunkCache, batches_of

ENCODED_SCHEMA = "doc_id long, ids array<int>"
DECODED_SCHEMA = "doc_id long, ids array<int>, decoded binary"
_IDS = pa.list_(pa.int32())
# Prefixes up to this long are remembered across the matches that begin with them.
_SHARED_BYTES = 24


class Ranks:
    """Vocabulary of byte strings by merge rank, with the test on which the tables rest.

    A sequence of tokens is what BPE makes of its bytes exactly if that holds for every two
    neighbours in it. ``fits`` tests two neighbours by undoing their merges, and remembers.
    """

    def __init__(self, path: str, most: int = 500_000):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: token for token, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        # Every ending of a token, with the token's id or -1.
        self.endings = dict.fromkeys((t[i:] for t in self.ids for i in range(len(t))), -1) | self.ids
        self._most = most
        self.known_fits: dict[tuple[int, int], bool] = {}
        self._stable: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}

    def merged(self, data: bytes, upto: int = 1) -> list[int]:
        """Tokens after merging the adjacent pair of least rank until none or ``upto`` tokens are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > upto:
            ranked = [self.ids.get(a + b, self.longest << 32) for a, b in zip(parts, parts[1:])]
            best = min(range(len(ranked)), key=ranked.__getitem__)
            if ranked[best] == self.longest << 32:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ids[p] for p in parts]

    def stable(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        known = self._stable.get(token)
        if known is None:
            known = self._stable[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        known = self.known_fits.get((left, right))
        if known is None:
            if len(self.known_fits) >= self._most:
                self.known_fits.clear()
            known = self.known_fits[left, right] = self.stable(left) and self.stable(right) and self._stay_apart(left, right)
        return known

    def _halves_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge is the last one in a stable token of several bytes."""
        known = self._halves.get(token)
        if known is None:
            known = self._halves[token] = tuple(self.merged(self.bytes_of[token], 2))
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two stable tokens.

        Merges go by rising rank and from left to right. So they are undone from the last one on, and
        what meets at the border must not have a token that would have been made before the merge undone.
        That holds for vocabularies learnt by merging, where a token ranks behind its parts.
        """
        ids, bytes_of, limit = self.ids, self.bytes_of, self.longest << 32
        while True:
            a, b = bytes_of[left], bytes_of[right]
            if ids.get(a + b, limit) < limit:
                return False
            if len(a) > 1 and (left > right or len(b) == 1):
                limit, left = left, self._halves_of(left)[1]
            elif len(b) > 1:
                limit, right = right + 1, self._halves_of(right)[0]
            else:
                return True


class PrefixTable:
    """Last token of the encoding of every prefix of a byte string.

    That token is unique: it ends the prefix and fits the last token of the prefix before it.
    So the table grows by appends without looking back further than the longest token, and an
    edit is followed by re-encoding only until a stretch as long as that is the same again.
    """

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self._ranks = ranks
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def _last_token(self, data: bytes, end: int) -> int:
        """The one token that fits; shorter ones are tried first, being more often it."""
        ranks, last = self._ranks, self.last
        find, fits = ranks.endings.get, ranks.known_fits.get
        for begin in range(end - 1, -1, -1):
            token = find(data[begin:end])
            if token is None:
                break
            if token < 0:
                continue
            if begin:
                good = fits((last[begin - 1], token))
                if good is None:
                    good = ranks.fits(last[begin - 1], token)
            else:
                good = ranks.stable(token)
            if good:
                return token
        raise ValueError(f"no token ends at byte {end}")

    def append(self, more: bytes) -> None:
        self.data += more
        data = bytes(self.data)
        for end in range(len(self.last) + 1, len(data) + 1):
            self.last.append(self._last_token(data, end))

    def splice(self, begin: int, end: int, new: bytes) -> int:
        """Replace the bytes ``begin:end`` by ``new``; return how many prefixes were re-encoded."""
        tail = self.last[end:]
        self.data[begin:end] = new
        data = bytes(self.data)
        del self.last[begin:]
        same, done = 0, 0
        for at in range(begin + 1, len(data) + 1):
            token = self._last_token(data, at)
            self.last.append(token)
            done += 1
            old = at - begin - len(new) - 1
            same = same + 1 if old >= 0 and tail[old] == token else 0
            if same >= self._ranks.longest:
                self.last += tail[old + 1 :]
                break
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self._ranks.bytes_of[out[-1]])
        return out[::-1]


class SharedPrefixes:
    """Last tokens of the prefixes of many short byte strings, found when asked and remembered.

    ``most`` is how many are remembered; it is looked at between strings.
    """

    def __init__(self, ranks: Ranks, most: int):
        self._ranks, self._most = ranks, most
        self._known: dict[bytes, int] = {}

    def _last_token(self, data: bytes) -> int:
        """The one token that fits; longer ones are tried first, since they ask for fewer prefixes."""
        find, ranks, ends = self._ranks.endings.get, self._ranks, []
        for begin in range(len(data) - 1, -1, -1):
            token = find(data[begin:])
            if token is None:
                break
            if token >= 0:
                ends.append((begin, token))
        for begin, token in reversed(ends):
            if begin:
                before = data[:begin]
                left = self._known.get(before)
                if left is None:
                    left = self._last_token(before)
                good = ranks.known_fits.get((left, token))
                if good is None:
                    good = ranks.fits(left, token)
            else:
                good = ranks.stable(token)
            if good:
                self._known[data] = token
                return token
        raise ValueError(f"no token ends {data!r}")

    def tokens(self, data: bytes) -> list[int]:
        if len(self._known) >= self._most:
            self._known.clear()
        out = []
        while data:
            token = self._known.get(data)
            out.append(self._last_token(data) if token is None else token)
            data = data[: -len(self._ranks.bytes_of[out[-1]])]
        return out[::-1]


class Encoder(ChunkCache):
    """Token ids of whole texts, each match of ``pattern`` encoded by itself.

    A match that is a token is that token; short ones share their prefixes, the others go through a
    :class:`PrefixTable`.
    """

    def __init__(self, path: str, pattern: str, most: int = 700_000):
        super().__init__(self._new_match, regex.compile(pattern).findall, most)
        self.ranks = Ranks(path)
        self._prefixes = SharedPrefixes(self.ranks, most // 2)

    def _new_match(self, match: str) -> bytes:
        data = match.encode("utf-8")
        whole = self.ranks.ids.get(data)
        if whole is not None:
            ids = [whole]
        elif len(data) <= _SHARED_BYTES:
            ids = self._prefixes.tokens(data)
        else:
            ids = PrefixTable(self.ranks, data).tokens()
        return array("i", ids).tobytes()


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, pattern)
    for batch in batches:
        for at, texts in batches_of(batch.column(1).to_pylist()):
            parts = encoder.encode(texts)
            bounds = np.cumsum([0, *map(len, parts)]) // 4
            ids = pa.array(np.frombuffer(b"".join(parts), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids, type=_IDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], names=["doc_id", "ids"])


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> pa.BinaryArray:
    """Bytes by token id, null for an id without a token."""
    with open(path, "rb") as lines:
        bytes_of = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return pa.array([bytes_of.get(i) for i in range(max(bytes_of) + 1)], pa.binary())


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary(path)
    for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
        lists = batch.column(1)
        ids = lists.flatten()
        span = pc.min_max(ids).as_py()
        outside = len(ids) and (ids.null_count or span["min"] < 0 or span["max"] >= len(vocabulary))
        if outside or (tokens := vocabulary.take(ids)).null_count:
            raise KeyError("an id is null or has no token")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        decoded = pc.binary_join(pa.ListArray.from_arrays(bounds, tokens), b"")
        decoded = pc.if_else(lists.is_valid(), decoded, pa.scalar(None, pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and ``ids`` of every document by the ranks in ``path``, without special tokens.

    A null or empty text has no ids. Null ids of documents and repeated rows are kept. Other
    columns are dropped. There is no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_encode, path=path, pattern=pattern), ENCODED_SCHEMA)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``decoded`` bytes beside ``doc_id`` and ``ids``; null for null ids.

    An id outside the vocabulary, or a null one inside a list, is an error.
    """
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(partial(_decode, path=path), DECODED_SCHEMA)
