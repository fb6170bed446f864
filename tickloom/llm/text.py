"""Words, hashes and cached tokenization used inside tasks."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import regex
import xxhash
from tokenizers import Tokenizer

_MASK = (1 << 64) - 1

# A run of white space and the run of other characters behind it. No token of a byte-level
# vocabulary crosses from a non-blank to a blank, so such chunks encode one by one. U+001C to
# U+001F count as blanks in `re` but not in the tokenizers.
_CHUNKS = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+").findall
_UNEVEN = re.compile(r"\s(?= )|\s\Z").search


def ascii_words(text: str | None) -> list[bytes]:
    """UTF-8 words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; none for a null text."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hash per word, remembered for a bounded number of words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self._most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of a splitmix generator)."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words.

    With fewer words the whole sequence is the only shingle; without words there is none.
    """
    if len(hashes) == 0:
        return hashes
    width = min(width, len(hashes))
    count = len(hashes) - width + 1
    rolled = np.zeros(count, np.uint64)
    for step in range(width):
        rolled = mix(rolled ^ hashes[step : step + count], step)
    return np.unique(rolled)


class _Uneven(Exception):
    """A text in which blanks meet, or which ends in one, so that its words aren't its chunks."""


class _Words(dict):
    """Encoded words, each with a space before it; a new one is learned when it is first asked for."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self._learn = learn

    def __missing__(self, word: str) -> bytes:
        return self._learn(word)


class ChunkCache:
    """Whole texts encoded chunk by chunk, each distinct chunk once while it is remembered.

    ``matches`` splits a chunk into what ``encode_match`` encodes. ``most`` words are remembered,
    and an eighth as many other chunks and matches.
    """

    def __init__(self, encode_match: Callable[[str], bytes], matches: Callable[[str], list[str]], most: int):
        self._encode_match, self._matches, self._most = encode_match, matches, most
        self._words = _Words(self._learn)
        self._chunks: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        known = self._words.get(chunk[1:]) if chunk[:1] == " " else None
        known = known if known is not None else self._chunks.get(chunk)
        if known is None:
            if len(self._chunks) >= self._most // 8:
                self._chunks.clear()
            known = self._chunks[chunk] = b"".join(map(self._match, self._matches(chunk)))
        return known

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._chunk, _CHUNKS(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Encoded texts; a null text is empty."""
        return [self._text(text) if text else b"" for text in texts]

    def _text(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if first[-1:].isspace():
            return self._pieces(text)
        try:
            return self._pieces(first) + b"".join(map(self._words.__getitem__, words))
        except _Uneven:
            return self._pieces(text)

    def _learn(self, word: str) -> bytes:
        """A word's code, remembered if it is a chunk by itself."""
        if not word or word[-1].isspace():
            raise _Uneven
        if not (word.isalpha() or word.split() == [word]):
            return self._pieces(" " + word)
        if len(self._words) >= self._most:
            self._words.clear()
        known = self._words[word] = self._word(word)
        return known

    def _word(self, word: str) -> bytes:
        """A word with a space before it; letters and a last mark are split as the pattern would."""
        if word.isalpha():
            return self._encode_match(" " + word)
        stem = word[:-1]
        if stem.isalpha():
            known = self._words.get(stem)
            if known is None:
                known = self._words[stem] = self._encode_match(" " + stem)
            return known + self._match(word[-1])
        return b"".join(map(self._match, self._matches(" " + word)))

    def _match(self, match: str) -> bytes:
        known = self._marks.get(match)
        if known is None:
            if len(self._marks) >= self._most // 8:
                self._marks.clear()
            known = self._marks[match] = self._encode_match(match)
        return known


def batches_of(texts: list, size: int = 200) -> Iterator[tuple[int, list]]:
    """Consecutive parts of a list and where they begin."""
    for at in range(0, len(texts), size):
        yield at, texts[at : at + size]


def byte_symbols() -> dict[int, str]:
    """Character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from U+0100 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkEncoder(ChunkCache):
    """Exact token ids of whole texts by the `tokenizers` library, as packed integers.

    For byte-level vocabularies with the common pattern. The pattern's matches go to the
    library's model one by one. Added tokens, such as <|endoftext|>, are found in a text as the
    library finds them by default, and give their ids.
    """

    def __init__(self, path: str, most: int = 700_000):
        super().__init__(self._new_match, regex.compile(public_tokenizers.PATTERN).findall, most)
        tokenizer = Tokenizer.from_file(path)
        self._tokenize = tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._symbols = byte_symbols()
        self._blank = self._symbols[32]
        added = tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path} has added tokens that are not matched literally")
        self._added = {t.content: self.pack([i]) for i, t in added.items()}
        by_length = sorted(self._added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, by_length)) + ")").split if added else None
        probe = "It's a\t\tprobe,  12é  "
        if [t for m in self._matches(probe) for t in self._ids(m)] != tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} does not split texts by the common byte-level pattern")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not any(a in text for a in self._added for text in texts if text):
            return super().encode(texts)
        parts = [self._split(text) if text else [text] for text in texts]
        plain = iter(super().encode([part for split in parts for part in split[::2]]))
        return [b"".join(self._added[part] if i % 2 else next(plain) for i, part in enumerate(split)) for split in parts]

    def pack(self, ids) -> bytes:
        return array(self._code, ids).tobytes()

    def _ids(self, match: str) -> list[int]:
        if match.isascii() and match[:1] == " " and match[1:].isalpha():
            spelled = self._blank + match[1:]  # letters stand for themselves
        else:
            spelled = match.encode("utf-8").decode("latin-1").translate(self._symbols)
        return [t.id for t in self._tokenize(spelled)]

    def _new_match(self, match: str) -> bytes:
        return array(self._code, self._ids(match)).tobytes()


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker, so that later tasks find the words of earlier ones."""
    return ChunkEncoder(path)
