"""The byte-level BPE vocabulary: what splits a text into words, and what merges a word's symbols."""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import regex
import tiktoken
from tokenizers.pre_tokenizers import ByteLevel

# The pattern by which byte-level BPE splits texts into words, and the byte alphabet of its vocabulary file.
# White space is spelled out, as the class \s of the regex module differs from that of the tokenizers library.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_LIBRARY = ByteLevel(add_prefix_space=False, use_regex=True)


def words(text: str) -> list[str]:
    """The words of a text. With code points newer than Python's Unicode tables, the library itself splits it."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in _LIBRARY.pre_tokenize_str(text)]
    return WORDS.findall(text)


def byte_alphabet() -> dict[str, int]:
    """Each byte's character in the vocabulary file: printable Latin-1 stands for itself, the rest count up from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """``merged`` maps a pair of symbols, as left << 32 | right, to its rank; symbols are bytes, then 256 + rank."""

    merged: dict[int, int]
    ids: list[int]  #: the vocabulary id of each symbol
    pieces: dict[int, bytes]  #: the bytes of each id
    special: dict[str, int]  #: strings that stand for one id wherever they occur in a text

    @classmethod
    def parse(cls, source: str) -> Vocabulary:
        """``source``: the JSON of a byte-level BPE tokenizer file."""
        whole = json.loads(source)
        model, alphabet = whole["model"], byte_alphabet()
        vocab = model["vocab"]
        symbols = [""] * 256
        for shown, b in alphabet.items():
            symbols[b] = shown
        number = {s: k for k, s in enumerate(symbols)}
        merged = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merged[number[left] << 32 | number[right]] = rank
            number[left + right] = 256 + rank
            symbols.append(left + right)
        pieces = {i: bytes(map(alphabet.__getitem__, s)) for s, i in vocab.items()}
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        pieces |= {i: s.encode() for s, i in special.items()}
        return cls(merged, [vocab[s] for s in symbols], pieces, special)

    def merges(self, symbols: list[int]) -> int:
        """Merges ``symbols`` in place, always the adjacent pair of lowest rank and of those the leftmost.

        Live symbols form a linked list, and candidate pairs a heap. Returns the number of merges made; a merged-away
        symbol becomes -1.
        """
        n, rank_of = len(symbols), self.merged.get
        if n < 2:
            return 0
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        after, before, made = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n or rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue  # one of the pair was merged with another symbol meanwhile
            symbols[i], symbols[j], made = 256 + rank, -1, made + 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return made

    def count(self, word: bytes) -> int:
        symbols = list(word)
        return len(symbols) - self.merges(symbols)

    def encode(self, word: bytes) -> tuple[int, ...]:
        symbols = list(word)
        self.merges(symbols)
        ids = self.ids
        return tuple(ids[s] for s in symbols if s >= 0)

    def encoder(self):
        """A function from a word's bytes to its ids: the native one wherever ids of merged symbols grow with their rank."""
        merged = self.ids[256:]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return lambda word: list(self.encode(word))
        ranks = {self.pieces[i]: i for i in self.ids}
        native = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        direct = getattr(getattr(native, "_core_bpe", None), "encode_single_piece", None)
        return direct or (lambda word: native.encode_ordinary(word.decode()))

    def row_encoder(self):
        """A function from words in a row, each with a space before it and none inside, to the ids of all."""
        merged = self.ids[256:]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return lambda row: np.array([i for word in row.split(b" ")[1:] for i in self.encode(b" " + word)], np.uint32)
        ranks = {self.pieces[i]: i for i in self.ids}
        native = tiktoken.Encoding("rows", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        return lambda row: native.encode_to_numpy(row.decode(), disallowed_special=())

    def splitter(self) -> regex.Pattern | None:
        """Matches the special strings, each in a group, so that ``split`` keeps them."""
        if not self.special:
            return None
        longest_first = sorted(self.special, key=lambda s: (-len(s), s))
        return regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")


class Memo(dict):
    """word -> ``of(word)``, computed once while it is remembered.

    Bounded: after ``most`` new words the table becomes the former one, and words only live on if they are used again.
    Words longer than ``longest`` characters are not remembered.
    """

    def __init__(self, of, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.of, self.most, self.longest, self.former = of, most, longest, {}

    def __missing__(self, word):
        value = self.former.get(word)
        if value is None:
            value = self.of(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.former = dict(self)
                self.clear()
            self[word] = value
        return value


def places(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of stretches in a row, each from ``start`` on."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


_VOCABULARIES: dict[int, Vocabulary] = {}


def loaded(source: str) -> Vocabulary:
    """The vocabulary of a tokenizer file's text, parsed once in a process."""
    if (key := hash(source)) not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary.parse(source)
    return _VOCABULARIES[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def source_of(path: str | None) -> str:
    """The text of the tokenizer file, read on the driver; its size is that of a vocabulary, whatever the corpus."""
    with open(path or default_path(), encoding="utf-8") as file:
        return file.read()
