"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import string
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import quoted, text_or_empty, word_blocks

# What Unicode 16 does not call a letter or number, but later versions do
# (first and last code point). Such signs are treated like any other sign, whatever
# version this Python's libraries know.
LATER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LATER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_LETTERS) + "]")
NO_LETTER = "\ue000"
# Capitals that Unicode 15 does not know, and their small letters.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7DC: 0x19B}
NEW_CAPITALS |= {c: c + 1 for c in (0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}
NEW_CAPITALS |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}

# Words, and pre-tokens, kept with their ids in each Python worker: so many in either generation.
CACHE_WORDS = 150_000
IDS_AT_ONCE = 1 << 16
# ASCII signs that are neither letters nor digits: at a word's end they are one pre-token.
SIGNS_TEXT = string.punctuation
SIGNS = SIGNS_TEXT.encode()
ROWS_AT_ONCE = 256
NO_PAIR = 1 << 62

ENCODED = (T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()))
DIGESTS = (
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class Merges:
    """Ranks and results of the pairs that may be merged, sorted for lookup by whole arrays."""

    def __init__(self, ranked: list[tuple[int, int, int]]) -> None:
        left, right, merged = (np.array(column, np.int64) for column in zip(*ranked))
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], NO_PAIR), np.append(order, 0)
        self.merged = merged

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """rank << 32 | place for pairs that may be merged, NO_PAIR for others and where a symbol is -1."""
        key = np.where(right < 0, -1, left << 20 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at] << 32 | place, NO_PAIR)


def merge_all(words: list[bytes], inner: np.ndarray, last: np.ndarray, merges: Merges) -> list[bytes]:
    """The ids of each word of one byte or more, as 32-bit numbers, once no pair is left to merge.

    A byte starts as its symbol in ``inner``, a word's last byte as that in ``last``; merged is
    always the leftmost pair of lowest rank. Every word has a segment tree. A leaf holds rank
    and place of the pair that starts at a symbol, a node the lower of its two, so the root is
    the next merge. A merge changes three leaves at most, each in a number of steps that is
    logarithmic in the word's length. Words of similar length are worked on together, one
    merge of each at a time.
    """
    made = list(words)
    by_width: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_width.setdefault(1 << max(1, (len(word) - 1).bit_length()), []).append(i)
    for width, group in by_width.items():
        step = max(1, (1 << 21) // width)
        for start in range(0, len(group), step):
            part = group[start : start + step]
            for i, ids in zip(part, _merge_together([words[i] for i in part], width, inner, last, merges)):
                made[i] = ids
    return made


def _merge_together(
    words: list[bytes], width: int, inner: np.ndarray, last: np.ndarray, merges: Merges
) -> Iterator[bytes]:
    """Merge words of at most ``width`` symbols; row r of the flat arrays is word r."""
    n, end = len(words), width
    places = np.arange(width)
    lengths = np.array([len(word) for word in words])
    letters = np.frombuffer(b"".join(words), np.uint8)
    symbols = np.full((n, width + 1), -1, np.int64)
    symbols[:, :-1][places < lengths[:, None]] = inner[letters]
    symbols[np.arange(n), lengths - 1] = last[letters[np.cumsum(lengths) - 1]]
    tree = np.full((n, 2 * width), NO_PAIR, np.int64)
    tree[:, width:] = merges.leaves(symbols[:, :-1], symbols[:, 1:], places)
    size = width
    while size > 1:
        tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
        size //= 2
    after = np.tile(np.arange(1, width + 2), (n, 1))
    after[:, width] = end
    before = np.tile(np.arange(-1, width), (n, 1))
    tree, symbols, after, before = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
    rows = np.arange(n)
    while True:
        root = tree[rows * (2 * width) + 1]
        going = root != NO_PAIR
        rows, root = rows[going], root[going]
        if not len(rows):
            break
        own, top = rows * (width + 1), rows * (2 * width)
        at = root & 0xFFFFFFFF
        gone = after[own + at]
        following = after[own + gone]
        symbols[own + at] = merges.merged[root >> 32]
        symbols[own + gone] = -1
        after[own + at] = following
        before[own + following] = at
        prior = before[own + at]
        first = prior < 0
        prior = np.where(first, at, prior)
        value = merges.leaves(symbols[own + at], symbols[own + following], at)
        earlier = merges.leaves(symbols[own + prior], symbols[own + at], prior)
        tree[top + width + gone] = NO_PAIR
        tree[top + width + at] = value
        tree[top + width + prior] = np.where(first, value, earlier)
        nodes = np.stack([gone, at, prior]) + width >> 1
        while nodes[0, 0]:
            spot = top + nodes
            tree[spot] = np.minimum(tree[spot + nodes], tree[spot + nodes + 1])
            nodes >>= 1
    left = symbols.reshape(n, -1)
    there = left >= 0
    flat, ends = left[there].astype(np.int32).tobytes(), 4 * np.cumsum(there.sum(axis=1))
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield flat[start:end]


class Known:
    """Values by key in two generations: what was used lately outlives the renewal of a full store."""

    def __init__(self) -> None:
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def unknown(self, wanted: set[bytes]) -> list[bytes]:
        """The keys without a value; the others of ``wanted`` are ``recent`` until the next call."""
        if len(self.recent) + len(wanted) > CACHE_WORDS:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        new = []
        for key in wanted.difference(recent):
            if key in older:
                recent[key] = older[key]
            else:
                new.append(key)
        return new


@dataclass
class Vocabulary:
    """A tokenizer file: pieces, merges, the pattern of pre-tokens and special tokens."""

    piece_ids: dict[str, int]
    pieces: dict[int, str]
    merges: Merges
    pattern: Any
    special: Any
    special_tokens: Sequence[str]
    suffix: str

    def __post_init__(self) -> None:
        letters = byte_letters()
        self.inner = np.array([self.piece_ids[x] for x in letters])
        self.last = np.array([self.piece_ids[x + self.suffix] for x in letters])
        self.special_ids = {t.encode(): array("i", [self.piece_ids[t]]).tobytes() for t in self.special_tokens}
        self.special_starts = {t[0] for t in self.special_tokens}
        # Ids as 32-bit numbers: of pre-tokens, and of words between blanks.
        self.tokens, self.words = Known(), Known()

    def _pre_tokens(self, word: bytes) -> list[bytes]:
        """Normalised pre-tokens of a word without blanks; special tokens stay as they are.

        NFC and lower case are taken letter by letter: a final sigma has no form of its own.
        """
        core = word.rstrip(SIGNS)
        if core.isalpha():
            return [word.lower()] if len(core) == len(word) else [core.lower(), word[len(core) :]]
        text = word.decode("utf-8", "replace")
        parts = [text]
        if not self.special_starts.isdisjoint(text) and self.special.search(text):
            parts = self.special.split(text)
        found: list[str] = []
        for part in parts:
            if len(parts) > 1 and self.special.fullmatch(part):
                found.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").translate(NEW_CAPITALS)
            part = part.lower()
            letters = part.rstrip(SIGNS_TEXT)
            if letters.isalpha():
                found += [letters, part[len(letters) :]]
            elif LATER.search(part):
                spans = [m.span() for m in self.pattern.finditer(LATER.sub(NO_LETTER, part))]
                found += [part[a:b] for a, b in spans]
            else:
                found += self.pattern.findall(part)
        return [t.encode() for t in found if t]

    def learn(self, words: list[bytes]) -> None:
        """Encode words that are not stored yet, all new pre-tokens together."""
        split = [self._pre_tokens(w) for w in words]
        new = self.tokens.unknown({t for tokens in split for t in tokens})
        plain = [t for t in new if t not in self.special_ids]
        known, stored = self.tokens.recent, self.words.recent
        known.update(zip(plain, merge_all(plain, self.inner, self.last, self.merges)))
        known.update(self.special_ids)
        for word, tokens in zip(words, split):
            stored[word] = known[tokens[0]] if len(tokens) == 1 else b"".join([known[t] for t in tokens])

    def decode(self, ids: Iterable[int]) -> str:
        """The pieces joined by blanks, as the file names no decoder."""
        return " ".join(map(self.pieces.__getitem__, ids))

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the decimal ids joined by one space, and of the decoding."""
        numbers, pieces = hashlib.sha256(), hashlib.sha256()
        for start in range(0, len(ids), IDS_AT_ONCE):
            part = ids[start : start + IDS_AT_ONCE].tolist()
            blank = " " if start else ""
            numbers.update((blank + " ".join(map(str, part))).encode())
            pieces.update((blank + self.decode(part)).encode())
        return numbers.hexdigest(), pieces.hexdigest()

    def encode(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The ids of each whole text."""
        for group in _in_groups(texts):
            ids: list[list[bytes]] = [[] for _ in group]
            for block in _blocks(group):
                wanted: set[bytes] = set()
                for _, words in block:
                    wanted.update(words)
                self.learn(self.words.unknown(wanted))
                ids_of = self.words.recent.__getitem__
                for i, words in block:
                    ids[i].append(b"".join(map(ids_of, words)))
            for parts in ids:
                yield np.frombuffer(b"".join(parts), np.int32)


def _in_groups(texts: Iterable[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in runs of about ``size`` bytes."""
    group, total = [], 0
    for text in texts:
        group.append(text)
        total += len(text)
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


def _blocks(group: list[bytes], most: int = 100_000) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The words of a group of texts, by text, in blocks of not many more than ``most`` words."""
    block, total = [], 0
    for i, text in enumerate(group):
        for words in word_blocks(text, most):
            if block and total + len(words) > most:
                yield block
                block, total = [], 0
            block.append((i, words))
            total += len(words)
    if block:
        yield block


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file of the kind "BPE with word ends"; once per Python worker.

    The file must name what this module implements: NFC, blanks folded, lower case, a
    split pattern, byte-level letters, merges with a word-end suffix, no decoder.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = {"normalizers": spec["normalizer"] or {}, "pretokenizers": spec["pre_tokenizer"] or {}}
    kinds = [[part["type"] for part in step.get(name, [])] for name, step in steps.items()]
    if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or spec["decoder"]:
        raise ValueError(f"{path} is not a vocabulary of this kind")
    model, splitter = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    ids = dict(model["vocab"])
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = [t["content"] for t in spec["added_tokens"]]
    ids |= {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Vocabulary(
        ids,
        {i: piece for piece, i in ids.items()},
        Merges([(ids[left], ids[right], ids[left + right]) for left, right in merges]),
        regex.compile(splitter[0]["pattern"]["Regex"]),
        regex.compile("(" + "|".join(map(regex.escape, special)) + ")"),
        special,
        model["end_of_word_suffix"],
    )


def _ids_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate([*rows, np.empty(0, np.int32)]))


def encode_documents(
    docs: DataFrame, vocabulary_path: str, text: str = "text", columns: Sequence[str] | None = None
) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with ``ids`` and ``decoded``; columns of those names are replaced.

    Null and empty texts have no ids and decode to empty text. Special tokens written
    in a text become their ids; nothing is added, cut or padded. The vocabulary file
    is opened by each Python worker, so its path must exist on every executor. Results
    leave the worker a few hundred texts at a time.
    """

    def made(known: Vocabulary, rows: Iterator[np.ndarray]) -> list[pa.Array]:
        held = list(rows)
        return [_ids_array(held), pa.array([known.decode(ids.tolist()) for ids in held], pa.string())]

    return _per_text(docs, vocabulary_path, text, columns, ENCODED, made)


def encode_digests(
    docs: DataFrame, vocabulary_path: str, text: str = "text", columns: Sequence[str] | None = None
) -> DataFrame:
    """As ``encode_documents``, but ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead of ids and decoding.

    The digests are those of the decimal ids joined by one space and of the decoding in
    UTF-8. Ids and decodings are made and hashed in the Python workers and never leave them.
    """

    def made(known: Vocabulary, rows: Iterator[np.ndarray]) -> list[pa.Array]:
        found = [(len(ids), *known.digests(ids)) for ids in rows]
        return [pa.array(column, t) for column, t in zip(zip(*found), (pa.int64(), pa.string(), pa.string()))]

    return _per_text(docs, vocabulary_path, text, columns, DIGESTS, made)


def _per_text(
    docs: DataFrame,
    vocabulary_path: str,
    text: str,
    columns: Sequence[str] | None,
    fields: tuple[T.StructField, ...],
    made: Callable[[Vocabulary, Iterator[np.ndarray]], list[pa.Array]],
) -> DataFrame:
    """``columns`` of ``docs`` and what ``made`` makes of the ids of some hundred texts at a time."""
    names = [f.name for f in fields]
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in names]
    # Plain names on the way: mapInArrow takes a dot in a name for a field.
    plain = [f"c{i}" for i in range(len(kept))]
    carried = [T.StructField(name, docs.schema[c].dataType) for name, c in zip(plain, kept)]
    schema = T.StructType([*carried, *fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(vocabulary_path)
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                ids = known.encode(t.as_py() for t in part.column(len(kept)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made(known, ids)], schema.names)

    rows = docs.select(*[F.col(quoted(c)) for c in kept], text_or_empty(text).cast("binary"))
    return rows.toDF(*plain, "text").mapInArrow(encode, schema).toDF(*kept, *names)


def decoded(ids: str, vocabulary_path: str) -> Column:
    """The decoding of a column of ids; null for null, an unknown id is an error."""

    @F.arrow_udf(T.StringType())
    def decode(rows: pa.Array) -> pa.Array:
        known = vocabulary(vocabulary_path)
        return pa.array([None if r is None else known.decode(r) for r in rows.to_pylist()], pa.string())

    return decode(ids)
