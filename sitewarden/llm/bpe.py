"""BPE encoding and decoding with the vocabulary files of public tokenizers."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# The word vocabulary drops everything that this pattern doesn't match. Fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Unicode's White_Space; str.split() would also split at U+001C to U+001F. Fixed value.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    visible Latin-1 characters stand for themselves, the rest are numbered from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in visible else spare))
        spare += b not in visible
    return out


def merge_symbols(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges to a symbol list, lowest rank first and leftmost among equals.

    ranks: left << 32 | right -> rank; merged: rank -> symbol. The symbols are a doubly
    linked list over two index arrays, and a heap holds rank << 32 | position of
    neighbours. A popped entry is stale, and skipped, when the pair that now starts at
    its position has another rank or is gone."""
    n = len(symbols)
    rank_of = ranks.get
    heap = []
    for i in range(n - 1):
        r = rank_of(symbols[i] << 32 | symbols[i + 1])
        if r is not None:
            heap.append(r << 32 | i)
    if not heap:
        return symbols
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
            continue
        symbols[i] = s = merged[rank]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            r = rank_of(s << 32 | symbols[k])
            if r is not None:
                heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0:
            r = rank_of(symbols[h] << 32 | s)
            if r is not None:
                heappush(heap, r << 32 | h)
    return [s for s in symbols if s >= 0]


class _Cache(dict):
    """Results of `make` by argument, at most `most` of them: in two generations, of which the older
    goes when the younger is full. What is asked for again moves to the younger."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """Encoder and decoder of a word-end BPE vocabulary in tokenizers' JSON format.

    A text is normalised (NFC, lower case, white space dropped) and split into words by
    WORD_PATTERN (the tokenizers library's normalizer and splitter do this for words that
    aren't ASCII), each word's UTF-8 bytes become symbols, the last one with the word-end
    suffix, and merges are applied to each word. Special tokens in a text are single ids.
    """

    def __init__(self, path: str, cached: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks, self.merged = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        alphabet = byte_alphabet()
        self.inner = [vocab.get(c) for c in alphabet]
        self.last = [vocab.get(c + suffix) for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.words = regex.compile(WORD_PATTERN)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = re.compile(f"[^{WHITE_SPACE}]+")
        # What is a letter or a digit, and its lower case, depends on the version of Unicode: the library has the say.
        rules = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalize, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.words_cache, self.cache = _Cache(self._word, cached), _Cache(self._chunk, cached)

    def _word(self, word: str) -> bytes:
        raw, inner = word.encode(), self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        return array("I", merge_symbols(symbols, self.ranks, self.merged)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, as little-endian 32-bit integers."""
        if chunk.isascii():
            norm = chunk.lower()
            return self.words_cache[norm] if norm.isalpha() else b"".join(map(self.words_cache.__getitem__, self.words.findall(norm)))
        norm = self.normalize(chunk)
        return b"".join([self.words_cache[norm[a:b]] for _, (a, b) in self.split(norm)])

    def _plain(self, text: str) -> bytes:
        exotic = any(c in text for c in "\x1c\x1d\x1e\x1f")
        chunks = self.chunks.findall(text) if exotic else text.split()
        return b"".join(map(self.cache.__getitem__, chunks))

    def encode(self, text: str) -> np.ndarray:
        """The text's ids (unsigned 32-bit)."""
        if self.specials is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self.specials.split(text)
        ids = [np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)]
        return np.frombuffer(b"".join(ids), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The ids' vocabulary strings, one after the other with a blank between them: the
        vocabulary names no decoder, so strings keep their byte alphabet and word ends."""
        strings = self.strings
        return " ".join([strings[i] for i in ids.tolist()])


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """The encoder of a vocabulary file, one for a process: its caches serve all tasks."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) of every row, in one pass
    without a shuffle. The hash of ids is over little-endian 32-bit integers.

    Null text counts as empty: no ids, the hashes of nothing. Null ids and repeated rows
    stay as they are; extra columns are ignored; an empty table gives no rows. A worker
    keeps the ids of at most 300,000 distinct words and as many chunks between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                text = bpe.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                if with_decoded:
                    decoded.append(text)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            if with_decoded:
                cols, names = [*cols, pa.array(decoded, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
