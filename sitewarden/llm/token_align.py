"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._shared import lasting, saved, scratch
from .bpe import byte_alphabet

#: Texts are put together in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Alignments of so many distinct runs are kept by a worker; of longer runs than RUN_BYTES none.
MOST_RUNS, RUN_BYTES = 200_000, 64
#: New runs that go through the tokenizers and the kernel side by side.
RUNS_AT_ONCE = 1 << 11
#: Rows of a block's dictionary that travel as one.
DICTIONARY_ROWS = 1 << 14
A_SHIFT = 1 << 32
# How byte-level vocabularies of the tokenizers library split a text unless they say otherwise. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """size bits in bytes, set where a token ends: ends are offsets just after the last byte."""
    bits = np.zeros(size, np.uint8)
    bits[ends - 1] = 1
    return np.packbits(bits)


class Ranked:
    """A packed bitset with the number of set bits before each byte, for rank and select."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits at places below at."""
        byte, bit = at >> 3, at & 7
        last = self.packed[np.minimum(byte, len(self.packed) - 1)]
        mask = (0xFF00 >> bit) & 0xFF  # the high `bit` bits: the first places of the byte
        return self.before[byte] + np.bitwise_count(last & mask.astype(np.uint8))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.packed))


def align(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Two tokenizations of `size` bytes, both ending with the last: (a_cut, b_cut, a_of, b_of).

    Where both bitsets have a bit, tokens of both end: group g has the A tokens from
    a_cut[g] to a_cut[g + 1] and the B tokens from b_cut[g] to b_cut[g + 1]. Where either has
    one, a stretch ends that lies in one A and one B token, and each overlapping pair has
    exactly one such stretch: a_of and b_of are these pairs in the order of the text."""
    a, b = Ranked(bitset(a_ends, size)), Ranked(bitset(b_ends, size))
    shared = Ranked(a.packed & b.packed).select() + 1
    stretches = Ranked(a.packed | b.packed).select()
    start = np.zeros(1, np.int64)
    return np.concatenate([start, a.rank(shared)]), np.concatenate([start, b.rank(shared)]), a.rank(stretches), b.rank(stretches)


#: A run's alignment: A tokens, B tokens, groups, pairs (A id << 32 | B id, int64), groups as text.
Aligned = tuple[int, int, int, bytes, bytes]


class Aligner:
    """Both vocabularies, and the alignments of runs met before.

    Where all white space of space + text is single blanks and line breaks, neither vocabulary
    has a token across the place before one of these, so both tokenizations, the shared cuts and
    the links are those of the runs that begin there. Any other text is aligned as a whole."""

    OTHER = re.compile(r"[^\S \n]|[ \n]{2}| \Z")
    #: Letters and digits up to here are the same in every version of Unicode.
    BEYOND_LATIN = re.compile("[^\x00-\u024f]")

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        a_bytes = {i: bytes(byte_of[c] for c in s) for s, i in spec["model"]["vocab"].items() if all(c in byte_of for c in s)}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(self.a.get_vocab_size())]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.fast = self._ranked(spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer"))
        self.lengths = [np.array([len(x) for x in names]) for names in (self.a_bytes, self.b_bytes)]
        # An id's digits, and what may follow them: within its part of a group, and at the part's end.
        self.digits = [(_strings(n, ","), _strings(n, end)) for n, end in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";"))]
        self.kept: dict[str, Aligned | None] = {}
        self.by_runs = not any(re.search("[^▁]▁|\n", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _ranked(self, model: dict, split: dict, normalizer: dict | None):
        """A's tokenizer by ranks, several times as fast, where merges come in the order of their ids
        and nothing but the usual splitting goes before them; else none."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get(a + b, -1) for a, b in merges]
        usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not normalizer
        if not usual or ids != sorted(ids) or model.get("ignore_merges"):
            return None
        merged = {*ids}
        ranks = {x: i for i, x in enumerate(self.a_bytes) if len(x) == 1 or i in merged}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, text: str) -> list[int]:
        if self.fast and not self.BEYOND_LATIN.search(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def many(self, texts: list[str]) -> Iterator[Aligned | None]:
        """The alignment of each text (space + text for A); None where there is none."""
        kept = self.kept
        if len(kept) > MOST_RUNS:
            kept.clear()
        parts: list[list[str] | None] = []
        new: dict[str, Aligned | None] = {}
        for t in texts:
            if t and self.by_runs and not self.OTHER.search(f" {t}"):
                runs = t.replace("\n", " \n").split(" ")
                new.update(dict.fromkeys(r for r in runs if r not in kept))
                parts.append(runs)
            else:
                parts.append(None)
        names = list(new)
        for at in range(0, len(names), RUNS_AT_ONCE):
            part = names[at : at + RUNS_AT_ONCE]
            new.update(zip(part, self._align([r if r[:1] == "\n" else " " + r for r in part])))
        for t, runs in zip(texts, parts):
            if runs is None:
                yield self._align([" " + t])[0] if t else None
                continue
            found = [kept[r] if r in kept else new[r] for r in runs]
            if None in found:
                yield None
                continue
            n_a, n_b, n_groups, pairs, groups = zip(*found)
            yield sum(n_a), sum(n_b), sum(n_groups), b"".join(pairs), b";".join(groups)
        kept.update((r, x) for r, x in new.items() if len(r) <= RUN_BYTES)

    def _align(self, units: list[str]) -> list[Aligned | None]:
        """The alignments of units, each a blank or line break and what follows, in one pass of
        the kernel: side by side they are one text, which both vocabularies cut between them."""
        text = "".join(units)
        raw = text.encode()
        a = np.array(self._a_ids(text), np.int64)
        # B adds the blank itself; to a line break it is a token of its own, which isn't in the text.
        b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return [None] if len(units) == 1 else [x for u in units for x in self._align([u])]
        b = np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        a_cut, b_cut, a_of, b_of = align(a_ends, b_ends, len(raw))
        pairs = (a[a_of] * A_SHIFT + b[b_of]).tobytes()
        groups, group_ends = self._groups(a, b, a_cut, b_cut)
        # Units end where tokens of both do: each is a run of tokens, of groups and of links.
        ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
        a_at, b_at = (np.concatenate([[0], np.searchsorted(x, ends) + 1]) for x in (a_ends, b_ends))
        g_at = np.searchsorted(a_cut, a_at)
        s_at = np.searchsorted(a_of, a_at) * 8
        t_at = group_ends[g_at].tolist()
        n_a, n_b, n_groups, s_at = np.diff(a_at).tolist(), np.diff(b_at).tolist(), np.diff(g_at).tolist(), s_at.tolist()
        return [(n_a[k], n_b[k], n_groups[k], pairs[s_at[k] : s_at[k + 1]], groups[t_at[k] : t_at[k + 1] - 1]) for k in range(len(units))]

    def _groups(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as text, each with a semicolon after it, and where each begins (and the last ends)."""
        text = np.empty(len(a) + len(b), object)
        sizes = np.empty(len(text), np.int64)
        for ids, cut, other, (inside, last) in ((a, a_cut, b_cut[:-1], self.digits[0]), (b, b_cut, a_cut[1:], self.digits[1])):
            at = np.arange(len(ids)) + np.repeat(other, np.diff(cut))
            text[at] = inside[0][ids]
            text[at[cut[1:] - 1]] = last[0][ids[cut[1:] - 1]]
            sizes[at] = inside[1][ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return "".join(text.tolist()).encode(), ends[a_cut + b_cut]


def _strings(n: int, after: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below n in decimal with a mark after them, and the lengths of that."""
    out = np.array([f"{i}{after}" for i in range(n)], object)
    return out, np.array([len(x) for x in out])


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for a process: what it keeps serves all tasks."""
    return Aligner(a_path, b_path)


_MADE = "block long, id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, groups string, entries array<int>, pairs array<long>, counts array<long>"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of at most so many rows, and no more than one text beyond BLOCK_BYTES."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.slice(at, rows)
            ids, texts, size, start = part.column(0), [], 0, 0
            for k, t in enumerate(part.column(1)):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > BLOCK_BYTES:
                    yield ids.slice(start, k + 1 - start), texts
                    texts, size, start = [], 0, k + 1
            if texts:
                yield ids.slice(start), texts


def _aligned(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    """Rows of two kinds: a document's, with links as places in its block's dictionary, and a
    slice of a block's dictionary, with how many links of the block hold each id pair."""
    kind = dict(docs.dtypes)[id_col]
    schema = _MADE.format(kind=kind)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 33
        ids, rows, size = [], [], 0
        for some, texts in _slices(batches):
            ids.append(some)
            # What a document needs later; the text of its groups is a hash from here on, unless asked for.
            for x in both.many(texts):
                rows.append((*x[:3], hashlib.sha256(x[4]).hexdigest(), x[3], x[4].decode() if with_groups else None) if x else (0, 0, 0, "", b"", "" if with_groups else None))
            size += sum(map(len, texts))
            if size >= BLOCK_BYTES:
                yield from made(block, ids, rows)
                block, ids, rows, size = block + 1, [], [], 0
        if rows:
            yield from made(block, ids, rows)

    def made(block: int, slices: list[pa.Array], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        n, ids = len(rows), pa.concat_arrays(slices)
        n_a, n_b, n_groups, hashes, pairs_of, groups = zip(*rows)
        coded = pa.array(np.frombuffer(b"".join(pairs_of), np.int64)).dictionary_encode()
        pairs, at = coded.dictionary, np.asarray(coded.indices)
        counts = np.bincount(at, minlength=len(pairs)).astype(np.int64)
        ends = np.cumsum([0, *(len(x) // 8 for x in pairs_of)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
        numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)]
        dealt = [pa.array([block] * n, pa.int64()), ids, *numbers, pa.array(hashes, pa.string()), listed, pa.array(groups, pa.string())]
        yield pa.RecordBatch.from_arrays([*dealt, pa.nulls(n, pa.list_(pa.int32())), *[pa.nulls(n, pa.list_(pa.int64()))] * 2], names=names)
        cut = [*range(0, len(pairs), DICTIONARY_ROWS), len(pairs)]
        if m := len(cut) - 1:
            own = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), x) for x in (pa.array(np.arange(len(pairs), dtype=np.int32)), pairs, pa.array(counts))]
            empty = [pa.nulls(m, ids.type), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), *empty, *own], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _with_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents, and what its dictionary's (entry, n, best) say of their links."""
    n, best = (np.zeros(1 + max(right["entry"].to_numpy(), default=0), np.int64) for _ in range(2))
    at = right["entry"].to_numpy()
    n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy()
    listed = pa.chunked_array(left["links"]).combine_chunks()
    ends = np.asarray(listed.offsets, np.int64)
    places = np.asarray(listed.values)[ends[0] : ends[-1]]
    sums = []
    for x in (best, n):
        running = np.concatenate([[0], np.cumsum(x[places])])
        sums.append(pa.array((running[ends[1:] - ends[0]] - running[ends[:-1] - ends[0]]).astype(np.int64)))
    rest = [c for c in left.column_names if c not in ("block", "links")]
    return pa.table([*[left[c] for c in rest], *sums], names=[*rest, "n_best", "count_sum"])


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]), one row for each
    row of docs.

    A is a byte-level BPE file of the tokenizers library, and encodes space + text; B is a
    sentencepiece model, and adds the space itself. Strings of special tokens are plain text.

    - groups: the bytes between places where tokens of both end, as `a1,a2|b1;a3|b2`.
    - links: the pairs of an A and a B token that share a byte. n_links counts them.
    - An id pair's count is the number of links of all documents that hold it. count_sum adds the
      counts of a document's links; n_best counts the links whose count is the largest that
      their B id has in any pair.

    Texts are aligned in one pass, in blocks of BLOCK_BYTES. A block's links are places in a
    dictionary of its id pairs, and only dictionaries are shuffled by pair, summed and looked
    up, so a pair that every text has is one row of each block. Answers return by block.
    The largest counts are a row for each id of B, which its vocabulary bounds: broadcast.

    Null and empty texts, and texts that one vocabulary doesn't give back byte by byte (B
    turns U+2581 into a space) have no tokens: zeros, and '' instead of a hash. Repeated rows
    count each for itself, a null id is an id, other columns aren't read, an empty table
    gives no rows, and a very long text is a block of its own."""
    with scratch(docs.sparkSession):
        made = saved(_aligned(docs, id_col, text_col, a_path, b_path, with_groups), "aligned")
        entries = made.where("pairs is not null").select("block", F.inline(F.arrays_zip("entries", "pairs", "counts"))).toDF("block", "entry", "pair", "n")
        counts = saved(entries.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(A_SHIFT - 1))), "pair-counts")
        highest = counts.groupBy("b").agg(F.max("n").alias("most"))
        counts = counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
        known = entries.select("block", "entry", "pair").join(counts, "pair").select("block", "entry", "n", "best")
        rest = ["id", "n_a", "n_b", "n_groups", "groups_sha256"] + ["groups"] * with_groups
        rows = made.where("pairs is null").select("block", "links", *rest)
        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in rest)
        out = lasting(saved(rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_with_sums, f"{schema}, n_best long, count_sum long"), "alignments"))
    n_links = F.col("n_a") + F.col("n_b") - F.col("n_groups")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", n_links.alias("n_links"), "n_best", "count_sum", *rest[4:])


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n): every pair of ids that shares a byte anywhere in docs, and how often."""
    with scratch(docs.sparkSession):
        made = lasting(saved(_aligned(docs, id_col, text_col, a_path, b_path, False), "aligned"))
    entries = made.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "counts"))).toDF("pair", "n")
    return entries.groupBy("pair").agg(F.sum("n").alias("n")).select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(A_SHIFT - 1)).cast("int").alias("b"), "n")
