"""Token ids in bit-packed binary files: writing, random access and reading back."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ._shared import new_path, saved, shuffle_partitions

MAGIC = b"TPACK001"
BLOCK = 1 << 16
_TAIL = struct.Struct("<QQQIB3x8s")  # index offset, ids, documents, ids in a block, bits, magic


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold every id below vocabulary_size."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as consecutive big-endian fields of `bits` bits, the last byte filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(each.ravel()).tobytes()


def unpack(raw: bytes, count: int, bits: int, skip: int = 0) -> np.ndarray:
    """`count` ids of packed bytes, after the first `skip`."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}")[skip : skip + count].astype("<u4")
    each = np.unpackbits(np.frombuffer(raw, np.uint8))[skip * bits : (skip + count) * bits].reshape(-1, bits)
    full = np.zeros((len(each), 32), np.uint8)
    full[:, 32 - bits :] = each
    return np.packbits(full, axis=1).view(">u4").ravel().astype("<u4")


#: Schemes of Hadoop's file systems, and what Arrow calls them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "gcs": "gs"}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path, and the path in it.

    Arrow's own: local files, s3(a), abfs(s) and wasb(s), gs, and hdfs where the workers
    have libhdfs. They take credentials from the environment, not from Hadoop's settings."""
    scheme, mark, rest = uri.partition("://")
    if mark and scheme != "file":
        try:
            return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
            raise ValueError(f"token files can't be written to {uri}: name a folder in a file system that Arrow knows") from e
    if uri.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pafs.LocalFileSystem(), uri


def write_shard(uri: str, documents: Iterable[tuple[int | None, np.ndarray]], bits: int) -> tuple[int, int]:
    """Write (doc_id, ids) in order to one file; the numbers of documents and ids.

    File: blocks of BLOCK ids, packed; then the index: doc_ids (int64), whether they are
    null (uint8), each document's end in ids (uint64), each block's offset in bytes (uint64);
    then a tail of fixed size. The file appears under its name only when complete, so a
    task that is lost or repeated leaves no half of one."""
    system, path = file_system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    keys, ends, offsets, total, at = [], [], [], 0, 0
    with system.open_output_stream(draft) as out:
        waiting, held = [], 0

        def flush(last: bool) -> None:
            nonlocal waiting, held, at
            ids = np.concatenate(waiting) if waiting else np.empty(0, "<u4")
            whole = len(ids) if last else len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                offsets.append(at)
                raw = pack(ids[k : min(k + BLOCK, whole)], bits)
                out.write(raw)
                at += len(raw)
            waiting, held = [ids[whole:]], len(ids) - whole

        for key, ids in documents:
            keys.append(key)
            total += len(ids)
            ends.append(total)
            waiting.append(ids)
            held += len(ids)
            if held >= 4 * BLOCK:
                flush(False)
        flush(True)
        out.write(np.array([k or 0 for k in keys], "<i8").tobytes())
        out.write(np.array([k is None for k in keys], np.uint8).tobytes())
        out.write(np.array(ends, "<u8").tobytes())
        out.write(np.array(offsets, "<u8").tobytes())
        out.write(_TAIL.pack(at, total, len(keys), BLOCK, bits, MAGIC))
    system.move(draft, path)
    return len(keys), total


class Shard:
    """A written file, opened for random access. Only its index is held in memory."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        index, self.total, n, self.block, self.bits, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        raw = self.file.read_at(size - _TAIL.size - index, index)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
        self.ends = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.offsets = np.append(np.frombuffer(raw, "<u8", -1, 17 * n).astype(np.int64), index)

    def __len__(self) -> int:
        return len(self.ends)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The file's ids start to stop; only the blocks that hold them are read."""
        if stop <= start:
            return np.empty(0, "<u4")
        a, b = start // self.block, (stop - 1) // self.block
        raw = self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        return unpack(raw, stop - start, self.bits, start - a * self.block)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self, run_ids: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of all documents, read in runs of about run_ids ids."""
        i = 0
        while i < len(self):
            first = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, first + run_ids, "right")))
            ids = self.ids(first, int(self.ends[j - 1]))
            for k in range(i, j):
                a = int(self.ends[k - 1]) if k else 0
                yield None if self.null[k] else int(self.doc_ids[k]), a, ids[a - first : int(self.ends[k]) - first]
            i = j


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library, with results kept by word.

    Where every white-space character of a text stands alone and is a blank or a line
    break, the usual splitting pattern never joins anything across it, so the text's
    ids are those of its runs that begin there: each distinct run is encoded by the
    library once, and one that ends with a full stop or comma after a letter together with the
    run without it. Any other text, one that names a special token, and any text of a
    vocabulary that splits otherwise, goes to the library as a whole."""

    SPACES = ("\t", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
    DOUBLES = ("  ", "\n\n", " \n", "\n ")
    OTHER = re.compile(r"[^\S \n]")
    STOPS = (".", ",")
    #: Letters up to here are the same in every version of Unicode.
    LATIN = "\u024f"
    #: What stands before a text's first run among the kept ones: no run holds it.
    FIRST = "\r"
    #: Texts are encoded in parts of about so many characters; longer runs than RUN_CHARS aren't kept.
    PART_CHARS, RUN_CHARS = 1 << 22, 64

    def __init__(self, path: str, most: int = 1_000_000):
        """most: the runs kept, in two generations. Before the newer one has more than half of them, the
        older one goes, but for what was met again since. (One part's runs are kept in any case.)"""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.kept, self.older = Tokenizer.from_file(path), most, {}, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        split = self.tokenizer.pre_tokenizer and json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        usual = split and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.splits = usual and not (self.tokenizer.normalizer or self.tokenizer.truncation or self.tokenizer.padding)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id's bytes begin with a blank or a line break, which a byte-level vocabulary writes so.
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[:1] in ("\u0120", "\u010a")]] = True
        self.joins = not any(re.search(r"\s", x) for x in self.special)
        self.stops = dict(zip(self.STOPS, map(np.ndarray.tobytes, self._ids([*self.STOPS]))))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def in_runs(self, text: str) -> bool:
        """Whether the text's white space is single blanks and line breaks only, and it names
        no special token."""
        if any(d in text for d in self.DOUBLES) or any(x in text for x in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not self.OTHER.search(text)
        return not any(c in text for c in self.SPACES)

    def _runs(self, names: list[str], part: int = 200) -> Iterator[bytes]:
        """The ids of runs that begin with a blank or line break, have no other white space and are
        more than that. Many of them are one text for the library: a run begins where an id
        does whose bytes begin so."""
        for k in range(0, len(names), part):
            some = names[k : k + part]
            ids = self._ids(["".join(some)])[0] if self.joins else np.empty(0, "<u4")
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(some) or at[0]:
                yield from (x.tobytes() for x in self._ids(some))
                continue
            raw, ends = ids.tobytes(), [*(at[1:] * 4).tolist(), len(ids) * 4]
            yield from (raw[a:b] for a, b in zip([0, *ends], ends))

    def _meet(self, runs: list[str]) -> list[bytes]:
        """The ids of each of these distinct runs. What isn't kept is encoded, and kept unless it is long."""
        kept, older = self.kept, self.older
        found = list(map(kept.get, runs))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = [runs[k] for k in missing]
        made = {x: older[x] for x in new if x in older}
        rest = [x for x in new if x not in made]
        alone = [x for x in rest if x[:1] == self.FIRST or x in ("", "\n")]
        made.update(zip(alone, map(np.ndarray.tobytes, self._ids([x[1:] if x[:1] == self.FIRST else x or " " for x in alone]))))
        rest = [x for x in rest if x not in made] if alone else rest
        stems = {x: x[:-1] for x in rest if x[-1] in self.stops and x[-2:-1].isalpha() and x[-2] <= self.LATIN}
        names = [x for x in rest if x not in stems] + [x for x in stems.values() if x not in kept and x not in older]
        names = list(dict.fromkeys(names))
        made.update(zip(names, self._runs([x if x[0] == "\n" else " " + x for x in names])))
        made.update((x, (made.get(stem) or kept.get(stem) or older[stem]) + self.stops[x[-1]]) for x, stem in stems.items())
        if len(kept) + len(new) > self.most // 2:
            self.older, self.kept = kept, {}
        self.kept.update((x, made[x]) for x in new if len(x) <= self.RUN_CHARS)
        for k, x in zip(missing, new):
            found[k] = made[x]
        return found

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > self.PART_CHARS:
                yield from self._part(some)
                some, size = [], 0
        yield from self._part(some)

    def _part(self, texts: list[str]) -> Iterator[bytes]:
        """Arrow finds the distinct runs, and lays out their ids in the order of the texts."""
        split = [self.splits and self.in_runs(t) for t in texts]
        # A run's blank is left off; one that begins with a line break keeps it.
        marked = [self.FIRST + t.replace("\n", " \n") for t, s in zip(texts, split) if s]
        runs = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        coded = runs.flatten().dictionary_encode()
        found = self._meet(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[runs.offsets.to_numpy()].tolist() if marked else []
        places = zip(ends, ends[1:])
        for t, s in zip(texts, split):
            if s:
                a, b = next(places)
                yield data[a:b].to_pybytes() if b > a else b""
            else:
                yield self._ids([t])[0].tobytes()


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, one for a process: what it keeps serves all tasks."""
    return ByteBpe(path)


def write_tokens(docs: DataFrame, vocabulary: str, uri: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every text (null: empty), append end_id, and write the ids in ascending id
    order to files under `uri`, one for each range of ids. Returns the manifest, one row for
    each file in order: (shard, uri, n_docs, n_tokens, start), start being the ids before it.

    One range shuffle of the texts; rows with a null id come first, repeated ids in order of
    their text. The manifest grows with the number of files only. A uri that the workers
    can't write to fails here, before any work (see file_system()). Further columns aren't
    read, a very long text is encoded whole, and of an empty table nothing is written but files
    without documents."""
    spark = docs.sparkSession
    file_system(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        end = np.array([end_id], "<u4").tobytes()

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1)
                some = (t or "" for at in range(0, len(keys), 64) for t in texts.slice(at, 64).to_pylist())
                for key, raw in zip(keys, bpe.encode_many(some)):
                    yield key, np.frombuffer(raw + end, "<u4")

        shard = TaskContext.get().partitionId()
        name = f"{uri}/shard-{shard:06d}.tpack"
        n, total = write_shard(name, documents(), bits_for(max(bpe.size, end_id + 1)))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["shard", "uri", "n_docs", "n_tokens"])

    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    manifest = saved(ranged.mapInArrow(run, "shard int, uri string, n_docs long, n_tokens long"), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document in the files of a manifest:
    start counts the ids of all documents before it, ids_crc32 is the unsigned CRC-32 of its
    ids as little-endian 32-bit integers. Each file is read by one task, in runs."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []

                def made() -> pa.RecordBatch:
                    cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                    return pa.RecordBatch.from_arrays(cols + [pa.array([r[4] for r in rows], pa.list_(pa.int32()))] * with_ids, names=names)

                for key, at, ids in Shard(uri).documents():
                    rows.append((key, start + at, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None))
                    if len(rows) >= (200 if with_ids else 10_000):
                        yield made()
                        rows = []
                yield made()

    files = manifest.select("uri", "start").repartition(max(shuffle_partitions(spark), 1))
    return files.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, uri: str | None = None, **options) -> DataFrame:
    """read_tokens() of what write_tokens() wrote, to a new folder of the shared one unless named."""
    return read_tokens(write_tokens(docs, vocabulary, uri or new_path(docs.sparkSession, "tokens"), **options))
