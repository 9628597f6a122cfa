"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIM = 2048
GRAM = 3
BITS = 8
SYMBOLS = 1 << BITS
SEED = 20240
UNDETERMINED = "und"
#: Cosines of unrelated texts scatter around 0 with a deviation of 1 / sqrt(DIM).
NOISE = DIM**-0.5
#: Texts with fewer n-grams are too short to be rejected for their score.
SHORT = 30
#: Texts that are bundled at once, whatever their length: each has DIM numbers, several times over.
MOST_TEXTS = 512
#: Languages that can be learned. Each is DIM numbers in every worker and on the driver.
MOST_LANGUAGES = 1000
#: A document's bundle of length one as whole numbers: sums don't depend on their order.
UNIT = 1 << 20


@functools.cache
def symbol_table() -> np.ndarray:
    """The symbol of every code point after lower-casing: 0 for anything that is no letter, 1 to
    26 for a-z, and one of the other 229, by a hash, for any other letter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 9) % (SYMBOLS - 27)
    return out


@functools.cache
def letter_vectors() -> np.ndarray:
    """The symbols' random vectors of +1 and -1, once as they are and rotated by one and by two
    places (GRAM x symbols x DIM). An n-gram's vector is the product of its letters'
    vectors, rotated by their distance from its end: rotations make the order count."""
    letters = (np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * 2 - 1).astype(np.float32)
    return np.stack([np.roll(letters, k, axis=1) for k in range(GRAM)])


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The vectors of n-grams (codes x DIM)."""
    rotated, out = letter_vectors(), None
    for k in range(GRAM):
        v = rotated[k][codes >> (BITS * k) & (SYMBOLS - 1)]
        out = v if out is None else out * v
    return out


def bundles(rows: np.ndarray, codes: np.ndarray, n: np.ndarray, texts: int, most_grams: int = 1024) -> np.ndarray:
    """The sums of all n-gram vectors of each of `texts` texts, n times each (texts x DIM). All
    sums are whole numbers, so they don't depend on what else is in the batch."""
    out = np.zeros((texts, DIM), np.float32)
    distinct, at = np.unique(codes, return_inverse=True)
    order = np.argsort(at, kind="stable")
    rows, at, n = rows[order], at[order], n[order]
    for start in range(0, len(distinct), most_grams):
        part = slice(*np.searchsorted(at, [start, start + most_grams]))
        own = distinct[start : start + most_grams]
        counts = np.zeros((texts, len(own)), np.float32)
        counts[rows[part], at[part] - start] = n[part]
        out += counts @ gram_vectors(own)
    return out


class GramCounter:
    """Counts the n-grams of texts, many texts at a time."""

    def __init__(self):
        self.symbols = symbol_table()

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, count) of every distinct n-gram of every text, ordered by row, and
        whether each text has a letter. A run of non-letters is one gap, and a text has
        one at either end."""
        wide = [(t or b"").decode("utf-8", "replace").encode("utf-32-le") for t in texts]
        points = np.frombuffer(b"\0\0\0\0".join(wide) + b"\0\0\0\0", np.uint32)
        ends = np.cumsum([len(w) // 4 + 1 for w in wide])
        symbols = self.symbols[points]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        kept = symbols[keep].astype(np.int64)
        rows = np.repeat(np.arange(len(wide)), np.diff(ends, prepend=0))[keep]
        has = np.bincount(rows, kept > 0, len(wide)) > 0
        # A text's last gap is also the one before the next text: n-grams with a gap in the middle are none.
        padded = np.concatenate(([0] * (GRAM - 2 + 1), kept, [0] * (GRAM - 2)))
        codes = np.zeros(len(padded) - GRAM + 1, np.int64)
        for k in range(GRAM):
            codes = codes << BITS | padded[k : len(codes) + k]
        middle = padded[1 : len(codes) + 1] != 0
        codes, rows = codes[middle], rows[np.minimum(np.flatnonzero(middle), len(rows) - 1)]
        key = np.sort(rows << (BITS * GRAM) | codes)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        n = np.diff(np.r_[first, len(key)])
        return key[first] >> (BITS * GRAM), key[first] & (SYMBOLS**GRAM - 1), n, has


def parts_of(texts: list[bytes | None], most_bytes: int = 1 << 19, most_texts: int = MOST_TEXTS) -> Iterator[slice]:
    """Slices of texts of about so many bytes and no more than so many texts; a longer text is a
    slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and (size + n > most_bytes or i - start >= most_texts):
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text has the remainder 2 modulo 4 (a null id has not)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in code point order, prototypes): a language's prototype is the sum of its
    documents' bundles, each scaled to length one, scaled to length one itself.

    All rows with a language count. Every partition makes one sum per language, and the
    sums, of whole numbers, are added by language: one vector of DIM numbers for each
    language reaches the driver. More than MOST_LANGUAGES distinct values are an error, in
    the first partition or else before anything is collected: such a column holds no
    languages. Without rows there is no language."""
    too_many = f"{lang_col} has more than {MOST_LANGUAGES} distinct values"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, sums = GramCounter(), {}
        for batch in batches:
            texts, langs = _texts(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for part in parts_of(texts):
                rows, codes, n, _ = counter.counts(texts[part])
                own = langs[part]
                found = bundles(rows, codes, n, len(own)).astype(np.float64)
                length = np.sqrt((found * found).sum(axis=1, keepdims=True))
                units = np.rint(found / np.maximum(length, 1) * UNIT).astype(np.int64)
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + units[own == lang].sum(axis=0)
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(too_many)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], names=["lang", "k", "v"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    summed = rows.mapInArrow(run, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    got = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("vs")).limit(MOST_LANGUAGES + 1).collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(too_many)
    langs = sorted(r["lang"] for r in got)
    by = {r["lang"]: np.array([x["v"] for x in r["vs"]], np.float64) for r in got}
    protos = [by[x] / max(np.linalg.norm(by[x]), 1e-9) for x in langs]
    return langs, np.stack(protos) if protos else np.zeros((0, DIM))


class Identifier:
    """Compares texts with prototypes: what it holds is DIM numbers for each language."""

    def __init__(self, langs: list[str], protos: np.ndarray):
        self.langs, self.protos = langs, protos

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's language, the cosine of its bundle with that language's prototype, and its
        number of n-grams."""
        counter = GramCounter()
        pred, scores, grams = [], [np.zeros(0)], [np.zeros(0, np.int64)]
        for part in parts_of(texts):
            rows, codes, n, ok = counter.counts(texts[part])
            ok &= bool(self.langs)
            cosine = np.zeros((len(ok), max(1, len(self.langs))))
            if len(rows) and self.langs:
                found = bundles(rows, codes, n, len(ok)).astype(np.float64)
                cosine = found @ self.protos.T / np.maximum(1, np.sqrt((found * found).sum(axis=1, keepdims=True)))
            best = cosine.argmax(axis=1)
            pred += [self.langs[k] if good else UNDETERMINED for k, good in zip(best, ok)]
            scores.append(np.where(ok, cosine.max(axis=1).clip(0, 1), 0.0))
            grams.append(np.bincount(rows, n, len(ok)).astype(np.int64))
        return pred, np.concatenate(scores), np.concatenate(grams)


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the language whose prototype has the largest cosine with the
    text's bundle, and that cosine, not below 0.

    `und` with score 0 if the text is null or has no letter, or no language was learned.
    Ties go to the language that is first in code point order. Null ids and repeated rows
    stay as they are."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(Identifier(langs, protos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, _ = shared.value(_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learn from the rows of docs that have a language and
    aren't held out, then predict every row from its text alone. An empty table gives no
    rows; extra columns are ignored."""
    langs, protos = learn(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    out = predict(docs, langs, protos, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 3 * NOISE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose language is identified: not `und`,
    and a score that a text in none of the learned languages doesn't reach by chance (texts
    of fewer than SHORT n-grams are not judged by it). Null ids, repeated rows and further
    columns stay as they are; an empty table gives no rows."""
    langs, protos = learn(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Identifier(langs, protos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, grams = shared.value(_texts(batch.column(at)))
            yield batch.filter(pa.array((np.array(pred, object) != UNDETERMINED) & ((score >= least_score) | (grams < SHORT))))

    return docs.mapInArrow(run, docs.schema)
