"""Fill-in-the-middle: texts cut in three at random units, and their parts put in another order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Rows go through the kernel in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 22

# What each byte of UTF-8 is: 0 the inside of a code point, 1 the first byte of one, 2 an ASCII letter.
_KIND = np.ones(256, np.uint8)
_KIND[0x80:0xC0] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2


def cut_all(raw: np.ndarray, bounds: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """For all texts of one buffer at once: (units, first cut, second cut, prefix characters,
    middle characters), cuts being offsets into raw.

    Text i is raw[bounds[i]:bounds[i + 1]]. A unit is a run of ASCII letters or any other
    code point. A draw is taken modulo the text's units plus one; the smaller is where the
    prefix ends, the larger where the middle does."""
    kind = _KIND[raw]
    begins = kind > 0
    begins[1:] &= (kind[1:] < 2) | (kind[:-1] < 2)  # a letter after a letter goes on with its unit
    begins[bounds[:-1][bounds[:-1] < len(raw)]] = True  # but never over the border of two texts
    wide = np.int64 if len(raw) > np.iinfo(np.int32).max else np.int32
    seen = np.cumsum(begins, dtype=wide)
    before = np.concatenate([np.zeros(1, wide), seen])[bounds].astype(np.int64)
    units = np.diff(before)
    a, b = (d % (units + 1) for d in draws)

    def offset(k: np.ndarray) -> np.ndarray:
        """Where unit k + 1 of each text begins, which is where its first k units end."""
        return np.where(k < units, np.searchsorted(seen, (before[:-1] + k + 1).astype(wide)), bounds[1:])

    first, second = offset(np.minimum(a, b)), offset(np.maximum(a, b))
    points = np.concatenate([np.zeros(1, wide), np.cumsum(kind > 0, dtype=wide)])
    return units, first, second, (points[first] - points[bounds[:-1]]).astype(np.int64), (points[second] - points[first]).astype(np.int64)


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES bytes each, a row at least."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = j


def _put_together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    text = batch.column(1).cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    forms = batch.column(2).to_pylist()
    draws = [np.asarray(batch.column(k)) for k in (3, 4)]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for i, j in _slices(ends):
        part, bounds = raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        units, first, second, n_prefix, n_middle = cut_all(part, bounds, tuple(d[i:j] for d in draws))
        whole, out = part.tobytes(), []
        for form, a, b, c, d in zip(forms[i:j], bounds.tolist(), first.tolist(), second.tolist(), bounds[1:].tolist()):
            if form == "psm":
                out.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
            elif form == "spm":
                out.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
            else:
                out.append(whole[a:d])
        plain = pa.array([f == "plain" for f in forms[i:j]], pa.bool_())
        chars = [pa.array(x, pa.int64(), mask=np.asarray(plain)) for x in (n_prefix, n_middle)]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(units), batch.column(2).slice(i, j - i), *chars, pa.array(out, pa.binary()).cast(pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row for each row of docs.

    Draws h1 to h4 are the first four 8-digit groups of the SHA-256 of `seed:id`. A text is
    plain where it is empty or holds a mark, or where h3 % 100 >= plain_from; else `spm` where
    h4 % 100 < spm_below, `psm` otherwise. Cuts come from cut_all(); output is

        psm    <P> prefix <S> suffix <M> middle
        spm    <S> suffix <P> prefix <M> middle
        plain  the text

    One pass in Arrow batches without a shuffle: what a row becomes follows from its id and
    text alone. Null text is empty text, with n 0; characters are null where plain. A null id
    draws as the empty string, repeated rows become equal rows, other columns aren't read,
    an empty table gives no rows, and a very long text is a slice of its own."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _put_together(batch)

    kind = dict(docs.dtypes)[id_col]
    made = rows.select("id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2")).mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(form: str = "form", output: str = "output"):
    """The text that an output was made of, as a column: the marks say where its parts are. No
    part holds a mark, and none can arise where a part meets one, so three splits are enough."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    found = F.col(output)
    for name, at in order.items():
        found = F.when(F.col(form) == name, F.concat(*[parts[k] for k in at])).otherwise(found)
    return found
