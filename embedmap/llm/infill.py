"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME_BYTES`` bytes, each with the units, code points and bytes that
precede it. A cut is given in units (``[A-Za-z]+|[^A-Za-z]``): the cumulative counts name the frame that holds it, and only that
frame is decompressed to find its place. Output and digests stream the frames in order, one at a time, and the output is
stored as frames too, so that a task never needs more than the compressed texts of a batch and one frame.

``framed`` stores texts, ``fill_in_middle`` cuts and reorders them, ``rebuilt`` gives the digest of the text rebuilt from the output and
its form alone, ``unframed`` gives plain text. No shuffle; a lost task is redone from its rows.

Defined cases: a null text is an empty one, which has form ``plain``; a null id draws its cuts as the text ``null``; repeated rows give
repeated results; a very long text, or a letter run longer than a frame, spans frames; a text that holds a marker stays ``plain``; an empty
table gives no rows. Other columns pass through untouched, whatever their names: only the text column is replaced by the new struct
column, and a column of that name in the input gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

FRAME_BYTES = 1 << 16
#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Texts whose frames go into one record batch.
BATCH_BYTES = 8 << 20

_FRAME = pa.struct([("units_before", pa.int64()), ("chars_before", pa.int64()), ("bytes_before", pa.int64()), ("data", pa.binary())])
_FRAMES = pa.list_(_FRAME)
_STORED = pa.struct([("n_units", pa.int64()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("marked", pa.bool_()), ("frames", _FRAMES)])
_DONE = pa.struct([("n_units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("output", _FRAMES)])
_REBUILT = pa.struct([*[f for f in _DONE if f.name != "output"], pa.field("restored_sha256", pa.string())])


def _marks(data: bytes, letter_before: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where units and code points start, and whether the last byte is a letter."""
    b = np.frombuffer(data, np.uint8)
    folded = b | 0x20
    letter = (folded >= 97) & (folded <= 122)
    head = (b & 0xC0) != 0x80
    after = np.concatenate([[letter_before], letter[:-1]])
    return (letter & ~after) | (~letter & head), head, bool(letter[-1]) if len(b) else letter_before


class FrameWriter:
    """Cuts a stream of bytes at code points into frames and counts as it goes."""

    def __init__(self, limit: int):
        self.limit, self.pending, self.letter = limit, b"", False
        self.units = self.chars = self.bytes = 0
        self.frames: list[tuple] = []
        self.zip = zstandard.ZstdCompressor(level=3)

    def write(self, data: bytes) -> None:
        self.pending += data
        while len(self.pending) > self.limit + 3:
            at = self.limit
            while at < len(self.pending) - 1 and at < self.limit + 3 and self.pending[at] & 0xC0 == 0x80:
                at += 1
            self._frame(self.pending[:at])
            self.pending = self.pending[at:]

    def _frame(self, data: bytes) -> None:
        starts, heads, self.letter = _marks(data, self.letter)
        self.frames.append((self.units, self.chars, self.bytes, self.zip.compress(data)))
        self.units += int(np.count_nonzero(starts))
        self.chars += int(np.count_nonzero(heads))
        self.bytes += len(data)

    def close(self) -> list[tuple]:
        if self.pending:
            self._frame(self.pending)
            self.pending = b""
        return self.frames


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    for at in range(0, len(data), size):
        yield data[at:at + size]


class FrameReader:
    """Frames with their cumulative counts; decompresses what is asked for, one frame at a time."""

    def __init__(self, frames: list[dict]):
        self.frames = frames
        self.units = np.array([f["units_before"] for f in frames], np.int64)
        self.bytes = np.array([f["bytes_before"] for f in frames], np.int64)
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        return self.unzip.decompress(self.frames[i]["data"])

    def place(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before a unit that the text has."""
        i = int(np.searchsorted(self.units, unit, "right")) - 1
        data = self.frame(i)
        # A frame that begins inside a letter run counts no start there: the run's unit belongs to the frame before.
        inside = i > 0 and _letter_at_end(self.frame(i - 1)) if data[:1].isalpha() else False
        starts, heads, _ = _marks(data, inside)
        at = int(np.flatnonzero(starts)[unit - self.units[i]])
        return int(self.bytes[i]) + at, self.frames[i]["chars_before"] + int(np.count_nonzero(heads[:at]))

    def stream(self, first: int, last: int) -> Iterator[bytes]:
        """Bytes [first, last) in order."""
        if first >= last:
            return
        i = int(np.searchsorted(self.bytes, first, "right")) - 1
        while i < len(self.frames) and self.bytes[i] < last:
            data, begin = self.frame(i), int(self.bytes[i])
            yield data[max(0, first - begin):last - begin]
            i += 1

    def find(self, mark: bytes, total: int) -> int:
        """Byte where ``mark`` is first found, also across two frames."""
        seen, tail = 0, b""
        for data in self.stream(0, total):
            at = (tail + data).find(mark)
            if at >= 0:
                return seen - len(tail) + at
            seen += len(data)
            tail = (tail + data)[-(len(mark) - 1):]
        return -1


def _letter_at_end(data: bytes) -> bool:
    return data[-1:].isalpha()


def _replaced(df: DataFrame, dropped: str | None, into: str, values: list[Column], make, kind: pa.DataType, cost) -> DataFrame:
    """``df`` with column ``into`` made from ``values`` row by row, in place of column ``dropped``; batches stay below BATCH_BYTES of ``cost``."""
    kept = [c for c in df.columns if c not in (dropped, into)]
    row = F.struct(*[df[f"`{c.replace('`', '``')}`"] for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    source = df.select(row.alias("row"), *[v.alias(f"v{i}") for i, v in enumerate(values)])
    shape = T.StructType([source.schema["row"], T.StructField("made", from_arrow_type(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, made, weight = 0, [], 0
            for i in range(b.num_rows):
                made.append(make(*[c[i].as_py() for c in b.columns[1:]]))
                weight += cost(made[-1])
                if weight > BATCH_BYTES or i == b.num_rows - 1:
                    yield pa.record_batch([b.column(0).slice(start, i + 1 - start), pa.array(made, kind)], names=["row", "made"])
                    start, made, weight = i + 1, [], 0

    out = source.mapInArrow(run, shape)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("made").alias(into))


def _weight(frames: list) -> int:
    return 64 + sum(len(f[3]) if isinstance(f, tuple) else len(f["data"]) for f in frames)


def _as_rows(frames: list[tuple]) -> list[dict]:
    return [dict(zip(("units_before", "chars_before", "bytes_before", "data"), f)) for f in frames]


def framed(docs: DataFrame, text_col: str = "text", into: str = "_frames", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``docs`` with the text replaced by struct ``into``: its unit, code point and byte counts, whether it holds a marker, and its frames."""

    def make(text: bytes | None) -> dict:
        data = bytes(text or b"")
        out = FrameWriter(frame_bytes)
        for piece in pieces(data, frame_bytes):
            out.write(piece)
        frames = out.close()
        return {"n_units": out.units, "n_chars": out.chars, "n_bytes": out.bytes, "marked": any(m in data for m in (PREFIX, SUFFIX, MIDDLE)), "frames": _as_rows(frames)}

    return _replaced(docs, text_col, into, [docs[text_col].cast("binary")], make, _STORED, lambda v: _weight(v["frames"]))


def draws(name: str, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(h[8 * i:8 * i + 8], 16) for i in range(4)]


def fill_in_middle(stored: DataFrame, id_col: str = "doc_id", frames_col: str = "_frames", into: str = "_infill", seed: int = 1,
                   plain_from: int = 90, spm_below: int = 20, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``stored`` (of ``framed``) with the frames replaced by struct ``into``: units, form (plain, psm or spm), code points of prefix and
    middle (null if plain), SHA-256 of the output, and the output as frames. Of 100 texts, those drawn from ``plain_from`` on stay plain;
    of the others, those drawn below ``spm_below`` get the suffix first."""

    def make(name: str | None, text: dict) -> dict:
        h1, h2, h3, h4 = draws("null" if name is None else name, seed)
        n, total, reader = text["n_units"], text["n_bytes"], FrameReader(text["frames"])
        done = {"n_units": n, "form": "plain", "prefix_chars": None, "middle_chars": None}
        if total == 0 or text["marked"] or h3 % 100 >= plain_from:
            digest = hashlib.sha256()
            for data in reader.stream(0, total):
                digest.update(data)
            return done | {"output_sha256": digest.hexdigest(), "output": text["frames"]}
        a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
        (a_byte, a_char), (z_byte, z_char) = [reader.place(k) if k < n else (total, text["n_chars"]) for k in (a, z)]
        parts = {PREFIX: (0, a_byte), SUFFIX: (z_byte, total), MIDDLE: (a_byte, z_byte)}
        spm = h4 % 100 < spm_below
        digest, out = hashlib.sha256(), FrameWriter(frame_bytes)
        for mark in (SUFFIX, PREFIX, MIDDLE) if spm else (PREFIX, SUFFIX, MIDDLE):
            digest.update(mark)
            out.write(mark)
            for data in reader.stream(*parts[mark]):
                digest.update(data)
                out.write(data)
        return done | {"form": "spm" if spm else "psm", "prefix_chars": a_char, "middle_chars": z_char - a_char,
                       "output_sha256": digest.hexdigest(), "output": _as_rows(out.close())}

    return _replaced(stored, frames_col, into, [stored[id_col].cast("string"), stored[frames_col]], make, _DONE, lambda v: _weight(v["output"]))


def original(form: str, frames: list[dict]) -> Iterator[bytes]:
    """The text's bytes in order, from an output and its form alone."""
    reader = FrameReader(frames)
    total = int(reader.bytes[-1]) + len(reader.frame(len(frames) - 1)) if frames else 0
    if form == "plain":
        yield from reader.stream(0, total)
        return
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    at = [reader.find(m, total) for m in marks] + [total]
    spans = {m: (at[i] + len(m), at[i + 1]) for i, m in enumerate(marks)}
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from reader.stream(*spans[m])


def rebuilt(done: DataFrame, done_col: str = "_infill", into: str = "_restored") -> DataFrame:
    """``done`` with struct ``into`` instead of the output: the digest of the text rebuilt from output and form, and the other fields."""

    def make(value: dict) -> dict:
        digest = hashlib.sha256()
        for data in original(value["form"], value["output"]):
            digest.update(data)
        return {k: v for k, v in value.items() if k != "output"} | {"restored_sha256": digest.hexdigest()}

    return _replaced(done, done_col, into, [done[done_col]], make, _REBUILT, lambda v: 200)


def unframed(df: DataFrame, frames: str, into: str) -> DataFrame:
    """``df`` with the plain text of a frames column (a path such as ``_infill.output``) as column ``into``; other columns stay."""

    def make(value: list[dict] | None) -> str | None:
        return None if value is None else b"".join(FrameReader([f]).frame(0) for f in value).decode()

    return _replaced(df, None, into, [F.col(frames)], make, pa.string(), lambda v: len(v or ""))
