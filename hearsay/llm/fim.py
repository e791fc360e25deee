"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME`` units (code points),
each with the number of units before it, so a place is found by bisection and only
its frame is decompressed.  A text is cut into prefix, middle and suffix at two places
drawn from its id.  Whole frames between the cuts go into the output as they are; the
frames that hold a cut are decompressed, divided and packed again.  Digests stream the
frames in order and never hold a whole output; the inverse looks for the marks in the
stream and reads the parts back in their first order.

Draws are the first four groups of eight hexadecimal digits of sha256(``1:id``).  The
form is ``plain`` for an empty text, a text that contains a mark, or by the third draw;
else ``spm`` or ``psm`` by the fourth.  Marks in the middle of a text cannot arise by
cutting, as a mark starts and ends with characters that it has nowhere else.

Defined cases: a null text counts as empty and is plain; a null id draws as ``1:``;
repeated rows are transformed alike; an empty table gives an empty table; columns of
the input stay unless they carry an added name, which is replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FRAME = 4_096          # units of one frame
LEVEL = 1
PLAIN_FROM = 90        # third draw modulo 100 from which a text stays plain
SPM_BELOW = 20         # fourth draw modulo 100 below which the suffix comes first
ADDED = ("n", "form", "prefix_chars", "middle_chars", "frames")

_FRAMES = "array<struct<start: bigint, units: bigint, data: binary>>"
_FRAME_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("units", pa.int64()), ("data", pa.binary())]))


class FrameWriter:
    """Packs pieces of text into frames; whole frames pass through unopened."""

    def __init__(self, frame: int = FRAME, level: int = LEVEL) -> None:
        self.size, self.packer = frame, zstandard.ZstdCompressor(level=level)
        self.reset()

    def reset(self) -> None:
        self.frames: list[dict] = []
        self.total, self.held, self.waiting = 0, 0, []

    def _add(self, units: int, data: bytes) -> None:
        self.frames.append({"start": self.total, "units": units, "data": data})
        self.total += units

    def _flush(self) -> None:
        if self.held:
            self._add(self.held, self.packer.compress("".join(self.waiting).encode("utf-8", "surrogatepass")))
            self.held, self.waiting = 0, []

    def put(self, text: str) -> None:
        at = 0
        while at < len(text):
            piece = text[at:at + self.size - self.held]
            self.waiting.append(piece)
            self.held += len(piece)
            at += len(piece)
            if self.held == self.size:
                self._flush()

    def put_frame(self, units: int, data: bytes) -> None:
        self._flush()
        self._add(units, data)

    def done(self) -> list[dict]:
        self._flush()
        frames = self.frames
        self.reset()
        return frames


class FrameReader:
    """Reads unit ranges of a framed text; counts the frames that were opened."""

    def __init__(self, frames: list[dict]) -> None:
        self.frames, self.opened = frames, 0
        self.starts = [f["start"] for f in frames]
        self.units = frames[-1]["start"] + frames[-1]["units"] if frames else 0
        self.unpacker = zstandard.ZstdDecompressor()

    def _open(self, k: int) -> str:
        self.opened += 1
        return self.unpacker.decompress(self.frames[k]["data"]).decode("utf-8", "surrogatepass")

    def pieces(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """``(frame, from, to)`` of the frames that hold the units ``[a, b)``."""
        k = max(bisect_right(self.starts, a) - 1, 0)
        while a < b:
            start, units = self.starts[k], self.frames[k]["units"]
            upto = min(b - start, units)
            yield k, a - start, upto
            a, k = start + upto, k + 1

    def read(self, a: int, b: int) -> Iterator[str]:
        for k, low, high in self.pieces(a, b):
            yield self._open(k)[low:high]

    def copy(self, a: int, b: int, out: FrameWriter) -> None:
        """Move ``[a, b)`` to a writer; frames that lie inside whole are not opened."""
        for k, low, high in self.pieces(a, b):
            frame = self.frames[k]
            if high - low == frame["units"] == out.size:
                out.put_frame(frame["units"], frame["data"])
            else:
                out.put(self._open(k)[low:high])

    def find(self, mark: str, start: int) -> int:
        """Place of the first ``mark`` at or after ``start``, -1 without one; streams."""
        tail, place = "", start
        for piece in self.read(start, self.units):
            text = tail + piece
            hit = text.find(mark)
            if hit >= 0:
                return place - len(tail) + hit
            place += len(piece)
            tail = text[-(len(mark) - 1):] if len(mark) > 1 else ""
        return -1

    def sha256(self, spans: list[tuple[int, int]]) -> str:
        digest = hashlib.sha256()
        for a, b in spans:
            for piece in self.read(a, b):
                digest.update(piece.encode("utf-8", "surrogatepass"))
        return digest.hexdigest()


def cut_places(units: int, first: int, second: int) -> tuple[int, int]:
    a, b = first % (units + 1), second % (units + 1)
    return min(a, b), max(a, b)


def rearrange(text: FrameReader, form: str, a: int, b: int, out: FrameWriter) -> list[dict]:
    """Frames of the output; ``a`` and ``b`` are the ends of prefix and middle."""
    n = text.units
    if form == "plain":
        text.copy(0, n, out)
        return out.done()
    head, tail = (PREFIX, 0, a), (SUFFIX, b, n)
    for mark, low, high in ([tail, head] if form == "spm" else [head, tail]) + [(MIDDLE, a, b)]:
        out.put(mark)
        text.copy(low, high, out)
    return out.done()


def parts(output: FrameReader, form: str) -> list[tuple[int, int]]:
    """Where prefix, middle and suffix lie in an output, in the order of the text."""
    if form == "plain":
        return [(0, output.units)]
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    a = output.find(first, 0)
    b = output.find(second, a + len(first))
    c = output.find(MIDDLE, b + len(second))
    lead, follow = (a + len(first), b), (b + len(second), c)
    middle = (c + len(MIDDLE), output.units)
    return [follow, middle, lead] if form == "spm" else [lead, middle, follow]


def _transform(frame: int, level: int):
    made = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                      ("frames", _FRAME_TYPE)])

    def transform(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        store, out = FrameWriter(frame, level), FrameWriter(frame, level)
        for texts, forms, firsts, seconds in batches:
            rows = []
            for text, form, first, second in zip(texts, forms.to_pylist(), firsts.to_pylist(), seconds.to_pylist()):
                store.put(text.as_py())
                framed = FrameReader(store.done())
                a, b = cut_places(framed.units, first, second)
                frames = rearrange(framed, form, a, b, out)
                plain = form == "plain"
                rows.append({"n": framed.units, "prefix_chars": None if plain else a,
                             "middle_chars": None if plain else b - a, "frames": frames})
            yield pa.array(rows, made)

    transform.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(transform, f"n bigint, prefix_chars bigint, middle_chars bigint, frames {_FRAMES}")


def _digest():
    made = pa.struct([("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def digest(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for framed, forms in batches:
            rows = []
            for frames, form in zip(framed, forms.to_pylist()):
                output = FrameReader(frames.as_py())
                rows.append({"output_sha256": output.sha256([(0, output.units)]),
                             "restored_sha256": output.sha256(parts(output, form))})
            yield pa.array(rows, made)

    digest.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(digest, "output_sha256 string, restored_sha256 string")


def draws(id_col: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              frame: int = FRAME, level: int = LEVEL) -> DataFrame:
    """Adds ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the output's ``frames``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = draws(id_col)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (F.when((text == "") | marked | (h[2] % 100 >= PLAIN_FROM), "plain")
            .when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm"))
    kept = [F.col(c) for c in docs.columns if c not in ADDED]
    made = (docs.withColumn("_form", form)
            .withColumn("_made", _transform(frame, level)(text, "_form", h[0], h[1])))
    return made.select(*kept, F.col("_form").alias("form"), "_made.n", "_made.prefix_chars",
                       "_made.middle_chars", "_made.frames")


def digests(made: DataFrame) -> DataFrame:
    """Replaces ``frames`` by the digests of the output and of the text rebuilt from it."""
    return (made.withColumn("_d", _digest()("frames", "form"))
            .select(*[c for c in made.columns if c not in ("frames", "output_sha256", "restored_sha256")],
                    "_d.output_sha256", "_d.restored_sha256"))


def as_text(frames: Column) -> Column:
    """The whole output as a string, for sinks that take no frames."""
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for framed in batches:
            readers = [FrameReader(f.as_py()) for f in framed]
            yield pa.array(["".join(r.read(0, r.units)) for r in readers], pa.string())

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(read, "string")(frames)
