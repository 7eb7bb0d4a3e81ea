"""Fill-in-the-middle: each text is cut at two ranks of its units and put together in another order.

Units begin where a predicate over two neighbouring bytes holds. A block of texts is decomposed into chunks that
overlap by that one byte, so each chunk counts the units that begin in it without looking at any other. Prefix sums of the
counts route a cut's rank to the chunk that owns it, and only owning chunks are scanned again for the place.
Nothing is shuffled; per text only the counts of its chunks are held beside the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import _SPACE, column, slices, text_buffer

#: Bytes of a chunk, and of the chunks that one array operation counts.
CHUNK, AT_ONCE = 1 << 12, 1 << 20
# Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of those that have their suffix first.
RATE, SUFFIX_FIRST = 90, 20

Predicate = Callable[[np.ndarray, np.ndarray], np.ndarray]


def characters(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A code point begins at each byte that continues none."""
    return (byte & 0xC0) != 0x80


def words(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A word begins after white space; the white space after a word belongs to it."""
    return _SPACE[before] & ~_SPACE[byte]


def lines(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A line begins after a line feed."""
    return before == 10


class ChunkedUnits:
    """Units of a block of texts (bytes ``data``, n + 1 offsets ``at``), counted by chunk.

    ``total`` has the units of each text. A text's first byte begins a unit whatever the predicate says.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, begins: Predicate = characters, size: int = CHUNK) -> None:
        self.data, self.at, self.begins = data, at, begins
        number = -(-np.diff(at) // size)
        self.first = np.concatenate([[0], np.cumsum(number)])
        text = np.repeat(np.arange(len(number)), number)
        self.start = at[text] + size * (np.arange(len(text)) - self.first[text])
        self.end = np.minimum(self.start + size, at[text + 1])
        self.head = self.start == at[text]
        counts = np.zeros(len(text), dtype=np.int64)
        step = max(1, AT_ONCE // size)
        for i in range(0, len(text), step):
            j = min(len(text), i + step)
            counts[i:j] = np.add.reduceat(self._marks(i, j), self.start[i:j] - self.start[i], dtype=np.int64)
        self.upto = np.concatenate([[0], np.cumsum(counts)])
        self.total = self.upto[self.first[1:]] - self.upto[self.first[:-1]]

    def _marks(self, i: int, j: int) -> np.ndarray:
        """Which bytes of the chunks i to j - 1 begin a unit; the byte before the first chunk is the overlap."""
        s, e = int(self.start[i]), int(self.end[j - 1])
        byte = self.data[s:e]
        before = self.data[s - 1 : e - 1] if s else np.concatenate([np.zeros(1, np.uint8), self.data[: e - 1]])
        marks = self.begins(before, byte)
        marks[self.start[i:j][self.head[i:j]] - s] = True
        return marks

    def places(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Byte at which the unit of that rank (from 0) of a text begins; the text's end for a rank of ``total``."""
        out = self.at[text + 1].copy()
        inside = np.flatnonzero(rank < self.total[text])
        wanted = self.upto[self.first[text[inside]]] + rank[inside]
        owner = np.searchsorted(self.upto, wanted, side="right") - 1
        for k, o, w in zip(inside.tolist(), owner.tolist(), wanted.tolist(), strict=True):
            out[k] = self.start[o] + np.flatnonzero(self._marks(o, o + 1))[w - self.upto[o]]
        return out


def _draws(key: Column, n: int) -> Column:
    """The first groups of eight hex digits of a key's SHA-256, as numbers."""
    digest = F.sha2(key.cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)))


def _rearrange(begins: Predicate, size: int, rate: int, suffix_first: int, kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            data, at = text_buffer(column(batch, "t"))
            units = ChunkedUnits(data, at, begins, size)
            h = column(batch, "h").flatten().to_numpy().reshape(-1, 4)
            bounds = [np.minimum(h[:, 0] % (units.total + 1), h[:, 1] % (units.total + 1)), np.maximum(h[:, 0] % (units.total + 1), h[:, 1] % (units.total + 1))]
            raw = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            plain = np.array([not t or any(m in t for m in marks) for t in raw], dtype=bool) | (h[:, 2] % 100 >= rate)
            cut = np.flatnonzero(~plain)
            places = [units.places(cut, b[cut]) - at[cut] for b in bounds]
            out, form = list(raw), ["plain"] * len(raw)
            for i, a, b in zip(cut.tolist(), places[0].tolist(), places[1].tolist(), strict=True):
                prefix, middle, suffix = marks[0] + raw[i][:a], marks[2] + raw[i][a:b], marks[1] + raw[i][b:]
                form[i] = "spm" if h[i, 3] % 100 < suffix_first else "psm"
                out[i] = b"".join((suffix, prefix, middle) if form[i] == "spm" else (prefix, suffix, middle))
            count = lambda x: pa.array(x, pa.int64(), mask=plain)  # noqa: E731, B023
            own = [batch.column(i) for i in range(kept)]
            made = [pa.array(units.total, pa.int64()), pa.array(form), count(bounds[0]), count(bounds[1] - bounds[0]), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(own + made, [*(f"c{i}" for i in range(kept)), "n", "form", "prefix_units", "middle_units", "output"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Predicate = characters, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: str = "1:", keep: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """A row a text: id, the columns in ``keep``, ``n`` (units), ``form``, ``prefix_units``, ``middle_units`` and ``output``.

    ``form`` is ``psm`` (prefix, suffix, middle) or ``spm`` (suffix first), ``plain`` for a text that stays as it is: an
    empty one, one that holds a mark, and those that the draw leaves out. Draws depend on ``salt`` and the id alone.

    A null text is an empty one, a null id draws as an empty string; rows of one id draw alike; repeated rows are rows of
    their own; an empty table gives none. Extra columns are ignored unless in ``keep``, which must not name a column of the result.
    """
    names = [id_col, *keep]
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(*own, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), _draws(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 4).alias("h"))
    shape = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    made = rows.mapInArrow(_rearrange(unit, chunk, rate, suffix_first, len(names)), f"{shape}, n long, form string, prefix_units long, middle_units long, output string")
    return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "n", "form", "prefix_units", "middle_units", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks stand once each in it, since no text that holds one is cut."""
    piece = lambda s, mark, n: F.split_part(s, F.lit(mark), F.lit(n))
    middle = piece(output, MIDDLE, 2)
    head = piece(output, MIDDLE, 1)
    psm = F.concat(piece(piece(head, SUFFIX, 1), PREFIX, 2), middle, piece(head, SUFFIX, 2))
    spm = F.concat(piece(head, PREFIX, 2), middle, piece(piece(head, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_digests(docs: DataFrame) -> DataFrame:
    """Cuts in code points, with digests of each output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
