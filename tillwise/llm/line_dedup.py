"""Line dedup with two Bloom filters, for hashes seen once and hashes seen twice.

A task reads its documents and sets the bits of each line's key in a first filter; where all bits
of a key are set already, it sets them in a second one.  Filters of different tasks are united bit
by bit: a bit is in the second filter if a task has it there, or if two tasks have it in the
first.  So the second filter has every key that occurs in two documents, and some that it only
seems to have.  Bits travel in segments, as places where few are set and as bitmap where many are.

With the second filter at hand the documents are read again: lines whose key is not in it are done.
Only the others are shuffled, as digests: how many documents hold a key is counted exactly, and
confirmed lines go back to their documents.  Documents without a suspected line are never shuffled.

The filter has ``2 ** bits`` places, however large the input; with more keys than that, more lines
are suspected and shuffled, and the result is the same.  Take some ten places per different key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tillwise.llm.common import table
from tillwise.sources.shared import settle, sized

#: Places of a filter, as a power of two: 32 MB.
BITS = 28
#: Bits that a key sets.
HASHES = 2
#: Places of a segment, as a power of two; a place within it takes two bytes.
SEGMENT = 16
#: Lines in this many documents or more go, if their key has this many code points or more.
LEAST_DOCS = 10
LEAST_CHARS = 1
#: Bytes of text handled together.
CHUNK_BYTES = 4 << 20


class Filters:
    """Two filters of ``2 ** bits`` places: set once or more, and set twice or more."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
        self.twice = np.zeros_like(self.once)

    def add(self, places: np.ndarray) -> None:
        """Set places, of which repeated ones count as often as they stand there."""
        for part in _by_turn(places):
            at, bit = _bytes_of(part)
            seen = self.once[at] & bit
            self.twice[at] |= seen
            self.once[at] |= bit

    def unite(self, segment: int, once: bytes, twice: bytes) -> None:
        """Add a segment of other filters."""
        low = (segment << SEGMENT) >> 3
        high = min(low + ((1 << SEGMENT) >> 3), len(self.once))
        one, two = _unpacked(once, high - low), _unpacked(twice, high - low)
        self.twice[low:high] |= two | (self.once[low:high] & one)
        self.once[low:high] |= one

    def segments(self, second_only: bool = False) -> Iterator[tuple[int, bytes, bytes]]:
        size = min((1 << SEGMENT) >> 3, len(self.once))
        used = np.flatnonzero(self.once.reshape(-1, size).any(axis=1))
        for k in used.tolist():
            part = slice(k * size, (k + 1) * size)
            twice = _packed(self.twice[part])
            if not second_only:
                yield k, _packed(self.once[part]), twice
            elif twice:
                yield k, b"", twice


def _by_turn(places: np.ndarray) -> Iterator[np.ndarray]:
    """The different places, and those that stand there twice or more once again."""
    unique, counts = np.unique(places, return_counts=True)
    yield unique
    yield unique[counts > 1]


def _bytes_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted places: the different bytes, and the bits set in each."""
    at = places >> 3
    first = np.flatnonzero(np.diff(at, prepend=-1))
    bit = np.left_shift(1, places & 7).astype(np.uint8)
    return at[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit


def _set_places(bitmap: np.ndarray) -> np.ndarray:
    used = np.flatnonzero(bitmap)
    byte, bit = np.nonzero(np.unpackbits(bitmap[used], bitorder="little").reshape(-1, 8))
    return used[byte] * 8 + bit


def _packed(part: np.ndarray) -> bytes:
    """Places in two bytes each while that is shorter than the bitmap; b"" for no place."""
    on = _set_places(part)
    return on.astype("<u2").tobytes() if 2 * len(on) < len(part) else part.tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    if len(data) == size:
        return np.frombuffer(data, np.uint8)
    out = np.zeros(size, np.uint8)
    at, bit = _bytes_of(np.frombuffer(data, "<u2").astype(np.int64))
    out[at] = bit
    return out


def _places(digests: np.ndarray, bits: int) -> np.ndarray:
    """Rows of places, one for each 16-byte digest."""
    low, high = (digests.view("<u8").reshape(-1, 2)[:, k] for k in (0, 1))
    mask = np.uint64((1 << bits) - 1)
    steps = np.arange(HASHES, dtype=np.uint64)[None, :]
    return ((low[:, None] + steps * (high[:, None] | np.uint64(1))) & mask).astype(np.int64)


class Lines:
    """The lines of a batch of texts, with digests of their keys."""

    def __init__(self, texts: pa.Array, least_chars: int):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        split = pc.split_pattern(texts, "\n")
        lines = split.flatten()
        self.text = np.asarray(pc.list_parent_indices(split)).astype(np.int64)
        lengths = np.asarray(pc.list_value_length(split)).astype(np.int64)
        self.line = np.arange(len(lines)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keys = pc.ascii_lower(pc.ascii_trim_whitespace(lines)).dictionary_encode()
        long = np.asarray(pc.greater_equal(pc.utf8_length(keys.dictionary), least_chars))
        digest = xxhash.xxh3_128_digest
        found = b"".join(digest(k) for k in keys.dictionary.cast(pa.large_binary()).to_pylist())
        self.digests = np.frombuffer(found, "V16")
        self.key = np.asarray(keys.indices).astype(np.int64)
        counted = long[self.key]
        self.text, self.line, self.key = self.text[counted], self.line[counted], self.key[counted]

    def once_a_text(self) -> np.ndarray:
        """Of each text and key, the first place in these arrays."""
        order = np.lexsort((self.line, self.key, self.text))
        t, k = self.text[order], self.key[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        return order[new]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of some megabytes, or of one text, and the place of the first text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > CHUNK_BYTES:
            yield first, texts.slice(first, k - first)
            first, held = k, 0
        held += size
    if first < len(texts):
        yield first, texts.slice(first)


_SEGMENTS = "segment int, once binary, twice binary"


def _suspects_of(docs: DataFrame, bits: int, least_chars: int) -> Broadcast:
    """The second filter over all documents: sorted places while these are fewer, or a bitmap."""

    def emit(filters: Filters, second_only: bool) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in filters.segments(second_only):
            rows.append(row)
            if len(rows) == 256:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def _rows(rows: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.binary(), pa.binary())
        columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["segment", "once", "twice"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for batch in batches:
            for _, texts in _chunks(batch.column("text")):
                lines = Lines(texts, least_chars)
                places = _places(lines.digests, bits)[lines.key[lines.once_a_text()]]
                filters.add(places.ravel())
        yield from emit(filters, False)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for batch in batches:
            for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                filters.unite(segment, once, twice)
        yield from emit(filters, True)

    parts = docs.select("text").mapInArrow(gather, _SEGMENTS)
    # Each task holds its own segments only; rows of a segment stream through it.
    second = parts.repartition("segment").mapInArrow(unite, _SEGMENTS).select("segment", "twice")
    twice = Filters(bits)
    # At most the 2 ** bits places of a filter come to the driver, whatever the input.
    for row in second.collect():
        twice.unite(row["segment"], bytes(row["twice"]), b"")
    on = _set_places(twice.once)
    few = 8 * len(on) < len(twice.once)
    return docs.sparkSession.sparkContext.broadcast(on if few else twice.once)


def _suspected(lines: Lines, twice: np.ndarray, bits: int) -> np.ndarray:
    """Which lines have all their places in the filter, sorted places or a bitmap."""
    places = _places(lines.digests, bits)
    if twice.dtype == np.uint8:
        known = (twice[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
    else:
        spot = np.searchsorted(twice, places)
        known = np.append(twice, -1)[spot] == places
    return known.all(axis=1)[lines.key]


def _name(doc_id, text) -> bytes:
    return xxhash.xxh3_128_digest(f"{'' if doc_id is None else doc_id}\n{text or ''}".encode("utf-8", "surrogatepass"))


def _marks(docs: DataFrame, twice: Broadcast, bits: int, least_chars: int) -> DataFrame:
    """Of each document and batch: its id, rows, suspected lines and their keys."""
    schema = StructType(
        [
            StructField("doc", BinaryType()),
            docs.schema["id"],
            StructField("rows", LongType()),
            StructField("lines", ArrayType(IntegerType())),
            StructField("keys", ArrayType(BinaryType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column("text")):
                ids = batch.column("id").slice(first, len(texts))
                lines = Lines(texts, least_chars)
                hit = np.flatnonzero(_suspected(lines, twice.value, bits))
                found, at = np.unique(lines.text[hit], return_index=True)
                out: dict[bytes, list] = {}
                for text, part in zip(found.tolist(), np.split(hit, at[1:])):
                    name = _name(ids[text].as_py(), texts[text].as_py())
                    if name in out:
                        out[name][1] += 1
                    else:
                        keys = [lines.digests[k].tobytes() for k in lines.key[part].tolist()]
                        out[name] = [text, 1, lines.line[part].tolist(), keys]
                rows = list(out.values())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(out), pa.binary()),
                        ids.take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[3] for r in rows], pa.list_(pa.binary())),
                    ],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def dedup_lines(
    docs: DataFrame,
    least_docs: int = 2,
    keep_first: bool = True,
    least_chars: int = LEAST_CHARS,
    bits: int = BITS,
    id_column: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, and the added ``lines``: ``n``, ``n_dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.  Keys
    of ``least_chars`` code points that stand in ``least_docs`` documents lose all their lines, but
    for the first one if ``keep_first``: that of the least id (null last), then of the document's
    digest, then of the line.  Lines that stay are joined by a line feed; a text that loses all of
    them is ``""``.  Null and empty texts have one empty line, and stay as they are.  Each row
    counts as a document, rows with the same id and text too; those have the same lines dropped.
    An empty table gives an empty one.  Other columns pass through unchanged, whatever their names; ``lines`` and ``text``
    are put in place of columns of that name.
    """
    least_docs, least_chars = max(2, least_docs), max(1, least_chars)
    narrow = docs.select(F.col(id_column).alias("id"), "text")
    twice = _suspects_of(narrow, bits, least_chars)
    marks = settle(_marks(narrow, twice, bits, least_chars))
    one = marks.select("doc", F.explode(F.arrays_zip("lines", "keys")).alias("x"))
    one = one.select("doc", F.col("x.lines").alias("line"), F.col("x.keys").alias("key"))
    # A key counts once a document, at its first line there.
    firsts = marks.select("*", F.explode(F.array_distinct("keys")).alias("key"))
    place = F.get("lines", (F.array_position("keys", F.col("key")) - 1).cast("int"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "doc", place.alias("line"))
    first = [F.min(order).alias("first")] if keep_first else []
    counted = firsts.groupBy("key").agg(F.sum("rows").alias("docs"), *first)
    confirmed = one.join(sized(counted.filter(F.col("docs") >= least_docs).drop("docs")), "key")
    if keep_first:
        stays = (F.col("first.doc") == F.col("doc")) & (F.col("first.line") == F.col("line"))
        confirmed = confirmed.filter(~stays)
    gone = confirmed.groupBy("doc").agg(F.collect_set("line").alias("gone"))
    return _without(docs, id_column, twice, bits, least_chars, sized(gone))


def _cut(text: Column, gone: Column) -> Column:
    """The text without the lines numbered in ``gone``; linear in the number of lines."""

    def kept(lines):
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # One element, so that the text is split once.
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), kept), F.lit(0))


def _without(
    docs: DataFrame, id_column: str, twice: Broadcast, bits: int, least_chars: int, gone: DataFrame
) -> DataFrame:
    """The documents without the lines that ``gone`` lists for them."""
    rows = docs.select(F.struct("*").alias("row"))
    row = rows.schema["row"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("row")
            for first, texts in _chunks(column.field("text")):
                ids = column.field(id_column).slice(first, len(texts))
                lines = Lines(texts, least_chars)
                names: list[bytes | None] = [None] * len(texts)
                for k in np.unique(lines.text[_suspected(lines, twice.value, bits)]).tolist():
                    names[k] = _name(ids[k].as_py(), texts[k].as_py())
                part = [column.slice(first, len(texts)), pa.array(names, pa.binary())]
                yield pa.RecordBatch.from_arrays(part, names=["row", "doc"])

    named = rows.mapInArrow(name, StructType([row, StructField("doc", BinaryType())]))
    text = F.col("row.text")
    none = F.lit(0).cast("bigint").alias("n_dropped")
    straight = named.filter(F.col("doc").isNull()).select("row", text.alias("left"), none)
    held = named.filter(F.col("doc").isNotNull()).join(gone, "doc", "left")
    held = held.select(
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(_cut(text, F.col("gone"))).alias("left"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    lines = F.struct(F.coalesce(n, F.lit(1)).cast("bigint").alias("n"), "n_dropped")
    kept = [
        F.col("left").alias("text") if f.name == "text" else F.col(f"row.`{f.name}`")
        for f in row.dataType.fields
        if f.name != "lines"
    ]
    return straight.unionByName(held).select(*kept, lines.alias("lines"))


def op13_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = dedup_lines(docs, least_docs=LEAST_DOCS, keep_first=False)
    return done.select(
        "doc_id",
        F.col("lines.n").alias("n_lines"),
        F.col("lines.n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP13_SQL = r"""
WITH x AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (
  SELECT r, i, l[i] AS line,
         translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM x)),
gone AS (SELECT k FROM e WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
s AS (
  SELECT e.r, count(*) AS n, count(gone.k) AS d,
         coalesce(string_agg(CASE WHEN gone.k IS NULL THEN line END, chr(10) ORDER BY i), '') AS kept
  FROM e LEFT JOIN gone ON e.k = gone.k GROUP BY e.r)
SELECT x.doc_id, s.n AS n_lines, s.d AS n_dropped, sha256(s.kept) AS kept_sha256 FROM x JOIN s ON x.r = s.r
"""
