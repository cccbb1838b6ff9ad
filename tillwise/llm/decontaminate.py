"""Benchmark decontamination by Wu-Manber search for many strings at once.

Strings are windows of ten words of a benchmark item, written with one space before, between and
after the words.  Let m be the least length of a string and B the block length.  The shift table
says, for each hash of a block, how far a window of m bytes that ends in this block may move
without passing the end of a string's first m bytes; a hash that no string holds allows
m - B + 1.  Where the shift is 0, the bucket of the block names the strings to compare byte by
byte.  Many positions of a batch of documents are moved along together with numpy; a position
only looks back at the m bytes before it, so any cut of the text is exact.

Benchmark items are the stated query set: they are read in blocks of at most ``block_bytes``,
each with its own tables, so the memory of a task does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tillwise.llm.common import table

WINDOW = 10
#: Benchmark text per set of tables, in bytes.
BLOCK_BYTES = 8 << 20
LANES = 8192
HASH_BITS = 20
BATCH_BYTES = 8 << 20

#: ASCII letters in lower case and digits stay, other ASCII becomes a space, the rest stays.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Strings:
    """Shift table, buckets and strings of one set with the same least length."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.least = m = min(map(len, strings))
        self.block = b = max(1, min(8, m // 2))
        self.shift = np.full(1 << HASH_BITS, m - b + 1, np.int32)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        heads = np.frombuffer(b"".join(s[:m] for s in strings), np.uint8).reshape(-1, m)
        for end in range(b, m + 1):
            packed = np.zeros((len(strings), 8), np.uint8)
            packed[:, :b] = heads[:, end - b : end]
            keys = self._hash(packed.view("<u8")[:, 0])
            np.minimum.at(self.shift, keys, m - end)
        self.bucket: dict[bytes, list[int]] = {}
        for i, s in enumerate(strings):
            self.bucket.setdefault(s[:m], []).append(i)

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks & self.mask) * _ODD) >> np.uint64(64 - HASH_BITS)

    def find(self, buffer: bytes) -> list[tuple[int, int]]:
        """(start, string) of every occurrence in ``buffer``."""
        m, b, n = self.least, self.block, len(buffer)
        if n < m:
            return []
        padded = buffer + bytes(8)
        blocks = np.ndarray((n,), "<u8", padded, 0, (1,))
        lanes = max(1, min(LANES, n // 64))
        cuts = np.linspace(m, n + 1, lanes + 1).astype(np.int64)
        at, stop = cuts[:-1].copy(), cuts[1:].copy()
        live = at < stop
        at, stop = at[live], stop[live]
        found = []
        while len(at):
            step = self.shift[self._hash(blocks[at - b])]
            zero = step == 0
            if zero.any():
                found.append(at[zero])
                step = step + zero
            at = at + step
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        out = []
        for end in np.concatenate(found).tolist() if found else ():
            start = end - m
            for i in self.bucket.get(buffer[start:end], ()):
                if buffer.startswith(self.strings[i], start):
                    out.append((start, i))
        return out


class Patterns:
    """The windows of some items: search tables, and which items each window belongs to."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        owners: dict[bytes, set[int]] = {}
        lengths: dict[bytes, int] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                string = b" " + b" ".join(words[i : i + size]) + b" "
                owners.setdefault(string, set()).add(item)
                lengths[string] = size
        strings = sorted(owners)
        self.owners = [sorted(owners[s] - {None}) for s in strings]
        self.sizes = [lengths[s] for s in strings]
        self.sets = []
        # Short strings would shorten every shift: they get tables of their own.
        for low, high in ((1, 8), (8, 16), (16, 32), (32, 1 << 62)):
            ids = [i for i, s in enumerate(strings) if low <= len(s) < high]
            if ids:
                self.sets.append((ids, Strings([strings[i] for i in ids])))

    def search(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
        """Per text: number of words, hit word spans (start, end), items with a window in it."""
        out: list = []
        pending: list[tuple[int, bytes]] = []
        size = 0
        for text in texts:
            words = words_of(text)
            out.append((len(words), [], set()))
            line = b" " + b" ".join(words) + b" " if words else b""
            pending.append((len(out) - 1, line))
            size += len(line)
            if size >= BATCH_BYTES:
                self._search(pending, out)
                pending, size = [], 0
        self._search(pending, out)
        return [(n, _merged(spans), sorted(items)) for n, spans, items in out]

    def _search(self, pending: list[tuple[int, bytes]], out: list) -> None:
        # A zero byte keeps occurrences inside one document.
        buffer = b"\0".join(line for _, line in pending)
        starts = np.cumsum([0, *[len(line) + 1 for _, line in pending]])
        for ids, strings in self.sets:
            hits = np.array(strings.find(buffer), np.int64).reshape(-1, 2)
            places = np.searchsorted(starts, hits[:, 0], "right") - 1
            for k in np.unique(places):
                where, line = pending[k]
                here = hits[places == k]
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                firsts = np.searchsorted(spaces, here[:, 0] - starts[k])
                for first, i in zip(firsts.tolist(), here[:, 1].tolist()):
                    out[where][1].append((first, first + self.sizes[ids[i]]))
                    out[where][2].update(self.owners[ids[i]])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with the added column ``found``: ``n_words``, ``spans`` of hit words, ``items``.

    Texts are lower-cased (A-Z only) and cut into words of letters, digits and characters beyond
    ASCII.  An item with fewer words than the window is one window; an item without words
    matches nothing; null texts have no words; the words of an item whose id is null are hit,
    but it is not listed.  Repeated documents are searched each for themselves; repeated items
    count once.  Spans are maximal, ``end`` is exclusive.  All columns of ``docs`` pass through
    unchanged, whatever their names; with an empty benchmark nothing is found.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in _item_blocks(benchmark, block_bytes)]
    kept = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    schema = StructType(
        [
            StructField("row", kept.schema["row"].dataType),
            StructField("n_words", LongType()),
            StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
            StructField("items", ArrayType(LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Patterns(blocks[0].value, window) if len(blocks) == 1 else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = (only or Patterns(b.value, window) for b in blocks)
            merged = None
            for patterns in parts:
                found = patterns.search(texts)
                merged = found if merged is None else [
                    (n, _merged([*s, *t]), sorted({*i, *j}))
                    for (n, s, i), (_, t, j) in zip(merged, found)
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([n for n, _, _ in merged], pa.int64()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in s] for _, s, _ in merged],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                    pa.array([i for _, _, i in merged], pa.list_(pa.int64())),
                ],
                names=["row", "n_words", "spans", "items"],
            )

    found = kept.mapInArrow(run, schema)
    return found.select("row.*", F.struct("n_words", "spans", "items").alias("found"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window, columns unchanged."""
    found = occurrences(docs.select(F.struct("*").alias("all"), "text"), benchmark, **options)
    return found.filter(F.size("found.spans") == 0).select("all.*")


def op7_wu_manber(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = occurrences(docs, table(spark, folder, "benchmark"))
    hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("found.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (
  SELECT item_id, list_filter(string_split(regexp_replace(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
q AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT q.doc_id, q.i, q.k, p.item_id FROM q JOIN p ON q.g = p.g AND q.k = p.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
