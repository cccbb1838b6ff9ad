"""Importance resampling towards the word distribution of a target text, over hashed n-grams.

Features are runs of 1 to ``longest`` words; a feature's bucket is the crc32 of its bytes by the
number of buckets.  A crc32 can be carried on: the state after one word and a space continues
into the next word.  So frequent things are looked up instead of computed: the exact counts of
all words give the head, whose states are broadcast; for features of two words or more, exact
counts of pairs of head words give the frequent pairs, broadcast with their states.  All others,
the tail, are computed from their bytes.  Both ways give the same bucket, so the head's size
affects speed only.

Each text is cut into words for the head, then once more for its buckets, which are stored.
Totals per bucket come from those, the gains of the buckets from the totals of both sides, and
the weight of a document is the mean gain of its features.  A document's score adds a Gumbel
variable from a hash of its id, so the highest scores are a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tillwise.functions.ranking import number_rows
from tillwise.llm.common import table
from tillwise.llm.decontaminate import FOLD
from tillwise.sources.shared import settle

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PER_CENT = 10
SEED = "2024"
#: The head: so many words, of so many bytes each at most, and so many pairs of them.
HEAD_WORDS = 50_000
HEAD_BYTES = 32
HEAD_PAIRS = 100_000
#: Bytes of text handled together.
CHUNK_BYTES = 4 << 20
#: Features whose gains are summed together.
SUMMED = 1 << 20


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Some texts at a time as bytes, and the place of the first."""
    first, out, size = 0, [], 0
    for k in range(len(texts)):
        out.append((texts[k].as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(out[-1])
        if size >= CHUNK_BYTES or k == len(texts) - 1:
            yield first, out
            first, out, size = k + 1, [], 0


class Cut:
    """Words of some texts as numbers of distinct words."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts).translate(FOLD) + b" ", np.uint8)
        letter = raw != 32
        edges = np.flatnonzero(np.diff(letter, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        buffers = [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(raw[letter])]
        flat = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        self.words = flat.dictionary
        self.ids = np.asarray(flat.indices).astype(np.int64)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.text = np.searchsorted(begins, starts, "right") - 1
        self.lengths = np.bincount(self.text, minlength=len(texts)).astype(np.int64)

    def starts(self, size: int) -> np.ndarray:
        """Places at which ``size`` words of one text begin."""
        last = np.arange(max(0, len(self.ids) - size + 1))
        return last[self.text[last] == self.text[last + size - 1]]


class Head:
    """Frequent words and pairs with the crc32 after each."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.words = pa.array(words, pa.large_binary())
        self.states = np.array([zlib.crc32(w) for w in words], np.int64)
        place = {w: k for k, w in enumerate(words)}
        keys = [place[a] * len(words) + place[b] for a, b in pairs]
        states = [zlib.crc32(b" " + b, int(self.states[place[a]])) for a, b in pairs]
        order = np.argsort(np.array(keys, np.int64))
        self.pairs = np.array(keys, np.int64)[order]
        self.pair_states = np.array(states, np.int64)[order]

    def place_of(self, words: pa.Array) -> np.ndarray:
        """Place of each word in the head, -1 for the tail."""
        return np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)

    def buckets(self, cut: Cut, longest: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per size of feature: the text and the bucket of each feature."""
        place = self.place_of(cut.words)
        states = np.zeros(len(cut.words), np.int64)
        in_head = place >= 0
        states[in_head] = self.states[place[in_head]]
        states[~in_head] = [zlib.crc32(w) for w in cut.words.filter(pa.array(~in_head)).to_pylist()]
        out = [(cut.text, (states % buckets)[cut.ids])]
        names = cut.words.to_pylist() if longest > 1 else []
        # A feature is the one before, by its number, and one word more.
        number, at, value = cut.ids, np.arange(len(cut.ids)), states
        number_at = np.zeros(len(cut.ids), np.int64)
        for size in range(2, longest + 1):
            number_at[at] = number
            at = cut.starts(size)
            word = cut.ids[at + size - 1]
            grams, number = np.unique(number_at[at] * max(1, len(names)) + word, return_inverse=True)
            before, last = np.divmod(grams, max(1, len(names)))
            found = np.zeros(len(grams), bool)
            following = np.zeros(len(grams), np.int64)
            if size == 2 and len(self.pairs):
                both = in_head[before] & in_head[last]
                key = place[before] * len(self.words) + place[last]
                spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                found = both & (self.pairs[spot] == key)
                following[found] = self.pair_states[spot[found]]
            for k in np.flatnonzero(~found).tolist():
                following[k] = zlib.crc32(b" " + names[last[k]], int(value[before[k]]))
            value = following
            out.append((cut.text[at], (value % buckets)[number]))
        return out


def _counted(frames: list[DataFrame], of) -> DataFrame:
    """Exact counts over all texts of what ``of(cut)`` lists with counts, as binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _chunks(batch.column("text")):
                first, second, counts = of(Cut(texts))
                columns = [first.cast(pa.binary()), second.cast(pa.binary()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    parts = [f.select("text").mapInArrow(run, "a binary, b binary, n bigint") for f in frames]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _words_of(cut: Cut):
    counts = np.bincount(cut.ids, minlength=len(cut.words))
    short = np.asarray(pc.less_equal(pc.binary_length(cut.words), HEAD_BYTES))
    words = cut.words.filter(pa.array(short))
    return words, pa.nulls(len(words), pa.binary()), counts[short]


def _most(counted: DataFrame, most: int) -> list:
    """The rows whose count reaches a bound: the least of a fixed scale that ``most`` rows reach.

    Counts per step of the scale, some 250 at most, come to the driver, then these rows.
    """
    if most <= 0:
        return []
    step = F.floor(4 * F.log2("n")).cast("int")
    stored = settle(counted.withColumn("step", step))
    bound, reached = None, 0
    for row in sorted(stored.groupBy("step").count().collect(), reverse=True):
        reached += row["count"]
        if reached > most:
            break
        bound = row["step"]
    return [] if bound is None else stored.filter(F.col("step") >= bound).collect()


def head_of(frames: list[DataFrame], longest: int, head_words: int, head_pairs: int) -> Head:
    """The most frequent words and, if features have two words or more, pairs of these.

    Counts are exact; at most so many words and pairs are taken.
    """
    words = sorted(bytes(r["a"]) for r in _most(_counted(frames, _words_of), head_words))
    if longest < 2 or not words or not head_pairs:
        return Head(words, [])
    context = frames[0].sparkSession.sparkContext
    known = context.broadcast(Head(words, []))

    def pairs_of(cut: Cut):
        place = known.value.place_of(cut.words)
        at = cut.starts(2)
        left, right = cut.ids[at], cut.ids[at + 1]
        both = (place[left] >= 0) & (place[right] >= 0)
        keys, counts = np.unique(left[both] * max(1, len(cut.words)) + right[both], return_counts=True)
        a, b = np.divmod(keys, max(1, len(cut.words)))
        return cut.words.take(pa.array(a)), cut.words.take(pa.array(b)), counts

    found = _most(_counted(frames, pairs_of), head_pairs)
    return Head(words, [(bytes(r["a"]), bytes(r["b"])) for r in found])


def _hashed(
    docs: DataFrame, head: Broadcast, longest: int, buckets: int, with_text: bool = True
) -> DataFrame:
    """``row``, number of words, and the buckets of all features as numbers of four bytes."""
    row = [F.col(f"`{c}`") for c in docs.columns if with_text or c != "text"]
    # A row without columns is no row for Arrow.
    row = F.struct(*(row or [F.lit(0).alias("none")]))
    kept = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType(
        [StructField("row", kept.schema["row"].dataType), StructField("n_words", LongType()), StructField("held", BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column("text")):
                cut = Cut(texts)
                per_size = head.value.buckets(cut, longest, buckets)
                parts = []
                for text, bucket in per_size:
                    ends = np.cumsum(np.bincount(text, minlength=len(texts)))
                    parts.append(np.split(bucket.astype("<u4"), ends[:-1]))
                held = [b"".join(p[k].tobytes() for p in parts) for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(first, len(texts)),
                        pa.array(cut.lengths),
                        pa.array(held, pa.binary()),
                    ],
                    names=["row", "n_words", "held"],
                )

    return kept.mapInArrow(run, schema)


def _totals(hashed: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: one row per bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch.column("held"):
                sums += np.bincount(np.frombuffer(one.as_buffer(), "<u4"), minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["bucket", "n"])

    schema = StructType([StructField("bucket", IntegerType()), StructField("n", LongType())])
    rows = hashed.select("held").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floor of 1000 times the log of the ratio of its shares, smoothed by one."""
    n = float(len(source))
    up = (target + 1.0) * (float(source.sum()) + n)
    down = (source + 1.0) * (float(target.sum()) + n)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weigh(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    head_words: int = HEAD_WORDS,
    head_pairs: int = HEAD_PAIRS,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with the added column ``weighed``: ``n_words``, ``n_features``, ``weight``.

    Texts are lower-cased (A-Z only) and cut into words of letters, digits and characters beyond
    ASCII; features are all runs of 1 to ``longest`` words, repeats counted.  ``weight`` is the
    floored mean of the gains of a document's features, 0 without any.  Null and empty texts
    have no features; repeated rows count as often as they stand there, on both sides; an empty
    target gives each bucket the share of none; an empty ``docs`` gives an empty table.  Other
    columns pass through unchanged, whatever their names, but one named ``weighed``.  All columns
    are stored once; without ``with_text`` the texts are neither stored nor returned.
    """
    context = docs.sparkSession.sparkContext
    texts = [x.select(F.col("text").cast("string").alias("text")) for x in (docs, target)]
    head = context.broadcast(head_of(texts, longest, head_words, head_pairs))
    hashed = settle(_hashed(docs.drop("weighed"), head, longest, buckets, with_text))
    goal = _hashed(texts[1], head, longest, buckets)
    table_of = context.broadcast(gains(_totals(hashed, buckets), _totals(goal, buckets)))
    weighed = StructType([StructField(x, LongType()) for x in ("n_words", "n_features", "weight")])
    schema = StructType([hashed.schema["row"], StructField("weighed", weighed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights = [], []
            for one in batch.column("held"):
                held = np.frombuffer(one.as_buffer(), "<u4")
                total = sum(int(table_of.value[held[k : k + SUMMED]].sum()) for k in range(0, len(held), SUMMED))
                sizes.append(len(held))
                weights.append(total // len(held) if len(held) else 0)
            found = pa.StructArray.from_arrays(
                [batch.column("n_words"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())],
                ["n_words", "n_features", "weight"],
            )
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], names=["row", "weighed"])

    return hashed.mapInArrow(run, schema).select("row.*", "weighed")


def resample(
    docs: DataFrame,
    target: DataFrame,
    per_cent: int = PER_CENT,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
    id_column: str = "doc_id",
    **options,
) -> DataFrame:
    """As ``weigh``, with ``score`` and ``rank`` added to ``weighed``: the draw.

    Of the documents with ``least_words`` words or more, the given share (floored) with the highest
    scores have ranks 1, 2, 3, ...; the others' rank is null.  The score adds to the weight a Gumbel
    variable that a hash of ``seed:id`` gives.  Ties go to the smaller id, null last, then to
    fewer features; rows alike in all these are ranked in any order.
    """
    found = weigh(docs, target, **options)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    score = (F.col("weighed.weight") + gumbel).cast("bigint")
    stored = settle(
        found.select(
            F.struct("*").alias("row"),
            score.alias("score"),
            F.col(id_column).isNull().cast("int").alias("no_id"),
            F.col(id_column).alias("id"),
            F.col("weighed.n_features").alias("n"),
            (F.col("weighed.n_words") >= least_words).alias("long"),
        )
    )
    order = [("score", "desc"), ("no_id", "asc"), ("id", "asc"), ("n", "asc")]
    able, n = number_rows(stored.filter("long"), {"place": order})
    drawn = F.col("place") <= n * per_cent // 100
    ranked = able.withColumn("rank", F.when(drawn, F.col("place").cast("bigint"))).select("row", "score", "rank")
    rest = stored.filter(~F.col("long")).select("row", "score", F.lit(None).cast("bigint").alias("rank"))
    whole = ranked.unionByName(rest)
    parts = [F.col(f"row.weighed.{x}").alias(x) for x in ("n_words", "n_features", "weight")]
    others = [F.col(f"row.`{c}`") for c in found.columns if c != "weighed"]
    return whole.select(*others, F.struct(*parts, "score", "rank").alias("weighed"))


def op12_importance_draw(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    drawn = resample(docs, table(spark, folder, "benchmark"), with_text=False)
    return drawn.select("doc_id", *[F.col(f"weighed.{x}").alias(x) for x in ("n_features", "weight", "score", "rank")])


OP12_SQL = r"""
WITH RECURSIVE poly AS (SELECT 3988292384::BIGINT AS p),
tab AS (
  SELECT list(list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, p) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t
  FROM range(256) r(b), poly),
x AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT side, r, doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda v: v <> '') AS f
  FROM x),
n AS (SELECT side, r, f, count(*) AS c FROM (SELECT side, r, unnest(f) AS f FROM w) GROUP BY ALL),
b AS (
  SELECT f, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
      lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS k
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)), tab),
a AS (
  SELECT k, coalesce(sum(c) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (side = 1), 0)::DOUBLE AS t
  FROM n JOIN b USING (f) GROUP BY k),
g AS (
  SELECT k, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM a) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM a) + 10000))))::BIGINT AS gain FROM a),
m AS (SELECT r, sum(c) AS n, sum(c * gain)::HUGEINT AS total FROM n JOIN b USING (f) JOIN g USING (k) WHERE side = 0 GROUP BY r),
s AS (
  SELECT w.doc_id, coalesce(m.n, 0)::BIGINT AS n_features,
         CASE WHEN m.n > 0 THEN (m.total - ((m.total % m.n) + m.n) % m.n) // m.n ELSE 0 END::BIGINT AS weight,
         (('0x' || substr(sha256('2024:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u
  FROM w LEFT JOIN m USING (r) WHERE side = 0),
o AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM s),
p AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS able FROM o)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM p
"""
