"""Periodic runs of words, found with longest common extensions over a difference cover.

The words of a chunk of documents become numbers, with a number of its own after each document.
``LCE(i, j)``, the count of equal words from i and from j on, is needed for many pairs.  Places
whose remainder by ``MODULUS`` is in ``COVER`` are samples; any i and j meet samples together
after fewer than ``MODULUS`` steps.  So only samples' suffixes are sorted: by words up to the
modulus, then by doubling ranks.  The common prefixes of neighbours in that order go into a sparse
table, whose range minimum gives the extension of any two samples.  A pair compares a few words
until both places are samples, and nearly all pairs differ before.

A run of period q and length 4q or more holds 3q words in a row that equal the word q later, so
it shows at a place of the grid 0, 3q, 6q, ... .  All grids of a document together have about
n/3 * ln(n/4) places.  Each place where the words agree is extended both ways (backwards on the
reversed words); equal stretches are one run, which keeps its smallest period.

Spark deals the documents; each is handled whole by itself, in memory that is linear in its
words times the logarithm of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tillwise.llm.common import SPACE, WORD, table

#: A perfect difference set; each remainder of 31 but 0 is one difference of two.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Least length of a run: so many words, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words handled together; a longer document is a chunk by itself.
CHUNK_WORDS = 200_000
#: Grid places handled together.
PLACES = 1 << 19

_CLASS = np.full(MODULUS, -1, np.int64)
_CLASS[list(COVER)] = np.arange(len(COVER))
#: Steps until places of these two remainders are both samples.
_STEPS = np.array(
    [
        [
            next(t for t in range(MODULUS) if _CLASS[(a + t) % MODULUS] >= 0 <= _CLASS[(b + t) % MODULUS])
            for b in range(MODULUS)
        ]
        for a in range(MODULUS)
    ]
)


class Extensions:
    """Longest common extensions of two different places of ``words``.

    No two places may have equal words up to the end: ``words`` must end with a number that
    occurs only there.
    """

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.blocks = self.n // MODULUS + 3
        top = int(words.max(initial=0)) + 1
        pad = self.blocks * MODULUS - self.n
        # The padding has numbers that occur once, so that no comparison passes the end.
        self.words = np.concatenate([words.astype(np.int64), np.arange(top, top + pad)])
        self.bits = max(1, int(top + pad).bit_length())
        self._sorted = False

    def _index(self, places: np.ndarray) -> np.ndarray:
        return _CLASS[places % MODULUS] * self.blocks + places // MODULUS

    def _refine(self, rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Split groups of equal rank by ``key``; a rank is the number of samples below.
        Returns the samples that are still tied."""
        order = np.lexsort((key, rank[live]))
        who, group, key = live[order], rank[live][order], key[order]
        at = np.arange(len(who))
        new_group = np.ones(len(who), bool)
        new_group[1:] = group[1:] != group[:-1]
        new_part = new_group.copy()
        new_part[1:] |= key[1:] != key[:-1]
        first = lambda starts: np.maximum.accumulate(np.where(starts, at, 0))
        rank[who] = group + first(new_part) - first(new_group)
        alone = new_part & np.append(new_part[1:], True)
        return who[~alone]

    def _sort(self) -> None:
        m = len(COVER) * self.blocks
        starts = (np.array(COVER)[:, None] + MODULUS * np.arange(self.blocks)[None, :]).ravel()
        # Samples beyond the words are of no use: their ranks follow their places.
        inside = starts < self.n
        rank = np.zeros(m, np.int64)
        live = np.flatnonzero(inside)
        rank[~inside] = np.arange(len(live), m)
        at_once = 62 // self.bits
        for first in range(0, MODULUS, at_once):
            if not len(live):
                break
            key = np.zeros(len(live), np.int64)
            for step in range(first, min(first + at_once, MODULUS)):
                key = (key << self.bits) | self.words[np.minimum(starts[live] + step, len(self.words) - 1)]
            live = self._refine(rank, live, key)
        self.levels, jump = [rank.copy()], 1
        while len(live):
            block = live % self.blocks + jump
            key = np.where(block < self.blocks, rank[np.minimum(live + jump, m - 1)], -1)
            live = self._refine(rank, live, key)
            self.levels.append(rank.copy())
            jump *= 2
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        order = order[: int(inside.sum())]
        self.rank, self.starts = rank, starts
        prefix = np.zeros(len(order), np.int64)
        if len(order) > 1:
            prefix[1:] = self._common(order[:-1], order[1:])
        self.minima = [prefix]
        width = 1
        while 2 * width <= len(prefix):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self._sorted = True

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of samples, by whole blocks from large to small, then words."""
        off = np.zeros(len(a), np.int64)
        m = len(self.rank)
        for k in range(len(self.levels) - 1, -1, -1):
            level, size = self.levels[k], 1 << k
            fits = (a % self.blocks + off < self.blocks) & (b % self.blocks + off < self.blocks)
            i, j = np.minimum(a + off, m - 1), np.minimum(b + off, m - 1)
            off += np.where(fits & (level[i] == level[j]), size, 0)
        i, j = self.starts[a] + off * MODULUS, self.starts[b] + off * MODULUS
        return off * MODULUS + self._compare(i, j, np.full(len(a), MODULUS))

    def _compare(self, i: np.ndarray, j: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, at most ``steps``."""
        same = np.zeros(len(i), np.int64)
        live = np.flatnonzero(steps > 0)
        last = len(self.words) - 1
        for t in range(int(steps.max(initial=0))):
            if not len(live):
                break
            equal = self.words[np.minimum(i[live] + t, last)] == self.words[np.minimum(j[live] + t, last)]
            live = live[equal]
            same[live] += 1
            live = live[steps[live] > t + 1]
        return same

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """LCE of each pair of places, i other than j."""
        steps = _STEPS[i % MODULUS, j % MODULUS]
        same = self._compare(i, j, steps)
        far = np.flatnonzero(same == steps)
        if len(far):
            if not self._sorted:
                self._sort()
            a = self.rank[self._index(i[far] + steps[far])]
            b = self.rank[self._index(j[far] + steps[far])]
            low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
            level = np.frexp((high - low).astype(float))[1] - 1
            least = np.empty(len(far), np.int64)
            for k in np.unique(level):
                mine = level == k
                row = self.minima[k]
                least[mine] = np.minimum(row[low[mine]], row[high[mine] - (1 << int(k))])
            same[far] += least
        return same


def runs_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of several documents: arrays (document, start, length, period), in that order.

    ``words`` are the documents' numbers in a row, each below ``len(words)``.
    """
    n_docs = len(lengths)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not (lengths >= LEAST_WORDS).any():
        return none
    # One number of its own after each document.
    total = int(lengths.sum())
    parted = np.empty(total + n_docs, np.int64)
    ends = np.cumsum(lengths + 1)
    inner = np.ones(len(parted), bool)
    inner[ends - 1] = False
    parted[inner] = words
    parted[ends - 1] = total + np.arange(n_docs)
    starts = ends - lengths - 1
    forward = Extensions(parted)
    # Read backwards, the separators stand before their documents; one more closes the last.
    backward = Extensions(np.append(parted[-2::-1], total + n_docs))
    last = len(parted) - 2

    long = np.flatnonzero(lengths >= LEAST_WORDS)
    most = lengths[long] // LEAST_PERIODS
    doc = np.repeat(long, most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = (LEAST_PERIODS - 1) * period
    count = (lengths[doc] - period - 1) // grid + 1
    before = np.concatenate([[0], np.cumsum(count)])
    found = []
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PLACES, "right")) - 1)
        c = count[lo:hi]
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        d, q = np.repeat(doc[lo:hi], c), np.repeat(period[lo:hi], c)
        i = starts[d] + k * (LEAST_PERIODS - 1) * q
        hit = parted[i] == parted[i + q]
        d, q, i = d[hit], q[hit], i[hit]
        lo = hi
        if not len(i):
            continue
        after = forward.of(i, i + q)
        behind = np.zeros(len(i), np.int64)
        inside = np.flatnonzero(i > starts[d])
        behind[inside] = backward.of(last - (i[inside] - 1), last - (i[inside] + q[inside] - 1))
        length = behind + after + q
        whole = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(np.stack([d[whole], i[whole] - behind[whole], length[whole], q[whole]]))
    if not found:
        return none
    d, s, n, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, n, s, d))
    d, s, n, q = d[order], s[order], n[order], q[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    d, s, n, q = d[new], s[new], n[new], q[new]
    order = np.lexsort((q, s, d))
    return d[order], (s - starts[d])[order], n[order], q[order]


_RUN = StructType([StructField(x, LongType()) for x in ("start", "length", "period")])
_SPLIT = "[ \t\n\x0b\x0c\r]+"


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of at most some ``CHUNK_WORDS`` words, or of one text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) // 5
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > CHUNK_WORDS:
            yield texts.slice(first, k - first)
            first, held = k, 0
        held += size
    if first < len(texts):
        yield texts.slice(first)


def _handle(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    split = pc.split_pattern_regex(pc.fill_null(texts, ""), _SPLIT)
    split = split.cast(pa.large_list(pa.large_string()))
    flat, parents = split.flatten(), np.asarray(pc.list_parent_indices(split))
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    flat, parents = flat.filter(pa.array(real)), parents[real]
    lengths = np.bincount(parents, minlength=len(texts)).astype(np.int64)
    ids = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
    d, start, length, period = runs_of(ids, lengths)
    first = np.cumsum(lengths) - lengths
    # Words after the first period of a run go: +1 where such a stretch begins, -1 behind it.
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, first[d] + start + period, 1)
    np.add.at(edge, first[d] + start + length, -1)
    stay = np.cumsum(edge[:-1]) == 0
    kept = flat.filter(pa.array(stay))
    left = np.concatenate([[0], np.cumsum(np.bincount(parents[stay], minlength=len(texts)))])
    kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), kept)
    collapsed = pc.binary_join(kept, pa.scalar(" ", pa.large_string()))
    cuts = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(texts)))])
    runs = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]
    )
    runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs)
    return pa.array(lengths), runs, collapsed.cast(pa.string())


def find_runs(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the added column ``found``: ``n_words``, ``runs`` and ``collapsed``.

    Words are what lies between white space of ASCII, numbered from 0.  A run is a stretch of
    words whose smallest period is ``period``, of ``LEAST_WORDS`` words and ``LEAST_PERIODS``
    periods or more, that no neighbouring word extends; runs are sorted by start, then period,
    and may overlap.  ``collapsed`` joins with one space the words that lie in no run or in the
    first period of each run they lie in.  Null and empty texts have no words, no runs and the
    collapsed text ``""``.  Each row is handled by itself, so repeated rows and empty tables need
    no rule; other columns pass through unchanged, whatever their names.
    """
    kept = docs.select(F.struct("*").alias("row"), F.col(column).alias("text"))
    found = StructType(
        [
            StructField("n_words", LongType()),
            StructField("runs", ArrayType(_RUN)),
            StructField("collapsed", StringType()),
        ]
    )
    schema = StructType([StructField("row", kept.schema["row"].dataType), StructField("found", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _chunks(batch.column("text")):
                result = pa.StructArray.from_arrays(list(_handle(texts)), ["n_words", "runs", "collapsed"])
                rows = batch.column("row").slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([rows, result], names=["row", "found"])

    return kept.mapInArrow(run, schema).select("row.*", "found")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the crc32 of their id, repeats its words from some place on.

    Let h be that crc32 and g the floor of h / 10.  Where h ends in 0 and there are n > 0 words,
    word i from a = g mod n on becomes word a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8)).
    Words are joined by one space there; other texts, and those without id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        def source(i):
            return F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")

        return F.array_join(F.transform(words, lambda _, i: F.get(words, source(i))), " ")

    # One element at most, so that the words are cut once.
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), planted), F.lit(0))
    chosen = (h % 10 == 0) & F.col("text").rlike(WORD)
    return docs.withColumn("text", F.when(chosen, changed).otherwise(F.col("text")))


def op11_periodic_runs(spark, folder):
    docs = with_planted_runs(table(spark, folder, "documents").select("doc_id", "text"))
    found = find_runs(docs).select("doc_id", "found.*")
    # Sorting by these puts the longest run first, then the smallest start and period.
    ranked = F.transform(
        "runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_min(ranked)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["s"].alias("start"),
        (-best["n"]).alias("length"),
        best["p"].alias("period"),
        F.floor(-1000 * best["n"] / best["p"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t
  FROM range(256) r(b)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda v: v <> '') AS w,
         CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(
           list_transform(range(1, length(hex(encode(doc_id::VARCHAR))), 2), lambda i: ('0x' || substr(hex(encode(doc_id::VARCHAR)), i, 2))::BIGINT),
           lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295) END AS h
  FROM documents, tab),
e AS (
  SELECT r, doc_id, n, unnest(range(n)) AS i, w, h % 10 = 0 AS planted, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p
  FROM (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM d)),
x AS (SELECT r, n, i, w[CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM e),
same AS (
  SELECT u.r, u.i, v.i - u.i AS q
  FROM x u JOIN x v ON u.r = v.r AND u.word = v.word AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
stretch AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island),
run AS (
  SELECT r, start, length, min(q) AS period FROM stretch WHERE length >= 6 AND length >= 4 * q GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS text FROM x ANTI JOIN gone ON x.r = gone.r AND x.i = gone.i GROUP BY x.r),
runs AS (
  SELECT r, count(*) AS n_runs, arg_min([start, length, period], [-length, start, period]) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM run GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
       1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN runs ON d.r = runs.r LEFT JOIN kept ON d.r = kept.r
"""
