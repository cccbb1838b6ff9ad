"""N-gram Jaccard join over a token-group matrix.

Documents whose shingle sets have a Jaccard similarity of at least ``per_cent`` are linked; the
result is the connected classes.  Similar documents are first partitioned into groups: equal
sets, then sets that were found similar to a common, central member.  The matrix holds, for each
group, the union of its members' telling tokens.

Tokens have one order, by the number of sets in a token's bucket, so that frequent shingles come
last; the buckets are a table of fixed size counted over all documents.  Two similar sets of n
and m tokens overlap in at least p / (100 + p) (n + m), so each holds a common token among its
first n - ceil(p n / 100) + 1, its telling tokens.  The first token of a query that is in a
group's union bounds the overlap with every member: what comes before is outside the union, so
at most n - place tokens are left.  Only groups that reach the least overlap are opened, and only
their members, under the same bound with both places, are compared with the query, exactly.
Before sets are compared, a parity sketch gives a lower bound of their symmetric difference,
which spares most comparisons and loses nothing.

Tokens are 64-bit hashes; sets are equal if a 128-bit digest of their tokens is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.llm.common import giving_back, table
from tillwise.llm.components import components
from tillwise.llm.shingles import shingle_sets
from tillwise.sources.shared import settle, sized

SIZE = 3
PER_CENT = 90
BUCKET_BITS = 20
CHUNKS = 64
SKETCH_BITS = 2048
#: Rounds in which sets are grouped around common members before the matrix is built.
ROUNDS = 3


def least_overlap(n, per_cent: int = PER_CENT):
    """The least overlap of a set of ``n`` tokens with any similar set."""
    return -(-(n * per_cent) // 100)


def _sketch(tokens: np.ndarray) -> bytes:
    bits = np.bincount((tokens >> np.uint64(53)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 1000):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            few = batch.slice(at, rows)
            yield few, few.column("text").to_pylist()


def described(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row ``doc_id``, ``n``, digest ``sig`` and ``sketch``; and rows with a ``chunk`` of the
    bucket counts of a task in ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        names = ["doc_id", "n", "sig", "sketch", "chunk"]
        for few, texts in _texts(batches):
            sets = shingle_sets(texts, size)
            if sets:
                places = np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)
                counts += np.bincount(places.astype(np.int64), minlength=len(counts)).astype(np.uint32)
            columns = [
                few.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([_sketch(s) for s in sets], pa.binary()),
                pa.nulls(len(sets), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        for k, part in enumerate(np.split(counts, CHUNKS)):
            if part.any():
                row = [[None], [None], [None], [zlib.compress(part.astype("<u4").tobytes(), 1)], [k]]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=names)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(giving_back(run), "doc_id bigint, n bigint, sig binary, sketch binary, chunk int")


def _bucket_counts(described_docs: DataFrame) -> np.ndarray:
    """The table of bucket counts over all documents: 2^20 numbers whatever the input."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for k, data in zip(frame["chunk"], frame["sketch"]):
                part = np.frombuffer(zlib.decompress(data), "<u4").astype(np.uint32)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pd.DataFrame({"chunk": list(sums), "sketch": [zlib.compress(v.tobytes(), 1) for v in sums.values()]})

    parts = described_docs.filter("chunk is not null").select("chunk", "sketch")
    summed = parts.repartition("chunk").mapInPandas(add, "chunk int, sketch binary").collect()
    counts = np.zeros((CHUNKS, (1 << BUCKET_BITS) // CHUNKS), np.uint32)
    for row in summed:
        counts[row["chunk"]] = np.frombuffer(zlib.decompress(row["sketch"]), np.uint32)
    return counts.ravel()


def _telling(docs: DataFrame, counts: np.ndarray, size: int, per_cent: int) -> DataFrame:
    """``token``, ``id``, ``n``, ``place``: the telling tokens of each set in their order.  Sets so small that
    one token more or less is too much are similar to equal sets only and have none."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for few, texts in _texts(batches):
            tokens, ids, sizes, places = [], [], [], []
            for doc_id, s in zip(few.column("doc_id").to_pylist(), shingle_sets(texts, size)):
                n = len(s)
                least = least_overlap(n, per_cent)
                if not n or (least == n and 100 * n < per_cent * (n + 1)):
                    continue
                rank = common[s >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64) << np.uint64(32)
                first = np.argsort(rank | (s & np.uint64(0xFFFFFFFF)), kind="stable")[: n - least + 1]
                tokens.append(s[first].view(np.int64))
                ids.append(np.full(len(first), doc_id, np.int64))
                sizes.append(np.full(len(first), n, np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            if tokens:
                columns = [pa.array(np.concatenate(c)) for c in (tokens, ids, sizes, places)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "id", "n", "place"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "token bigint, id bigint, n int, place int")


def _verified(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, size: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar indeed."""

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                for c in ("sketch_a", "sketch_b")
            ]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1).astype(np.int64)
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            # |A n B| <= (|A| + |B| - apart) / 2, and 100 |A n B| >= p |A u B| is asked for.
            both = (n + m - apart) // 2
            keep = pa.array(100 * both >= per_cent * (n + m - both))
            yield batch.select(["a", "b"]).filter(keep)

    def side(name):
        return sketches.select(F.col("id").alias(f"id_{name}"), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    sketched = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    likely = settle(sketched.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(may_be, "a bigint, b bigint").distinct())
    wanted = likely.select(F.col("a").alias("wanted")).union(likely.select("b")).distinct()
    wanted = sized(settle(wanted))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, texts in _texts(batches):
            sets = [s.tobytes() for s in shingle_sets(texts, size)]
            yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "tokens"])

    texts = docs.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    sets = texts.select("doc_id", "text").mapInArrow(giving_back(sets_of), "id bigint, tokens binary").distinct()
    sets = settle(sets)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("id_x"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("id_y"), F.col("tokens").alias("y"))
    whole = likely.join(left, F.col("a") == F.col("id_x")).join(right, F.col("b") == F.col("id_y"))
    return settle(whole.select("a", "b", "x", "y").mapInArrow(giving_back(compare), "a bigint, b bigint").distinct())


def _grouped(entries: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Entries with their group: the class found so far, or the set alone."""
    if classes is None:
        return entries.withColumn("grp", F.col("id"))
    found = classes.select(F.col("id").alias("__id"), F.col("component").alias("__component"))
    joined = entries.join(found, F.col("id") == F.col("__id"), "left")
    return joined.select("token", "id", "n", "place", F.coalesce("__component", "id").alias("grp"))


def _between_groups(entries: DataFrame) -> DataFrame:
    """Entries of tokens that more than one group holds."""
    held = entries.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low < high")
    held = held.select(F.col("token").alias("__token"))
    return entries.join(held, F.col("token") == F.col("__token")).drop("__token")


def similar_classes(
    docs: DataFrame, size: int = SIZE, per_cent: int = PER_CENT, rounds: int = ROUNDS
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Two documents link when 100 * intersection >= ``per_cent`` * union of their sets of distinct
    ``size``-word shingles (A-Z in lower case); a text with fewer words, but not none, has its
    words as one shingle; without words or text a document links with nothing.  The component id
    is the least doc_id reachable.  Rows that share a doc_id count as one document with several
    texts; rows without doc_id are not compared and have no component.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    all_rows = settle(described(docs, size))
    counts = _bucket_counts(all_rows)
    rows = all_rows.filter("chunk is null").drop("chunk")
    full = rows.filter("n > 0 and doc_id is not null")
    # Equal sets: one group, stood for by its least id.
    equal = settle(full.groupBy("sig").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")))
    sketches = equal.select("id", "n", "sketch")
    ids = sized(settle(equal.select(F.col("id").alias("wanted")).distinct()))
    single = docs.join(ids, F.col("doc_id") == F.col("wanted"), "left_semi")
    entries = settle(_telling(single, counts, size, per_cent).distinct())
    entries = settle(_between_groups(_grouped(entries, None)).drop("grp"))

    members = full.select(F.col("sig").alias("__sig"), F.col("doc_id").alias("b")).distinct()
    # Rows with equal sets are linked through the class of their id at the end; rows of one
    # doc_id with several sets link those here.
    links = settle(
        equal.select("sig", "id")
        .join(members, F.col("sig") == F.col("__sig"))
        .join(ids, F.col("b") == F.col("wanted"), "left_semi")
        .filter("id <> b")
        .select(F.col("id").alias("a"), "b")
    )
    def may_reach(n, m, left):
        """Can sets of n and m tokens be similar when their overlap is at most ``left``?"""
        return F.lit(100 + per_cent).cast("bigint") * left >= F.lit(per_cent).cast("bigint") * (n + m)

    def near(mine, theirs):
        n, m = F.col(f"{mine}n"), F.col(f"{theirs}n")
        left = F.least(n - F.col(f"{mine}place"), m - F.col(f"{theirs}place"), n, m)
        return may_reach(n, m, left)

    classes = components(links)
    for turn in range(rounds):
        # Each set meets one set of another group: of those that hold one of its telling tokens
        # at the earliest place, hence with little else, the one that holds most of them.
        grouped = settle(_between_groups(_grouped(entries, classes)))
        pick = F.struct("place", F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "grp")
        pivots = grouped.groupBy(F.col("token").alias("__token")).agg(F.min(pick).alias("p"))
        met = grouped.join(pivots, F.col("token") == F.col("__token"))
        met = met.filter((F.col("grp") != F.col("p.grp")) & near("", "p."))
        met = met.groupBy("id", F.col("p.id").alias("b")).agg(F.count("*").alias("shared"))
        best = met.groupBy(F.col("id").alias("a")).agg(F.max(F.struct("shared", "b")).alias("best"))
        found = _verified(docs, best.select("a", F.col("best.b").alias("b")), sketches, size, per_cent)
        if found.isEmpty():
            break
        links = settle(links.unionByName(found))
        classes = components(links)

    # The matrix of what is still held by several groups: token, group, and for the bound the
    # range of its members' sizes and the most tokens that a member has from this one on.
    grouped = settle(_between_groups(_grouped(entries, classes)))
    matrix = grouped.groupBy(F.col("token").alias("of"), F.col("grp").alias("group_b")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("rest")
    )
    smallest = F.greatest(F.col("least"), F.expr(f"(n * {per_cent} + 99) div 100"))
    reaches = may_reach(F.col("n"), smallest, F.least(F.col("n") - F.col("place"), F.col("rest")))
    fits = (F.col("grp") != F.col("group_b")) & (100 * F.col("most") >= per_cent * F.col("n")) & reaches
    qualifying = grouped.join(matrix, (F.col("token") == F.col("of")) & fits)
    qualifying = settle(qualifying.select("token", "id", "n", "place", "group_b"))
    # Opening them: the members that hold the token as well.
    asked = qualifying.select("token", F.col("id").alias("query"), F.col("n").alias("q_n"), F.col("place").alias("q_place"), "group_b")
    inside = grouped.select(F.col("token").alias("of"), F.col("id").alias("member"), F.col("n").alias("m_n"), F.col("place").alias("m_place"), "grp")
    held = (F.col("token") == F.col("of")) & (F.col("group_b") == F.col("grp")) & (F.col("query") < F.col("member"))
    opened = asked.join(inside, held & near("q_", "m_")).select("query", "member").distinct()
    found = _verified(docs, opened.select(F.col("query").alias("a"), F.col("member").alias("b")), sketches, size, per_cent)
    classes = components(links.unionByName(found))

    # From sets back to documents; a doc_id with several sets takes the least class of them.
    of_set = equal.select("sig", "id").join(
        classes.select(F.col("id").alias("__id"), "component"), F.col("id") == F.col("__id"), "left"
    )
    of_set = settle(of_set.select(F.col("sig").alias("__sig"), F.coalesce("component", "id").alias("class")))
    return rows.join(of_set, F.col("sig") == F.col("__sig"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"),
    )


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the least doc_id, and all documents that link
    with nothing; columns unchanged.  Of rows that share a doc_id one remains, the one whose text
    sorts first; rows without doc_id all stay."""
    classed = settle(similar_classes(docs, **options))
    gone = classed.filter("component_id <> doc_id").select(F.col("doc_id").alias("__doc_id")).distinct()
    kept = docs.join(sized(settle(gone)), F.col("doc_id") == F.col("__doc_id"), "left_anti")
    repeated = classed.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__doc_id"))
    repeated = sized(settle(repeated.agg(F.count("*").alias("__rows")).filter("__rows > 1").select("__doc_id")))
    if repeated.isEmpty():
        return kept
    on = F.col("doc_id") == F.col("__doc_id")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    first = kept.join(repeated, on, "left_semi").withColumn("__place", place).filter("__place = 1")
    return kept.join(repeated, on, "left_anti").unionByName(first.drop("__place"))


def op10_group_join(spark, folder):
    return similar_classes(table(spark, folder, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE r.c < u.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""
