"""Suffix-array dedup: repeated byte strings of 50 bytes, by a distributed difference cover.

Spark deals the windows of 50 bytes by their anchor value, the least hash among the substrings of
20 bytes in them: equal windows have equal values, so they meet in one bucket.  Windows next to
each other with the same value travel as one piece of text; a bucket holds each different piece
once, with the rows where it occurs.

Within a bucket the suffixes of the pieces are sorted by the DC3 algorithm over characters of 6
bytes: the triples at two of three places are named by their rank, triples of names are named
again until they cover 50 bytes, and with those ranks the remaining suffixes are sorted and
merged.  Then adjacent prefixes of 50 bytes are compared: a run of equal ones is one string, and
the least doc_id of its pieces decides for all of its places.

Only what may repeat gets that far.  A first pass sends 4 bytes of each anchor value and its doc_id;
windows whose value is found in one document only repeat nowhere.  That loses nothing.  A task
sends each piece once and settles its own copies, so a text or line that stands in very many rows
is sent once a task.  What differs around a value of very many documents is dealt by whole
windows instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import giving_back, table

LENGTH = 50
ANCHOR = 20
#: Bytes of text for each bucket, bytes of pieces that are sorted together, and windows of a piece.
BUCKET_BYTES = 4 << 20
SORT_BYTES = 40_000
PIECE_WINDOWS = 4096
#: A value of so many documents has its windows dealt one by one.
OFTEN = 200_000
_OFTEN = 1 << 62
#: Bytes of a character of the sort: with the place of one in 65,536 it fits in 8 bytes.
CHAR = 6
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(32)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _print(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def anchors(raw: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, value) of the stretches of windows with one anchor value."""
    n = len(raw) - anchor + 1
    wide = length - anchor + 1
    if n < wide:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    padded = raw + bytes(8)
    views = [np.ndarray((n,), "<u8", padded, at, (1,)) for at in [*range(0, anchor - 7, 8), anchor - 8]]
    h = np.zeros(n, np.uint64)
    for v in views:
        h ^= v
        h *= _A
        h ^= h >> np.uint64(31)
    h *= _B
    least, span = h, 1
    while span < wide:
        step = min(span, wide - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(begin[1:], len(least))
    if (end - begin).max() > PIECE_WINDOWS:
        parts = [np.arange(a, b, PIECE_WINDOWS) for a, b in zip(begin.tolist(), end.tolist())]
        begin = np.concatenate(parts)
        end = np.append(begin[1:], len(least))
    return begin, end, least[begin]


def _codes(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 4 bytes of each value.  Values that share a code are only taken for one."""
    return ((values >> _LOW) % np.uint64(buckets)).astype(np.int64) << 32 | (values & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _packed(numbers: np.ndarray) -> bytes:
    """Differences of 8-byte numbers, byte planes apart, compressed."""
    planes = np.diff(numbers, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return planes.T.copy().view("<i8").ravel().cumsum()


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 upwards; equal keys have equal ranks."""
    bits = np.uint64(max(1, len(keys).bit_length()))
    if int(keys.max(initial=0)).bit_length() + int(bits) <= 64:
        # Key and place in one number: sorting numbers takes a third of the time of sorting places.
        ordered = np.sort(keys << bits | np.arange(len(keys), dtype=np.uint64))
        at = (ordered & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        ordered >>= bits
    else:
        at = np.argsort(keys)
        ordered = keys[at]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    ranks = np.empty(len(keys), np.int64)
    ranks[at] = np.cumsum(new)
    return ranks


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """The same for rows of ranks."""
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if int(key.max(initial=0)).bit_length() + bits > 64:
            key = _dense(key).astype(np.uint64)
        key = key << np.uint64(bits) | c.astype(np.uint64)
    return _dense(key)


def suffix_order(text: bytes, begins: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, piece of each, new): the places of all windows in the order of their suffixes, and
    whether the window's prefix of ``length`` bytes differs from that of the one before.

    Pieces of ``text`` are at ``begins``, have ``length`` bytes at least, and 8 zeros after each.
    A suffix is read in steps of ``CHAR`` bytes, its characters; zeros follow the end of its piece.
    Suffixes that agree in ``length`` bytes lie together, in any order.
    """
    void = len(text)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = begins[piece] + inside
    end = (begins + sizes)[piece]
    kind = inside // CHAR % 3

    def later(which, step):
        """The places ``step`` bytes on; a place of rank 0 beyond the piece."""
        at = place[which] + step
        return np.where(at < end[which], at, void)

    def by_place(which, ranks):
        out = np.zeros(void + 1, np.int64)
        out[place[which]] = ranks
        return out

    words = np.ndarray((void,), ">u8", text + bytes(8), 0, (1,))
    every = np.arange(len(place))
    char = by_place(every, _dense(words[place].astype(np.uint64) >> np.uint64(64 - 8 * CHAR)))
    # Names of the samples' triples, then of triples of names.
    sample = np.flatnonzero(kind > 0)
    names, width = char, CHAR
    while width < length or width == CHAR:
        if 3 * width >= length:
            # The last names are read for windows only, at most two characters on.
            sample = sample[inside[sample] <= (sizes[piece] - length)[sample] + 2 * CHAR]
        names = by_place(sample, _ranks(*(names[later(sample, k * width)] for k in range(3))))
        width *= 3
    # Merging: a suffix of kind 0 meets those of kind 1 and of kind 2 under keys that both have.
    window = inside <= sizes[piece] - length
    zero, one, two = (np.flatnonzero(window & (kind == k)) for k in range(3))
    with_one, with_two = np.concatenate([zero, one]), np.concatenate([zero, two])
    first = _ranks(char[place[with_one]], names[later(with_one, CHAR)])
    second = _ranks(char[place[with_two]], char[later(with_two, CHAR)], names[later(with_two, 2 * CHAR)])

    def smaller(of, among):
        """How many ranks of ``among`` are less than each of ``of``."""
        counts = np.bincount(among, minlength=int(of.max(initial=0)) + 1)
        return (np.cumsum(counts) - counts)[of]

    n = len(zero)
    samples = names[place[np.concatenate([one, two])]]
    own = smaller(samples, samples)
    rank = np.concatenate([
        smaller(first[:n], first[:n]) + smaller(first[:n], first[n:]) + smaller(second[:n], second[n:]),
        own[: len(one)] + smaller(first[n:], first[:n]),
        own[len(one) :] + smaller(second[n:], second[:n]),
    ])
    order = np.concatenate([zero, one, two])[np.argsort(rank.astype(np.int32))]
    # Adjacent prefixes.
    at = place[order]
    new = np.zeros(len(at), bool)
    new[:1] = True
    for step in [*range(0, length - 7, 8), length - 8]:
        w = words[at + step]
        new[1:] |= w[1:] != w[:-1]
    return at, piece[order], new


def least_docs(pieces: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """For all windows of the pieces, one after another: the least doc_id with an equal window."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(sizes + 8) - sizes - 8
    text = bytes(8).join(pieces) + bytes(8)
    at, piece, new = suffix_order(text, begins, sizes, length)
    runs = np.flatnonzero(new)
    docs = np.repeat(np.minimum.reduceat(least[piece], runs), np.diff(runs, append=len(at)))
    wide = sizes - length + 1
    out = np.empty(len(at), np.int64)
    out[at - begins[piece] + (np.cumsum(wide) - wide)[piece]] = docs
    return out


def shared_values(docs: DataFrame, buckets: int, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """``value`` (codes of anchor values found in several documents; plus 2^62 if in ``often``
    or more) and ``doc_id``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "bucket known n codes docs"

        def rows(codes, owners, known):
            places = codes >> 32
            cuts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])[: len(codes)])
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(codes)).tolist()):
                by_doc = a + np.argsort(owners[a:b], kind="stable")
                data = (codes[by_doc] & 0xFFFFFFFF).astype("<u4").tobytes()
                yield _batch(names, [int(places[a])], [known], [b - a], [data], [_packed(owners[by_doc])])

        for batch in batches:
            found, owners = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if doc_id is not None and text:
                    values = anchors(_raw(text), length)[2]
                    found.append(values)
                    owners.append(np.full(len(values), doc_id, np.int64))
            codes = _codes(np.concatenate([np.zeros(0, np.uint64), *found]), buckets)
            owners = np.concatenate([np.zeros(0, np.int64), *owners])
            at = np.lexsort((owners, codes))
            codes, owners = codes[at], owners[at]
            once = np.ones(len(codes), bool)
            once[1:] = (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1])
            codes, owners = codes[once], owners[once]
            # Of the documents of a value, the first and the last tell other tasks all.
            edge = np.ones(len(codes), bool)
            edge[1:-1] = (codes[1:-1] != codes[:-2]) | (codes[1:-1] != codes[2:])
            yield from rows(codes[edge], owners[edge], False)
            yield from rows(codes[~edge], owners[~edge], True)

    def meet(got: pa.Table) -> pa.Table:
        bucket = got.column("bucket")[0].as_py()
        codes, owners, sent = [], [], []
        for known, data, packed in zip(*(got.column(c).to_pylist() for c in ("known", "codes", "docs"))):
            codes.append(np.frombuffer(data, "<u4"))
            owners.append(_unpacked(packed))
            sent.append(np.full(len(codes[-1]), known))
        codes, owners, sent = np.concatenate(codes), np.concatenate(owners), np.concatenate(sent)
        mine = np.flatnonzero(~sent)
        at = mine[np.argsort(codes[mine], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], codes[at[1:]] != codes[at[:-1]]])[: len(at)])
        several = np.zeros(0, bool)
        if len(at):
            differ = np.maximum.reduceat(owners[at], starts) != np.minimum.reduceat(owners[at], starts)
            several = np.repeat(differ, np.diff(starts, append=len(at)))
        out = np.concatenate([at[several], np.flatnonzero(sent)])
        value, doc_id = codes[out].astype(np.int64) | bucket << 32, owners[out]
        if len(value) >= often:
            _, which, n = np.unique(value, return_inverse=True, return_counts=True)
            value[n[which] >= often] += _OFTEN
        return pa.table({"value": value, "doc_id": doc_id})

    sent = docs.mapInArrow(giving_back(send), "bucket bigint, known boolean, n bigint, codes binary, docs binary")
    return sent.groupBy("bucket").applyInArrow(meet, "value bigint, doc_id bigint")


SENT = "bucket bigint, known boolean, codes binary, sizes binary, docs binary, prints binary, begins binary, data binary"
_SENT = " ".join(part.split()[0] for part in SENT.split(", "))


def repeats(docs: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """``doc_id``, ``print`` (of the text), ``start`` and ``stop``: ranges of places where strings
    of ``length`` bytes start that also start in a document with a smaller doc_id.

    A range comes from one piece; those of a row may touch one another."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // BUCKET_BYTES + 1)
    values = shared_values(docs, buckets, length, often)
    values = values.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("value").alias("values"))

    def by_window(raw, begin, end, codes, common):
        """Windows of common values as pieces of their own, with a value of their own bytes."""
        many = np.isin(codes, common)
        width = (end - begin)[many]
        place = np.repeat(begin[many] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        own = np.array([xxhash.xxh64_intdigest(raw[a : a + length]) for a in place.tolist()], np.uint64)
        begin, end = np.concatenate([begin[~many], place]), np.concatenate([end[~many], place + 1])
        codes = np.concatenate([codes[~many], _codes(own, buckets)])
        at = np.argsort(begin)
        return begin[at], end[at], codes[at]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text")]
            lists = batch.column("values")
            asked = [k for k, v in enumerate(lists.is_valid().to_pylist()) if v and columns[1][k]]
            # In the order of doc_id: the first to hold a piece is the least of this task to do so.
            asked.sort(key=lambda k: columns[0][k])
            seen: dict[bytes, int] = {}
            out: list[tuple] = []
            settled: list[list[int]] = []
            for k in asked:
                doc_id, raw = columns[0][k], _raw(columns[1][k])
                begin, end, value = anchors(raw, length)
                codes = _codes(value, buckets)
                asked_for = lists[k].values.to_numpy()
                mine = np.flatnonzero(np.isin(codes, asked_for & (_OFTEN - 1)))
                print_ = _print(raw)
                begin, end, codes = begin[mine], end[mine], codes[mine]
                if (asked_for >= _OFTEN).any():
                    begin, end, codes = by_window(raw, begin, end, codes, asked_for[asked_for >= _OFTEN] - _OFTEN)
                for a, b, code in zip(begin.tolist(), end.tolist(), codes.tolist()):
                    piece = raw[a : b + length - 1]
                    if seen.setdefault(piece, doc_id) == doc_id:
                        out.append((code, doc_id, print_, a, piece))
                    elif settled and settled[-1][3] == a and settled[-1][:2] == [doc_id, print_]:
                        settled[-1][3] = b
                    else:
                        settled.append([doc_id, print_, a, b])
            out.sort(key=lambda r: r[0])
            codes = np.array([r[0] for r in out], np.int64)
            cuts = np.flatnonzero(np.diff(codes >> 32, prepend=-1))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(out)).tolist()):
                part = sorted(out[a:b], key=lambda r: r[1:4])
                numbers = [np.array([r[c] for r in part], np.int64) for c in range(4)]
                sizes = np.array([len(r[4]) for r in part], np.int64)
                data = zstandard.compress(b"".join(r[4] for r in part), 1)
                low = _packed(numbers[0] & 0xFFFFFFFF)
                yield _batch(_SENT, [int(codes[a] >> 32)], [False], [low], [_packed(sizes)], *([_packed(x)] for x in numbers[1:]), [data])
            if settled:
                doc_ids, prints, begins, ends = np.array(settled, np.int64).T
                bucket = settled[0][1] % buckets
                yield _batch(_SENT, [bucket], [True], [b""], [_packed(ends - begins)], [_packed(doc_ids)], [_packed(prints)], [_packed(begins)], [b""])

    def compare(got: pa.Table) -> pa.Table:
        results = [np.zeros((4, 0), np.int64)]
        codes, distinct, rows = [], {}, []
        for known, low, sizes, doc_ids, prints, begins, data in zip(*(got.column(c).to_pylist() for c in _SENT.split()[1:])):
            sizes, doc_ids, prints, begins = map(_unpacked, (sizes, doc_ids, prints, begins))
            if known:
                results.append(np.stack([doc_ids, prints, begins, begins + sizes]))
                continue
            data, ends = zstandard.decompress(data), np.cumsum(sizes).tolist()
            which = [distinct.setdefault(data[a:b], len(distinct)) for a, b in zip([0, *ends], ends)]
            codes.append(_unpacked(low))
            rows.append(np.stack([np.array(which, np.int64), doc_ids, prints, begins]))
        if distinct:
            pieces = list(distinct)
            which, doc_ids, prints, begins = np.concatenate(rows, 1)
            least = np.full(len(pieces), np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc_ids)
            code = np.zeros(len(pieces), np.int64)
            code[which] = np.concatenate(codes)
            wide = np.array([len(p) for p in pieces], np.int64) - length + 1
            # Equal windows have one code: parts of the codes are sorted one after another.
            parts = (np.sum(wide) + (length - 1) * len(pieces)) // SORT_BYTES + 1
            order = np.argsort(code * 0x9E3779B1 % 0xFFFFFFFB % parts, kind="stable")
            part = (code * 0x9E3779B1 % 0xFFFFFFFB % parts)[order]
            ends = np.searchsorted(part, np.arange(parts), "right")
            found = [least_docs([pieces[k] for k in order[a:b].tolist()], least[order[a:b]], length) for a, b in zip([0, *ends[:-1]], ends) if a < b]
            found = np.concatenate(found)
            offset = np.empty(len(pieces), np.int64)
            offset[order] = np.cumsum(wide[order]) - wide[order]
            # Each row that holds a piece asks for the windows found under a smaller doc_id.
            width = wide[which]
            total = np.cumsum(width)
            inside = np.arange(total[-1]) - np.repeat(total - width, width)
            gone = found[np.repeat(offset[which], width) + inside] < np.repeat(doc_ids, width)
            row = np.repeat(np.arange(len(which)), width)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1] | (inside[1:] == 0)
            closes = gone.copy()
            closes[:-1] &= ~gone[1:] | (inside[1:] == 0)
            opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
            of = row[opens]
            results.append(np.stack([doc_ids[of], prints[of], begins[of] + inside[opens], begins[of] + inside[closes] + 1]))
        return pa.table(list(np.concatenate(results, 1)), names=["doc_id", "print", "start", "stop"])

    joined = docs.join(values, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "values")
    sent = joined.mapInArrow(giving_back(send), SENT)
    return sent.groupBy("bucket").applyInArrow(compare, "doc_id bigint, print bigint, start bigint, stop bigint")


def covered(ranges, length: int = LENGTH) -> list[tuple[int, int]]:
    """The bytes of all strings that start in the ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + length)
        else:
            out.append([a, b - 1 + length])
    return [tuple(x) for x in out]


def deduplicated(docs: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """``doc_id``, ``spans`` removed (byte offsets, end exclusive) and ``kept``, the bytes left.

    Texts are UTF-8 bytes; null texts are empty; matches never cross documents.  Strings are
    judged on the input.  Rows that share a doc_id are not earlier than one another; rows
    without doc_id are kept whole and are not searched.  Other columns are not read.  ``often``
    affects speed only.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = repeats(docs, length, often)
    found = found.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("print", "start", "stop")).alias("found"))
    joined = docs.join(found, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "found")
    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            lists = batch.column("found")
            for k, text in enumerate(batch.column("text").to_pylist()):
                raw = _raw(text)
                gone = []
                if lists[k].is_valid:
                    of_print, starts, stops = (lists[k].values.field(c).to_numpy() for c in range(3))
                    mine = of_print == _print(raw)
                    gone = covered(zip(starts[mine].tolist(), stops[mine].tolist()), length)
                edges = [0, *[e for s in gone for e in s], len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pairs), pa.array(kept, pa.binary())]
            yield _batch("doc_id n_bytes spans kept", *columns)

    return joined.mapInArrow(giving_back(run), schema)


def op5_suffix_dedup(spark, folder):
    found = deduplicated(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
