"""Token-ID output: files of range asymmetric numeral system (rANS) blocks with one shared table.

Documents are range-partitioned and sorted by doc_id, turned into token ids, and cut into blocks
of whole documents.  A first pass counts all ids; the counts, scaled to 2^20, are the static
table shared by all blocks.  Symbol j of a block goes to lane j mod 1024; each lane is a rANS
state of 64 bits that gives off 32 bits at a time into the block's one stream.  Every 128 steps
the block notes all lane states and the place in the stream: decoding starts at all of these
checkpoints at once.  A checksum of the blob and one of the ids guard each block.

A token folder holds two tables: ``table`` (token, freq) and ``blocks`` (part, block, n_tokens,
data).  Parts are ascending ranges of doc_id, blocks ascend within a part.  Spark's own commit
makes the folder appear only when whole, whatever executors are lost.

Blob layout, little endian: magic "RANS1", then u32 n_docs, n_tokens, n_words, n_segments; per
document i64 doc_id, u8 is_null, u32 n_tokens; per segment u32 place, 1024 x u64 states; the words
(u32); u32 crc32 of the ids as u32; u32 crc32 of all before.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.llm.common import giving_back, table
from tillwise.sources.shared import settle, shared_folder

LANES = 1024
SEGMENT_STEPS = 128
SCALE_BITS = 20
BLOCK_TOKENS = 1 << 18
END_ID = 0
MAGIC = b"RANS1"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_SCALE = np.uint64(SCALE_BITS)
_SLOT = np.uint64((1 << SCALE_BITS) - 1)


# Text to ids


def per_process(key, build: Callable):
    """What ``build`` makes, kept for the life of the Python worker and not sent with the code."""
    kept = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


class _Seen(dict):
    """Numbers keys as they come; ``new`` holds those not yet learned."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = place = len(self)
        self.new.append(key)
        return place


class TextEncoder:
    """Ids of whole texts, with the ids of words that were met before looked up.

    Byte-level BPE always cuts between a printable character and the single space or newline
    after it, and never merges across the cut.  So a text is encoded as its words, each with the
    space or newline before it.  Texts with a space or newline after any other character are
    encoded whole.  Words of plain characters go straight to the library's model, cut by the
    rules of its pre-tokenizer; all others go through the whole tokenizer.
    """

    #: Where a cut is not certain: white space after white space or after an unusual character.
    UNSURE = re.compile("[^!-~À-ÿ][ \n]")
    PLAIN = re.compile("[!-~À-ÿ]+")
    # Fixed value: the pre-tokenizer's pattern, for plain characters.
    PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ A-Za-z0-9À-ÖØ-öø-ÿ]+")
    #: How byte-level BPE writes the space and the two bytes of the other plain characters.
    BYTES = {32: "Ġ"} | {
        c: "".join(chr(b if b >= 0xAE or 0xA1 <= b <= 0xAC else 0x122 + b - 0x80 if b < 0xA1 else 0x143) for b in chr(c).encode())
        for c in range(0xC0, 0x100)
    }
    MOST_SEEN = 1_200_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.look = self.model.tokenize
        whole = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.seen, self.flat = _Seen(), np.zeros(0, np.uint32)
        self.begin = self.length = self.used = np.zeros(0, np.int64)
        self.newline = whole("\n")
        # A tokenizer of another kind is used only as a whole.
        probe = [" thé", " x's", " 12,5", " (Ô)", " ~"]
        parts = [self._plain(p) for p in probe] if self.tokenizer.pre_tokenizer else []
        self.by_words = list(chain(self.newline, self._plain("ab"), *parts)) == whole("\nab" + "".join(probe))

    def _plain(self, text: str) -> list[int]:
        look = self.look
        pieces = (text,) if text[1:].isalpha() and text[0] == " " else self.PIECES.findall(text)
        return [t.id for p in pieces for t in look(p.translate(self.BYTES))]

    def _word(self, key: str) -> list[int]:
        """Ids of a key: a word (a space before it), "\\n" and a word, or " " and the first of a text."""
        if key.isascii() and key.isalpha():
            return [t.id for t in self.look("Ġ" + key)]
        mark = key[:1] if key[:1] in ("\n", " ") else ""
        if not self.PLAIN.fullmatch(key, len(mark)):
            text = key[1:] if mark == " " else key if mark else " " + key
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if mark:
            return (self.newline if mark == "\n" else []) + self._plain(key[1:])
        return self._plain(" " + key)

    def _forget(self):
        """Keep the words met more than once, the most frequent half of the table at most."""
        often = np.flatnonzero(self.used > 1)
        if len(often) > self.MOST_SEEN // 2:
            often = np.sort(often[np.argsort(-self.used[often], kind="stable")[: self.MOST_SEEN // 2]])
        keys = list(self.seen)
        self.seen = _Seen((keys[i], k) for k, i in enumerate(often.tolist()))
        self.flat, self.length = self._of(often), self.length[often]
        self.begin = np.cumsum(self.length) - self.length
        self.used = np.zeros(len(often), np.int64)

    def _of(self, place: np.ndarray) -> np.ndarray:
        """The ids of the words at ``place``, one after the other."""
        length = self.length[place]
        shift = np.repeat(self.begin[place] - (np.cumsum(length) - length), length)
        return self.flat[shift + np.arange(len(shift))]

    def _learn(self):
        new, self.seen.new = self.seen.new, []
        ids = list(map(self._word, new))
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        more = np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, more])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        if len(self.seen) > self.MOST_SEEN:
            self._forget()
        look = self.seen.__getitem__
        places = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif not self.by_words or self.UNSURE.search(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out[i] = np.array(ids, np.uint32)
            else:
                parts = text.replace("\n", " \n").split(" ")
                if parts[0]:
                    parts[0] = " " + parts[0]
                else:
                    del parts[0]
                places.append((i, np.fromiter(map(look, parts), np.int64, len(parts))))
        self._learn()
        for i, place in places:
            out[i] = self._of(place)
        if places:
            self.used += np.bincount(np.concatenate([p for _, p in places]), minlength=len(self.used))
        return out


# Ids to blobs and back


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^20, at least 1 for each id that occurs."""
    total, used = int(counts.sum()), counts > 0
    room = (1 << SCALE_BITS) - int(used.sum())
    if room < 0:
        raise ValueError(f"more than {1 << SCALE_BITS} distinct ids")
    freq = np.zeros(len(counts), np.int64)
    if total:
        freq[used] = 1 + np.floor(counts[used].astype(np.float64) / total * room).astype(np.int64)
        freq[int(counts.argmax())] += (1 << SCALE_BITS) - int(freq.sum())
    return freq


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, documents: Sequence[tuple[int | None, np.ndarray]]) -> bytes:
        ids = np.concatenate([x for _, x in documents]).astype(np.uint32)
        n = len(ids)
        steps = -(-n // LANES)
        states = np.full(LANES, _LOW, np.uint64)
        words, marks, placed = [], [], 0
        for step in range(steps - 1, -1, -1):
            here = ids[step * LANES : (step + 1) * LANES]
            freq, x = self.freq[here], states[: len(here)]
            full = x >= freq << np.uint64(63 - SCALE_BITS)
            if full.any():
                given = x[full].astype(np.uint32)
                words.append(given)
                placed += len(given)
                x = np.where(full, x >> _WORD, x)
            high = x // freq
            states[: len(here)] = (high << _SCALE) + (x - high * freq) + self.cum[here]
            if step % SEGMENT_STEPS == 0:
                marks.append((placed, states.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        out = [MAGIC, struct.pack("<4I", len(documents), n, len(stream), len(marks))]
        for doc_id, x in documents:
            out.append(struct.pack("<qBI", doc_id or 0, doc_id is None, len(x)))
        for at, kept in marks[::-1]:
            out += [struct.pack("<I", len(stream) - at), kept.astype("<u8").tobytes()]
        out += [stream.astype("<u4").tobytes(), struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes()))]
        blob = b"".join(out)
        return blob + struct.pack("<I", zlib.crc32(blob))

    def decode(self, blob: bytes) -> list[tuple[int | None, np.ndarray]]:
        if blob[:5] != MAGIC or zlib.crc32(blob[:-4]) != struct.unpack("<I", blob[-4:])[0]:
            raise ValueError("a token block is damaged")
        n_docs, n, n_words, segments = struct.unpack_from("<4I", blob, 5)
        at = 21
        documents = [struct.unpack_from("<qBI", blob, at + 13 * i) for i in range(n_docs)]
        at += 13 * n_docs
        place, x = np.zeros(segments, np.int64), np.zeros((segments, LANES), np.uint64)
        for s in range(segments):
            place[s] = struct.unpack_from("<I", blob, at)[0]
            x[s] = np.frombuffer(blob, "<u8", LANES, at + 4)
            at += 4 + 8 * LANES
        words = np.append(np.frombuffer(blob, "<u4", n_words, at).astype(np.uint64), np.uint64(0))
        ids = np.zeros((segments, SEGMENT_STEPS, LANES), np.uint32)
        first = np.arange(segments)[:, None] * (SEGMENT_STEPS * LANES) + np.arange(LANES)
        for step in range(min(SEGMENT_STEPS, -(-n // LANES))):
            live = first + step * LANES < n if segments == 1 or step else first < n
            slot = x & _SLOT
            symbol = self.symbol[slot]
            ids[:, step] = symbol
            moved = self.freq[symbol] * (x >> _SCALE) + slot - self.cum[symbol]
            need = (moved < _LOW) & live
            taken = np.cumsum(need, axis=1)
            given = words[np.minimum(place[:, None] + taken - 1, n_words)]
            x = np.where(need, (moved << _WORD) | given, moved)
            place = place + taken[:, -1]
        flat = ids.reshape(-1)[:n]
        if zlib.crc32(flat.astype("<u4").tobytes()) != struct.unpack_from("<I", blob, len(blob) - 8)[0]:
            raise ValueError("a token block does not decode to its checksum")
        cuts = np.cumsum([d[2] for d in documents])[:-1]
        parts = np.split(flat, cuts) if documents else []
        return [(None if d[1] else d[0], p) for d, p in zip(documents, parts)]


# Spark


def _pack(documents: list) -> bytes:
    """Ids between the two passes, before there is a table."""
    head = [struct.pack("<I", len(documents))]
    head += [struct.pack("<qBI", d or 0, d is None, len(x)) for d, x in documents]
    body = np.concatenate([x for _, x in documents]).astype("<u4")
    wide = 2 if body.max(initial=0) < 1 << 16 else 4
    planes = body.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()
    return b"".join(head) + bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes) -> list:
    (n,) = struct.unpack_from("<I", data, 0)
    heads = [struct.unpack_from("<qBI", data, 4 + 13 * i) for i in range(n)]
    wide = data[4 + 13 * n]
    planes = zstandard.ZstdDecompressor().decompress(data[5 + 13 * n :])
    ids = np.frombuffer(planes, np.uint8).reshape(wide, -1).T.copy().view(f"<u{wide}").ravel()
    parts = np.split(ids, np.cumsum([h[2] for h in heads])[:-1])
    return [(None if h[1] else h[0], p) for h, p in zip(heads, parts)]


BLOCKS = "part int, block int, n_tokens bigint, data binary"
_NAMES = ["part", "block", "n_tokens", "data"]


def _tokenise(path: str, block_tokens: int, keep_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build = lambda: TextEncoder(path)
        encoder = per_process(("encoder", path), build) if keep_words else build()
        part, block = TaskContext.get().partitionId(), 0
        documents, size, counts = [], 0, np.zeros(0, np.int64)

        def full():
            nonlocal counts
            more = np.bincount(np.concatenate([x for _, x in documents]), minlength=len(counts))
            more[: len(counts)] += counts
            counts = more
            row = [[part], [block], [size], [_pack(documents)]]
            types_ = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types_)], names=_NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                few = batch.slice(at, 2000)
                ids = encoder.encode(few.column("text").to_pylist())
                for doc_id, x in zip(few.column("doc_id").to_pylist(), ids):
                    documents.append((doc_id, np.append(x, np.uint32(END_ID))))
                    size += len(x) + 1
                    if size >= block_tokens:
                        yield full()
                        documents, size, block = [], 0, block + 1
        if documents:
            yield full()
        # A last row without tokens: the counts of all ids of the task.
        data = zlib.compress(counts.astype("<i8").tobytes())
        row = [[part], [-1], [0], [data]]
        types_ = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types_)], names=_NAMES)

    return run if keep_words else giving_back(run)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data"):
            counts = np.frombuffer(zlib.decompress(data.as_py()), "<i8")
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["token", "n"])


def _coder(shared) -> Coder:
    """The coder of the folder at hand; a worker keeps one."""
    name, freq = shared.value
    kept = per_process("coder", dict)
    if name not in kept:
        kept.clear()
        kept[name] = Coder(freq)
    return kept[name]


def _share(spark: SparkSession, tokens: DataFrame):
    """The table as a broadcast; it has a row per id of the vocabulary, 2^20 at most."""
    rows = tokens.limit(1 << SCALE_BITS).collect()
    freq = np.zeros(max([r["token"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        freq[r["token"]] = r["freq"]
    return spark.sparkContext.broadcast((uuid.uuid4().hex, freq))


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    block_tokens: int = BLOCK_TOKENS,
    order: Sequence[Column] | None = None,
    keep_words: bool = True,
) -> None:
    """Write the ids of ``docs`` to a new token folder.

    Null and empty texts consist of the end id alone.  Documents are written by ascending doc_id,
    null first; rows that share a doc_id are ordered by text and all written.  Or they are written
    by ``order``, columns that should tell rows apart.  Other columns are not read.  An
    empty table gives an empty folder of the same form.  Python workers keep the words they have
    met for their next task, some 200 MB at most, or drop them with each task.
    """
    spark = docs.sparkSession
    narrow = [F.col("doc_id").cast("bigint").alias("doc_id"), "text"]
    if order is None:
        by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
        ordered = docs.select(*narrow).repartitionByRange(*by[:2]).sortWithinPartitions(*by)
    else:
        names = [f"__order_{k}" for k in range(len(order))]
        placed = docs.select(*narrow, *[c.alias(n) for c, n in zip(order, names)])
        placed = placed.repartitionByRange(*names).sortWithinPartitions(*names)
        ordered = placed.select("doc_id", "text")
    stored = settle(ordered.mapInArrow(_tokenise(tokenizer, block_tokens, keep_words), BLOCKS))
    raw, counts = stored.filter("block >= 0"), stored.filter("block < 0").select("data")
    counts = counts.mapInArrow(_count, "token bigint, n bigint")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(max([r["token"] for r in counts], default=0) + 1, np.int64)
    for r in counts:
        seen[r["token"]] = r["n"]
    freq = scaled(seen)
    rows = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    tokens = spark.createDataFrame(rows, "token bigint, freq bigint")
    tokens.coalesce(1).write.parquet(f"{folder}/table")
    shared = _share(spark, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for i in range(batch.num_rows):
                blob = coder.encode(_unpack(batch.column("data")[i].as_py()))
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([blob], pa.binary())], names=_NAMES)

    raw.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (u32, little
    endian) of each document in a token folder; blocks are decoded independently."""
    shared = _share(spark, spark.read.schema("token bigint, freq bigint").parquet(f"{folder}/table"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    per_part = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    earlier = F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("of"), F.coalesce(earlier, F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(per_part), F.lit(0))
    index = sizes.withColumn("within", within).join(parts, F.col("part") == F.col("of"))
    index = settle(
        index.select(
            F.col("part").alias("__part"), F.col("block").alias("__block"), (F.col("before") + F.col("within")).alias("start")
        )
    )
    placed = blocks.join(index, (F.col("part") == F.col("__part")) & (F.col("block") == F.col("__block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                documents = coder.decode(data.as_py())
                lengths = np.array([len(x) for _, x in documents], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in documents], pa.int64()),
                        pa.array(start + np.cumsum(lengths) - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for _, x in documents], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.select("start", "data").mapInArrow(giving_back(run), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


def digests(docs: DataFrame, **options) -> DataFrame:
    """Write the documents as a token folder, read it back, and describe each document's ids."""
    spark = docs.sparkSession
    folder = new_folder(spark)
    write_tokens(docs, folder, tokenizer_path(), **options)
    return read_tokens(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op1_range_ans(spark, folder):
    return digests(table(spark, folder, "documents"))
