"""Language-model scoring: a small causal self-attention model over subword ids, in numpy.

Texts become ids of a public byte-level vocabulary (no training of tokenizers), closed by an end
id.  Frequent ids are classes of their own; the others share classes by leading space and
frequency.  The model gives P(class | context): attention, a hidden layer and, as the output's
bias, the counts of classes after the last two classes.  Counts also give P(id | class, last
class), so every text has a proper probability.  All counts are over all training texts.

Context windows of 32 positions overlap by half: a block of 16 positions is scored once and
attends to itself, causally, and to the 16 positions before it, all blocks of a batch in one
masked attention.  The weights start from a fit on a bounded number of training texts and are
then refined where the data lie: in each round every task runs gradient steps over its share of
the round's training texts, over all rounds each text once, and the weights are averaged by the number of steps.

The base score needs the count of every word in the training texts.  Words that are frequent in
some task are counted in a table of bounded size; all others, each of which is rare, are
shuffled by word to be counted and by document to be summed.  Words are 64-bit hashes.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.llm.common import table
from tillwise.llm.shingles import word_hashes
from tillwise.llm.token_files import per_process, tokenizer_path
from tillwise.sources.shared import settle

CLASSES = 160
SINGLE = 128
WIDTH = 16
HIDDEN = 32
BLOCK = 16
CHUNK = 128
RATE = 0.01
#: Texts of the first fit, about, and its ids, at most: the bound of what the driver trains on.
FIRST_TEXTS = 3000
FIRST_IDS = 3_000_000
FIRST_STEPS = 1500
STEP_BLOCKS = 128
#: Rounds of gradient steps; each training text has its round by hash.
ROUNDS = 8
#: Weight of the shorter context in the counts of the longer one, for classes and for ids.
BACK_OFF = 6.0
ID_BACK_OFF = 2.0
#: Words that a task names as frequent, and how many words the common table holds.
TASK_WORDS = 16_384
TABLE_WORDS = 131_072
VOCABULARY = 50_257
END = 50_256


class Encoder:
    """Byte-level BPE ids of many texts; each word, with the space before it, is encoded once a call.

    The pattern always cuts before a space that stands after something other than white space, and
    what comes after the cut does not depend on what is before.  Texts with a space at an end, or
    after white space or a rarer character, are encoded whole.
    """

    # The plain characters are printable ASCII and Latin-1 letters.
    UNSURE = re.compile(r" (?:(?<![!-~À-ÿ] )|\Z)")
    PLAIN = re.compile("[!-~À-ÿ]")
    ONLY_SPACE = bytes(range(256))

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        by_words = [i for i, t in enumerate(texts) if self.PLAIN.match(t[-1:]) and not self.UNSURE.search(t)]
        heads, _, rests = zip(*(texts[i].partition(" ") for i in by_words)) if by_words else ((), (), ())
        words = [w for r in rests if r for w in r.split(" ")]
        hashes, ends = word_hashes(rests, self.ONLY_SPACE)
        _, at, place = np.unique(hashes, return_index=True, return_inverse=True)
        each = [words[i] for i in at.tolist()]
        ids = np.array(self.whole("".join([" " + w for w in each])), np.int64)
        # Where each word ends among the ids, by bytes.
        bytes_of = np.cumsum([1 + len(w.encode()) for w in each])
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), bytes_of) + 1
        length = np.diff(cuts, prepend=0)
        begin, length = (cuts - length)[place], length[place]
        size = np.concatenate([[0], np.cumsum(length)])
        flat = ids[np.repeat(begin - size[:-1], length) + np.arange(size[-1])]
        out: list = [None] * len(texts)
        for i, head, rest in zip(by_words, heads, np.split(flat, size[ends])):
            out[i] = np.concatenate([np.array(self.whole(head), np.int64), rest, [END]]).astype(np.uint16)
        for i, text in enumerate(texts):
            if out[i] is None:
                out[i] = np.array([*self.whole(text), END], np.uint16)
        return out


def spaced_ids(path: str) -> np.ndarray:
    """Which ids begin with a space."""
    out = np.zeros(VOCABULARY, bool)
    with open(path, "rb") as lines:
        for a, b in map(bytes.split, lines):
            out[int(b)] = base64.b64decode(a).startswith(b" ")
    return out


# Classes


def classes_of(counts: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, P(id | class)) from the training counts; 0.5 is added to each."""
    mass = counts + 0.5
    order = np.lexsort((np.arange(len(counts)), -counts))
    alone = [END, *[i for i in order.tolist() if i != END][: SINGLE - 1]]
    kind = np.full(len(counts), -1)
    kind[alone] = np.arange(SINGLE)
    half = (CLASSES - SINGLE) // 2
    for flag in (0, 1):
        rest = order[(kind[order] < 0) & (spaced[order] == bool(flag))]
        part = np.cumsum(mass[rest])
        kind[rest] = SINGLE + flag * half + np.minimum(half - 1, (part / part[-1] * half).astype(int))
    total = np.bincount(kind, mass, CLASSES)
    return kind, mass / total[kind]


# The model

SHAPES = {
    "E": (CLASSES, WIDTH),
    "QKV": (WIDTH, 3 * WIDTH),
    "O": (WIDTH, WIDTH),
    "B": (2 * BLOCK,),
    "W1": (WIDTH, HIDDEN),
    "W2": (HIDDEN, WIDTH),
    "U": (WIDTH, CLASSES),
    "u": (CLASSES,),
}
_OFFSET = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
_AHEAD = _OFFSET < 0
#: Exponents whose size has this bound need no shift.
_SAFE = 30


class Counts:
    """What the training texts say: ln P(class | last two classes) and ln P(id | class, last class)."""

    def __init__(self, kind: np.ndarray, inside: np.ndarray, triples: np.ndarray, after: np.ndarray):
        triples = triples.reshape(CLASSES, CLASSES, CLASSES)
        pairs = triples.sum(0)
        single = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
        double = (pairs + BACK_OFF * single) / (pairs.sum(1, keepdims=True) + BACK_OFF)
        triple = (triples + BACK_OFF * double) / (triples.sum(2, keepdims=True) + BACK_OFF)
        self.prior = np.log(triple).astype(np.float32).reshape(-1, CLASSES)
        self.kind = kind
        # Only ids that occur have columns of their own; the last column stands for all others.
        after = after.reshape(CLASSES, -1)
        used = np.flatnonzero(after.any(0))
        self.column = np.full(len(kind), len(used))
        self.column[used] = np.arange(len(used))
        total = pairs[:, kind[used]] + ID_BACK_OFF
        self.inside = np.log((after[:, used] + ID_BACK_OFF * inside[used]) / total).astype(np.float32)
        self.inside = np.concatenate([self.inside, np.zeros((CLASSES, 1), np.float32)], 1)
        self.unseen = np.log(ID_BACK_OFF * inside)
        self.unseen_total = np.log(pairs + ID_BACK_OFF)

    def within(self, ids: np.ndarray, classes: np.ndarray, last: np.ndarray) -> float:
        """Sum of ln P(id | class, last class) over a text."""
        column = self.column[ids]
        found = self.inside[last, column].sum(dtype=np.float64)
        new = np.flatnonzero(column == self.inside.shape[1] - 1)
        if len(new):
            found += (self.unseen[ids[new]] - self.unseen_total[last[new], classes[new]]).sum()
        return found


def new_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.3 / math.sqrt(WIDTH) if k != "E" else 0.3, s).astype(np.float32) for k, s in SHAPES.items()}
    w["B"][:] = -0.05 * np.arange(2 * BLOCK)
    w["U"] *= np.float32(0.1)
    w["u"][:] = 0
    return w


def blocks_of(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(inputs, targets, real, first, text) of class sequences that end with the end class 0.

    Each text starts a new block; its first input is the end class."""
    sizes = np.array([len(t) for t in texts], np.int64)
    wide = -(-sizes // BLOCK) * BLOCK
    begin = np.cumsum(wide) - wide
    inputs = np.zeros(int(wide.sum()), np.int64)
    targets = np.zeros_like(inputs)
    real = np.zeros(len(inputs), bool)
    for at, t in zip(begin.tolist(), texts):
        targets[at : at + len(t)] = t
        inputs[at + 1 : at + len(t)] = t[:-1]
        real[at : at + len(t)] = True
    first = np.zeros(len(inputs) // BLOCK, bool)
    first[begin // BLOCK] = True
    owner = np.repeat(np.arange(len(texts)), wide // BLOCK)
    shape = (-1, BLOCK)
    return inputs.reshape(shape), targets.reshape(shape), real.reshape(shape), first, owner


def windows(of_class: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The rows of each block's classes and of those of the block before, as a view; zeros come before the first."""
    rows = np.zeros((BLOCK + len(classes), WIDTH), of_class.dtype)
    of_class.take(classes, 0, rows[BLOCK:], "clip")
    row, cell = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (len(classes) // BLOCK, 2 * BLOCK, WIDTH), (BLOCK * row, row, cell))


def longest(rows: np.ndarray) -> float:
    return math.sqrt(np.vecdot(rows, rows).max(initial=0))


def prepared(w: dict) -> dict:
    """The weights and what follows from them alone, for ``forward``.

    Queries, keys and values depend on the class alone: they are computed once per class."""
    q, k, v = (np.ascontiguousarray(part) for part in np.split(w["E"] @ w["QKV"], 3, axis=1))
    q *= 1 / math.sqrt(WIDTH)
    bias = w["B"][np.maximum(_OFFSET, 0)]
    # The bias of the output as one more row, for a column of ones.
    out = np.concatenate([w["U"], w["u"][None]]) if "u" in w else w["U"]
    return w | {
        "of_class": (q, k, v),
        "bias": np.where(_AHEAD, -np.inf, bias).astype(bias.dtype),
        "factors": np.where(_AHEAD, 0, np.exp(np.minimum(bias, _SAFE))),
        "is_safe": longest(q) * longest(k) + np.abs(bias).max() < _SAFE,
        "out": out,
        "out_length": longest(out.T),
    }


def forward(w: dict, prior: np.ndarray, inputs: np.ndarray, first: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits (positions, classes).  The block before ``inputs[i]`` is ``inputs[i - 1]``; a block
    with ``first`` attends to itself only."""
    w = w if "of_class" in w else prepared(w)
    flat = inputs.ravel()
    q, k, v = w["of_class"]
    q, k, v = q.take(flat, 0).reshape(-1, BLOCK, WIDTH), windows(k, flat), windows(v, flat)
    s = np.matmul(q, k.transpose(0, 2, 1))
    if w["is_safe"]:
        p = np.exp(s, out=s)
        p *= w["factors"]
        p[first, :, :BLOCK] = 0
    else:
        s += w["bias"]
        s[first, :, :BLOCK] = -np.inf
        s -= s.max(-1, keepdims=True)
        p = np.exp(s, out=s)
    total = p.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, p.dtype)
    a = np.matmul(p, v).reshape(-1, WIDTH)
    a /= total[:, None]
    x = w["E"].take(flat, 0)
    h = a @ w["O"]
    h += x
    m = h @ w["W1"]
    np.maximum(m, 0, out=m)
    g = m @ w["W2"]
    g += h
    if "u" in w:
        g = np.concatenate([g, np.ones((len(g), 1), g.dtype)], 1)
    if keep is not None:
        keep.update(x=x, q=q, k=k, v=v, p=p, total=total, a=a, h=h, m=m, g=g)
    before = np.zeros_like(inputs)
    before[:, 1:] = inputs[:, :-1]
    before[1:, 0] = inputs[:-1, -1]
    before[first, 0] = 0
    before *= CLASSES
    before += inputs
    z = g @ w["out"]
    z += prior.take(before.ravel(), 0)
    # Log-probabilities with a small correction: a shift is hardly ever needed.
    if longest(g) * w["out_length"] > _SAFE:
        z -= z.max(1, keepdims=True)
    return z


def log_probability(w: dict, prior: np.ndarray, inputs, targets, first) -> np.ndarray:
    """ln P(class | context) of each position, block by block."""
    out = np.zeros(targets.shape, np.float32)
    ones = np.ones(CLASSES, prior.dtype)
    w = prepared(w)
    for at in range(0, len(inputs), CHUNK):
        # One block more in front gives the context of the first; it is scored in its own chunk.
        low = max(0, at - 1)
        starts = first[low : at + CHUNK]
        z = forward(w, prior, inputs[low : at + CHUNK], starts)[(at - low) * BLOCK :]
        here = targets[at : at + CHUNK].ravel()
        picked = z[np.arange(len(here)), here]
        total = np.exp(z, out=z) @ ones
        out[at : at + CHUNK] = (picked - np.log(total)).reshape(-1, BLOCK)
    return out


def gradients(w: dict, prior: np.ndarray, inputs, targets, real, first) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log-probability."""
    t: dict = {}
    z = forward(w, prior, inputs, first, t)
    e = np.exp(z, out=z)
    each = e @ np.ones(CLASSES, e.dtype)
    e[np.arange(len(e)), targets.ravel()] -= each
    # The factor of a row is applied to the narrow sides of the products.
    factor = (real.ravel() / max(1, real.sum()) / each).astype(e.dtype)
    last = (e.T @ (t["g"] * factor[:, None])).T
    out = {"U": last[:WIDTH], "u": last[WIDTH]}
    dg = e @ w["U"].T
    dg *= factor[:, None]
    dm = dg @ w["W2"].T
    dm *= t["m"] > 0
    out["W2"], out["W1"] = t["m"].T @ dg, t["h"].T @ dm
    dh = dm @ w["W1"].T
    dh += dg
    out["O"] = t["a"].T @ dh
    da = dh @ w["O"].T
    da /= t["total"][:, None]
    inner = np.vecdot(da, t["a"]).reshape(-1, BLOCK, 1)
    da = da.reshape(len(inputs), BLOCK, WIDTH)
    ds = np.matmul(da, t["v"].transpose(0, 2, 1))
    ds -= inner
    ds *= t["p"]
    out["B"] = np.bincount(np.maximum(_OFFSET, 0).ravel(), ds.sum(0).ravel(), 2 * BLOCK)
    dq = np.matmul(ds, t["k"]).reshape(-1, WIDTH)
    both = np.empty((len(inputs), 2 * BLOCK, 2 * WIDTH), e.dtype)
    np.matmul(ds.transpose(0, 2, 1), t["q"], out=both[:, :, :WIDTH])
    np.matmul(t["p"].transpose(0, 2, 1), da, out=both[:, :, WIDTH:])
    both[:-1, BLOCK:] += both[1:, :BLOCK]
    dkv = both[:, BLOCK:].reshape(-1, 2 * WIDTH)
    part = 1 / math.sqrt(WIDTH)
    out["QKV"] = np.concatenate([t["x"].T @ dq * part, t["x"].T @ dkv], 1)
    dx = dkv @ w["QKV"][:, WIDTH:].T
    dx += dq @ (w["QKV"][:, :WIDTH].T * part)
    dx += dh
    cells = (inputs.ravel() * WIDTH)[:, None] + np.arange(WIDTH)
    out["E"] = np.bincount(cells.ravel(), dx.ravel(), CLASSES * WIDTH).reshape(CLASSES, WIDTH)
    return out


def train(w: dict, prior: np.ndarray, texts: Sequence[np.ndarray], most_steps: int | None = None, seed: int = 1) -> int:
    """Adam steps over the texts' blocks, in place; once over all of them, or ``most_steps``."""
    if not len(texts):
        return 0
    inputs, targets, real, first, _ = blocks_of(texts)
    rng = np.random.default_rng(seed)
    groups = -(-len(inputs) // STEP_BLOCKS)
    # All weights as one array, of which ``mine`` has the parts.
    flat = np.concatenate([v.ravel() for v in w.values()])
    cuts = np.cumsum([v.size for v in w.values()])[:-1]
    mine = {k: part.reshape(w[k].shape) for k, part in zip(w, np.split(flat, cuts))}
    one, two = np.zeros_like(flat), np.zeros_like(flat)
    steps, step = most_steps or groups, 0
    while step < steps:
        for g in rng.permutation(groups)[: steps - step]:
            part = slice(g * STEP_BLOCKS, (g + 1) * STEP_BLOCKS)
            starts = first[part].copy()
            starts[0] = True
            d = gradients(mine, prior, inputs[part], targets[part], real[part], starts)
            d = np.concatenate([d[k].ravel() for k in w], dtype=flat.dtype)
            step += 1
            rate = RATE * (1 - 0.9 * step / steps) * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            one *= 0.9
            one += 0.1 * d
            two *= 0.99
            two += 0.01 * d * d
            flat -= rate * one / (np.sqrt(two) + 1e-8)
    for k in w:
        w[k][...] = mine[k]
    return step


# Spark

ENCODED = "kind int, doc_id bigint, print bigint, held_out boolean, ids binary, key bigint, n bigint"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = ["kind", "doc_id", "print", "held_out", "ids", "key", "n"]
DOC, WORD, ID = 0, 1, 2


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _counts(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    none = [None] * len(keys)
    return _rows([kind] * len(keys), none, none, none, none, keys, n)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _print(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, n, len(found)).astype(np.int64)


def encoded(docs: DataFrame, ranks: str) -> DataFrame:
    """Per document its ids; per task its frequent training words and all its training ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_process(("ranks", ranks), lambda: Encoder(ranks)).encode
        id_counts = np.zeros(VOCABULARY, np.int64)
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 1500):
                few = batch.slice(at, 1500)
                texts = few.column("text").to_pylist()
                held = few.column("held_out").to_pylist()
                # Fewer texts a call bound the memory of their words.
                ids = [x for k in range(0, len(texts), 500) for x in encode([t or "" for t in texts[k : k + 500]])]
                learned = [x for x, h in zip(ids, held) if not h]
                if learned:
                    id_counts += np.bincount(np.concatenate(learned), minlength=VOCABULARY)
                    hashes, _ = word_hashes([t for t, h in zip(texts, held) if not h])
                    found, n = np.unique(hashes, return_counts=True)
                    words, counts = _merged(np.concatenate([words, found]), np.concatenate([counts, n]))
                    if len(words) > 20 * TASK_WORDS:
                        often = np.argpartition(-counts, 10 * TASK_WORDS)[: 10 * TASK_WORDS]
                        words, counts = words[often], counts[often]
                none = [None] * len(ids)
                data = [pack(x.view(np.uint8).reshape(-1, 2).T.tobytes()) for x in ids]
                prints = list(map(_print, texts))
                yield _rows([DOC] * len(ids), few.column("doc_id").to_pylist(), prints, held, data, none, none)
        often = np.argsort(-counts, kind="stable")[:TASK_WORDS]
        yield _counts(WORD, words[often].view(np.int64), counts[often])
        used = np.flatnonzero(id_counts)
        yield _counts(ID, used, id_counts[used])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return narrow.mapInArrow(run, ENCODED)


def _ids(data) -> np.ndarray:
    unpack = per_process("unpack", lambda: zstandard.ZstdDecompressor().decompress)
    raw = unpack(data.as_py())
    return np.frombuffer(raw, np.uint8).reshape(2, -1).T.copy().view(np.uint16).ravel().astype(np.int64)


def _class_texts(batch: pa.RecordBatch, kind: np.ndarray) -> list[np.ndarray]:
    return [kind[_ids(data)] for data in batch.column("ids")]


CHUNK_CELLS = 1 << 16


def counted(documents: DataFrame, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of three classes in a row and of ids after classes, over all training documents.

    Tables of a fixed number of cells: tasks give them off in compressed pieces, which are added
    piece by piece."""
    sizes = (CLASSES**3, CLASSES * VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(-(-n // CHUNK_CELLS) * CHUNK_CELLS, np.uint32) for n in sizes]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids = [_ids(d) for d in batch.slice(at, 500).column("ids")]
                rows = [np.concatenate([[0, 0], kind[x]]) for x in ids]
                one, two, now = (np.concatenate([r[k : len(r) - 2 + k] for r in rows]) for k in range(3))
                for t, cells in zip(tables, ((one * CLASSES + two) * CLASSES + now, two * VOCABULARY + np.concatenate(ids))):
                    places, n = np.unique(cells, return_counts=True)
                    t[places] += n.astype(np.uint32)
        for which, t in enumerate(tables):
            for piece, part in enumerate(t.reshape(-1, CHUNK_CELLS)):
                if part.any():
                    data = zlib.compress(part.astype("<u4").tobytes(), 1)
                    columns = [pa.array([which], pa.int32()), pa.array([piece], pa.int32()), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["of", "piece", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for which, piece, data in zip(*(batch.column(c).to_pylist() for c in ("of", "piece", "data"))):
                part = np.frombuffer(zlib.decompress(data), "<u4").astype(np.uint64)
                sums[which, piece] = sums.get((which, piece), 0) + part
        for (which, piece), part in sums.items():
            data = zlib.compress(part.astype("<u8").tobytes(), 1)
            columns = [pa.array([which], pa.int32()), pa.array([piece], pa.int32()), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["of", "piece", "data"])

    schema = "of int, piece int, data binary"
    pieces = documents.filter("not held_out").select("ids").mapInArrow(count, schema)
    tables = [np.zeros(-(-n // CHUNK_CELLS) * CHUNK_CELLS, np.uint64) for n in sizes]
    for r in pieces.repartition("of", "piece").mapInArrow(add, schema).toLocalIterator():
        begin = r["piece"] * CHUNK_CELLS
        tables[r["of"]][begin : begin + CHUNK_CELLS] = np.frombuffer(zlib.decompress(r["data"]), "<u8")
    return tables[0][: sizes[0]], tables[1][: sizes[1]]


def of_round(learned: DataFrame, turn: int) -> DataFrame:
    """The training documents of a round; the rounds together hold each of them once."""
    return learned.filter(F.pmod(F.xxhash64("doc_id", "print"), F.lit(ROUNDS)) == turn)


def fit(documents: DataFrame, known: Counts) -> dict[str, np.ndarray]:
    """Weights from the training documents' ids."""
    kind, prior = known.kind, known.prior
    learned = documents.filter("not held_out")
    part = max(1, learned.count() // FIRST_TEXTS)
    place = F.xxhash64("doc_id", "print", F.lit("first"))
    # In the order of the hash, so that the end at ``FIRST_IDS`` favours no partition.
    first = learned.filter(F.pmod(place, F.lit(part)) == 0).orderBy(place).select("ids")
    texts: list[np.ndarray] = []
    size = 0
    for r in first.toLocalIterator():
        texts.append(kind[_ids(pa.scalar(bytes(r["ids"])))])
        size += len(texts[-1])
        if size > FIRST_IDS:
            break
    w = new_weights()
    train(w, prior, texts, FIRST_STEPS)
    shared = documents.sparkSession.sparkContext.broadcast((kind, prior))
    names, sizes = list(SHAPES), [int(np.prod(s)) for s in SHAPES.values()]
    for turn in range(ROUNDS):
        chosen = of_round(learned, turn).select("ids")
        now = {k: v.copy() for k, v in w.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind, prior = shared.value
            mine = {k: v.copy() for k, v in now.items()}
            steps = 0
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    steps += train(mine, prior, _class_texts(batch.slice(at, 500), kind))
            if steps:
                flat = np.concatenate([mine[k].ravel() for k in names]).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat))), pa.array(flat * steps), pa.array(np.full(len(flat), steps))],
                    names=["slot", "value", "steps"],
                )

        sums = chosen.mapInArrow(run, "slot bigint, value double, steps bigint")
        # Rounded before the sum: whole numbers, so the average does not depend on the order.
        sums = sums.groupBy("slot").agg(
            F.sum(F.round(F.col("value") * 1e6).cast("decimal(38,0)")).alias("value"), F.sum("steps").alias("steps")
        )
        rows = sums.collect()
        if rows:
            flat = np.concatenate([w[k].ravel() for k in names])
            for r in rows:
                flat[r["slot"]] = float(r["value"]) / 1e6 / r["steps"]
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            w = {k: p.reshape(SHAPES[k]).astype(np.float32) for k, p in zip(names, parts)}
    return w


def model_scores(documents: DataFrame, w: dict, known: Counts) -> DataFrame:
    """``doc_id``, ``print`` and ``score`` (log10 of the text's probability)."""
    shared = documents.sparkSession.sparkContext.broadcast(known.__dict__)

    # Shifted, which changes no probability, so that no logit is far above 0.
    w, last_bias = {k: v for k, v in w.items() if k != "u"}, w["u"] - w["u"].max()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts.__new__(Counts)
        known.__dict__.update(shared.value)
        known.prior = known.prior + last_bias
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                few = batch.slice(at, 200)
                ids = [_ids(d) for d in few.column("ids")]
                classes = [known.kind[x] for x in ids]
                inputs, targets, real, first, owner = blocks_of(classes)
                found = log_probability(w, known.prior, inputs, targets, first)
                sums = np.where(real, found, 0).sum(1, dtype=np.float64)
                last = [np.concatenate([[0], y[:-1]]) for y in classes]
                inside = [known.within(x, y, z) for x, y, z in zip(ids, classes, last)]
                total = np.bincount(owner, sums, len(ids)) + inside
                yield pa.RecordBatch.from_arrays(
                    [few.column("doc_id"), few.column("print"), pa.array(total / math.log(10), pa.float64())],
                    names=["doc_id", "print", "score"],
                )

    return documents.select("doc_id", "print", "ids").mapInArrow(run, "doc_id bigint, print bigint, score double")


COUNTED = (
    "kind int, doc_id bigint, print bigint, held_out boolean, uid bigint, n_tokens bigint, places binary, "
    "key bigint, n bigint"
)
_COUNTED_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
_COUNTED_NAMES = "kind doc_id print held_out uid n_tokens places key n".split()


def base_scores(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Per row ``doc_id``, ``print``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens`` and
    ``base_score``.  ``frequent``: sorted hashes of the words of the common table."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        common = np.zeros(len(frequent) + 1, np.int64)
        uid = TaskContext.get().partitionId() << 33
        types = dict(zip(_COUNTED_NAMES, _COUNTED_TYPES))
        pack = zstandard.ZstdCompressor(level=1).compress

        def rows(size, **columns):
            full = [pa.array(columns[c], types[c]) if c in columns else pa.nulls(size, types[c]) for c in _COUNTED_NAMES]
            return pa.RecordBatch.from_arrays(full, names=_COUNTED_NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                few = batch.slice(at, 500)
                texts, held = few.column("text").to_pylist(), np.array(few.column("held_out").to_pylist())
                hashes, ends = word_hashes(texts)
                sizes = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(len(texts)), sizes)
                place = np.searchsorted(frequent, hashes)
                place[place == len(frequent)] = 0
                known = (frequent[place] == hashes) if len(frequent) else np.zeros(len(hashes), bool)
                common += np.bincount(
                    np.append(place[known & ~held[owner]], np.full(int((~held).sum()), len(frequent))), minlength=len(common)
                )
                # Frequent words as (place, times) per text, to be looked up when all are counted.
                cells, n = np.unique(owner[known] * len(common) + place[known], return_counts=True)
                cuts = np.searchsorted(cells, np.arange(len(texts) + 1) * len(common))
                pairs = np.stack([cells % len(common), n], 1).astype("<u4")
                packed = [pack(pairs[a:b].T.tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
                yield rows(
                    len(texts),
                    kind=[DOC] * len(texts),
                    doc_id=few.column("doc_id"),
                    print=list(map(_print, texts)),
                    held_out=held,
                    uid=uid + np.arange(len(texts)),
                    n_tokens=sizes + 1,
                    places=packed,
                )
                rare = np.flatnonzero(~known)
                if len(rare):
                    order = np.lexsort((hashes[rare], owner[rare]))
                    o, h = owner[rare][order], hashes[rare][order]
                    new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))
                    times = np.diff(new, append=len(o))
                    yield rows(
                        len(new), kind=np.full(len(new), WORD), uid=uid + o[new], held_out=held[o[new]], key=h[new].view(np.int64), n=times
                    )
                uid += len(texts)
        used = np.flatnonzero(common)
        yield rows(len(used), kind=[ID] * len(used), key=used, n=common[used])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", is_held_out(F.col("doc_id")).alias("held_out"))
    stored = settle(narrow.mapInArrow(run, COUNTED))
    table_counts = np.zeros(len(frequent) + 1, np.int64)
    for r in stored.filter(F.col("kind") == ID).groupBy("key").agg(F.sum("n").alias("n")).collect():
        table_counts[r["key"]] = r["n"]
    # Every other word: its count over the training texts beside each of its occurrences.
    of_word = W.partitionBy("key")
    rare = stored.filter(F.col("kind") == WORD).select("key", "uid", "n", "held_out")
    learned = F.when(~F.col("held_out"), F.col("n")).otherwise(F.lit(0))
    rare = rare.withColumn("c", F.sum(learned).over(of_word)).withColumn(
        "lead", F.row_number().over(of_word.orderBy("uid")) == 1
    )
    per_doc = settle(
        rare.groupBy("uid").agg(
            # In thousand millionths, so that sums do not depend on their order.
            F.sum(F.round(F.log10(F.col("c") + 0.5) * F.col("n") * 1e9).cast("bigint")).alias("logs"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
            F.sum(learned).alias("learned"),
            F.sum(F.when(F.col("lead") & (F.col("c") > 0), 1).otherwise(0)).alias("distinct"),
        )
    )
    sums = per_doc.agg(F.sum("learned"), F.sum("distinct")).first()
    total = int(table_counts.sum()) + int(sums[0] or 0)
    distinct = int((table_counts > 0).sum()) + int(sums[1] or 0)
    scale = math.log10(total + 0.5 * (distinct + 1))
    values = context.broadcast((np.log10(table_counts + 0.5), table_counts > 0))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, known = values.value
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sums = []
            for data in batch.column("places"):
                place, n = np.frombuffer(unpack(data.as_py()), "<u4").reshape(2, -1).astype(np.int64)
                # The end of the text is the last entry of the table.
                sums.append((float((logs[place] * n).sum() + logs[-1]), int((known[place] * n).sum()) + int(known[-1])))
            names = ["doc_id", "print", "held_out", "n_tokens", "of"]
            columns = [batch.column(c) for c in ("doc_id", "print", "held_out", "n_tokens", "uid")]
            columns += [pa.array([s for s, _ in sums], pa.float64()), pa.array([k for _, k in sums], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "table_logs", "table_known"])

    whole = stored.filter(F.col("kind") == DOC).select("doc_id", "print", "held_out", "n_tokens", "uid", "places")
    whole = whole.mapInArrow(
        look_up, "doc_id bigint, print bigint, held_out boolean, n_tokens bigint, of bigint, table_logs double, table_known bigint"
    )
    joined = whole.join(per_doc, F.col("of") == F.col("uid"), "left")
    logs = F.col("table_logs") + F.coalesce(F.col("logs"), F.lit(0)) / 1e9
    return joined.select(
        "doc_id",
        "print",
        "held_out",
        "n_tokens",
        (F.col("table_known") + F.coalesce(F.col("known"), F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
    )


def score(docs: DataFrame, ranks: str) -> DataFrame:
    """Base and model scores of every row of ``docs``.

    Training texts are those whose crc32(doc_id as text) mod 5 is not 1.  Null and empty texts
    consist of their end alone; a null doc_id counts as the empty text; repeated rows count as
    often as they stand and have equal scores.  Without training texts every count is 0 and the
    model keeps its first weights.  Other columns are not read; an empty table gives no rows.
    """
    stored = settle(encoded(docs, ranks))
    spaced = spaced_ids(ranks)
    counts = np.zeros(VOCABULARY, np.int64)
    for r in stored.filter(F.col("kind") == ID).groupBy("key").agg(F.sum("n").alias("n")).collect():
        counts[r["key"]] = r["n"]
    words = stored.filter(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n"))
    words = words.orderBy(F.desc("n"), "key").limit(TABLE_WORDS).select("key").toPandas()["key"].to_numpy(np.int64)
    frequent = np.sort(words.view(np.uint64))
    kind, inside = classes_of(counts, spaced)
    documents = stored.filter(F.col("kind") == DOC)
    known = Counts(kind, inside, *counted(documents, kind))
    scores = model_scores(documents, fit(documents, known), known).groupBy("doc_id", "print").agg(F.min("score").alias("score"))
    scores = settle(scores).select(F.col("doc_id").alias("__doc_id"), F.col("print").alias("__print"), "score")
    base = base_scores(docs, frequent)
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("print") == F.col("__print"))
    return base.join(scores, on).drop("__doc_id", "__print", "print")


def op4_attention_score(spark, folder):
    return score(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
