"""Periodic runs, importance draw and line dedup against plain versions and on odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_text_operators import CLASH, ODD, SCHEMA, SMALL, _framed, _got, _pairs, _sorted, _table, none, odd  # noqa: F401
from tillwise.llm import line_dedup, queries, resample, runs

NEW = ("op11_periodic_runs", "op12_importance_draw", "op13_line_dedup")


@pytest.mark.parametrize("name", NEW)
def test_sql_exactly(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    ours = queries.QUERIES[name](spark, SMALL)
    theirs = con.sql(queries.ORACLE_SQL[name])
    places = [theirs.columns.index(c) for c in ours.columns]
    assert _got(ours) == _sorted([tuple(r[i] for i in places) for r in theirs.fetchall()])


# 11


def plain_runs(words):
    """(start, length, period) by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _made(rng):
    n, letters = rng.choice([0, 1, 5, 6, 7, 30, 200, 400]), rng.choice([1, 2, 3, 50])
    words = [f"w{rng.randrange(letters)}" for _ in range(n)]
    if n > 30 and rng.random() < 0.7:
        p, a = rng.randint(1, n // 4), rng.randrange(n // 2)
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
    return words


@pytest.mark.parametrize("places", [10, 1000, 1 << 19])
def test_runs_equal_plain_runs(monkeypatch, places):
    monkeypatch.setattr(runs, "PLACES", places)
    rng = random.Random(places)
    for _ in range(120):
        docs = [_made(rng) for _ in range(rng.randint(1, 6))]
        flat = [w for d in docs for w in d]
        ids = np.unique(flat, return_inverse=True)[1] if flat else np.zeros(0, np.int64)
        got = runs.runs_of(ids.astype(np.int64), np.array([len(d) for d in docs]))
        want = [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d)]
        assert list(zip(*[x.tolist() for x in got])) == want


def test_extensions_equal_plain_ones():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 40):
        words = np.append(rng.integers(0, letters, 700), 1000)
        words[300:600] = words[:300]
        i, j = rng.integers(0, 700, (2, 3000))
        i, j = i[i != j], j[i != j]
        got = runs.Extensions(words).of(i, j)
        for a, b, n in zip(i.tolist(), j.tolist(), got.tolist()):
            assert (words[a : a + n] == words[b : b + n]).all() and words[a + n] != words[b + n]


def test_cover_is_a_difference_cover():
    seen = {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER}
    assert seen == set(range(runs.MODULUS))


def test_find_runs(spark, odd, none):
    more = [
        (11, "a b " * 20 + "c " + "x y z " * 9, "en", "a"),
        (12, "one two\x1cthree " * 12, "en", "a"),
        (13, " \n\t ", "en", "a"),
        (None, "go " * 6, None, None),
    ]
    df = odd.unionByName(_framed(spark, more)).drop("found")
    found = runs.find_runs(df)
    assert found.columns == [*df.columns, "found"]
    got = [
        (r.doc_id, r.text, r.found.n_words, [tuple(x) for x in r.found.runs], r.found.collapsed)
        for r in found.collect()
    ]
    assert len(got) == df.count()
    for _, text, n, listed, collapsed in got:
        words = brute.words(text)
        assert n == len(words)
        if n < 3000:
            assert listed == plain_runs(words)
        assert collapsed == plain_collapsed(words, listed)
    assert runs.find_runs(none.drop("found")).count() == 0


def test_planted_documents_have_their_runs(spark):
    docs = _table(spark)
    texts = dict(_pairs(docs))
    planted = runs.with_planted_runs(docs)
    changed = 0
    for i, text in _pairs(planted):
        h = zlib.crc32(str(i).encode())
        w, g = brute.words(texts[i]), h // 10
        if h % 10 or not w:
            assert text == texts[i]
            continue
        a, n = g % len(w), len(w)
        p = 1 + (n - a) // (3 + g % 8)
        assert text == " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
        changed += 1
    assert changed > 5
    nobody = spark.createDataFrame([(None, "a b c d")], "doc_id bigint, text string")
    assert runs.with_planted_runs(nobody).first()["text"] == "a b c d"


# 12


def _features(text, longest):
    w = brute.bench_words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain_draw(rows, items, longest=1, buckets=10_000, per_cent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source = collections.Counter(bucket(f) for _, t in rows for f in _features(t, longest))
    target = collections.Counter(bucket(f) for t in items for f in _features(t, longest))
    s_all, t_all = sum(source.values()), sum(target.values())

    def gain(b):
        return math.floor(1000 * math.log((target[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))

    out = []
    for i, text in rows:
        f = _features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([len(brute.bench_words(text)), i, len(f), weight, score, None])
    able = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    for place, r in enumerate(able[: len(able) * per_cent // 100]):
        r[5] = place + 1
    return _sorted([tuple(r[1:]) for r in out])


def _drawn(df):
    return _got(df.select("doc_id", "weighed.n_features", "weighed.weight", "weighed.score", "weighed.rank"))


@pytest.mark.parametrize("longest, words, pairs", [(1, 50_000, 0), (1, 0, 0), (1, 7, 0), (2, 50, 40), (2, 0, 0), (3, 500, 1000)])
def test_draw_equals_plain_draw(spark, longest, words, pairs):
    docs, items = _table(spark), _table(spark, "benchmark")
    got = resample.resample(docs, items, longest=longest, head_words=words, head_pairs=pairs)
    want = plain_draw(_pairs(docs), [r.text for r in items.collect()], longest)
    assert _drawn(got) == want


def test_draw_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([("Word x1",), (None,), ("",), ("w5 w6 ÀB",)], "text string")
    df = odd.unionByName(_framed(spark, [(None, "lone " * 30, None, None), (20, "ÀB àb Ab", "en", "a")]))
    got = resample.resample(df, items, per_cent=50)
    assert set(CLASH) <= set(got.columns)
    assert _drawn(got) == plain_draw(_pairs(df), [r.text for r in items.collect()], per_cent=50)
    assert resample.resample(none, items).count() == 0
    no_target = resample.resample(df, items.limit(0), per_cent=50)
    assert _drawn(no_target) == plain_draw(_pairs(df), [], per_cent=50)


def test_draw_repeats_for_any_partitions(spark):
    docs, items = _table(spark), _table(spark, "benchmark")
    found = [_drawn(resample.resample(docs.repartition(n), items, with_text=False)) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2]


def test_head_states_continue(spark):
    head = resample.Head([b"a", b"bc"], [(b"a", b"bc"), (b"bc", b"bc")])
    cut = resample.Cut([b"A bc bc x", b"", b"a"])
    got = head.buckets(cut, 3, 1 << 32)
    want = [[b"a", b"bc", b"bc", b"x", b"a"], [b"a bc", b"bc bc", b"bc x"], [b"a bc bc", b"bc bc x"]]
    assert [b.tolist() for _, b in got] == [[zlib.crc32(f) for f in size] for size in want]
    assert [t.tolist() for t, _ in got] == [[0, 0, 0, 0, 2], [0, 0, 0], [0, 0]]


# 13


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)


def plain_lines(rows, least_docs, keep_first, least_chars=1):
    """(doc_id, n_lines, n_dropped, text) per row."""
    name = lambda i, t: hashlib.md5(f"{i}\n{t or ''}".encode()).hexdigest()
    held = collections.Counter()
    for _, t in rows:
        held.update({_key(x) for x in (t or "").split("\n")})
    first = {}
    for i, t in rows:
        for at, line in enumerate((t or "").split("\n")):
            place = (i is None, i or 0, name(i, t), at)
            first[_key(line)] = min(first.get(_key(line), place), place)
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for at, line in enumerate(lines):
            k = _key(line)
            drop = len(k) >= least_chars and held[k] >= least_docs
            if not drop or (keep_first and first[k] == (i is None, i or 0, name(i, t), at)):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return _sorted(out)


def _deduped(df):
    return _got(df.select("doc_id", "lines.n", "lines.n_dropped", F.coalesce("text", F.lit(""))))


@pytest.mark.parametrize("bits", [4, 12, 28])
@pytest.mark.parametrize("least_docs, keep_first, least_chars", [(10, False, 1), (2, True, 1), (3, True, 30)])
def test_lines_equal_plain_lines(spark, bits, least_docs, keep_first, least_chars):
    docs = _table(spark)
    got = line_dedup.dedup_lines(docs, least_docs, keep_first, least_chars, bits)
    assert _deduped(got) == plain_lines(_pairs(docs), least_docs, keep_first, least_chars)


def test_lines_of_odd_rows(spark, odd, none):
    more = [
        (21, "Same line\n\n  same LINE \t\nother\r", "en", "a"),
        (22, "\x0bSAME line\x0c\nÀ\nother", "en", "a"),
        (None, "same line\nà\n", None, None),
        (23, "\n\n\n", "en", "a"),
        (24, "".join(f"l{k % 500}\n" for k in range(20_000)), "en", "a"),
        (25, "".join(f"L{k}\n" for k in range(400)), "en", "a"),
    ]
    df = odd.unionByName(_framed(spark, more)).withColumn("lines", F.lit(1))
    for keep_first in (False, True):
        got = line_dedup.dedup_lines(df, 2, keep_first)
        assert set(CLASH) <= set(got.columns)
        assert _deduped(got) == plain_lines(_pairs(df), 2, keep_first)
    assert line_dedup.dedup_lines(none).count() == 0
    nulls = got.filter("doc_id = 3").select("text", "lines.n", "lines.n_dropped").first()
    assert tuple(nulls) == (None, 1, 0)


def test_filters_have_no_false_negative():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 14, 9000)
    parts = [line_dedup.Filters(14) for _ in range(3)]
    for k, part in enumerate(np.array_split(keys, 9)):
        parts[k % 3].add(part)
    whole = line_dedup.Filters(14)
    for p in parts:
        for segment in p.segments():
            whole.unite(*segment)
    counts = np.bincount(keys, minlength=1 << 14)
    on = lambda x: np.unpackbits(x, bitorder="little").astype(bool)
    assert (on(whole.once) == (counts > 0)).all()
    assert (on(whole.twice) == (counts > 1)).all()


def test_lines_shuffle_only_suspects(spark, monkeypatch):
    """Of documents without a line in common, nothing is marked for the exact count."""
    marked = []
    keep = line_dedup.settle
    monkeypatch.setattr(line_dedup, "settle", lambda df: marked.append(keep(df)) or marked[-1])
    alone = spark.createDataFrame([(i, f"only {i}\nline {i * 7}\n{i}") for i in range(2000)], "doc_id long, text string")
    assert line_dedup.dedup_lines(alone).filter("lines.n_dropped > 0").count() == 0
    assert marked[0].count() <= 2
