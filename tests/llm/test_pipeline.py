"""The pipeline against its brute-force version on a small corpus."""

import collections
import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_text_operators import CLASH, SMALL, _framed, _plain_encode, none  # noqa: F401
from tillwise.llm import mixing, rules


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # The verdicts of the first stage have their own test.
    kept = sorted(r.doc_id for r in rules.judge(docs).collect() if r.kept)
    classes = brute.components([(i, rows[i].text) for i in kept], size=5, per_cent=80)
    kept = [i for i in kept if classes[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [r[0] for r in brute.contaminated([(i, rows[i].text) for i in kept], items) if not r[-1]]
    sizes = {i: len(brute.words(rows[i].text)) for i in kept}
    taken = brute.mix([(i, rows[i].source, sizes[i]) for i in kept])
    copies = collections.Counter({i: taken[i][1] // sizes[i] for i in kept if taken[i][1]})
    # The files keep the training order, which the curriculum's own SQL test covers.
    order = [r.doc_id for r in mixing.mix(docs.filter(F.col("doc_id").isin(kept))).collect()]
    assert collections.Counter(order) == copies
    assert order != sorted(order)
    expected = brute.token_digests([(i, rows[i].text) for i in order], _plain_encode())
    got = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).orderBy("start").collect()]
    assert got == expected
    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5


TEXT = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old tall tree nearby"


@pytest.fixture(scope="module")
def messy(spark):
    """Null ids, sources and texts, rows that share an id, rows that stand twice."""
    words = TEXT.split()
    turned = lambda k: " ".join(f"{w}{k}" for w in words)
    rows = [
        (None, turned(1), "en", "a"),
        (None, "bad", "en", "a"),
        (1, turned(2), "en", None),
        (2, turned(3), None, "a"),
        (2, "bad", None, "a"),
        (3, turned(4), "en", "a"),
        (3, turned(4), "en", "a"),
        (4, None, "en", "a"),
        (5, "", "en", "b"),
        (6, " ".join([turned(5), turned(6), turned(7), turned(8)]), "en", "b"),
        (7, " ".join([turned(5), turned(6), turned(7), turned(8)]) + " end", "en", "b"),
    ]
    return _framed(spark, rows)


def test_clean_leaves_out_rows_not_ids(messy):
    kept = sorted((str(r.doc_id), r.text[:4]) for r in rules.clean(messy).collect())
    assert kept == sorted([("None", "the1"), ("1", "the2"), ("2", "the3"), ("3", "the4"), ("3", "the4"), ("6", "the5"), ("7", "the5")])


@pytest.mark.parametrize("made", ["messy", "none"])
def test_stages_on_odd_rows(spark, made, request, tmp_path):
    docs = request.getfixturevalue(made)
    columns, empty = docs.columns, made == "none"
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), SMALL)
        assert docs.columns == columns or name == "token_ids"
        found = [(r.doc_id, r.text[:4]) for r in docs.collect()] if name != "token_ids" else docs.collect()
        assert bool(found) != empty
        if name == "near_copies" and not empty:
            # Of 6 and 7, near copies, and of the rows with id 3 one stays each.
            assert sorted(map(str, (i for i, _ in found))) == ["1", "2", "3", "6", "None"]
    assert set(CLASH) <= set(columns)


FREED = """
import re
from tillwise.llm import common

def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()).group(1)) // 1024

def run(batches):
    # Small pieces that stay between large ones keep the heap from shrinking by itself.
    made = [bytes(2000) for _ in range(100_000)]
    pins.extend(made[::500])
    del made
    yield held()

pins, before = [], held()
(inside,) = common.giving_back(run)(iter(()))
print(inside - before, held() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_tasks_give_back_memory():
    folder = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    said = subprocess.run([sys.executable, "-c", FREED], cwd=folder, capture_output=True, text=True, check=True, timeout=100)
    inside, after = map(int, said.stdout.split())
    assert inside > 100 and after < 50


def test_stages_hand_over_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(corpus_pipeline, "_tables", {})
    docs = spark.createDataFrame([(i,) for i in range(300)], "doc_id long").coalesce(1)
    docs = docs.withColumn("text", F.repeat(F.col("doc_id").cast("string"), 100_000))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    try:
        stage = corpus_pipeline._stage(lambda spark, docs, folder: docs.mapInArrow(sizes, "n long, size long"))
        got = stage(spark, docs, SMALL).collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r.n for r in got) == 300
    assert max(r["size"] for r in got) < 2 * corpus_pipeline.BATCH_BYTES < sum(r["size"] for r in got)
