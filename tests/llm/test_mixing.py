from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventlens.llm import mixing as M
from tests.llm.helpers import SF, awkward, frame, words


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 100, 1023])
def test_permutation_moves_every_value_once(spark, size):
    df = spark.range(size).select("id", F.lit(size).cast("long").alias("n"))
    for seed in (0, 5):
        got = [r[0] for r in df.select(M._permuted(F.col("id"), F.col("n"), F.lit(seed))).collect()]
        assert sorted(got) == list(range(size))
        assert size < 60 or got != list(range(size))


def expected_targets(sizes, weights=M.WEIGHTS, cap=M.MAX_REPEATS):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: cap * sizes[s] for s in over}


def check(rows, block=M.BLOCK_WORDS):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = expected_targets(sizes)
    for s, t in want.items():
        assert targets[s] == pytest.approx(t) and abs(taken[s] - t) <= 2 * block


def with_source(spark, docs, **options):
    got = M.taken_words(docs, **options).select("doc_id", "size", "target", "taken", "source_size")
    return got.join(docs.select("doc_id", "source"), "doc_id")


def test_targets_and_limits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(with_source(spark, docs).collect())
    check(with_source(spark, docs, block_words=16).collect(), 16)


def test_reruns_and_partitions_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, M.taken_words(docs).collect()))
    assert one == sorted(map(tuple, M.taken_words(docs.repartition(13)).collect()))


def test_pieces_are_what_is_counted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("rank", F.lit(1)).withColumn("block", F.lit("x"))
    mixed = M.mix_documents(docs, block_words=64, shard_slots=16)
    assert mixed.columns == [*docs.columns, "shard", "position", "from_word", "n_words"]
    rows = mixed.collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    taken = defaultdict(int)
    for r in rows:
        assert words(r["text"]) == words(text[r["doc_id"]])[r["from_word"] : r["from_word"] + r["n_words"]]
        assert r["text"] in text[r["doc_id"]]
        taken[r["doc_id"]] += r["n_words"]
    want = {r["doc_id"]: r["taken"] for r in M.taken_words(docs, block_words=64, shard_slots=16).collect() if r["taken"]}
    assert taken == want
    slots = {(r["shard"], r["position"]) for r in rows}
    assert len(slots) == max(s for s, _ in slots) * 16 + 1 + max(p for s, p in slots if s == max(s for s, _ in slots))


def test_awkward_rows(spark):
    docs = frame(spark, awkward(), size="1", shard="'s'", target="2", start="0")
    rows = M.taken_words(docs).collect()
    assert len(rows) == len(awkward())
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    mixed = M.mix_documents(docs)
    assert set(docs.columns) <= set(mixed.columns) and mixed.agg(F.sum("n_words")).first()[0] == sum(r["taken"] for r in rows)
    assert M.taken_words(docs.limit(0)).count() == 0 and M.mix_documents(docs.limit(0)).count() == 0
    empty = docs.where("doc_id IN (3, 4, 5)")
    assert [r["taken"] for r in M.taken_words(empty).collect()] == [0, 0, 0] and M.mix_documents(empty).count() == 0


def test_shards_are_those_of_the_mix(spark):
    """The number of shards of a document against the mix itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    options = {"block_words": 32, "shard_slots": 100}
    got = {r["doc_id"]: (r["shards"], r["taken"]) for r in M.taken_words(docs, **options).collect()}
    mixed = defaultdict(set)
    for r in M.mix_documents(docs, **options).select("doc_id", "shard").collect():
        mixed[r["doc_id"]].add(r["shard"])
    assert {k: len(v) for k, v in mixed.items()} == {k: n for k, (n, _) in got.items() if n}
    assert max(n for n, _ in got.values()) > 3 and all((n > 0) == (taken > 0) for n, taken in got.values())
