import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from eventlens.llm import sharding as S
from tests.llm.helpers import SF, awkward, frame


def shards_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    for of in out.values():
        assert sorted(r["slot"] for r in of) == list(range(len(of)))
    return out


def test_equal_bytes_gapless_slots_whole_groups(spark):
    rows = S.op7(spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    sizes = {s: sum(r["size"] for r in of) for s, of in shards_of(rows).items()}
    ideal, largest = sum(sizes.values()) / 8, max(r["size"] for r in rows)
    assert set(sizes) == set(range(8)) and all(abs(v - ideal) <= largest + 0.02 * ideal for v in sizes.values())
    groups = defaultdict(set)
    for r in rows:
        groups[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())


def test_hot_text_is_cut(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("y"), 75))).alias("text"))
    rows = S.shard_documents(docs, 4).collect()
    sizes = [sum(r["size"] for r in of) for of in shards_of(rows).values()]
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 4
    assert sorted(map(tuple, S.shard_documents(docs.repartition(7), 4).collect())) == sorted(map(tuple, rows))


def test_awkward_rows(spark):
    docs = frame(spark, awkward(), size="'x'", shard="1", text_key="2", range="3", _column_0="4")
    out = S.shard_documents(docs.drop("_column_0"), 3)
    rows = out.collect()
    assert len(rows) == len(awkward()) and set(docs.columns) - {"_column_0"} <= set(out.columns)
    shards_of(rows)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert Counter(r["doc_id"] for r in rows)[2] == 3
    assert S.shard_documents(docs.limit(0)).count() == 0
    nothing = S.shard_documents(docs.where("doc_id = 3"), 8).collect()
    assert [(r["size"], r["slot"]) for r in nothing] == [(1, 0)]
