from eventlens.llm.decontaminate import words_of
from eventlens.session import materialise
from tests.llm.helpers import SF, awkward, frame, words
from tests.llm.test_decontaminate import naive
from tests.llm.test_mixing import expected_targets
from tests.llm.test_simhash import brute_components, brute_fingerprint

import corpus_pipeline as P


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = materialise(stage(spark, before, SF))
        kept[name] = before.collect(), docs.collect()
        assert name == "sharding" or docs.columns == columns
    before, after = kept["toxicity"]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert len(gone & toxic) > 0.6 * len(toxic) and set(after) <= set(before)

    before, after = kept["simhash_near_dedup"]
    before.sort(key=lambda r: r["doc_id"])
    roots = brute_components([brute_fingerprint(r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({before[r]["doc_id"] for r in roots})

    before, after = kept["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for w in (words_of(t) for _, t in items) for i in range(len(w) - 9)}
    short = [x for x in items if len(words_of(x[1])) < 10]
    clean = {r["doc_id"] for r in before if not naive(r["text"], short)[1]
             and not any(tuple((w := words_of(r["text"]))[i : i + 10]) in grams for i in range(len(words_of(r["text"])) - 9))}
    assert {r["doc_id"] for r in after} == clean

    before, after = kept["mixing"]
    sizes, taken = {}, {}
    for rows, into in ((before, sizes), (after, taken)):
        for r in rows:
            into[r["source"]] = into.get(r["source"], 0) + len(words(r["text"]))
    for s, t in expected_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 512
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = kept["sharding"]
    assert sorted(tuple(r[c] for c in columns) for r in after) == sorted(map(tuple, before))
    slots = {}
    for r in after:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_is_the_stages(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and {"shard", "slot", "size"} <= set(out.columns)


def test_awkward_rows(spark):
    """Null, empty, repeated and very long rows, an empty table and one of nulls through all stages, with columns of any name."""
    docs = frame(spark, awkward(), size="'x'", shard="1", representative="2", _id_key="'k'")
    for given in (docs, docs.limit(0), docs.where("text IS NULL")):
        columns, texts = given.columns, {r["text"] for r in given.collect() if words(r["text"])}
        for name, stage in P.STAGES:
            before = given
            given = materialise(stage(spark, before, SF))
            assert name == "sharding" or given.columns == columns
            if name in ("toxicity", "simhash_near_dedup", "benchmark_decontamination"):
                rows = lambda df: sorted(map(tuple, df.select("doc_id", "text", "lang", "source").collect()), key=repr)
                assert all(r in rows(before) for r in rows(given))
        pieces = given.collect()
        assert all(any(r["text"] in t for t in texts) for r in pieces) and (not texts or pieces)
        assert sorted(r["slot"] for r in pieces if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in pieces)))
