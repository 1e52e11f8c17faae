"""Mixing sources to target weights, in DataFrame operations only.

The documents of each source are laid end to end, in an order given by a digest of their id, and the words of that
sequence are cut into blocks of fixed length.  The mix is a sequence of slots, each holding one block, and is cut into
output shards of equal numbers of slots.  A source's share of the words gives its number of slots.  Which slots it
gets is a draw without replacement: a pseudorandom permutation of all slots.  The counts of sources per shard are thus
multinomial counts under the condition that their totals meet the targets (a plain multinomial draw would miss them, and
repeat some documents more often than allowed).  The k-th slot of a source reads the block that a permutation of that
source's blocks, a new one for each pass over them, puts at k; slots and blocks are joined by source and block index.

Nothing depends on the partitioning, so reruns agree.  A hot source is spread over ranges of the digest: running
positions need a window per (source, range) and a prefix sum over the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import WORD, query, table, text_or_empty
from eventlens.session import materialise

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
RANGE_DIGITS = 3
_CHUNK = 1 << 14
_ROUNDS = 4


def _permuted(value: Column, size: Column, seed: Column) -> Column:
    """Where a pseudorandom permutation of [0, size) puts ``value``.

    Each round scrambles the values below the largest power of two in ``size`` (xor, odd factor, xor-shift: all
    reversible there) and rotates all, so that after a few rounds every value has moved; no two values ever meet.
    """
    bits = F.length(F.bin(size)) - 1
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    half = F.call_function("shiftright", bits, F.lit(1)) + 1

    def one_round(x, r):
        key = seed.cast("long") * 48271 + r * 69621
        y = (x.bitwiseXOR(key.bitwiseAND(mask)) * (r * 81384 + 1) + key).bitwiseAND(mask)
        y = y.bitwiseXOR(F.call_function("shiftright", y, half))
        return (F.when(x <= mask, y).otherwise(x) + F.call_function("shiftright", size, F.lit(1)) + key % size) % size

    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in range(1, _ROUNDS + 1)]), value, one_round)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rank, target and number of slots of each source, from (source_key, source, source_size).

    Weights go round the sources in code point order, null last.  Targets share the words of all sources by
    weight; none exceeds ``max_repeats`` times its source, the rest is shared again.  That is a common level per
    unit of weight, the largest over all ways to cap the sources with the least room per weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    room = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(room), F.lit(0))).cast("double")
                    / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(room), F.lit(0))).cast("double"))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight").cast("double")))
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor((F.col("target") - F.col("passes") * F.col("source_size")) * F.col("blocks") / F.col("source_size") + 0.5).cast("long")
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long")).withColumn("passes", passes)
        .withColumn("slots", F.when(F.col("source_size") > 0, F.col("passes") * F.col("blocks") + rest).otherwise(0))
        .withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0)))
        .withColumn("all_slots", F.sum("slots").over(whole))
        .select("source_key", "rank", "source_size", "target", "blocks", "slots", "first_slot", "all_slots")
    )


def draw_slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per slot of the mix: (shard, position, rank, block)."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = sources.where("slots > 0").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {_CHUNK})")))
    slots = (
        chunks.repartition(n, "rank", "chunk")
        .withColumn("ordinal", F.explode(F.expr(f"sequence(chunk * {_CHUNK}, least((chunk + 1) * {_CHUNK}, slots) - 1)")))
        .withColumn("slot", _permuted(F.col("first_slot") + F.col("ordinal"), F.col("all_slots"), F.lit(seed)))
        .withColumn("pass", F.expr("ordinal div blocks"))
        .withColumn("block", _permuted(F.col("ordinal") % F.col("blocks"), F.col("blocks"), F.col("rank") * 101 + F.col("pass") + seed))
    )
    return slots.select(F.expr(f"slot div {shard_slots}").alias("shard"), (F.col("slot") % shard_slots).alias("position"), "rank", "block")


def place_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                    block_words: int = BLOCK_WORDS, keep_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every document's place in the word sequence of its source, and the sources with their targets.

    The first frame has id, size, start (of its words) and the columns of its source; with ``keep_rows`` also
    ``row``, all columns of ``docs``.
    """
    row = [F.struct(*docs.columns).alias("row")] if keep_rows else []
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("null")).alias("source_key"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("digest"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"), *row)
    rows = rows.withColumn("range", F.substring("digest", 1, RANGE_DIGITS))
    if not keep_rows:
        rows = materialise(rows)
    ranges = rows.groupBy("source_key", "source", "range").agg(F.sum("size").alias("range_size"))
    ranges = materialise(ranges)
    sources = source_targets(ranges.groupBy("source_key", "source").agg(F.sum("range_size").alias("source_size")), weights, max_repeats, block_words)
    sources = materialise(sources)
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .select("source_key", "range", "offset").join(sources, "source_key")
    )
    inside = Window.partitionBy("source_key", "range").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        # both sides by (source, range), as the window needs them anyway: the ranges grow with the number of sources
        rows.drop("source").join(offsets.hint("merge"), ["source_key", "range"])
        .withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
        .drop("source_key", "range", "digest", "offset")
    )
    return placed, sources


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """The part of each document in each block that it touches."""
    return (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
        .withColumn("from_word", F.greatest("start", F.col("block") * block_words) - F.col("start"))
        .withColumn("n_words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
                    - F.greatest("start", F.col("block") * block_words))
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                  block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix itself: the pieces of documents that each slot holds, in the columns of ``docs``.

    Adds shard, position, from_word and n_words (``docs`` columns of these names are replaced); ``text_col`` holds
    the piece: its words with the white space that follows each (and what precedes the first word of a text).
    Documents without words, or of which no block is drawn, don't occur; an empty input gives an empty mix; the rows
    of a null source are a source of their own, last in order.
    """
    placed, sources = place_documents(docs, id_col, text_col, source_col, weights, max_repeats, block_words, keep_rows=True)
    # every match is one word
    words = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(rf"(?:^[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    placed = placed.where("size > 0").withColumn("words", words)
    pieces = _pieces(placed, block_words).withColumn("piece", F.array_join(F.expr("slice(words, int(from_word + 1), int(n_words))"), ""))
    pieces = pieces.select("rank", "block", "from_word", "n_words", "piece", F.col("row").dropFields(text_col).alias("row"))
    # Spark takes the exploded slots for as few as the sources they come from, and would broadcast them
    mixed = draw_slots(sources, shard_slots, seed).hint("merge").join(pieces, ["rank", "block"])
    added = ["shard", "position", "from_word", "n_words"]
    columns = [F.col("piece").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return mixed.select(*columns, *added)


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken, shards) per row of ``docs``: words that the mix takes, repeats counted, and
    the number of output shards to which the draw sends any of them.

    A null text has size 0; rows that repeat an id are placed and counted one by one.
    """
    placed, sources = place_documents(docs, id_col, text_col, source_col, weights, max_repeats, block_words)
    placed = materialise(placed)
    drawn = draw_slots(sources, shard_slots, seed).groupBy("rank", "block", "shard").agg(F.count("*").alias("times"))
    own = ["rank", "start", "id", "size", "source_size", "target"]
    words = _pieces(placed, block_words).join(drawn.hint("merge"), ["rank", "block"]).select(*own, "shard", (F.col("n_words") * F.col("times")).alias("taken"))
    none = [F.lit(None).cast("long").alias("shard"), F.lit(0).cast("long").alias("taken")]
    counted = (
        words.unionByName(placed.where("size > 0").select(*own, *none)).groupBy(*own, "shard").agg(F.sum("taken").alias("taken"))
        .groupBy(*own).agg(F.sum("taken").alias("taken"), F.count("shard").alias("shards"))
    )
    out = ["id", "size", "source_size", "target", "taken", "shards"]
    wordless = placed.where("size = 0").select(*own, none[1], F.lit(0).cast("long").alias("shards")).select(*out)
    return counted.select(*out).unionByName(wordless).withColumnRenamed("id", id_col)


def _permutation_sql(name: str, given: str, value: str, size: str, seed: str, out: str) -> str:
    """CTEs ``name_0`` ... that add ``out``: the same permutation in SQL."""
    half = "((bits >> 1) + 1)"
    ctes = [f"{name}_0 AS (SELECT *, {value} AS {out}, length(bin({size})) - 1 AS bits, CAST({seed} AS BIGINT) AS seed FROM {given})",
            f"{name}_00 AS (SELECT *, (CAST(1 AS BIGINT) << bits) - 1 AS mask FROM {name}_0)"]
    last = f"{name}_00"
    for r in range(_ROUNDS):
        key = f"(seed * 48271 + {(r + 1) * 69621})"
        ctes.append(f"{name}_{r}a AS (SELECT *, ((xor({out}, {key} & mask) * {40692 * 2 * (r + 1) + 1}) + {key}) & mask AS y FROM {last})")
        ctes.append(f"""{name}_{r}b AS (SELECT * EXCLUDE (y) REPLACE ((CASE WHEN {out} <= mask THEN xor(y, y >> {half}) ELSE {out} END
             + ({size} >> 1) + {key} % {size}) % {size} AS {out}) FROM {name}_{r}a)""")
        last = f"{name}_{r}b"
    ctes.append(f"{name} AS (SELECT * EXCLUDE (bits, seed, mask) FROM {last})")
    return ",\n".join(ctes)


MIX_SQL = f"""m_rows AS (SELECT row_number() OVER () AS r, *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS m_size FROM DOCS),
m_sources AS (SELECT source AS m_source, CAST(sum(m_size) AS BIGINT) AS source_size,
  row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM m_rows GROUP BY source),
m_weights AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][rank % {len(WEIGHTS)} + 1] AS weight, source_size * {MAX_REPEATS} AS cap FROM m_sources),
m_levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER room, 0) AS DOUBLE)
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER room, 0) AS DOUBLE) AS level FROM m_weights
  WINDOW room AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m_targets AS (SELECT *, least(CAST(cap AS DOUBLE), max(level) OVER () * CAST(weight AS DOUBLE)) AS target,
  CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT) AS blocks FROM m_levels),
m_passes AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM m_targets),
m_slots AS (SELECT *, CASE WHEN source_size > 0 THEN passes * blocks
  + CAST(floor((target - passes * source_size) * blocks / source_size + 0.5) AS BIGINT) ELSE 0 END AS slots FROM m_passes),
m_firsts AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_slot,
  CAST(sum(slots) OVER () AS BIGINT) AS all_slots FROM m_slots),
m_ordinals AS (SELECT rank, blocks, CAST(first_slot AS BIGINT) AS first_slot, all_slots, unnest(generate_series(0, CAST(slots AS BIGINT) - 1)) AS ordinal FROM m_firsts WHERE slots > 0),
{_permutation_sql("m_global", "m_ordinals", "first_slot + ordinal", "all_slots", str(SEED), "slot")},
{_permutation_sql("m_drawn", "m_global", "ordinal % blocks", "blocks", f"rank * 101 + ordinal // blocks + {SEED}", "block")},
m_placed AS (SELECT *, sum(m_size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, m_size, r
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m_size AS start FROM m_rows),
m_docs AS (SELECT p.*, s.rank, s.source_size, s.target FROM m_placed p JOIN m_firsts s ON p.source IS NOT DISTINCT FROM s.m_source),
m_pieces AS (SELECT *, greatest(start, block * {BLOCK_WORDS}) - start AS from_word,
  least(start + m_size, (block + 1) * {BLOCK_WORDS}) - greatest(start, block * {BLOCK_WORDS}) AS n_words
  FROM (SELECT *, unnest(generate_series(CAST(start AS BIGINT) // {BLOCK_WORDS}, CAST(start + m_size - 1 AS BIGINT) // {BLOCK_WORDS})) AS block FROM m_docs WHERE m_size > 0)),
m_mix AS (SELECT p.*, d.slot // {SHARD_SLOTS} AS m_shard, d.slot % {SHARD_SLOTS} AS m_position FROM m_drawn d JOIN m_pieces p USING (rank, block))"""


@query("op1_mix_sources", sql=f"""WITH {MIX_SQL.replace("DOCS", "documents")},
taken AS (SELECT r, sum(n_words) AS taken, count(DISTINCT m_shard) AS shards FROM m_mix GROUP BY r)
SELECT doc_id, m_size AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(shards, 0) AS shards FROM m_docs LEFT JOIN taken USING (r)""")
def op1(spark, d):
    """Words that the mix takes of every document, and how many output shards they are drawn for."""
    return taken_words(table(spark, d, "documents").select("doc_id", "text", "source"))
