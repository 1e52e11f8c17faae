"""Language-model scores by Katz backoff over pairs of words.

Counts of words and of pairs come from the training documents.  Good-Turing discounts take mass from rare pairs; what a
history has left goes to the words never seen after it, in proportion to their own probability, by a weight that makes
the probabilities after every history add up to one.  Words back off in the same way: the mass that Good-Turing takes
from rare words is the probability of an unknown word.  A score adds up the logarithms over the tokens of a text.

The model is three written tables: words (one row each), pairs (partitioned by the hash of the history) and histories
(count, scale and backoff weight).  Text is tokenised in tasks over Arrow batches; what they exchange are compressed
blobs of sorted arrays, each pair once per task and flush with the documents that hold it.  The most frequent words, at
most ``HEAD_WORDS`` whatever the corpus, are sent to all tasks and written as short codes; the counts of all other words
are joined by hash.  The pairs of a frequent history are spread over as many partitions as its count asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.arrays import ROW, by_target, dump, frame, from_planes, from_sorted_planes, heads, load, narrow, part_of, planes, record_batch, sorted_planes
from eventlens.llm.common import mix64, packed, query, slices, span_hashes, table, word_spans
from eventlens.session import materialise

HEAD_WORDS = 1 << 20
MAX_DISCOUNTED = 5
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x94057B7EF767814F)
#: Tokens of training text per partition of pairs, and tokens that a task holds before it passes them on.
PART_TOKENS = 1 << 20
_FLUSH_TOKENS = 1 << 20
_RARE = np.uint64(1) << np.uint64(63)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_TURN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Discounts:
    """Good-Turing factors of counts 1 .. k; larger counts are left alone."""

    factor: np.ndarray

    @staticmethod
    def of(number: dict[int, int]) -> Discounts:
        """From the number of types of each count, with the largest k up to MAX_DISCOUNTED that gives factors in (0, 1).

        Where no k does (small or odd tables), counts are lowered by a constant below one instead.
        """
        n = [0.0] + [float(number.get(r, 0)) for r in range(1, MAX_DISCOUNTED + 2)]
        for k in range(MAX_DISCOUNTED, 0, -1):
            if not all(n[r] for r in range(1, k + 2)):
                continue
            common = (k + 1) * n[k + 1] / n[1]
            factor = [((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if common < 1 else 0 for r in range(1, k + 1)]
            if all(0 < f < 1 for f in factor):
                return Discounts(np.array([1.0, *factor]))
        less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return Discounts(np.array([1.0] + [(r - less) / r for r in range(1, MAX_DISCOUNTED + 1)]))

    def mass(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        padded = np.append(self.factor, 1.0)
        return counts * padded[np.minimum(counts, len(self.factor)).astype(np.int64)]

    def column(self, count: Column) -> Column:
        out = count.cast("double")
        for r, f in list(enumerate(self.factor.tolist()))[1:]:
            out = F.when(count == r, F.lit(r * f)).otherwise(out)
        return out


@dataclass
class Lexicon:
    """The frequent words, by hash, and what every task has to know about words."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    discounts: Discounts
    scale: float
    parts: int
    documents: int

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The position of a frequent word, or the hash of another with the top bit set."""
        if not len(self.hashes):
            return (hashes >> np.uint64(1)) | _RARE
        different, inverse = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, different), len(self.hashes) - 1)
        code = np.where(self.hashes[at] == different, at.astype(np.uint64), (different >> np.uint64(1)) | _RARE)
        return code[inverse]

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words with these counts; zero stands for the unknown word."""
        known = self.scale * self.discounts.mass(counts) / max(self.tokens, 1)
        return np.where(counts > 0, known, self.unknown)

    unknown: float = 1.0

    def spread(self, history: np.ndarray) -> np.ndarray:
        """Number of partitions for the pairs of each history: as many as its tokens fill."""
        frequent = history < _RARE
        count = np.zeros(len(history), dtype=np.int64)
        count[frequent] = self.counts[history[frequent].astype(np.int64)]
        count[history == START] = self.documents
        return (count // max(1, self.tokens // self.parts) + 1).astype(np.uint64)

    def place(self, history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order key, partition) of pairs: equal pairs, histories and partitions come together in the key's order."""
        mixed = mix64(word)
        home = mix64(history + (mixed % self.spread(history)) * _TURN)
        return (home & _HIGH) | (mixed >> np.uint64(32)), part_of(home, self.parts)


def _good_lexicon(lexicon: Lexicon, discounted: float) -> Lexicon:
    """Sets the scale and the unknown word's probability, so that all add up to one and none is zero."""
    left = 1 - discounted / lexicon.tokens if lexicon.tokens else 1.0
    if lexicon.tokens and left < 1e-12:
        lexicon.scale = lexicon.tokens / (lexicon.tokens + 1)
        left = 1 - lexicon.scale * discounted / lexicon.tokens
    lexicon.unknown = left
    return lexicon


def _tokens(batch: pa.RecordBatch):
    """(begin, end of a slice of the batch, words' document numbers, words' hashes)."""
    for first in range(0, len(batch), 1000):
        texts = [t or b"" for t in batch.column(1).slice(first, 1000).cast(pa.binary()).to_pylist()]
        for begin, end in slices(texts):
            buf, offsets = packed(texts[begin:end])
            starts, ends = word_spans(buf)
            yield first + begin, first + end, np.searchsorted(offsets, starts, side="right") - 1, span_hashes(buf, starts, ends)


def _pairs(n_docs: int, owner: np.ndarray, codes: np.ndarray, end: np.uint64):
    """History, word and document of every token, the end included, in order."""
    counts = np.bincount(owner, minlength=n_docs)
    last = np.cumsum(counts + 1) - 1
    words = np.empty(len(codes) + n_docs, dtype=np.uint64)
    at_word = np.ones(len(words), dtype=bool)
    at_word[last] = False
    words[at_word], words[last] = codes, end
    history = np.empty_like(words)
    history[1:] = words[:-1]
    history[last - counts] = START
    return history, words, np.repeat(np.arange(n_docs, dtype=np.int32), counts + 1)


def _count_words(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        h, inverse = np.unique(h, return_inverse=True)
        return h, np.bincount(inverse, weights=n).astype(np.int64)

    for batch in batches:
        for begin, end, _, hashes in _tokens(batch):
            h, n = np.unique(hashes, return_counts=True)
            held.append((np.append(h, END), np.append(n, end - begin)))
            size += len(h)
        if size >= _FLUSH_TOKENS:
            held = [merged()]
            size = len(held[0][0])
            if size >= _FLUSH_TOKENS // 2:
                yield pa.record_batch({"word": held[0][0].view(np.int64), "n": held[0][1]})
                held, size = [], 0
    if held:
        h, n = merged()
        yield pa.record_batch({"word": h.view(np.int64), "n": n})


def _pack_pairs(h: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in which equal histories stand together."""
    first = np.flatnonzero(heads(h))
    return dump(planes(h[first]), narrow(np.diff(np.append(first, len(h)))), planes(w), narrow(n))


def _pair_arrays(blob: bytes):
    h, times, w, n = load(blob)
    return np.repeat(from_planes(h), times), from_planes(w), n.astype(np.int64)


def _count_pairs(lexicon):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            h, w = (np.concatenate(x) for x in zip(*held))
            key, part = lexicon.value.place(h, w)
            order = np.argsort(key)
            h, w, part = h[order], w[order], part[order]
            cut = np.flatnonzero(heads(h, w))
            n = np.diff(np.append(cut, len(h)))
            h, w, part = h[cut], w[cut], part[cut]
            bounds = np.searchsorted(part, np.arange(lexicon.value.parts + 1))
            return record_batch([(int(p), "count", _pack_pairs(*(x[bounds[p] : bounds[p + 1]] for x in (h, w, n)))) for p in np.unique(part)])

        for batch in batches:
            for begin, end, owner, hashes in _tokens(batch):
                codes = lexicon.value.codes(np.append(hashes, END))
                h, w, _ = _pairs(end - begin, owner, codes[:-1], codes[-1])
                held.append((h, w))
                size += len(h)
                if size >= _FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _merge_pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of pairs per partition, with the number of pairs of each small count."""
    h, w, n = (np.concatenate(x) for x in zip(*[_pair_arrays(b) for b in pdf["blob"]]))
    together = (mix64(h) & _HIGH) | (mix64(w) >> np.uint64(32))
    order = np.argsort(together)
    new = heads(h[order], w[order])
    if not np.array_equal(new, heads(together[order])):  # two pairs of one key: sort by the pairs themselves
        order = np.lexsort((w, h))
        new = heads(h[order], w[order])
    cut = np.flatnonzero(new)
    h, w, n = h[order][cut], w[order][cut], np.add.reduceat(n[order], cut)
    small = np.bincount(np.minimum(n, MAX_DISCOUNTED + 2), minlength=MAX_DISCOUNTED + 3)
    return pd.DataFrame({"part": [key[0]], "kind": ["pairs"], "blob": [_pack_pairs(h, w, n)], "small": [small[: MAX_DISCOUNTED + 2].tolist()]})


def _history_sums(lexicon, discounts: Discounts):
    """Per history of a partition: count, discounted count, and the probability of its frequent words."""

    def run(batches):
        for pdf in batches:
            for blob in pdf["blob"]:
                h, w, n = _pair_arrays(blob)
                cut = np.flatnonzero(heads(h))
                frequent = w < _RARE
                p = np.zeros(len(h))
                p[frequent] = lexicon.value.probability(lexicon.value.counts[w[frequent].astype(np.int64)])
                yield pd.DataFrame({"history": h[cut].view(np.int64), "n": np.add.reduceat(n, cut),
                                    "discounted": np.add.reduceat(discounts.mass(n), cut), "seen": np.add.reduceat(p, cut)})

    return run


def _rare_pairs(batches):
    for pdf in batches:
        for blob in pdf["blob"]:
            h, w, _ = _pair_arrays(blob)
            rare = w >= _RARE
            yield pd.DataFrame({"history": h[rare].view(np.int64), "code": w[rare].view(np.int64)})


def _code(word: str) -> Column:
    """The code of a word that isn't frequent, from its hash."""
    return F.shiftrightunsigned(F.col(word), 1).bitwiseOR(F.lit(-(1 << 63)))


@dataclass
class KatzModel:
    lexicon: Lexicon
    words: DataFrame
    pairs: DataFrame
    histories: DataFrame
    discounts: Discounts


def fit_katz(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> KatzModel:
    """The model of all texts of ``docs``; a null text is empty, and no text at all gives the unknown word probability one."""
    spark = docs.sparkSession
    rows = docs.select(id_col, text_col)
    words = rows.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(words)
    # an eighth of a power of two per step: a few hundred rows at any size of the corpus
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    room, least = head_words, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["types"]
        if room < 0:
            break
        least = r["least"]
    small = {r["n"]: r["types"] for r in words.where(F.col("n") <= MAX_DISCOUNTED + 1).groupBy("n").agg(F.count("*").alias("types")).collect()}
    discounts = Discounts.of(small)
    frequent = words.where(F.col("n") >= (least if least is not None else 1 << 62)).toArrow()
    hashes = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    total = sum(r["n"] for r in steps)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))
    documents = words.where(F.col("word") == int(END.view(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lexicon = Lexicon(hashes[order], frequent["n"].to_numpy()[order], total, sum(r["types"] for r in steps), discounts, 1.0, parts, documents)
    discounted = total - sum(c * small.get(c, 0) * (1 - f) for c, f in enumerate(discounts.factor.tolist()))
    lexicon = _good_lexicon(lexicon, discounted)
    shared = spark.sparkContext.broadcast(lexicon)
    pairs = materialise(rows.mapInArrow(_count_pairs(shared), ROW).groupBy("part").applyInPandas(_merge_pairs, ROW + ", small array<long>"))
    types = [F.sum(F.element_at("small", r + 1)).alias(f"n{r}") for r in range(1, MAX_DISCOUNTED + 2)]
    found = pairs.agg(*types).first()
    pair_discounts = Discounts.of({r: found[f"n{r}"] or 0 for r in range(1, MAX_DISCOUNTED + 2)})
    sums = "history long, n long, discounted double, seen double"
    direct = pairs.mapInPandas(_history_sums(shared, pair_discounts), sums)
    probability = discounts.column(F.col("n")) * lexicon.scale / max(total, 1)
    rare = words.where(F.col("n") < (least if least is not None else 1 << 62)).select(_code("word").alias("code"), probability.alias("p"))
    backed = (
        pairs.mapInPandas(_rare_pairs, "history long, code long").join(rare, "code").groupBy("history").agg(F.sum("p").alias("seen"))
        .select("history", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("discounted"), "seen")
    )
    histories = direct.unionByName(backed).groupBy("history").agg(*[F.sum(c).alias(c) for c in ("n", "discounted", "seen")])
    # a history whose pairs are all frequent has nothing left: it gives up one in n + 1
    scale = F.when(F.col("n") - F.col("discounted") < 1e-9 * F.col("n"), F.col("n") / (F.col("n") + 1)).otherwise(F.lit(1.0))
    histories = histories.withColumn("scale", scale).withColumn(
        "backoff", (1 - F.col("scale") * F.col("discounted") / F.col("n")) / F.greatest(1 - F.col("seen"), F.lit(1e-300)))
    return KatzModel(lexicon, words, pairs, materialise(histories.select("history", "n", "scale", "backoff")), pair_discounts)


def _pack_histories(lexicon):
    """Blobs of histories for every partition that holds pairs of them."""

    def run(batches):
        lex = lexicon.value
        for pdf in batches:
            h = pdf["history"].to_numpy().view(np.uint64)
            order = np.argsort(h)
            h = h[order]
            values = [pdf[c].to_numpy()[order] for c in ("n", "scale", "backoff")]
            spread = lex.spread(h).astype(np.int64)
            which = np.repeat(np.arange(len(h)), spread)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(spread) - spread, spread)
            part = part_of(mix64(h[which] + turn.astype(np.uint64) * _TURN), lex.parts)
            pair = np.unique(np.stack([part, which], axis=1), axis=0) if len(which) else np.zeros((0, 2), dtype=np.int64)
            rows = [(p, "histories", dump(sorted_planes(h[i]), *[v[i] for v in values])) for p, (i,) in by_target(pair[:, 0], pair[:, 1])]
            yield frame(rows)

    return run


def _ask(lexicon):
    """Pairs of all texts by partition, words that aren't frequent, and a line about every document."""

    def run(batches):
        lex: Lexicon = lexicon.value
        chunk = TaskContext.get().partitionId() << 20
        held, docs, size, n_docs = [], [], 0, 0
        floor = np.log10(lex.tokens + lex.types + 1)

        def flush():
            h, w, d = (np.concatenate(x) for x in zip(*held))
            rows = []
            frequent = w < _RARE
            counts = lex.counts[w[frequent].astype(np.int64)]
            base = np.bincount(d[frequent], weights=np.log10(counts + 1) - floor, minlength=n_docs)
            known = np.bincount(d[frequent], minlength=n_docs)
            tokens = np.bincount(d, minlength=n_docs)
            ids, held_out = (np.concatenate(x) for x in zip(*docs))
            rows.append((chunk % lex.parts, "doc", dump(chunk, ids, held_out, tokens, known, base)))
            rare_w, rare_d = w[~frequent], d[~frequent]
            order = np.lexsort((rare_d, rare_w))
            rare_w, rare_d = rare_w[order], rare_d[order]
            cut = np.flatnonzero(heads(rare_w, rare_d))
            times = np.diff(np.append(cut, len(rare_w)))
            rows.append((chunk % lex.parts, "rare", dump(chunk, rare_w[cut], rare_d[cut], times)))
            key, part = lex.place(h, w)
            order = np.argsort(key)
            h, w, d, part = h[order], w[order], d[order], part[order]
            bounds = np.searchsorted(part, np.arange(lex.parts + 1))
            for p in np.unique(part):
                s = slice(bounds[p], bounds[p + 1])
                cut = np.flatnonzero(heads(h[s], w[s]))
                n = np.diff(np.append(cut, s.stop - s.start))
                rows.append((int(p), "ask", dump(chunk, _pack_pairs(h[s][cut], w[s][cut], n), narrow(d[s]))))
            return record_batch(rows)

        for batch in batches:
            ids, out = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for begin, end, owner, hashes in _tokens(batch):
                codes = lex.codes(np.append(hashes, END))
                h, w, d = _pairs(end - begin, owner, codes[:-1], codes[-1])
                held.append((h, w, d + np.int32(n_docs)))
                docs.append((np.array(ids.slice(begin, end - begin).to_pylist(), dtype=object), out[begin:end]))
                size += len(h)
                n_docs += end - begin
                if size >= _FLUSH_TOKENS:
                    yield flush()
                    held, docs, size, n_docs = [], [], 0, 0
                    chunk += 1
        if held:
            yield flush()

    return run


def _answer(lexicon, discounts: Discounts):
    """Log probabilities of the asked pairs, summed by document; rare words that histories back off to."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lex: Lexicon = lexicon.value
        blobs = {k: g["blob"].tolist() for k, g in pdf.groupby("kind")}
        rows = [(load(b)[0], k, b) for k in ("doc", "rare") for b in blobs.get(k, [])]
        empty = np.zeros(0)
        parts = [load(b) for b in blobs.get("histories", [])]
        history = np.concatenate([from_sorted_planes(b[0]) for b in parts]) if parts else empty.astype(np.uint64)
        n, scale, backoff = (np.concatenate([b[i] for b in parts]) if parts else empty for i in (1, 2, 3))
        order = np.argsort(history)
        history, n, scale, backoff = history[order], n[order], scale[order], backoff[order]
        parts = [_pair_arrays(b) for b in blobs.get("pairs", [])]
        pair_h, pair_w, count = (np.concatenate(x) for x in zip(*parts)) if parts else (empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(np.int64))
        pair = mix64(pair_h * np.uint64(3) + mix64(pair_w))
        order = np.argsort(pair)
        pair, count = pair[order], count[order]
        for blob in blobs.get("ask", []):
            chunk, asked, d = load(blob)
            h, w, times = _pair_arrays(asked)
            value = np.zeros(len(h))
            known = np.zeros(len(h), dtype=bool)
            if len(history):
                at = np.minimum(np.searchsorted(history, h), len(history) - 1)
                known = history[at] == h
                at = at[known]
                k = mix64(h[known] * np.uint64(3) + mix64(w[known]))
                where = np.minimum(np.searchsorted(pair, k), max(len(pair) - 1, 0))
                seen = pair[where] == k if len(pair) else np.zeros(len(k), dtype=bool)
                found = np.flatnonzero(known)
                value[found[seen]] = np.log10(scale[at[seen]] * discounts.mass(count[where[seen]]) / n[at[seen]])
                value[found[~seen]] = np.log10(backoff[at[~seen]])
                lower = np.ones(len(h), dtype=bool)
                lower[found[seen]] = False
            else:
                lower = np.ones(len(h), dtype=bool)
            frequent = lower & (w < _RARE)
            value[frequent] += np.log10(lex.probability(lex.counts[w[frequent].astype(np.int64)]))
            owner = np.repeat(np.arange(len(h)), times)
            total = np.bincount(d, weights=value[owner])
            has = np.flatnonzero(np.bincount(d))
            rows.append((chunk, "sum", dump(narrow(has), total[has])))
            rare = (lower & (w >= _RARE))[owner]
            if rare.any():
                rows.append((chunk, "backed", dump(chunk, w[owner[rare]], d[rare].astype(np.int64), np.ones(int(rare.sum()), dtype=np.int64))))
        return frame(rows)

    return run


def _explode_rare(batches):
    for pdf in batches:
        for kind, blob in zip(pdf["kind"], pdf["blob"]):
            chunk, w, d, times = load(blob)
            yield pd.DataFrame({"chunk": np.full(len(w), chunk, dtype=np.int64), "doc": d.astype(np.int64), "code": w.view(np.int64),
                                "own": times if kind == "rare" else np.zeros(len(w), dtype=np.int64),
                                "backed": times if kind == "backed" else np.zeros(len(w), dtype=np.int64)})


def _total(key: tuple, blobs: pd.DataFrame, rare: pd.DataFrame) -> pd.DataFrame:
    """One row per document of a flush."""
    (_, ids, held_out, tokens, known, base), = [load(b) for k, b in zip(blobs["kind"], blobs["blob"]) if k == "doc"]
    score = np.zeros(len(ids))
    for k, b in sorted(zip(blobs["kind"], blobs["blob"])):
        if k == "sum":
            d, total = load(b)
            score[d.astype(np.int64)] += total
    rare = rare.sort_values("doc")
    d = rare["doc"].to_numpy(dtype=np.int64)
    known = known + np.bincount(d, weights=rare["known"], minlength=len(ids)).astype(np.int64)
    base = base + np.bincount(d, weights=rare["base"], minlength=len(ids))
    score = score + np.bincount(d, weights=rare["score"], minlength=len(ids))
    return pd.DataFrame({"id": pd.Series(ids, dtype=object), "held_out": held_out, "n_tokens": tokens, "n_known": known, "base_score": base, "score": score})


def score_katz(docs: DataFrame, model: KatzModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``score`` is the model's log10 probability of the text's words and its end; ``base_score`` that of single words
    with one added to every count.  A null or empty text has one token, its end.  Rows may repeat ids.
    """
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(model.lexicon)
    rows = docs.select(id_col, text_col, held_out.alias("_held_out"))
    asked = rows.mapInArrow(_ask(lexicon), ROW)
    tables = model.pairs.select("part", "kind", "blob").unionByName(model.histories.mapInPandas(_pack_histories(lexicon), ROW))
    answers = materialise(asked.unionByName(tables).groupBy("part").applyInPandas(_answer(lexicon, model.discounts), ROW))
    lex = model.lexicon
    rare = answers.where("kind IN ('rare', 'backed')").mapInPandas(_explode_rare, "chunk long, doc long, code long, own long, backed long")
    # several rows of a code can meet in one task, so codes are counted there before the exchange
    known = model.words.select(_code("word").alias("code"), F.col("n").alias("count"))
    count = F.coalesce(F.col("count"), F.lit(0))
    p = F.when(count > 0, lex.discounts.column(count) * lex.scale / max(lex.tokens, 1)).otherwise(F.lit(lex.unknown))
    rare = (
        rare.join(known, "code", "left")
        .groupBy(F.col("chunk").alias("part"), "doc")
        .agg(F.sum(F.when(count > 0, F.col("own")).otherwise(0)).alias("known"),
             F.sum(F.col("own") * (F.log10(count + 1) - float(np.log10(lex.tokens + lex.types + 1)))).alias("base"),
             F.sum(F.col("backed") * F.log10(p)).alias("score"))
    )
    id_type = dict(docs.dtypes)[id_col]
    out = answers.where("kind IN ('doc', 'sum')").groupBy("part").cogroup(rare.groupBy("part")).applyInPandas(
        _total, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(lex.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


@query("op5_katz_scores")
def op5(spark, d):
    """Scores of every document by a model of six sevenths of them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return score_katz(docs, fit_katz(docs.where(~held_out())), held_out())
