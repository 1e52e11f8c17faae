import hashlib
import random
from collections import Counter

import pytest

from eventlens.llm import alignment as A
from tests.llm.helpers import SF, awkward, documents, frame


@pytest.fixture(scope="module")
def codecs():
    from tokenizers import Tokenizer

    import sentencepiece

    a = Tokenizer.from_file(A.TOKENIZER_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=A.TOKENIZER_B)
    return a, b, A.ByteCodec(open(A.TOKENIZER_A, "rb").read()), A.PieceCodec(open(A.TOKENIZER_B, "rb").read())


def brute(rows, codecs):
    """Whole texts encoded at once, shared ends by set intersection."""
    a, b, codec_a, codec_b = codecs
    aligned = []
    for doc_id, text in rows:
        groups = []
        if text:
            data = (" " + text).encode()
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba, bb = [codec_a.bytes_of[i] for i in ia], [codec_b.bytes_of[i] for i in ib]
            if b"".join(ba) == data == b"".join(bb):
                ends = []
                for pieces in (ba, bb):
                    at = 0
                    ends.append([at := at + len(p) for p in pieces])
                shared = sorted(set(ends[0]) & set(ends[1]))
                x = y = 0
                for s in shared:
                    x2, y2 = ends[0].index(s, x) + 1, ends[1].index(s, y) + 1
                    groups.append((ia[x:x2], ib[y:y2]))
                    x, y = x2, y2
        aligned.append((doc_id, groups))
    links = Counter((g[0][-1], g[1][-1]) for _, groups in aligned for g in groups)
    best = {}
    for (x, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, groups in aligned:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        of = [(p[-1], q[-1]) for p, q in groups]
        out.append((doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(groups),
                    sum(links[x] == best[x[1]] for x in of), sum(links[x] for x in of),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd_texts():
    rng = random.Random(5)
    marks = [" ", "  ", "\n", "\t", " \n ", "\u00a0", "\u3000", "\u2003", "\u1680", "\u205f", "\u2019", "a", "the", "don't", "\u00c9", "\u00df",
             "\u6f22\u5b57", "\U0001f600", "\0", "123456", "...", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\x7f", "\x1c", "\x85", "e\u0301",
             "\ufb01", "\u200b"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(600)]
    return texts + ["\u2581", "a \u2581b", " ", "  ", "   ", "a ", "a  ", "<|endoftext|>", "<unk>", "\ufeff", "x" * 5000, "\u6f22" * 3000, " " * 3000, "ab" * 4000 + " c"]


def test_whole_table_against_whole_texts(spark, codecs):
    rows = [(r[0], r[1]) for r in documents()]
    got = result(A.op11(spark, SF))
    assert got == brute(rows, codecs)
    assert sum(r[1] > 0 for r in got) > 0.9 * len(rows)


def test_odd_texts(spark, codecs):
    rows = list(enumerate(odd_texts()))
    got = result(A.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute(rows, codecs)


def test_groups_are_returned(spark, codecs):
    rows = [(1, "An unbelievable re-tokenisation")]
    df = A.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), with_groups=True)
    r = df.collect()[0]
    assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] == brute(rows, codecs)[0][-1]


def test_chunks_and_whole_texts_as_segments(spark, codecs, monkeypatch):
    import pyarrow as pa

    rows = [(i, t) for i, t in enumerate(odd_texts()[:200])]
    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    parts = list(A.chunks([batch], 300))
    assert len(parts) > 5 and [x for p in parts for x in p.column("id").to_pylist()] == [r[0] for r in rows]
    _, _, a, b = codecs
    cut = A.load(A._encode_chunk(next(A.chunks([batch])), A.Encoder(a, b), True)[0])
    monkeypatch.setattr(b, "cuts", False)
    whole = A.load(A._encode_chunk(next(A.chunks([batch])), A.Encoder(a, b), True)[0])
    assert cut[2] == whole[2] and cut[-1] == whole[-1]
    # an encoder that keeps forgetting gives the same
    monkeypatch.setattr(b, "cuts", True)
    monkeypatch.setattr(A, "KEPT_TOKENS", 50)
    forgetful = A.Encoder(a, b)
    shas = [x for p in A.chunks([batch], 300) for x in A.load(A._encode_chunk(p, forgetful, True)[0])[2]]
    assert shas == cut[2]


def test_divide_and_conquer_finds_every_shared_end():
    import numpy as np

    rng = random.Random(9)
    for n in (1, 2, 5, 50, 700):
        for share in (0.0, 0.02, 0.5, 1.0):
            ends_a = sorted(rng.sample(range(1, 4 * n + 1), n - 1)) + [4 * n + 1]
            ends_b = sorted({e for e in ends_a if rng.random() < share} | {e + 1 for e in ends_a[:-1] if rng.random() < 0.3} | {4 * n + 1})
            a, b = A.shared_cuts(np.array(ends_a), np.array(ends_b), np.array([0, len(ends_a)]), np.array([0, len(ends_b)]))
            shared = sorted(set(ends_a) & set(ends_b))
            assert [ends_a[i] for i in a] == shared == [ends_b[i] for i in b]


def test_awkward_rows(spark, codecs):
    docs = frame(spark, awkward(), id="1", pair="2", chunk="'x'", n_a="3")
    assert result(A.align_tokenizers(docs)) == brute([(r[0], r[1]) for r in awkward()], codecs)
    assert A.align_tokenizers(docs.limit(0)).collect() == []
    nothing = result(A.align_tokenizers(docs.where("doc_id in (3, 4)")))
    assert nothing == [(3, 0, 0, 0, 0, 0, 0, ""), (4, 0, 0, 0, 0, 0, 0, "")]
