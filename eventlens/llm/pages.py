"""Main text of web pages by wrappers that are inferred from all pages of a host.

Every page gives its folded expression (``wrappers``).  Equal expressions of a host are summed in the tasks that read
them, so what is exchanged are expressions and not pages.  Expressions of a host are aligned in rounds: in buckets by
hash, then buckets together, until one wrapper is left; within a bucket in the order of their hashes.  So a host with
a third of all pages is spread over all tasks, and the result doesn't depend on how the input is split.  The wrapper
of a host then reads its pages; pages aren't exchanged unless the table of wrappers is too large for Spark to send it
to all tasks.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import wrappers as W
from eventlens.llm.common import query, table
from eventlens.session import materialise

#: Bits of the buckets of each round in which a host's expressions are aligned.
ROUNDS = (16, 8, 0)
#: Distinct expressions that a task sums before it passes them on, and readings that it keeps.
HELD = 1 << 13
#: Pages of a record batch that are handled together.
ROWS = 256
_ROW = "host string, bucket long, hash long, form binary, seen binary"


def _pack(value) -> bytes:
    return zstandard.compress(pickle.dumps(value, 5), 1)


def _unpack(data: bytes):
    return pickle.loads(zstandard.decompress(data))


def _sum_seen(a: list, b: list) -> list:
    return [[x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4])] for x, y in zip(a, b)]


def host_of(url) -> F.Column:
    """The host in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]*)", 1), F.lit("")))


def _expressions(batches):
    """(host, hash, form, statistics) of the distinct expressions of a task's pages."""
    held: dict = {}

    def rows():
        out = [(host, 0, _hash(form), pickle.dumps(form, 5), _pack(seen)) for (host, form), seen in held.items()]
        held.clear()
        return pd.DataFrame(out, columns=["host", "bucket", "hash", "form", "seen"])

    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                page, _ = W.parse(source or "")
                key, seen = (host, W.frozen(page)), [s.seen for s in W.slots(page)]
                held[key] = _sum_seen(held[key], seen) if key in held else seen
            if len(held) > HELD:
                yield pa.RecordBatch.from_pandas(rows(), schema=_SCHEMA, preserve_index=False)
    yield pa.RecordBatch.from_pandas(rows(), schema=_SCHEMA, preserve_index=False)


_SCHEMA = pa.schema([("host", pa.string()), ("bucket", pa.int64()), ("hash", pa.int64()), ("form", pa.binary()), ("seen", pa.binary())])


def _hash(form: tuple) -> int:
    return int(np.uint64(W.xxhash.xxh64_intdigest(repr(form).encode("utf-8", "surrogatepass"))).view(np.int64))


def _align(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for all expressions of a (host, bucket)."""
    forms: dict = {}
    for h, form, seen in zip(rows["hash"], rows["form"], rows["seen"]):
        key, seen = (int(h), form), _unpack(seen)
        forms[key] = _sum_seen(forms[key], seen) if key in forms else seen
    wrapper = None
    for h, form in sorted(forms):
        items = W.thawed(pickle.loads(form), iter(forms[h, form]))
        wrapper = items if wrapper is None else W.align(wrapper, items)
    form = W.frozen(wrapper)
    first = rows.iloc[0]
    return pd.DataFrame([(first["host"], int(first["bucket"]), _hash(form), pickle.dumps(form, 5), _pack([s.seen for s in W.slots(wrapper)]))],
                        columns=["host", "bucket", "hash", "form", "seen"])


def _judge(batches):
    for batch in batches:
        hosts, out = batch.column("host").to_pylist(), []
        for form, seen in zip(batch.column("form").to_pylist(), batch.column("seen").to_pylist()):
            items = W.thawed(pickle.loads(form), iter(_unpack(seen)))
            W.judge(items)
            out.append(_pack(W.compiled(items)))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(out, pa.binary())], ["of_host", "wrapper"])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: of_host and its wrapper with verdicts.  Pages without a host have no common template."""
    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html")).where("host <> ''")
    forms = rows.mapInArrow(_expressions, _ROW)
    for bits in ROUNDS:
        forms = forms.withColumn("bucket", F.pmod(F.col("hash"), F.lit(1 << bits)) if bits == ROUNDS[0] else F.pmod(F.col("bucket"), F.lit(1 << bits)))
        forms = forms.groupBy("host", "bucket").applyInPandas(_align, _ROW)
    return materialise(forms.mapInArrow(_judge, "of_host string, wrapper binary"))


def _extract():
    def run(batches):
        verdicts: dict = {}
        opened: dict = {}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part, out = batch.slice(at, ROWS), []
                for source, wrapper in zip(part.column("_html").to_pylist(), part.column("_wrapper").to_pylist()):
                    page, texts = W.parse(source or "")
                    key = wrapper, W.frozen(page)
                    if key not in verdicts:
                        if len(verdicts) > HELD:
                            verdicts.clear()
                            opened.clear()
                        W.judge(page)
                        if wrapper is not None:
                            if wrapper not in opened:
                                opened[wrapper] = W.opened(_unpack(wrapper))
                            W.read(page, opened[wrapper])
                        verdicts[key] = [s.verdict for s in W.slots(page)]
                    for slot, verdict in zip(W.slots(page), verdicts[key]):
                        slot.verdict = verdict
                    out.append(W.main_text(page, texts))
                columns = [part.column(c) for c in part.schema.names if c not in ("_html", "_wrapper")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                                 [c for c in part.schema.names if c not in ("_html", "_wrapper")] + ["text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the page itself, if None) of every row, with ``text`` and ``n_chars``.

    A null or empty page has an empty text.  A page whose address is null or has no host, and the only page of a host,
    is read by its own expression.  Repeated rows give repeated results and count each.  Columns of ``pages`` named
    text or n_chars are replaced; an empty table gives an empty result.
    """
    keep = [c for c in (keep or pages.columns) if c not in ("text", "n_chars", *([] if keep else [html_col]))]
    wrappers = infer_wrappers(pages, url_col, html_col)
    own = {c: f"_column_{i}" for i, c in enumerate(keep)}
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col(f"`{html_col}`").cast("string").alias("_html"), host_of(F.col(f"`{url_col}`")).alias("_host"))
    joined = rows.join(wrappers, F.col("_host") == F.col("of_host"), "left").select(*own.values(), "_html", F.col("wrapper").alias("_wrapper"))
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join([f"{n} {types[c]}" for c, n in own.items()] + ["text string", "n_chars long"])
    done = joined.mapInArrow(_extract(), schema)
    return done.select(*[F.col(n).alias(c) for c, n in own.items()], "text", "n_chars")


@query("op13_extract_pages")
def op13(spark, d):
    """Main text of every page."""
    return extract_pages(table(spark, d, "pages"), keep=["page_id", "url"])
