"""Spans of a text and the columns that the span operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def span_table(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], kinds: tuple[str, ...], order: Callable[[Span], tuple], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_<kind>.., base_sha256, spans. find gives base spans and added ones; code points, end exclusive."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in kinds}
        shas, texts = [], []
        for text in batch.column(1):
            base, added = find(text.as_py())
            base = sorted(base, key=order)
            for k in kinds:
                counts[k].append(sum(s[0] == k for s in base))
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            texts.append(joined(sorted({*base, *added}, key=order)))
        cols = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in kinds), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"
    return common.map_batches(common.id_text(docs, id_col, text_col), f, schema)
