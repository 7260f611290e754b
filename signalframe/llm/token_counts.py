"""Token counts of sections by offsets: a text is encoded once, its tokens go to sections.

Byte-level tokens spell the text, so their lengths give every token's span in
characters; sections are spans too, and counting is an interval join of the two
sorted lists. A token that crosses a section's edge is allotted by a stated rule:
``start`` (where its first character lies), ``end`` (where its last one lies) or
``split`` (to each section by its share of the token's characters).
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

RULES = ("start", "end", "split")
_ENCODERS: dict[tuple[str, str], tuple] = {}


def encoder(path: str, pattern: str):
    """The encoding and each id's number of bytes."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODERS[path, pattern]


def line_spans(text: str) -> list[tuple[int, int]]:
    """Each line with its line break; the empty text is one empty line."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text) or not text:
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends))


def token_edges(raw: bytes, ids, sizes: np.ndarray) -> np.ndarray:
    """Byte edges of the tokens: token i spans ``edges[i] .. edges[i+1]``."""
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(sizes[np.asarray(ids, dtype=np.int64)], out=edges[1:])
    return edges


def allot(edges: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each span; spans are in the same unit as ``edges`` and may overlap."""
    if rule == "split":
        if len(edges) < 2:
            return np.zeros(len(starts))
        upto = lambda x: np.interp(x, edges, np.arange(len(edges)))
        return upto(ends) - upto(starts)
    at = edges[:-1] if rule == "start" else edges[1:] - 1
    n = np.searchsorted(at, ends) - np.searchsorted(at, starts)
    return np.maximum(n, 0).astype(np.float64)


def _run(path, pattern, sections, rule):
    def run(batches):
        enc, sizes = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                where, number, begin, end, counts, totals = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    raw = text.encode()
                    edges = token_edges(raw, enc.encode_ordinary(text), sizes)
                    spans = np.array(sections(text), dtype=np.int64).reshape(-1, 2)
                    # Characters to bytes: the k-th character starts at first[k].
                    if len(raw) == len(text):
                        own = spans
                    else:
                        first = np.r_[np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw)]
                        own = first[spans]
                    where += [i] * len(spans)
                    number.append(np.arange(len(spans)))
                    begin.append(spans[:, 0])
                    end.append(spans[:, 1])
                    counts.append(allot(edges, own[:, 0], own[:, 1], rule))
                    totals.append(np.full(len(spans), len(edges) - 1))
                join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(where, pa.int64())), join(number, pa.int32()), join(begin, pa.int64()), join(end, pa.int64()), join(counts, pa.float64()), join(totals, pa.int64())],
                    ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"],
                )

    return run


def attribute(docs: DataFrame, path: str, pattern: str, sections=line_spans, rule: str = "start") -> DataFrame:
    """``doc_id, section, start, end, n_tokens, doc_tokens``: one row per section of every row.

    ``sections`` maps a text to character spans, by default its lines. A null text
    is empty (one empty line, 0 tokens); rows that repeat give their sections
    again; text outside all sections counts in ``doc_tokens`` only; an empty table
    gives an empty one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_run(path, pattern, sections, rule), "doc_id long, section int, start long, end long, n_tokens double, doc_tokens long")
