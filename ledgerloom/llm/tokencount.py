"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole. Its sections are its lines, each with the line end that closes it. Tokens and
sections are both intervals of the text's bytes and are joined by their overlap: a token inside one section
counts there; a token across a boundary counts for the section that holds most of its bytes, the earlier one of
equals (rule ``majority``), or for the section of its first byte (rule ``first``). So the sections' counts always
sum to the document's.

Edge cases: null and empty texts have one empty section without tokens; repeated rows are counted alike; an
empty table gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .common import arrow

_FIELDS = {"doc_id": pa.int64(), "section": pa.int32(), "start": pa.int64(), "end": pa.int64(), "n_tokens": pa.int64(), "n_crossing": pa.int64()}
RULES = ("majority", "first")


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Section of every token, and whether it crosses a boundary.

    ends: byte offset after each token; bounds: byte offset after each section; both increase, both end together.
    """
    starts = np.concatenate([[0], ends])[:-1]
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    owner, crossing = first.copy(), last > first
    if rule == "majority":
        for t in np.flatnonzero(crossing):  # few: a token is a few bytes
            edges = np.concatenate([[starts[t]], bounds[first[t] : last[t]], [ends[t]]])
            owner[t] += int(np.argmax(np.diff(edges)))
    return owner, crossing


def line_bounds(data: bytes) -> np.ndarray:
    """Byte offset after each line; a text that ends in a line end has no empty line after it."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def section_counts(documents: DataFrame, rule: str = "majority") -> DataFrame:
    """One row per document and line: doc_id, section (from 0), start, end (code points), n_tokens, n_crossing.

    n_tokens: tokens allocated to the section; n_crossing: those of them that reach into another section.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = tokens.byte_lengths()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _FIELDS}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                bounds = line_bounds(data)
                ends = np.cumsum(size[tokens.ids(text or "")])
                owner, crossing = attribute(ends, bounds, rule)
                chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                after = np.where(bounds > 0, chars[bounds - 1] if len(data) else 0, 0)
                out["doc_id"] += [doc_id] * len(bounds)
                out["section"] += range(len(bounds))
                out["start"] += [0, *after[:-1].tolist()]
                out["end"] += after.tolist()
                out["n_tokens"] += np.bincount(owner, minlength=len(bounds)).tolist()
                out["n_crossing"] += np.bincount(owner[crossing], minlength=len(bounds)).tolist()
            yield arrow(_FIELDS, out)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens long, n_crossing long")
