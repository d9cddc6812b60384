"""Token counts of fields or sections through offset-mapped attribution.

A document is encoded once as a whole.  The tokens' character spans are joined with the intervals of
its sections; both are ordered, so the join is a merge by binary search within the document.  A token
that crosses a boundary goes to one section by an explicit rule:

* ``start``: the section that holds its first character,
* ``end``: the section that holds its last character,
* ``most``: the section that holds most of its characters, the earlier one in a tie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_slices, texts_of
from .encode import encoder

RULES = ("start", "end", "most")


def count_tokens(df: DataFrame, tokenizer: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text", ends_col: str | None = None) -> DataFrame:
    """One row for each section: (id, section, start, end, n_tokens, n_crossing).

    Sections are consecutive character intervals given by ``ends_col`` (an array of increasing ends), by
    default the text's lines with their line feeds.  Text beyond the last end forms one more section;
    ends beyond the text give empty sections.  ``n_crossing`` counts tokens of the section that also
    reach into another.  Null and empty texts have one empty section.
    """
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    kind = df.schema[id_col].dataType.simpleString()
    ends = F.col(ends_col).cast("array<long>") if ends_col else F.lit(None).cast("array<long>")

    def run(batches):
        coder, schema = encoder(tokenizer, True, True), None
        for part in byte_slices(batches, budget=2 << 20):
            texts, given = texts_of(part), part.column(2).to_pylist()
            first, stop, counts = coder.spans(texts)
            stop = np.maximum(stop, first + 1)
            rows, numbers, starts, finals, sums, crossings, at = [], [], [], [], [], [], 0
            for i, (text, n) in enumerate(zip(texts, counts.tolist(), strict=True)):
                edges = section_ends(text, given[i])
                a, b = first[at : at + n], stop[at : at + n]
                at += n
                lo, hi = np.searchsorted(edges, a, "right"), np.searchsorted(edges, b - 1, "right")
                last = len(edges) - 1
                lo, hi = np.minimum(lo, last), np.minimum(hi, last)
                own, across = (hi if rule == "end" else lo), lo != hi
                if rule == "most" and across.any():
                    own = own.copy()
                    for j in np.flatnonzero(across).tolist():
                        inner = np.clip(np.concatenate([[0], edges]), a[j], b[j])
                        own[j] = int(np.argmax(np.diff(inner)))
                rows.append(np.full(len(edges), i))
                numbers.append(np.arange(len(edges)))
                starts.append(np.concatenate([[0], edges[:-1]]))
                finals.append(edges)
                sums.append(np.bincount(own, minlength=len(edges)))
                crossings.append(np.bincount(own[across], minlength=len(edges)))
            schema = schema or pa.schema([part.schema.field(0), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
            yield batch_of(schema, [part.column(0).take(pa.array(np.concatenate(rows))), *(np.concatenate(x) for x in (numbers, starts, finals, sums, crossings))])

    return df.select(F.col(id_col), F.col(text_col).cast("string"), ends.alias("ends")).mapInArrow(run, f"`{id_col}` {kind}, section int, start long, end long, n_tokens long, n_crossing long")


def section_ends(text: str, given: list[int] | None) -> np.ndarray:
    if given is None:
        edges = np.cumsum([len(x) + 1 for x in text.split("\n")], dtype=np.int64)
        edges[-1] -= 1  # no line feed after the last line
        return edges[:-1] if len(edges) > 1 and edges[-1] == edges[-2] else edges
    edges = np.minimum(np.array([x for x in given if x is not None], np.int64), len(text))
    edges = np.maximum.accumulate(edges) if len(edges) else edges
    return edges if len(edges) and edges[-1] >= len(text) else np.append(edges, len(text))
