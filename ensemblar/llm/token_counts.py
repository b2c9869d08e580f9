"""Token counts of sections by offset mapping.

A whole document is encoded once.  In byte-level encoding the tokens' bytes, laid
side by side, are the text, so the running sum of their lengths gives every token
its span.  The spans are interval-joined with the sections (lines, each with its
newline) by binary search.  A token over a boundary counts for the section that
holds most of its bytes, the earlier one on ties: the sections of a document add
up to the document.

The splitting rules run out of stack on very long runs of white space.  These are one piece
for the tokenizer, but for their last character where other text follows, so they are
encoded apart; the ids are those of the whole text.

Defined cases: a null or empty text is one section without tokens; repeated rows
each give their sections; further columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches

#: Characters of a run of white space from which on it is encoded apart.
LONG_RUN = 4096
# What \\s stands for in the tokenizer's rules.
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG = re.compile(rf"[{_BLANKS}]{{{LONG_RUN},}}")

_encodings: dict[int, tuple] = {}


def _encoding(ranks: bytes, pattern: str) -> tuple:
    """This worker's encoding and the number of bytes of each token."""
    key = hash((ranks, pattern))
    if key not in _encodings:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        size = np.zeros(max(table.values()) + 1, np.int64)
        size[list(table.values())] = [len(x) for x in table]
        _encodings.clear()
        _encodings[key] = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=table, special_tokens={}), size
    return _encodings[key]


def encode(encoding: "tiktoken.Encoding", text: str) -> list[int]:  # noqa: F821
    """The ids of a text under rules of which the last two are ``\\s+(?!\\S)`` and ``\\s+`` and no other takes white space beyond one blank in front."""
    ids, at = [], 0
    for m in _LONG.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += encoding.encode_ordinary(text[at : m.start()])
        ids += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def attribute(sizes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens counted for each section.

    sizes: bytes of each token in order; bounds: the sections' first bytes and the end of the last.
    """
    end = np.cumsum(sizes)
    first = np.searchsorted(bounds, end - sizes, "right") - 1
    last = np.searchsorted(bounds, end - 1, "right") - 1
    over = np.flatnonzero(first != last)
    for k in over.tolist():
        a, b = int(end[k] - sizes[k]), int(end[k])
        cut = np.clip(bounds[first[k] : last[k] + 2], a, b)
        first[k] += int(np.argmax(np.diff(cut)))
    n = len(bounds) - 1
    return np.bincount(first, minlength=n), np.bincount(first[over], minlength=n)


def section_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of each document: doc_id, section, first_char, n_chars, n_tokens, n_crossing."""
    if not pattern.endswith(r"\s+(?!\S)|\s+"):
        raise ValueError("the pattern's rules on white space are not known")
    bound_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of one size whatever the corpus

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoding(ranks.value, pattern)
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                data = np.frombuffer(text.encode(), np.uint8)
                bounds = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])
                if len(bounds) > 2 and bounds[-2] == len(data):
                    bounds = bounds[:-1]  # nothing stands after the last newline
                chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[bounds]
                tokens, crossing = attribute(size[np.array(encode(encoding, text), np.int64)], bounds) if len(data) else (np.zeros(1, np.int64),) * 2
                for x, v in zip(out, (np.arange(len(tokens)), chars[:-1], np.diff(chars), tokens, crossing), strict=True):
                    x.append(v)
                rows.append(len(tokens))
            if rows:
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), rows)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(x).astype(np.int64)) for x in out]], ["doc_id", "section", "first_char", "n_chars", "n_tokens", "n_crossing"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "doc_id long, section long, first_char long, n_chars long, n_tokens long, n_crossing long")
