"""Token counts: whole documents are encoded once, and tokens attributed to sections by offsets.

A byte-level BPE vocabulary gives each token's bytes, so the lengths of the tokens are their spans in
the text. Spans of tokens and sections are joined as sorted intervals. A token that crosses a
boundary goes to the section with most of its characters (ties: the earlier one), or to the one of
its first or last character, as ``rule`` says. A token within a character counts that character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[int, tuple[tiktoken.Encoding, np.ndarray]] = {}


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def build(ranks: dict[bytes, int], pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the byte length of every token."""
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(text: str, encoder: tiktoken.Encoding) -> np.ndarray:
    return np.asarray(encoder.encode_to_numpy(text, disallowed_special=()), np.int64)


def spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters [start, end) that each token touches."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    ends = np.cumsum(sizes[ids])
    if len(data) != (ends[-1] if len(ends) else 0):
        raise ValueError("the tokens do not make up the text")
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return before[ends - sizes[ids] + 1] - 1, before[ends]


def attribute(start: np.ndarray, end: np.ndarray, begins: np.ndarray, length: int,
              rule: str = "majority") -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary); sections begin at the rising
    ``begins`` and end where the next begins."""
    first = np.searchsorted(begins, start, "right") - 1
    last = np.searchsorted(begins, np.maximum(end - 1, start), "right") - 1
    crossing = np.flatnonzero(first != last)
    home = (last if rule == "last" else first).copy()
    if rule == "majority" and len(crossing):
        stops = np.append(begins[1:], length)
        most = np.zeros(len(crossing), np.int64)
        for k in range(int((last - first)[crossing].max()) + 1):
            at = np.minimum(first[crossing] + k, last[crossing])
            held = np.minimum(end[crossing], stops[at]) - np.maximum(start[crossing], begins[at])
            better = held > most
            most[better] = held[better]
            home[crossing[better]] = at[better]
    return np.bincount(home, minlength=len(begins)), len(crossing)


def _line_begins(text: str) -> np.ndarray:
    """Lines as sections; a line break belongs to the line it ends."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    after = np.flatnonzero(points == 10) + 1
    return np.concatenate(([0], after[after < len(points)]))


def count_tokens(docs: DataFrame, fields: tuple[str, ...] | None = None, rule: str = "majority",
                 vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_sections, n_crossing, section_tokens.

    Sections are the lines of ``text``; or, where ``fields`` are named, those columns, encoded as one
    text with a line break between two, which belongs to the field it ends. A null value is
    empty; an empty document has one section without tokens; an empty table gives no rows; repeated rows give
    repeated results; further columns are ignored. The vocabulary is read once, on the driver.
    """
    if rule not in ("majority", "first", "last"):
        raise ValueError(f"unknown rule {rule!r}")
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))  # a vocabulary's fixed size
    key = hash((vocabulary, pattern))
    kind = "n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<bigint>"

    @F.pandas_udf(kind)
    def counted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        if key not in _ENCODERS:
            _ENCODERS[key] = build(shared.value, pattern)
        encoder, sizes = _ENCODERS[key]
        for columns in batches:
            out = []
            columns = (columns,) if isinstance(columns, pd.Series) else columns  # one column comes bare
            for values in zip(*columns, strict=True):
                parts = [v if isinstance(v, str) else "" for v in values]
                text = "\n".join(parts)
                begins = (np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])[:-1])) if fields
                          else _line_begins(text))
                ids = encode(text, encoder)
                per, crossing = attribute(*spans(text, ids, sizes), begins, len(text), rule)
                out.append((len(ids), len(begins), crossing, per))
            yield pd.DataFrame(out, columns=["n_tokens", "n_sections", "n_crossing", "section_tokens"])
    names = [F.col(c).cast("string") for c in fields or ("text",)]
    return docs.select("doc_id", counted(*names).alias("c")).select("doc_id", "c.*")
