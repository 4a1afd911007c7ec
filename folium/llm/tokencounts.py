"""Token counts by offset-mapped attribution: whole documents are encoded once, and tokens are joined to sections by span.

Sections partition a document: its fields, in order, and within a field its lines, a line ending with its line break.
Fields are joined by one line break. Token spans come from the byte lengths of the tokens, mapped to code points; the
interval join of token spans and section spans goes by their sorted ends. A token that crosses a boundary is allocated
by a rule: `first` (the section of its first character), `last`, or `most` (the section of most of its characters, the
earlier one on a tie; the default). So a document's counts always add up to its number of tokens.

Cases: a null field is an empty one; an empty document has one empty section with no tokens; very long texts are encoded
whole; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import table

RULES = ("first", "last", "most")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class SpanEncoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last code point of every token."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) == len(text):
            return starts, ends - 1
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char_of[starts], char_of[ends - 1]


_ENCODERS: dict[str, SpanEncoder] = {}


def encoder(path: str) -> SpanEncoder:
    """One per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SpanEncoder(path)
    return _ENCODERS[path]


def line_ends(text: str) -> list[int]:
    """Where lines end, in code points, exclusive; the last one at the end of the text."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def allocate(first: np.ndarray, last: np.ndarray, ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of its first characters' tokens cross its end; ends are sorted and exclusive."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right")
    crossing = np.flatnonzero(a != b)
    to = b.copy() if rule == "last" else a.copy()
    if rule == "most":
        for t in crossing:
            edges = np.concatenate([[first[t]], ends[a[t] : b[t]], [last[t] + 1]])
            to[t] = a[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(to, minlength=len(ends)), np.bincount(a[crossing], minlength=len(ends))


def section_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), by_line: bool = True, rule: str = "most", path: str | None = None) -> DataFrame:
    """(doc_id, field, section, start, end, n_tokens, n_crossing, doc_tokens) for each section; places in code points of the joined fields."""
    where = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(where)
        for batch in batches:
            rows, out = [], []
            for row, values in enumerate(zip(*(batch.column(1 + i).to_pylist() for i in range(len(fields))), strict=True)):
                names, ends, parts, at = [], [], [], 0
                for i, value in enumerate(values):
                    part = ("" if value is None else value) + ("\n" if i + 1 < len(values) else "")
                    own = line_ends(part) if by_line else [len(part)]
                    names += [fields[i]] * len(own)
                    ends += [at + e for e in own]
                    parts.append(part)
                    at += len(part)
                edges = np.array(ends, np.int64)
                n, crossing = allocate(*encode.spans("".join(parts)), edges, rule)
                rows += [row] * len(ends)
                out.append((names, np.arange(len(ends), dtype=np.int32), np.concatenate([[0], edges[:-1]]), edges, n, crossing, np.full(len(ends), n.sum())))
            if out:
                names, *numbers = zip(*out, strict=True)
                made = [pa.array(list(chain.from_iterable(names)), pa.string()), *(pa.array(np.concatenate(x)) for x in numbers)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *made], names=columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
    chosen = docs.select("doc_id", *[F.col(f"`{f}`").cast("string") for f in fields])
    return chosen.mapInArrow(count, f"doc_id {kind}, field string, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with its tokens."""
    return section_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
