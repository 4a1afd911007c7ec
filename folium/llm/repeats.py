"""Substring dedup: passages of at least a window of words that begin in an earlier document, by prefix-partitioned suffix trees.

A suffix begins at each word; trees are cut at the depth of a window, since that is where a passage counts as repeated.
Suffixes are dealt to tasks by a prefix of as many words as it takes to fill PREFIX bytes, so a prefix has few words where they
are long (and telling) and many where they are short; the number of groups of prefixes grows with the suffixes, so that the
trees of a group fit in memory. In a group, suffixes are sorted, which lays out its trees leaf by leaf: neighbours with a common
prefix of a whole window hang on one deep internal node, and the node's smallest document keeps the passage. Maximal
repeats are the runs of covered words that deep nodes leave in a document.

Texts are first cut into chunks, written once as they are; all that is sent afterwards refers to a chunk, and is answered by one
bit for each thing asked. Only suffixes that can repeat are sent: of each window the smallest hash of its runs of ANCHOR words
is its anchor, equal windows have equal anchors, and windows whose anchor no other document has are left out. Equal suffixes
of a chunk are sent once, with their smallest document, so a passage that a third of all documents share is one row a
chunk. Hashes only choose what is compared: suffixes are compared as words.

Cases: null, empty and short texts have no window and stay whole; a null doc_id is neither smaller nor larger than another, so
such rows keep all and take nothing; rows that repeat a doc_id are documents of their own, none of them smaller; very long
texts are chunks of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folium.llm.common import Scratch, map_groups, table, utf8

#: Words of a window.
WINDOW = 13
#: Bytes that a prefix has at least, and words of an anchor's run.
PREFIX, ANCHOR = 24, 7
#: Bytes of text in a chunk; windows for each bucket of anchors and each group of prefixes; fewest of both.
CHUNK, PER_BUCKET, PER_GROUP, FEWEST = 2_000_000, 4_000_000, 2_000_000, 48
#: Answers are joined by broadcast up to so many bytes; beyond, by a shuffle.
BROADCAST_BYTES = 32_000_000

#: Odd, so that its powers have inverses modulo 2**64.
_BASE, _MIX = 0x9E3779B97F4A7C15 | 5, np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64


def packed(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


class Chunk:
    """Documents whose words are joined by spaces and ended by a line feed, with the windows and what asks about them."""

    def __init__(self, ids: list[int | None], lines: bytes, window: int):
        self.ids, self.window, self.lines = ids, window, lines
        self.known = np.array([i is not None for i in ids], bool)
        self.doc = np.array([i or 0 for i in ids], np.int64)
        text = np.frombuffer(lines, np.uint8)
        gaps = np.flatnonzero((text == 32) | (text == 10))
        begin = np.concatenate([[0], gaps[:-1] + 1]).astype(np.int64)
        real = gaps > begin  # an empty document is a line without a word
        last = np.cumsum(text[gaps] == 10) - (text[gaps] == 10)
        self.begin, self.end, self.owner = begin[real], gaps[real], last[real]
        self.n_words = np.bincount(self.owner, minlength=len(ids))
        n = len(self.begin) - window + 1
        here = np.arange(max(n, 0))
        self.starts = here[(self.owner[here] == self.owner[here + window - 1]) & self.known[self.owner[here]]] if n > 0 else here
        self.text = text

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the bytes from each word `first` to the end of each word `last`, from sums that all runs share."""
        power, inverse = powers(len(self.text))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum((self.text.astype(_U) + _U(1)) * power)])
        start = self.begin[first]
        h = (sums[self.end[last]] - sums[start]) * inverse[start]
        h = (h ^ (h >> _U(32))) * _MIX
        return (h ^ (h >> _U(29))) * _MIX

    def anchors(self) -> np.ndarray:
        """Of each window, the smallest hash of its runs of ANCHOR words; the lowest bit is free."""
        width = min(ANCHOR, self.window)
        if not len(self.starts):
            return np.empty(0, _U)
        first = np.arange(len(self.begin) - width + 1)
        h = self.hashes(first, first + width - 1)
        least = h[self.starts]
        for s in range(1, self.window - width + 1):
            np.minimum(least, h[self.starts + s], out=least)
        return least & ~_U(1)

    def asked_anchors(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, sorted distinct anchors); the lowest bit tells that several documents of the chunk have it."""
        anchors = self.anchors()
        if not len(anchors):
            return
        order = np.argsort(anchors, kind="stable")
        value, first = np.unique(anchors[order], return_index=True)
        docs = self.doc[self.owner[self.starts]][order]
        several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
        for bucket, part in slices(bucket_of(value, buckets)):
            yield bucket, value[part] | several[part].astype(_U)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """The windows whose anchor is shared; a flag for each of the chunk's distinct anchors, ascending."""
        return self.starts[shared[np.unique(self.anchors(), return_inverse=True)[1]]] if len(self.starts) else self.starts

    def groups(self, windows: np.ndarray, groups: int) -> np.ndarray:
        """The group of each suffix, by the hash of its variable-length prefix."""
        goal = self.begin[windows] + PREFIX
        last = np.minimum(np.searchsorted(self.end, goal), windows + self.window - 1)
        return bucket_of(self.hashes(windows, last), groups)

    def suffixes(self, windows: np.ndarray, groups: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """(group, distinct suffixes in order of their first, their smallest documents, windows of the group, the suffix of each)."""
        of = self.groups(windows, groups)
        order = np.argsort(of, kind="stable")
        lo, hi, docs, lines = self.begin[windows], self.end[windows + self.window - 1], self.doc[self.owner[windows]], self.lines
        for group, part in slices(of[order]):
            at = order[part]
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(lines[i:j], len(number)) for i, j in zip(lo[at].tolist(), hi[at].tolist(), strict=True)], np.int64)
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, which, docs[at])
            yield group, list(number), least, at, which


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the largest chunk so far."""
    if not hasattr(powers, "kept") or len(powers.kept[0]) < n:
        inverse = pow(_BASE, -1, 2**64)
        powers.kept = tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, b, _U))])[: n + 1] for b in (_BASE, inverse))
    return powers.kept[0][:n], powers.kept[1]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A number under n by the upper bits, so that sorted hashes have sorted buckets."""
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, its slice) of sorted keys."""
    key, first = np.unique(sorted_keys, return_index=True)
    edges = [*first.tolist(), len(sorted_keys)]
    for k, i, j in zip(key.tolist(), edges, edges[1:], strict=False):
        yield k, slice(i, j)


def written_chunks(scratch: Scratch, docs: DataFrame, window: int, limit: int) -> DataFrame:
    """(chunk, ids, lines, windows): documents of a few MB of text together, in the order of their partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, lines, held, windows = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([b"\n".join(lines) + b"\n"], pa.binary()), pa.array([windows])], names=["chunk", "ids", "lines", "windows"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = utf8(text.as_py()).split()
                line = b" ".join(words)
                if ids and held + len(line) > limit:
                    yield row()
                    seq, ids, lines, held, windows = seq + 1, [], [], 0, 0
                ids.append(doc)
                lines.append(line)
                held, windows = held + len(line) + 1, windows + max(0, len(words) - window + 1)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return scratch.write(rows.mapInArrow(cut, "chunk long, ids array<long>, lines binary, windows long"), "chunks")


def each_chunk(chunks: DataFrame, work: Callable[..., Iterator[tuple]], schema: str, window: int) -> DataFrame:
    """work(chunk number, Chunk, answers...) for each row of chunks; work yields tuples of the schema."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, lines, *answers = (c[i].as_py() for c in batch.columns)
                rows = list(work(number, Chunk(ids, lines, window), *answers))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return chunks.mapInArrow(run, schema)


def answered(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """chunks with their answers (key, bits), ascending by key, in one array. There are fewer bits than a chunk has words."""
    size = answers.agg(F.sum(F.length("bits") + 24)).first()[0] or 0
    by_chunk = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("key", "bits"))).alias(name))
    return chunks.join(F.broadcast(by_chunk) if size <= BROADCAST_BYTES else by_chunk, "chunk", "left")


def flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def shared_anchors(rows: dict[str, np.ndarray]) -> list[tuple]:
    """For each chunk's anchors of one bucket, whether several documents have them."""
    asked = [np.frombuffer(blob, _U) for blob in rows["blob"]]
    values = np.concatenate(asked)
    value, which, times = np.unique(values | _U(1), return_inverse=True, return_counts=True)
    shared = times > 1
    shared[which[(values & _U(1)) == 1]] = True
    out, at = [], 0
    for chunk, key, blob in zip(rows["chunk"], rows["key"], asked, strict=True):
        mine = shared[which[at : at + len(blob)]]
        at += len(blob)
        if mine.any():
            out.append((int(chunk), int(key), np.packbits(mine).tobytes(), len(blob)))
    return out


def deep_nodes(rows: dict[str, np.ndarray]) -> list[tuple]:
    """For each chunk's suffixes of one group, whether a smaller document holds them too.

    Sorting the leaves lays out the group's trees; a deep internal node is a run of leaves with a whole window in common.
    """
    leaves, asked = [], []
    for n, (blob, least) in enumerate(zip(rows["blob"], rows["least"], strict=True)):
        mine, docs = unpacked(blob).split(b"\n"), np.frombuffer(unpacked(least), np.int64)
        asked.append(np.zeros(len(mine), bool))
        leaves += zip(mine, docs.tolist(), [n] * len(mine), range(len(mine)), strict=True)
    leaves.sort()
    node = None
    for suffix, doc, n, i in leaves:
        if suffix != node:
            node, smallest = suffix, doc  # leaves of a node come by ascending document
        elif doc > smallest:
            asked[n][i] = True
    return [(int(chunk), int(key), np.packbits(bits).tobytes(), len(bits)) for chunk, key, bits in zip(rows["chunk"], rows["key"], asked, strict=True) if bits.any()]


def covered_words(chunk: Chunk, windows: np.ndarray, groups: int, found: dict[int, bytes]) -> np.ndarray:
    """A flag for each word of the chunk, whether a repeated window covers it."""
    turns = np.zeros(len(chunk.begin) + 1, np.int64)
    docs = chunk.doc[chunk.owner[windows]]
    for group, suffixes, least, at, which in chunk.suffixes(windows, groups):
        earlier = flags(found[group], len(suffixes))[which] if group in found else np.zeros(len(at), bool)
        start = windows[at[earlier | (docs[at] > least[which])]]
        turns[start] += 1  # windows of a chunk start at different words
        np.subtract.at(turns, start + chunk.window, 1)
    return np.cumsum(turns)[:-1] > 0


def repeated_passages(docs: DataFrame, window: int = WINDOW, kept_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept) for each row of docs (doc_id, text).

    spans are the maximal repeats to remove, as arrays of first word and number of words; kept is the text without them, its
    words joined by one space, or null unless asked for.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    chunks = written_chunks(scratch, docs, window, CHUNK)
    n = chunks.agg(F.sum("windows")).first()[0] or 0
    buckets, groups = max(FEWEST, n // PER_BUCKET), max(FEWEST, n // PER_GROUP)
    texts = chunks.select("chunk", "ids", "lines")

    def ask_anchors(number: int, chunk: Chunk) -> Iterator[tuple]:
        for bucket, anchors in chunk.asked_anchors(buckets):
            yield number, bucket, anchors.tobytes()

    asked = each_chunk(texts, ask_anchors, "chunk long, key long, blob binary", window)
    shared = scratch.write(map_groups(asked, ["key"], shared_anchors, "chunk long, key long, bits binary, n long"), "shared")

    def candidates(chunk: Chunk, answers: list[dict] | None) -> np.ndarray:
        if not answers or not len(chunk.starts):
            return chunk.starts[:0]
        yes = {a["key"]: a["bits"] for a in answers}
        value = np.unique(chunk.anchors())
        told = np.zeros(len(value), bool)
        for bucket, part in slices(bucket_of(value, buckets)):
            if bucket in yes:
                told[part] = flags(yes[bucket], part.stop - part.start)
        return chunk.candidates(told)

    def ask_suffixes(number: int, chunk: Chunk, answers: list[dict] | None) -> Iterator[tuple]:
        for group, suffixes, least, _, _ in chunk.suffixes(candidates(chunk, answers), groups):
            yield number, group, packed(b"\n".join(suffixes)), packed(least.tobytes())

    told = answered(texts, shared, "shared")
    asked = each_chunk(told, ask_suffixes, "chunk long, key long, blob binary, least binary", window)
    repeated = scratch.write(map_groups(asked, ["key"], deep_nodes, "chunk long, key long, bits binary, n long"), "repeated")

    def remove(number: int, chunk: Chunk, answers: list[dict] | None, found: list[dict] | None) -> Iterator[tuple]:
        gone = covered_words(chunk, candidates(chunk, answers), groups, {a["key"]: a["bits"] for a in found or []})
        ends = np.cumsum(chunk.n_words)
        for i, (doc, stop) in enumerate(zip(chunk.ids, ends.tolist(), strict=True)):
            words = slice(stop - int(chunk.n_words[i]), stop)
            out = gone[words]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
            begin, end = chunk.begin[words], chunk.end[words]
            # what stays is cut from the line in runs of words
            runs = np.concatenate([[0], edges, [len(out)]]).reshape(-1, 2).tolist()
            kept = b" ".join(chunk.lines[begin[a] : end[b - 1]] for a, b in runs if b > a)
            spans = [{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()]
            yield doc, len(out), int(out.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode("utf-8", "surrogatepass") if kept_text else None

    last = answered(told, repeated, "repeated")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,length:long>>, kept string"
    return each_chunk(last, remove, schema, window)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), w AS (
  SELECT rid, doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM d WHERE doc_id IS NOT NULL
), x AS (
  SELECT rid, doc_id, pos, array_to_string(list_slice(words, pos, pos + 12), ' ') AS s FROM w
), f AS (
  SELECT s, min(doc_id) AS least FROM x GROUP BY s
), c AS (
  SELECT DISTINCT rid, pos + o AS pos FROM x JOIN f USING (s), (SELECT unnest(range(13)) AS o) WHERE x.doc_id > f.least
), k AS (
  SELECT t.rid, count(c.pos) AS n_removed, string_agg(t.word, ' ' ORDER BY t.pos) FILTER (c.pos IS NULL) AS kept
  FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d) t LEFT JOIN c ON c.rid = t.rid AND c.pos = t.pos GROUP BY t.rid
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.rid = d.rid
"""
