"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph digests.

A text's paragraphs (lines) are cut into blocks of about four words, at places that the bytes before a blank decide,
so an edit changes the blocks around it and no others. A block's digest hashes its bytes and how often they came before
in the text, which makes a set. The sketch of a set adds every digest to one cell of each of three tables: a count, the
xor of the digests and the xor of their checks. A table has a power of two of cells, about as many in all as the set has
digests, so a sketch folds exactly into any smaller one.

The fingerprint is the sketch, in base64, and all that a comparison needs. Two fingerprints are folded to a small size and
subtracted, and peeling (cells of count one whose check fits name a digest, which is then removed everywhere) recovers the
digests that differ; where that fails it is retried at four times the size, up to the smaller fingerprint's own. Differences
beyond that, of texts with little in common, are estimated from the squared counts of the subtracted cells, within what the
two sets' sizes allow. The likeness is 1 - |difference| / (sum of set sizes), 1 if both are empty; it is a function of the two
strings (`likeness`).

`successor_pairs` brings every document's text and that of the next doc_id to one task: ranges of doc_id between drawn
splitters, each also given the first row of the next range, are sorted and streamed, so no window spans the table.

Cases: null and empty texts have the empty set; equal doc_ids are ordered by text; a null doc_id comes first; a single
document follows itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import Scratch, int_array, table

#: Cells of a table at least, and digests per cell of a table at most; the factor after a failure.
LEAST, LOAD, LARGER = 16, 2.5, 4
TABLES = 3
#: Bytes of text in a range, the most ranges, drawn ids per range; texts sketched together.
RANGE_BYTES, MAX_RANGES, DRAWN = 6_000_000, 1 << 17, 24
TOGETHER, TOGETHER_BYTES = 1000, 1_500_000

U64 = np.uint64
#: Added to digests before they are placed in a table.
SALTS = [U64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for n in range(TABLES)]
C1, C2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
#: An odd factor of the hash of blocks, and its inverse modulo 2 ** 64.
FACTOR = 0x9DDFEA08EB382D69
INVERSE = pow(FACTOR, -1, 1 << 64)
CELL = np.dtype([("n", "<i4"), ("k", "<u8"), ("c", "<u4")])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * C1
    h = (h ^ (h >> U64(29))) * C2
    return h ^ (h >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


@dataclass
class Sets:
    """Digests of many texts, distinct in each: text numbers in order, and digests."""

    of: np.ndarray
    digests: np.ndarray
    count: int

    @property
    def sizes(self) -> np.ndarray:
        return np.bincount(self.of, minlength=self.count)


def digest_sets(texts: list[bytes]) -> Sets:
    """The sets of texts, all at once: blocks are cut after a line break, and after a blank whose four bytes before say so."""
    gap = b"\n\n\n\n"
    b = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    lengths = np.array([len(t) + len(gap) for t in texts], np.int64)
    firsts = len(gap) + np.cumsum(lengths) - lengths
    at = np.flatnonzero((b == 32) | (b == 10))
    at = at[at >= 4]
    h = np.zeros(len(at), np.uint32)
    for back, odd in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), 1):
        h += b[at - back] * np.uint32(odd)
    cut = at[((h >> np.uint32(20)) & np.uint32(3) == 0) | (b[at] == 10)]
    # places 0 to 3 hold line breaks too, and every text is followed by four
    cut = np.concatenate([[3], cut])
    start, end = cut[:-1] + 1, cut[1:]
    some = end > start
    start, end = start[some], end[some]
    if not len(start):
        return Sets(np.array([], np.int64), np.array([], U64), len(texts))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((b.astype(U64) + U64(1)) * powers(FACTOR, len(b)), dtype=U64)])
    h = mixed((sums[end] - sums[start]) * powers(INVERSE, len(b))[start] + (end - start).astype(U64) * C2)
    of = np.searchsorted(firsts, start, "right") - 1
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])])
    again = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    h = np.where(again > 0, mixed(h + again.astype(U64) * C1), h)
    return Sets(of, h, len(texts))


def digests(text: bytes) -> np.ndarray:
    return digest_sets([text]).digests


def check(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)


class Sketches:
    """Sketches of many sets at once; sketch i has TABLES tables of width[i] cells, a power of two."""

    def __init__(self, width: np.ndarray):
        self.width = width.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(TABLES * self.width)])
        total = int(self.first[-1])
        self.count, self.keys, self.checks = np.zeros(total, np.int64), np.zeros(total, U64), np.zeros(total, np.uint32)

    @classmethod
    def of(cls, sets: Sets) -> Sketches:
        out = cls(1 << np.ceil(np.log2(np.maximum(sets.sizes / LOAD, LEAST))).astype(np.int64))
        out.add(sets.of, sets.digests, np.ones(len(sets.of), np.int64))
        return out

    def places(self, of: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        return self.first[of] + n * self.width[of] + (mixed(keys + SALTS[n]) & (self.width[of] - 1).astype(U64)).astype(np.int64)

    def add(self, of: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        checks = check(keys)
        for n in range(TABLES):
            at = self.places(of, keys, n)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def folded(self, pick: np.ndarray, width: np.ndarray) -> Sketches:
        """The sketches picked, at smaller widths."""
        out = Sketches(width)
        cells = TABLES * self.width[pick]
        row = np.repeat(np.arange(len(pick)), cells)
        within = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
        wide = self.width[pick][row]
        to = out.first[row] + within // wide * out.width[row] + (within % wide) % out.width[row]
        source = self.first[pick][row] + within
        np.add.at(out.count, to, self.count[source])
        np.bitwise_xor.at(out.keys, to, self.keys[source])
        np.bitwise_xor.at(out.checks, to, self.checks[source])
        return out

    def subtract(self, other: Sketches) -> Sketches:
        out = Sketches(self.width)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sketch, digest, sign) of the recovered digests, and whether each was recovered whole. Empties the sketches."""
        found = [(np.array([], np.int64), np.array([], U64), np.array([], np.int64))]
        at = np.flatnonzero(np.abs(self.count) == 1)
        while True:
            at = at[np.abs(self.count[at]) == 1]
            at = at[check(self.keys[at]) == self.checks[at]]
            if not len(at):
                break
            of, keys, sign = self.owner(at), self.keys[at], self.count[at]
            # a digest is often alone in several cells: take it once
            order = np.lexsort((keys, of))
            of, keys, sign = of[order], keys[order], sign[order]
            once = np.ones(len(of), bool)
            once[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
            of, keys, sign = of[once], keys[once], sign[once]
            found.append((of, keys, sign))
            self.add(of, keys, -sign)
            at = np.unique(np.concatenate([self.places(of, keys, n) for n in range(TABLES)]))
        whole = ~np.logical_or.reduceat((self.count != 0) | (self.keys != 0), self.first[:-1]) if len(self.width) else np.array([], bool)
        of, keys, sign = (np.concatenate(x) for x in zip(*found, strict=True))
        return of, keys, sign, whole

    def totals(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first[:-1]) if len(self.width) else np.array([], values.dtype)

    def encoded(self) -> list[str]:
        packed = np.empty(len(self.count), CELL)
        packed["n"], packed["k"], packed["c"] = self.count, self.keys, self.checks
        return [base64.b64encode(packed[i:j].tobytes()).decode() for i, j in zip(self.first, self.first[1:], strict=False)]

    @classmethod
    def decoded(cls, fingerprints: list[str]) -> Sketches:
        cells = [np.frombuffer(base64.b64decode(f), CELL) for f in fingerprints]
        out, packed = cls(np.array([len(c) // TABLES for c in cells], np.int64)), np.concatenate([np.empty(0, CELL), *cells])
        out.count, out.keys, out.checks = packed["n"].astype(np.int64), packed["k"].copy(), packed["c"].copy()
        return out


def estimated(difference: Sketches, sizes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The number of digests that differ, from the squared counts, between what the sizes of the two sets allow.

    In a table of w cells, d digests of which a surplus s has one sign make the squares add up to d + (s * s - d) / w.
    """
    w, surplus = difference.width, (sizes - other).astype(np.float64)
    squares = difference.totals(difference.count**2) / TABLES
    return np.clip((squares - surplus**2 / w) / (1 - 1 / w), np.abs(surplus), sizes + other)


def likeness_of(left: Sketches, i: np.ndarray, right: Sketches, j: np.ndarray) -> np.ndarray:
    """Of the sketches numbered i on the left and j on the right, pair by pair."""
    sizes, other = (s.totals(s.count)[n] // TABLES for s, n in ((left, i), (right, j)))
    most, differ = np.minimum(left.width[i], right.width[j]), np.zeros(len(i))
    todo, width = np.arange(len(i)), np.full(len(i), LEAST)
    while len(todo):
        now = np.minimum(width[todo], most[todo])
        apart = left.folded(i[todo], now).subtract(right.folded(j[todo], now))
        guess = estimated(apart, sizes[todo], other[todo])
        of, _, _, whole = apart.peel()
        done = whole | (now == most[todo])
        differ[todo[done]] = np.where(whole, np.bincount(of, minlength=len(todo)), guess)[done]
        todo, width = todo[~done], width * LARGER
    both = sizes + other
    return np.where(both > 0, 1 - differ / np.maximum(both, 1), 1.0)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """How alike the texts of fingerprints are, from 0 to 1, pair by pair."""
    every = np.arange(len(left))
    return likeness_of(Sketches.decoded(left), every, Sketches.decoded(right), every)


def rank_in(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at or below the value; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def advance(found: Column, step: Column) -> Column:
        ahead = (found + step).cast("int")
        return F.when((ahead <= len(bounds)) & (value >= F.element_at(int_array(bounds), F.least(ahead, F.lit(len(bounds))))), ahead).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def successor_pairs(docs: DataFrame) -> DataFrame:
    """(r, extra, doc_id, text): ranges r of doc_id; rows with extra set are the first of the next range (after the last: of the first)."""
    scratch = Scratch(docs.sparkSession, "ranges")
    own = F.col("doc_id").cast("long")
    sizes = scratch.write(docs.select(own.alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 1
    aim = int(min(MAX_RANGES, max(1, total // RANGE_BYTES)))
    draw = F.pmod(F.xxhash64(F.lit("ranges"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sizes.where("doc_id is not null").where(draw < F.col("size") * F.lit(aim * DRAWN / total)).select("doc_id").distinct()
    bounds = sorted(r["doc_id"] for r in drawn.collect())[DRAWN::DRAWN]
    firsts = {r["r"]: r["first"] for r in sizes.groupBy(rank_in(bounds, F.col("doc_id")).alias("r")).agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("first")).collect()}
    scratch.drop(sizes)
    filled = sorted(firsts)
    lowest = -(1 << 63)
    first_of, before = [lowest] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, r in enumerate(filled):
        first_of[r], before[r] = firsts[r] if firsts[r] is not None else lowest, filled[i - 1]
    row = docs.select(own.alias("doc_id"), "text").withColumn("r", rank_in(bounds, F.col("doc_id")))
    at = (F.col("r") + 1).cast("int")
    is_first = F.coalesce(F.col("doc_id"), F.lit(lowest)) == F.element_at(int_array(first_of), at)
    mine = F.struct(F.col("r").cast("long").alias("r"), F.lit(False).alias("extra"))
    borrowed = F.struct(F.element_at(int_array(before), at).alias("r"), F.lit(True).alias("extra"))
    dealt = row.select(F.explode(F.when(is_first, F.array(mine, borrowed)).otherwise(F.array(mine))).alias("x"), "doc_id", "text")
    parts = max(1, -(-len(filled) // 3))
    return dealt.select("x.r", "x.extra", "doc_id", "text").repartition(parts, "r").sortWithinPartitions("r", "extra", "doc_id", "text")


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for (doc_id, text)."""
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        last, done = None, None
        for batch in batches:
            for r, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if done == r:
                    continue  # a second extra row: the first follows already
                text = text or ""
                if last and last[0] == r:
                    yield last[1], last[2], text
                last = (r, doc_id, text)
                if extra:
                    last, done = None, r

    def work(group: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        ids, texts, after = zip(*group, strict=True)
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, after, strict=True)]
        raw = [t.encode("utf-8", "surrogatepass") for t in edited]
        # the next document is mostly the next of the group; those that are not come last
        m, every = len(group), np.arange(len(group))
        apart = [i for i in range(m) if i + 1 == m or texts[i + 1] is not after[i]]
        following = every + 1
        following[apart] = m + np.arange(len(apart))
        own = Sketches.of(digest_sets([t.encode("utf-8", "surrogatepass") for t in (*texts, *(after[i] for i in apart))]))
        changed = Sketches.of(digest_sets(raw))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
                pa.array(own.encoded()[:m], pa.string()), pa.array(changed.encoded(), pa.string()),
                pa.array(likeness_of(own, every, changed, every)), pa.array(likeness_of(own, every, own, following)),
            ],
            names=[f.split()[0] for f in fields.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for pair in pairs(batches):
            group.append(pair)
            size += len(pair[1]) + len(pair[2])
            if len(group) >= TOGETHER or size >= TOGETHER_BYTES:
                yield work(group)
                group, size = [], 0
        if group:
            yield work(group)

    return successor_pairs(docs).mapInArrow(run, fields)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
