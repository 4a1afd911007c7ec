"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token ids, cut into pieces only where longer than a sequence. The plan needs no more than the count of
pieces of each length. It goes from the longest length down: the gap a piece leaves is looked up among single lengths,
pair sums and triple sums, and combinations that fill it exactly are consumed as often as the counts allow. What then
remains goes best-fit, longest first. A plan is a list of intervals "the pieces of this length with these ranks sit at
this offset of these sequences"; pieces are ranked within their length and looked up in it.

Only the histogram (one count per length up to the capacity) reaches the driver. Ranks come from windows over
(length, salt) groups of bounded size plus cumulated counts, so a very common length is no single task.

Cases: a null or empty text is the closing id alone; ties of length are ordered by a hash; repeated rows are packed as
often as they occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import Scratch, columns_of, fresh, int_array, plainly_named, table, utf8

CAPACITY, END = 2048, 0
#: Words a worker remembers the ids of, and pieces of one length that a window holds, about.
CACHE_WORDS, RANKED_TOGETHER = 400_000, 20_000


#: Sizes of windows are joined by broadcast up to so many (about 2 MB).
MANY_WINDOWS = 100_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of a text, word by word, the words' ids remembered.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its words in turn.
    Words are cut at ASCII white space only; any other stays inside a word, which the tokenizer then sees whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.marks = {m.encode(): np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ".,;:!?"}

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        # the tokenizer lower-cases; only its special tokens, which hold "<|", are told apart by case
        words = (text if b"<|" in text else text.lower()).split()
        parts = list(map(self.known.get, words))
        if None in parts:
            own = self.encode({w for w, p in zip(words, parts, strict=True) if p is None})
            parts = [own[w] if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)

    def encode(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words, which are then remembered. Letters and a closing mark are tokens apart, so the mark is set aside."""
        bare = {w: w[:-1] for w in words if w[-1:] in self.marks and w[:-1].decode().isalpha()}
        own = {w: self.known[b] for w, b in bare.items() if b in self.known}
        ask = list({bare.get(w, w) for w in words if w not in own})
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in ask], add_special_tokens=False)
        made = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(ask, encoded, strict=True)}
        out = {w: (own[w] if w in own else made[bare.get(w, w)]) + (self.marks[w[-1:]] if w in bare else b"") for w in words}
        if len(self.known) < CACHE_WORDS:
            self.known.update((w, p) for w, p in (made | out).items() if len(w) < 40)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) from (doc_id, text); what else docs has besides its text stays too."""
    end = np.array([END], "<u4").tobytes()

    keys, kinds = docs.drop("text").columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(len(keys))):
                ids = encode.ids(utf8(text.as_py())) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            rows, *columns = zip(*out, strict=True) if out else [()] * 6
            kept = batch.select(range(len(keys))).take(pa.array(rows, pa.int64()))
            made = [pa.array(values, kind) for values, kind, _ in zip(columns, kinds, names, strict=False)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*keys, *names])

    added = T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    rows = docs.select(*columns_of(docs.drop("text")), "text")
    return plainly_named(rows).mapInArrow(cut, T.StructType([*rows.schema.fields[:-1], *added.fields]))


def exact_fill(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Consumes from `left` (pieces by length) what fills sequences exactly: (lengths, how often)."""
    done: list[tuple[tuple[int, ...], int]] = []

    def times(lengths: tuple[int, ...]) -> int:
        return min(int(left[x]) // n for x, n in Counter(lengths).items())

    def consume(lengths: tuple[int, ...]) -> bool:
        n = times(lengths)
        if n:
            done.append((lengths, n))
            for x in lengths:
                left[x] -= n
        return n > 0

    def pairs(total: int, most: int) -> Iterator[tuple[int, int]]:
        a = np.arange((total + 1) // 2, min(most, total - 1) + 1)
        for x in a[(left[a] > 0) & (left[total - a] > 0)][::-1] if len(a) else ():
            yield int(x), total - int(x)

    def fill(length: int, gap: int, pair_sums: np.ndarray) -> bool:
        if gap == 0 or left[gap]:
            if consume((length, gap) if gap else (length,)):
                return True
        if pair_sums[gap]:
            for a, b in pairs(gap, gap):
                if consume((length, a, b)):
                    return True
        present = np.flatnonzero(left[: gap - 1]) if gap > 2 else np.array([], int)
        for a in present[::-1]:
            if 3 * a < gap:
                break
            if pair_sums[gap - a]:
                for b, c in pairs(int(gap - a), int(a)):
                    if consume((length, int(a), b, c)):
                        return True
        return False

    def sums() -> np.ndarray:
        """Which sums two available lengths have; a superset once counts have fallen."""
        there = (left > 0).astype(np.float32)
        return np.rint(np.fft.irfft(np.fft.rfft(there, 2 * len(left)) ** 2, 2 * len(left)))[: len(left)] > 0

    pair_sums = sums()
    for length in range(capacity, 0, -1):
        if left[length] and length % 64 == 0:
            pair_sums = sums()
        while left[length] and fill(length, capacity - length, pair_sums):
            pass
    return done


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs all of `left`, longest first, each into the fullest sequence that has room."""
    open_bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    room = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(room[length:])
            if not len(fits):
                fit = capacity // length
                for each, bins in ((fit, n // fit), (n % fit, 1)):
                    if each and bins:
                        open_bins[capacity - each * length].append(((length,) * each, bins))
                        room[capacity - each * length] = True
                n = 0
                break
            gap = length + int(fits[0])
            lengths, bins = open_bins[gap].pop()
            each = max(1, min(gap // length, n)) if bins == 1 else 1
            used = min(bins, n)
            if used < bins:
                open_bins[gap].append((lengths, bins - used))
            open_bins[gap - each * length].append((lengths + (length,) * each, used))
            room[gap], room[gap - each * length] = bool(open_bins[gap]), True
            n -= used * each
        left[length] = 0
    return [group for groups in open_bins for group in groups]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Intervals (length, first rank, first sequence, offset), sorted by length and rank."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    groups = exact_fill(left, capacity)
    groups += best_fit(left, capacity)
    used, sequence, out = Counter(), 0, []
    for lengths, n in groups:
        offset = 0
        for length in lengths:
            out.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a written table) with sequence_id and offset."""
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_sequences(counts, capacity)
    # each length has as many windows as it needs; their sizes, cumulated, are where their ranks begin
    salt, rank, first = (fresh(name, pieces) for name in ("salt", "rank", "first"))
    salts = int_array([max(1, -(-counts.get(length, 0) // RANKED_TOGETHER)) for length in range(1, capacity + 1)])
    by_hash = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    salted = pieces.withColumn(salt, F.pmod(by_hash, F.element_at(salts, F.col("length").cast("int"))).cast("int"))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", salt, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    many = sum(n // RANKED_TOGETHER for n in counts.values()) > MANY_WINDOWS
    within = Window.partitionBy("length", salt).orderBy(by_hash, "doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn(rank, (F.row_number().over(within) - 1).cast("long")).join(sizes if many else F.broadcast(sizes), ["length", salt])
    rows = ranked.select(*columns_of(pieces), (F.col(rank) + F.col(first)).alias(rank))
    keys, shared = plan[:, 0] << 44 | plan[:, 1], pieces.sparkSession.sparkContext.broadcast(plan)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length, place = batch.column(at_length).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            at = plan[np.searchsorted(keys, length << 44 | place, "right") - 1]
            made = [pa.array(at[:, 2] + place - at[:, 1]), pa.array(at[:, 3])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    at_length, names = pieces.columns.index("length"), [*pieces.columns, "sequence_id", "offset"]
    return plainly_named(rows).mapInArrow(look_up, T.StructType([*pieces.schema.fields, *T.StructType.fromDDL("sequence_id long, offset long").fields]))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every piece of (doc_id, text).

    Columns of docs beside these two, such as the number of a copy, come after doc_id and tell rows of one doc_id apart.
    """
    pieces = pieces_of(docs, path or tokenizer_path(), capacity, with_ids)
    return place(Scratch(docs.sparkSession, "packing").write(pieces, "pieces"), capacity)


def numbered_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, text): every row of a written table with a number of its own, which tells the copies of a doc_id apart."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("copy"), "text")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, (sequence_id, ids): a bounded group each, from pack_documents(with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
