"""Where a chunk of text stands among the spans of a page: fuzzy runs of spans, and the boxes of their lines.

A run's score is the share of the chunk's characters that longest matching blocks find in it, in percent. Runs begin at spans
that are like one of the chunk's seeds (its first ten, five and two words) and have up to `longest` spans; the best score wins,
of equal ones the earliest start and then the shortest run. Comparing texts block by block is costly, so bounds come first: a run
can match no more than the longest common subsequence. One pass over the chunk's letters tells for all starts of a page at once how
far a run must go to have all of them, all but one and so on up to a few (MISSING); runs are compared from the fewest missing up
until the rest cannot win. Only chunks that no run has so nearly are compared with the subsequence of each start's longest run,
worked out whole. No run that could win is left out, and whether a span is like a seed is asked of those that could.

A page's spans are one row, as a page is bounded. Chunks of a page are dealt to blocks of about CHUNKS, fewer where it has many spans,
and a block meets its page in a join, so that a large page is worked on by many tasks and is not copied for each chunk.

Cases: a null or empty chunk, a chunk of one word, a page without spans and a score under the threshold give found = false; null spans are
empty ones; spans of equal place keep the order of their text; a null page matches nothing; requests with equal ids
are answered each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from folium.functions import text as T
from folium.plans.registry import query
from folium.session import table

#: Words of the seeds, least likeness of a span to a seed, least score in percent, and spans of a run.
SEEDS, LIKE, THRESHOLD, LONGEST = (10, 5, 2), 0.4, 0.75, 100
#: Letters of a chunk that runs may lack, step by step, before all runs are bounded one by one.
MISSING = (3, 12, 30)
#: Chunks of a page that are worked on together, spans of a page from which on they are fewer, and chunk letters after which starts that are out are dropped.
CHUNKS, SPANS, LETTERS_A_ROUND = 64, 256, 8
#: What comparable texts are made of besides the space.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789.,;:()[]{}+-=/"
_OTHER, _BLANKS = re.compile(r"[^a-z0-9\s.,;:()\[\]{}+\-=/]"), re.compile(r"\s+")
RANGE = StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("score", DoubleType())])


@lru_cache(maxsize=4096)
def folded(c: str) -> str:
    """A Greek letter as its name, a mathematical one as the last word of its name; a character without a name is dropped."""
    name = unicodedata.name(c, "")
    if "GREEK" in name:
        return name.split("LETTER")[-1].strip().lower()
    return name.rsplit(" ", 1)[-1].lower() if "MATHEMATICAL" in name else c if name else ""


def folded_text(text: str | None) -> str:
    return text if text is not None and text.isascii() and text.isprintable() else "".join(map(folded, text or ""))


def plain(text: str | None) -> str:
    """Text as it is compared: folded, lower-cased, other symbols as blanks, single blanks."""
    return _BLANKS.sub(" ", _OTHER.sub(" ", folded_text(text).lower())).strip()


#: Texts that are Python's at a time.
TEXTS = 256


@F.arrow_udf(StringType())
def comparable(texts: pa.Array) -> pa.Array:
    parts = [pa.array(map(plain, texts.slice(i, TEXTS).to_pylist()), pa.string()) for i in range(0, len(texts), TEXTS)]
    return pa.concat_arrays([pa.array([], pa.string()), *parts])


def matched(a: str, b: str) -> int:
    return sum(block.size for block in SequenceMatcher(None, a, b).get_matching_blocks())


def percentage(chunk: str, run: str) -> float:
    """Matched characters in percent of the chunk, two decimals.

    In 200 characters or more, those that make up over a hundredth begin no block; without others there is nothing to compare.
    """
    if not chunk or not run or (len(run) >= 200 and not any(0 < run.count(c) <= len(run) // 100 + 1 for c in set(chunk))):
        return 0.0
    return round(100 * matched(chunk, run) / len(chunk), 2)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def match_percentage(chunk: pd.Series, span: pd.Series) -> pd.Series:
    return pd.Series([percentage(x or "", y or "") for x, y in zip(chunk, span, strict=True)])


def seeds_of(chunk: str) -> list[str]:
    words = chunk.split()
    return ["".join(words[:n]) for n in SEEDS if len(words) >= n]


class Page:
    """The spans of a page in their order, and where the next one of a letter is."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        self.plain = [plain(t) for t in self.texts]
        self.runs: dict[tuple[int, int], str] = {}
        # a run's text is in that of its spans, which may have more blanks where they meet
        inside = [_BLANKS.sub(" ", _OTHER.sub(" ", folded_text(t).lower())) for t in self.texts]
        self.edges = np.concatenate([[0], np.cumsum([len(t) for t in inside], dtype=np.int64)]).astype(np.int32)
        self.letters = np.frombuffer("".join(inside).encode("ascii"), np.uint8)
        self.after: dict[int, np.ndarray] = {}

    def next_of(self, letter: int) -> np.ndarray:
        """From each place the place behind the next such letter; one more than there are letters where none follows."""
        if letter not in self.after:
            n, at = len(self.letters), np.flatnonzero(self.letters == letter).astype(np.int32)
            out = np.full(n + 2, n + 1, np.int32)
            out[at] = at + 1
            self.after[letter] = np.minimum.accumulate(out[::-1])[::-1].copy()
        return self.after[letter]

    def reach(self, chunk: str, missing: int, longest: int) -> list[tuple[int, int, int]]:
        """(letters missing, start, spans) of the runs whose text lacks at most so many of a chunk's letters as a common subsequence."""
        spans = len(self.texts)
        start = np.arange(spans)
        limit = self.edges[np.minimum(start + longest, spans)]
        ends = np.repeat(self.edges[None, :-1], missing + 1, axis=0)
        for i, letter in enumerate(chunk.encode("ascii"), 1):
            found = self.next_of(letter).take(ends)
            np.minimum(found[1:], ends[:-1], out=found[1:])  # or the letter is missing
            ends = found
            if i % LETTERS_A_ROUND == 0:
                still = ends[-1] <= limit
                if not still.all():
                    ends, start, limit = ends[:, still], start[still], limit[still]
                if not len(start):
                    return []
        out = []
        ahead = np.maximum(np.searchsorted(self.edges, ends) - start, 1)
        most = np.minimum(longest, spans - start)
        for first, few, last in zip(start.tolist(), ahead.T.tolist(), most.tolist(), strict=True):
            stop = last + 1
            for lacking, n in enumerate(few):
                out += [(lacking, first, x) for x in range(n, stop)]
                stop = min(stop, n)
        return sorted(out)

    def seeds(self, chunk: str) -> list[tuple[dict[str, int], SequenceMatcher, int]]:
        """For each seed of a chunk the places of its letters, a matcher and its size."""
        return [(letter_places(s), SequenceMatcher(None, "", s), len(s)) for s in seeds_of(chunk)]

    def begins(self, i: int, seeds: list[tuple[dict[str, int], SequenceMatcher, int]]) -> bool:
        """Whether a span is like a seed; what shares too few characters with it is not compared."""
        span = self.plain[i]
        for masks, matcher, size in seeds:
            least = LIKE * (len(span) + size) - 1e-9
            if 2 * min(len(span), size) >= least and 2 * common(masks, size, span)[-1] >= least:
                matcher.set_seq1(span)
                if matcher.ratio() >= LIKE:
                    return True
        return False

    def starts(self, chunk: str) -> list[int]:
        """Spans that are like a seed."""
        seeds = self.seeds(chunk)
        return [i for i in range(len(self.texts)) if self.begins(i, seeds)]

    def run(self, start: int, stop: int) -> str:
        if (start, stop) not in self.runs:
            self.runs[start, stop] = plain("".join(self.texts[start:stop]))
        return self.runs[start, stop]

    def best(self, text: str | None, longest: int = LONGEST) -> tuple[int, int, float] | None:
        """(first span, last span, score) of the best run for a chunk, or None where no span is like its seeds.

        Runs are compared from the largest bound down, until none that is left could win or be an earlier equal."""
        chunk = plain(text)
        if not chunk:
            return None
        seeds, begun, compared = self.seeds(chunk), {}, set()
        score, at = 0.0, None

        def compare(runs: list[tuple[int, int, int]]) -> None:
            nonlocal score, at
            for lacking, start, ahead in runs:
                most = bound(lacking)
                if most < score or most == 0:
                    break
                if (most == score and (start, ahead) > at) or (start, ahead) in compared:
                    continue
                compared.add((start, ahead))
                if start not in begun:
                    begun[start] = self.begins(start, seeds)
                if not begun[start]:
                    continue
                found = percentage(chunk, self.run(start, start + ahead))
                if found > score or (found == score and at is not None and (start, ahead) < at):
                    score, at = found, (start, ahead)

        def bound(lacking: int) -> float:
            return round(100 * (len(chunk) - lacking) / len(chunk), 2)

        for missing in MISSING:
            missing = min(missing, len(chunk) - 1)
            compare(self.reach(chunk, missing, longest))
            if bound(missing + 1) < score or missing == len(chunk) - 1:
                break
        else:
            begun |= {i: self.begins(i, seeds) for i in range(len(self.texts)) if i not in begun}
            compare(self.bounded(chunk, [i for i, like in begun.items() if like], longest))
        return (at[0], at[0] + at[1] - 1, score) if at else None

    def bounded(self, chunk: str, starts: list[int], longest: int) -> list[tuple[int, int, int]]:
        """(letters missing, start, spans) of all runs of these starts."""
        masks, out = letter_places(chunk), []
        for start in starts:
            stop = min(start + longest, len(self.texts))
            whole = self.run(start, stop)
            shared = common(masks, len(chunk), whole)
            for ahead in range(1, stop - start + 1):
                run = self.run(start, start + ahead)
                out.append((len(chunk) - shared[len(run) if whole.startswith(run) else -1], start, ahead))
        return sorted(out)


def letter_places(text: str) -> dict[str, int]:
    """Where a text has each of its letters, as bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places


def common(masks: dict[str, int], size: int, run: str) -> list[int]:
    """The length of the longest common subsequence of a text of `size` letters, whose places are `masks`, and each beginning of the run.

    Matching blocks stand in the same order on both sides, so they have no more letters than that. A bit for each letter of the
    text is cleared where the sequence gets longer."""
    every = (1 << size) - 1
    left, out = every, [0]
    for c in run:
        meet = left & masks.get(c, 0)
        if meet:
            left = ((left + meet) | (left - meet)) & every
        out.append(size - left.bit_count())
    return out


@F.arrow_udf(ArrayType(RANGE))
def _best_runs(texts: pa.Array, places: pa.Array, chunks: pa.Array, longest: pa.Array) -> pa.Array:
    """The best run of each chunk of a block among the spans of its page; None where there is none."""
    out = []
    for spans, at, block, most in zip(texts, places, chunks, longest, strict=True):
        page, at = Page(spans.as_py()) if spans.is_valid else None, at.as_py()
        found = [page and page.best(chunk, most.as_py()) for chunk in block.as_py()]
        out.append([run and {"first": at[run[0]], "last": at[run[1]], "score": run[2]} for run in found])
    return pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))


def span_runs(chunks: DataFrame, spans: DataFrame, threshold: float | Column = THRESHOLD, longest: int = LONGEST, page: tuple[str, ...] = ("page",)) -> DataFrame:
    """chunks (page, ..., text) with found, first, last (places of the best run's ends) and score; spans are (page, pos, text).

    A run is found if its score reaches the threshold, in percent; the score of the best run is told anyway, 0 where there is none.
    """
    pages = spans.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.coalesce("text", F.lit("")).alias("text")))).alias("__spans"))
    names = [F.col(f"`{c}`") for c in chunks.columns]
    sizes = spans.groupBy(*page).agg(F.count("*").alias("__spans")).join(chunks.groupBy(*page).agg(F.count("*").alias("__chunks")), list(page))
    blocks = sizes.select(*page, F.ceil(F.greatest(F.col("__spans") / SPANS, F.col("__chunks") / CHUNKS)).alias("__blocks"))
    block = F.pmod(F.xxhash64(*names), F.coalesce("__blocks", F.lit(1 << 20)))  # chunks without a page lie in few by few
    dealt = chunks.join(blocks, list(page), "left").groupBy(*page, block.alias("__block")).agg(F.collect_list(F.struct(*names)).alias("__rows"))
    # few bytes are much work here, so partitions are not to be coalesced by size; by a hash, as the blocks' own grouping is coalesced and would do
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.join(pages, list(page), "left").repartition(parts, F.xxhash64(*page, "__block"))
    met = met.withColumn("__runs", _best_runs(F.col("__spans.text"), F.col("__spans.pos"), F.col("__rows.text"), F.lit(longest)))
    met = met.select(F.explode(F.arrays_zip("__rows", "__runs")).alias("x")).select("x.__rows.*", F.col("x.__runs").alias("__run"))
    reached = F.coalesce(F.col("__run.score") >= (threshold if isinstance(threshold, Column) else F.lit(threshold)), F.lit(False))
    ends = [F.when(reached, F.col(f"__run.{c}")).alias(c) for c in ("first", "last")]
    return met.select(*[F.col(f"`{c}`") for c in chunks.columns], reached.alias("found"), *ends, F.coalesce("__run.score", F.lit(0.0)).alias("score"))


def best_spans(chunks: DataFrame, spans: DataFrame, threshold: float = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(page, chunk_id, first, last, score) of the chunks (page, chunk_id, text) that a run of their page's spans matches."""
    return span_runs(chunks, spans, threshold, longest).where("found").select("page", "chunk_id", "first", "last", "score")


def span_boxes(requests: DataFrame, spans: DataFrame, sizes: DataFrame, threshold: float | Column = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(request_id, found, score, boxes) for requests (request_id, page, text): the boxes of the lines that the best run covers.

    spans are (page, pos, text, x0, y0, x1, y1) with the box of their line, sizes (page, width, height). Lines of equal top and
    bottom are one box, as wide as its spans' lines; boxes are shares of the page and come from the top.
    """
    numbered = requests.withColumn("__id", F.monotonically_increasing_id())
    runs = span_runs(numbered, spans.select("page", "pos", "text"), threshold, longest)
    covered = runs.where("found").select("__id", "page", "first", "last").join(spans.select("page", "pos", "x0", "y0", "x1", "y1"), "page").where(F.col("pos").between(F.col("first"), F.col("last")))
    lines = covered.groupBy("__id", "page", "y0", "y1").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).join(sizes, "page")
    box = F.struct((F.col("y0") / F.col("height")).alias("y0"), (F.col("x0") / F.col("width")).alias("x0"), (F.col("x1") / F.col("width")).alias("x1"), (F.col("y1") / F.col("height")).alias("y1"))
    boxes = lines.groupBy("__id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    shown = F.transform("boxes", lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1")))
    return runs.join(boxes, "__id", "left").select("request_id", "found", "score", F.coalesce(shown.cast(kind), F.expr(f"cast(array() as {kind})")).alias("boxes"))


# ---------------------------------------------------------------- queries

query("f24_sequence_ratio")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", F.round(sequence_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio")))
query("f25_match_percentage")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", match_percentage(F.col("p_name"), F.concat("p_type", F.lit(" "), "p_name")).alias("share")))
query("f22_fold_symbols")(lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", comparable(F.concat(F.lit("α β ≤ 𝑥 "), "text")).alias("text")))


def _spans(spark, sf_dir) -> DataFrame:
    """The turns of each conversation as a page of spans, cut after every sixth word, with boxes of lines of two spans."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), "turn", T.word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = turns.select("page", "turn", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(6)), lambda i: F.array_join(F.slice("w", i, F.lit(6)), " "))).alias("i", "text"))
    line = F.floor(F.col("i") / 2)
    return cut.select(
        "page", (F.col("turn") * 10_000 + F.col("i")).cast("long").alias("pos"), "text",
        (50.0 + 200 * (F.col("i") % 2)).alias("x0"), (F.col("turn") * 100 + 12 * line + 0.0).alias("y0"), (240.0 + 200 * (F.col("i") % 2)).alias("x1"), (F.col("turn") * 100 + 12 * line + 10.0).alias("y1"),
    )


def _chunks(spark, sf_dir) -> DataFrame:
    """One quotation of each turn as the chunk to find: twelve words, of which one is left out, that begin inside a span."""
    words = T.word_list(F.col("text"))
    kept = F.array_join(F.filter(F.slice(words, 4, 13), lambda w, i: i != 7), " ")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), kept.alias("text"))


query("j18_best_spans")(lambda spark, sf_dir: best_spans(_chunks(spark, sf_dir), _spans(spark, sf_dir), longest=8))
query("j24_best_spans_strict")(lambda spark, sf_dir: best_spans(_chunks(spark, sf_dir), _spans(spark, sf_dir), threshold=80.0, longest=8))


@query("j19_span_boxes")
def j19(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    sizes = spans.groupBy("page").agg(F.lit(500.0).alias("width"), (F.max("y1") + 50).alias("height"))
    return span_boxes(_chunks(spark, sf_dir).withColumnRenamed("chunk_id", "request_id"), spans, sizes, F.when(F.col("request_id") % 2 == 0, 80.0).otherwise(THRESHOLD), longest=8).withColumn("boxes", F.to_json("boxes"))
