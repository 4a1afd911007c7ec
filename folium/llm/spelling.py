"""Spelling variants: words within one edit of each other, found by a trie over letter counts.

The letters are dealt to GROUPS groups of about equal frequency; a word's levels in the trie are its letter counts by group.
One inserted, deleted or replaced letter raises at most one of the counts by one and lowers at most one by one, so a walk
from the root, depth first, that lets each query spend one surplus and one deficit reaches every near word. All queries that
reach a node go down together; leaves are verified on the letters. A leaf of many words with equal counts is joined by
halves: of two words within one edit, the first or the last half of the shorter one is common to both.

Subtrees are dealt to tasks by the counts of the first few groups, as many as make the largest subtree small. A word is a
member of its own subtree and a guest of those after it that the budget reaches, so that each pair meets once. A subtree gives
each word its number of near words and the best of them, not the pairs.

Forms are followed to their last in joins that double the step: a form has at least twice the occurrences, so there are no
circles and few rounds.

Cases: null and empty texts have no words; a null doc_id counts as an empty one in the hash that plants deletions; rows that
repeat a doc_id are documents of their own; words of any length are taken whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import Scratch, table

#: Letter groups, that is levels of the trie.
GROUPS = 16
#: Words of a subtree at most (while more levels can split it), subtrees aimed at with so many levels, and words of a leaf.
MEMBERS, SUBTREES, USUAL_DEPTH, LEAF = 50_000, 100, 4, 48
#: Words that a task counts before it hands them on, and pairs that are verified at once.
COUNTED, HELD = 300_000, 200_000
#: Letters up to which words are verified together.
USUAL = 32

#: Bytes of UTF-8 text with all that can't be in a run made spaces; runs are told apart in what is left.
_KEPT = bytes(b if b"a"[0] <= b <= b"z"[0] or b >= 128 else 32 for b in range(256))
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def runs_of(text: str) -> Iterator[tuple[bytes, int]]:
    """The distinct runs of letters of a text with their counts, A-Z lower-cased, in UTF-8."""
    for piece, n in Counter(text.encode("utf-8", "surrogatepass").lower().translate(_KEPT).split()).items():
        if piece.isascii():
            yield piece, n
        else:
            for run in _RUN.findall(piece):
                yield run, n


def planted(run: bytes, owner: bytes, every: int) -> str:
    """The run as a word, without one letter where the hash of owner and run says so."""
    word, h = run.decode(), zlib.crc32(owner + run)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = 5, every: int = 97) -> DataFrame:
    """(word, n) of all texts of docs (doc_id, text)."""

    def frame(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                owner = (str(doc.as_py()) if doc.is_valid else "").encode() + b":"
                for run, n in runs_of(text.as_py()):
                    if len(run) >= shortest:
                        word = planted(run, owner, every)
                        if len(word) >= shortest:
                            counts[word] += n
                if len(counts) > COUNTED:
                    yield frame(counts)
                    counts = Counter()
        if counts:
            yield frame(counts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame) -> list[str]:
    """The letters of each group: by falling frequency, to and fro, so that the groups weigh about the same."""
    counted = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()  # one row a letter
    groups = [""] * GROUPS
    for at, row in enumerate(sorted(counted, key=lambda r: (-r["count"], r["letter"]))):
        lap, place = divmod(at, GROUPS)
        groups[GROUPS - 1 - place if lap % 2 else place] += row["letter"]
    return groups


def group_count(letters: str) -> Column:
    """How many letters of the word are of this group."""
    return F.length("word") - F.length(F.translate("word", letters, "")) if letters else F.lit(0)


def count_vectors(words: list[str], group_of: np.ndarray) -> np.ndarray:
    """Letter counts by group, a row a word."""
    raw = [w.encode("latin-1") for w in words]
    row = np.repeat(np.arange(len(raw)), [len(w) for w in raw])
    cells = row * GROUPS + group_of[np.frombuffer(b"".join(raw), np.uint8)]
    return np.bincount(cells, minlength=len(raw) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Verifier:
    """Tells which pairs of words are one edit apart, many at once."""

    def __init__(self, words: list[str]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        self.letters = np.zeros((len(words), USUAL + 1), np.uint8)
        for i in np.flatnonzero(self.size <= USUAL).tolist():
            w = words[i].encode("latin-1")
            self.letters[i, : len(w)] = np.frombuffer(w, np.uint8)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        grown = self.size[b] - self.size[a]
        ok = grown <= 1
        short = self.size[b] <= USUAL
        x, y = self.letters[a], self.letters[b]
        unlike = x[:, :USUAL] != y[:, :USUAL]
        first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), USUAL)
        shifted = x[:, :USUAL] != y[:, 1:]  # of a word one letter longer, all after the first difference is shifted by one
        last = np.where(shifted.any(axis=1), USUAL - shifted[:, ::-1].argmax(axis=1), 0)
        ok &= np.where(grown == 0, unlike.sum(axis=1) == 1, last <= first)
        for i in np.flatnonzero(~short & (grown <= 1)).tolist():
            ok[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return ok


class Subtree:
    """The trie over the members of one subtree, as rows sorted by their counts, with all words of the task as queries."""

    def __init__(self, words: list[str], held: np.ndarray, group_of: np.ndarray):
        counts = count_vectors(words, group_of)
        members = np.flatnonzero(held)
        self.rows = members[np.lexsort(counts[members].T[::-1])]
        self.words, self.counts, self.held, self.sorted = words, counts, held, counts[self.rows]
        self.verify, self.candidates, self.found = Verifier(words), [], []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(self.words))
        if len(self.rows):
            self.walk(0, 0, len(self.rows), every, np.zeros(len(every), bool), np.zeros(len(every), bool))
        self.check()
        a, b = zip(*self.found, strict=True) if self.found else ([every[:0]], [every[:0]])
        return np.concatenate(a), np.concatenate(b)

    def walk(self, level: int, lo: int, hi: int, queries: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """Takes the queries from a node, which holds the rows lo to hi, to its children; surplus and deficit are what each has spent."""
        if hi - lo <= LEAF:
            self.leaf(level, lo, hi, queries, surplus, deficit)
            return
        if level == GROUPS:
            self.halves(lo, hi, queries)
            return
        values, starts = np.unique(self.sorted[lo:hi, level], return_index=True)
        mine = self.counts[queries, level]
        for value, start, end in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), hi - lo], strict=True):
            more, less = mine == value + 1, mine == value - 1
            go = (mine == value) | (more & ~surplus) | (less & ~deficit)
            if go.any():
                self.walk(level + 1, lo + start, lo + end, queries[go], (surplus | more)[go], (deficit | less)[go])

    def leaf(self, level: int, lo: int, hi: int, queries: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """What is left of the budget is spent on the remaining levels at once, for each query and row."""
        rest = self.sorted[lo:hi, level:]
        for at in range(0, len(queries), 2048):
            q = slice(at, at + 2048)
            apart = self.counts[queries[q], level:][:, None, :] - rest[None, :, :]
            up, down = np.maximum(apart, 0).sum(axis=2), np.maximum(-apart, 0).sum(axis=2)
            i, j = np.nonzero((up + surplus[q][:, None] <= 1) & (down + deficit[q][:, None] <= 1))
            self.take(queries[q][i], self.rows[lo:hi][j])

    def halves(self, lo: int, hi: int, queries: np.ndarray) -> None:
        """A leaf of many words with equal counts, and so of equal length: a near word shares the first or the last half."""
        size = len(self.words[self.rows[lo]])
        k, heads, tails = size // 2, {}, {}
        for r in self.rows[lo:hi].tolist():
            w = self.words[r]
            heads.setdefault(w[:k], []).append(r)
            tails.setdefault(w[size - k :], []).append(r)
        for q in queries.tolist():
            w = self.words[q]
            near = set(heads.get(w[:k], ())) | set(tails.get(w[len(w) - k :], ()))
            self.take(np.full(len(near), q), np.fromiter(near, np.int64, len(near)))

    def take(self, queries: np.ndarray, rows: np.ndarray) -> None:
        """Of two members, the later row is the query."""
        once = ~self.held[queries] | (queries > rows)
        self.candidates.append((queries[once], rows[once]))
        if sum(len(q) for q, _ in self.candidates[-64:]) > HELD or len(self.candidates) >= 4096:
            self.check()

    def check(self) -> None:
        if self.candidates:
            a, b = map(np.concatenate, zip(*self.candidates, strict=True))
            self.candidates = []
            for at in range(0, len(a), HELD):
                x, y = a[at : at + HELD], b[at : at + HELD]
                ok = self.verify(x, y)
                self.found.append((x[ok], y[ok]))


def near_words(words: DataFrame, groups: list[str], depth: int) -> DataFrame:
    """(word, n_near, best) for each of words (word, n) that has near words; best has the largest n, then the smallest word."""
    group_of = np.zeros(256, np.int64)
    for g, letters in enumerate(groups):
        for x in letters:
            group_of[ord(x)] = g
    own = F.array(*[group_count(g) for g in groups[:depth]])
    steps = [(i, 0, 1) for i in range(depth)] + [(i, j, 2) for i in range(depth) for j in range(i + 1, depth)]

    def moved(i: int, j: int, kind: int) -> Column:
        # a later subtree: its first differing count is larger by one; where a second one differs, it is smaller by one
        return F.transform("own", lambda x, at: x + F.when(at == i, 1).when((at == j) & F.lit(kind == 2), -1).otherwise(0))

    placed = words.withColumn("own", own).withColumn("to", F.explode(F.array(F.col("own"), *[moved(*s) for s in steps])))
    placed = placed.where(~F.exists("to", lambda x: x < 0)).select(F.concat_ws(",", "to").alias("key"), (F.col("to") == F.col("own")).alias("held"), "word", "n")

    def pair_up(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows["held"].to_numpy(bool)
        if not held.any() or len(rows) < 2:
            return frame_of([], [], [], [])
        rows = rows.sort_values("word", kind="stable", ignore_index=True)  # numbers in code-point order: ties go to the smaller
        words, n, held = rows["word"].tolist(), rows["n"].to_numpy(np.int64), rows["held"].to_numpy(bool)
        a, b = Subtree(words, held, group_of).pairs()
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((b, -n[b], a))
        a, b = a[order], b[order]
        who, first, many = np.unique(a, return_index=True, return_counts=True)
        best = b[first]
        return frame_of([words[i] for i in who], many, n[best], [words[i] for i in best])

    def frame_of(word: list[str], many: np.ndarray, most: np.ndarray, best: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(word, dtype=object), "n_near": many, "best_n": most, "best": pd.Series(best, dtype=object)})

    near = placed.groupBy("key").applyInPandas(pair_up, "word string, n_near long, best_n long, best string")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))


def subtree_depth(words: DataFrame, groups: list[str]) -> int:
    """How many levels a subtree's place takes: the fewest that make the largest one small enough, or all.

    Guests are copies, about half the square of the levels for each word, so no more than USUAL_DEPTH levels are taken just
    to have more subtrees.
    """
    wanted = words.count() / SUBTREES * 4
    for depth in range(2, GROUPS):
        largest = words.groupBy(*[group_count(g).alias(f"g{i}") for i, g in enumerate(groups[:depth])]).count().agg(F.max("count")).first()[0] or 0
        if largest <= MEMBERS and (largest <= wanted or depth >= USUAL_DEPTH):
            return depth
    return GROUPS


def last_forms(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): each step joins the table with itself, so steps double."""
    current = scratch.write(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = scratch.write(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "stepped")
        if not stepped.where("moved").limit(1).count():
            return stepped.select("word", "root")
        scratch.drop(current)
        current = stepped.select("word", "root")
        current._folium_path = stepped._folium_path


def spelling_variants(docs: DataFrame, shortest: int = 5, fewest: int = 3, times: int = 2, every: int = 97) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of docs (doc_id, text) with at least `fewest` occurrences."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(word_counts(docs, shortest, every).where(F.col("n") >= fewest), "words")
    groups = letter_groups(words)
    near = near_words(words, groups, subtree_depth(words, groups))
    better = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    chosen = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), better["word"].alias("form"), (-better["less"]).cast("long").alias("form_n"))
    chosen = scratch.write(chosen, "chosen")
    roots = last_forms(scratch, chosen.where("form is not null"))
    return chosen.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
