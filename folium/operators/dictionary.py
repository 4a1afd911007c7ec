"""Dictionary matching with a choice of method: an automaton that reads each text once, or n-grams joined with the terms.

The automaton is built of the lemma forms of the terms, with failure links, so that one pass over the words of a text gives
every term that ends at each word. It is broadcast, so its size is checked: beyond MAX_TERMS words of terms the n-gram
join is used, which shuffles. Both give the same rows. Lemmas are worked out once for each distinct word of a task.

Cases: a null or empty text has no matches; a null key is kept as it is; terms without a word of letters or digits match
nothing; of terms with one lemma form the first by name stands for all (`prepared_terms`); rows that repeat a key are texts of
their own with the automaton, and one text's candidates with the n-grams, so keys should be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folium.functions import text as T
from folium.operators.keywords import candidates, count_terms, leftmost_longest, longest_first, prepared_terms
from folium.plans.registry import query
from folium.session import table

#: Words of all terms up to which the automaton is broadcast (about 200 bytes each), lemmas that a task remembers, and texts that it scans at a time.
MAX_TERMS, KEPT, SLICE = 1_000_000, 50_000, 256

Match = tuple[int, int]


class Lemmas(dict):
    """The rule lemma of a lower-case word, worked out when it is first asked for."""

    def __missing__(self, word: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        self[word] = found = self.lemma(word)
        return found

    @staticmethod
    def lemma(word: str) -> str:
        n = len(word)
        if word.endswith("s"):
            if word.endswith("ies") and n > 4:
                return word[:-3] + "y"
            if word.endswith(("ses", "xes", "zes", "ches", "shes")) and n > 3:
                return word[:-2]
            return word if word.endswith("ss") or n < 3 else word[:-1]
        if word.endswith("ied") and n > 4:
            return word[:-3] + "y"
        silent = "e" if word.endswith("ing") and n > 5 else "" if word.endswith("ed") and n > 4 else None
        if silent is None:
            return word
        stem = word[:-3] if silent else word[:-2]
        return stem[:-1] if stem[-1] == stem[-2] else stem + silent


class Automaton:
    """States of a trie of word lists; `ends` has the lengths of the terms that end in a state, the longest first."""

    def __init__(self, terms: Iterable[list[str]]):
        self.steps: list[dict[str, int]] = [{}]
        self.fall, self.ends = [0], [[]]
        for words in terms:
            state = 0
            for word in words:
                if word not in self.steps[state]:
                    self.steps[state][word] = len(self.steps)
                    self.steps.append({})
                    self.fall.append(0)
                    self.ends.append([])
                state = self.steps[state][word]
            if words and len(words) not in self.ends[state]:
                self.ends[state].append(len(words))
        level = list(self.steps[0].values())
        while level:
            below = []
            for state in level:
                for word, child in self.steps[state].items():
                    self.fall[child] = self.after(self.fall[state], word)
                    self.ends[child] += self.ends[self.fall[child]]
                    below.append(child)
            level = below

    def after(self, state: int, word: str) -> int:
        while state and word not in self.steps[state]:
            state = self.fall[state]
        return self.steps[state].get(word, 0)

    def matches(self, words: Iterable[str]) -> Iterator[Match]:
        """(first word, number of words) of every term in the words, by their ends."""
        state, root = 0, self.steps[0]
        for at, word in enumerate(words):
            state = self.after(state, word) if state else root.get(word, 0)
            for n in self.ends[state] if state else ():
                yield at - n + 1, n


def from_the_left(found: Iterable[Match]) -> list[Match]:
    """The matches a scan from the left takes: the longest at the first place, then on behind it."""
    longest: dict[int, int] = {}
    for start, n in found:
        longest[start] = max(n, longest.get(start, 0))
    out, free = [], 0
    for start in sorted(longest):
        if start >= free:
            out.append((start, longest[start]))
            free = start + longest[start]
    return out


def by_length(found: Iterable[Match]) -> list[Match]:
    """The matches that don't overlap a longer one, or an equally long one before, that is taken itself."""
    out, taken = [], set()
    for start, n in sorted(set(found), key=lambda m: (-m[1], m[0])):
        places = range(start, start + n)
        if taken.isdisjoint(places):
            taken.update(places)
            out.append((start, n))
    return out


#: What is taken of overlapping matches: the scan of the automaton, and the same over joined candidates.
TAKES = {"leftmost": (from_the_left, leftmost_longest), "longest": (by_length, longest_first)}


def scan_texts(batches: Iterator[pa.RecordBatch], automaton: Automaton, take: Callable[[Iterable[Match]], list[Match]], key: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Matches in batches of (key, words joined by blanks), a batch for each SLICE texts: no more are Python strings at a time."""
    lemmas = Lemmas()
    for batch in chain.from_iterable((whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)) for whole in batches):
        row, start, size, form = [], [], [], []
        for i, text_of in enumerate(batch.column(1).to_pylist()):
            words = [lemmas[w] for w in text_of.split(" ")] if text_of else []
            for first, n in take(automaton.matches(words)):
                row.append(i)
                start.append(first + 1)
                size.append(n)
                form.append(" ".join(words[first : first + n]))
        keys = batch.column(0).take(pa.array(row, pa.int64())).cast(kind)
        yield pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(form, pa.string())], names=[key, "start", "n", "form"])


def find_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", take: str = "leftmost", method: str = "automaton") -> DataFrame:
    """(key, start, n, form): where terms (`prepared_terms`) stand in texts, first word from 1 and number of words, without overlaps.

    take is "leftmost" (the longest at each place of a scan) or "longest" (by falling length); method "automaton" or "ngrams".
    """
    here, joined = TAKES[take]
    if method not in ("automaton", "ngrams"):
        raise ValueError(f"no method {method}")
    if method == "ngrams" or (terms.agg(F.sum("n")).first()[0] or 0) > MAX_TERMS:
        found = joined(candidates(docs, terms, key, text), key)
        return found.select(key, "start", "n", "form")
    machine = docs.sparkSession.sparkContext.broadcast(Automaton(r["form"].split(" ") for r in terms.select("form").toLocalIterator()))
    kind = to_arrow_type(docs.schema[key].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan_texts(batches, machine.value, here, key, kind)

    plain = docs.select(key, T.plain_words(F.col(text)).alias("__words"))
    return plain.mapInArrow(scan, f"`{key}` {docs.schema[key].dataType.simpleString()}, start int, n int, form string")


def term_matches(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", method: str = "automaton") -> DataFrame:
    """What a scan from the left finds, with the words as they stand, their first and last place (from 0) and the term's columns."""
    found = find_terms(docs, terms, key, text, method=method)
    words = docs.select(key, T.word_list(T.plain_words(F.col(text))).alias("__w"))
    spans = found.groupBy(key).agg(F.collect_list(F.struct("start", "n", "form")).alias("__x")).join(words, key)
    shown = F.transform("__x", lambda x: F.struct(x["form"].alias("form"), F.array_join(F.slice("__w", x["start"], x["n"]), " ").alias("matched_text"), (x["start"] - 1).alias("start_idx"), (x["start"] + x["n"] - 2).alias("end_idx")))
    return spans.select(key, F.explode(shown).alias("m")).select(key, "m.*").join(terms.drop("n"), "form").drop("form")


# ---------------------------------------------------------------- queries


def _terms(spark, sf_dir) -> DataFrame:
    """The first two and three words of the benchmark passages."""
    b = table(spark, sf_dir, "benchmark")
    words = F.split(T.plain_words(F.col("text")), " ")
    return prepared_terms(b.select(F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 1, 3), " "))).alias("name")))


def _matches(spark, sf_dir, **how) -> DataFrame:
    return find_terms(table(spark, sf_dir, "documents"), _terms(spark, sf_dir), **how)


query("j16_longest_matches")(_matches)
query("j17_term_matches")(lambda spark, sf_dir: term_matches(table(spark, sf_dir, "documents"), _terms(spark, sf_dir)))
query("j15_ngram_matches")(lambda spark, sf_dir: _matches(spark, sf_dir, take="longest"))
query("a03_term_frequency")(lambda spark, sf_dir: count_terms(_matches(spark, sf_dir)))
query("a14_distinct_terms")(lambda spark, sf_dir: _matches(spark, sf_dir).groupBy("form").agg(F.count("*").alias("n")))
