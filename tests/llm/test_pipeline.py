"""Every stage of the pipeline, recomputed in plain Python from what the stage before kept."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import packing, pii

from ..conftest import TESTDATA
from .brute import similar_pairs, smallest_reachable


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """Rows before the first stage and after each one."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(spark, kept):
    """Measured on the larger tables: 38 of 51 documents labelled toxic go, and none of 348 labelled clean; few labels are learned from."""
    assert not Counter(kept[1]) - Counter(kept[0])
    folder = str(TESTDATA / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    ids, left = {r["doc_id"] for r in docs.select("doc_id").collect()}, {r["doc_id"] for r in corpus_pipeline.reject_toxic(spark, docs, folder).collect()}
    of = {k: {d for d in ids if toxic.get(d) == k} for k in (0, 1)}
    assert len(of[1] - left) >= 0.7 * len(of[1]) and len(of[0] & left) >= 0.98 * len(of[0])


def test_one_of_each_group_stays(kept):
    before, after = kept[1], kept[2]
    docs = [(r["doc_id"], r["text"]) for r in before]
    root = smallest_reachable([d for d, _ in docs], similar_pairs(docs, 80))
    assert sorted(r["doc_id"] for r in after) == sorted(d for d in root if root[d] == d)
    assert not Counter(after) - Counter(before) and len(after) < len(before)


def test_spans_are_masked_and_nothing_else(spark, kept):
    before, after = {r["doc_id"]: r for r in kept[2]}, {r["doc_id"]: r for r in kept[3]}
    assert before.keys() == after.keys()
    table = spark.createDataFrame([(d, r["text"]) for d, r in before.items()], "doc_id long, text string")
    masked = 0
    for doc, spans in table.select("doc_id", pii.find_spans(F.col("text")).alias("s")).collect():
        text, out, at = before[doc]["text"], "", 0
        for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
            if x["start"] >= at:
                out, at = f"{out}{text[at:x['start']]}<{x['kind'].upper()}>", x["end"]
        want = None if text is None else out + text[at:]
        got = after[doc]
        assert got["text"] == want and got["n_chars"] == (None if want is None else len(want))
        assert (got["lang"], got["source"]) == (before[doc]["lang"], before[doc]["source"])
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", want or "")
        masked += len(spans) > 0
    assert masked


def test_sources_are_mixed_by_their_rates(kept):
    before, after = kept[3], kept[4]
    sizes = [(r, len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in before]
    of = defaultdict(int)
    for r, n in sizes:
        of[r["source"]] += n
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:  # the excess goes to the others by weight until none is above
        rest = sum(of.values()) - sum(3 * of[s] for s in capped)
        target = {s: 3 * of[s] if s in capped else rest * weight[s] / sum(weight[o] for o in names if o not in capped) for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * of[s]}
        if not over:
            break
        capped |= over
    want = Counter()
    for r, _ in sizes:
        rate = min(3, target[r["source"]] / of[r["source"]]) if of[r["source"]] else 0
        draw = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        want[r] = math.floor(rate) + (draw < rate - math.floor(rate))
    assert Counter(after) == +want


def test_every_copy_is_packed_whole(kept):
    plain = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    lengths = Counter()
    for r in kept[4]:
        lengths[r["doc_id"], len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1] += 1
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in kept[5]:
        pieces[r["doc_id"], r["copy"]].append((r["piece"], r["start"], r["length"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    got = Counter()
    for (doc, _), own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and all(n == 2048 for _, _, n in own[:-1])
        assert [s for _, s, _ in own] == [2048 * p for p in range(len(own))]
        got[doc, sum(n for _, _, n in own)] += 1
    assert got == lengths
    for rows in filled.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))] and sum(n for _, n in rows) <= 2048
    assert len(filled) <= 1.05 * math.ceil(sum(n * k for (_, n), k in lengths.items()) / 2048) + 1
