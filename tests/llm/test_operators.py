"""Every operator on odd and empty tables, against brute force, SQL or a round trip."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import embeddings, fingerprints, lm, mixing, neardup, packing, pii, sharding, tokencounts, toxicity
from folium.llm.queries import QUERIES, SQL

from ..conftest import rows_of
from .brute import cosine_links, shingles, similar_pairs, smallest_reachable


@pytest.fixture(scope="module")
def docs(spark, odd_docs):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd_docs}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(name, spark, odd_docs):
    if name in ("op11_negatives", "op12_spelling"):  # rows of pairs and words: test_negatives, test_spelling
        return
    source = "embeddings" if name.startswith("op1_") else "documents"
    n = spark.read.parquet(f"{odd_docs}/{source}.parquet").count()
    got = QUERIES[name](spark, odd_docs).toPandas()
    assert len(got) >= n if name in ("op4_packing", "op9_token_counts") else len(got) == n


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(name, spark, empty_docs):
    assert QUERIES[name](spark, empty_docs).count() == 0


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op1_embeddings", "op11_negatives"}))
def test_sql_on_odd_tables(name, spark, odd_docs, duck):
    assert rows_of(QUERIES[name](spark, odd_docs).toPandas()) == rows_of(duck(SQL[name], odd_docs))


def test_embeddings_against_all_pairs(spark, odd_docs):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{odd_docs}/embeddings.parquet").collect()]
    links = cosine_links(rows)
    reach, degree = smallest_reachable([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in links]), Counter(rows[a][0] for a, _ in links)
    for r in embeddings.op1_embeddings(spark, odd_docs).collect():
        assert (r["n_links"], r["component_id"]) == (degree[r["vec_id"]], reach[r["vec_id"]])


def test_mixing_emits_what_the_plan_says(spark, odd_docs):
    table = spark.read.parquet(f"{odd_docs}/documents.parquet")
    plan = mixing.plan_mix(table).toPandas()
    assert mixing.mix_sources(table).count() == sum(m["copies"] for m in plan["mix"])
    assert mixing.mix_sources(table).columns == table.columns
    assert all(m["copies"] <= 3 for m in plan["mix"])


def test_language_model_base_counts(spark, odd_docs, docs):
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in docs]
    counts = Counter()
    for (d, _), words in zip(docs, tokens, strict=True):
        if d is None or zlib.crc32(str(d).encode()) % 10:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(w), sum(x in counts for x in w), round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for (d, _), w in zip(docs, tokens, strict=True))
    got = lm.op3_lm_score(spark, odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_spelling_is_a_distribution():
    words = [b"abc", b"abd", b"xyz", b"abcabc"] * 5
    model = lm.count_slots(lm.batches_of(words))
    assert model.learn(lm.spelling_steps(lm.batches_of(words))) == 8 * sum(len(w) + 1 for w in words) == model.refine[:, 1].sum()
    # the first byte's values share one
    raw, contexts, starts = lm.spelled([bytes([b]) for b in range(256) if b != 32])
    logs = np.zeros(len(raw))
    for node, bit in lm.bits(raw):
        p = model.probability(lm.slots_of(contexts, node))
        logs += np.log(np.where(bit == 1, p, 1 - p))
    assert 0.9 < np.exp(logs[starts]).sum() <= 1 + 1e-9


def test_phrases_are_looked_for_at_every_word():
    rng = np.random.default_rng(5)
    lengths, hashed = np.array([1, 40, 3, 60]), rng.integers(0, 1 << 63, 30).astype(np.uint64)
    tokens, ends = rng.integers(0, 30, lengths.sum()), np.cumsum(lengths)
    at, keys, number = lm.phrase_keys(hashed, tokens, lengths)
    want = [i for j, n in zip(ends, lengths, strict=True) for i in range(j - n + 3, j)]
    assert at.tolist() == want
    assert (lm.keys_of(lm.packed_keys(keys)) == keys).all()
    grams = [tuple(tokens[i - 3 : i].tolist()) for i in want] + [tuple(tokens[i - 3 : i + 1].tolist()) for i in want]
    assert len(set(zip(grams, number.tolist(), strict=True))) == len(set(grams)) == len(keys)


def test_phrases_are_counted_whole_though_few_keys_are_sent(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:6], "w1 w2 w3 w4", "w1", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes = lm.Classes(np.zeros(lm.CLASSES), np.zeros((lm.CLASSES, lm.HASHED), np.float32))
    data = lm.Scratch(spark, "few-keys").write(lm.chunks_of(docs, 4, classes), "chunks").select("chunk", "docs", "flags", "sizes", "tokens", "words")
    here = {r["chunk"]: lm.Phrases.of(lm.Chunk.of(r)) for r in data.collect()}
    assert len(here) == 3
    total = Counter()
    for chunk in here.values():
        total.update(dict(zip(chunk.keys.tolist(), chunk.times.tolist(), strict=True)))
    for kept in (lm.upper_bits(len(total)), 6):  # with few bits, most are asked for in vain
        requests = lm.phrase_requests(data, lm.hints(lm.hints_wanted(data, 4, kept)), 4, kept)
        replies = lm.phrase_answers(requests).toPandas().sort_values("block")
        for k, chunk in here.items():
            assert chunk.counts(replies[replies["chunk"] == k], kept).tolist() == [total[x] for x in chunk.keys.tolist()]
        sent = sum(len(lm.keys_of(r["keys"])) for r in requests.collect())
        assert sent < sum(len(c.keys) for c in here.values()) / 3 or kept == 6


def running_bits(texts, taught, phrases_of):
    """What lm.bits_of_text gives, word by word: per token the ways to tell it, as (kind, bit, share)."""
    out = []
    for d, text in enumerate(texts):
        after, seen = {}, Counter()
        for i, t in enumerate(text):
            ways = []
            if (d, i) in phrases_of and phrases_of[d, i][0] > 0:
                before, whole = phrases_of[d, i]
                ways.append(("known", whole > 0, whole / before))
            if i >= 2 and (text[i - 2], text[i - 1]) in after:
                ways.append(("follows", after[text[i - 2], text[i - 1]] == t, 1.0))
            if i:
                ways.append(("again", seen[t] > 0, seen[t] / i))
            out.append(ways)
            seen[t] += 1
            if i >= 2:
                after[text[i - 2], text[i - 1]] = t
    return out


def test_bits_of_text_in_order():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 6, n).tolist() for n in (40, 1, 300, 7)]
    lengths, tokens = np.array([len(t) for t in texts]), np.concatenate([np.array(t) for t in texts])
    opened = np.flatnonzero(rng.random(len(tokens)) < 0.2)
    before = rng.integers(0, 4, len(opened))
    whole = np.minimum(rng.integers(0, 3, len(opened)), before)
    place = [(d, i) for d, t in enumerate(texts) for i in range(len(t))]
    want = running_bits(texts, None, {place[at]: (b, w) for at, b, w in zip(opened.tolist(), before.tolist(), whole.tolist(), strict=True)})
    ways, own = lm.bits_of_text(tokens, lengths, np.ones(len(tokens), bool), opened, before, whole)
    got = [[] for _ in tokens]
    for name, way in zip(("known", "follows", "again"), ways, strict=True):
        for at, bit, share in zip(way.at.tolist(), way.bit.tolist(), way.share.tolist(), strict=True):
            got[at].append((name, bool(bit), share))
    assert got == want
    counted = [Counter(t) for t in texts]
    assert own.tolist() == [counted[d][texts[d][i]] for d, i in place]


def test_probabilities_of_all_next_tokens_sum_to_one():
    """Every token that could come next, each told by its own bits under the same chances."""
    text, vocabulary = [0, 1, 2, 0, 1, 2, 3, 0, 1], 5
    word_p = np.array([0.3, 0.3, 0.2, 0.15, 0.05])
    corpus = {2: 3, 4: 1}  # how often tokens follow the three words before, elsewhere
    total = 0.0
    for t in range(vocabulary):
        tokens = np.array([*text, t])
        last = len(text)
        ways, _ = lm.bits_of_text(tokens, np.array([len(tokens)]), np.ones(len(tokens), bool), np.array([last]), np.array([4]), np.array([corpus.get(t, 0)]))
        chances = [np.full(len(way.at), c) for way, c in zip(ways, (0.5, 0.3, 0.6), strict=True)]
        total += lm.along_text(word_p[tokens], ways, chances)[last]
    assert total == pytest.approx(1.0)


def test_word_probabilities_token_by_token():
    """Discounted shares back off from class to all to spelling, and classes are weighted by what they told before."""
    rng = np.random.default_rng(9)
    by_class = rng.integers(0, 5, (lm.CLASSES, 12)).astype(np.uint32)
    spell = np.log(rng.dirichlet(np.ones(12)))
    every = np.vstack([by_class, by_class.sum(axis=0)]).astype(int)
    sums = [lm.Sums(int(c.sum()), int((c > 0).sum()), int((c == 1).sum()), int((c == 2).sum())) for c in every]
    texts = [rng.integers(0, 12, n) for n in (5, 1, 9)]
    got = lm.word_probabilities(np.concatenate(texts), np.array([5, 1, 9]), np.zeros(15, np.int64), np.zeros(3, np.int64), by_class, spell, sums)

    def backed_off(s, count, lower):
        return max(count - s.discount, 0) / s.n + s.discount * s.v / s.n * lower

    want = []
    for text in texts:
        weight = np.array([(s.n + 1) / (sums[-1].n + lm.CLASSES) for s in sums[:-1]])
        for t in text:
            p = [backed_off(s, int(by_class[k, t]), backed_off(sums[-1], int(every[-1, t]), math.exp(spell[t]))) for k, s in enumerate(sums[:-1])]
            want.append((weight * p).sum() / weight.sum())
            weight = weight * p
    assert got == pytest.approx(np.array(want))


def test_a_text_that_other_documents_hold_scores_higher(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words[i] for i in rng.zipf(1.3, 400) % 4000) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:20])]
    rows += [(500 + i, " ".join(rng.permutation(texts[i].split()))) for i in range(20, 40)]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [r["score"] / r["n_tokens"] for d, r in got.items() if d < 20 or 120 <= d < 140]
    once = [r["score"] / r["n_tokens"] for d, r in got.items() if 40 <= d < 120]
    assert np.quantile(twice, 0.1) > np.quantile(once, 0.9)


def test_held_out_documents_beat_the_base(spark, sf_dir):
    rows = [r for r in lm.op3_lm_score(spark, sf_dir.replace("sf0.001", "sf0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_packing_round_trip(spark, odd_docs, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    whole = sorted((str(d), np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t in docs)
    table = spark.read.parquet(f"{odd_docs}/documents.parquet").select("doc_id", "text")
    rows = packing.pack_documents(table, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in rows:
        ids = bytes(r["ids"])
        assert zlib.crc32(ids) == r["ids_crc32"] and len(ids) == 4 * r["length"] and (r["length"] == 2048 or r["piece"] == max(x["piece"] for x in rows if x["doc_id"] == r["doc_id"]))
        pieces[str(r["doc_id"])].append((r["piece"], r["sequence_id"], r["offset"], ids))
    by_doc = Counter(d for d, _ in whole)
    assert sorted((d, b"".join(p[3] for p in sorted(pieces[d]))) for d in pieces if by_doc[d] == 1) == [x for x in whole if by_doc[x[0]] == 1]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1


@pytest.mark.parametrize("counts", [{}, {1: 5000}, {2048: 3}, {1500: 10, 400: 7}, {700: 5, 1000: 3, 348: 2}, {1024: 3}, {i: 3 for i in range(1, 2049, 7)}])
def test_plans_place_every_piece_once(counts):
    plan = packing.plan_sequences(counts)
    # give every piece its place, as the look-up does
    keys = plan[:, 0] << 44 | plan[:, 1]
    spans = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            p = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            assert p[0] == length
            spans[p[2] + rank - p[1]].append((p[3], length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_toxicity_on_held_out_documents(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in toxicity.op5_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert right / len(rows) > 0.93 and all(r["predicted"] == 0 for r in rows if labels[r["doc_id"]] == 0)


def test_machine_learns_an_interaction():
    """Neither term alone tells, both together do."""
    rng = np.random.default_rng(2)
    samples = []
    for _ in range(600):
        a, b = map(int, rng.random(2) < 0.5)
        samples.append((a * b, np.array([0] * a + [1] * b + [2 + int(rng.integers(5))])))
    machine = toxicity.fit(samples, np.arange(7, dtype=np.uint32))
    rows = np.array
    assert machine.score(rows([0, 1])) > 0 > max(machine.score(rows([0])), machine.score(rows([1])))
    assert machine.latent[0] @ machine.latent[1] > 0


def test_toxicity_scores_by_hand(spark, odd_docs, docs):
    """The machine's formula, term by term and pair by pair."""
    table = spark.read.parquet(f"{odd_docs}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{odd_docs}/labels.parquet"))
    rng = np.random.default_rng(1)
    terms = np.array(sorted({h for _, t in docs for w in (t or "").encode().lower().split() for h in toxicity.terms_of(w)}), np.uint32)[::2]
    model = toxicity.Machine(-0.5, terms, rng.normal(size=len(terms)).astype(np.float32), rng.normal(size=(len(terms), 8)).astype(np.float32))
    row = {int(h): i for i, h in enumerate(terms)}
    want = []
    for d, t in docs:
        at = sorted({row[h] for w in (t or "").encode().lower().split() for h in toxicity.terms_of(w) if h in row})
        z = model.bias + sum(float(model.linear[i]) for i in at)
        z += sum(float(model.latent[i] @ model.latent[j]) for n, i in enumerate(at) for j in at[:n]) / max(1, len(at))
        want.append((str(d), pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)))
    got = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score_texts(table, model).collect())
    assert got == sorted(want, key=lambda x: (x[0], x[1].expected))


def test_telling_terms_by_counting(spark):
    n, hits, docs, toxic = 30, 25, 200, 60
    seen = np.array([[hits, n - hits], [toxic - hits, docs - n - toxic + hits]], float)
    want = 2 * (seen * np.log(seen / (seen.sum(1, keepdims=True) * seen.sum(0) / docs))).sum()
    got = spark.range(1).select(toxicity.g_statistic(F.lit(n), F.lit(hits), docs, toxic)).first()[0]
    assert got == pytest.approx(want)


def test_near_duplicates_against_all_pairs(spark, odd_docs, docs):
    reach = smallest_reachable([d for d, _ in docs if d is not None], similar_pairs(docs, 85))
    got = neardup.op6_neardup(spark, odd_docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((d, reach[d]) for d, _ in docs if d is not None)
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingles(t)) for _, t in docs)


def test_chains_across_components(spark):
    """A chain whose ends don't link is one component, whichever documents the pivots are."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(12):
        words = list(base)
        for j in range(k):
            words[j * 20] = f"new{j}"
        rows.append((100 - k, " ".join(words)))
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {89}


def test_one_document_of_each_group_stays(spark, odd_docs):
    table = spark.read.parquet(f"{odd_docs}/documents.parquet")
    kept = neardup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 40 in ids and not {41, 42, 43, 44, 50, 51} & set(ids)


@pytest.mark.parametrize("first", [0, 1 << 62])
def test_repeated_ids_of_other_texts_are_documents_of_their_own(spark, first):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(1, a, 1), (1, b, 2), (2, a + " end", 3), (3, b, 4), (5, "other text of few words here", 5), (5, "", 6), (5, "", 7), (None, a, 8), (6, "once more", 9), (6, "once more", 10)]
    table = spark.createDataFrame([(d if d is None else first + d, t, n) for d, t, n in rows], "doc_id long, text string, `v``ertex` int")
    kept = neardup.drop_near_duplicates(table)
    assert kept.columns == table.columns and sorted(r[2] for r in kept.collect()) in ([1, 2, 5, 6, 7, 8, 9], [1, 2, 5, 6, 7, 8, 10])


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_of_every_document(spark, sf_dir, monkeypatch, block):
    """All links of a full comparison are found, however small the blocks are."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    links = similar_pairs(docs, 85)
    reach = smallest_reachable([d for d, _ in docs], links)
    got = {r["doc_id"]: r["component_id"] for r in neardup.op6_neardup(spark, folder).collect()}
    assert len(links) > 50 and got == reach


def test_pipeline_drops_pairs_from_a_similarity_of_0_80(spark, tmp_path):
    """Against all pairs: copies between 0.80 and 0.85 go in the pipeline and stay apart in op6_neardup, those below 0.80 stay in both."""
    rows = []
    for g in range(40):
        words = [f"g{g}w{i}" for i in range(200 + g)]
        rows.append((10 * g, " ".join(words)))
        changed = list(words)
        for i in range(20, 20 + (3 + g % 4) * 25, 25):
            changed[i] = f"other{g}x{i}"
        rows.append((10 * g + 1, " ".join(changed)))
    sets = [(d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for d, w in ((d, t.split()) for d, t in rows)]
    like = {(a, b): len(x & y) / len(x | y) for a, x in sets for b, y in sets if a < b}
    between = [p for p, s in like.items() if 0.80 <= s < 0.85]
    assert len(between) >= 8 and sum(0.7 < s < 0.80 for s in like.values()) >= 8 and sum(s >= 0.85 for s in like.values()) >= 8

    def reach(least):
        return smallest_reachable([d for d, _ in rows], [p for p, s in like.items() if s >= least])

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == {d for d, low in reach(0.80).items() if d == low}
    assert not kept & {b for _, b in between}
    assert {r["doc_id"]: r["component_id"] for r in neardup.op6_neardup(spark, str(tmp_path)).collect()} == reach(0.85)


def test_pruning_keeps_what_reaches_the_threshold():
    rng, least = np.random.default_rng(0), neardup.fewest_matches(0.85)
    equal = rng.random((20_000, neardup.HASHES)) < 0.85
    kept = neardup.survives(equal.astype(np.uint32), np.ones_like(equal, np.uint32), least)
    assert len(kept) / len(equal) > 0.999


def cut_blocks(text):
    """The digests' blocks, byte by byte."""
    out, block, before = [], b"", b"\n\n\n\n"
    for n in range(len(text) + 1):
        c = text[n : n + 1] or b"\n"
        h = sum(x * odd for x, odd in zip(reversed(before), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), strict=True)) % (1 << 32)
        if c == b"\n" or c == b" " and (h >> 20) % 4 == 0:
            out += [block] * bool(block)
            block = b""
        else:
            block += c
        before = before[1:] + c
    return {(b, n) for n, b in enumerate_equal(out)}


def enumerate_equal(items):
    seen = Counter()
    for x in items:
        yield seen[x], x
        seen[x] += 1


def test_fingerprints_against_sets(spark, odd_docs, docs):
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    got = fingerprints.op7_fingerprints(spark, odd_docs).collect()
    want, prints, exact = [], {}, {}
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest()))
        a, b, c = (cut_blocks(x.encode()) for x in (t, edited, after))
        exact[want[-1]] = [(len(x ^ y), 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0) for x, y in ((a, b), (a, c))]
        assert len(a) == len(fingerprints.digests(t.encode()))
    rows = {(str(r["doc_id"]), r["n_chars"], r["edited_sha256"]): r for r in got}
    assert len(got) == len(docs) and set(rows) == set(want)
    for key, r in rows.items():
        for (n, like), value in zip(exact[key], (r["near_edited"], r["near_next"]), strict=True):
            # small differences are recovered digest by digest, others are estimated
            assert value == pytest.approx(like, abs=1e-9 if n <= 10 else 0.35) and 0 <= value <= 1
    texts = dict(docs)
    for r in got:
        assert prints.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"] or r["doc_id"] is None


def test_likeness_follows_from_the_returned_fingerprints(spark, sf_dir):
    rows = sorted(fingerprints.op7_fingerprints(spark, sf_dir.replace("sf0.001", "sf0.01")).collect(), key=lambda r: r["doc_id"])
    prints = [r["fingerprint"] for r in rows]
    assert fingerprints.likeness(prints, [r["edited_fingerprint"] for r in rows]).tolist() == [r["near_edited"] for r in rows]
    assert fingerprints.likeness(prints, prints[1:] + prints[:1]).tolist() == [r["near_next"] for r in rows]
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.9 * len(rows)


def test_peeling_recovers_the_difference():
    a, b = np.arange(1, 40, dtype=np.uint64), np.arange(20, 60, dtype=np.uint64)

    def sketch(keys, width):
        out = fingerprints.Sketches(np.array([width]))
        out.add(np.zeros(len(keys), np.int64), keys, np.ones(len(keys), np.int64))
        return out

    of, keys, sign, whole = sketch(a, 64).subtract(sketch(b, 64)).peel()
    assert whole[0] and set(keys[sign > 0].tolist()) == set(range(1, 20)) and set(keys[sign < 0].tolist()) == set(range(40, 60))
    assert not sketch(a, 4).subtract(sketch(b, 4)).peel()[3][0]
    small, folded = sketch(a, 16), sketch(a, 64).folded(np.array([0]), np.array([16]))
    assert (small.count == folded.count).all() and (small.keys == folded.keys).all() and (small.checks == folded.checks).all()


def test_estimates_of_large_differences():
    rng = np.random.default_rng(8)
    for n, common in ((300, 0), (300, 150), (2000, 200)):
        keys = rng.integers(0, 1 << 63, 2 * n, np.int64).astype(np.uint64)
        sets = fingerprints.Sets(np.repeat([0, 1], n), np.concatenate([keys[:n], keys[n - common : 2 * n - common]]), 2)
        s = fingerprints.Sketches.of(sets)
        got = fingerprints.likeness_of(s, np.array([0]), s, np.array([1]))[0]
        assert got == pytest.approx(common / n, abs=0.2)


def test_masked_text_has_no_personal_data(spark, odd_docs):
    masked = pii.mask(spark.read.parquet(f"{odd_docs}/documents.parquet"))
    rows = {r["doc_id"]: r for r in masked.where("doc_id in (57, 58)").collect()}
    assert rows[57]["text"] == "mail <EMAIL>, <PHONE> or <IP>"
    assert rows[58]["text"] == "<CARD> and 4111111111111112; iban <IBAN>. ssn: <SSN>, tel <LOCAL_PHONE>"
    assert rows[57]["n_chars"] == len(rows[57]["text"])


def test_token_counts_add_up(spark, odd_docs, docs):
    encode = tokencounts.encoder(tokencounts.tokenizer_path()).encoding.encode_ordinary
    table = spark.read.parquet(f"{odd_docs}/documents.parquet")
    rows = tokencounts.section_tokens(table, fields=("source", "text")).collect()
    total = sum(len(encode(f"{r['source'] or ''}\n{r['text'] or ''}")) for r in table.collect())
    assert sum(r["n_tokens"] for r in rows) == total


@pytest.mark.parametrize("rule, want", [("first", [3, 1]), ("last", [2, 2]), ("most", [2, 2])])
def test_boundary_rules(rule, want):
    # the third token has one character before the boundary at 5 and two after it
    n, crossing = tokencounts.allocate(np.array([0, 2, 4, 7]), np.array([1, 3, 6, 8]), np.array([5, 9]), rule)
    assert n.tolist() == want and crossing.tolist() == [1, 0]


def check_shards(docs, rows, shards):
    """Sizes and digests, gapless slots, near-equal bytes, and equal texts in one shard while they fit."""
    size = lambda t: len((t or "").encode()) + 16
    want = sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    slots, filled, groups, places = defaultdict(list), Counter(), Counter(), defaultdict(set)
    for _, t in docs:
        groups[size(t), zlib.crc32((t or "").encode())] += size(t)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        filled[r["shard"]] += r["size"]
        places[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    mean = sum(filled.values()) / shards
    assert all(len(places[g]) == 1 for g, b in groups.items() if b <= mean)
    fits = max((b for b in groups.values() if b <= mean), default=0)
    alone = max((g[0] for g in groups if g[0] > mean), default=0)
    assert max(filled.values()) - min(filled[s] for s in range(shards)) <= max(fits, alone, 0.02 * mean)
    return filled, mean


def test_shards_are_near_equal_and_gapless(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(docs, sharding.op10_sharding(spark, folder).collect(), 40)


def test_shards_of_many_small_rows_are_within_a_hundredth(spark):
    docs = [(i, f"text {i} " + "x" * (i % 50)) for i in range(20_000)]
    filled, mean = check_shards(docs, sharding.shard_rows(spark.createDataFrame(docs, "doc_id long, text string"), shards=10).collect(), 10)
    assert max(filled.values()) < 1.01 * mean and min(filled.values()) > 0.99 * mean


def test_a_group_larger_than_a_shard_is_subdivided(spark):
    docs = [(i, "same text" if i % 2 else f"text {i}" if i % 10 else "another text") for i in range(4000)] + [(7, "same text")] * 300
    filled, mean = check_shards(docs, sharding.shard_rows(spark.createDataFrame(docs, "doc_id long, text string"), shards=10).collect(), 10)
    assert max(filled.values()) < 1.02 * mean


def test_columns_with_clashing_names_pass_through(spark, odd_docs):
    names = ["n", "s", "t", "mix", "copy", "__mix", "__size", "__s", "__toxicity", "toxicity", "vertex", "salt", "rank", "first", "we`ird.name", "dot.ted"]
    table = spark.read.parquet(f"{odd_docs}/documents.parquet").limit(40)
    table = table.select("doc_id", "text", "source", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for stage in (corpus_pipeline.reject_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mask_personal_data, corpus_pipeline.mix):
        out = stage(spark, table, odd_docs)
        assert out.columns == table.columns
        assert {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(names)))}
    assert packing.pack_documents(table.drop("source")).columns[-2:] == ["sequence_id", "offset"]


def test_pipeline(spark, odd_docs, empty_docs):
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    columns = docs.columns
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd_docs)
        assert docs.columns == columns
    rows = corpus_pipeline.run(spark, odd_docs).collect()
    assert rows and len({(r["doc_id"], r["copy"], r["piece"]) for r in rows}) == len(rows)
    assert corpus_pipeline.run(spark, empty_docs).count() == 0
