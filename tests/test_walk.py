"""The walk that gathers a reference, against a line by line version, and matches of a dictionary with their words."""

import random
import re

from folium.operators.citations import CLOSING_HEADING, NO_TEXT, REFERENCE_STARTS, reference_walk
from folium.operators.dictionary import term_matches
from folium.operators.keywords import prepared_terms


def kind_of(text):
    return next((name for name, pattern in REFERENCE_STARTS if re.search(pattern, text)), None)


def walked(target, lines, dx=25.0, dy=60.0):
    _, page, x, y = target
    tops = [l[3] for l in lines if l[0] == page + 1]
    met = [(False, *l) for l in lines if l[0] == page and y - dy <= l[3] <= y] + [(True, *l) for l in lines if l[0] == page + 1 and l[3] >= max(tops) - dy]
    near = [l for l in met if abs(l[3] - x) <= dx]
    if not near:
        return NO_TEXT, "none", False, 0.0, 0
    kind, taken, spans = None, [], False
    for is_next, _, pos, _, ly, text in sorted(near, key=lambda l: (l[0], -l[4], l[2])):
        text = text.strip()
        if not text:
            continue
        spans = spans or is_next
        own = kind_of(text)
        if kind and own == kind:
            break
        if kind is None and own is None:
            continue
        kind = kind or own
        taken.append(text)
        if own is None and re.search(CLOSING_HEADING, text):
            break
    if not taken:
        used = [l[5].strip() for l in sorted(near, key=lambda l: (l[2], l[5].strip()))]
        return re.sub(r"\s+", " ", " ".join(used)).strip() or NO_TEXT, "proximity", spans, round(0.3 + 0.1 * spans, 6), len(used)
    return re.sub(r"\s+", " ", " ".join(taken)).strip(), kind, spans, round(0.8 + 0.1 * spans, 6), len(taken)


def test_walk_equals_brute_force(spark):
    draw = random.Random(5)
    texts = ["[1] Smith", "[2]  Doe", "Smith, J. Title (2001)", "Roe et al. (1999)", "doi:10.1/x", "https://a.b", "arXiv:1", "3. Third", "goes  on", "", "  ", "Appendix A", "Tables 1", "and on"]
    lines = [(p, i, draw.choice([40.0, 50.0, 60.0, 300.0]), 700.0 - 12 * i, draw.choice(texts)) for p in range(60) if p % 7 for i in range(draw.randint(1, 9))]
    targets = [(i, draw.randrange(60), draw.choice([50.0, 300.0, 500.0]), 700.0 - 12 * draw.randrange(9)) for i in range(300)]
    out = reference_walk(spark.createDataFrame(targets, "id int, page int, x double, y double"), spark.createDataFrame(lines, "page int, pos int, x double, y double, text string")).collect()
    got = {r["id"]: (r.reference, r.method, r.spans_pages, r.confidence, r.lines_used) for r in out}
    assert got == {t[0]: walked(t, lines) for t in targets}
    assert len({m for _, m, *_ in got.values()}) > 4


def test_terms_are_shown_as_they_stand(spark):
    terms = prepared_terms(spark.createDataFrame([("neural network", "u1"), ("network", "u2")], "name string, url string"))
    docs = spark.createDataFrame([(1, "Two Neural Networks, one network."), (2, "none"), (3, None), (4, "")], "doc_id int, text string")
    got = sorted((r.doc_id, r.start_idx, r.end_idx, r.matched_text.lower(), r.name, r.url) for r in term_matches(docs, terms).collect())
    assert got == [(1, 1, 2, "neural networks", "neural network", "u1"), (1, 4, 4, "network", "network", "u2")]
