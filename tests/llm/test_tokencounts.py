"""Tokens of sections against a plain loop over characters."""

import pytest

from folium.llm import tokencounts

FIELDS = ("source", "text")


def sections(values, by_line):
    """(field, start, end) of a document's joined fields."""
    out, at = [], 0
    for k, (field, value) in enumerate(zip(FIELDS, values, strict=True)):
        part = (value or "") + ("\n" if k + 1 < len(values) else "")
        lines = [part]
        if by_line:
            *closed, last = part.split("\n")
            lines = [x + "\n" for x in closed] + ([last] if last or not closed else [])
        for line in lines:
            out.append((field, at, at + len(line)))
            at += len(line)
    return out


def counted(encoding, values, by_line, rule):
    """Rows (field, section, start, end, n_tokens, n_crossing) by owners of single characters."""
    text, parts = "\n".join(v or "" for v in values), sections(values, by_line)
    owner = [s for s, (_, a, b) in enumerate(parts) for _ in range(a, b)]
    char_of = [k for k, c in enumerate(text) for _ in c.encode()]
    tokens, crossing, at = [0] * len(parts), [0] * len(parts), 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        chars = range(char_of[at], char_of[at + size - 1] + 1)
        at += size
        owners = [owner[c] for c in chars]
        to = {"first": owners[0], "last": owners[-1], "most": max(sorted(set(owners)), key=owners.count)}[rule]
        tokens[to] += 1
        crossing[owners[0]] += owners[0] != owners[-1]
    return [(f, s, a, b, n, x) for s, ((f, a, b), n, x) in enumerate(zip(parts, tokens, crossing, strict=True))]


@pytest.mark.parametrize("rule", tokencounts.RULES)
@pytest.mark.parametrize("by_line", [True, False])
def test_sections_equal_a_plain_loop(spark, odd_docs, rule, by_line):
    encoding = tokencounts.encoder(tokencounts.tokenizer_path()).encoding
    odd = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{odd_docs}/documents.parquet").collect()]
    more = [(1001, "a", "one\n\n\n\ntwo\n \n\tthree\n"), (1002, None, "\n"), (1003, "", ""), (1004, "é\nß", "naïve 🙂🙂\n漢字かな\n\n  x"), (1005, "s", "    \n    \n\n\n        y")]
    docs = [(i, d, s, t) for i, (d, s, t) in enumerate(odd + more)]
    table = spark.createDataFrame(docs, "doc_id long, real long, source string, text string")
    got = {}
    for r in tokencounts.section_tokens(table, FIELDS, by_line, rule).collect():
        got.setdefault(r["doc_id"], []).append((r["field"], r["section"], r["start"], r["end"], r["n_tokens"], r["n_crossing"]))
        assert r["doc_tokens"] == len(encoding.encode_ordinary(f"{docs[r['doc_id']][2] or ''}\n{docs[r['doc_id']][3] or ''}"))
    want = {i: counted(encoding, (s, t), by_line, rule) for i, _, s, t in docs}
    assert {i: sorted(rows, key=lambda r: r[1]) for i, rows in got.items()} == want
    assert any(x for rows in want.values() for *_, x in rows)
