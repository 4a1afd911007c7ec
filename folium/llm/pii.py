"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame operations only.

A kind has a pattern, a validator and a score; a word of its context within CONTEXT characters before or after the span adds to
the score, and a span is kept from THRESHOLD on. The base kinds score above it by themselves; the added ones are IBANs
(mod 97), which do too, and US social security numbers and phone numbers without a country code, which need a word nearby.

Matches are leftmost and non-overlapping within a kind; a match that fails is dropped, not retried. Their places come
from the lengths of the matches and of the pieces between them. The patterns are written with possessive repeats and
start only where a run starts, which finds the same matches as the plain forms in time linear in the text.

Cases: a null text is an empty one; very long texts are read whole; repeated rows give repeated results; an empty table
an empty one; other columns pass through `mask`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import table

CONTEXT, THRESHOLD = 40, 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that every text with a match passes.
    hint: str
    #: Whether a match (value, text, start, end) is confirmed.
    valid: Callable[[Column, Column, Column, Column], Column]
    score: float
    context: str


def _always(value: Column, text: Column, start: Column, end: Column) -> Column:
    return F.lit(True)


def _ip(value: Column, text: Column, start: Column, end: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})$"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column, text: Column, start: Column, end: Column) -> Column:
    digits = F.reverse(F.split(_digits(value), ""))

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    n = F.length(_digits(value))
    return F.when(n.between(16, 19), F.aggregate(F.transform(digits, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def _phone(value: Column, text: Column, start: Column, end: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


def _mod97(value: Column, text: Column, start: Column, end: Column) -> Column:
    compact = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.length(compact).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def _apart(text: Column, start: Column, end: Column) -> Column:
    """No letter, digit or hyphen touches the span."""
    around = F.concat(F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(""), F.substring(text, end + 1, F.lit(1)))
    return ~around.rlike("[A-Za-z0-9-]")


def _ssn(value: Column, text: Column, start: Column, end: Column) -> Column:
    return ~value.rlike("^(000|666|9)") & ~value.rlike("-00-|-0000$") & _apart(text, start, end)


def _local_phone(value: Column, text: Column, start: Column, end: Column) -> Column:
    return _apart(text, start, end) & ~F.substring(text, start - 3, F.lit(4)).rlike(r"\+")


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", _always, 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", _ip, 0.7, r"ip|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]{2}|[0-9][\x20-][0-9]", _luhn, 0.8, "card|visa|credit|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _phone, 0.7, "phone|tel|call|fax|mobile"),
)
ADDED = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}", _mod97, 0.6, "iban|bank|account|konto"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9]{2}-[0-9]", _ssn, 0.3, "ssn|social security"),
    Kind("local_phone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", r"[0-9][.-][0-9]{4}", _local_phone, 0.3, "phone|tel|call|fax|mobile"),
)
KINDS = BASE + ADDED


def spans_of(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, value, score) of one kind, in order; places in code points, end exclusive."""
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string,score:double>>)")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    pieces = F.split(text, kind.pattern, -1)
    placed_type = "array<struct<start:int,end:int,value:string>>"

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).cast(placed_type).alias("out"))

    def scored(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
        nearby = F.lower(F.concat(before, F.lit("\n"), F.substring(text, x["end"] + 1, F.lit(CONTEXT))))
        score = F.lit(kind.score) + F.when(nearby.rlike(kind.context), 0.3).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {placed_type})").alias("out"))
    placed = F.aggregate(F.arrays_zip(pieces.alias("p"), found.alias("m")), start, place)["out"]
    valid = F.filter(placed, lambda x: kind.valid(x["value"], text, x["start"], x["end"]))
    kept = F.filter(F.transform(valid, scored), lambda x: x["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.hint), kept).otherwise(empty)


def find_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All spans of a text, by kind as listed, then by start."""
    body = F.coalesce(text, F.lit(""))
    return F.concat(*[spans_of(body, k) for k in kinds])


def mask_text(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The text with every span that find_spans gives replaced by <KIND>; of spans that overlap the first, the longer one on a tie."""
    ordered = F.array_sort(F.transform(find_spans(text, kinds), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))

    def cut(acc: Column, x: Column) -> Column:
        masked = F.struct((-x["back"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"))
        return F.when(x["start"] >= acc["at"], masked).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(text.isNotNull(), F.aggregate(ordered, start, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def mask(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with the spans of find_spans masked; n_chars, where it is a column, follows the text. Nulls stay null."""
    out = docs.withColumn(text, mask_text(F.col(text), kinds))
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", find_spans(F.col("text")).alias("s"))
    names = [k.name for k in BASE]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of_kind(name: str) -> Column:
        return F.filter("s", lambda x: x["kind"] == name)

    counts = [F.size(of_kind(n)).cast("long").alias(f"n_{n}") for n in names]
    base = F.filter("s", lambda x: x["kind"].isin(names))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
k AS (
  SELECT * FROM (VALUES
    (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', 0.9, ''),
    (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', 0.7, ''),
    (3, 'card', '[0-9]([\x20-]?[0-9])+', 0.8, ''),
    (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', 0.7, ''),
    (5, 'iban', '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?', 0.6, ''),
    (6, 'ssn', '[0-9]{3}-[0-9]{2}-[0-9]{4}', 0.3, 'ssn|social security'),
    (7, 'local_phone', '\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}', 0.3, 'phone|tel|call|fax|mobile')
  ) AS t(ord, kind, re, score, ctx)
), f AS (
  SELECT rid, text, ord, kind, score, ctx, regexp_extract_all(text, re) AS ms, regexp_split_to_array(text, re) AS ps FROM d, k WHERE regexp_matches(text, re)
), u AS (
  SELECT rid, text, ord, kind, score, ctx, unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM f
), p AS (
  SELECT rid, text, ord, kind, score, ctx, ms[i] AS v,
    (sum(length(ps[i]) + length(ms[i])) OVER (PARTITION BY rid, ord ORDER BY i) - length(ms[i]))::INT AS s,
    (sum(length(ps[i]) + length(ms[i])) OVER (PARTITION BY rid, ord ORDER BY i))::INT AS e
  FROM u
), q AS (
  SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS dg, replace(v, ' ', '') AS c,
    (CASE WHEN s > 0 THEN substring(text, s, 1) ELSE '' END) || substring(text, e + 1, 1) AS around,
    lower(substring(text, greatest(s - 40, 0) + 1, least(s, 40)) || chr(10) || substring(text, e + 1, 40)) AS nearby
  FROM p
), ok AS (
  SELECT rid, ord, kind, s, e FROM q WHERE
    (ctx = '' OR regexp_matches(nearby, ctx)) AND CASE kind
      WHEN 'email' THEN true
      WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0
      WHEN 'card' THEN length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda j:
        CASE WHEN (length(dg) - j) % 2 = 0 THEN dg[j]::INT WHEN dg[j]::INT > 4 THEN dg[j]::INT * 2 - 9 ELSE dg[j]::INT * 2 END)) % 10 = 0
      WHEN 'phone' THEN length(dg) BETWEEN 8 AND 15
      WHEN 'iban' THEN length(c) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substring(c, 5) || substring(c, 1, 4), ''), lambda x: ascii(x))),
        lambda r, a: (CASE WHEN a < 65 THEN r * 10 + a - 48 ELSE r * 100 + a - 55 END) % 97) = 1
      WHEN 'ssn' THEN NOT regexp_matches(v, '^(000|666|9)') AND NOT regexp_matches(v, '-00-|-0000$') AND NOT regexp_matches(around, '[A-Za-z0-9-]')
      ELSE NOT regexp_matches(around, '[A-Za-z0-9-]') AND NOT contains(substring(text, greatest(s - 3, 1), 4), '+') END
), g AS (
  SELECT rid, count(*) FILTER (ord = 1) AS n_email, count(*) FILTER (ord = 2) AS n_ip, count(*) FILTER (ord = 3) AS n_card, count(*) FILTER (ord = 4) AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (ord <= 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) AS spans
  FROM ok GROUP BY rid
)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
