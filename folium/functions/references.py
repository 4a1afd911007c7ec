"""Parsing of reference strings as Column expressions: identifiers, year, title, authors, links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.text import quote_plus, strip


#: Endings that belong to the sentence around an identifier or link, not to it.
CLOSING, BRACKETS = ".,;:!?'\"", ")]}>"
#: Identifiers by their public syntax: a DOI is a registrant's number and a suffix; an arXiv identifier is year, month and number,
#: or an archive and seven digits before 2007.
DOI = r"10\.[0-9]{4,9}(?:\.[0-9]+)*/[^\s\"<>,]+"
ARXIV = r"(?:[0-9]{2}(?:0[1-9]|1[0-2])\.[0-9]{4,5}|[A-Za-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?"
LINK = r"https?://[^\s\"<>]+"
EARLIEST, LATEST = 1900, 2030


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _bare(found: Column) -> Column:
    """Without closing marks; closing brackets go too where none was opened."""
    return F.when(found.contains("(") | found.contains("["), F.rtrim(found, F.lit(CLOSING))).otherwise(F.rtrim(found, F.lit(CLOSING + BRACKETS)))


def doi(text: Column) -> Column:
    """The first DOI, however it is introduced."""
    return _filled(_bare(F.regexp_extract(text, DOI, 0)))


def arxiv_id(text: Column) -> Column:
    """The first identifier that follows the archive's name or address."""
    return _filled(F.regexp_extract(text, rf"(?i:arxiv(?:\.org/(?:abs|pdf)/|:\s*))({ARXIV})", 1))


def url(text: Column) -> Column:
    """The first link whose host is not one of the resolvers that `doi` and `arxiv_id` stand for."""
    links = F.transform(F.regexp_extract_all(text, F.lit(f"(?i:{LINK})"), 0), _bare)
    host = lambda u: F.lower(F.split_part(u, F.lit("/"), F.lit(3)))
    return F.try_element_at(F.filter(links, lambda u: ~host(u).isin("doi.org", "dx.doi.org", "www.doi.org", "arxiv.org", "www.arxiv.org")), F.lit(1))


def year(text: Column) -> Column:
    """The first year from EARLIEST to LATEST in brackets, else anywhere."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\(([0-9]{4})[a-z]?\)"), 1), F.regexp_extract_all(text, F.lit(r"\b([0-9]{4})\b"), 1))
    return F.try_element_at(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(EARLIEST, LATEST)), F.lit(1))


def without_number(text: Column) -> Column:
    """Without the number in a list: [3], (3) or 3. before the rest."""
    return F.regexp_replace(text, r"^\s*(?:\[[0-9]+\]|\([0-9]+\)|[0-9]+\.)\s*", "")


def title(text: Column) -> Column:
    """What stands in quotes; else the first sentence, after authors with a bracketed year, of three words or more that is no link or venue."""
    quoted = F.trim(F.regexp_extract(text, r"[\"“”]([^\"“”]+)[\"“”]", 1))
    plain = F.regexp_replace(F.regexp_replace(without_number(text), f"(?i:{LINK})", ""), r"^[^().]+\([0-9]{4}[a-z]?\)[.,:]?\s*", "")
    sentences = F.transform(F.split(plain, r"[.?!]\s+"), lambda t: F.trim(t))
    wordy = F.filter(sentences, lambda t: (F.regexp_count(t, F.lit(r"\p{L}{3,}")) >= 3) & ~t.rlike(r"(?i)^(?:in|see|doi|proceedings)\b"))
    return F.coalesce(_filled(quoted), F.try_element_at(wordy, F.lit(1)))


def authors(text: Column, most: int = 5) -> Column:
    """Names with initials before the title or year, as they are written; null if there is none or more than 20."""
    before = F.regexp_extract(without_number(text), r"^([^\"“”(]*)", 1)
    names = F.transform(F.regexp_extract_all(before, F.lit(r"\p{Lu}[\p{L}'-]+,\s(?:\p{Lu}\.[ -]?)+"), 0), lambda n: F.trim(n))
    return F.when(F.size(names).between(1, 20), F.slice(names, 1, most))


def split_references(text: Column) -> Column:
    """References of a section: at [n], (n) or n. where lines start so, else at empty lines."""
    def cut(pattern: str) -> Column:
        return F.filter(F.transform(F.split(text, pattern), strip), lambda r: r != "")

    return (
        F.when(text.rlike(r"(?m)^\s*\[\d+\]"), cut(r"(?m)(?=^\s*\[\d+\])"))
        .when(text.rlike(r"(?m)^\s*\(\d+\)"), cut(r"(?m)(?=^\s*\(\d+\))"))
        .when(text.rlike(r"(?m)^\s*\d+\.\s"), cut(r"(?m)(?=^\s*\d+\.\s)"))
        .otherwise(F.filter(cut(r"\n\s*\n"), lambda r: F.length(r) > 20))
    )


def scholar_link(raw: Column, title: Column, authors: Column, year: Column) -> Column:
    parts = F.concat_ws(" ", F.nullif(title, F.lit("")), F.try_element_at(authors, F.lit(1)), year.cast("string"))
    plain = F.regexp_replace(F.left(raw, F.lit(200)), r"[\[\]()]", "")
    return F.concat(F.lit("https://scholar.google.com/scholar?q="), quote_plus(F.when(parts == "", plain).otherwise(parts)))


def link(doi: Column, arxiv: Column, url: Column, scholar: Column) -> tuple[Column, Column]:
    """The best link and its kind."""
    kind = F.when(doi.isNotNull(), "doi").when(arxiv.isNotNull(), "arxiv").when(url.isNotNull(), "url").otherwise("scholar")
    target = F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://arxiv.org/abs/"), arxiv), url, scholar)
    return target, kind


def pdf_link(arxiv: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.lit(".pdf"))


def arxiv_abs_to_pdf(address: Column) -> Column:
    return F.regexp_replace(address, r"^https?://arxiv\.org/abs/([0-9.]+)(v\d+)?.*$", "https://arxiv.org/pdf/$1$2.pdf")


def doi_of_url(address: Column) -> Column:
    """The DOI of a resolver's address, without query or fragment."""
    return _filled(F.regexp_extract(address, r"(?i)^https?://(?:dx\.|www\.)?doi\.org/([^\s?#]+)", 1))


# ---------------------------------------------------------------- references whose fields ran together

#: Names as they stand before a year: words and initials, or initials first. No part can match another's characters, so they stay linear.
NAME = r"(?:(?:[A-Z]\.\s*)+[A-Z][a-z]++|[A-Z][a-z]++(?:\s+(?:[A-Z][a-z]++|[A-Z]\b\.?))*+)"
NAMES = rf"{NAME}(?:(?:,\s*and\s+|\s+and\s+|,\s*){NAME})*+"
CENTURIES = r"\b((?:19|20)[0-9]{2})\b"


def year_of(text: Column) -> Column:
    """The first year of the twentieth or twenty-first century."""
    return _filled(F.regexp_extract(text, CENTURIES, 1))


def title_authors(title: Column) -> Column:
    """The names that precede 'year.' at a title's start, none if there are none."""
    names = F.regexp_extract(title, rf"^({NAMES})\.?\s*[0-9]{{4}}\.", 1)
    return F.filter(F.transform(F.split(names, r",\s*(?:and\s+)?|\s+and\s+"), strip), lambda n: n != "")


def clean_title(title: Column) -> Column:
    """Without authors and year before it, or a year after it, or dots and blanks around it."""
    bare = F.regexp_replace(title, rf"^{NAMES}\.?\s*[0-9]{{4}}\.\s*", "")
    bare = F.regexp_replace(bare, r"^\s*[0-9]{4}(?:[a-z]?\.)?\s+", "")
    return F.btrim(F.regexp_replace(bare, r"\.\s*[0-9]{4}\.$", "."), F.lit(". "))


def repair(title: Column, year: Column, authors: Column, venue: Column) -> tuple[Column, Column, Column, Column]:
    """Title, year, authors and venue, the year and authors taken from the title where they are missing; a year that is none is null."""
    no_names = F.coalesce(F.size(F.filter(authors, lambda a: strip(a) != "")), F.lit(0)) == 0
    people = F.when((F.coalesce(F.size(authors), F.lit(0)) == 0) & title.isNotNull(), title_authors(title)).when(~no_names, F.filter(authors, lambda a: strip(a) != ""))
    return clean_title(title), year_of(F.coalesce(_filled(year), year_of(title))), F.coalesce(people, F.expr("cast(array() as array<string>)")), clean_title(venue)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sentences(text: Column, last: int) -> Column:
    """The sentences of a text as one, without so many of the last; a single one stays."""
    kept = F.filter(F.split(text, r"\."), lambda p: strip(p) != "")
    some = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - last, F.lit(0)))).otherwise(kept)
    return strip(F.array_join(some, ". "))


def popup_fields(text: Column) -> tuple[Column, Column, Column]:
    """Title, authors and year of a reference by its full stops: authors stand before the first; the title after the year, without
    the last two sentences, or, if that has under 10 characters, between the first sentence and the last; else the first 100 characters."""
    bare = F.regexp_replace(text, r"^\[[0-9]+\]\s*", "")
    year = year_of(bare)
    opening = F.substring_index(bare, ".", 1)
    people = F.filter(F.array(strip(opening)), lambda o: o != "")
    names = F.flatten(F.transform(people, lambda o: F.transform(F.split(o, r"(?i),\s*(?:and\s+)?|\s+and\s+"), strip)))
    beyond = F.coalesce(F.substring(bare, F.instr(bare, year) + 4, F.length(bare)), F.lit(""))
    inner = F.substring(bare, F.length(opening) + 2, F.length(bare))
    # the first that is long enough, of what may be the title
    choices = F.array(
        F.struct(_sentences(beyond, 2).alias("t"), F.lit(10).alias("least")), F.struct(_sentences(inner, 1).alias("t"), F.when(F.regexp_replace(inner, r"[.\s]", "") == "", 1000).otherwise(0).alias("least")),
        F.struct(_sentences(beyond, 2).alias("t"), F.lit(0).alias("least")),
    )
    title = F.get(F.filter(choices, lambda c: F.length(c["t"]) >= c["least"]), F.lit(0))["t"]
    return _let(title, lambda t: F.when(F.length(t) < 5, strip(F.left(bare, F.lit(100)))).otherwise(t)), names, year.cast("int")


def search_text(text: Column) -> Column:
    """A reference without its number, runs of blanks or final dot."""
    single = F.btrim(F.regexp_replace(text, r"[\s\u00A0\u2000-\u200B\u2028\u2029]+", " "))
    bare = F.regexp_replace(single, r"^(?:\[[0-9]+\] ?)?(?:[0-9]+\. ?)?", "")
    return F.btrim(F.when(bare.endswith("."), F.left(bare, F.length(bare) - 1)).otherwise(bare))


def _behind(text: Column, part: Column) -> Column:
    """What follows a part that a text starts with, and the mark after it."""
    return F.substring(text, F.length(part) + 2, F.length(text))


def components(text: Column) -> Column:
    """(format, authors, year, title, venue) by what stands around the first year: in brackets after names ('Authors (year). Title. Venue'),
    after a sentence and a name ('Title. Author, year. Venue'), after other words ('Words year rest'); else all is the venue. A
    title runs to its full stop."""
    dots = F.lit(". \t\n\r")

    def record(name: str, authors: Column, year: Column, title: Column, venue: Column) -> Column:
        return F.struct(F.lit(name).alias("format"), authors.alias("authors"), year.alias("year"), title.alias("title"), venue.alias("venue"))

    def bracketed(clean: Column) -> Column:
        before = F.substring_index(clean, "(", 1)
        inside = _behind(clean, before)
        rest = F.ltrim(F.substring(inside, 6, F.length(inside)), dots)
        title = F.substring_index(rest, ".", 1)
        fits = (strip(before) != "") & ~before.contains(".") & inside.rlike(r"^[0-9]{4}\)") & (title != "")
        return F.when(fits, record("authorYear", F.rtrim(before), F.left(inside, F.lit(4)), title, F.ltrim(_behind(rest, title))))

    def after_title(clean: Column) -> Column:
        title = F.substring_index(clean, ".", 1)
        rest = F.ltrim(_behind(clean, title))
        name = F.substring_index(rest, ",", 1)
        tail = F.ltrim(_behind(rest, name))
        fits = (title != "") & (name != "") & tail.rlike("^[0-9]{4}")
        return F.when(fits, record("titleFirst", name, F.left(tail, F.lit(4)), title, F.ltrim(F.substring(tail, 5, F.length(tail)), dots)))

    def after_words(clean: Column) -> Column:
        cut = F.split(clean, r"\s+(?=[0-9]{4}\b)", 2)
        rest = F.get(cut, F.lit(1))
        return F.when((F.size(cut) == 2) & (F.get(cut, F.lit(0)) != ""), record("simple", F.get(cut, F.lit(0)), F.left(rest, F.lit(4)), F.lit(""), F.substring(rest, 5, F.length(rest))))

    none = F.lit("")
    return _let(search_text(text), lambda c: F.coalesce(bracketed(c), after_title(c), after_words(c), record("unknown", none, none, none, c)))


def search_query(text: Column) -> Column:
    """A long title in quotes, the first three words of the authors and the year; else the first 100 characters."""
    c = components(text)
    parts = F.concat_ws(
        " ", F.when(F.length(c["title"]) > 10, F.concat(F.lit('"'), c["title"], F.lit('"'))),
        _filled(F.array_join(F.slice(F.split(c["authors"], r"\s+"), 1, 3), " ")), _filled(c["year"]),
    )
    return F.when(parts == "", F.left(search_text(text), F.lit(100))).otherwise(parts)


# Patterns of in-text citations, their type and confidence, in order.
CITATION_PATTERNS = [
    (r"\(([A-Z][a-z]+(?:\s+et\s+al\.)?),?\s+(\d{4}[a-z]?)\)", "inline", 0.9),
    (r"\(([A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+)*(?:\s*&\s*[A-Z][a-z]+)?),?\s+(\d{4}[a-z]?)\)", "inline", 0.85),
    (r"\[(\d+(?:[-,]\d+)*)\]", "reference", 0.8),
    (r"([¹²³⁴⁵⁶⁷⁸⁹⁰]+)", "reference", 0.7),
    (r"(10\.\d{4,}/[^\s\)]+)", "doi", 0.95),
    (r"(https?://[^\s\)]+)", "url", 0.9),
    (r"(arXiv:\d{4}\.\d{4,5}(?:v\d+)?)", "reference", 0.9),
]


def citations(text: Column) -> Column:
    """Array of (type, text, confidence, priority): distinct in-text citations, by pattern, then place."""
    rank = {"doi": 4, "inline": 3, "url": 2, "reference": 1}

    def of(pattern: str, kind: str, confidence: float) -> Column:
        def record(t: Column) -> Column:
            return F.struct(F.lit(kind).alias("type"), t.alias("text"), F.lit(confidence).alias("confidence"), F.lit(rank[kind]).alias("priority"))

        return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)), record)

    return F.concat(*[of(*p) for p in CITATION_PATTERNS])
