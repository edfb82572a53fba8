"""Scalar expressions for bibliographic text: titles, names, years, labels, embedded data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that are no person, and marks of labels that say nothing about a work.
NOT_PERSONS = ["bible", "anonymous", "unknown", "various", "encyclopedia", "the koran", "the quran", "the talmud", "folklore", "oral tradition"]
NOISE_MARKS = ["Best Books", "Category", "--", "Listings", "Banned Books", "Anne Haight", "Harvard Classics", "Movie Books"]
_START, _END = r"(?is)^.*?\*\*\*\s*START OF.*?\*\*\*", r"(?is)\*\*\*\s*END OF.*"


def _tokens(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def norm_title(title: Column) -> Column:
    """Lower case, letters, digits and single spaces; one leading article goes."""
    plain = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "^(the|a|an) ", ""), " +", " "))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(_tokens(norm_title(title), " "))


def surname(author: Column) -> Column:
    """The last word in lower case (so of "Verne, Jules" the given name); empty without words."""
    return F.lower(F.coalesce(F.try_element_at(_tokens(author, r"[,\s]+"), F.lit(-1)), F.lit("")))


def match_key(title: Column, author: Column) -> Column:
    return F.concat_ws("|", norm_title(title), surname(author))


def is_person(name: Column) -> Column:
    return ~norm_title(name).isin(NOT_PERSONS) & F.trim(name).rlike(r"^[A-Za-z.\-' ]+$")


def year_in(text: Column) -> Column:
    """The first four-digit year from 1000 to 2099 in a text, else null."""
    return F.nullif(F.regexp_extract(text, r"\b(1[0-9]{3}|20[0-9]{2})\b", 1), F.lit("")).try_cast("int")


def bucket(year: Column, width: int = 20) -> Column:
    return (F.floor(year / width) * width).cast("int")


def year_label(year: Column) -> Column:
    return F.when(year < 0, F.concat((-year).cast("string"), F.lit(" BCE"))).otherwise(year.cast("string"))


def is_datable(takeoff: Column, start: int) -> Column:
    return F.coalesce(takeoff > start + 2, F.lit(False))


def without_boilerplate(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _START, ""), _END, "")


def first_words(text: Column, n: int) -> Column:
    """The first n words joined by a space; null if there is none."""
    return F.nullif(F.array_join(F.slice(_tokens(text, r"\s+"), 1, n), " "), F.lit(""))


def json_array(text: Column, schema: str) -> Column:
    """What stands from the first [ to the last ] of a text, parsed; an empty array if there is none or it is damaged."""
    return F.coalesce(F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), schema), F.array().cast(schema))


def plain_text_url(formats: Column) -> Column:
    found = F.filter(F.map_entries(formats), lambda e: e["key"].startswith("text/plain") & ~e["value"].endswith(".zip"))
    return F.get(found, F.lit(0))["value"]


def ordered_labels(first: Column, second: Column, n: int = 8) -> Column:
    return F.slice(F.array_distinct(F.concat(first, second)), 1, n)


def clean_labels(labels: Column, marks: list[str] | None = None) -> Column:
    marks = NOISE_MARKS if marks is None else marks

    def noise(label: Column) -> Column:
        found = F.lit(False)
        for m in marks:
            found = found | label.contains(m)
        return found

    return F.filter(labels, lambda g: ~noise(g))


def title_overlap(want: Column, got: Column) -> Column:
    return F.size(F.array_intersect(want, got)) / F.greatest(F.size(want), F.lit(1))


def description_or_title(description: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(description, F.lit("")), title, F.lit(""))


def balanced_object(text: Column, marker: str) -> Column:
    """The first {...} with even braces behind a marker (strings are not looked into); null if there is none."""
    rest = F.lit(2147483647)
    tail = F.when(F.contains(text, F.lit(marker)), F.substring(text, F.instr(text, marker) + len(marker), rest))
    opened = F.when(F.contains(tail, F.lit("{")), F.substring(tail, F.instr(tail, "{"), rest))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(opened, ""), zero, step, lambda s: s["end"])
    return F.when(end > 0, F.substring(opened, F.lit(1), end))


def hover_fields(text: Column) -> Column:
    """title, author and year of "<b>title</b><br>author (year)"; what doesn't match is all title."""
    pattern = r"(?s)^<b>(.*?)</b><br>(.*) \((-?[0-9]+)\)"
    title = F.regexp_extract(text, pattern, 1)
    hit = text.rlike(pattern)
    return F.struct(F.when(hit, title).otherwise(text).alias("title"), F.when(hit, F.regexp_extract(text, pattern, 2)).alias("author"), F.when(hit, F.regexp_extract(text, pattern, 3).try_cast("int")).alias("year"))


def trace_fields(name: Column) -> Column:
    """label, z and emergent of "label (z=+1.23) *"."""
    pattern = r"^(.*?) \(z=([+-]?[0-9.]+)\)"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("label"), F.regexp_extract(name, pattern, 2).try_cast("double").alias("z"), F.contains(name, F.lit("★")).alias("emergent"))


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def colour(code: Column) -> Column:
    """Shares of red, green and blue of "#rrggbb"."""
    return F.array(*(F.round(F.conv(F.substring(code, at, 2), 16, 10).cast("double") / 255, 6) for at in (2, 4, 6)))
