"""People on a page: look-ahead over its lines, and cards where that finds nobody."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dramatis.functions import names, text
from dramatis.functions.binding import let
from dramatis.functions.positions import MARKERS, has_marker

#: Lines after a title in which the name may stand, and lines from the name on in which its phone and email may.
NAME_WITHIN, SCOPE, LONGEST_TITLE = 3, 5, 120
TITLE_EDGE, CARD_EDGE = " -–—•·|:", " \t-–—•·|:"


def _contact(name: Column, position: Column, scope: Column, phones: str) -> Column:
    return F.struct(
        name.alias("full_name"), position.alias("position_raw"),
        let(text.extract_emails(scope), text.person_email).alias("person_email"), text.first_or_empty(text.extract_phones(scope, phones)).alias("person_phone"),
    )


def first_name(line: Column) -> Column:
    """The first run of capitalised words of a line if it is a valid name, else an empty string."""
    found = F.coalesce(F.get(names.candidates(line), F.lit(0)), F.lit(""))
    return let(found, lambda n: F.when(names.is_valid(n), n).otherwise(""))


def look_ahead(lines: Column) -> Column:
    """Pairs (title line, name line), left to right: after a pair the search goes on behind its name line."""
    marks = F.transform(lines, lambda x: F.struct((has_marker(x) & (F.length(x) < LONGEST_TITLE) & ~names.is_valid(x)).alias("title"), first_name(x).alias("name")))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i: int, j: int>>").alias("pairs"))
    titles = lambda m: F.filter(F.transform(m, lambda x, i: F.when(x["title"], i)), lambda i: i.isNotNull())

    def pairs(m: Column) -> Column:
        name_line = lambda i: F.coalesce(*[F.when(F.get(m, i + k)["name"] != "", i + k) for k in range(1, NAME_WITHIN + 1)])
        found = F.filter(F.transform(titles(m), lambda i: F.struct(i.alias("i"), name_line(i).alias("j"))), lambda p: p["j"].isNotNull())
        step = lambda state, p: F.when(p["i"] >= state["next"], F.struct((p["j"] + 1).alias("next"), F.concat(state["pairs"], F.array(p)).alias("pairs"))).otherwise(state)
        return F.aggregate(found, start, step, lambda state: state["pairs"])

    return let(marks, pairs)


def from_lines(lines: Column, phones: str = "plan") -> Column:
    return F.transform(
        look_ahead(lines),
        lambda p: _contact(first_name(F.get(lines, p["j"])), F.btrim(F.get(lines, p["i"]), F.lit(TITLE_EDGE)), F.array_join(F.slice(lines, p["j"] + 1, SCOPE), " \n"), phones),
    )


def from_blocks(blocks: Column, phones: str = "plan") -> Column:
    """One contact per card that holds a title and a valid name."""
    pattern = rf"(?iU)\b({'|'.join(MARKERS)})\b"

    def card(block: Column) -> Column:
        found = F.get(F.filter(names.candidates(block), names.is_valid), F.lit(0))
        lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.btrim(x, F.lit(CARD_EDGE))), lambda x: (x != "") & has_marker(x) & ~names.is_valid(x))
        at = F.regexp_instr(block, F.lit(pattern))
        begin = F.greatest(F.lit(1), at - 40)
        around = F.trim(F.split_part(F.substring(block, begin, at + F.length(F.regexp_extract(block, pattern, 1)) + 40 - begin), F.lit("\n"), F.lit(1)))
        return let(found, lambda name: F.when(name.isNotNull(), _contact(name, F.coalesce(F.get(lines, F.lit(0)), around), block, phones)))

    return F.filter(F.transform(F.filter(blocks, has_marker), card), lambda c: c.isNotNull())


def first_of_each(contacts: Column) -> Column:
    """The first contact of each pair of name and title, whatever their case."""
    key = lambda c: F.concat_ws("\x1f", F.lower(c["full_name"]), F.lower(c["position_raw"]))
    return let(contacts, lambda a: let(F.transform(a, key), lambda keys: F.filter(a, lambda c, i: F.array_position(keys, key(c)) == i + 1)))


def page_contacts(page: Column, phones: str = "plan") -> Column:
    """All contacts of a parsed page."""
    flat = first_of_each(from_lines(page["lines"], phones))
    return let(flat, lambda a: F.when(F.size(a) > 0, a).otherwise(first_of_each(from_blocks(page["blocks"], phones))))
