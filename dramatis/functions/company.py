"""Company names as column expressions: cleaning of page titles and choice among candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dramatis.functions.binding import let, literal_array

# Separators, phrases and words that results depend on.
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&"), ("&laquo;", "«"), ("&raquo;", "»")]
#: Of a title as it is written, the one entity that is resolved.
AMPERSAND = [("&amp;", "&")]
SEPARATORS = [" | ", " — ", " – ", " · ", " • ", " :: "]
NOISE = [
    "руководство компании", "руководство", "наша команда", "команда", "контакты", "контакт", "о компании", "о нас", "главная страница",
    "главная", "о предприятии", "наши контакты", "наши сотрудники", "сотрудники", "наши специалисты", "специалисты", "наши эксперты", "эксперты",
    "our team", "our company", "contact us", "contacts", "about us", "about", "home", "home page",
]
JUNK = [
    "команда", "наша команда", "наши специалисты", "наши сотрудники", "наш коллектив", "контакты", "контактная информация", "руководство", "о компании",
    "о нас", "главная", "главная страница", "our team", "about us", "about", "staff", "leadership", "contacts", "наш сайт", "сайт компании",
]
PREFIXES = "команда сотрудники руководство специалисты коллектив профессионал наш наша наши познакомьтесь знакомьтесь".split()
#: Inflected forms of the prefixes, which are stripped like them.
PREFIX_FORMS = PREFIXES + "команды команде команду командой сотрудник сотрудников коллектива профессионалы профессионалов специалист специалистов руководства нашей нашего наше".split()
FORM_AND_QUOTED = r"""(?iU)((?:ООО|ОАО|ПАО|ЗАО|АО|ИП|ФГУП|МУП|ГУП|НКО|АНО)\s*[«"'`]([^»"'`]+)[»"'`])"""
HAS_FORM = r"(?iU)\b(ООО|ПАО|ОАО|ЗАО|АО|ИП|ФГУП|МУП|ГУП|НКО|АНО)\b"
FORMS = "ооо оао пао зао ао ип фгуп муп гуп нко ано ltd llc inc gmbh corp plc".split()
QUOTED = r"""(?U)[«"`]([^»"'`]{2,80})[»"`]"""
EDGE = " :—–-|"


def first_separated(raw: Column) -> Column:
    """What stands before the first of the separators, in their order, that occurs at all."""
    s = F.trim(raw)
    present = F.filter(literal_array(SEPARATORS), lambda x: F.contains(s, x))
    return let(F.get(present, F.lit(0)), lambda x: F.when(x.isNull(), s).otherwise(F.trim(F.split_part(s, x, F.lit(1)))))


def upper_forms(phrase: Column) -> Column:
    """Legal forms in capitals; other words keep their form (no open-vocabulary declension)."""
    tokens = F.regexp_extract_all(phrase, F.lit(r"(?U)\s+|\S+"), 0)
    forms = literal_array(FORMS)
    low = lambda t: F.btrim(F.lower(t), F.lit("«»\"'"))
    return F.array_join(F.transform(tokens, lambda t: F.when(~F.rlike(t, F.lit("^[«\"'`]")) & F.array_contains(forms, low(t)), F.upper(t)).otherwise(t)), "")


def without_noise(s: Column) -> Column:
    """What follows a phrase of the interface at the beginning; null if such a phrase is all. The first phrase of the list that fits decides."""
    phrases = literal_array(NOISE)

    def of(low: Column) -> Column:
        fits = F.filter(phrases, lambda p: (low == p) | F.startswith(low, F.concat(p, F.lit(" "))) | F.startswith(low, F.concat(p, F.lit(":"))))
        rest = lambda p: F.trim(F.ltrim(F.substring(s, F.length(p) + 1, F.lit(1_000_000)), F.lit(EDGE)))
        return let(F.get(fits, F.lit(0)), lambda p: F.when(p.isNull(), s).when(low != p, rest(p)))

    return let(F.btrim(F.lower(s), F.lit(EDGE)), of)


def without_prefixes(s: Column) -> Column:
    """Without the words of the prefix list that it begins with."""
    prefixes = literal_array(PREFIX_FORMS)
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda a, w: F.when((F.size(a) == 0) & F.array_contains(prefixes, F.lower(w)), a).otherwise(F.concat(a, F.array(w))))
    return F.array_join(kept, " ")


def written_title(source: Column) -> Column:
    """A title as it is written, but for the spaces around it and ``AMPERSAND``."""
    return F.replace(F.regexp_replace(source, r"^\p{Zs}+|\p{Zs}+$", ""), *[F.lit(x) for x in AMPERSAND[0]])


def upper_initial(letter: Column) -> Column:
    """A letter's capital, if that is one letter; so ß has ẞ, and not SS."""
    return let(F.upper(letter), lambda u: F.when(letter == "ß", "ẞ").when(F.length(u) > 1, letter).otherwise(u))


def _named(body: Column) -> Column:
    """From what is left once noise and prefixes are gone."""
    final = lambda s: F.trim(F.concat(upper_initial(F.left(s, F.lit(1))), F.substring(s, 2, 1_000_000)))
    short = lambda n: F.when(F.length(n) > 120, F.regexp_replace(F.left(n, F.lit(120)), r"(?s) [^ ]*$", "")).otherwise(n)
    named = lambda n: F.when(F.rlike(body, F.lit(QUOTED)), F.trim(n)).otherwise(let(short(n), lambda s: let(final(s), lambda t: F.when(F.length(t) < 3, "").otherwise(t))))
    return F.when(F.lower(body).isin(JUNK), "").otherwise(let(upper_forms(body), named))


def clean_company_name(raw: Column, entities: list[tuple[str, str]] = ENTITIES) -> Column:
    """The name in a title or the like, in which ``entities`` are resolved; an empty string if it holds none."""
    s = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), entities, F.coalesce(raw, F.lit("")))

    def of(rest: Column) -> Column:
        direct = F.regexp_extract(rest, FORM_AND_QUOTED, 1)
        return F.when(rest.isNull(), "").otherwise(let(direct, lambda d: F.when(d != "", F.trim(upper_forms(F.trim(d)))).otherwise(let(without_prefixes(rest), _named))))

    return let(let(s, first_separated), lambda t: let(without_noise(t), of))


def choose_company_name(candidates: Column, entities: list[tuple[str, str]] = ENTITIES) -> Column:
    """Of an array of candidates: the first that has a legal form once cleaned, else the first that is not empty, else an empty string."""
    cleaned = F.filter(F.transform(candidates, lambda c: clean_company_name(c, entities)), lambda c: c != "")
    return let(cleaned, lambda a: F.coalesce(F.get(F.filter(a, lambda c: F.rlike(c, F.lit(HAS_FORM))), F.lit(0)), F.get(a, F.lit(0)), F.lit("")))


def text_scope(footer: Column, body: Column) -> Column:
    """Where a company's own contacts are looked for: the footer, else the end of the page."""
    return F.coalesce(footer, F.right(F.coalesce(body, F.lit("")), F.lit(4000)))


def told_language(lang: Column) -> Column:
    """The language a page names; an empty string if it names none."""
    return F.coalesce(F.lower(F.left(lang, F.lit(2))), F.lit(""))


def language(lang: Column) -> Column:
    return F.coalesce(F.nullif(told_language(lang), F.lit("")), F.lit("ru"))
