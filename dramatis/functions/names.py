"""Person names as column expressions: splitting, gender, normal form, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dramatis.functions.binding import let, literal_array

# Words that are never part of a name, and patterns that results depend on.
STOP_WORDS = {
    "roles": "генеральный исполнительный директор главный заместитель зам начальник руководитель менеджер инженер бухгалтер президент вице-президент советник помощник ассистент специалист мастер оператор инспектор консультант координатор юрист врач владелец собственник основатель".split(),
    "organization_forms": "ооо оао зао пао ао ип фгуп муп гуп нко ано ltd llc inc gmbh corp plc".split(),
    "cities": "москва санкт-петербург петербург спб мск екатеринбург новосибирск казань нижний новгород краснодар ростов-на-дону уфа самара челябинск омск пермь воронеж волгоград красноярск".split(),
    "geography": "область край республика город поселок район улица".split(),
    "ui_noise": ["page down", "page up", "map data", "keyboard shortcuts", "scroll to zoom", "satellite", "about us", "our team", "contact us", "meet the team", "read more", "подробнее", "все сотрудники", "вся команда", "подробнее о", "узнать больше", "обратная связь", "тех. поддержка", "служба поддержки"],
}
MALE_PATRONYMIC = r"(?iU)(ович|евич)(а|у|ем|е)?$"
FEMALE_PATRONYMIC = r"(?iU)(овна|евна|инична|ична)(ы|е|у|ой|ою)?$"
SURNAME = r"(?iU)(ов|ев|ин|ский|цкий|енко|юк|ук)$"
WORD = r"^[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё\-]*$"
INITIALS = r"^[A-ZА-ЯЁ]\.[A-ZА-ЯЁ]?\.?$"
NOISE_BEFORE_SPLIT = [r"(?iU)^(about|our|contact|meet|join|the|this|read|show|see)\s+(us|team|form|staff|company|more|all)$", r"(?iU)^\s*page\s+(up|down)\s*$"]
NOISE = [r"(?iU)^(about|our|contact|meet|join|the)\s+(us|team|form|staff|company)$", r"(?iU)^(read|show|see)\s+more$", r"(?iU)^\s*page\s+(up|down)\s*$"]
MALE_NAMES_IN_A = ["никита", "илья", "кузьма", "фома"]
CANDIDATE = r"(?U)(?:[A-ZА-ЯЁ][a-zа-яё\-]{1,30})(?:\s+[A-ZА-ЯЁ][a-zа-яё\-\.]{1,30}){1,3}"


def candidates(text: Column) -> Column:
    """Runs of two to four capitalised words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CANDIDATE), 0)


def _matches_any(c: Column, patterns: list[str]) -> Column:
    return F.rlike(c, F.lit("|".join(patterns)))


STOP = [w for words in STOP_WORDS.values() for w in words]


def split_name(raw: Column) -> Column:
    """struct(last, first, patronymic), or null if ``raw`` is no name of two or three words."""
    spaced = F.regexp_replace(F.btrim(F.coalesce(raw, F.lit("")), F.lit(" ,.;:\n\t")), r"(?U)\s+", " ")
    return let(spaced, lambda s: F.when(~_matches_any(s, NOISE_BEFORE_SPLIT), let(F.trim(F.regexp_replace(s, r"(?U)\s*\([^)]*\)\s*", " ")), _split)))


def _split(plain: Column) -> Column:
    stop = literal_array(STOP)
    name = lambda last, first, patronymic=F.lit(""): F.struct(last.alias("last"), first.alias("first"), patronymic.alias("patronymic"))
    is_patronymic = lambda t: F.rlike(t, F.lit(f"{MALE_PATRONYMIC}|{FEMALE_PATRONYMIC}"))
    initials = lambda t: F.rlike(t, F.lit(INITIALS))

    def of(tokens: Column) -> Column:
        wordlike = F.forall(tokens, lambda t: F.rlike(F.replace(t, F.lit("."), F.lit("")), F.lit(WORD)))
        fits = F.size(tokens).isin(2, 3) & wordlike & ~F.arrays_overlap(F.transform(tokens, F.lower), stop)
        a, b, c = (F.get(tokens, F.lit(k)) for k in range(3))
        swapped = ~initials(b) & F.rlike(b, F.lit(SURNAME)) | initials(a)
        two = F.when(swapped, name(b, a)).otherwise(name(a, b))
        three = F.when(~is_patronymic(c) & is_patronymic(b), name(c, a, b)).otherwise(name(a, b, c))
        return F.when(fits & (F.size(tokens) == 2), two).when(fits, three)

    return let(F.split(plain, r"(?U)\s+"), of)


def gender(first: Column, patronymic: Column) -> Column:
    low = F.lower(first)
    return (
        F.when(F.rlike(patronymic, F.lit(MALE_PATRONYMIC)), "М")
        .when(F.rlike(patronymic, F.lit(FEMALE_PATRONYMIC)), "Ж")
        .when((low.endswith("а") | low.endswith("я")) & ~low.isin(MALE_NAMES_IN_A), "Ж")
        .otherwise("?")
    )


def capitalised(word: Column) -> Column:
    """Each part of a hyphenated word with a capital first letter and the rest in lower case."""
    return F.array_join(F.transform(F.split(word, "-"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1_000_000)))), "-")


def ending(last: Column) -> Column:
    return F.when(F.length(last) >= 3, F.right(last, F.lit(3))).when(F.length(last) == 2, last).otherwise("")


def normalised(raw: Column) -> Column:
    """struct(last_name, first_name, patronymic, gender, full, initials, ending, valid); names keep their case form."""
    dotted = lambda x: F.concat(F.left(x, F.lit(1)), F.lit("."))

    def of(parts: Column) -> Column:
        shown = F.transform(F.array(parts["last"], parts["first"], parts["patronymic"]), lambda w: F.coalesce(capitalised(w), F.lit("")))
        return let(F.struct(parts.alias("parts"), shown.alias("shown")), finish)

    def finish(x: Column) -> Column:
        last, first, patronymic = (F.get(x["shown"], F.lit(k)) for k in range(3))
        initials = F.when((first != "") & (patronymic != ""), F.concat(dotted(first), dotted(patronymic))).when(first != "", dotted(first)).otherwise("")
        return F.struct(
            last.alias("last_name"), first.alias("first_name"), patronymic.alias("patronymic"),
            F.when(x["parts"].isNull(), "?").otherwise(gender(x["parts"]["first"], x["parts"]["patronymic"])).alias("gender"),
            F.array_join(F.filter(x["shown"], lambda w: w != ""), " ").alias("full"), initials.alias("initials"), ending(last).alias("ending"), ((last != "") & (first != "")).alias("valid"),
        )

    return let(split_name(raw), of)


def is_valid(raw: Column) -> Column:
    """Whether ``raw`` can be the name of a person."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")
    return let(s, lambda t: F.length(t).between(3, 120) & ~_matches_any(t, NOISE) & let(split_name(t), lambda p: p.isNotNull() & (p["last"] != "") & (p["first"] != "")))
