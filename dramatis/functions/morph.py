"""Declension of the closed vocabulary of job titles, from rules.

Lemmas are needed only for words that a catalog names, so each is declined by the rule of its class, and the
table of forms is read backwards. Words outside it stand for themselves in lower case.
"""

from __future__ import annotations

from functools import cache

# The words, by declension class.
MASCULINE = "директор президент бухгалтер аналитик аудитор инженер конструктор технолог мастер менеджер рекрутер юрист архитектор врач ректор профессор помощник начальник разработчик персонал маркетинг проект отдел департамент совет бренд участок".split()
MASCULINE_SOFT = "секретарь председатель заместитель руководитель".split()
FEMININE = "продажа закупка логистика экономика".split()
NEUTER = "производство строительство".split()
ADJECTIVES = "генеральный исполнительный финансовый главный старший технический информационный коммерческий юридический операционный сервисный научный".split()
IRREGULAR = {
    "владелец": "владелец владельца владельцу владельцем владельце владельцы владельцев владельцам владельцами владельцах".split(),
    "казначей": "казначей казначея казначею казначеем казначее казначеи казначеев казначеям казначеями казначеях".split(),
    "участок": "участок участка участку участком участке участки участков участкам участками участках".split(),
}
#: Abbreviations that are written in capitals.
KEPT_UPPER = "ceo cto cfo coo cio hr it ит pr gr vp cmo cro cso pmo".split()


def forms(word: str) -> list[str]:
    """All forms, the genitive singular second."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word in MASCULINE:
        plural = "и" if word[-1] in "кгхжшчщ" else "ы"
        many = "ей" if word[-1] in "жшчщ" else "ов"
        return [word, *(word + e for e in ("а", "у", "ом", "е", plural, many, "ам", "ами", "ах")), *([word[:-2] + "ора"] if word in ("директор", "профессор") else [])]
    if word in MASCULINE_SOFT:
        return [word, *(word[:-1] + e for e in ("я", "ю", "ем", "е", "и", "ей", "ям", "ями", "ях"))]
    if word in FEMININE:
        plural = "и" if word[-2] in "кгхжшчщ" else "ы"
        stem = word[:-1]
        many = stem[:-1] + "ок" if stem.endswith("пк") else stem
        return [word, *(stem + e for e in (plural, "е", "у", "ой", "ам", "ами", "ах")), many]
    if word in NEUTER:
        return [word, *(word[:-1] + e for e in ("а", "у", "ом", "е", "ам", "ами", "ах")), word[:-1]]
    if word in ADJECTIVES:
        stem, soft = word[:-2], word.endswith("ший")
        hard = ("ый", "ого", "ому", "ым", "ом", "ая", "ой", "ую", "ое", "ые", "ых", "ыми")
        velar = ("ий", "ого", "ому", "им", "ом", "ая", "ой", "ую", "ое", "ие", "их", "ими")
        sibilant = ("ий", "его", "ему", "им", "ем", "ая", "ей", "ую", "ее", "ие", "их", "ими")
        return [stem + e for e in (sibilant if soft else velar if word.endswith("ий") else hard)]
    return [word]


@cache
def lemma_table() -> dict[str, str]:
    """Form -> lemma; the first class that has a form keeps it."""
    table: dict[str, str] = {}
    for word in [*MASCULINE, *MASCULINE_SOFT, *FEMININE, *NEUTER, *ADJECTIVES, *IRREGULAR]:
        for form in forms(word):
            table.setdefault(form, word)
    return table


#: First parts of hyphenated titles that are declined as well.
DECLINED_FIRST = ["инженер"]


def genitive(phrase: str) -> str:
    """A title in the genitive singular, word by word, beginning with a small letter. Of a hyphenated word the last part is declined."""
    out = []
    for token in phrase.split(" "):
        low = token.lower()
        lemma = lemma_table().get(low)
        if low in KEPT_UPPER:
            out.append(token.upper())
        elif "-" in low:
            *first, last = low.split("-")
            parts = [forms(x)[1] if x in DECLINED_FIRST else x for x in first]
            out.append("-".join([*parts, forms(lemma_table().get(last, last))[1] if last in lemma_table() else last]))
        elif lemma:
            form = forms(lemma)[1]
            out.append(form[:1].upper() + form[1:] if token[:1].isupper() else form)
        else:
            out.append(low)
    text = " ".join(out)
    return text[:1].lower() + text[1:]
