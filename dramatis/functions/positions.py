"""Job titles as column expressions: cleaning, lemmas, matching against the catalog, routing to sheets.

The catalog is a literal inside the expressions, so a title is resolved within its row, with no join: exact matches by a
map look-up, lemma matches by higher-order functions over 59 entries. Only fuzzy scoring needs Python.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from dramatis.functions.binding import let, literal_array, literal_map, sql_literal
from dramatis.functions.morph import KEPT_UPPER, lemma_table
from dramatis.sources.catalog import OTHERS, ROLE_SHEETS, Position, positions

# Characters, words and patterns that results depend on.
EDGE = " \t\n\r-–—•·|,.;:"
TITLE_WORDS = "директор бухгалтер инженер менеджер руководитель начальник президент специалист мастер технолог врач юрист архитектор оператор инспектор ректор профессор советник помощник казначей аудитор разработчик программист рекрутер учредитель владелец основатель".split()
MARKERS = (
    "директор бухгалтер инженер менеджер руководитель начальник президент специалист мастер технолог врач юрист архитектор оператор консультант "
    "ректор профессор советник помощник казначей аудитор разработчик программист рекрутер учредитель владелец основатель секретарь "
    "engineer manager director officer developer accountant president ceo cto cfo coo cio founder owner"
).split()
LEGAL_FORMS = "ооо оао пао зао ао ип фгуп муп гуп нко ано ltd llc inc gmbh".split()
TAIL = r"(?iU)\b(по|в|на|при)\s+[а-яё][а-яё\s-]{2,40}"
PREFIXES = [(r"(?U)^\s*зам(?:\.|естител\w*|\s|$)", "Заместитель "), (r"(?U)\bи\.\s*о\.?|\bврио\b", "И.о. "), (r"(?U)\bпомощник\w*", "Помощник "), (r"(?U)\bассистент\w*", "Ассистент ")]
FALLBACK_CATEGORY, FUZZY_LEAST = "Другое", 90


def has_marker(line: Column) -> Column:
    """Whether a line holds a job title as a whole word."""
    return F.rlike(line, F.lit(rf"(?iU)\b({'|'.join(MARKERS)})\b"))


def clean(raw: Column) -> Column:
    """A title without decoration: the first sentence, spaces collapsed, at most 120 characters."""
    edge = F.lit(EDGE)
    s = F.btrim(F.coalesce(raw, F.lit("")), edge)
    s = F.regexp_replace(s, r"(?sU)[.!?;]\s+[А-ЯA-Z].*$", "")
    s = F.regexp_replace(s, r"(?U)\s*[—–-]\s+[а-яa-z]", "")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return let(s, lambda t: F.btrim(F.when(F.length(t) > 120, _cut(t)).otherwise(t), edge))


def _cut(title: Column) -> Column:
    """A long title up to the first word of the list that occurs, and six words more."""
    heads = F.array(*[F.regexp_extract(title, rf"(?isU)^(.*?\b{word}\w*\b)", 1) for word in TITLE_WORDS])
    head = F.coalesce(F.get(F.filter(heads, lambda h: h != ""), F.lit(0)), F.lit(""))

    def with_tail(h: Column) -> Column:
        tail = F.slice(F.filter(F.split(F.substring(title, F.length(h) + 1, F.lit(1_000_000)), " "), lambda w: w != ""), 1, 6)
        return F.when(h != "", F.concat(h, F.lit(" "), F.array_join(tail, " "))).otherwise(title)

    return F.trim(F.left(let(head, with_tail), F.lit(120)))


@cache
def _lemma_map() -> Column:
    return literal_map(lemma_table())


def lemmas(text: Column) -> Column:
    """Lemmas of the words of a text; words outside the closed vocabulary stand for themselves."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[A-Za-zА-Яа-яЁё]+"), 0)
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(_lemma_map(), w), w)))


def has_lemma(found: Column, word: Column) -> Column:
    """Whether ``word`` is a lemma, or one of at least four letters and either begins with the other."""
    near = lambda x: (F.length(x) >= 4) & (F.length(word) >= 4) & (F.startswith(x, word) | F.startswith(word, x))
    return F.array_contains(found, word) | F.exists(found, near)


def _escape(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def _word_starts(words: list[str]) -> str:
    return r"(?iU)\b(" + "|".join(map(_escape, words)) + ")"


def has_exclude(low: Column, modifiers: list[str]) -> Column:
    return F.rlike(low, F.lit(_word_starts(modifiers))) if modifiers else F.lit(False)


def has_required(low: Column, found: Column, words: list[str]) -> Column:
    """Whether any of ``words`` is a lemma or begins a word; true if there are none."""
    if not words:
        return F.lit(True)
    plain = [w for w in words if all(c.isalpha() or c == "-" for c in w)]
    out = F.rlike(low, F.lit(_word_starts(words)))
    for w in plain:
        out = out | has_lemma(found, F.lit(w))
    return out


def sheet_of(ord_: Column, low: Column, found: Column) -> Column:
    """The sheet of an entry for a title; null if it has none, a modifier excludes it, or what it requires is missing."""
    out = F.lit(None).cast("string")
    for p in positions():
        if p.sheet:
            out = F.when((ord_ == p.ord) & ~has_exclude(low, p.exclude_modifiers) & has_required(low, found, p.requires_any), p.sheet).otherwise(out)
    return out


def field(ord_: Column, get) -> Column:
    """A field of the entry of that number; null for null."""
    return F.try_element_at(literal_map({p.ord: get(p) for p in positions()}), ord_)


@cache
def _exact_map() -> Column:
    first: dict[str, int] = {}
    for p in positions():
        for name in [p.canonical, *p.aliases]:
            first.setdefault(name.lower(), p.ord)
    return literal_map(first)


def exact_match(low: Column) -> Column:
    """Number of the first entry that has this name; null if none has."""
    return F.try_element_at(_exact_map(), low)


@cache
def _rules() -> Column:
    """The entries that have keywords, as an array literal."""

    def rule(p: Position) -> str:
        fields = {"priority": p.priority, "size": len(" ".join(p.keywords)), "back": -p.ord, "keywords": p.keywords, "required": p.requires_any, "pattern": _word_starts(p.requires_any)}
        return f"named_struct({', '.join(f'{sql_literal(k)}, {sql_literal(v)}' for k, v in fields.items())})"

    return F.expr(f"array({', '.join(rule(p) for p in positions() if p.keywords)})")


def morph_match(low: Column, found: Column) -> Column:
    """Number of the best entry all of whose keywords occur: highest priority, then longest keywords, then first."""

    def fits(e: Column) -> Column:
        required = (F.size(e["required"]) == 0) | F.exists(e["required"], lambda t: has_lemma(found, t)) | F.rlike(low, e["pattern"])
        return F.forall(e["keywords"], lambda k: has_lemma(found, k)) & required

    ranks = F.transform(F.filter(_rules(), fits), lambda e: F.struct(e["priority"].alias("priority"), e["size"].alias("size"), e["back"].alias("back")))
    return -F.array_max(ranks)["back"]


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & (1 << len(a)) - 1).bit_count()


def indel(a: str, b: str) -> float:
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two texts as sets of words, 0 to 100."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, [both, " ".join(sorted(d))])) for d in (x - y, y - x))
    ratios = [indel(left, right)]
    if both:
        ratios += [indel(both, left), indel(both, right)]
    return max(ratios)


FUZZY = StructType([StructField("ord", IntegerType()), StructField("score", DoubleType())])


@F.arrow_udf(FUZZY)
def fuzzy_match(lows: pa.Array) -> pa.Array:
    """Number and score of the most similar entry (the first of equals), among canonical names and aliases of two words or more; null below the least score."""
    names = [(p.ord, n.lower()) for p in positions() for n in [p.canonical, *(a for a in p.aliases if len(a.split()) >= 2)]]

    def best(low: str | None) -> dict | None:
        top, at = 0.0, None
        for ord_, name in names if low else ():
            if (s := token_set_ratio(low, name)) > top:
                top, at = s, ord_
        return {"ord": at, "score": top} if at is not None and top >= FUZZY_LEAST else None

    return pa.array([best(x) for x in lows.to_pylist()], pa.struct([("ord", pa.int32()), ("score", pa.float64())]))


def tail(cleaned: Column) -> Column:
    """The first "по ..." or the like of a title."""
    return F.trim(F.regexp_extract(cleaned, TAIL, 0))


def built_canonical(ord_: Column, cleaned: Column) -> Column:
    """The canonical name with the title's own prefix (then in the genitive) and tail."""
    low = F.lower(cleaned)
    prefix = F.lit(None).cast("string")
    for pattern, word in reversed(PREFIXES):
        prefix = F.when(F.rlike(low, F.lit(pattern)), word).otherwise(prefix)
    name = F.when(prefix.isNotNull(), F.concat(prefix, field(ord_, lambda p: p.canonical_gen))).otherwise(field(ord_, lambda p: p.canonical))
    return F.trim(F.concat_ws(" ", name, F.nullif(tail(cleaned), F.lit(""))))


def fallback_canonical(cleaned: Column) -> Column:
    """An unmatched title in lower case, abbreviations and legal forms in capitals, the first letter capital."""
    tokens = F.regexp_extract_all(cleaned, F.lit(r"(?U)[\s,.;:/]+|[^\s,.;:/]+"), 0)
    upper = literal_array([*KEPT_UPPER, *LEGAL_FORMS])
    words = F.transform(tokens, lambda t: F.when(F.array_contains(upper, F.lower(t)), F.upper(t)).when(F.rlike(t, F.lit("^[A-Za-zА-Яа-яЁё]")), F.lower(t)).otherwise(t))
    return let(F.trim(F.array_join(words, "")), lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1_000_000)))


def route(sheet: Column, full_name: Column) -> Column:
    """The one sheet a contact goes to."""
    named = F.trim(F.coalesce(full_name, F.lit(""))) != ""
    return F.when(named & sheet.isin(ROLE_SHEETS), sheet).otherwise(OTHERS)
