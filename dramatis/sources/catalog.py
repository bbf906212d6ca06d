"""The catalog of positions: the only dimension of the engine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from dramatis.functions.morph import genitive

CEO, CFO, ACCOUNTANTS, ENGINEERS, OTHERS = "Генеральные директора", "Финансовые директора", "Главные бухгалтеры", "Главные инженеры", "Остальные"
ROLE_SHEETS = [CEO, CFO, ACCOUNTANTS, ENGINEERS]
SHEETS = [*ROLE_SHEETS, OTHERS]
METHODS = ["exact", "morph", "fuzzy", "fallback", "empty"]

TOP, MONEY, IT, MAKING, SALES = "Топ-менеджмент", "Финансы / Бухгалтерия", "IT / Технологии", "Производство / Инженерия", "Продажи / Маркетинг"
HR, LAW, LOGISTICS, OPERATIONS, MIDDLE = "HR / Персонал", "Юридический отдел", "Логистика / Закупки", "Операционное управление", "Средний менеджмент"
BUILDING, HEALTH, SCIENCE = "Строительство / Проектирование", "Медицина / Здравоохранение", "Образование / Наука"

# The positions, in the order that decides ties.
# id | canonical | aliases | keywords (all must occur) | category | sheet | priority | excluding modifiers | one of these is required
POSITIONS = f"""
ceo | Генеральный директор | ген. директор; ген директор; гендиректор; генеральный; ceo; chief executive officer; executive director; президент компании; президент; директор компании; директор | директор | {TOP} | {CEO} | 100 | зам; и.о.; бывший; экс; помощник; ассистент; советник | генеральный; ceo; president; президент; исполнительный
executive_director | Исполнительный директор | исполнительный директор; managing director | исполнительный; директор | {TOP} | {CEO} | 95 | зам; и.о.; помощник |
president | Президент | президент; president | президент | {TOP} | {CEO} | 90 | вице; помощник; зам |
owner | Владелец | владелец; собственник; основатель; founder; co-founder; учредитель | владелец | {TOP} | | 70 | |
chairman | Председатель совета директоров | председатель совета директоров; chairman | председатель | {TOP} | | 70 | |
vice_president | Вице-президент | вице-президент; vice president; vp | вице-президент | {TOP} | | 70 | |
cfo | Финансовый директор | финдиректор; cfo; chief financial officer; директор по финансам; директор по экономике и финансам; финансовый директор | финансовый; директор | {MONEY} | {CFO} | 100 | зам; и.о.; помощник; ассистент |
economic_director | Директор по экономике | директор по экономике; economic director | экономика; директор | {MONEY} | {CFO} | 90 | зам; и.о.; помощник |
chief_accountant | Главный бухгалтер | главбух; chief accountant; главный бухгалтер | главный; бухгалтер | {MONEY} | {ACCOUNTANTS} | 100 | зам; и.о.; старший; младший; помощник; ассистент |
accountant | Бухгалтер | бухгалтер; accountant | бухгалтер | {MONEY} | | 30 | |
senior_accountant | Старший бухгалтер | старший бухгалтер; senior accountant | старший; бухгалтер | {MONEY} | | 50 | |
financial_analyst | Финансовый аналитик | финансовый аналитик; financial analyst | финансовый; аналитик | {MONEY} | | 30 | |
treasurer | Казначей | казначей; treasurer | казначей | {MONEY} | | 30 | |
auditor | Аудитор | аудитор; auditor | аудитор | {MONEY} | | 30 | |
cto | Технический директор | cto; chief technology officer; директор по технологиям; технический директор | технический; директор | {IT} | {ENGINEERS} | 100 | зам; и.о.; помощник |
cio | IT-директор | it-директор; ит-директор; cio; chief information officer; директор по it; директор по информационным технологиям | информационный; директор | {IT} | | 80 | зам; и.о. |
head_of_it | Руководитель отдела IT | руководитель отдела it; head of it; начальник отдела ит | руководитель | {IT} | | 40 | |
developer | Разработчик | разработчик; developer; программист | разработчик | {IT} | | 20 | |
devops | DevOps-инженер | devops; devops-инженер; site reliability engineer; sre | devops | {IT} | | 20 | |
chief_engineer | Главный инженер | главный инженер; chief engineer | главный; инженер | {MAKING} | {ENGINEERS} | 95 | зам; и.о.; старший; помощник |
production_director | Директор по производству | директор по производству; production director | производство; директор | {MAKING} | | 60 | зам; и.о. |
engineer | Инженер | инженер; engineer | инженер | {MAKING} | | 20 | |
senior_engineer | Старший инженер | старший инженер; senior engineer | старший; инженер | {MAKING} | | 30 | |
designer_engineer | Инженер-конструктор | инженер-конструктор; инженер конструктор; design engineer | инженер; конструктор | {MAKING} | | 30 | |
chief_technologist | Главный технолог | главный технолог | главный; технолог | {MAKING} | | 50 | зам |
foreman | Мастер | мастер участка; старший мастер; бригадир | мастер | {MAKING} | | 20 | |
sales_director | Директор по продажам | директор по продажам; sales director; коммерческий директор | продажа; директор | {SALES} | | 60 | зам; и.о. |
commercial_director | Коммерческий директор | коммерческий директор; commercial director | коммерческий; директор | {SALES} | | 60 | зам; и.о. |
marketing_director | Директор по маркетингу | директор по маркетингу; marketing director; cmo | маркетинг; директор | {SALES} | | 60 | зам; и.о. |
sales_manager | Менеджер по продажам | менеджер по продажам; sales manager | менеджер; продажа | {SALES} | | 20 | |
purchase_manager | Менеджер по закупкам | менеджер по закупкам; purchasing manager | менеджер; закупка | {LOGISTICS} | | 20 | |
project_manager | Менеджер по проектам | менеджер по проектам; project manager; руководитель проектов | менеджер; проект | {OPERATIONS} | | 20 | |
brand_manager | Бренд-менеджер | бренд-менеджер; brand manager | бренд | {SALES} | | 20 | |
smm_manager | SMM-менеджер | smm-менеджер; smm manager | smm | {SALES} | | 20 | |
hr_director | Директор по персоналу | директор по персоналу; hr director; hrd | персонал; директор | {HR} | | 60 | зам; и.о. |
hr_manager | HR-менеджер | hr-менеджер; менеджер по персоналу; hr manager | hr | {HR} | | 20 | |
recruiter | Рекрутер | рекрутер; recruiter | рекрутер | {HR} | | 20 | |
legal_director | Директор юридического департамента | директор юридического департамента; legal director; general counsel | юридический; директор | {LAW} | | 60 | |
lawyer | Юрист | юрист; юрисконсульт; lawyer | юрист | {LAW} | | 20 | |
head_of_legal | Начальник юридического отдела | начальник юридического отдела; head of legal | юридический | {LAW} | | 40 | |
logistics_director | Директор по логистике | директор по логистике; logistics director | логистика; директор | {LOGISTICS} | | 60 | зам; и.о. |
logistics_manager | Менеджер по логистике | менеджер по логистике; logistics manager | менеджер; логистика | {LOGISTICS} | | 20 | |
coo | Операционный директор | операционный директор; coo; chief operating officer | операционный; директор | {OPERATIONS} | | 70 | зам; и.о. |
deputy_director | Заместитель директора | заместитель директора; зам. директора; замдиректора; зам директора | заместитель; директор | {MIDDLE} | | 80 | |
head_of_department | Руководитель отдела | руководитель отдела; начальник отдела; head of department | руководитель | {MIDDLE} | | 50 | |
department_chief | Начальник отдела | начальник отдела | начальник; отдел | {MIDDLE} | | 50 | |
service_manager | Сервисный менеджер | сервисный менеджер; service manager | сервисный | {OPERATIONS} | | 20 | |
technical_manager | Технический менеджер | технический менеджер; technical manager | технический; менеджер | {IT} | | 30 | |
manager_generic | Менеджер | менеджер; manager | менеджер | {OPERATIONS} | | 10 | |
assistant | Помощник | помощник; ассистент; assistant | помощник | {OPERATIONS} | | 10 | |
secretary | Секретарь | секретарь; secretary | секретарь | {OPERATIONS} | | 10 | |
construction_director | Директор по строительству | директор по строительству | строительство; директор | {BUILDING} | | 60 | |
chief_architect | Главный архитектор | главный архитектор | главный; архитектор | {BUILDING} | | 50 | |
project_engineer | Инженер проекта | инженер проекта; гип; главный инженер проекта | инженер; проект | {BUILDING} | | 30 | |
chief_physician | Главный врач | главный врач; главврач; chief physician | главный; врач | {HEALTH} | | 60 | |
doctor | Врач | врач; doctor | врач | {HEALTH} | | 20 | |
rector | Ректор | ректор | ректор | {SCIENCE} | | 60 | |
professor | Профессор | профессор; professor | профессор | {SCIENCE} | | 20 | |
scientific_director | Научный руководитель | научный руководитель | научный; руководитель | {SCIENCE} | | 40 | |
"""


@dataclass(frozen=True)
class Position:
    ord: int
    id: str
    canonical: str
    aliases: list[str]
    keywords: list[str]
    category: str
    sheet: str | None
    priority: int
    exclude_modifiers: list[str]
    requires_any: list[str]

    @property
    def canonical_gen(self) -> str:
        return genitive(self.canonical)


@cache
def positions() -> tuple[Position, ...]:
    out = []
    for k, line in enumerate(POSITIONS.strip().split("\n")):
        name, canonical, aliases, keywords, category, sheet, priority, excluded, required = (x.strip() for x in line.split("|"))
        many = lambda x: [y.strip() for y in x.split(";") if y.strip()]
        out.append(Position(k, name, canonical, many(aliases), many(keywords), category, sheet or None, int(priority), many(excluded), many(required)))
    return tuple(out)


SCHEMA = "ord int, id string, canonical string, aliases array<string>, keywords array<string>, category string, sheet string, priority int, exclude_modifiers array<string>, requires_any array<string>, canonical_gen string"


def catalog_frame(spark: SparkSession) -> DataFrame:
    rows = [(p.ord, p.id, p.canonical, p.aliases, p.keywords, p.category, p.sheet, p.priority, p.exclude_modifiers, p.requires_any, p.canonical_gen) for p in positions()]
    return spark.createDataFrame(rows, SCHEMA)
