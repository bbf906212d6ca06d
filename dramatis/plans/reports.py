"""Report relations over contacts, and counters over sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramatis.sources.catalog import METHODS, OTHERS, SHEETS, positions
from dramatis.sources.scratch import kept

# Headers and widths of the report.
HEADERS = [
    ("№", 6), ("Компания", 30), ("Сайт", 22), ("ИНН", 14), ("КПП", 12), ("Общий email", 26), ("Общий телефон", 20), ("ФИО (полностью)", 30),
    ("Фамилия", 18), ("Имя", 14), ("Отчество", 18), ("Пол", 6), ("Должность (как на сайте)", 32), ("Должность (норм.)", 28), ("Категория отрасли", 22),
    ("Метод нормализации", 14), ("Личный email", 26), ("Личный телефон", 20), ("Соцсети", 30), ("URL источника", 38), ("Язык", 8), ("Дата", 12), ("Статус", 10), ("Комментарий", 24),
]
QUALITY_HEADERS = ["Компания", "Сайт", "Сырая должность", "Нормализованная", "Метод", "Комментарий"]
FIELDS = "company_name domain inn kpp company_email company_phone full_name last_name first_name patronymic gender position_raw position_canonical role_category norm_method person_email person_phone social_links page_url language scan_date status comment".split()
QUALITY_ORDER = {"empty": -1, "fallback": 0, "fuzzy": 1, "morph": 2, "exact": 3}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sheet_name() -> Column:
    """The sheet of a contact; an unknown or empty one counts as the last."""
    return F.when(F.col("sheet_name").isin(SHEETS), F.col("sheet_name")).otherwise(OTHERS)


def bucket(contacts: DataFrame, name: str) -> DataFrame:
    return contacts.where(sheet_name() == name)


def row_numbers(rows: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """``rows`` with ``n``, their number from 1 in ``order`` (within ``group``, of which there are few values).

    Rows are range-partitioned and numbered within their partition; the counts of the partitions, a few numbers, give what comes before.
    """
    keys = [group] if group else []
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(rows.repartitionByRange(width, *keys, order).withColumn("__part", F.spark_partition_id()), "numbered")
    before, seen = [], {}
    for r in sorted(placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["__part"]):
        key = r[group] if group else None
        before.append((key, r["__part"], seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "__group string, __of int, __before long")
    own = (F.col("__part") == F.col("__of")) & (F.col(group).eqNullSafe(F.col("__group")) if group else F.lit(True))
    within = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order))
    return placed.withColumn("n", within).join(F.broadcast(offsets), own).withColumn("n", (F.col("n") + F.col("__before")).cast("int")).select(*rows.columns, "n")


def numbered(contacts: DataFrame, order: str = "ord") -> DataFrame:
    """Contacts with their number within their sheet, from 1."""
    return row_numbers(contacts.withColumn("sheet", sheet_name()), order, "sheet")


def contact_rows(contacts: DataFrame, order: str, scan_date: str) -> DataFrame:
    """The 24 columns of the report, numbered from 1, in order."""
    extra = {"social_links": F.array_join(F.coalesce("social_links", F.array().cast("array<string>")), "\n"), "scan_date": F.lit(scan_date), "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("ok"))}
    if "scan_date" in contacts.columns:
        extra["scan_date"] = F.coalesce(F.col("scan_date").cast("string"), F.lit(scan_date))
    return row_numbers(contacts, order).select("n", *[extra.get(c, _text(c) if c in contacts.columns else F.lit("")).alias(c) for c in FIELDS]).orderBy("n")


def totals(contacts: DataFrame) -> DataFrame:
    has = lambda c: F.count_if(_text(c) != "")
    return contacts.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct(F.nullif("domain", F.lit(""))).alias("domains"), has("full_name").alias("with_name"),
        has("person_email").alias("with_email"), has("person_phone").alias("with_phone"), has("inn").alias("with_inn"),
    )


def counts_by(contacts: DataFrame, value: Column, names: list[str], label: str) -> DataFrame:
    """One row per name, in order, with how many contacts have that value; names that none has count 0."""
    spark = contacts.sparkSession
    dimension = spark.createDataFrame(list(enumerate(names)), f"pos int, {label} string")
    counted = contacts.select(value.alias(label)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return dimension.join(counted, label, "left").select("pos", label, F.coalesce("n", F.lit(0)).alias("n"))


def sheet_counts(contacts: DataFrame) -> DataFrame:
    return counts_by(contacts, sheet_name(), SHEETS, "sheet")


def method_counts(contacts: DataFrame) -> DataFrame:
    return counts_by(contacts, F.coalesce(F.nullif("norm_method", F.lit("")), F.lit("unknown")), METHODS, "method")


def summary(contacts: DataFrame, task: dict) -> DataFrame:
    """pos, label, value (a string): what the summary sheet shows, from one pass for totals and one for each set of counts."""
    spark = contacts.sparkSession
    meta = [("Задача", task.get("task_id", "")), ("Создано", task.get("created_at", "")), ("Статус", task.get("status", "")), ("Всего URL", task.get("total_urls", 0)), ("Обработано URL", task.get("processed_urls", 0)), ("", "")]
    head = spark.createDataFrame([(k, a, str(b)) for k, (a, b) in enumerate(meta)], "pos int, label string, value string")
    names = [("total", "Всего записей"), ("domains", "Уникальных доменов"), ("with_name", "С ФИО"), ("with_email", "С личным email"), ("with_phone", "С личным телефоном"), ("with_inn", "С ИНН")]
    pairs = F.array(*[F.struct(F.lit(10 + k).alias("pos"), F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for k, (c, label) in enumerate(names)])
    middle = totals(contacts).select(F.explode(pairs).alias("r")).select("r.*")
    sheets = sheet_counts(contacts).select((F.col("pos") + 20).alias("pos"), F.concat(F.lit("Лист: "), "sheet").alias("label"), F.col("n").cast("string").alias("value"))
    methods = method_counts(contacts).select((F.col("pos") + 30).alias("pos"), F.concat(F.lit("Норм. "), "method").alias("label"), F.col("n").cast("string").alias("value"))
    return head.unionByName(middle).unionByName(sheets).unionByName(methods)


def quality_rank() -> Column:
    out = F.lit(99)
    for method, rank in QUALITY_ORDER.items():
        out = F.when(F.col("norm_method") == method, rank).otherwise(out)
    return out


def quality_report(contacts: DataFrame, order: str = "ord") -> DataFrame:
    """Six columns after the rank, least certain methods first."""
    return contacts.select(quality_rank().alias("quality_rank"), *[_text(c).alias(c) for c in ("company_name", "domain", "position_raw", "position_canonical", "norm_method", "comment")], F.col(order).alias("__o")).orderBy("quality_rank", "__o").drop("__o")


def task_counters(sites: DataFrame) -> DataFrame:
    """Per task: sites done, fine, failed (all that are not fine), contacts, and the progress in percent."""
    done = ~F.col("status").isin("pending", "processing")
    out = sites.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("processed"), F.count_if(done & (F.col("status") == "ok")).alias("ok"),
        F.count_if(done & (F.col("status") != "ok")).alias("errors"), F.coalesce(F.sum(F.when(done, F.col("contacts_count"))), F.lit(0)).alias("contacts"),
    )
    return out.withColumn("progress", F.when(F.col("total") == 0, 0).otherwise(F.floor(F.col("processed") * 100 / F.col("total") + 0.5)).cast("long"))


def error_sites(sites: DataFrame) -> DataFrame:
    """Sites that failed; partial ones are not listed."""
    return sites.where("status = 'error'").select("url", "error_code", F.left("error_message", F.lit(200)).alias("error_message"))


def pending_sites(sites: DataFrame, task_id: str) -> DataFrame:
    """What a run or a resumed run of a task has to do."""
    return sites.where((F.col("task_id") == task_id) & F.col("status").isin("pending", "error"))


def task_list(tasks: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first."""
    return tasks.orderBy(F.desc("created_at"), "task_id").offset(offset).limit(limit)


def catalog_listing(catalog: DataFrame) -> DataFrame:
    return catalog.select("id", "canonical", "category", "sheet", "priority", F.size("aliases").cast("long").alias("aliases_count"))


def catalog_size() -> int:
    return len(positions())


def blacklist_listing(blacklist: DataFrame) -> DataFrame:
    """Newest first."""
    return blacklist.orderBy(F.desc("added_at"), "entry_value")


def first_contacts(contacts: DataFrame, order: str = "ord", limit: int = 500) -> DataFrame:
    """What a page of contacts shows."""
    return contacts.orderBy(order).limit(limit)
