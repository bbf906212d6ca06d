"""A relation of contacts derived from the driver's tables, by SQL that Spark and DuckDB both run.

The tables hold no job titles or Russian names, so inline values are dealt out over the rows of ``customer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TITLES = [
    "Генеральный директор", "директор", "Главный бухгалтер", "заместитель главного бухгалтера", "Финансовый директор", "Технического директора", "главный инженер проекта", "Менеджер по продажам",
    "Региональный директор по продажам", "президент", "начальник отдела", "коммерческий директор", "гендиректор", "Помощник генерального директора", "старшего бухгалтера", "Ведущий эколог",
    "", "Chief Financial Officer", "И.о. технического директора", "Директор по развитию",
]
NAMES = [
    "Иванов Иван Иванович", "Анна Петрова", "Сидоров П.П.", "Our Team", "", "Олег Петрович Кузнецов", "Смирнова Мария Ивановна", "Page Down", "Орлов", "белый никита", "А.Б. Седов",
    "Главный Инженер", "Римский-Корсаков Лев", "Anna Smith", "Иванова Ольга (отпуск)", "Один Два Три Четыре", "Read more",
]


def cases(column: str, values: list[str]) -> str:
    return f"CASE CAST({column} % {len(values)} AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


CONTACTS = f"""
SELECT c_custkey AS ord, CASE CAST(c_nationkey % 3 AS INT) WHEN 0 THEN 'ta' WHEN 1 THEN 'tb' ELSE 'tc' END AS task_id, CAST(c_nationkey AS BIGINT) AS site_id,
  concat('s', CAST(c_nationkey AS VARCHAR(9)), '.example.ru') AS domain, concat('https://www.s', CAST(c_nationkey AS VARCHAR(9)), '.example.ru/team') AS page_url,
  CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE concat('ООО «Фирма ', CAST(c_nationkey AS VARCHAR(9)), '»') END AS company_name,
  CASE WHEN c_nationkey % 4 = 0 THEN concat('info@s', CAST(c_nationkey AS VARCHAR(9)), '.example.ru') ELSE '' END AS company_email,
  CASE WHEN c_nationkey % 6 = 0 THEN '+7 (495) 123-45-67' ELSE '' END AS company_phone,
  {cases("c_custkey", NAMES)} AS full_name, {cases("c_custkey", TITLES)} AS position_raw,
  CASE WHEN c_custkey % 3 = 0 THEN concat('p', CAST(c_custkey % 40 AS VARCHAR(9)), '@example.ru') ELSE '' END AS person_email,
  CASE WHEN c_custkey % 7 = 0 THEN '+7 (812) 555-00-11' ELSE '' END AS person_phone,
  CASE WHEN c_nationkey % 2 = 0 THEN '7701234567' ELSE '' END AS inn, CASE WHEN c_nationkey % 3 = 0 THEN '770101001' ELSE '' END AS kpp,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Имя' END AS first_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Фамилия' END AS last_name, '' AS patronymic,
  {cases("c_custkey", ["Генеральный директор", "", "Бухгалтер"])} AS position_canonical,
  {cases("c_custkey", ["Генеральные директора", "Остальные", "Главные инженеры", "Прочее", "", "Остальные", "Финансовые директора"])} AS sheet_name,
  {cases("c_custkey", ["exact", "morph", "fallback", "", "empty", "exact", "other"])} AS norm_method,
  {cases("c_custkey", ["ok", "ok", "partial"])} AS status, {cases("c_custkey", ["", "Должность без ФИО"])} AS comment
FROM customer
"""
SITES = """
SELECT concat('t', CAST(user_id % 5 AS VARCHAR(9))) AS task_id, concat('https://u', CAST(event_id AS VARCHAR(9)), '.example.ru') AS url,
  CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'pending' ELSE 'processing' END AS status,
  event_id % 7 AS contacts_count, CASE WHEN event_type = 'error' THEN 'fetch_failed' END AS error_code, CASE WHEN event_type = 'error' THEN props END AS error_message
FROM events
"""
TASKS = "SELECT concat('o', CAST(o_orderkey AS VARCHAR(12))) AS task_id, o_orderstatus AS status, o_orderdate AS created_at, o_custkey AS total_urls FROM orders"


def relation(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, CONTACTS, "customer")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, SITES, "events")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, TASKS, "orders")
