"""Tables of tasks, sites, contacts and the blacklist on parquet, and the workbook."""

from __future__ import annotations

import zipfile
from datetime import UTC, datetime
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from dramatis.plans import reports

STATUS_FILLS = {"partial": "FEF3C7", "error": "FEE2E2"}
BLACKLIST_KINDS = ["position", "fio", "email", "domain"]


def append_contacts(contacts: DataFrame, path: str) -> None:
    """Contacts by task; a task that is written again replaces its own rows only."""
    contacts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)


def read_contacts(spark: SparkSession, path: str, task_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if task_id is None else rows.where(F.col("task_id") == task_id)


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with those of ``rows`` whose keys it does not have, each once."""
    return existing.unionByName(rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def updated(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the columns of ``changes`` replaced where the keys meet, and ``updated_at`` set there."""
    new = [c for c in changes.columns if c not in keys]
    joined = existing.join(changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in new], F.lit(True).alias("__hit")), keys, "left")
    value = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in new}
    if "updated_at" in existing.columns:
        value["updated_at"] = F.when(F.col("__hit"), F.current_timestamp()).otherwise(F.col("updated_at"))
    return joined.select(*[value.get(c, F.col(c)).alias(c) for c in existing.columns])


def delete_task(spark: SparkSession, paths: list[str], task_id: str) -> None:
    """Drop the partition of a task from each of its tables."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path, f"task_id={task_id}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def without_blacklisted(contacts: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Contacts none of whose fields is listed: an option, off unless called."""
    kinds = {"position": "position_canonical", "fio": "full_name", "email": "person_email", "domain": "domain"}
    for kind, column in kinds.items():
        listed = blacklist.where(F.col("entry_type") == kind).select(F.lower(F.trim("entry_value")).alias("__listed")).distinct()
        contacts = contacts.join(listed, F.lower(F.trim(F.col(column))) == F.col("__listed"), "left_anti")
    return contacts


# The workbook, in the parts of its public file format.
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId{0}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{1}" Target="{2}"/>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_STYLES = f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/></font></fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{{}}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fillId="3" applyFill="1"/><xf fillId="4" applyFill="1"/></cellXfs></styleSheet>'
_FILL = '<fill><patternFill patternType="solid"><fgColor rgb="FF{}"/></patternFill></fill>'


def _letters(k: int) -> str:
    return (_letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def _cell(row: int, k: int, value: object, style: int) -> str:
    at = f'r="{_letters(k)}{row}"' + (f' s="{style}"' if style else "")
    if isinstance(value, int):
        return f"<c {at}><v>{value}</v></c>"
    text = "".join(c for c in str(value or "") if c in "\t\n\r" or ord(c) >= 32)
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(rows, widths: list[int], styles=lambda k, row: 0, frozen: bool = False):
    """The parts of a sheet, row by row."""
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' if frozen else ""
    cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
    yield f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}">{view}<cols>{cols}</cols><sheetData>'
    for k, row in enumerate(rows, 1):
        style = styles(k, row)
        yield f'<row r="{k}">' + "".join(_cell(k, c, v, style) for c, v in enumerate(row)) + "</row>"
    yield "</sheetData></worksheet>"


def write_workbook(contacts: DataFrame, path: str, task: dict | None = None, errors: DataFrame | None = None, order: str = "ord") -> str:
    """The workbook of a task: five sheets of roles, all contacts, summary, quality report. Rows stream to the file; at scale the relations themselves are the sink."""
    today = datetime.now(UTC).strftime("%Y-%m-%d")
    head, widths = [h for h, _ in reports.HEADERS], [w for _, w in reports.HEADERS]

    def people(df: DataFrame):
        yield head
        for row in reports.contact_rows(df, order, today).toLocalIterator():
            yield list(row)

    def style(k: int, row: list) -> int:
        return 1 if k == 1 else {"partial": 2, "error": 3}.get(row[-2], 0)

    def quality():
        yield reports.QUALITY_HEADERS
        for row in reports.quality_report(contacts, order).toLocalIterator():
            yield list(row)[1:]
        found = errors.collect() if errors is not None else []
        if found:
            yield from ([], ["Ошибки сайтов:"], ["URL", "Ошибка", "Сообщение"])
            yield from (list(r) for r in found)

    sheets = [(name, _sheet(people(reports.bucket(contacts, name)), widths, style, True)) for name in reports.SHEETS]
    sheets.append(("Все контакты", _sheet(people(contacts), widths, style, True)))
    sheets.append(("Сводка", _sheet(([r.label, r.value] for r in reports.summary(contacts, task or {}).orderBy("pos").collect()), [38, 14])))
    sheets.append(("Отчёт качества", _sheet(quality(), [30, 22, 34, 30, 14, 30], lambda k, row: int(k == 1))))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        numbers = range(1, len(sheets) + 1)
        out.writestr("[Content_Types].xml", _TYPES.format("".join(map(_SHEET_TYPE.format, numbers))))
        out.writestr("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml")))
        out.writestr("xl/_rels/workbook.xml.rels", _RELS.format("".join(_REL.format(k, "worksheet", f"worksheets/sheet{k}.xml") for k in numbers) + _REL.format(len(sheets) + 1, "styles", "styles.xml")))
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1))
        out.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        out.writestr("xl/styles.xml", _STYLES.format("".join(map(_FILL.format, ["1F4E79", *STATUS_FILLS.values()]))))
        for k, (_, parts) in zip(numbers, sheets, strict=True):
            with out.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                for part in parts:
                    f.write(part.encode("utf-8"))
    return path
