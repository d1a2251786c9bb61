"""Report files: titled tables as text, with a format line for each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed formats of the columns that the report's tables hold; other fractions are written with two places.
_PLACES = {"EmpiricalQuality": 4, "EstimatedQReported": 4, "Errors": 2}
_TYPES = {"d": T.LongType(), "f": T.DoubleType(), "s": T.StringType()}
_DESCRIPTIONS = {"Arguments": "Recalibration argument collection values used in this run", "Quantized": "Quality quantization map"}
_HEAD = "#:GATKReport.v1.1:"


@dataclass
class ReportTable:
    """One table: small, as reports are, and held as rows."""

    title: str
    description: str
    columns: list[str]
    formats: list[str]
    rows: list[tuple]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rows as a DataFrame typed by the formats; a format of no known kind stays text."""
        fields = [T.StructField(c, _TYPES.get(f[-1], T.StringType())) for c, f in zip(self.columns, self.formats, strict=True)]
        return spark.createDataFrame(self.rows, T.StructType(fields))

    def text(self) -> str:
        cells = [[str(v) if f == "%s" else f % v for v, f in zip(row, self.formats, strict=True)] for row in self.rows]
        widths = [max(map(len, column)) for column in zip(self.columns, *cells, strict=True)]
        pad = lambda v, w, left: v.ljust(w) if left else v.rjust(w)
        lines = ["  ".join(c.ljust(w) for c, w in zip(self.columns, widths, strict=True))]
        lines += ["  ".join(pad(v, w, f == "%s") for v, w, f in zip(row, widths, self.formats, strict=True)) for row in cells]
        head = f"#:GATKTable:{len(self.columns)}:{len(self.rows)}:{':'.join(self.formats)}:;"
        return "\n".join([head, f"#:GATKTable:{self.title}:{self.description}", *lines])


def parse_table(text: str) -> ReportTable:
    """Cells are parted by any white space; the counts in the format line are not checked."""
    head, title, columns, *rows = text.splitlines()
    names, formats = columns.split(), head.split(":")[4:-1]
    own = {"d": int, "f": float}
    read = [own.get(f[-1], str) for f in formats]
    return ReportTable(*title.split(":")[2:4], names, formats, [tuple(r(v) for r, v in zip(read, row.split(), strict=True)) for row in rows])


def parse_report(text: str) -> list[ReportTable]:
    """All tables of a report; fewer or more than its first line says fail."""
    head, _, body = text.partition("\n")
    tables = [parse_table(t) for t in body.strip("\n").split("\n\n") if t.strip()]
    if not head.startswith("#:GATKReport.") or int(head.rsplit(":", 1)[1]) != len(tables):
        raise ValueError(f"report does not hold what it says: {head}")
    return tables


def format_report(tables: list[ReportTable]) -> str:
    return "\n".join([f"{_HEAD}{len(tables)}", "\n\n".join(t.text() for t in tables)]) + "\n\n"


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A report's tables by title. A report is read whole: its size is bounded by its format."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    return {t.title: t.frame(spark) for t in parse_report(row["value"])}


def collect_report(tables: dict[str, DataFrame]) -> list[ReportTable]:
    """Tables of a model, ready to be written. CovariateValue is written before CovariateName."""
    out = []
    for title, df in tables.items():
        formats = ["%s" if f.dataType == T.StringType() else f"%.{_PLACES.get(f.name, 2)}f" if f.dataType == T.DoubleType() else "%d" for f in df.schema]
        out.append(ReportTable(title, _DESCRIPTIONS.get(title, ""), df.columns, formats, [tuple(r) for r in df.collect()]))
    return out
