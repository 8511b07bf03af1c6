"""Writers of reports and of the escalation feed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tocsin.operators.reports import escalations, report_json
from tocsin.session import ship
from tocsin.sources.ranges import system_of


def write_reports(reports: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Nested columns in a columnar or JSON format."""
    writer = reports.write.mode("overwrite")
    if file_format == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(file_format).save(path)


def write_report_texts(reports: DataFrame, path: str) -> None:
    """One JSON text per line."""
    report_json(reports).select("report").write.mode("overwrite").text(path)


def write_escalations(reports: DataFrame, path: str) -> None:
    escalations(reports).write.mode("overwrite").json(path)


def write_text_files(files: DataFrame, path: str, extension: str) -> None:
    """A file below ``path`` for every row (name, text); the tasks write them, and a repeated task replaces its files."""
    ship(files.sparkSession)
    system, place = system_of(path)
    system.create_dir(place)

    def run(batches):
        system, place = system_of(path)
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                with system.open_output_stream(f"{place}/{name}{extension}") as file:
                    file.write(text.encode())
            yield batch[["name"]]

    files.select("name", "text").mapInPandas(run, "name string").count()
