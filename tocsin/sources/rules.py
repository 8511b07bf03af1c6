"""The rule table: read it, check it, turn it into rules."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tocsin import schemas
from tocsin.operators.governance import ALLOW, DENY, Rules, engine_pattern


def read_rules(spark: SparkSession, path: str, file_format: str = "parquet") -> Rules:
    """Rules from a table with columns kind, command_type, ordinal and pattern.

    A missing path fails in the reader; a table with wrong rows or patterns is
    refused.  Rules become expressions, so the driver reads the table whole.  A kind without rows is an empty section.
    """
    table = spark.read.format(file_format).schema(schemas.RULE).load(path)
    return rules_from(table)


def rules_from(table: DataFrame) -> Rules:
    rows = table.select(*schemas.RULE.names).collect()
    deny, allow = [], {}
    for row in sorted(rows, key=lambda r: (r.ordinal is None, r.ordinal or 0)):
        if row.pattern is None or row.ordinal is None:
            raise ValueError(f"rule without pattern or ordinal: {row}")
        if row.kind == DENY:
            try:
                re.compile(row.pattern, re.IGNORECASE)
            except re.error as failure:
                raise ValueError(f"deny pattern does not compile: {row.pattern}") from failure
            deny.append(row.pattern)
        elif row.kind == ALLOW and row.command_type is not None:
            allow.setdefault(row.command_type, []).append(row.pattern)
        else:
            raise ValueError(f"rule of unknown kind or without command type: {row}")
    if deny:
        # Python and the engine differ in what they compile; a job must not find out in a task.
        tried = table.sparkSession.createDataFrame([(engine_pattern(p),) for p in deny], "pattern string")
        try:
            tried.filter("'' RLIKE pattern").count()
        except (PySparkException, Py4JJavaError) as failure:
            raise ValueError(f"deny pattern does not compile in the engine: {failure}") from failure
    return Rules(deny=deny, allow=allow)


def write_rules(spark: SparkSession, rules: Rules, path: str, file_format: str = "parquet") -> None:
    rules.table(spark).coalesce(1).write.mode("overwrite").format(file_format).save(path)
