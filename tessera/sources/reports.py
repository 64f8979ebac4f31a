"""Reports: small results as Markdown and JSON, and what makes a run repeatable."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def cell(value) -> str:
    if value is None:
        return ""
    return f"{value:.3f}" if isinstance(value, float) else str(value).replace("|", "\\|")


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a table; raises beyond ``most`` rows."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has {most} rows at most")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in got]) + "\n"


def report(spark: SparkSession, title: str, sections: dict[str, DataFrame], path: str, generated: str = "") -> str:
    """title, date and sections as ``path``.md and, with the session's settings, as ``path``.json; gives the Markdown."""
    text = f"# {title}\n\n" + (f"Generated {generated}\n\n" if generated else "") + "\n".join(f"## {name}\n\n{markdown(rows)}" for name, rows in sections.items())
    told = {"title": title, "generated": generated, "settings": settings(spark)}
    told["sections"] = {name: [json.loads(x) for x in rows.toJSON().collect()] for name, rows in sections.items()}
    for ending, body in ((".md", text), (".json", json.dumps(told, indent=2, sort_keys=True, ensure_ascii=False))):
        where = spark._jvm.org.apache.hadoop.fs.Path(path + ending)
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(body.encode()))
        out.close()
    return text


def settings(spark: SparkSession) -> dict[str, str]:
    """What a result may depend on: Spark's version and the session's SQL settings."""
    names = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled", "spark.sql.caseSensitive")
    return {"spark": spark.version} | {name: spark.conf.get(name) for name in names}
