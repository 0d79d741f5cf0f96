"""Where results go: JSON lines, a report in Markdown, scalars by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, limit: int | None = None, order: list[str] | None = None) -> None:
    """JSON lines; with ``limit`` the first rows in an order, for a look at the data."""
    if limit is not None:
        df = df.orderBy(*(order or df.columns)).limit(limit)
    df.write.mode("overwrite").json(path)


def scalars(metrics: DataFrame, step: int = 0, by: str = "dataset") -> DataFrame:
    """(tag, step, value): each number of each data set under ``dataset/metric``."""
    numeric = [c for c, t in metrics.dtypes if t in ("int", "bigint", "double", "float") and c != by]
    long = metrics.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in numeric])).alias("x"))
    return long.select(F.concat_ws("/", F.coalesce(F.col(by), F.lit("_GLOBAL")), F.col("x.m")).alias("tag"), F.lit(step).alias("step"), F.col("x.v").alias("value"))


def markdown(metrics: DataFrame, title: str, by: str = "dataset") -> str:
    """A table of one row for each data set, which are few."""
    rows = metrics.orderBy(F.col(by).asc_nulls_last()).collect()
    head = f"# {title}\n\n| {' | '.join(metrics.columns)} |\n|{'---|' * len(metrics.columns)}\n"
    show = lambda v: "_GLOBAL" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return head + "".join(f"| {' | '.join(show(v) for v in r)} |\n" for r in rows)


def metrics_json(metrics: DataFrame, by: str = "dataset") -> str:
    """One JSON object: each data set's numbers, the overall ones under ``_GLOBAL``."""
    import json

    return json.dumps({r[by] if r[by] is not None else "_GLOBAL": {k: v for k, v in r.asDict().items() if k != by} for r in metrics.collect()}, sort_keys=True)


def response(df: DataFrame, *columns: str, error: str | None = None, key: str | None = None) -> DataFrame:
    """([key,] status, body): each row as a JSON answer; 400 where ``error`` says why there is none."""
    bad = F.col(error).isNotNull() if error else F.lit(False)
    failed = F.to_json(F.struct(F.col(error).alias("error"))) if error else F.lit(None).cast("string")
    body = F.when(bad, failed).otherwise(F.to_json(F.struct(*columns)))
    return df.select(*([key] if key else []), F.when(bad, 400).otherwise(200).alias("status"), body.alias("body"))
