"""Sinks: appended JSON, details, CSV, frozen samples with a manifest, and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; durable when the write commits."""
    df.write.mode("append").json(path)


def split_results(rows: DataFrame, success_path: str, failure_path: str) -> None:
    """Rows without error to one place, the others to another, which must differ. Rows are made once, into
    a folder beside the successes that goes at the end, so no request is sent twice."""
    success, failure = success_path.rstrip("/"), failure_path.rstrip("/")
    if success == failure:
        raise ValueError("successes and failures need different paths")
    spark = rows.sparkSession
    whole = f"{success}-unsplit-{uuid.uuid4().hex}"
    rows.write.parquet(whole)
    made = spark.read.schema(rows.schema).parquet(whole)
    append_jsonl(made.where("error is null").drop("error"), success)
    append_jsonl(made.where("error is not null"), failure)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(whole)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def detail_document(df: DataFrame, path: str) -> None:
    """All columns of each row as one JSON object; for small results."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def two_decimals(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f", c.cast("double")))


def csv(df: DataFrame, path: str, empty: str = "") -> None:
    """Headed CSV; nulls as `empty`."""
    df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(empty)).alias(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, escape='"')


def review_sheet(df: DataFrame, path: str, key: str = "doc_id") -> None:
    """A sheet for manual labels. An existing one with the same ids stays; with others it is an error."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.csv(path, header=True, multiLine=True, escape='"').select(F.col(key).cast("string"))
        own = df.select(F.col(key).cast("string"))
        if not old.exceptAll(own).isEmpty() or not own.exceptAll(old).isEmpty():
            raise ValueError(f"{path} holds a sheet of other ids")
        return
    df.write.csv(path, header=True, escape='"')


def frozen_lines(samples: DataFrame, order: str) -> DataFrame:
    """One row: the samples as JSON lines in order, and their sha256."""
    line = F.to_json(F.struct("*"))
    rows = samples.select(F.col(order).alias("o"), line.alias("line")).agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("rows"))
    content = F.concat(F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit("\n"))
    return rows.select(content.alias("content"), F.sha2(content, 256).alias("sha256"))


def manifest(samples: DataFrame, order: str, seed: int, **facts: str) -> DataFrame:
    """One row that describes frozen samples: indices, counts by subject and gold, digest."""

    def counts(column: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n"))))

    by = {c: samples.groupBy(c).agg(F.count("*").alias("n")).agg(counts(c).alias(f"{c}_counts")) for c in ("subject", "gold")}
    own = samples.agg(F.count("*").alias("count"), F.transform(F.sort_array(F.collect_list(F.struct(order, "dataset_index"))), lambda x: x["dataset_index"]).alias("selected_indices"))
    out = own.join(by["subject"]).join(by["gold"]).join(frozen_lines(samples, order).select(F.col("sha256").alias("input_sha256")))
    return out.select(*[F.lit(v).alias(k) for k, v in facts.items()], F.lit(seed).alias("seed"), "*")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table; more than `most` rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for a table in a report")
    rows = df.limit(most).select(*[text.escaped_cell(text.cell(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns]).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"


def bars(df: DataFrame, label: str, value: str, width: int = 600, most: int = 200) -> str:
    """A small result as horizontal bars in SVG; more than `most` rows are an error."""
    from xml.sax.saxutils import escape

    rows = [(str(r[0]), float(r[1] or 0)) for r in df.select(label, value).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a chart")
    top = max((v for _, v in rows), default=0) or 1
    body = "".join(f'<text x="0" y="{24 * i + 16}">{escape(k)}</text><rect x="200" y="{24 * i + 4}" width="{v / top * (width - 260):.1f}" height="16"/><text x="{205 + v / top * (width - 260):.1f}" y="{24 * i + 16}">{v:g}</text>' for i, (k, v) in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{24 * len(rows) + 8}">{body}</svg>'
