"""Readers with explicit schemas. Every path is opened by Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of evaluation logs and results.
SAMPLES = "id bigint, question string, gold string"
API_RESULTS = "id bigint, question string, answer string, model string, url string, request_options struct<thinking:struct<type:string>,max_tokens:int,temperature:double>, response_model string, system_fingerprint string, finish_reason string, usage map<string,bigint>, gold string, exact_match int"
API_FAILURES = "id bigint, question string, gold string, model string, url string, request_options string, error_type string, status_code int, error string"
ITEM_LOGS = "doc_id bigint, filter string, doc struct<question:string,answer:string,subject:string>, target string, resps array<array<string>>, filtered_resps array<string>, exact_match double, acc double, arguments struct<gen_args_0:struct<arg_0:string>>"
LEDGER = "run_id string, timestamp string, model string, revision string, revision_resolved string, tasks array<string>, num_fewshot int, seed int, seeds map<string,int>, `limit` int, batch_size string, dtype string, apply_chat_template boolean, result_file string, command string, notes string, env map<string,string>, env_from_result_file array<string>, probed boolean"
REVIEW_SHEET = "doc_id string, question string, gold_final_answer string, model_extracted_answer string, model_full_response string, reference_solution string, error_category_fill_in string, evidence_note_fill_in string"
LABELS = "labels map<string,struct<category:string,note:string>>"
RUN_RESULTS = "config struct<model:string,model_args:map<string,string>,limit:int,device:string,batch_size:string,random_seed:int,numpy_seed:int,torch_seed:int,fewshot_seed:int>, results map<string,map<string,string>>, `n-samples` map<string,struct<effective:int>>, `n-shot` map<string,int>, lm_eval_version string, date double, git_hash string, transformers_version string"


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line. A byte-order mark and blank lines are skipped. A bad line fails the read when
    strict, naming file and text; otherwise it is dropped. A missing path is an empty table."""
    kind = spark.createDataFrame([], schema).schema
    try:
        lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    except Exception as e:  # Spark names the condition
        if getattr(e, "getCondition", lambda: "")() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], kind)
        raise
    lines = lines.where(F.trim("line") != "")
    wide = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    rows = lines.select("line", "file", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    bad = F.col("row._bad").isNotNull() | ~F.trim("line").startswith("{")
    if strict:
        message = F.concat(F.lit("bad line in "), F.col("file"), F.lit(": "), F.left(F.col("line"), F.lit(200)))
        checked = F.when(bad, F.raise_error(message).cast(kind)).otherwise(F.struct(*[F.col("row").getField(f.name).alias(f.name) for f in kind.fields]))
        return rows.select(checked.alias("row")).select("row.*")
    return rows.where(~bad).select(*[F.col("row").getField(f.name).alias(f.name) for f in kind.fields])


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and line of what a tolerant read drops."""
    wide = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("file")).where(F.trim("line") != "")
    return lines.where(F.from_json("line", wide, {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull() | ~F.trim("line").startswith("{"))


def samples(spark: SparkSession, path: str | None, count: int = 4) -> DataFrame:
    """The first `count` samples by id, or synthetic ones; repeated ids, blank questions and an empty
    file are errors."""
    if path is None:
        return spark.range(1, count + 1).select("id", F.format_string("question %d", "id").alias("question"), F.lit(None).cast("string").alias("gold"))
    rows = jsonl(spark, path, SAMPLES).orderBy("id").limit(count)
    n, distinct, good = rows.agg(F.count("*"), F.countDistinct("id"), F.count_if((F.trim("question") != "") & F.col("id").isNotNull())).first()
    if not n:
        raise ValueError(f"{path} has no samples")
    if distinct < n or good < n:
        raise ValueError(f"{path} has repeated ids or blank questions")
    return rows


def completed(spark: SparkSession, path: str) -> DataFrame:
    """Finished results; a repeated id is an error."""
    rows = jsonl(spark, path, API_RESULTS)
    if not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{path} has repeated ids")
    return rows


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The run ledger; corrupt lines are dropped (bad_lines() lists them)."""
    return jsonl(spark, path, LEDGER, strict=False)


def run_results(spark: SparkSession, root: str) -> DataFrame:
    """Facts (task, limit, metric, seed, value, stderr, model, path) of all results_*.json under root.
    Task, seed and limit come from the path .../task/seed<N>_limit<M>/...; accuracy may be named
    acc,none or acc. What isn't a number is null."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "results_*.json").option("wholetext", True).text(root)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", RUN_RESULTS).alias("r"))
    place = r"/([^/]+)/seed(\d+)_limit(\d+)/"
    rows = rows.select("path", F.regexp_extract("path", place, 1).alias("task"), F.regexp_extract("path", place, 2).try_cast("int").alias("seed"), F.regexp_extract("path", place, 3).try_cast("int").alias("limit"), F.col("r.config.model").alias("model"), F.col("r.config.limit").alias("config_limit"), F.explode("r.results").alias("result_task", "metrics"))
    rows = rows.where(F.col("seed").isNotNull()).select("*", F.explode("metrics").alias("name", "raw")).where(~F.col("name").contains("_stderr") & (F.col("name") != "alias"))
    base, tail = F.substring_index("name", ",", 1), F.regexp_extract("name", "(,.*)$", 1)
    error = F.coalesce(F.try_element_at("metrics", F.concat(base, F.lit("_stderr"), tail)), F.try_element_at("metrics", F.concat(base, F.lit("_stderr"))))
    return rows.select("task", "limit", base.alias("metric"), "seed", F.col("raw").try_cast("double").alias("value"), error.try_cast("double").alias("stderr"), "model", (F.col("config_limit") == F.col("limit")).alias("consistent"), "path")


def probe(spark: SparkSession, path: str) -> DataFrame:
    """What a result file says of its run; null where it says nothing, and for a broken file."""
    files = spark.read.option("wholetext", True).text(path)
    r = F.from_json("value", RUN_RESULTS)
    return files.select(F.col("_metadata.file_path").alias("result_file"), r.alias("r")).select(
        "result_file",
        F.col("r.config.model").alias("model"),
        F.array_sort(F.map_keys("r.results")).alias("tasks"),
        F.col("r.config.limit").alias("limit"),
        F.col("r.config.batch_size").alias("batch_size"),
        F.col("r.config.random_seed").alias("seed"),
        F.date_format(F.timestamp_seconds("r.date"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("r.git_hash").alias("git_hash"),
    )


def item_log(spark: SparkSession, path: str, filter_name: str | None = None) -> DataFrame:
    """Per-item log rows, of one filter if named."""
    rows = jsonl(spark, path, ITEM_LOGS)
    return rows.where(F.col("filter") == filter_name) if filter_name else rows


def few_shot_questions(log: DataFrame) -> DataFrame:
    """ref_id, question: distinct few-shot questions of the prompts, all but the last of each; the first
    spelling of equal words stands, numbered in the order first seen."""
    from pyspark.sql import Window

    from ..functions import text

    found = text.questions(F.col("arguments.gen_args_0.arg_0"))
    rows = log.select("doc_id", F.posexplode(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))).alias("place", "question"))
    rows = rows.withColumn("key", F.array_join(text.words(F.col("question")), " "))
    first = rows.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "place"))).where("turn = 1")
    return first.select(F.row_number().over(Window.orderBy("doc_id", "place")).cast("bigint").alias("ref_id"), "question")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headed CSV whose cells may hold line feeds; a byte-order mark before the header is no matter."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=True)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, category, note from an object of labels by document."""
    files = spark.read.option("wholetext", True).text(path)
    rows = files.select(F.explode(F.from_json("value", LABELS)["labels"]).alias("doc_id", "label"))
    return rows.select("doc_id", "label.category", "label.note")


def kept_section(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """section: what a report holds from the marker on; null without it."""
    files = spark.read.option("wholetext", True).text(path)
    at = F.instr("value", marker)
    return files.select(F.when(at > 0, F.substring("value", at, F.length("value"))).alias("section"))


def environment(spark: SparkSession, packages: tuple[str, ...] = ("pyspark", "numpy", "pandas")) -> DataFrame:
    """One row: versions of Python and packages on the driver."""
    import platform
    from importlib import metadata

    def version(name: str):
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    row = (platform.python_version(), platform.system(), {p: version(p) for p in packages})
    return spark.createDataFrame([row], "python string, system string, packages map<string,string>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
