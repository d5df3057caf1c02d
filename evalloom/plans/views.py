"""Evaluation-shaped views over the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "eval_items": "select d.doc_id as id, d.lang as subject, d.source as model, d.text, l.quality = 1 as correct from documents d join labels l on d.doc_id = l.doc_id",
    "paired": "select l.doc_id as id, l.quality = 1 as old, l.toxic = 0 as new, d.lang as filter from labels l join documents d on d.doc_id = l.doc_id",
    "mcq": """select p_partkey as id,
        case when p_partkey % 97 = 0 then ' ' else p_name end as question,
        p_brand as A, case when p_partkey % 11 = 0 then '' else p_type end as B,
        concat(p_brand, ' ', p_type) as C, cast(p_size as string) as D,
        case p_size % 9 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' when 4 then 'C.' when 5 then 'X' when 6 then '' when 7 then 'a' else 'D' end as answer
        from part""",
    "responses": """select l_orderkey * 10 + l_linenumber as id, l_returnflag as flag,
        case when l_returnflag = 'A' then concat('We get ', cast(cast(l_quantity as int) as string), ' and so #### ', cast(cast(l_quantity as int) as string))
             when l_returnflag = 'N' then concat('The total is $', cast(cast(l_quantity as int) * 1000 as string), '. Or ', cast(l_linenumber as string), '.')
             else 'No idea ..' end as response,
        concat('Step 1 ', cast(l_linenumber as string), ' #### ', cast(cast(l_quantity as int) as string)) as target
        from lineitem""",
    "answers": """select e.event_id as id, e.event_type as task, cast(e.user_id % 5 + 1 as int) as seed, e.value as value,
        e.value > 50 as ok, e.user_id as user_id, e.props as props, e.ts as ts from events e""",
    "seed_scores": """select task, 'acc' as metric, lim.n as limit_n, seed, avg(cast(ok as int)) as value, count(*) as items
        from (select event_id as id, event_type as task, cast(user_id % 5 + 1 as int) as seed, value > 50 as ok from events) a
        join (select 500 as n union all select 2000 as n union all select 1000000 as n) lim on a.id <= lim.n
        group by task, lim.n, seed""",
    "choices_scored": """select l_orderkey * 10 + l_linenumber as id, l_linenumber % 3 as gold,
        -cast(floor(l_quantity) % 7 as double) as s0, -cast(floor(l_discount * 100) % 7 as double) as s1, -cast(floor(l_tax * 100) % 7 as double) as s2 from lineitem""",
    "sheet": "select doc_id, case when doc_id % 3 = 0 then 'logic' else '' end as category, case when doc_id % 4 = 0 then 'seen' else ' ' end as note from labels",
    "run_configs": """select o_orderkey as run_id, case when o_custkey % 10 = 0 then 'other' else 'base' end as model, case when o_orderkey % 11 = 0 then 'float32' else 'bfloat16' end as dtype,
        cast(case when o_orderkey % 3 = 0 then 4 else 3 end as int) as item_limit, 'cuda' as device, case when o_orderkey % 13 = 0 then null else '8' end as batch_size, cast(1 as int) as random_seed,
        cast(case when o_orderkey % 17 = 0 then 2 else 1 end as int) as numpy_seed, cast(1 as int) as torch_seed, cast(1 as int) as fewshot_seed, cast(0 as int) as num_fewshot, '0.4' as version,
        cast(case when o_orderkey % 19 = 0 then 0 else 1 end as int) as log_version, o_orderstatus as state from orders""",
    "run_lines": "select l_orderkey as run_id from lineitem",
    "asked": "select item_id as id, text as question, cast(item_id as string) as gold, 'base' as model, 'http://localhost/v1' as url, 'greedy' as options from benchmark",
    "given": """select item_id as id, case when item_id % 7 = 0 then concat(text, ' ') else text end as question, case when item_id % 5 = 0 then null else cast(item_id as string) end as gold,
        case when item_id % 35 = 0 then 'other' else 'base' end as model, 'http://localhost/v1' as url, case when item_id % 11 = 0 then 'n=2' else 'greedy' end as options from benchmark where item_id % 3 <> 0""",
    "old_prompts": "select item_id, concat('Question: ', text, ' Answer:') as prompt from benchmark",
    "new_prompts": "select item_id, concat('Problem: ', case when item_id % 7 = 0 then lower(text) else text end, case when item_id % 9 = 0 then ' Reply:' else ' Answer:' end) as prompt from benchmark",
    "new_labels": "select doc_id, case when quality = 1 then 'logic' else 'format' end as new_category, concat('toxic ', cast(toxic as string)) as new_note from labels",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_views(*names: str) -> str:
    """The beginning of a DuckDB query over these views."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names) + " "
