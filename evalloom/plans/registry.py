"""All registered queries by the id of what they compute, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import checks, items, overlap, runs, sharedgrams
from .views import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Pieces of DuckDB SQL.
FOLD = "replace(lower(coalesce({0}, '')), 'ß', 'ss')"
WORDS = r"regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}_]+')"
NORMAL = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'))"
STRICT = r"coalesce(nullif(regexp_extract({0}, '#### (-?[0-9.,]+)', 1), ''), '[invalid]')"
FLEXIBLE = r"coalesce(list_extract(regexp_extract_all({0}, '(-?[$0-9.,]{{2,}})|(-?[0-9]+)'), -1), '[invalid]')"
GOLD = "trim(list_extract(string_split({0}, '####'), -1))"
GRAMS = """{name} as (
  select distinct id, array_to_string(w[i : i + {n} - 1], ' ') as gram from (
    select id, w, unnest(range(1, greatest(len(w) - {n} + 2, 1))) as i from (
      select {id} as id, {words} as w from {table})))"""
MCQ_CHOICES = "list_filter([A, B, C, D], lambda x: trim(coalesce(x, '')) <> '')"
WILSON = "(c / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) {0} 1.96 * sqrt(c / n * (1 - c / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def grams_sql(name: str, n: int, id_col: str, from_table: str) -> str:
    return GRAMS.format(name=name, n=n, id=id_col, words=WORDS.format("text"), table=from_table)


def docs(spark, d):
    return table(spark, d, "documents")


# Scalar functions


@query(f"select doc_id, md5({NORMAL.format('text')}) as normal, length({NORMAL.format('text')})::int as n from documents")
def sc1_normalize(spark, d):
    n = text.normalize(F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(n.cast("binary")).alias("normal"), F.length(n).alias("n"))


@query(f"""with n as (select doc_id, {NORMAL.format('text')} as t from documents)
select doc_id, case when length(t) >= 5 then len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: t[i : i + 4]))) when t <> '' then 1 else 0 end::int as shingles from n""")
def sc2_shingles(spark, d):
    return docs(spark, d).select("doc_id", F.size(text.shingles(F.col("text"))).alias("shingles"))


@query(f"""with n as (select item_id, {NORMAL.format('text')} as t from benchmark),
s as (select item_id, list_distinct(list_transform(range(1, length(t) - 3), lambda i: t[i : i + 4])) as s from n)
select a.item_id as a, b.item_id as b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) as similarity
from s a join s b on b.item_id = a.item_id + 1""")
def sc3_jaccard(spark, d):
    s = table(spark, d, "benchmark").select("item_id", text.shingles(F.col("text")).alias("s"))
    other = s.select(F.col("item_id").alias("b"), F.col("s").alias("z"), (F.col("item_id") - 1).alias("a"))
    return s.join(other, s["item_id"] == other["a"]).select("a", "b", text.jaccard(F.col("s"), F.col("z")).alias("similarity"))


@query(f"select doc_id, len({WORDS.format('text')})::int as n_words, md5(array_to_string({WORDS.format('text')}, ' ')) as words from documents")
def sc4_words(spark, d):
    w = text.words(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(w).alias("n_words"), F.md5(F.array_join(w, " ").cast("binary")).alias("words"))


@query("with " + grams_sql("g", 13, "item_id", "benchmark") + " select b.item_id, count(g.gram)::int as grams from benchmark b left join g on g.id = b.item_id group by 1")
def sc5_grams(spark, d):
    w = table(spark, d, "benchmark").select("item_id", text.words(F.col("text")).alias("w"))
    return w.select("item_id", F.size(text.grams(F.col("w"), 13)).alias("grams"))


@query(with_views("mcq") + f"""select id as item_id, case when trim(question) <> '' then question end as question, {MCQ_CHOICES} as choices, case when trim(answer) <> '' then trim(answer) end as answer from mcq""")
def sc6_sc7_sc8_canonical_items(spark, d):
    return items.canonical(view(spark, d, "mcq"), "id")


@query(with_views("responses") + f"select id, {STRICT.format('response')} as strict, {FLEXIBLE.format('response')} as flexible, {GOLD.format('target')} as gold from responses")
def sc10_sc11_sc12_extract(spark, d):
    r = F.col("response")
    return view(spark, d, "responses").select("id", text.strict_answer(r).alias("strict"), text.flexible_answer(r).alias("flexible"), text.gold_answer(F.col("target")).alias("gold"))


@query(with_views("responses") + r"select id, trim(list_extract(regexp_extract_all(target, '####\s*([^\n]+)', 1), -1)) as final from responses")
def sc13_final_answer(spark, d):
    return view(spark, d, "responses").select("id", text.final_answer(F.col("target")).alias("final"))


@query("""with p as (select conv_id, 'Question: ' || string_agg(coalesce(text, ''), chr(10) || 'Answer:' || chr(10) || 'Question: ' order by turn, role) || chr(10) || 'Answer:' as prompt from conversations group by 1)
select conv_id, len(regexp_extract_all(prompt, '(?ms)^Question: (.*?)\\nAnswer:', 1))::int as n, md5(list_extract(regexp_extract_all(prompt, '(?ms)^Question: (.*?)\\nAnswer:', 1), -1)) as tested from p""".replace("\\\\", "\\"))
def sc14_prompt_questions(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    prompt = F.concat(F.lit("Question: "), F.array_join(F.transform("t", lambda x: x["text"]), "\nAnswer:\nQuestion: "), F.lit("\nAnswer:"))
    q = text.questions(prompt)
    return rows.select("conv_id", F.size(q).alias("n"), F.md5(F.element_at(q, -1).cast("binary")).alias("tested"))


@query(with_views("responses") + f"select id, trim({FLEXIBLE.format('response')}) = trim({GOLD.format('target')}) as exact from responses")
def sc15_exact_match(spark, d):
    return view(spark, d, "responses").select("id", (text.strip(text.flexible_answer(F.col("response"))) == text.strip(text.gold_answer(F.col("target")))).alias("exact"))


@query(with_views("responses") + r"""select id, lower(regexp_replace(regexp_replace(regexp_replace(response, '[,$]', '', 'g'), '(?s).*#### ', '', 'g'), '\.$', '')) as canonical from responses""")
def sc16_canonical_number(spark, d):
    return view(spark, d, "responses").select("id", text.canonical_number(F.col("response")).alias("canonical"))


@query(with_views("mcq") + "select id, regexp_full_match(trim(answer), '[ABCD]') as valid, answer like '%.' as cut from mcq")
def sc17_sc18_answer_predicates(spark, d):
    return view(spark, d, "mcq").select("id", text.valid_letter(F.col("answer")).alias("valid"), F.col("answer").endswith(".").alias("cut"))


@query(with_views("mcq") + "select id, concat(trim(question), chr(10), 'A. ', trim(A), chr(10), 'B. ', trim(B), chr(10), 'C. ', trim(C), chr(10), 'D. ', trim(D), chr(10), 'Answer:') as prompt from mcq")
def sc19_sc20_prompts(spark, d):
    return view(spark, d, "mcq").select("id", text.mcq_prompt(F.col("question"), F.array("A", "B", "C", "D")).alias("prompt"))


@query("select item_id, replace(replace(text, 'the', 'THE'), 'THE', 'the') = text as same from benchmark")
def sc21_prompt_delta(spark, d):
    variant = F.replace(F.col("text"), F.lit("the"), F.lit("THE"))
    return table(spark, d, "benchmark").select("item_id", (F.replace(variant, F.lit("THE"), F.lit("the")) == F.col("text")).alias("same"))


@query(r"""select page_id, list_filter([
  case when contains(html, '　') then 'ideographic space' end, case when regexp_matches(html, '[\x{200b}-\x{200f}\x{feff}]') then 'invisible character' end,
  case when regexp_matches(html, '[ \t]{2,}') then 'repeated blanks' end,
  case when regexp_matches(html, '[Ａ-Ｚａ-ｚ０-９]') and regexp_matches(html, '[A-Za-z0-9]') then 'mixed width' end], lambda x: x is not null) as flags,
  contains(html, 'Õ') or contains(html, chr(65533)) as mojibake from pages""")
def sc22_sc23_encoding_flags(spark, d):
    return table(spark, d, "pages").select("page_id", text.encoding_flags(F.col("html")).alias("flags"), text.mojibake(F.col("html")).alias("mojibake"))


@query("select subject, sum(correct::int)::bigint as correct, count(*) as total, printf('%.1f%%', sum(correct::int) * 100.0 / count(*)) as share from (" + "select d.lang as subject, l.quality = 1 as correct from documents d join labels l on d.doc_id = l.doc_id) group by 1")
def sc24_percent(spark, d):
    rows = view(spark, d, "eval_items").groupBy("subject").agg(F.sum(F.col("correct").cast("bigint")).alias("correct"), F.count("*").alias("total"))
    return rows.withColumn("share", text.percent(F.col("correct"), F.col("total")))


@query(with_views("eval_items") + f"""select subject, {WILSON.format('-')} as low, {WILSON.format('+')} as high, case when n > 1 then sqrt(c / n * (1 - c / n) / (n - 1)) end as stderr
from (select subject, sum(correct::int)::double as c, count(*)::double as n from eval_items group by 1)""")
def sc25_sc26_intervals(spark, d):
    rows = view(spark, d, "eval_items").groupBy("subject").agg(F.sum(F.col("correct").cast("double")).alias("c"), F.count("*").cast("double").alias("n"))
    low, high = numbers.wilson(F.col("c"), F.col("n"))
    return rows.select("subject", low.alias("low"), high.alias("high"), numbers.binomial_stderr(F.col("c") / F.col("n"), F.col("n")).alias("stderr"))


@query("""select doc_id, right(text, 400) as tail, left(text, 120) as head, left(replace(replace(text, '|', '\\|'), chr(10), ' '), 120) as cell,
case when doc_id % 2 = 0 then coalesce(nullif(lang, ''), '-') else '-' end as lang from documents""".replace("\\\\", "\\"))
def sc27_sc28_sc29_cells(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.right(t, F.lit(400)).alias("tail"), F.left(t, F.lit(120)).alias("head"), text.escaped_cell(t).alias("cell"), text.cell(F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("lang"))


@query("select p_partkey, list_transform(string_split(concat(p_brand, ' , ', p_type, ',', p_name), ','), lambda x: trim(x)) as parts, coalesce(nullif(p_brand, 'Brand#1'), p_type, 'none') as chosen from part")
def sc30_sc31_lists(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.split_list(F.concat("p_brand", F.lit(" , "), "p_type", F.lit(","), "p_name")).alias("parts"), F.coalesce(F.nullif("p_brand", F.lit("Brand#1")), "p_type", F.lit("none")).alias("chosen"))


@query("select event_id, strftime(to_timestamp(1700000000 + event_id) at time zone 'UTC', '%Y%m%d-%H%M%S') || '-' || left(md5((1700000000 + event_id)::varchar), 4) as run_id from events")
def sc32_run_ids(spark, d):
    return table(spark, d, "events").select("event_id", text.run_id(F.col("event_id") + 1700000000).alias("run_id"))


@query(r"""select event_id, regexp_extract(p, '^(\w+)/seed(\d+)_limit(\d+)$', 2)::int as seed, regexp_extract(p, '^(\w+)/seed(\d+)_limit(\d+)$', 3)::int as limit_n, regexp_matches(md5(p) || left(md5(p), 8), '^[0-9a-f]{40}$') as commit_like
from (select event_id, concat('arc/seed', (user_id % 5 + 1)::int, '_limit', (event_id % 3 * 100)::int) as p from events)""")
def sc33_sc36_paths(spark, d):
    p = F.concat(F.lit("arc/seed"), (F.col("user_id") % 5 + 1).cast("int").cast("string"), F.lit("_limit"), (F.col("event_id") % 3 * 100).cast("int").cast("string"))
    rows = table(spark, d, "events").select("event_id", p.alias("p"))
    pattern, digest = r"^(\w+)/seed(\d+)_limit(\d+)$", F.md5(F.col("p").cast("binary"))
    return rows.select("event_id", F.regexp_extract("p", pattern, 2).cast("int").alias("seed"), F.regexp_extract("p", pattern, 3).cast("int").alias("limit_n"), text.commit_id(F.concat(digest, F.left(digest, F.lit(8)))).alias("commit_like"))


@query("select event_id, coalesce(case when event_id % 2 = 0 then value end, value / 2) as acc from events")
def sc34_metric_fallback(spark, d):
    m = F.map_filter(F.create_map(F.lit("acc,none"), F.when(F.col("event_id") % 2 == 0, F.col("value")), F.lit("acc"), F.col("value") / 2), lambda k, v: v.isNotNull())
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(m, F.lit("acc,none")), F.try_element_at(m, F.lit("acc"))).alias("acc"))


@query("select doc_id, sha256(text) as sha256 from documents")
def sc35_sha256(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


# Filters and constraints

MCQ_PROBLEMS = """list_filter([case when trim(coalesce(question, '')) = '' then '空题干' end,
  case when trim(coalesce(A, '')) = '' or trim(coalesce(B, '')) = '' or trim(coalesce(C, '')) = '' or trim(coalesce(D, '')) = '' then '缺失或空选项' end,
  case when trim(coalesce(answer, '')) = '' then '空答案' end], lambda x: x is not null)"""


def problems(spark, d):
    return items.problems(view(spark, d, "mcq").withColumn("item_id", F.col("id")))


@query(with_views("eval_items") + "select id, model from eval_items where subject = 'en' and not correct")
def fl1_fl2_wrong_of_filter(spark, d):
    return view(spark, d, "eval_items").where("subject = 'en' and not correct").select("id", "model")


@query(with_views("mcq") + f"select * from (select id as item_id, {MCQ_PROBLEMS} as problems from mcq) where len(problems) > 0")
def fl3_missing_fields(spark, d):
    return problems(spark, d)


VALIDITY = f"""v as (select item_id, answer, case when list_contains(l, answer) then 'valid' when list_contains(l, upper(regexp_replace(answer, '\\.+$', ''))) then 'malformed' else 'out_of_range' end as kind
from (select id as item_id, trim(answer) as answer, string_split('ABCDEF', '')[1 : len({MCQ_CHOICES})] as l from mcq where trim(answer) <> '') where len(l) > 0)"""


@query(with_views("mcq") + ", " + VALIDITY + " select item_id, kind, answer from v")
def fl4_answer_validity(spark, d):
    return items.answer_validity(items.canonical(view(spark, d, "mcq"), "id"))


LENGTHS = """q as (select count(*) as n, sum(length)::double / count(*) as mean, list_sort(list(length)) as v from (select length(text) as length from documents)),
b as (select n, v[1] as least, v[floor(0.01 * n)::int + 1] as p01, v[floor(0.25 * n)::int + 1] as q1, v[floor(0.5 * n)::int + 1] as median, v[floor(0.75 * n)::int + 1] as q3, v[floor(0.99 * n)::int + 1] as p99, v[n] as most, mean from q),
s as (select *, greatest(0.0, q1 - 1.5 * (q3 - q1))::double as low, (q3 + 1.5 * (q3 - q1))::double as high from b)"""


@query("with " + LENGTHS + " select doc_id, length(text) as length, case when length(text) > high then 'long' else 'short' end as kind from documents, s where length(text) > high or (length(text) > 0 and length(text) < low)")
def fl5_length_outliers(spark, d):
    return items.length_outliers(docs(spark, d).select("doc_id", F.length("text").alias("length")), "doc_id")


@query(f"select doc_id from documents where len({WORDS.format('text')}) < 13")
def fl6_too_short(spark, d):
    return docs(spark, d).where(F.size(text.words(F.col("text"))) < 13).select("doc_id")


@query("select o_orderkey from orders join (select l_orderkey, count(*) as n from lineitem group by 1) l on l_orderkey = o_orderkey where o_orderstatus = 'F' and n >= 4")
def fl7_completed_runs(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(lines.where("n >= 4"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")


@query("select user_id, count(*) as n from events group by 1 having count(*) > 1")
def fl8_repeated_keys(spark, d):
    return runs.repeated_keys(table(spark, d, "events"), "user_id")


@query("select source, count(*) as n from documents group by 1 having count(*) <> 50")
def fl9_cardinality(spark, d):
    return runs.violations(docs(spark, d).groupBy("source").agg(F.count("*").alias("n")), F.col("n") != 50)


@query("select s_suppkey from supplier join customer on s_suppkey = c_custkey where s_nationkey is distinct from c_nationkey")
def fl10_config_equality(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return runs.violations(s.join(c, F.col("s_suppkey") == F.col("c_custkey")), ~F.col("s_nationkey").eqNullSafe(F.col("c_nationkey"))).select("s_suppkey")


@query("select lang, count(distinct source) as identities from documents group by 1 having count(distinct source) <> 1")
def fl11_one_identity(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.countDistinct("source").alias("identities")).where("identities <> 1")


@query("with sheet as (select doc_id, case when doc_id % 3 = 0 then 'logic' else '' end as category, case when doc_id % 4 = 0 then 'seen' else ' ' end as note from labels) select doc_id from sheet where category not in ('logic', 'format') or trim(note) = ''")
def fl12_label_enum(spark, d):
    return runs.violations(view(spark, d, "sheet"), ~F.col("category").isin("logic", "format") | (F.trim("note") == "")).select("doc_id")


@query(with_views("responses") + f"select id from responses where {STRICT.format('response')} <> {FLEXIBLE.format('response')}")
def fl13_rederived(spark, d):
    r = F.col("response")
    return runs.violations(view(spark, d, "responses"), text.strict_answer(r) != text.flexible_answer(r)).select("id")


# Joins


def gram_rows(spark, d, name, id_col, n):
    return overlap.gram_rows(table(spark, d, name), id_col, "text", n)


def overlap_sql(n: int, tail: str) -> str:
    return f"with {grams_sql('t', n, 'item_id', 'benchmark')}, {grams_sql('r', n, 'doc_id', 'documents')}, p as (select t.id as test_id, r.id as ref_id, count(*) as shared, min(t.gram) as example from t join r using (gram) group by 1, 2) {tail}"


def cross_pairs(spark, d, n):
    return overlap.overlap_pairs(gram_rows(spark, d, "benchmark", "item_id", n), gram_rows(spark, d, "documents", "doc_id", n))


@query(overlap_sql(13, "select * from p"))
def jn1_overlap_pairs(spark, d):
    return cross_pairs(spark, d, 13)


@query(overlap_sql(8, "select * from p"))
def dc5_overlap_pairs_8(spark, d):
    return cross_pairs(spark, d, 8)


SELF = f"with {grams_sql('g', 13, 'doc_id', 'documents')}, p as (select a.id as test_id, b.id as ref_id, count(*) as shared, min(a.gram) as example from g a join g b on a.gram = b.gram and a.id < b.id group by 1, 2) "


def id_texts(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("t"))


@query(SELF + "select * from p")
def jn2_self_overlap(spark, d):
    rows = id_texts(spark, d)
    return sharedgrams.with_examples(sharedgrams.pairs(rows, 13), rows, 13)


@query(f"""with n as (select doc_id as id, {NORMAL.format('text')} as t from documents),
s as (select id, unnest(list_distinct(case when length(t) >= 5 then list_transform(range(1, length(t) - 3), lambda i: hash(t[i : i + 4])) else [hash(t)] end)) as s from n where t <> ''),
c as (select id, count(*) as n from s group by 1)
select a, b, i / (x.n + y.n - i) as similarity from (select a.id as a, b.id as b, count(*) as i from s a join s b on a.s = b.s and a.id < b.id group by 1, 2)
join c x on x.id = a join c y on y.id = b where i * 100 >= (x.n + y.n - i) * 80""")
def jn3_near_duplicates(spark, d):
    return overlap.near_duplicates(docs(spark, d), "doc_id", "text")


@query(with_views("responses") + f"select id, min({FLEXIBLE.format('response')}) as flexible, min({STRICT.format('response')}) as strict from responses group by 1")
def jn4_filter_pivot(spark, d):
    rows = view(spark, d, "responses")
    both = F.array(F.struct(F.lit("strict-match").alias("filter"), text.strict_answer(F.col("response")).alias("answer")), F.struct(F.lit("flexible-extract").alias("filter"), text.flexible_answer(F.col("response")).alias("answer")))
    return runs.pivoted_filters(rows.select("id", F.explode(both).alias("x")).select("id", "x.*"), "id", "answer")


@query("select doc_id, lang, source from documents join labels using (doc_id) where toxic = 1")
def jn5_paired_join(spark, d):
    return docs(spark, d).join(table(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang", "source")


@query("select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate")
def jn6_jn12_validated_join(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return runs.violations(joined, F.col("l_shipdate") < F.col("o_orderdate")).select("l_orderkey", "l_linenumber")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def jn7_pending(spark, d):
    return runs.pending(docs(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("select array_agg(doc_id order by doc_id) as missing from documents where doc_id not in (select doc_id from labels)")
def jn8_missing_ids(spark, d):
    return runs.pending(docs(spark, d), table(spark, d, "labels"), "doc_id").agg(F.sort_array(F.collect_list("doc_id")).alias("missing"))


@query("select doc_id, source from documents where doc_id in (select doc_id from labels)")
def jn9_scored(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query(with_views("sheet", "new_labels") + "select doc_id, coalesce(nullif(category, ''), new_category) as category, coalesce(nullif(trim(note), ''), new_note) as note, coalesce(nullif(category, '') <> new_category, false) as conflict from sheet join new_labels using (doc_id)")
def jn10_label_merge(spark, d):
    return runs.merged_labels(view(spark, d, "sheet"), view(spark, d, "new_labels"), "doc_id")


@query("select c_custkey, r_name as category from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def jn11_dimension_lookup(spark, d):
    category = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(category, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("category"))


# Aggregations


@query("select min(doc_id) as first_id, count(*) as n, list_sort(list(doc_id)) as ids from documents group by text, lang, source having count(*) > 1")
def ag1_sc9_exact_duplicates(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("item_id"), F.col("text").alias("question"), F.array("lang").alias("choices"), F.col("source").alias("answer"))
    return items.exact_duplicates(rows)


@query(with_views("mcq") + f"select problem, count(*) as n from (select unnest({MCQ_PROBLEMS}) as problem from mcq) group by 1")
def ag2_problem_breakdown(spark, d):
    return items.breakdown(problems(spark, d))


@query(with_views("mcq") + ", " + VALIDITY + """, c as (select answer, count(*) as n from v where kind = 'valid' group by 1), s as (select answer, n, round_even(n * 100.0::double / sum(n) over (), 1) as share, 100.0::double / count(*) over () as expected from c)
select answer, n, share, expected, abs(share - expected) > 5 as suspicious from s""")
def ag3_position_bias(spark, d):
    return items.position_bias(items.canonical(view(spark, d, "mcq"), "id"))


@query("with " + LENGTHS + " select * from s")
def ag4_ag5_length_summary(spark, d):
    return items.length_summary(docs(spark, d).select(F.length("text").alias("length")))


@query(f"with h as (select distinct ref_id as id from ({overlap_sql(13, 'select * from p')})), e as (select d.doc_id as id, l.quality = 1 as correct from documents d join labels l on d.doc_id = l.doc_id) select h.id is not null as hit, sum(correct::int)::bigint as correct, count(*) as total from e left join h on h.id = e.id group by 1")
def ag6_accuracy_by_overlap(spark, d):
    hits = cross_pairs(spark, d, 13).select(F.col("ref_id").alias("id")).distinct()
    return overlap.accuracy_by_hit(view(spark, d, "eval_items").select("id", "correct"), hits)


@query(SELF + f", w as (select doc_id, array_to_string({WORDS.format('text')}, ' ') as w from documents) select test_id, ref_id from p join w a on a.doc_id = test_id join w b on b.doc_id = ref_id where a.w = b.w")
def ag7_equal_overlap_pairs(spark, d):
    return sharedgrams.equal_pairs(id_texts(spark, d), 13)


@query(f"""with k as (select conv_id, turn, role, text, array_to_string({WORDS.format('text')}, ' ') as key from conversations),
f as (select *, row_number() over (partition by key order by conv_id, turn, role) as r from k)
select conv_id, turn, role from f where r = 1""")
def ag8_first_spelling(spark, d):
    rows = table(spark, d, "conversations").withColumn("key", F.array_join(text.words(F.col("text")), " "))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("conv_id", "turn", "role"))
    return rows.withColumn("r", turn).where("r = 1").select("conv_id", "turn", "role")


def facts(spark, d):
    return view(spark, d, "seed_scores").select("task", F.col("limit_n").alias("limit"), "metric", "seed", "value", numbers.binomial_stderr(F.col("value"), F.col("items")).alias("stderr"))


STATS = with_views("seed_scores") + ', f as (select task, limit_n as "limit", metric, seed, value, case when items > 1 then sqrt(value * (1 - value) / (items - 1)) end as stderr from seed_scores), g as (select task, "limit", metric, count(*) as n, avg(value) as mean, stddev_samp(value) as seed_sd, min(value) as least, max(value) as most, avg(stderr) as mean_stderr, max(value) - min(value) as range, list_sort(list(distinct seed)) as seeds from f group by 1, 2, 3) '


@query(STATS + 'select task, "limit", metric, n, round(mean, 9) as mean, round(seed_sd, 9) as seed_sd, least, most, round(mean_stderr, 9) as mean_stderr, range from g where seeds = [1, 2, 3, 4, 5]')
def ag9_ag10_seed_statistics(spark, d):
    out = runs.seed_statistics(facts(spark, d))
    return out.select(*[F.round(c, 9).alias(c) if c in ("mean", "seed_sd", "mean_stderr") else F.col(c) for c in out.columns])


@query(with_views("seed_scores") + 'select task, limit_n as "limit", metric, seed, value from seed_scores')
def ag11_collapsed_runs(spark, d):
    f = facts(spark, d)
    return runs.collapsed(f.union(f)).select("task", "limit", "metric", "seed", "value")


@query("select lang, count(*) as n, min(doc_id) as first_seen from documents group by 1")
def ag12_subject_mix(spark, d):
    return runs.in_first_seen_order(docs(spark, d), "lang", "doc_id")


@query(with_views("responses") + f""", x as (select {STRICT.format('response')} as s, {FLEXIBLE.format('response')} as f, {GOLD.format('target')} as g from responses)
select count(*) as total, count_if(s = '[invalid]') as strict_failed, count_if(f = '[invalid]') as flexible_failed, count_if(s = g) as strict_correct, count_if(f = g) as flexible_correct, (count_if(f = g) - count_if(s = g)) * 100.0::double / count(*) as delta_pp, count_if(s <> f) as differ from x""")
def ag13_extraction_audit(spark, d):
    r = F.col("response")
    x = view(spark, d, "responses").select(text.strict_answer(r).alias("s"), text.flexible_answer(r).alias("f"), text.gold_answer(F.col("target")).alias("g"))
    right = lambda c: F.count_if(F.col(c) == F.col("g"))
    return x.agg(
        F.count("*").alias("total"), F.count_if(F.col("s") == text.INVALID).alias("strict_failed"), F.count_if(F.col("f") == text.INVALID).alias("flexible_failed"),
        right("s").alias("strict_correct"), right("f").alias("flexible_correct"), ((right("f") - right("s")) * F.lit(100.0) / F.count("*")).alias("delta_pp"), F.count_if(F.col("s") != F.col("f")).alias("differ"),
    )


TRANSITIONS = """t as (select filter, count_if(not old and new) as improved, count_if(old and not new) as worsened, count_if(old and new) as both_correct, count_if(not old and not new) as both_wrong, count(*) as total,
 coalesce(list_sort(list(id) filter (not old and new)), []) as improved_ids, coalesce(list_sort(list(id) filter (old and not new)), []) as worsened_ids from paired group by 1)"""


@query(with_views("paired") + ", " + TRANSITIONS + " select *, (improved - worsened) * 100.0::double / total as delta_pp from t")
def ag14_dc2_transitions(spark, d):
    return runs.transitions(view(spark, d, "paired"), "filter").drop("p")


@query(with_views("paired") + ", " + TRANSITIONS + """, n as (select filter, (improved + worsened)::bigint as n, least(improved, worsened)::bigint as k from t)
select filter, case when n = 0 then 1.0::double else round(least(1.0::double, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::double))))), 6) end as p from n""")
def dc1_paired_test(spark, d):
    return runs.transitions(view(spark, d, "paired"), "filter").select("filter", F.round("p", 6).alias("p"))


@query("select count(*) as samples, count(quality) as scored, case when count(*) = count(quality) then avg(quality) end::double as accuracy from documents left join labels using (doc_id)")
def ag15_complete_accuracy(spark, d):
    return runs.complete_accuracy(docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("select 'k' as field, sum((props::json->>'k')::bigint)::bigint as total from events where (props::json->>'k') is not null having count(*) > 0")
def ag16_usage_totals(spark, d):
    return runs.usage_totals(table(spark, d, "events").select(F.from_json("props", "map<string,bigint>").alias("usage")), "usage")


@query("select lang, list_sort(list(distinct source)) as sources from documents group by 1")
def ag17_distinct_lists(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query(with_views("eval_items") + """, m as (select subject, avg(correct::int) filter (model = 'src0') * 100 as src0, avg(correct::int) filter (model = 'src1') * 100 as src1, avg(correct::int) filter (model = 'src2') * 100 as src2 from eval_items group by 1)
select *, src1 - src0 as src1_minus_src0, src2 - src1 as src2_minus_src1 from m""")
def ag18_dc4_category_pivot(spark, d):
    return runs.by_category(view(spark, d, "eval_items"), "subject", "model", "correct", ["src0", "src1", "src2"])


@query("select quality, toxic, count(*) as n from labels group by 1, 2")
def ag19_label_counts(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("select to_json(map_from_entries(list(struct_pack(k := lang, v := n) order by lang))) as counts from (select lang, count(*) as n from documents group by 1)")
def ag20_frequency_map(spark, d):
    rows = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n"))))).alias("counts"))


@query("select event_type, count(*) filter (value > 50) * 1.0::double / (epoch(max(ts)) - epoch(min(ts))) as per_second from events group by 1")
def ag21_throughput(spark, d):
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) / F.lit(1e6) - F.unix_micros(F.min("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, d, "events").groupBy("event_type").agg((F.count_if(F.col("value") > 50) / seconds).alias("per_second"))


@query(with_views("mcq") + ", " + VALIDITY + f""", p as (select {MCQ_PROBLEMS} as p from mcq)
select 1 as place, 'exact duplicates' as check, coalesce(sum(n - 1), 0)::bigint as n from (select count(*) as n from mcq group by question, A, B, C, D, answer having count(*) > 1)
union all select 2, 'missing fields', count(*) from p where len(p) > 0
union all select 3, 'invalid answers', count(*) from v where kind <> 'valid'
union all select 4, 'encoding flags', 0""")
def ag22_audit_summary(spark, d):
    mcq = view(spark, d, "mcq")
    canonical = items.canonical(mcq, "id").cache()
    whole = mcq.select(F.col("id").alias("item_id"), "question", F.array("A", "B", "C", "D").alias("choices"), "answer")
    flags = canonical.where(F.size(text.encoding_flags(F.concat_ws(" ", "question", F.array_join("choices", " ")))) > 0)
    parts = [
        ("exact duplicates", items.exact_duplicates(whole).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n"))),
        ("missing fields", problems(spark, d).agg(F.count("*").alias("n"))),
        ("invalid answers", items.answer_validity(canonical).where("kind <> 'valid'").agg(F.count("*").alias("n"))),
        ("encoding flags", flags.agg(F.count("*").alias("n"))),
    ]
    out = None
    for i, (name, rows) in enumerate(parts, 1):
        row = rows.select(F.lit(i).alias("place"), F.lit(name).alias("check"), "n")
        out = row if out is None else out.union(row)
    return out


# Windows, order, sets, samples


@query("select doc_id, min(doc_id) over (partition by text) as first_id, row_number() over (partition by text order by doc_id)::int as turn from documents")
def wn1_first_occurrence(spark, d):
    own = Window.partitionBy("text")
    return docs(spark, d).select("doc_id", F.min("doc_id").over(own).alias("first_id"), F.row_number().over(own.orderBy("doc_id")).alias("turn"))


@query(STATS + ', l as (select *, lag(seed_sd) over (partition by task, metric order by "limit") as before from g where seeds = [1, 2, 3, 4, 5]) select task, metric, bool_and(case when before is not null then seed_sd < before end) as falls, count(*) as limits from l group by 1, 2 having count(*) > 1')
def wn2_falling_deviation(spark, d):
    return runs.falling_deviation(runs.seed_statistics(facts(spark, d)))


@query("select lang, count(*) * 1.0::double / sum(count(*)) over () as share from documents group by 1")
def wn3_share_of_total(spark, d):
    counts = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    whole = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.join(whole).select("lang", (F.col("n") / F.col("total")).alias("share"))


@query("select doc_id, lang from documents order by doc_id limit 100")
def wn4_prefix_limit(spark, d):
    return docs(spark, d).orderBy("doc_id").limit(100).select("doc_id", "lang")


@query("select event_id, format('{}  {}', event_id, event_type) as line, row_number() over (partition by user_id order by event_id)::int as number from events")
def wn5_wn6_listing(spark, d):
    return table(spark, d, "events").select("event_id", F.format_string("%d  %s", "event_id", "event_type").alias("line"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("number"))


@query(SELF + "select * from p order by shared desc, test_id, ref_id limit 10")
def tk1_top_pairs(spark, d):
    rows = id_texts(spark, d)
    top = sharedgrams.with_examples(overlap.top_pairs(sharedgrams.pairs(rows, 13)), rows, 13)
    return overlap.top_pairs(top)


@query(with_views("eval_items") + "select id, subject from eval_items where not correct order by id limit 10")
def tk2_tk3_tk4_examples(spark, d):
    return view(spark, d, "eval_items").where("not correct").orderBy("id").limit(10).select("id", "subject")


@query("select least(count(*), 3000) as scanned, count(*) > 3000 as truncated from documents")
def tk5_scan_cap(spark, d):
    return docs(spark, d).agg(F.least(F.count("*"), F.lit(3000)).alias("scanned"), (F.count("*") > 3000).alias("truncated"))


@query("(select doc_id from documents except select doc_id from labels where toxic = 1)")
def st1_difference(spark, d):
    return docs(spark, d).select("doc_id").exceptAll(table(spark, d, "labels").where("toxic = 1").select("doc_id"))


@query("select n_nationkey as key, 'left' as side from nation where n_nationkey not in (select s_nationkey from supplier) union all select distinct s_nationkey, 'right' from supplier where s_nationkey not in (select n_nationkey from nation)")
def st2_set_equality(spark, d):
    return runs.only_once(table(spark, d, "nation").select(F.col("n_nationkey").alias("key")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).distinct())


@query("with a as (select list(distinct source) as s from documents where lang = 'en'), b as (select list(distinct source) as s from documents where lang = 'fr') select len(list_intersect(a.s, b.s))::int as both, len(list_distinct(list_concat(a.s, b.s)))::int as either from a, b")
def st3_set_sizes(spark, d):
    s = docs(spark, d).agg(*[F.collect_set(F.when(F.col("lang") == c, F.col("source"))).alias(c) for c in ("en", "fr")])
    return s.select(F.size(F.array_intersect("en", "fr")).alias("both"), F.size(F.array_union("en", "fr")).alias("either"))


@query(SELF + "select test_id as id from p union select ref_id from p")
def st4_both_sides(spark, d):
    return sharedgrams.hit_ids(id_texts(spark, d), 13)


@query("select doc_id, coalesce(l.toxic, -1)::int as value from documents d left join labels l using (doc_id)")
def st5_override(spark, d):
    old = docs(spark, d).select("doc_id", F.lit(-1).alias("value"))
    return runs.latest(old, table(spark, d, "labels").select("doc_id", F.col("toxic").alias("value")), "doc_id")


def sample_sql(rows: str, key: str, n: int) -> str:
    return f"select {key}, (row_number() over (order by h, {key}))::int as draw from (select {key}, md5('42:' || {key}::varchar) as h from {rows} order by h, {key} limit {n})"


@query(sample_sql("benchmark", "item_id", 20))
def sm1_sample(spark, d):
    return runs.sample(table(spark, d, "benchmark").select("item_id"), "item_id", 20)


@query("select doc_id from (" + sample_sql("(select * from labels where quality = 0)", "doc_id", 25) + ")")
def sm2_sample_of_filtered(spark, d):
    return runs.sample(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", 25).select("doc_id").orderBy("doc_id")


@query("select source, doc_id, turn::int as turn from (select source, doc_id, row_number() over (partition by source order by doc_id) as turn from documents) where turn <= 5")
def sm3_few_shot(spark, d):
    return runs.first_per_group(docs(spark, d).select("source", "doc_id"), "source", "doc_id", 5)


@query("select event_type as task, min(event_id) as first_event, count(*) as n, date_trunc('day', ts) as start from events group by 1, 4")
def sr1_event_days(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("task"), F.date_trunc("day", "ts").alias("start")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query("with a as (select unnest(range(0, 3)) as retry, c_custkey % 4 * 0.5 as backoff, c_custkey from customer) select c_custkey, list((backoff * 2 ** retry)::double order by retry) as waits from a group by 1")
def sr3_retry_schedule(spark, d):
    backoff = (F.col("c_custkey") % 4) * F.lit(0.5)
    return table(spark, d, "customer").select("c_custkey", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: backoff * F.pow(F.lit(2.0), i)).alias("waits"))


# Scores of candidates


SCORES = with_views("choices_scored")


@query(SCORES + """, b as (select *, list_position([s0, s1, s2], greatest(s0, s1, s2)) - 1 as best, list_position([s0 / 1, s1 / 2, s2 / 3], greatest(s0 / 1, s1 / 2, s2 / 3)) - 1 as best_norm from choices_scored)
select id, (best = gold)::int as acc, (best_norm = gold)::int as acc_norm from b""")
def ex1_ex2_accuracy(spark, d):
    s = F.array("s0", "s1", "s2")
    return view(spark, d, "choices_scored").select("id", (numbers.best(s) == F.col("gold")).cast("int").alias("acc"), (numbers.best_per_length(s, F.array(*[F.lit(float(i)) for i in (1, 2, 3)])) == F.col("gold")).cast("int").alias("acc_norm"))


@query(SCORES + "select id, round((case when gold <> 0 then exp(s0) else 0 end + case when gold <> 1 then exp(s1) else 0 end + case when gold <> 2 then exp(s2) else 0 end) / (exp(s0) + exp(s1) + exp(s2)), 9) as mass from choices_scored")
def ex3_mass_on_correct(spark, d):
    right = F.array(*[F.col("gold") != i for i in range(3)])
    return view(spark, d, "choices_scored").select("id", F.round(numbers.mass_on(F.array("s0", "s1", "s2"), right), 9).alias("mass"))


@query(SCORES + "select id, (list_position([-s0, -s1, -s2], least(-s0, -s1, -s2)) - 1)::bigint as choice, len(list_filter([-s0, -s1, -s2], lambda x: x = least(-s0, -s1, -s2))) > 1 as tie from choices_scored")
def ex4_dc3_perplexity_choice(spark, d):
    choice, tie = numbers.least(F.transform(F.array("s0", "s1", "s2"), lambda x: -x))
    return view(spark, d, "choices_scored").select("id", choice.alias("choice"), tie.alias("tie"))


@query(with_views("eval_items") + "select model, avg(correct::int) as mean from eval_items group by 1")
def ex5_group_mean(spark, d):
    return view(spark, d, "eval_items").groupBy("model").agg(F.avg(F.col("correct").cast("int")).alias("mean"))


@query("with a as (select user_id, bool_and(value > 5) as a, bool_or(value > 99) as o from events group by 1) select count(*) as tasks, avg(a::int) as pass_all, avg(o::int) as pass_any from a")
def dc6_reliability(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.bool_and(F.col("value") > 5).alias("all_ok"), F.bool_or(F.col("value") > 99).alias("any_ok"))
    return e.agg(F.count("*").alias("tasks"), F.avg(F.col("all_ok").cast("double")).alias("pass_all"), F.avg(F.col("any_ok").cast("double")).alias("pass_any"))


# Constraints, on views that break them

RUN = {"model": "base", "dtype": "bfloat16", "item_limit": 4, "device": "cuda", "batch_size": "8", "random_seed": 1, "numpy_seed": 1, "torch_seed": 1, "fewshot_seed": 1, "num_fewshot": 0, "version": "0.4", "log_version": 1, "state": "F"}
RUN_STATE = "r as (select c.*, coalesce(n, 0) as lines from run_configs c left join (select run_id, count(*) as n from run_lines group by 1) using (run_id)), s as (select run_id, array_to_string(list_filter([" + ", ".join(f"case when {k} is distinct from {v!r} then '{k}' end" for k, v in RUN.items()) + ", case when lines <> item_limit then 'lines' end], lambda x: x is not null), ',') as differing from r)"


def run_state(spark, d):
    return checks.run_state(view(spark, d, "run_configs"), RUN, view(spark, d, "run_lines"), "run_id", "item_limit")


@query(with_views("run_configs", "run_lines") + ", " + RUN_STATE + " select run_id, differing, differing = '' as complete from s")
def fl7_run_equalities(spark, d):
    return run_state(spark, d).select("run_id", F.array_join("differing", ",").alias("differing"), "complete")


@query(with_views("run_configs", "run_lines") + ", " + RUN_STATE + " select o_orderkey + 100 as run_id from orders where o_orderkey + 100 not in (select run_id from s)")
def sr5_run_matrix(spark, d):
    """Planned runs that nothing has been made of; partial output among them would be refused."""
    planned = table(spark, d, "orders").select((F.col("o_orderkey") + 100).alias("run_id"))
    state = run_state(spark, d)
    partial = state.where(~F.col("complete")).select("run_id")
    return checks.still_to_run(planned.join(partial, "run_id", "left_anti"), state, "run_id")


ASKED = ("question", "gold", "model", "url", "options")


@query(with_views("asked", "given") + ", m as (select a.id, array_to_string(list_filter([" + ", ".join(f"case when a.{f} is distinct from g.{f} then '{f}' end" for f in ASKED) + "], lambda x: x is not null), ',') as differing from asked a join given g using (id)) select * from m where differing <> ''")
def jn6_jn12_field_mismatches(spark, d):
    out = checks.mismatches(view(spark, d, "asked"), view(spark, d, "given"), "id", *ASKED)
    return out.select("id", F.array_join("differing", ",").alias("differing"))


@query("select item_id as id, 'left' as side from benchmark where item_id % 3 = 0 union all select c_custkey, 'right' from customer where c_custkey not in (select item_id from benchmark)")
def jn5_st2_orphans(spark, d):
    right = view(spark, d, "given").select("id").union(table(spark, d, "customer").join(table(spark, d, "benchmark"), F.col("c_custkey") == F.col("item_id"), "left_anti").select("c_custkey"))
    return checks.orphans(view(spark, d, "asked"), right, "id")


@query(with_views("old_prompts", "new_prompts") + "select item_id, replace(n.prompt, 'Problem: ', 'Question: ') = o.prompt as same from old_prompts o join new_prompts n using (item_id)")
def sc21_changed_prompts(spark, d):
    return checks.changed_prompts(view(spark, d, "old_prompts"), view(spark, d, "new_prompts"), "item_id", "prompt", "Problem: ", "Question: ")


@query("with h as (select distinct o_orderpriority as model, cast(o_custkey % 57 as int) as subject from orders where o_custkey % 57 <> length(o_orderpriority)), a as (select * from (select distinct model from h), (select distinct subject from h)) select model, list_sort(list(subject)) as missing from (select * from a except select * from h) group by 1")
def src9_subject_sets(spark, d):
    subject = (F.col("o_custkey") % 57).cast("int")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), subject.alias("subject")).where(subject != F.length("o_orderpriority"))
    return checks.incomplete_sets(rows, "model", "subject")


@query("select event_type, count(*) as n from events group by 1 having count(*) <> 570")
def fl9_row_counts(spark, d):
    return runs.violations(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), F.col("n") != 570)


@query(with_views("seed_scores") + 'select task, limit_n as "limit", metric, seed, 2 as n from seed_scores where seed = 2')
def ag11_contradicting_runs(spark, d):
    f = facts(spark, d)
    return runs.conflicts(f.union(f).union(f.where("seed = 2").withColumn("value", F.col("value") + 1)))


@query(with_views("mcq") + "select id, concat(trim(question), chr(10), 'A. ', trim(A), chr(10), 'B. ', trim(B), chr(10), 'C. ', trim(C), chr(10), 'D. ', trim(D), chr(10), 'Answer:') as doc_to_text, 'A,B,C,D' as doc_to_choice, case when answer in ('A', 'B', 'C', 'D') then position(answer in 'ABCD') - 1 end::int as doc_to_target from mcq")
def sc20_task_template(spark, d):
    letters = F.array(*map(F.lit, "ABCD"))
    target = F.nullif(F.array_position(letters, F.col("answer")), F.lit(0)) - 1
    return view(spark, d, "mcq").select("id", text.mcq_prompt(F.col("question"), F.array("A", "B", "C", "D")).alias("doc_to_text"), F.array_join(letters, ",").alias("doc_to_choice"), target.cast("int").alias("doc_to_target"))
