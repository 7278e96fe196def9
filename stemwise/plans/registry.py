"""All queries of the engine by operator id, and the SQL they are held against."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import stats, text as T
from ..operators import audit, classifier, items as I, matching, results as R, scoring, surface
from ..sources import readers, sinks
from ..streaming import upsert
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OK = "coalesce(pick = gold, false)"


def query(oracle: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def on_answers(name: str, oracle: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(f"with {V.ANSWERS} {oracle}".replace(")) ,", ")),").replace(") ,", "),"), name)(lambda spark, sf_dir: f(V.answers(spark, sf_dir)))


def on_options(name: str, oracle: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(f"with {V.OPTIONS} {oracle}", name)(lambda spark, sf_dir: f(V.options(spark, sf_dir)))


def on_items(name: str, oracle: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(f"with {V.ITEMS} {oracle}", name)(lambda spark, sf_dir: f(V.items(spark, sf_dir)))


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- D: aggregations, E: statistics ---------------------------------------------------

WILSON = """(k / n + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"""
GROUPS = f"g as (select model, condition, count(*) filter ({OK}) as k, count(*) as n, count(*) filter (pick is null) as unparsed from answers group by all)"
FAV = "f as (select model, condition, pick as fav from (select *, row_number() over (partition by model, condition order by c desc, p) as r from (select model, condition, pick, count(*) as c, min(item_pos) as p from answers where pick is not null group by all)) where r = 1)"
RATE = "h as (select a.model, a.condition, any_value(fav) as fav, avg(case when gold = fav then 1.0 else 0.0 end) as fav_rate from answers a join f on a.model = f.model and a.condition = f.condition group by all)"

TAIL = "(select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) from (select unnest(range({a}, {b} + 1)) as i))"


def tail(a: str, b: str, p: str = "0.2") -> str:
    return TAIL.format(a=a, b=b, p=p)


def significant(c: str) -> Column:
    """Six significant digits as text, so that engines agree. Java writes no more digits
    than tell a double from its neighbours, under six near zero, so that is scaled first."""
    scaled = F.format_string("%.5e", F.col(c) * 1e100)
    small = F.concat(F.substring_index(scaled, "e-", 1), F.lit("e-"), (F.substring_index(scaled, "e-", -1).cast("int") + 100).cast("string"))
    return F.when((F.col(c) > 0) & (F.col(c) < 1e-300), small).otherwise(F.format_string("%.5e", F.col(c)))


SIGNIFICANT = "format('{{:.5e}}', {})"

on_answers("d1_accuracy", f"select model, condition, count(*) filter ({OK}) as k, count(*) as n, round(avg({OK}::int), 8) as acc, count(*) filter (pick is null) as unparsed from answers group by all", lambda a: rounded(R.accuracy(a, "model", "condition")))
on_answers("d2_by_condition", f"select condition, count(*) filter ({OK}) as k, count(*) as n, round(avg({OK}::int), 8) as acc, count(*) filter (pick is null) as unparsed from answers group by all", lambda a: rounded(R.accuracy(a, "condition")))
on_answers("d3_by_condition_bank", f"select condition, bank, count(*) filter ({OK}) as k, count(*) as n, round(avg({OK}::int), 8) as acc, count(*) filter (pick is null) as unparsed from answers group by all", lambda a: rounded(R.accuracy(a, "condition", "bank")))
on_answers("d4_first_seen_runs", "select model, condition, min(item_pos) as first_pos, count(*) as n from answers group by all", lambda a: R.first_seen(a, "model", "condition"))
on_answers("d5_by_model_condition_bank", f"select model, condition, bank, count(*) filter ({OK}) as k, count(*) as n, round(avg({OK}::int), 8) as acc, count(*) filter (pick is null) as unparsed from answers group by all", lambda a: rounded(R.accuracy(a, "model", "condition", "bank")))
on_answers("d6_histogram", "select pick, count(*) as n from answers group by all", lambda a: R.histogram(a, "pick"))
on_answers("d7_mode_first_seen", "select model, condition, pick as fav, c as fav_n from (select *, row_number() over (partition by model, condition order by c desc, p) as r from (select model, condition, pick, count(*) as c, min(item_pos) as p from answers where pick is not null group by all)) where r = 1", lambda a: R.favourite(a, "model", "condition"))
on_answers("d7_mode_with_null", "select bank, pick as fav, c as fav_n from (select *, row_number() over (partition by bank order by c desc, p) as r from (select bank, pick, count(*) as c, min(item_pos) as p from answers group by all)) where r = 1", lambda a: R.favourite(a, "bank", with_null=True))
on_answers("d8_always_favourite", f", {FAV}, {RATE} select model, condition, fav, round(fav_rate, 8) as fav_rate from h", lambda a: rounded(R.always_favourite(a, "model", "condition")))
on_answers("d9_unparsed", "select model, count(*) filter (pick is null) as unparsed from answers group by all", lambda a: a.groupBy("model").agg(F.count_if(F.col("pick").isNull()).alias("unparsed")))
PAIRED = "a_ as (select item_pos, condition, gold, bank, pick, {ok} as ok from answers where model = 'm0'), b_ as (select item_pos, condition, gold, bank, pick, {ok} as ok from answers where model = 'm1'), pairs as (select a_.item_pos, a_.condition, a_.gold as a_gold, b_.gold as b_gold, a_.bank as a_bank, b_.bank as b_bank, a_.pick as a_pick, b_.pick as b_pick, a_.ok as a_right, b_.ok as b_right from a_ join b_ on a_.item_pos = b_.item_pos and a_.condition = b_.condition)".replace("{ok}", OK)
PAIR = lambda a: R.paired(a, "m0", "m1", "model", ["item_pos", "condition"])
TABLE = "select condition, count(*) filter (a_right and b_right) as a, count(*) filter (a_right and not b_right) as b, count(*) filter (not a_right and b_right) as c, count(*) filter (not a_right and not b_right) as d from pairs group by all"
on_answers("d13_contingency", f", {PAIRED} {TABLE}", lambda a: R.contingency(PAIR(a), "condition"))
on_answers("d14_agreement", f", {PAIRED} select n, same, round(same / n, 8) as rate, round(s / (n * n), 8) as chance from (select count(*) as n, count(*) filter (a_pick is not distinct from b_pick) as same from pairs), (select sum(ca * cb)::double as s from (select a_pick as x, count(*) as ca from pairs group by 1) join (select b_pick as y, count(*) as cb from pairs group by 1) on x is not distinct from y)", lambda a: rounded(R.agreement(PAIR(a))))
on_answers("d15_conditional_accuracy", f", {PAIRED} select round(avg(a_right::int) filter (b_right), 8) as acc_if_right, round(avg(a_right::int) filter (not b_right), 8) as acc_if_wrong from pairs", lambda a: rounded(R.conditional_accuracy(PAIR(a))))
CONDITIONS = ["full", "options", "shuffle"]
on_answers("d16_pivot", "select bank, " + ", ".join(f"round(avg({OK}::int) filter (condition = '{c}'), 8) as \"{c}\"" for c in CONDITIONS) + " from answers group by bank", lambda a: rounded(R.pivot_accuracy(a, CONDITIONS)))
on_answers("d17_totals", f"select bank, count(*) filter ({OK}) as k, count(*) as n from answers group by rollup (bank)", R.totals)
on_answers("d18_share_by_group", f"select bank, count(*) filter ({OK}) as k, count(*) as n, round(100.0 * count(*) filter ({OK}) / count(*), 8) as share, round(100.0 * count(*) / sum(count(*)) over (), 8) as of_total from answers group by bank", lambda a: rounded(R.shares(a, "bank", R.correct())))
on_answers("d20_distinct_letters", "select bank, list_aggregate(list_sort(list_distinct(list(pick) filter (pick is not null))), 'string_agg', '') as letters from answers group by bank", lambda a: a.groupBy("bank").agg(F.array_join(F.array_sort(F.collect_set("pick")), "").alias("letters")))
on_answers("d24_by_model_bank", f"select model, bank, count(*) filter ({OK}) as k, count(*) as n, round(avg({OK}::int), 8) as acc, count(*) filter (pick is null) as unparsed from answers group by all", lambda a: rounded(R.accuracy(a, "model", "bank")))
on_answers("e5_wilson", f", {GROUPS} select model, condition, round({WILSON.format(s='-')}, 8) as lo, round({WILSON.format(s='+')}, 8) as hi from g", lambda a: rounded(R.accuracy(a, "model", "condition").select("model", "condition", *(x.alias(n) for x, n in zip(stats.wilson(F.col("k"), F.col("n")), ("lo", "hi"))))))
on_answers("e6_z_score", f", {GROUPS} select model, condition, round((k - 0.2 * n) / sqrt(0.16 * n), 6) as z from g", lambda a: rounded(R.accuracy(a, "model", "condition").select("model", "condition", stats.z_score(F.col("k"), F.col("n")).alias("z")), 6))
on_answers("e2_binomial_upper_tail", f", {GROUPS} select model, condition, bank, k, n, {SIGNIFICANT.format(tail('k', 'n'))} as p from (select model, condition, bank, count(*) filter ({OK}) as k, count(*) as n from answers group by all)", lambda a: R.accuracy(a, "model", "condition", "bank").withColumn("p", stats.binom_sf("k", "n")).select("model", "condition", "bank", "k", "n", significant("p").alias("p")))
on_answers("e2_binomial_exact", f", {GROUPS} select bank, k, n, {SIGNIFICANT.format(tail('k', 'n'))} as p from (select bank, condition, count(*) filter ({OK}) as k, count(*) as n from answers group by all)", lambda a: R.accuracy(a, "bank", "condition").withColumn("p", stats.binom_sf_exact("k", "n")).select("bank", "k", "n", significant("p").alias("p")))
on_answers("e3_binomial_lower_tail", f"select model, bank, k, n, case when k <= 0.2 * n then {SIGNIFICANT.format(tail('0', 'k'))} end as p from (select model, bank, count(*) filter (pick = 'A') as k, count(*) as n from answers group by all)", lambda a: a.groupBy("model", "bank").agg(F.count_if(F.col("pick") == "A").alias("k"), F.count("*").alias("n")).withColumn("p", R.lower_p("k", "n")).select("model", "bank", "k", "n", F.when(F.col("p").isNotNull(), significant("p")).alias("p")))
on_answers("e4_guarded_p", f"select model, bank, k, n, case when k <= 0.2 * n then {SIGNIFICANT.format('1.0::double')} else {SIGNIFICANT.format(tail('k', 'n'))} end as p from (select model, bank, count(*) filter ({OK}) as k, count(*) as n from answers group by all)", lambda a: R.accuracy(a, "model", "bank").withColumn("p", R.upper_p("k", "n")).select("model", "bank", "k", "n", significant("p").alias("p")))
FISHER = "exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1))"
on_answers(
    "e7_fisher",
    f", {PAIRED}, t as (select a_bank as bank, count(*) filter (a_right and b_right) as a, count(*) filter (a_right and not b_right) as b, count(*) filter (not a_right and b_right) as c, count(*) filter (not a_right and not b_right) as d from pairs group by all), "
    f"w as (select bank, x, {FISHER} as p, {FISHER.replace('x +', 'a +').replace('- x', '- a').replace('- a + x', '- a + a')} as p0 from (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from t)) "
    f"select bank, {SIGNIFICANT.format('least(1.0, sum(p) filter (p <= p0 * (1 + 1e-7)))')} as p from w group by bank",
    lambda a: R.contingency(PAIR(a).withColumnRenamed("a_bank", "bank"), "bank").withColumn("p", stats.fisher_exact("a", "b", "c", "d")).select("bank", significant("p").alias("p")),
)
on_answers("e8_mcnemar", f", {PAIRED} select bank, {SIGNIFICANT.format('case when n = 0 then 1.0 else least(1.0, 2 * ' + tail('0', 'm', '0.5') + ') end')} as p from (select a_bank as bank, count(*) filter (a_right <> b_right) as n, least(count(*) filter (a_right and not b_right), count(*) filter (not a_right and b_right)) as m from pairs group by all)", lambda a: R.contingency(PAIR(a).withColumnRenamed("a_bank", "bank"), "bank").withColumn("p", stats.mcnemar("b", "c")).select("bank", significant("p").alias("p")))
on_answers("e9_rho", f", {GROUPS} select g.model, g.condition, round(case when f.k / f.n > 0.2 then (g.k / g.n - 0.2) / (f.k / f.n - 0.2) end, 6) as rho from g join g f on g.model = f.model and f.condition = 'full'", lambda a: rounded(R.score_report(a).select("model", "condition", "rho"), 6))
on_answers("flagship_score_report", f", {GROUPS}, {FAV}, {RATE} select g.model, g.condition, g.k, g.n, round(g.k / g.n, 8) as acc, round({WILSON.format(s='-').replace('k /', 'g.k /').replace('n', 'g.n').replace('g.n)', 'g.n)')}, 8) as lo, round({WILSON.format(s='+').replace('k /', 'g.k /').replace('n', 'g.n')}, 8) as hi, round((g.k - 0.2 * g.n) / sqrt(0.16 * g.n), 8) as z, g.unparsed, fav, round(fav_rate, 8) as fav_rate, round(case when o.k / o.n > 0.2 then (g.k / g.n - 0.2) / (o.k / o.n - 0.2) end, 8) as rho from g join h on g.model = h.model and g.condition = h.condition join g o on o.model = g.model and o.condition = 'full'", lambda a: rounded(R.score_report(a).drop("p")))

# --- F: windows, G: sorts, H: sets -----------------------------------------------------

on_options("f1_length_rank", "select item_pos, letter, row_number() over (partition by item_pos order by length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) desc, letter_idx) as rank from options", lambda o: surface.length_rank(o).select("item_pos", "letter", "rank"))
on_options("f2_longest_is_answer", "select item_pos, max(r) filter (is_gold) as answer_rank, bool_or(is_gold and r = 1) as longest, bool_or(is_gold and r = 5) as shortest from (select *, row_number() over (partition by item_pos order by length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) desc, letter_idx) as r from options) group by item_pos", lambda o: surface.length_rank(o).groupBy("item_pos").agg(F.max(F.when(F.col("is_gold"), F.col("rank"))).alias("answer_rank"), F.bool_or(F.col("is_gold") & F.col("is_longest")).alias("longest"), F.bool_or(F.col("is_gold") & F.col("is_shortest")).alias("shortest")))
NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
on_items("f3_dedupe_per_bank", f"select item_pos, bank from (select *, row_number() over (partition by bank, {NORM.format('question')} order by item_pos) as r from items where {NORM.format('question')} <> '') where r = 1", lambda i: I.dedupe_first(i.withColumn("key", T.norm_lower(F.col("question"))), ["bank", "key"], ["item_pos"]).select("item_pos", "bank"))
on_items("f4_dedupe_global", f"select item_pos from (select *, row_number() over (partition by {NORM.format('question')} order by item_pos) as r from items where {NORM.format('question')} <> '') where r = 1", lambda i: I.dedupe_first(i.withColumn("key", T.norm_lower(F.col("question"))), ["key"], ["item_pos"]).select("item_pos"))
CASES = f"c as (select *, {NORM.format('opts[1]')} as k, count(*) over (partition by {NORM.format('opts[1]')}) as m from items)"
WITH_CASE = lambda i: R.with_group_size(i.withColumn("key", T.norm_lower(F.element_at("options", "A"))), "key")
on_items("d21_case_group_size", f", {CASES} select item_pos, m as group_size, case when m > 1 then md5(k) end as grp from c", lambda i: WITH_CASE(i).select("item_pos", "group_size", F.md5("case_group").alias("grp")))
on_items("f6_one_per_case", f", {CASES} select item_pos from (select *, row_number() over (partition by case when m > 1 then 'g' || k else 'i' || item_pos end order by item_pos) as r from c) where r = 1", lambda i: I.one_per_case(WITH_CASE(i)).select("item_pos"))
on_items("f7_stratified_sample", "select bank, item_pos from (select *, row_number() over (partition by bank order by sha256('20260902|' || item_pos)) as r from items) where r <= 100", lambda i: I.stratified_sample(i, "bank", 100, 20260902).select("bank", "item_pos"))
on_items("f8_first_per_bank", "select bank, item_pos from (select *, row_number() over (partition by bank order by item_pos) as r from items) where r <= 5", lambda i: R.first_per_group(i, "bank", 5).select("bank", "item_pos"))
on_options("f9_length_z", "select item_pos, letter, round((l - avg(l) over w) / coalesce(nullif(stddev_pop(l) over w, 0), 1), 6) as z from (select *, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as l from options) window w as (partition by item_pos)", lambda o: rounded(surface.dense_features(o).select("item_pos", "letter", F.col("len_z").alias("z")), 6))
ABS = r"(always|never|all|only|must|no|entirely|completely)"
on_options("f10_only_option_with_flag", "select item_pos, letter, f::int as numeric, (f and sum(f::int) over (partition by item_pos) = 1)::int as only_numeric from (select *, regexp_matches(text, '[0-9]') as f from options)", lambda o: surface.dense_features(o).select("item_pos", "letter", "numeric", "only_numeric"))
on_options("f11_hash_permutation", "select item_pos, letter, row_number() over (partition by item_pos order by sha256('20260910|' || item_pos || '|' || letter)) - 1 as new_idx from options", lambda o: I.hash_order(o, 20260910).select("item_pos", "letter", "new_idx"))
on_answers("f13_running_accuracy", f"select model, condition, seen, r as \"right\" from (select model, condition, row_number() over w as seen, sum({OK}::int) over w as r from answers window w as (partition by model, condition order by item_pos rows unbounded preceding)) where seen % 50 = 0", lambda a: R.running_accuracy(a, 50))
on_items("f14_train_split", "select item_pos, case when ('0x' || substr(sha256('20260914|' || item_pos), 1, 8))::bigint % 10 < 1 then 'validation' else 'fit' end as part from items", lambda i: I.train_split(i, 20260914).select("item_pos", "part"))
on_answers("g2_most_common", "select pick, n, row_number() over (order by n desc, p, pick nulls first) as rank from (select pick, count(*) as n, min(item_pos) as p from answers group by pick)", lambda a: R.most_common(a, "pick"))
on_answers("g4_top_bank", "select bank, count(*) as n from answers group by bank order by n desc, bank limit 1", lambda a: a.groupBy("bank").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bank").limit(1))
on_answers("h1_union_all", "select bank, count(*) as n from (select bank from answers where condition = 'full' union all select bank from answers where model = 'm0') group by bank", lambda a: a.filter("condition = 'full'").unionByName(a.filter("model = 'm0'")).groupBy("bank").agg(F.count("*").alias("n")))
on_answers("h2_distinct_banks", "select distinct bank from answers", lambda a: a.select("bank").distinct())
on_answers("h5_groups_without_picks", "select model, bank from answers group by all having count(*) filter (pick = 'E' and condition = 'full') = 0", lambda a: a.groupBy("model", "bank").agg(F.count_if((F.col("pick") == "E") & (F.col("condition") == "full")).alias("n")).filter("n = 0").select("model", "bank"))
on_answers("b22_correct", f"select item_pos, model, condition, {OK} as correct from answers", lambda a: a.select("item_pos", "model", "condition", R.correct().alias("correct")))
on_answers("b28_alignment_violations", f", {PAIRED} select count(*) filter (a_gold is distinct from b_gold) as gold, count(*) filter (a_bank is distinct from b_bank) as bank from pairs", lambda a: R.violations(PAIR(a)))
on_answers("c1_positional_join", f", {PAIRED} select item_pos, condition, a_pick, b_pick from pairs", lambda a: PAIR(a).select("item_pos", "condition", "a_pick", "b_pick"))
on_answers("c3_run_groups", "select x.condition, x.n as n0, y.n as n1 from (select condition, count(*) as n from answers where model = 'm0' group by 1) x join (select condition, count(*) as n from answers where model = 'm1' group by 1) y on x.condition = y.condition", lambda a: R.run_groups(a, "m0", "m1"))
on_answers("a11_upsert", "select model, condition, count(*) as n, count(pick) as read from (select model, condition, pick from answers where model <> 'm1' union all select 'm1', condition, gold from answers where model = 'm0') group by all", lambda a: sinks.upserted(a, a.filter("model = 'm0'").withColumns({"model": F.lit("m1"), "pick": F.col("gold")})).groupBy("model", "condition").agg(F.count("*").alias("n"), F.count("pick").alias("read")))
on_answers("a12_report_lines", f"select rtrim(rpad(bank, 10, ' ') || rpad((count(*) filter ({OK}))::varchar, 8, ' ') || rpad(count(*)::varchar, 8, ' ')) as line from answers group by bank", lambda a: sinks.report_lines(R.accuracy(a, "bank"), ("bank", 10), ("k", 8), ("n", 8)))

# --- B: parsing and predicates, C: joins over items -------------------------------------

MARK = "regexp_extract({}, '(?i)reference answer\\s*:?\\s*([A-Ga-g]+)', 1)"


def on_raw(name: str, oracle: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(oracle and f"with {V.RAW} {oracle}", name)(lambda spark, sf_dir: f(V.raw(spark, sf_dir)))


LETTERS_OF = "regexp_extract_all(data, '(?:^|[ \\t\\n\\x0b\\f\\r])([A-G])[.]{}', 1)"
ASCII_CLASS = f"r as (select *, {MARK.format('label')} as m, {LETTERS_OF.format('[ \\t\\n\\x0b\\f\\r]*')} as l from raw)"
on_raw("b1_strict_parse_markers", f", {ASCII_CLASS} select pos, case when m = '' then 'no_marker' when length(m) > 1 then 'multi_answer' else 'other' end as why from r", lambda r: I.parse_strict(r).select("pos", F.when(F.col("reject").isin("no_marker", "multi_answer"), F.col("reject")).otherwise("other").alias("why")))
WS = r"[ \t\n\x0b\f\r]"
TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
PARSED = f"""p0 as (select pos, data, label, coalesce(nullif({MARK.format('label')}, ''), {MARK.format('data')}) as m, {LETTERS_OF.format('[ \\t\\n\\x0b\\f\\r]*')} as l,
    list_transform(string_split_regex(data, '(?:^|{WS})[A-G][.．、]{WS}*'), lambda x: {TRIM.format('x')}) as t from raw),
  p1 as (select *, case when m = '' then 'no_marker' when length(m) > 1 then 'multi_answer' when regexp_matches(data || label, '[\\x{{4e00}}-\\x{{9fff}}]') then 'cjk' when len(l) < 1 then 'no_options'
    when len(list_distinct(l)) < len(l) then 'repeated_letter' when list_sort(l) <> ['A','B','C','D','E'] then 'not_five' when upper(m) not in ('A','B','C','D','E') then 'key_not_option'
    when length(t[1]) < 15 then 'short_question' when list_contains(t[2:], '') then 'empty_option' end as reject from p0)"""
on_raw("b1_strict_parse", f", {PARSED} select pos, reject, case when reject is null then upper(m) end as answer, case when reject is null then md5(t[1]) end as question_md5, case when reject is null then md5(t[1 + list_position(l, 'A')] || '|' || t[1 + list_position(l, 'E')]) end as options_md5 from p1", lambda r: I.parse_strict(r).select("pos", "reject", F.when(F.col("reject").isNull(), F.col("answer")).alias("answer"), F.when(F.col("reject").isNull(), F.md5("question")).alias("question_md5"), F.md5(F.concat(F.element_at("options", "A"), F.lit("|"), F.element_at("options", "E"))).alias("options_md5")))
on_raw("b4_drop_reasons", f", {PARSED} select coalesce(reject, 'kept') as reason, count(*) as n from p1 group by 1", lambda r: I.drop_reasons(I.parse_strict(r)))
on_raw("b21_drop_columns", "select pos, bank from raw", lambda r: r.drop("data", "label", "archive"))
on_raw("b5_normalize_answer", "select pos, regexp_replace(upper(label), '[^A-Z]', '', 'g') as answer from raw", lambda r: r.select("pos", T.normalize_answer(F.col("label")).alias("answer")))
on_raw("b8_option_shape", f", s as (select pos, {LETTERS_OF.format('[ \\t\\n\\x0b\\f\\r]')} as l, {NORM.format('data')} as k from raw), u as (select *, list_sort(list_distinct(l)) as q from (select *, row_number() over (partition by k order by pos) as rn from s) where rn = 1 and k <> '') select pos, case when len(l) = 0 then 'none' when len(l) <> len(q) then 'duplicate_letters' when q = ['A','B','C','D','E'] then 'clean_ABCDE' when q = (['A','B','C','D','E','F','G'])[1:len(q)] then 'clean_' || len(q) || '_options' else 'gapped_or_odd' end as shape from u", lambda r: audit.classify(r).select("pos", "shape"))
LEAK = "case when regexp_matches(data, '(?i)haoxiang') then 'watermark_edu' when regexp_matches(data, '(?i)qq\\s*:?\\s*[0-9]{6,}') then 'watermark_qq' when regexp_matches(data, '^Unit\\s+[0-9]') then 'unit_header' when contains(data, '##########') then 'page_marker' end"
DISTINCT = "len(list_distinct(regexp_extract_all({}, '{}', 1)))"
LOOSE, PAREN = r"(?:^|[ \t\n\x0b\f\r])([A-G])[ \t\n\x0b\f\r]*[.．、:：\)）]", r"[\(（][ \t\n\x0b\f\r]*([A-G])[ \t\n\x0b\f\r]*[\)）]"
AUDITED = f"""a0 as (select *, {NORM.format('data')} as k, {MARK.format('label')} as m1, {MARK.format('data')} as m2, {LETTERS_OF.format('[ \\t\\n\\x0b\\f\\r]')} as l from raw),
  a1 as (select *, coalesce(nullif(m1, ''), m2) as m, regexp_matches(data, '(?i)\\[\\s*shared\\s+stem\\s*\\]') as sh, list_sort(list_distinct(l)) as q from (select *, row_number() over (partition by k order by pos) as rn from a0) where rn = 1 and k <> ''),
  a2 as (select case when m = '' then 'no_answer_marker' when length(m) > 1 then 'multi_answer' else 'single_answer' end as answerable, {LEAK} as leak,
    case when len(l) = 0 then 'none' when len(l) <> len(q) then 'duplicate_letters' when q = ['A','B','C','D','E'] then 'clean_ABCDE' when q = (['A','B','C','D','E','F','G'])[1:len(q)] then 'clean_' || len(q) || '_options' else 'gapped_or_odd' end as shape,
    case when len(l) = 0 then case when {DISTINCT.format('label', '(?:^|[ ])([A-G])[.．、][ ]')} >= 4 then 'options stored in the answer field' when {DISTINCT.format('data', LOOSE)} >= 4 then 'other punctuation or no space' when {DISTINCT.format('data', PAREN)} >= 4 then 'letters in parentheses' else 'no option labels found' end end as no_options,
    case when len(l) <> len(q) and len(regexp_extract_all(data, '(?i)\\[\\s*(?:single|multiple|multi)[\\s-]*choices?(?:\\s+questions?)?\\s*\\]')) >= 2 then case when sh then 'with shared-stem marker' else 'without shared-stem marker' end end as merged,
    sh::varchar as shared, regexp_matches(data || label, '[\\x{{4e00}}-\\x{{9fff}}]')::varchar as cjk from a1)"""
on_raw("b9_b13_audit_summary", f", {AUDITED} select class, value, count(*) as n from (unpivot a2 on answerable, leak, shape, no_options, merged, shared, cjk into name class value value) where value is not null group by all", lambda r: audit.summary(audit.classify(r)))
on_raw("b10_merged_records", f", s as (select pos, data, {LETTERS_OF.format('[ \\t\\n\\x0b\\f\\r]')} as l, {NORM.format('data')} as k from raw), u as (select * from (select *, row_number() over (partition by k order by pos) as rn from s) where rn = 1 and k <> '') select pos, case when regexp_matches(data, '(?i)\\[\\s*shared\\s+stem\\s*\\]') then 'with shared-stem marker' else 'without shared-stem marker' end as merged from u where len(l) <> len(list_distinct(l)) and len(regexp_extract_all(data, '(?i)\\[\\s*(?:single|multiple|multi)[\\s-]*choices?(?:\\s+questions?)?\\s*\\]')) >= 2", lambda r: audit.classify(r).filter("merged is not null").select("pos", "merged"))
on_raw("b11_leaks", "select pos, case when regexp_matches(data, '(?i)haoxiang') then 'watermark_edu' when regexp_matches(data, '(?i)qq\\s*:?\\s*[0-9]{6,}') then 'watermark_qq' when regexp_matches(data, '^Unit\\s+[0-9]') then 'unit_header' when contains(data, '##########') then 'page_marker' end as leak from raw", lambda r: r.select("pos", T.first_named(F.col("data")).alias("leak")))
on_raw("b12_answerability", f", r as (select pos, data, label, {MARK.format('label')} as m, {NORM.format('data')} as k from raw) select pos, case when m = '' then 'no_answer_marker' when length(m) > 1 then 'multi_answer' else 'single_answer' end as answerable from (select *, row_number() over (partition by k order by pos) as rn from r) where rn = 1 and k <> ''", lambda r: audit.classify(r).select("pos", "answerable"))
on_raw("b14_shared_stem", "select pos, regexp_matches(data, '(?i)\\[\\s*shared\\s+stem\\s*\\]') as shared from raw", lambda r: r.select("pos", T.matches(F.col("data"), T.SHARED).alias("shared")))
query("select conv_id, turn, nullif(regexp_extract(upper(text), '(?:^|[^0-9A-Z_\\x{80}-\\x{10FFFF}])([A-E])(?:$|[^0-9A-Z_\\x{80}-\\x{10FFFF}])', 1), '') as pick from conversations where role = 'assistant'", "b18_extract_letter")(lambda spark, sf_dir: V.replies(spark, sf_dir).select("conv_id", "turn", T.extract_letter(F.col("text")).alias("pick")))
query("select conv_id, turn, case when starts_with(upper(trim(text)), 'YES') then 'YES' else 'NO' end as verdict from conversations where role = 'assistant'", "b19_yes_no")(lambda spark, sf_dir: V.replies(spark, sf_dir).select("conv_id", "turn", T.yes_no(F.col("text")).alias("verdict")))
BLOCK = "'A. ' || opts[1] || chr(10) || 'B. ' || opts[2] || chr(10) || 'C. ' || opts[3] || chr(10) || 'D. ' || opts[4] || chr(10) || 'E. ' || opts[5]"
on_items("b16_prompts", f"select item_pos, md5(question || chr(10) || {BLOCK} || chr(10) || chr(10) || 'Answer with one letter.') as full_md5, md5({BLOCK} || chr(10) || chr(10) || '{I.PROMPTS['en', 'options'].split(chr(10))[-1]}') as options_md5, md5(question || chr(10) || chr(10) || '{I.PROMPTS['en', 'question'].split(chr(10))[-1]}') as question_md5 from items", lambda i: i.select("item_pos", F.md5(I.prompt("full")).alias("full_md5"), F.md5(I.prompt("options")).alias("options_md5"), F.md5(I.prompt("question")).alias("question_md5")))
on_items("b20_whole_text", f"select item_pos, md5(question || chr(10) || {BLOCK}) as whole_md5 from items", lambda i: i.select("item_pos", F.md5(I.whole_text(F.col("question"), F.col("options"))).alias("whole_md5")))
ORDER = "o as (select item_pos, list(letter_idx order by sha256('20260910|' || item_pos || '|' || letter)) as ord from options group by item_pos)"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = I.hash_order(V.options(spark, sf_dir), 20260910).groupBy("item_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("new_idx", "letter_idx"))), lambda x: x["letter_idx"]).alias("order"))
    return I.apply_order(V.items(spark, sf_dir).join(w, "item_pos"))


query(f"with {V.OPTIONS}, {ORDER} select i.item_pos, substr('ABCDE', list_position(ord, (ascii(answer) - 65)::int)::int, 1) as new_answer, md5(opts[ord[1] + 1] || '|' || opts[ord[5] + 1]) as ends from items i join o on i.item_pos = o.item_pos", "b23_apply_permutation")(lambda s, d: _ordered(s, d).select("item_pos", "new_answer", F.md5(F.concat_ws("|", F.element_at("new_options", "A"), F.element_at("new_options", "E"))).alias("ends")))
HEX = "('0x' || substr(sha256({}), 1, 8))::bigint"
on_options("b25_c9_swap_donor", f", ring as (select item_pos, bank, coalesce(lead(item_pos) over w, first_value(item_pos) over w) as donor from (select distinct item_pos, bank from options) window w as (partition by bank order by sha256('20260910|' || item_pos))), r as (select *, substr('ABCDE', ({HEX.format(chr(39) + '20260911|' + chr(39) + ' || item_pos')} % 5 + 1)::int, 1) as dl from ring where donor <> item_pos) select o.item_pos, o.letter, r.donor, r.dl as donor_letter, md5(t.text) as donor_md5 from options o join r on r.item_pos = o.item_pos join options t on t.item_pos = r.donor and t.letter = r.dl where o.is_gold", lambda o: I.swap_donor(o, 20260910).select("item_pos", "letter", "donor", "donor_letter", F.md5("donor_text").alias("donor_md5")))
EVAL = "item_pos % 10 = 0"
OT = NORM.format("text")
#: Evaluation items are those of the benchmark's passages, and every document's items may train.
MINE = f"m as (select item_pos, {OT} as t, count(*) as c from options group by all), v as (select distinct item_pos as other, {OT} as t from eval_options), pairs_ as (select m.item_pos, other, sum(c) as shared from m join v on m.t = v.t and m.item_pos <> other group by all)"
EVALUATED = f"with {V.OPTIONS}, {V.EVAL_OPTIONS}"
query(f"{EVALUATED}, {MINE} select item_pos, max(shared)::bigint as shared from pairs_ group by item_pos", "c5_d23_option_overlap")(lambda s, d: matching.overlaps(V.options(s, d), V.options(s, d, "benchmark")))
query(f"{EVALUATED}, {MINE} select item_pos, max(shared)::bigint as shared from pairs_ group by item_pos having max(shared) >= 3", "c5_overlapping")(lambda s, d: matching.overlapping(V.options(s, d), V.options(s, d, "benchmark"), 3))
query(f"{EVALUATED} select item_pos from items i where not exists (select 1 from eval_items e where {NORM.format('e.question')} = {NORM.format('i.question')})", "c4_anti_join")(lambda s, d: matching.without(*(i.withColumn("key", T.norm_lower(F.col("question"))) for i in (V.items(s, d), V.items(s, d, "benchmark"))), "key").select("item_pos"))
query(f"{EVALUATED}, k as (select *, {NORM.format('question')} as key from items), {MINE}, s as (select item_pos, max(shared) as shared from pairs_ group by 1), w as (select k.item_pos, key, case when k.bank in (select bank from eval_items) then 'bank' when key in (select {NORM.format('question')} from eval_items) then 'question' when s.shared >= 3 then 'overlap' end as why from k left join s on s.item_pos = k.item_pos) select item_pos, case when why is null and row_number() over (partition by key, why is null order by item_pos) > 1 then 'repeat' else why end as why from w", "f5_training_pool")(
    lambda s, d: matching.training_pool(V.items(s, d), V.items(s, d, "benchmark"), V.options(s, d), V.options(s, d, "benchmark")).select("item_pos", "why")
)
on_items("c6_prefix_match", f", a as (select item_pos as pos, bank, answer, substr({NORM.format('question || chr(32) || opts[1]')}, 1, 80) as key from items), b as (select *, min(pos) over (partition by bank, key) as fp from a), h as (select item_pos, bank, answer, substr({NORM.format('question')}, 1, 60) as head from items), j as (select i.item_pos, b.pos, row_number() over (partition by i.item_pos order by fp, b.pos) as r from h i join b on b.bank = i.bank and b.answer = i.answer and substr(b.key, 1, length(head)) = head and head <> '') select item_pos, pos as archive_pos from j where r = 1", lambda i: matching.prefix_match(i, i.select(F.col("item_pos").alias("pos"), "bank", "answer", F.concat_ws(" ", F.col("question"), F.element_at("options", "A")).alias("data"))))
on_items("c2_index_join", "select a.item_pos, b.item_pos as other, a.answer = b.answer as same from items a join items b on b.item_pos = a.item_pos + 1", lambda i: R.by_index(i, i, 1))
OUT = (2, 59, 166, 381, 515, 587, 645, 652)
on_items("c11_exclusion", f"select item_pos from items where item_pos not in {OUT}", lambda i: R.without_positions(i, OUT).select("item_pos"))
query(f"with {V.ITEMS}, f as (select distinct substr(question, 1, 40) as x from items where question <> '' union select distinct substr(o, 1, 25) from (select unnest(opts) as o from items) where length(o) >= 25) select count(*) as leaks from f where exists (select 1 from items i where contains(i.bank || '|' || i.answer || '|' || length(i.question), f.x))", "c13_leak_check")(lambda s, d: surface.leak_check(i := V.items(s, d), i.select(F.concat_ws("|", "bank", "answer", F.length("question").cast("string")).alias("blob"))))
KEYED = lambda i: i.select("bank", F.col("item_pos").alias("pos"), matching.alignment_key(F.col("answer"), F.col("question")).alias("key"))
query(None, "c7_align_sequences")(lambda s, d: matching.align_sequences(KEYED(V.items(s, d)), KEYED(V.items(s, d).withColumn("answer", F.when(F.col("item_pos") % 7 == 0, "A").otherwise(F.col("answer"))))))
UNIQUE = lambda i, changed: i.select("bank", F.col("item_pos").alias("pos"), F.concat(F.when(changed, F.lit("x")).otherwise(""), F.col("item_pos").cast("string")).alias("key"))
on_items("c7_align_unique_keys", "select bank, item_pos as left_pos, item_pos as right_pos from items where item_pos % 7 <> 0", lambda i: matching.align_sequences(UNIQUE(i, F.lit(False)), UNIQUE(i, F.col("item_pos") % 7 == 0)))
query(f"with {V.ITEMS}, c as (select bank, lang as path, ascii(lang) as ord, count(*) as n from items group by all) select bank, path, n from (select *, row_number() over (partition by bank order by n desc, ord) as r from c) where r = 1", "d22_best_candidate")(lambda s, d: matching.best_candidate(V.items(s, d).groupBy("bank", F.col("lang").alias("path")).agg(F.count("*").alias("n")).withColumn("order", F.ascii("path"))))

# --- B15, D10-D12, I, L: surface, functions and classifier ------------------------------

WORDY = "0-9A-Za-z_\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{10FFFF}"
BOUNDED = "regexp_matches(text, '(?i)(?:^|[^" + WORDY + "])(?:{})(?:$|[^" + WORDY + "])')"
FLAG_SQL = {
    "catch_all": "regexp_matches(text, '(?i)all of the above|none of the above|both .+ and |以上')",
    "absolute": BOUNDED.replace("{}", "always|never|all|only|must|no|entirely|completely"),
    "hedge": BOUNDED.replace("{}", "may|can|usually|often|generally|sometimes|possible|likely"),
    "numeric": "regexp_matches(text, '[0-9]')",
    "negation": BOUNDED.replace("{}", "not|without|cannot|none|except"),
}
FLAGGED = "flagged as (select *, " + ", ".join(f"{v} as {k}" for k, v in FLAG_SQL.items()) + " from options)"
on_options("b15_lexical_flags", f", {FLAGGED} select item_pos, letter, {', '.join(FLAG_SQL)} from flagged", lambda o: surface.with_flags(o, T.FLAGS).select("item_pos", "letter", *T.FLAGS))
on_options("d12_lift", f", {FLAGGED}, each as (" + " union all ".join(f"select '{f}' as flag, avg({f}::int) filter (is_gold) as a, avg({f}::int) as b from flagged" for f in FLAG_SQL) + ") select flag, round(a, 8) as p_correct, round(b, 8) as p_any, round(a / nullif(b, 0), 8) as lift from each", lambda o: rounded(surface.lifts(surface.with_flags(o, T.FLAGS))))
on_options("d10_mean_length", "select is_gold, round(avg(length(text)), 6) as mean_len, round(coalesce(nullif(stddev_pop(length(text)), 0), 1), 6) as sd from options group by is_gold", lambda o: rounded(surface.mean_lengths(o), 6).withColumn("mean_len", F.round("mean_len", 6)))
on_items("b26_case_key", f", n as (select item_pos, bank, regexp_extract_all(substr(trim(regexp_replace(question, '\\s+', ' ', 'g')), 1, 300), '[0-9]+(?:\\.[0-9]+)?') as x from items) select item_pos, case when len(x) >= 3 then bank || '|' || array_to_string(x, '|') end as case_key from n", lambda i: i.select("item_pos", I.case_key(F.col("question"), F.col("bank")).alias("case_key")))
on_items("b27_alignment_key", "select item_pos, answer || '|' || array_to_string((regexp_extract_all(question, '[0-9]+(?:\\.[0-9]+)?'))[1:8], ',') as key from items", lambda i: i.select("item_pos", matching.alignment_key(F.col("answer"), F.col("question")).alias("key")))
FULL_WIDTH = "".join(chr(0xFF10 + i) for i in range(10))
on_items("b27_full_width_digits", "select item_pos, answer || '|' || array_to_string((regexp_extract_all(question, '[0-9]+(?:\\.[0-9]+)?'))[1:8], ',') as key from items", lambda i: i.select("item_pos", matching.alignment_key(F.col("answer"), F.translate("question", "0123456789", FULL_WIDTH)).alias("key")))
on_items("i2_nfkc_full_width", "select item_pos, md5(nfc_normalize(question)) as n from items", lambda i: i.select("item_pos", F.md5(T.nfkc(F.translate("question", "0123456789ABCabc", FULL_WIDTH + "ＡＢＣａｂｃ"))).alias("n")))
on_items("i1_normalize", f"select item_pos, md5(trim(regexp_replace(question, '\\s+', ' ', 'g'))) as n from items", lambda i: i.select("item_pos", F.md5(T.norm(F.col("question"))).alias("n")))
query(None, "i2_nfkc")(lambda s, d: V.items(s, d).select("item_pos", T.nfkc("question").alias("n")))
on_items("i7_hash_id", "select item_pos, substr(sha256(trim(regexp_replace(question, '\\s+', ' ', 'g'))), 1, 16) as id from items", lambda i: i.select("item_pos", T.hash_id(T.norm(F.col("question"))).alias("id")))
on_options("i9_tokens", "select item_pos, letter, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as n from options", lambda o: o.select("item_pos", "letter", F.size(T.tokens(F.col("text"))).alias("n")))
JACCARD = "case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 0 else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) end"
on_options("h3_c10_option_overlap", f", t as (select item_pos, letter, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from options) select a.item_pos, a.letter, round(sum({JACCARD}) / 4, 6) as overlap from t a join t b on a.item_pos = b.item_pos and a.letter <> b.letter group by all", lambda o: rounded(surface.dense_features(o).select("item_pos", "letter", "overlap"), 6))
on_options("l1_dense_features", "select item_pos, letter, round(ln(1 + l), 6) as len_log, (r - 1) / 4 as rank_4, (r = 1)::int as is_longest, (r = 5)::int as is_shortest from (select item_pos, letter, l, row_number() over (partition by item_pos order by l desc, letter_idx) as r from (select *, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as l from options))", lambda o: rounded(surface.dense_features(o).select("item_pos", "letter", "len_log", "rank_4", "is_longest", "is_shortest"), 6))
on_options("l2_labelled_rows", "select item_pos, letter, is_gold::int as label from options", classifier.labelled_rows)
SPLIT = "('0x' || substr(sha256('20260914|' || item_pos), 1, 8))::bigint % 10 >= 1"
RANKED = "d as (select *, ln(1 + l) as len_log, (row_number() over (partition by item_pos order by l desc, letter_idx) - 1) / 4 as rank_4 from (select *, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as l from options))"


def _scaled(o: DataFrame) -> DataFrame:
    rows = I.train_split(surface.dense_features(o), 20260914)
    return classifier.scale(rows.filter("part = 'fit'"), rows)


on_options("l3_standardised", f", {RANKED}, t as (select avg(len_log) as m1, coalesce(nullif(stddev_pop(len_log), 0), 1) as s1, avg(rank_4) as m2, coalesce(nullif(stddev_pop(rank_4), 0), 1) as s2 from d where {SPLIT}) select item_pos, letter, round((len_log - m1) / s1, 6) as z_len_log, round((rank_4 - m2) / s2, 6) as z_rank_4 from d, t", lambda o: rounded(_scaled(o).select("item_pos", "letter", "z_len_log", "z_rank_4"), 6))
on_options("g6_argmax", ", d as (select *, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as l from options) select item_pos, letter as pick from (select *, row_number() over (partition by item_pos order by l desc, letter_idx) as r from d) where r = 1", lambda o: R.argmax(surface.dense_features(o).withColumn("score", F.col("len_log"))))
GRAMS = """w0 as (select item_pos, letter, regexp_extract_all(lower(text), '[a-z0-9_\\x{80}-\\x{10FFFF}]{2,}') as w from options),
  w1 as (select item_pos, letter, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as gram from w0),
  w2 as (select item_pos, letter, gram, count(*) as tf from w1 group by all),
  w3 as (select gram, count(*) as df, ln((1 + (select count(*) from options)) / (1 + count(*))) + 1 as idf from w2 group by gram having count(*) >= 5)"""
on_options("l4_idf", f", {GRAMS} select gram, df, round(idf, 6) as idf from w3", lambda o: rounded(classifier.idf(classifier.word_grams(o)), 6))
on_options("l4_document_weights", f", {GRAMS}, x as (select item_pos, letter, w2.gram, (1 + ln(tf)) * idf as v from w2 join w3 on w2.gram = w3.gram) select item_pos, letter, gram, round(v / sqrt(sum(v * v) over (partition by item_pos, letter)), 6) as w from x", lambda o: rounded(classifier.document_weights(classifier.word_grams(o)), 6))


@query(None, "l4_l8_option_classifier")
def _classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _folder(spark, "classifier"), surface.dense_features(V.options(spark, sf_dir))
    I.train_split(rows, 20260914).select("item_pos", "bank", "letter", "letter_idx", "text", "is_gold", *surface.DENSE, "part").write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    picks = lambda use_text, name: classifier.OptionClassifier(use_text=use_text, path=f"{path}/{name}").fit(rows).picks(rows.filter("part = 'validation'")).withColumnRenamed("pick", name)
    return picks(False, "surface_pick").join(picks(True, "text_pick").select("item_pos", "text_pick"), "item_pos").select("item_pos", "bank", "gold", "surface_pick", "text_pick")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.items(spark, sf_dir).select("item_pos", I.prompt("options").alias("prompt"))


BLOCK = "'A. ' || opts[1] || chr(10) || 'B. ' || opts[2] || chr(10) || 'C. ' || opts[3] || chr(10) || 'D. ' || opts[4] || chr(10) || 'E. ' || opts[5]"
PROMPT = f"{BLOCK} || chr(10) || chr(10) || '{I.PROMPTS['en', 'options'].split(chr(10))[-1]}'"
STUB = f"(select item_pos, {PROMPT} as prompt, substr('ABCDE', (('0x' || substr(sha256('1|' || {PROMPT}), 1, 2))::bigint % 5 + 1)::int, 1) as pick from items)"
NO_WAIT = lambda seconds: None
FAILS = lambda prompt: len(prompt) % 3 == 0
query(f"with {V.ITEMS} select item_pos, pick, null::varchar as error from {STUB}", "a14_k1_score_with_stub")(lambda s, d: scoring.score(_prompts(s, d), scoring.stub(1)).select("item_pos", T.extract_letter(F.col("reply")).alias("pick"), "error"))
query(f"with {V.ITEMS} select item_pos, md5('{{\"model\":\"m\",\"messages\":[{{\"role\":\"system\",\"content\":\"s\"}},{{\"role\":\"user\",\"content\":' || to_json(prompt)::varchar || '}}],\"max_tokens\":2000,\"temperature\":0}}') as body_md5 from {STUB}", "a15_hosted_request")(lambda s, d: _prompts(s, d).select("item_pos", F.md5(scoring.request_body("m", "s", F.col("prompt"))).alias("body_md5")))
query(f"with {V.ITEMS} select item_pos, pick from {STUB}", "j1_retry")(lambda s, d: scoring.scored_only(scoring.score(_prompts(s, d), scoring.flaky(scoring.stub(1), lambda p, n: n < 3), wait=NO_WAIT)))
query(f"with {V.ITEMS} select item_pos, pick from {STUB}", "j2_second_pass")(lambda s, d: scoring.score_twice(_prompts(s, d), scoring.flaky(scoring.stub(1), lambda p, n: FAILS(p)), V.scratch(s), again=scoring.stub(1), wait=NO_WAIT).select("item_pos", "pick"))
query(f"with {V.ITEMS}, n as (select count(*) as n from items) select 'ValueError: down' as error, least(n, 5) as n from n union all select 'stopped', n - 5 from n where n > 5", "j3_circuit_breaker")(lambda s, d: scoring.score_as_one(_prompts(s, d), scoring.flaky(scoring.stub(1), lambda p, n: True), V.scratch(s), wait=NO_WAIT).groupBy("error").agg(F.count("*").alias("n")))
@query(f"with {V.ITEMS}, f as (select *, length(prompt) % 3 = 0 and item_pos % 3 = 0 as fails from {STUB}) select count(*) filter (not fails) as scored, count(*) filter (fails) as failed from f", "j4_failures_are_not_scored")
def _not_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed calls, spread so that no five follow one another, are counted and not scored."""
    marked = _prompts(spark, sf_dir).withColumn("prompt", F.when((F.length("prompt") % 3 == 0) & (F.col("item_pos") % 3 == 0), F.concat("prompt", F.lit("\0"))).otherwise(F.col("prompt")))
    got = scoring.score(marked, scoring.flaky(scoring.stub(1), lambda p, n: p.endswith("\0")), wait=NO_WAIT, most=2**31)
    return got.agg(F.count_if(F.col("error").isNull()).alias("scored"), F.count_if(F.col("error").isNotNull()).alias("failed"))


query(f"with {V.ITEMS} select item_pos, pick from {STUB}", "j5_pause")(lambda s, d: scoring.scored_only(scoring.score(_prompts(s, d), scoring.stub(1), pause=0.5, wait=NO_WAIT)))
on_answers("a16_route_by_name", "select distinct model, contains(model, ':') as local from answers", scoring.routes)
query(None, "f11_replayed_permutation")(lambda s, d: I.replayed_orders(s, V.items(s, d).count(), 20260910))
on_items("f12_seeded_sample", "select item_pos from items order by sha256('7|' || item_pos) limit 30", lambda i: i.orderBy(I.sample_key(7, "item_pos")).limit(30).select("item_pos"))
on_items("a13_review_rows", "select sample_index, verdict, section from (select item_pos as sample_index, 'NO' as verdict, 'rejected' as section from items where item_pos % 3 = 0) union all (select item_pos, 'YES', 'accepted' from items where item_pos % 3 <> 0 order by sha256('7|' || item_pos) limit 30)", lambda i: sinks.review_rows(i.select(F.col("item_pos").alias("sample_index"), F.when(F.col("item_pos") % 3 == 0, "NO").otherwise("YES").alias("verdict")), 7))
query(name="export_features")(lambda s, d: surface.export_features(V.items(s, d), V.options(s, d)).select("item_pos", "id", "bank", "answer", "stem_len", "longest_is_answer", "answer_len_rank", "shared_stem"))
ORACLES["export_features"] = f"with {V.OPTIONS}, r as (select item_pos, row_number() over (partition by item_pos order by length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) desc, letter_idx) as rk, is_gold from options) select i.item_pos, substr(sha256(trim(regexp_replace(question, '\\s+', ' ', 'g'))), 1, 16) as id, bank, answer, length(trim(regexp_replace(question, '\\s+', ' ', 'g'))) as stem_len, rk = 1 as longest_is_answer, rk as answer_len_rank, false as shared_stem from items i join r on r.item_pos = i.item_pos and r.is_gold"


# --- Further parsing, prompts and joins ------------------------------------------------


def _rendered(items: DataFrame) -> DataFrame:
    """Items as one text with an option run, and as a field with an option per line."""
    line = lambda sep, end: F.concat_ws(end, *(F.concat(F.lit(f"{x}{sep}"), F.element_at("options", x)) for x in T.LETTERS))
    return items.select("item_pos", F.concat_ws(" ", F.col("question"), line(". ", " ")).alias("run"), line(" ", "\n").alias("lines"))


RUN = "rendered as (select item_pos, bank, answer, question || ' A. ' || opts[1] || ' B. ' || opts[2] || ' C. ' || opts[3] || ' D. ' || opts[4] || ' E. ' || opts[5] as run, array_to_string(list_transform(range(1, 6), lambda i: substr('ABCDE', i::int, 1) || ' ' || opts[i]), chr(10)) as lines from items)"
MARKED = rf"(?:^|{WS})([A-E])[.．、]{WS}*"
LAST_RUN = f"""{RUN}, r0 as (select *, regexp_extract_all(run, '{MARKED}', 1) as l, regexp_extract_all(run, '{MARKED}', 0) as whole, string_split_regex(run, '{MARKED.replace('([A-E])', '[A-E]')}') as t from rendered),
  r1 as (select *, len(l)::int as n from r0),
  r2 as (select *, {TRIM.format("coalesce(array_to_string(list_transform(range(1, n - 3), lambda i: t[i] || case when i < n - 4 then whole[i] else '' end), ''), '')")} as q, list_transform(t[n - 3:], lambda x: {TRIM.format('x')}) as o from r1),
  r3 as (select *, n >= 5 and l[n - 4:] = ['A','B','C','D','E'] and q <> '' and not list_contains(o, '') as ok from r2)"""
on_items("b2_last_run", f", {LAST_RUN} select item_pos, case when ok then q end as question, case when ok then md5(o[5]) end as last_md5 from r3", lambda i: _rendered(i).select("item_pos", I.parse_last_run(F.col("run")).alias("x")).select("item_pos", "x.question", F.md5(F.element_at("x.options", "E")).alias("last_md5")))
OPENS = rf"^{WS}*([A-H])(?:{WS}+|{WS}*[.．、:：]{WS}*)(.*)$"
LINES = f"""{RUN}, n0 as (select item_pos, unnest(ls) as line, unnest(range(len(ls))) as ln from (select item_pos, string_split_regex(lines, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') as ls from rendered)),
  n1 as (select *, regexp_extract(line, '{OPENS}', 1) as s from n0 where {TRIM.format('line')} <> ''),
  n2 as (select *, {TRIM.format(f"case when s <> '' then regexp_extract(line, '{OPENS}', 2) else line end")} as t, sum((s <> '')::int) over (partition by item_pos order by ln) as seg from n1),
  n3 as (select item_pos, seg, max(s) as letter, string_agg(t, ' ' order by ln) as text from n2 where seg > 0 group by all),
  n4 as (select item_pos, count(*) as n, count(distinct letter) as d, md5(max(text) filter (letter = 'A')) as first_md5 from n3 group by item_pos)"""
on_items("b3_line_options", f", {LINES} select i.item_pos, case when n = d then n end as n, case when n = d then first_md5 end as first_md5 from items i left join n4 on n4.item_pos = i.item_pos", lambda i: I.parse_lines(_rendered(i), "item_pos", "lines").select("item_pos", F.when(F.col("options").isNotNull(), F.size("options")).alias("n"), F.md5(F.element_at("options", "A")).alias("first_md5")))


def _aligned(i: DataFrame) -> DataFrame:
    """Records of an archive map to blocks, some of which are missing, differ or do not parse."""
    n, run = F.col("item_pos"), _rendered(i)
    blocks = run.join(i.select("item_pos", "bank", "answer"), "item_pos").select("bank", n.alias("pos"), F.when(n % 13 == 0, "no options").otherwise(F.col("run")).alias("text"), F.when(n % 11 == 0, "A").otherwise(F.col("answer")).alias("answer"))
    mapping = i.filter("item_pos % 7 <> 0").select("bank", n.alias("left_pos"), n.alias("right_pos"))
    return matching.aligned_items(i, i.select("item_pos", n.alias("archive_pos")), mapping, blocks, OUT)


C8 = f", {LAST_RUN} select item_pos as sample_index, bank, q as question, md5(o[5]) as last_md5, answer, item_pos in {OUT} as excluded from r3 where ok and item_pos % 7 <> 0 and item_pos % 13 <> 0 and (item_pos % 11 <> 0 or answer = 'A')"
on_items("c8_aligned_items", C8, lambda i: _aligned(i).withColumn("last_md5", F.md5(F.element_at("options", "E"))).drop("options"))
on_items("b21_drop_excluded", f"{C8.replace(' select item_pos as sample_index', ', c8 as (select item_pos as sample_index', 1)}) select sample_index, bank, question, answer from c8 where not excluded", lambda i: matching.drop_excluded(_aligned(i)).drop("options"))
ZH = "请只回答一个字母。"
on_items("b17_prompts_zh", f"select item_pos, md5(question || chr(10) || {BLOCK} || chr(10) || chr(10) || '{ZH}') as full_md5 from items", lambda i: i.select("item_pos", F.md5(I.prompt("full", "zh")).alias("full_md5")))
query(f"with {V.OPTIONS}, {ORDER}, n as (select i.item_pos, answer, opts, list_transform(ord, lambda x: opts[x + 1]) as new from items i join o on i.item_pos = o.item_pos) select item_pos, substr('ABCDE', list_position(new, opts[ascii(answer) - 64])::int, 1) as gold_by_text from n", "b24_gold_by_text")(
    lambda s, d: _ordered(s, d).select("item_pos", T.letter_at(F.array_position(F.transform(F.array(*map(F.lit, T.LETTERS)), lambda x: F.element_at("new_options", x)), F.element_at(F.col("options"), F.col("answer"))) - 1).alias("gold_by_text"))
)
on_answers("c12_bank_lookup", "select item_pos, model, condition, 'file' || substr(bank, 5) as file from answers where bank <> 'bank7'", lambda a: R.with_file(a, {f"bank{i}": f"file{i}" for i in range(7)}).select("item_pos", "model", "condition", "file"))
on_answers("c14_second_pass", "select f.item_pos, f.model, s.pick as second from (select * from answers where condition = 'full' and pick = gold) f left join (select * from answers where condition = 'options' and pick is not null) s on s.item_pos = f.item_pos and s.model = f.model", lambda a: R.second_pass(a.filter("condition = 'full'"), a.filter("condition = 'options'")))
on_answers("h6_accept_reject", f"select model, count(*) filter ({OK}) as accepted, count(*) filter (not {OK}) as rejected from answers group by model", lambda a: R.accept_reject(a, "model"))
on_answers("g1_sorted_histogram", "select pick, n, row_number() over (order by pick nulls first) as place from (select pick, count(*) as n from answers group by pick)", lambda a: R.histogram(a, "pick").withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("pick").asc_nulls_first()))))
on_answers("g3_ordered_shares", f"select bank, round(share, 8) as share, row_number() over (order by share desc, bank) as place from (select bank, 100.0 * count(*) filter ({OK}) / count(*) as share from answers group by bank)", lambda a: rounded(R.ordered_shares(a, "bank")))
on_answers("h4_ordered_distinct", "select model, row_number() over (order by p, model) as place from (select model, min(item_pos) as p from answers group by model)", lambda a: R.first_seen(a, "model").select("model", F.row_number().over(Window.orderBy("first_pos", "model")).alias("place")))
on_items("i5_length_substring", "select item_pos, length(question) as n, substr(question, 3, 5) as part from items", lambda i: i.select("item_pos", F.length("question").alias("n"), F.substring("question", 3, 5).alias("part")))


# --- Sources and sinks: written, read back, and held against the tables ------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{V.scratch(spark)}/{name}"


def _archives(raw: DataFrame) -> DataFrame:
    """(path, content): zip archives of banks' JSON files, beside files to be skipped."""

    def zipped(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank, part = (x.as_py() for x in key)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open(f"nested/{bank}.json", "w", force_zip64=True) as f:
                f.write(b"[")
                for batch in batches:
                    for at in range(0, batch.num_rows, 512):
                        some = batch.slice(at, 512)
                        f.write("".join(json.dumps({"data": d, "label": x}) + ", " for d, x in zip(some["data"].to_pylist(), some["label"].to_pylist(), strict=True)).encode())
                f.write(b"7]")
            z.writestr("broken.json", "{")
            z.writestr("note.txt", "[]")
        yield pa.RecordBatch.from_arrays([pa.array([f"/x/part{part}_{bank}.zip"]), pa.array([out.getbuffer()], pa.binary())], names=["path", "content"])

    parts = raw.select("bank", (F.col("pos") % 4).alias("part"), "data", "label")
    return parts.groupBy("bank", "part").applyInArrow(zipped, "path string, content binary")


def _digest(records: DataFrame) -> DataFrame:
    return records.select("bank", F.md5("data").alias("data_md5"), "label")


RECORDS = "select bank, md5(data) as data_md5, label from raw"
on_raw("a2_i12_i13_zip_records", RECORDS, lambda r: _digest(readers.unzipped(_archives(r))))
on_raw("a1_load_bank", f"{RECORDS} where bank = 'src3' and pos % 4 = (select min(pos % 4) from raw where bank = 'src3')", lambda r: _digest(readers.load_bank(readers.unzipped(_archives(r)), "src3")))
on_raw("a3_from_first_archive", f"{RECORDS} where bank = (select min(bank) from raw where pos % 4 = (select min(pos % 4) from raw)) and pos % 4 = (select min(pos % 4) from raw)", lambda r: _digest(readers.from_first_archive(readers.unzipped(_archives(r)), "src0")))
FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"with {V.ITEMS} select md5({FLAT.format('question')}) as question_md5, answer from items", "a4_text_blocks")
def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "blocks")
    V.items(spark, sf_dir).select(F.concat(T.norm(F.col("question")), F.lit("\n参考答案："), F.lower("answer"), F.lit(" 解析\n"))).write.mode("overwrite").text(path)
    return readers.text_blocks(spark, path).select(F.md5("text").alias("question_md5"), "answer")


@query(f"with {V.ITEMS} select md5(question) as question_md5, md5({BLOCK}) as options_md5, answer, bank as discipline from items", "a5_csv_rows")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    rows = V.items(spark, sf_dir).select(F.col("question").alias("Question"), I.options_block(F.col("options")).alias("Options"), F.col("answer").alias("Answer"), F.col("bank").alias("Medical Discipline"))
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.csv_rows(spark, path).select(F.md5(F.coalesce("Question", F.lit(""))).alias("question_md5"), F.md5("Options").alias("options_md5"), F.col("Answer").alias("answer"), F.col("Medical Discipline").alias("discipline"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answers(spark, sf_dir).select("model", "condition", "bank", "gold", "pick", R.correct().alias("correct"), F.col("item_pos").alias("sample_index"))


ROWS = f"select model, condition, bank, gold, pick, {OK} as correct, item_pos as sample_index from answers"
READ = ["model", "condition", "bank", "gold", "pick", "correct", "sample_index"]


@query(f"with {V.ANSWERS} {ROWS}", "a6_a10_json_table")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "results.json")
    sinks.write_json(_results(spark, sf_dir), path)
    return readers.json_table(spark, path, schemas.RUN_RESULT).select(*READ)


@query(f"with {V.ANSWERS} {ROWS} where model in ('m0', 'm1')", "a7_glob_runs")
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = _folder(spark, "runs"), _results(spark, sf_dir)
    for model in ("m0", "m1"):
        sinks.write_json(rows.filter(F.col("model") == model), f"{folder}/extended_{model}.json")
    sinks.write_json(rows, f"{folder}/extended_m0_summary.json")
    sinks.write_json(rows, f"{folder}/other_m2.json")
    return readers.glob_runs(spark, folder, "extended_", schemas.RUN_RESULT).select(*READ)


@query(f"with {V.ANSWERS} {ROWS} where model = 'm2'", "a8_optional_table")
def _optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "optional")
    sinks.write_json(_results(spark, sf_dir).filter("model = 'm2'"), f"{folder}/there.json")
    both = (readers.optional_table(spark, f"{folder}/{name}.json", schemas.RUN_RESULT) for name in ("there", "missing"))
    return next(both).select(*READ).union(next(both).select(*READ))


@query("select count(distinct source) as files, (select sum(octet_length(encode(coalesce(text, ''))) + 1) from documents)::bigint as bytes from documents", "a9_non_empty_files")
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "files")
    rows = V.table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("folder"))
    rows.repartition("folder").write.mode("overwrite").partitionBy("folder").text(path)
    rows.limit(0).coalesce(1).select("text").write.mode("overwrite").text(f"{path}/folder=none")
    found = readers.non_empty_files(spark, f"{path}/*")
    return found.agg(F.countDistinct(F.regexp_extract("path", "folder=([^/]*)/", 1)).alias("files"), F.sum("length").alias("bytes"))


@query(f"with {V.ANSWERS} select model, condition, count(*) as n, count(pick) as read from answers group by all", "a11_upsert_stream")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table by micro-batches, one file each, into the upsert table."""
    folder, rows = _folder(spark, "stream"), _results(spark, sf_dir)
    rows.repartition("model").write.mode("overwrite").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    upsert.upsert_stream(source, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("model", "condition").agg(F.count("*").alias("n"), F.count("pick").alias("read"))
