"""Queries over validity and rating tables (groups K, L, M, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statelens.operators import ratings as M
from statelens.operators import stats as L
from statelens.operators import validity as K
from statelens.plans import bindings as B

C = list(B.CRITERIA)


def k1_validity_by_model_method(spark, sf):
    return K.pass_rates(B.validity(spark, sf), ["model", "method"], "syntax_valid")


def k1_strict_validity(spark, sf):
    return K.pass_rates(B.validity(spark, sf), ["model", "method"], "strict_valid")


def k2_invalid_cases(spark, sf):
    v = B.validity(spark, sf).where("not syntax_valid or not strict_valid")
    return v.select("case_id", "model", "method", F.array_join(F.array_compact(F.array(F.when(~F.col("syntax_valid"), "syntax"), F.when(~F.col("strict_valid"), "strict"))), " | ").alias("issues"))


def k3_pass_rates_by_method(spark, sf):
    return K.pass_rates(B.validity(spark, sf), ["method"], "strict_valid")


def k4_syntax_strict_join(spark, sf):
    v = B.validity(spark, sf)
    a, b = v.select("case_id", "model", "method", "syntax_valid"), v.select("case_id", "model", "method", "strict_valid")
    return a.join(b, ["case_id", "model", "method"]).withColumn("strict_valid", F.when(F.col("syntax_valid"), F.col("strict_valid")))


def _violation_counts(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), (F.col("n_chars") % 5).alias("violations"))
    return B.validity(spark, sf).where("syntax_valid").join(d, "case_id")


def k5_violation_count_summary(spark, sf):
    return K.count_summary(_violation_counts(spark, sf), ["method"], "violations")


def _kinds(spark, sf):
    rows = _violation_counts(spark, sf)
    kinds = F.filter(F.sequence(F.lit(1), F.lit(4)), lambda k: k <= F.col("violations"))
    return rows.select("method", "model", F.explode(kinds).alias("k")).select("method", "model", F.concat(F.lit("kind_"), F.col("k").cast("string")).alias("kind")), rows


def k6_violation_kinds(spark, sf):
    v, rows = _kinds(spark, sf)
    return K.kind_distribution(v, rows, ["method"])


def k7_kind_deltas(spark, sf):
    """Each model's target method against two references, over the kinds of all of them."""
    v, rows = _kinds(spark, sf)
    return K.kind_deltas(v, rows, ["model"], "method", "en", ["en", "fr", "es"])


def k8_method_filter(spark, sf):
    return B.validity(spark, sf).where(F.col("method").isin("en", "fr")).groupBy("model").agg(F.count("*").alias("n"))


def k10_dense_validity(spark, sf):
    return K.dense_rates(B.validity(spark, sf), ["model", "method"], "strict_valid")


def k10_system_types(spark, sf):
    """Rates by system type of the test cases: three types by length, every fourth case is not in the test split."""
    n = F.col("n_chars") % 3
    cases = B.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 4 == 0, "pool").otherwise("test").alias("split"), F.when(n == 0, "embedded_system").when(n == 1, "software_system").otherwise("other").alias("system_type"))
    v = B.validity(spark, sf).withColumn("method", F.when(F.col("method") == "de", "RAG [de]").otherwise(F.col("method")))
    return K.rates_by_system_type(v, cases, "strict_valid")


def k12_row_filter(spark, sf):
    v = B.validity(spark, sf).where(~F.col("model").startswith("src1") & ~F.contains("model", F.lit("9")))
    return K.pass_rates(v, ["model"], "syntax_valid")


def k14_overall_pass_rate(spark, sf):
    return K.pass_rates(B.validity(spark, sf).withColumn("pool", F.lit("all")), ["pool"], "strict_valid")


def k15_top_kinds(spark, sf):
    return K.top_kinds(k6_violation_kinds(spark, sf), 3)


def k17_valid_counts_with_total(spark, sf):
    return K.pass_rates_with_total(B.validity(spark, sf), "method", "strict_valid")


def k18_cases_per_group(spark, sf):
    return K.cases_per_group(B.validity(spark, sf), ["model", "method"], "case_id")


def _scores(spark, sf):
    return M.long_form(B.ratings(spark, sf), ["item_id", "method", "model"], C)


def l1_midranks(spark, sf):
    return L.midranks(_scores(spark, sf), ["criterion"], "score")


def l2_kruskal_wallis(spark, sf):
    return L.kruskal_wallis(_scores(spark, sf), ["criterion"], "method", "score", any_df=False)


def l3_dunn(spark, sf):
    return L.dunn(_scores(spark, sf), ["criterion"], "method", "score")


def l4_holm(spark, sf):
    t = L.kruskal_wallis(_scores(spark, sf), ["model", "criterion"], "method", "score", any_df=False)
    return L.holm(t.select("model", "criterion", "p"), ["model"], order=["criterion"])


def l5_gated_posthoc(spark, sf):
    s = _scores(spark, sf)
    return L.gated(L.dunn(s, ["criterion"], "method", "score"), L.kruskal_wallis(s, ["criterion"], "method", "score", any_df=False), ["criterion"], 0.5)


def l6_chi_square(spark, sf):
    return L.chi_square(B.validity(spark, sf), [], "method", "strict_valid")


def l7_fisher_pairs(spark, sf):
    return L.fisher_pairs(K.pass_rates(B.validity(spark, sf), ["method"], "strict_valid"), [], "method")


def l8_tails(spark, sf):
    d = L.dunn(_scores(spark, sf), ["criterion"], "method", "score").withColumn("p", F.round(L.normal_two_sided("z"), 8))
    return d.select("criterion", "group_a", "group_b", F.round("z", 9).alias("z"), "p", L.p_text(F.col("p")).alias("p_text"), L.significance(F.col("p")).alias("verdict"))


def l9_significance_text(spark, sf):
    t = L.kruskal_wallis(_scores(spark, sf), ["criterion"], "method", "score", any_df=False)
    return t.select("criterion", L.p_text(F.round("p", 8)).alias("p_text"), L.significance(F.col("p")).alias("verdict"))


def l10_battery_by_model(spark, sf):
    """All tests of the methods within each model: a rating is valid where terms fit, strictly where it is complete; its faults are counted."""
    r = B.ratings(spark, sf).select("model", "method", (F.col("terminology_alignment") >= 2).alias("syntax"), (F.col("completeness") >= 4).alias("strict"), (5 - F.col("correctness")).alias("faults"))
    t = L.battery(r, ["model"], "method", "syntax", "strict", "faults")
    return t.select("model", "metric", "test", "group_a", "group_b", F.round("statistic", 6).alias("statistic"), "df", F.round("p", 8).alias("p"), F.round("p_adjusted", 8).alias("p_adjusted"), "significant")


def m1_numeric_parse(spark, sf):
    e = B.table(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("raw"))
    return e.withColumn("score", M.as_score("raw")).groupBy("score").agg(F.count("*").alias("n"))


def m2_descriptives(spark, sf):
    return M.descriptives(_scores(spark, sf), ["method", "criterion"])


def m3_distribution(spark, sf):
    return M.distribution(_scores(spark, sf), ["method", "criterion"])


def m4_median_by_model_method(spark, sf):
    return _scores(spark, sf).groupBy("method", "model", "criterion").agg(F.count("*").alias("n"), F.median("score").alias("median"))


def m6_ratings_summary(spark, sf):
    return _scores(spark, sf).groupBy("method", "model", "criterion").agg(F.median("score").alias("median"), F.count("*").alias("responses"), F.countDistinct("item_id").alias("diagrams"))


def _pairs(spark, sf):
    return M.closest_pairs(B.ratings(spark, sf), "item_id", "rater", C)


def m7_closest_pairs(spark, sf):
    return _pairs(spark, sf)


def m8_disagreement(spark, sf):
    return M.disagreement(M.pair_scores(_pairs(spark, sf), "item_id", C), ["criterion"])


def m10_kappa(spark, sf):
    s = M.pair_scores(_pairs(spark, sf), "item_id", C)
    k = lambda w: M.kappa(s, ["criterion"], w).withColumnRenamed("kappa", f"kappa_{w}")
    return k("none").join(k("linear"), "criterion").join(k("quadratic"), "criterion")


def m12_median_of_medians(spark, sf):
    return m4_median_by_model_method(spark, sf).groupBy("method", "model").agg(F.avg("median").alias("mean_median"))


def n1_wide_table(spark, sf):
    r = K.pass_rates(B.validity(spark, sf), ["model", "method"], "strict_valid")
    r = r.withColumn("cell", K.percent_cell(F.col("valid"), F.col("total")))
    return K.wide(r, ["model"], "method", "cell", ["en", "fr", "de", "es"])


def n3_wide_to_long(spark, sf):
    w = n1_wide_table(spark, sf)
    w = w.select("model", *[F.col(c).alias(f"{c} | strict") for c in ("en", "fr", "de", "es")])
    return K.long(w, ["model"]).withColumnRenamed("model", "m").select("method", "percent", "n")


def n4_median_cells(spark, sf):
    """Medians as cells of both forms, by model, read back; blank for understandability of one method."""
    m = M.descriptives(_scores(spark, sf), ["method", "model", "criterion"])
    cell = F.when(F.col("model") == "F", K.median_cell(F.col("median"), F.col("n"))).otherwise(F.format_string("%.1f (IQR %.1f), n=%d ", "median", "iqr", "n"))
    m = m.withColumn("cell", F.when((F.col("criterion") == "understandability") & (F.col("method") == "A"), " ").otherwise(cell))
    return m.select("method", "model", "criterion", K.median_parts(F.col("cell")).alias("c")).select("method", "model", "criterion", "c.*")


def n5_preferred_order(spark, sf):
    return K.preferred(K.pass_rates(B.validity(spark, sf), ["method"], "syntax_valid"), "method", ["fr", "en"])


_R = f"with {B.VR}, s as (unpivot (select item_id, method, model, {', '.join(C)} from r) on {', '.join(C)} into name criterion value score)"
_V = f"with {B.VV}"
_RATE = "count(*) as total, count(*) filter ({f}) as valid, count(*) - count(*) filter ({f}) as invalid, 100.0 * count(*) filter ({f}) / count(*) as percent"
_KIND = f"""{_V}, c as (select v.*, d.n_chars % 5 as n from v join documents d on v.case_id = d.doc_id where v.syntax_valid),
kinds as (select method, 'kind_' || cast(k as varchar) as kind from (select method, unnest(generate_series(1, n)) as k from c)),
dist as (select method, kind, count(*) as count, any_value(total) as total, 100.0 * count(*) / any_value(total) as percent from kinds join (select method, count(*) as total from c group by 1) using (method) group by 1, 2)"""


def _ranked(by):
    keys = ", ".join(by)
    return f"""h as (select {keys}, method as grp, score, count(*) as c from s group by all),
t as (select *, sum(c) over (partition by {keys}, score) as ties, coalesce(sum(c) over (partition by {keys} order by score range between unbounded preceding and 1 preceding), 0) as before from h),
rg as (select {keys}, grp, sum(c) as n, sum((before + (ties + 1) / 2) * c) as rank_sum from t group by all),
tie as (select {keys}, sum(cast(ties as double) * ties * ties - ties) as tie_sum from (select distinct {keys}, score, ties from t) group by all),
tot as (select {keys}, sum(n) as total, count(*) as groups, sum(rank_sum * rank_sum / n) as ss from rg group by all),
kw as (select tot.*, tie_sum, (12 / (cast(total as double) * (total + 1)) * ss - 3 * (total + 1)) / (1 - tie_sum / (cast(total as double) * total * total - total)) as h from tot join tie using ({keys}))"""


_DUNN = f"""{_R}, {_ranked(["criterion"])},
d as (select a.criterion, a.grp as group_a, b.grp as group_b, (a.rank_sum / a.n - b.rank_sum / b.n) / sqrt((cast(total as double) * (total + 1) / 12 - tie_sum / (12 * (total - 1))) * (1.0 / a.n + 1.0 / b.n)) as z
from rg a join rg b on a.criterion = b.criterion and a.grp < b.grp join kw on kw.criterion = a.criterion)"""
_PAIRS = f"""with {B.VR}, p as (select a.item_id, a.rater as rater_a, b.rater as rater_b, {', '.join(f'a.{c} as {c}_a, b.{c} as {c}_b' for c in C)} from r a join r b on a.item_id = b.item_id and a.rater < b.rater),
q as (select *, row_number() over (partition by item_id order by {' + '.join(f'abs({c}_a - {c}_b)' for c in C)}, abs({' + '.join(f'({c}_a - {c}_b)' for c in C)}), greatest({', '.join(f'abs({c}_a - {c}_b)' for c in C)}), rater_a, rater_b) as rn from p),
best as (select * exclude (rn) from q where rn = 1),
ps as ({' union all '.join(f"select item_id, '{c}' as criterion, {c}_a as a, {c}_b as b from best" for c in C)})"""
_KAPPA = lambda w, n: f"""(select criterion, 1 - (select avg({w}) from ps x where x.criterion = y.criterion) / (select sum({w} * ca * cb) / sum(ca * cb) from (select a, count(*) as ca from ps x where x.criterion = y.criterion group by a), (select b, count(*) as cb from ps x where x.criterion = y.criterion group by b)) as kappa_{n} from (select distinct criterion from ps) y)"""
_FISH = f"""{_V}, c as (select method, count(*) filter (strict_valid) as valid, count(*) filter (not strict_valid) as invalid from v group by 1),
p as (select a.method as group_a, b.method as group_b, a.valid as a, a.invalid as b, b.valid as c, b.invalid as d, a.valid + a.invalid as n1, b.valid + b.invalid as n2, a.valid + b.valid as m from c a join c b on a.method < b.method),
x as (select *, unnest(generate_series(greatest(0, m - n2), least(n1, m))) as x from p),
pr as (select *, exp(lgamma(n1 + 1) + lgamma(n2 + 1) + lgamma(m + 1) + lgamma(n1 + n2 - m + 1) - lgamma(n1 + n2 + 1) - lgamma(x + 1) - lgamma(n1 - x + 1) - lgamma(m - x + 1) - lgamma(n2 - m + x + 1)) as prob from x),
ob as (select group_a, group_b, max(prob) filter (x = a) as obs from pr group by 1, 2)"""
ORACLES = {
    "k1_validity_by_model_method": f"{_V} select model, method, {_RATE.format(f='syntax_valid')} from v group by 1, 2",
    "k1_strict_validity": f"{_V} select model, method, {_RATE.format(f='strict_valid')} from v group by 1, 2",
    "k2_invalid_cases": f"{_V} select case_id, model, method, concat_ws(' | ', case when not syntax_valid then 'syntax' end, case when not strict_valid then 'strict' end) as issues from v where not syntax_valid or not strict_valid",
    "k3_pass_rates_by_method": f"{_V} select method, {_RATE.format(f='strict_valid')} from v group by 1",
    "k4_syntax_strict_join": f"{_V} select case_id, model, method, syntax_valid, case when syntax_valid then strict_valid end as strict_valid from v",
    "k5_violation_count_summary": f"{_KIND} select method, count(*) as n, avg(n) as mean, median(n) as median, max(n) as max, count(*) filter (n = 0) as zeros from c group by 1",
    "k6_violation_kinds": f"{_KIND} select * from dist",
    "k7_kind_deltas": f"""{_KIND}, cm as (select c.* from c where method in ('en', 'fr', 'es')), tt as (select model, method, count(*) as total from cm group by 1, 2), km as (select model, method, 'kind_' || k as kind, count(*) as n from (select model, method, unnest(generate_series(1, n)) as k from cm) group by 1, 2, 3),
f as (select tt.model, tt.method, x.kind, coalesce(km.n, 0) as n, total, round(100.0 * coalesce(km.n, 0) / total, 2) as share from tt cross join (select distinct kind from km) x left join km on km.model = tt.model and km.method = tt.method and km.kind = x.kind),
j as (select a.model, a.kind, a.n as target_count, a.total as target_total, a.share as target_percent, b.method as reference, b.n as reference_count, b.total as reference_total, b.share as reference_percent, round(a.share - b.share, 2) as delta from f a join f b on a.model = b.model and a.kind = b.kind where a.method = 'en' and b.method <> 'en')
select *, case when target_count = 0 and reference_count > 0 then 'eliminated_by_target' when target_count > 0 and reference_count = 0 then 'introduced_by_target' when delta < 0 then 'mitigated_by_target' when delta > 0 then 'increased_by_target' else 'unchanged' end as status from j""",
    "k10_system_types": f"""{_V}, x as (select v.*, case d.n_chars % 3 when 0 then 'embedded_system' when 1 then 'software_system' end as t, d.doc_id % 4 <> 0 as test from v join documents d on d.doc_id = v.case_id where method <> 'de'),
n as (select model, method, t, count(*) as total, count(*) filter (strict_valid) as valid from x where test and t is not null group by 1, 2, 3)
select m.model, h.method, y.t as system_type, coalesce(total, 0) as total, coalesce(valid, 0) as valid, coalesce(total - valid, 0) as invalid, coalesce(round(100.0 * valid / total, 2), 0.0) as percent
from (select distinct model from x) m cross join (select distinct method from x) h cross join (values ('embedded_system'), ('software_system')) y(t) left join n on n.model = m.model and n.method = h.method and n.t = y.t""",
    "k8_method_filter": f"{_V} select model, count(*) as n from v where method in ('en', 'fr') group by 1",
    "k10_dense_validity": f"""{_V}, a as (select model, method, {_RATE.format(f='strict_valid')} from v group by 1, 2)
select m.model, t.method, coalesce(total, 0) as total, coalesce(valid, 0) as valid, coalesce(invalid, 0) as invalid, coalesce(percent, 0) as percent from (select distinct model from v) m cross join (select distinct method from v) t left join a using (model, method)""",
    "k12_row_filter": f"{_V} select model, {_RATE.format(f='syntax_valid')} from v where not starts_with(model, 'src1') and not contains(model, '9') group by 1",
    "k14_overall_pass_rate": f"{_V} select 'all' as pool, {_RATE.format(f='strict_valid')} from v",
    "k15_top_kinds": f"{_KIND} select kind, cast(sum(count) as bigint) as count from dist group by 1 order by 2 desc, 1 limit 3",
    "k17_valid_counts_with_total": f"{_V} select case when grouping(method) = 1 then 'TOTAL' else method end as method, count(*) as total, count(*) filter (strict_valid) as valid from v group by rollup (method)",
    "k18_cases_per_group": f"{_V} select model, method, case_id // 1000 as part, count(*) as n, string_agg(cast(case_id as varchar), ', ' order by case_id) as cases from v group by 1, 2, 3",
    "l1_midranks": f"{_R}, h as (select criterion, score, count(*) as ties from s group by 1, 2) select criterion, score, ties, coalesce(sum(ties) over (partition by criterion order by score rows between unbounded preceding and 1 preceding), 0) + (ties + 1) / 2 as midrank from h",
    "l2_kruskal_wallis": f"{_R}, {_ranked(['criterion'])} select criterion, groups, cast(total as bigint) as n, h, groups - 1 as df, exp(-h / 2) as p from kw",
    "l3_dunn": f"{_DUNN} select * from d",
    "l4_holm": f"""{_R}, {_ranked(["model", "criterion"])}, p as (select model, criterion, exp(-h / 2) as p from kw), a as (select *, least(1.0, p * (count(*) over (partition by model) - row_number() over (partition by model order by p, criterion) + 1)) as a from p)
select model, criterion, p, max(a) over (partition by model order by p, criterion rows unbounded preceding) as p_holm from a""",
    "l5_gated_posthoc": f"{_DUNN} select * from d where criterion in (select criterion from kw where exp(-h / 2) < 0.5)",
    "l6_chi_square": f"""{_V}, c as (select method, strict_valid, count(*) as o from v group by 1, 2), t as (select sum(o) as n from c), r as (select method, sum(o) as r from c group by 1), k as (select strict_valid, sum(o) as k from c group by 1)
select sum((coalesce(o, 0) - r * k / n) * (coalesce(o, 0) - r * k / n) / (r * k / n)) as chi2, (count(distinct r.method) - 1) * (count(distinct k.strict_valid) - 1) as df, cast(any_value(n) as bigint) as n from r cross join k cross join t left join c using (method, strict_valid)""",
    "l7_fisher_pairs": f"""{_FISH} select group_a, group_b, case when any_value(b * c) = 0 then case when any_value(a * d) = 0 then 0.0 else 'inf'::double end else any_value(a * d) / any_value(b * c) end as odds_ratio, least(1.0, sum(prob) filter (prob <= obs + 1e-12)) as p from pr join ob using (group_a, group_b) group by 1, 2""",
    "m1_numeric_parse": "select cast(trunc(try_cast(case when event_id % 7 = 0 then 'n/a' else cast(value as varchar) end as double)) as int) as score, count(*) as n from events group by 1",
    "m2_descriptives": f"{_R} select method, criterion, count(*) as n, quantile_cont(score, 0.5) as median, avg(score) as mean, quantile_cont(score, 0.25) as q1, quantile_cont(score, 0.75) as q3, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) as iqr, {', '.join(f'count(*) filter (score = {i}) as score_{i}_count' for i in range(1, 6))} from s group by 1, 2",
    "m3_distribution": f"{_R} select g.method, g.criterion, cast(x.score as int) as score, count(s.score) as count, any_value(g.n) as n, 100.0 * count(s.score) / any_value(g.n) as percent from (select method, criterion, count(*) as n from s group by 1, 2) g cross join (select unnest(generate_series(1, 5)) as score) x left join s on s.method = g.method and s.criterion = g.criterion and s.score = x.score group by 1, 2, 3",
    "m4_median_by_model_method": f"{_R} select method, model, criterion, count(*) as n, median(score) as median from s group by 1, 2, 3",
    "m6_ratings_summary": f"{_R} select method, model, criterion, median(score) as median, count(*) as responses, count(distinct item_id) as diagrams from s group by 1, 2, 3",
    "m7_closest_pairs": f"{_PAIRS} select * from best",
    "m8_disagreement": f"""{_PAIRS} select criterion, count(*) as n, avg(a) as mean_a, avg(b) as mean_b, avg(abs(a - b)) as mean_abs_diff, avg(case when abs(a - b) >= 2 then 1.0 else 0.0 end) as share_2,
case when sqrt((var_samp(a) + var_samp(b)) / 2) = 0 then 0.0 else (avg(a) - avg(b)) / sqrt((var_samp(a) + var_samp(b)) / 2) end as cohens_d, case when stddev_samp(a - b) = 0 then 0.0 else avg(a - b) / stddev_samp(a - b) end as d_z from ps group by 1""",
    "m10_kappa": f"{_PAIRS} select * from {_KAPPA('cast(a <> b as int)', 'none')} join {_KAPPA('abs(a - b) / 4', 'linear')} using (criterion) join {_KAPPA('((a - b) / 4) * ((a - b) / 4)', 'quadratic')} using (criterion)",
    "m12_median_of_medians": f"{_R} select method, model, avg(m) as mean_median from (select method, model, criterion, median(score) as m from s group by 1, 2, 3) group by 1, 2",
    "n1_wide_table": f"""{_V}, c as (select model, method, printf('%.2f%% (n=%d/%d)', 100.0 * count(*) filter (strict_valid) / count(*), count(*) filter (strict_valid), count(*)) as cell from v group by 1, 2)
select model, {', '.join(f"max(cell) filter (method = '{m}') as {m}" for m in ("en", "fr", "de", "es"))} from c group by 1""",
    "n3_wide_to_long": f"{_V} select method, round(100.0 * count(*) filter (strict_valid) / count(*), 2) as percent, cast(count(*) filter (strict_valid) as double) as n from v group by model, method",
    "n4_median_cells": f"{_R} select method, model, criterion, case when criterion = 'understandability' and method = 'A' then null else median(score) end as median, case when criterion = 'understandability' and method = 'A' then null else count(*) end as n from s group by 1, 2, 3",
    "n5_preferred_order": f"{_V} select method, {_RATE.format(f='syntax_valid')} from v group by 1",
}
#: Two-sided normal tail by Simpson's rule over twelve deviations.
_TAIL = "2 * list_sum(list_transform(range(0, 4001), lambda i: case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end * exp(-pow(abs(z) + i * 0.003::double, 2) / 2))) * 0.001::double / sqrt(2 * pi())"
_PTEXT = "case when {p} < 1e-8 then '<1e-8' else regexp_replace(regexp_replace(printf('%.8f', {p}), '0+$', ''), '[.]$', '') end"
_VERDICT = "case when {p} < 0.05 then 'significant' else 'not significant' end"
ORACLES["l8_tails"] = f"{_DUNN}, dp as (select *, round({_TAIL}, 8) as p from d) select criterion, group_a, group_b, round(z, 9) as z, p, {_PTEXT.format(p='p')} as p_text, {_VERDICT.format(p='p')} as verdict from dp"
_LB = f"""with {B.VR}, b as (select model, method as grp, terminology_alignment >= 2 as syn, completeness >= 4 as strict, 5 - correctness as score from r), s as (select model, grp as method, score from b where syn), {_ranked(['model'])},
fl as (select model, 'syntax validity' as metric, grp, syn as ok from b union all select model, 'structural validity', grp, strict from b where syn),
c as (select model, metric, grp, count(*) filter (ok) as v, count(*) filter (not ok) as i from fl group by 1, 2, 3), ct as (select model, metric, sum(v) as tv, sum(i) as ti, count(*) as k from c group by 1, 2),
ch as (select model, metric, sum((v - (v + i) * tv / (tv + ti)) * (v - (v + i) * tv / (tv + ti)) / nullif((v + i) * tv / (tv + ti), 0)) + sum((i - (v + i) * ti / (tv + ti)) * (i - (v + i) * ti / (tv + ti)) / nullif((v + i) * ti / (tv + ti), 0)) as x, any_value(k) - 1 as df from c join ct using (model, metric) group by 1, 2),
fp as (select a.model, a.metric, a.grp as group_a, b.grp as group_b, a.v as a, a.i as b, b.v as c, b.i as d, a.v + a.i as n1, b.v + b.i as n2, a.v + b.v as m from c a join c b on a.model = b.model and a.metric = b.metric and a.grp < b.grp),
fx as (select *, unnest(generate_series(greatest(0, m - n2), least(n1, m))) as x from fp),
fr as (select *, exp(lgamma(n1 + 1) + lgamma(n2 + 1) + lgamma(m + 1) + lgamma(n1 + n2 - m + 1) - lgamma(n1 + n2 + 1) - lgamma(x + 1) - lgamma(n1 - x + 1) - lgamma(m - x + 1) - lgamma(n2 - m + x + 1)) as prob from fx),
fo as (select model, metric, group_a, group_b, max(prob) filter (x = a) as obs from fr group by 1, 2, 3, 4),
fe as (select model, metric, group_a, group_b, any_value(a * d) / nullif(any_value(b * c), 0) as odds, least(1.0, sum(prob) filter (prob <= obs + 1e-12)) as p from fr join fo using (model, metric, group_a, group_b) group by 1, 2, 3, 4),
dz as (select a.model, a.grp as group_a, b.grp as group_b, (a.rank_sum / a.n - b.rank_sum / b.n) / sqrt((cast(total as double) * (total + 1) / 12 - tie_sum / (12 * (total - 1))) * (1.0 / a.n + 1.0 / b.n)) as z from rg a join rg b on a.model = b.model and a.grp < b.grp join kw on kw.model = a.model),
dp as (select *, {_TAIL} as p from dz), dh as (select *, least(1.0, p * (count(*) over (partition by model) - row_number() over (partition by model order by p, group_a, group_b) + 1)) as q from dp),
da as (select *, max(q) over (partition by model order by p, group_a, group_b rows unbounded preceding) as pa from dh)"""
ORACLES["l10_battery_by_model"] = f"""{_LB} select model, metric, 'chi-squared' as test, null as group_a, null as group_b, round(x, 6) as statistic, df, round(exp(-x / 2), 8) as p, null::double as p_adjusted, exp(-x / 2) < 0.05 as significant from ch
union all select model, 'violation count', 'Kruskal-Wallis', null, null, round(h, 6), groups - 1, round(exp(-h / 2), 8), null, exp(-h / 2) < 0.05 from kw
union all select model, metric, 'exact pair', group_a, group_b, round(odds, 6), null, round(p, 8), null, p < 0.05 from fe
union all select model, 'violation count', 'Dunn pair', group_a, group_b, round(z, 6), null, round(p, 8), round(pa, 8), pa < 0.05 from da"""
ORACLES["l9_significance_text"] = f"{_R}, {_ranked(['criterion'])} select criterion, {_PTEXT.format(p='round(exp(-h / 2), 8)')} as p_text, {_VERDICT.format(p='exp(-h / 2)')} as verdict from kw"
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "klmn" and n[1:2].isdigit()}
