"""Every query by name, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veristrata.functions import text as T
from veristrata.operators import assertion, cluster, conformal, gates, matching, provenance, retrieval, rouge, runlog, sample, segment, stats

from veristrata.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ALPHAS = [0.05, 0.1, 0.2]
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
# SQL pieces
LOOSE = r"trim(regexp_replace(regexp_replace(lower(text), '\[\*\*[^\]]+\*\*\]', ' ', 'g'), '[^a-z0-9.]+', ' ', 'g'))"
EXACT = r"trim(regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g'))"
TOKENS = rf"list_filter(list_transform(string_split({LOOSE}, ' '), lambda t: case when regexp_full_match(t, '\d+(\.\d+)?') then t else regexp_replace(t, '\.+$', '') end), lambda t: length(t) >= 3 and t not in ({STOPS}))"
WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?')"
SCORED = "scored as (select doc_id, lang, source, n_chars, least(1.0::double, n_chars / 5000.0::double) as score, quality = 1 as ok, toxic = 1 as tox from documents join labels using (doc_id))"
WILSON = lambda h, n: (f"round(({h}/{n}::double + 1.96*1.96/(2*{n}) - 1.96*sqrt(({h}/{n}::double)*(1-{h}/{n}::double)/{n} + 1.96*1.96/(4.0*{n}*{n})))/(1+1.96*1.96/{n}),4)", f"round(({h}/{n}::double + 1.96*1.96/(2*{n}) + 1.96*sqrt(({h}/{n}::double)*(1-{h}/{n}::double)/{n} + 1.96*1.96/(4.0*{n}*{n})))/(1+1.96*1.96/{n}),4)")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", "n_chars", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"), (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("tox"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as (conv_id, source: user turns, note: assistant turns)."""
    turns = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns("user").alias("source"), turns("assistant").alias("note"))


NOTES = "notes as (select conv_id, coalesce(string_agg(text, chr(10) order by turn) filter (role = 'user'), '') as source, coalesce(string_agg(text, chr(10) order by turn) filter (role = 'assistant'), '') as note from conversations group by conv_id)"
SHARED = f"i as (select item_id, unnest(list_distinct({TOKENS})) as token from benchmark), d as (select doc_id, unnest(list_distinct({TOKENS})) as token from documents), k as (select item_id, count(*) as n_tokens from i group by 1), s as (select item_id, doc_id, count(*) as shared from i join d using (token) group by 1, 2)"


@query(f"select item_id, doc_id from (select item_id, {EXACT} as q from benchmark) join (select doc_id, {EXACT} as t from documents) on contains(t, q)")
def q_exact_quote(spark, d):
    return provenance.contained(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query(f"select item_id, doc_id from (select item_id, {LOOSE} as q from benchmark) join (select doc_id, {LOOSE} as t from documents) on contains(t, q)")
def q_norm_quote(spark, d):
    return provenance.contained(table(spark, d, "benchmark"), table(spark, d, "documents"), T.normal_loose)


@query(f"with {SHARED} select item_id, doc_id, shared, n_tokens, round(shared / n_tokens::double, 6) as coverage from s join k using (item_id) qualify row_number() over (partition by item_id order by shared desc, doc_id) = 1")
def q_token_coverage_top1(spark, d):
    from pyspark.sql import Window

    near = provenance.shared_tokens(table(spark, d, "benchmark"), table(spark, d, "documents"))
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("shared").desc(), "doc_id"))).filter("r = 1")
    return top.select("item_id", "doc_id", "shared", "n_tokens", F.round(F.col("shared") / F.col("n_tokens"), 6).alias("coverage"))


TAXONOMY = f"""with {SHARED}, best as (select item_id, doc_id as top_doc, shared / n_tokens::double as coverage from s join k using (item_id) qualify row_number() over (partition by item_id order by shared / n_tokens::double desc, doc_id) = 1),
x as (select item_id, min(doc_id) as x_doc from (select item_id, {EXACT} as q from benchmark) join (select doc_id, {EXACT} as t from documents) on contains(t, q) group by 1),
l as (select item_id, min(doc_id) as l_doc from (select item_id, {LOOSE} as q from benchmark) join (select doc_id, {LOOSE} as t from documents) on contains(t, q) group by 1),
items as (select item_id, case when x_doc is not null then 'exact' when l_doc is not null then 'normalized' when coverage >= 0.92 then 'noncontiguous' when coverage >= 0.72 then 'pointer_drift' when coverage >= 0.45 then 'weak_overlap' else 'low_overlap' end as category, coalesce(coverage, 0) as coverage, coalesce(x_doc, l_doc, top_doc) as doc_id from benchmark left join best using (item_id) left join x using (item_id) left join l using (item_id))"""


@query(f"{TAXONOMY}, c as (select category, count(*) as items, sum(count(*)) over () as total from items group by 1) select category, items, round(items / total::double, 6) as rate, {WILSON('items', 'total')[0]} as low, {WILSON('items', 'total')[1]} as high from c")
def q_miss_taxonomy(spark, d):
    return provenance.summarise(provenance.miss_taxonomy(table(spark, d, "benchmark"), table(spark, d, "documents")))


@query(f"{TAXONOMY} select item_id, category, round(coverage, 6) as coverage, doc_id from items")
def q_miss_items(spark, d):
    return provenance.miss_taxonomy(table(spark, d, "benchmark"), table(spark, d, "documents")).withColumn("coverage", F.round("coverage", 6))


@query(f"with w as (select doc_id, source, quality = 1 as ok, len({WORDS}) as words from documents join labels using (doc_id)), c as (select case when words < 1000 then '<1000' when words < 2000 then '1000-1999' when words < 4000 then '2000-3999' else '4000+' end as bucket, source, bool_and(ok) as gate, count(*) as items, count(*) filter (ok) as passed from w group by 1, 2) select bucket, count(*) as cases, sum(items)::bigint as items, sum(passed)::bigint as passed, count(*) filter (gate) as gated_cases from c group by 1")
def q_case_gate_buckets(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("ok"), provenance.word_bucket(F.size(T.word_tokens(F.col("text")))).alias("bucket"))
    return provenance.gate_rates(rows, "bucket", "source", "ok")


@query(f"with g as (select lang, source, count(*) as n, count(*) filter (quality = 1) as good from documents join labels using (doc_id) group by rollup (lang, source)) select lang, source, n, good, {WILSON('good', 'n')[0]} as low, {WILSON('good', 'n')[1]} as high from g")
def q_lang_source_rollup(spark, d):
    g = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    low, high = T.wilson(F.col("good"), F.col("n"))
    return g.select("lang", "source", "n", "good", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query(r"with l as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(x, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')), lambda x: x <> '') as x from documents), u as (select doc_id, unnest(range(1, len(x) + 1)) as o, x from l) select doc_id, o::int as ordinal, 'L' || right('0000' || o, greatest(4, length(o::varchar))) as line_id, length(x[o])::int as chars from u")
def q_line_index(spark, d):
    return segment.line_index(table(spark, d, "documents")).select("doc_id", "ordinal", "line_id", F.length("text").alias("chars"))


@query(r"select doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?;:\n]+[.!?;:]*'), lambda s: trim(s)), lambda s: s <> ''))::int as sentences from documents")
def q_sentence_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(segment.sentences(F.col("text"))).alias("sentences"))


@query(f"with w as (select {WORDS} as w from documents), g as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from w) select gram, count(*) as n from g group by 1 order by n desc, gram limit 50")
def q_ngram_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(T.ngrams(T.word_tokens(F.col("text")), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "gram").limit(50)


@query("select doc_id, ceil(length(text) / 4.0)::bigint as tokens, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::int as words, len(regexp_extract_all(text, '[0-9]+'))::int as numbers, len(regexp_extract_all(text, chr(10)))::int as line_breaks, len(regexp_extract_all(text, '[A-Z]'))::int as upper, len(regexp_extract_all(text, '[.!?]'))::int as stops, len(regexp_extract_all(text, '[|]'))::int as bars, length(text) > 15000 as is_long, length(text) < 2500 as is_sparse from documents")
def q_density_features(spark, d):
    return segment.density(table(spark, d, "documents"))


@query(r"""with f as (select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::int as note_words, len(regexp_extract_all(text, '(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|units?|ml|meq)\b'))::int as dose_mentions, regexp_matches(text, '(?i)laborator|pertinent results') as has_lab_section, regexp_matches(text, '(?i)procedure|operations?') as has_procedure_section, len(regexp_extract_all(text, '\[\*\*'))::int as deidentification_markers, len(regexp_extract_all(text, '\b\d+(?:\.\d+)?\b'))::int as numeric_tokens from documents),
r as (select *, array_to_string(list_filter([case when note_words >= 1800 then 'note_words>=1800' end, case when dose_mentions >= 18 then 'dose_mentions>=18' end, case when note_words >= 1200 and has_lab_section and has_procedure_section then 'note_words>=1200+lab_section+procedure_section' end], lambda x: x is not null), ';') as reasons from f) select *, case when reasons <> '' then 'two_stage_complex' else 'single_stage_standard' end as route from r""")
def q_complexity_route(spark, d):
    return segment.complexity(table(spark, d, "documents"))


CLUSTERED = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\[\*\*.*?\*\*\]', ' [deid] ', 'g'), '\d+(\.\d+)?', '#', 'g'), '[^a-z#]+', ' ', 'g'))"


@query(f"select sha256({CLUSTERED}) as digest, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def q_dup_exact(spark, d):
    return cluster.exact_groups(table(spark, d, "documents"))


BITS = " + ".join(f"(case when 2 * coalesce(sum((h >> {b}) & 1), 0) >= count(h) then {1 << b}::hugeint else 0 end)" for b in range(64))
SIMHASH = f"""w as (select doc_id, list_filter(string_split({CLUSTERED}, ' '), lambda x: x <> '') as w from documents), k as (select doc_id, w, greatest(len(w) - 2, 0) as k from w),
g as (select doc_id, unnest(case when k > 0 then range(1, k + 1) else [null] end) as i, w from k), h as (select doc_id, case when i is not null then ('0x' || substr(sha256(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 16))::ubigint end as h from g),
fp as (select doc_id, coalesce({BITS}, 0)::hugeint as u from h group by 1), p as (select doc_id, u from fp)"""


@query(f"with {SIMHASH} select doc_id, (case when u >= 9223372036854775808 then u - 18446744073709551616 else u end)::bigint as fp from p")
def q_simhash(spark, d):
    return cluster.simhash(table(spark, d, "documents"))


PAIRS = f"""with {SIMHASH}, near as (select x.doc_id as a, y.doc_id as b, bit_count(xor(x.u::ubigint, y.u::ubigint))::int as distance from p x join p y on x.doc_id < y.doc_id where bit_count(xor(x.u::ubigint, y.u::ubigint)) <= 10)"""


@query(f"{PAIRS} select * from near")
def q_simhash_pairs(spark, d):
    return cluster.hamming_pairs(cluster.simhash(table(spark, d, "documents")))


@query(f"{PAIRS.replace('with w as', 'with recursive w as', 1)}, e as (select a, b from near union select b, a from near), r(id, root) as (select a, a from e union select e.b, r.root from r join e on e.a = r.id) select id as doc_id, min(root) as cluster_id from r group by 1")
def q_dup_clusters(spark, d):
    near = cluster.near_clusters(cluster.simhash(table(spark, d, "documents")))
    return near.select(F.col("id").alias("doc_id"), F.col("root").alias("cluster_id"))


@query(
    f"""with w as (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(lower(text), '\\[\\*\\*.*?\\*\\*\\]', ' ', 'g'), '[^a-z0-9%./+-]+', ' ', 'g'), ' '), lambda t: length(t) >= 3 and t not in ({", ".join(f"'{w}'" for w in cluster.COMMON)})) as w from documents),
t as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) as token from w), tf as (select doc_id, token, count(*) as tf from t group by 1, 2), n as (select count(*) as n from documents), df as (select token, count(*) as df, any_value(n) as n from tf, n group by 1 having count(*) >= 3 and count(*) <= 0.85 * any_value(n) order by df desc, token limit 5000),
x as (select doc_id, token, round((1 + ln(tf)) * (ln((1.0::double + n) / (1 + df)) + 1), 6) as weight from tf join df using (token)) select doc_id, row_number() over (partition by doc_id order by weight desc, token)::int as rank, token, weight from x qualify rank <= 5"""
)
def q_tfidf_top(spark, d):
    return cluster.tfidf_top(table(spark, d, "documents"))


CRC = f"with {SCORED}, a as (select unnest([0.05, 0.1, 0.2])::double as alpha), c as (select 0.0::double as l union select distinct score from scored), r as (select l, (select count(*) from scored where score >= l and not ok) as loss, (select count(*) from scored) as n from c), t as (select alpha, coalesce(min(l) filter ((loss + 1.0::double) / (n + 1) <= alpha), 1 + 1e-9::double) as threshold from a, r group by 1)"


@query(f"{CRC} select alpha, threshold from t")
def q_crc_threshold(spark, d):
    return conformal.crc_threshold(scored(spark, d), "score", F.col("ok"), ALPHAS)


@query(f"{CRC} select alpha, count(*) as n, count(*) filter (score >= threshold) as accepted, round(count(*) filter (score >= threshold and not ok) / count(*)::double, 6) as risk, round(count(*) filter (score >= threshold) / count(*)::double, 6) as coverage, round(count(*) filter (score >= threshold and ok) / nullif(count(*) filter (ok), 0)::double, 6) as recall, round(count(*) filter (score >= threshold and not ok) / nullif(count(*) filter (score >= threshold), 0)::double, 6) as fdr from scored, t group by 1")
def q_crc_eval(spark, d):
    rows = scored(spark, d)
    return conformal.crc_evaluate(rows, "score", F.col("ok"), conformal.crc_threshold(rows, "score", F.col("ok"), ALPHAS))


PVALUES = f"with {SCORED}, m as (select doc_id, score, substr(sha256('split:' || doc_id), 1, 1) < '8' and not ok as is_null, substr(sha256('split:' || doc_id), 1, 1) >= '8' as is_test from scored), p as (select doc_id, score, (1.0::double + (select count(*) from m z where z.is_null and z.score >= m.score)) / ((select count(*) from m where is_null) + 1) as p from m where is_test)"


def _tests(spark, d):
    calibration = F.substring(F.sha2(F.concat(F.lit("split:"), F.col("doc_id").cast("string")), 256), 1, 1) < "8"
    rows = scored(spark, d).withColumn("cal", calibration).filter(~(F.col("cal") & F.col("ok")))
    return conformal.p_values(rows, "doc_id", "score", F.col("cal"))


@query(f"{PVALUES} select doc_id, round(p, 9) as p from p")
def q_conformal_pvalues(spark, d):
    return _tests(spark, d).select("doc_id", F.round("p", 9).alias("p"))


@query(f"{PVALUES}, k as (select *, row_number() over (order by p) as k, count(*) over () as m from p), c as (select max(p) as cut from k where p <= 0.9 * k / m) select doc_id, coalesce(p <= cut, false) as selected from p, c")
def q_bh_select(spark, d):
    return conformal.benjamini_hochberg(_tests(spark, d), "doc_id", 0.9).select("doc_id", "selected")


@query(f"with {SCORED}, k as (select lang, score, row_number() over (partition by lang order by score) as k, count(*) over (partition by lang) as n from scored) select lang, max(n) as n, coalesce(max(score) filter (k = ceil((n + 1) * 0.9::double - 1e-9)), 'infinity'::double) as q from k group by 1")
def q_mondrian_quantiles(spark, d):
    return conformal.quantiles(scored(spark, d), "score", 0.1, ["lang"])


@query(f"with {SCORED}, g as (select unnest([lang, source, case when n_chars > 15000 then 'long' when n_chars < 2500 then 'sparse' else 'middle' end]) as grp, score from scored), k as (select grp, score, row_number() over (partition by grp order by score) as k, count(*) over (partition by grp) as n from g) select grp, max(n) as n, coalesce(max(score) filter (k = ceil((n + 1) * 0.9::double - 1e-9)), 'infinity'::double) as q from k group by 1 having max(n) >= 20")
def q_group_conformal(spark, d):
    size = F.when(F.col("n_chars") > 15000, "long").when(F.col("n_chars") < 2500, "sparse").otherwise("middle")
    return conformal.quantiles(scored(spark, d).select(F.explode(F.array("lang", "source", size)).alias("grp"), "score"), "score", 0.1, ["grp"]).filter("n >= 20")


@query(f"with {SCORED}, r as (select ok, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from scored) select count(*) filter (ok) as positives, count(*) filter (not ok) as negatives, round((sum(r) filter (ok) - count(*) filter (ok) * (count(*) filter (ok) + 1) / 2.0::double) / (count(*) filter (ok) * count(*) filter (not ok)), 6) as auc from r")
def q_auc(spark, d):
    return stats.auc(scored(spark, d), "score", F.col("ok"))


@query(f"with {SCORED}, f as (select ok, unnest([{{'feature': 'english', 'x': lang = 'en'}}, {{'feature': 'long', 'x': n_chars > 15000}}, {{'feature': 'sparse', 'x': n_chars < 2500}}, {{'feature': 'toxic', 'x': tox}}], recursive := true) from scored), t as (select feature, count(*) filter (x and ok) as n11, count(*) filter (x and not ok) as n10, count(*) filter (not x and ok) as n01, count(*) filter (not x and not ok) as n00 from f group by 1) select *, round((n11::double * n00 - n10::double * n01) / nullif(sqrt((n11 + n10)::double * (n01 + n00) * (n11 + n01) * (n10 + n00)), 0), 6) as phi, round(n11 / nullif(n11 + n10, 0)::double - n01 / nullif(n01 + n00, 0)::double, 6) as risk_difference, round((n11 + 0.5::double) * (n00 + 0.5) / ((n10 + 0.5::double) * (n01 + 0.5)), 6) as odds_ratio from t")
def q_feature_association(spark, d):
    return stats.association(scored(spark, d), {"english": F.col("lang") == "en", "long": F.col("n_chars") > 15000, "sparse": F.col("n_chars") < 2500, "toxic": F.col("tox")}, F.col("ok"))


@query(f"with {SCORED}, c as (select score, sum(count(*)) over w as n, sum(count(*) filter (not ok)) over w as bad from scored group by score window w as (order by score)) select max(score) filter (bad <= 0.15 * n) as threshold, max(n) filter (bad <= 0.15 * n)::bigint as accepted from c")
def q_risk_threshold(spark, d):
    return conformal.risk_threshold(scored(spark, d), "score", ~F.col("ok"), 0.15)


@query(f"with {SCORED}, p as (select ok, unnest([{{'policy': '0 all', 'x': true}}, {{'policy': '1 not toxic', 'x': not tox}}, {{'policy': '2 and not sparse', 'x': not tox and n_chars >= 500}}, {{'policy': '3 and english', 'x': not tox and n_chars >= 500 and lang = 'en'}}], recursive := true) from scored) select policy, count(*) as n, count(*) filter (x) as accepted, count(*) filter (x and not ok) as unsafe_accepted, round(count(*) filter (x and not ok) / nullif(count(*) filter (x), 0)::double, 6) as risk from p group by 1")
def q_policy_ablation(spark, d):
    own = ~F.col("tox")
    rules = {"0 all": F.lit(True), "1 not toxic": own, "2 and not sparse": own & (F.col("n_chars") >= 500), "3 and english": own & (F.col("n_chars") >= 500) & (F.col("lang") == "en")}
    p = scored(spark, d).select("ok", F.explode(F.array(*(F.struct(F.lit(k).alias("policy"), v.alias("x")) for k, v in rules.items()))).alias("p")).select("ok", "p.*")
    return p.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count_if("x").alias("accepted"), F.count_if(F.col("x") & ~F.col("ok")).alias("unsafe_accepted")).withColumn("risk", F.round(T.ratio(F.col("unsafe_accepted"), F.col("accepted")), 6))


RATERS = "with r as (select quality as gold, case when contains(text, '!!') or contains(text, '|') or contains(text, '###') then 0 else 1 end as predicted from documents join labels using (doc_id))"


def _raters(spark, d):
    rule = F.when(F.col("text").contains("!!") | F.col("text").contains("|") | F.col("text").contains("###"), 0).otherwise(1)
    return table(spark, d, "documents").select("doc_id", rule.alias("predicted")).join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("gold"), "predicted")


@query(f"{RATERS} select gold, predicted, count(*) as n from r group by 1, 2")
def q_confusion(spark, d):
    return stats.confusion(_raters(spark, d), F.col("gold"), F.col("predicted"))


@query(f"{RATERS}, l as (select unnest([0, 1]) as label), t as (select label, (select count(*) from r where gold = label and predicted = label) as tp, (select count(*) from r where gold = label) as gold_n, (select count(*) from r where predicted = label) as pred_n from l) select *, round(coalesce(tp / nullif(pred_n, 0)::double, 0), 6) as precision, round(coalesce(tp / nullif(gold_n, 0)::double, 0), 6) as recall, round(coalesce(2 * tp / nullif(pred_n + gold_n, 0)::double, 0), 6) as f1 from t")
def q_class_scores(spark, d):
    return stats.class_scores(stats.confusion(_raters(spark, d), F.col("gold"), F.col("predicted")))


@query(f"{RATERS}, t as (select count(*) as n, count(*) filter (gold = 1 and predicted = 1) as n_both, count(*) filter (gold = 1 and predicted = 0) as first, count(*) filter (gold = 0 and predicted = 1) as second, count(*) filter (gold = 0 and predicted = 0) as neither from r), p as (select *, (n_both + neither) / n::double as ra, ((n_both + first) / n::double + (n_both + second) / n::double) / 2 as pi from t) select n, n_both, first, second, neither, round(ra, 6) as raw, round(2 * n_both / nullif(2 * n_both + first + second, 0)::double, 6) as positive, round(2 * neither / nullif(2 * neither + first + second, 0)::double, 6) as negative, round((ra - 2 * pi * (1 - pi)) / (1 - 2 * pi * (1 - pi)), 6) as ac1 from p")
def q_agreement_ac1(spark, d):
    return stats.agreement(_raters(spark, d), F.col("gold") == 1, F.col("predicted") == 1)


@query("with w as (select user_id, avg(value) filter (event_type = 'view') as a, avg(value) filter (event_type = 'click') as b from events where event_type in ('view', 'click') group by 1) select count(*) as cases, round(avg(b - a), 4) as mean_delta, round(avg(b - a) - 1.96 * stddev_samp(b - a) / sqrt(count(*)), 4) as low, round(avg(b - a) + 1.96 * stddev_samp(b - a) / sqrt(count(*)), 4) as high from w where a is not null and b is not null")
def q_paired_contrast(spark, d):
    return stats.paired(table(spark, d, "events"), "user_id", "event_type", "value", "view", "click")


@query(f"with t as (select event_type, count(*) as n, count(*) filter (value > 150) as failed, avg(value) as m from events group by 1) select event_type, n, failed, round((n - failed) / n::double, 6) as completion, {WILSON('(n - failed)', 'n')[0]} as low, {WILSON('(n - failed)', 'n')[1]} as high, round(m, 4) as mean_value from t")
def q_runlog_summary(spark, d):
    return runlog.summary(table(spark, d, "events"), "event_type", "value", F.col("value") > 150)


@query("with k as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events) select event_type, max(value) filter (k = ceil(n * 0.5::double)) as p50, max(value) filter (k = ceil(n * 0.9::double)) as p90 from k group by 1")
def q_runlog_percentiles(spark, d):
    return runlog.percentiles(table(spark, d, "events"), "event_type", "value")


@query("select l_orderkey, l_linenumber, l_partkey, round(l_quantity * p_retailprice / 1e6, 9) as cost from lineitem left join part on l_partkey = p_partkey")
def q_cost_snapshot(spark, d):
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = runlog.cost(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), prices, "l_partkey", F.col("l_quantity"), "p_retailprice")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("cost", 9).alias("cost"))


@query("with o as (select * from events where event_type in ('view', 'click')), s as (select user_id, least(count(*) filter (event_type = 'view'), count(*) filter (event_type = 'click')) as k from o group by 1), t as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by event_id) as turn from o) select event_id, user_id, event_type, turn::int as turn from t join s using (user_id) where turn <= k")
def q_matched_volume(spark, d):
    return runlog.matched_volume(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", "event_id", "view", "click")


@query("with t as (select user_id, value <= 150 as ok, row_number() over (partition by user_id order by event_id) as turn from events), z as (select unnest([5, 10, 20, 30]) as size), c as (select user_id, size, count(*) as n, bool_and(ok) as gate from t join z on turn <= size group by 1, 2 having count(*) = size) select size, count(*) as cases, count(*) filter (gate) as passed from c group by 1")
def q_prefix_gate(spark, d):
    return runlog.prefixes(table(spark, d, "events"), "user_id", "event_id", F.col("value") <= 150, [5, 10, 20, 30])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def q_incomplete_pairs(spark, d):
    return runlog.missing(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("with a as (select l_partkey, max(l_quantity) as before from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey, max(l_quantity) as after from lineitem where l_returnflag = 'R' group by 1) select l_partkey, case when before is null then 'started' when after is null then 'stopped' when before = after then 'continued' else 'changed' end as state from a full join b using (l_partkey)")
def q_set_diff(spark, d):
    side = lambda flag, name: table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.max("l_quantity").alias(name))
    both = side("A", "before").join(side("R", "after"), "l_partkey", "full")
    return both.select("l_partkey", F.when(F.col("before").isNull(), "started").when(F.col("after").isNull(), "stopped").when(F.col("before") == F.col("after"), "continued").otherwise("changed").alias("state"))


@query("with o as (select doc_id, source, sha256('cohort:' || doc_id) as h from documents where source not in (select source from documents join labels using (doc_id) group by source having avg(toxic) > 0.2)) select doc_id, source from (select *, row_number() over (partition by source order by h, doc_id) as r from o) where r = 1 order by h, doc_id limit 10")
def q_hash_cohort(spark, d):
    bad = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.avg("toxic").alias("t")).filter("t > 0.2").select("source")
    return sample.hash_cohort(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", bad, "cohort", 10)


@query("select doc_id, lang, turn::int as turn from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as turn from documents) order by turn, lang limit 40")
def q_round_robin(spark, d):
    return sample.round_robin(table(spark, d, "documents"), "doc_id", "lang", 40)


@query("with o as (select doc_id, row_number() over (order by doc_id) - 1 as position, count(*) over () as n from documents) select position, doc_id from o where position in (select floor(i * (select max(n) from o) / 25.0)::bigint from range(25) t(i))")
def q_even_sample(spark, d):
    return sample.even_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 25)


def _rouge_sql(n: int) -> str:
    gram = "w[i]" if n == 1 else "w[i] || ' ' || w[i + 1]"
    side = lambda c, name: f"(select conv_id, g, count(*) as {name} from (select conv_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: {gram})) as g from (select conv_id, {WORDS.replace('text', c)} as w from notes)) group by 1, 2)"
    return f"with {NOTES}, b as (select conv_id, coalesce(r, 0) as r, coalesce(c, 0) as c from {side('source', 'r')} full join {side('note', 'c')} using (conv_id, g)), t as (select conv_id, coalesce(sum(least(r, c)), 0)::bigint as overlap, coalesce(sum(r), 0)::bigint as n_reference, coalesce(sum(c), 0)::bigint as n_candidate from notes left join b using (conv_id) group by 1), p as (select *, coalesce(overlap / nullif(n_candidate, 0)::double, 0) as p, coalesce(overlap / nullif(n_reference, 0)::double, 0) as q from t) select conv_id, overlap, n_reference, n_candidate, round(p, 6) as precision, round(q, 6) as recall, round(case when p + q > 0 then 2 * p * q / (p + q) else 0 end, 6) as f1 from p"


@query(_rouge_sql(1))
def q_rouge1(spark, d):
    return rouge.rouge_n(notes(spark, d), "conv_id", "source", "note", 1)


@query(_rouge_sql(2))
def q_rouge2(spark, d):
    return rouge.rouge_n(notes(spark, d), "conv_id", "source", "note", 2)


@query()
def q_rouge_l(spark, d):
    return rouge.rouge_l(notes(spark, d), "conv_id", "source", "note")


@query(f"with {NOTES}, w as (select conv_id, {WORDS.replace('text', 'source')} as s, {WORDS.replace('text', 'note')} as t from notes), g as (select *, list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]) as s2, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) as t2 from w) select conv_id, len(t)::int as tokens, round(case when len(t) > 0 then len(list_filter(t, lambda x: list_contains(s, x))) / len(t)::double else 0 end, 6) as token_support, round(case when len(t2) > 0 then len(list_filter(t2, lambda x: list_contains(s2, x))) / len(t2)::double else 0 end, 6) as bigram_support from g")
def q_source_support(spark, d):
    return rouge.source_support(notes(spark, d), "conv_id", "source", "note")


@query(f"with {NOTES}, w as (select conv_id, {WORDS.replace('text', 'source')} as s, least(len({WORDS.replace('text', 'note')}), len({WORDS.replace('text', 'source')})) as k from notes) select conv_id, array_to_string(s[1:k], ' ') as lead, array_to_string(s[len(s) - k + 1:len(s)], ' ') as tail from w")
def q_lead_tail_baseline(spark, d):
    return rouge.lead_tail(notes(spark, d), "conv_id", "source", "note")


@query(r"""with x as (select page_id, regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1) as x from pages), u as (select page_id, x, unnest(range(1, len(x) + 1)) as p from x), t as (select page_id, p, regexp_replace(x[p], '<[^>]*>', '', 'g') as s from u)
select page_id, p::int as ordinal, trim(regexp_replace(replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'), '[ \t\n\v\f\r]+', ' ', 'g')) as text from t""")
def q_html_sentences(spark, d):
    return readers.marked_up(table(spark, d, "pages"), "page_id", "html", "p")


@query("with c as (select o_orderpriority as cell, l_discount as v, l_quantity as w from orders join lineitem on o_orderkey = l_orderkey) select cell, count(*) as n, round(sum(v * w) / sum(w), 6) as weighted_mean from c group by rollup (cell)")
def q_weighted_rollup(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("cell")).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount", "l_quantity"), "o_orderkey")
    return rows.rollup("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted_mean"))


# Claims: each benchmark passage in the documents that hold it; its first four words stand in for a label.
def _claims(spark, d):
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    pairs = provenance.contained(items, docs).join(items, "item_id")
    return pairs.select("item_id", "doc_id", F.col("text").alias("quote"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("label")), docs


_in = lambda sql, column: sql.replace("text", column)
LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(x, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')), lambda x: x <> '')"
_HAS = lambda a, b: f"(case when len(list_distinct({a})) > 0 then len(list_intersect(list_distinct({a}), {b})) / len(list_distinct({a}))::double else 0 end)"
RANKED = f"""c as (select item_id, doc_id, d.text as source, i.text as quote, array_to_string(string_split(i.text, ' ')[1:4], ' ') as label from (select *, {EXACT} as e from benchmark) i join (select *, {EXACT} as e from documents) d on contains(d.e, i.e)),
ln as (select *, {_in(LINES, 'source')} as x from c), u as (select item_id, doc_id, quote, label, unnest(range(1, len(x) + 1)) as ordinal, x from ln),
tk as (select *, x[ordinal] as line, {_in(TOKENS, 'quote')} as q, {_in(TOKENS, 'label')} as l, {_in(TOKENS, 'x[ordinal]')} as t from u),
sc as (select *, {_HAS('q', 't')} as qc, {_HAS('l', 't')} as lc, contains({_in(LOOSE, 'line')}, {_in(LOOSE, 'quote')}) as ex, contains({_in(LOOSE, 'line')}, {_in(LOOSE, 'label')}) as nm from tk),
ranked as (select *, greatest(qc, 0.95::double * lc, ex::int::double, nm::int * 0.92::double) as score, len({_in(WORDS, 'line')}) as words, row_number() over (partition by item_id, doc_id order by greatest(qc, 0.95::double * lc, ex::int::double, nm::int * 0.92::double) desc, ex desc, qc desc, lc desc, ordinal) as rank from sc)"""


@query(f"with {RANKED} select item_id, doc_id, rank::int as rank, ordinal::int as ordinal, round(score, 6) as score, round(qc, 6) as quote_coverage from ranked where rank <= 3")
def q_ranked_lines(spark, d):
    ranked = retrieval.ranked_lines(*_claims(spark, d)).filter("rank <= 3")
    return ranked.select("item_id", "doc_id", "rank", "ordinal", F.round("score", 6).alias("score"), F.round("quote_coverage", 6).alias("quote_coverage"))


@query(f"with {RANKED}, b as (select unnest([1, 2, 4, 8])::int as budget), g as (select budget, item_id, doc_id, {_HAS('any_value(q)', 'flatten(list(t))')} as c, sum(words) as w from ranked join b on rank <= budget group by 1, 2, 3) select budget, count(*) as claims, count(*) filter (c >= 0.72) as supported, round(avg(c), 6) as mean_coverage, round(avg(w), 6) as mean_words from g group by 1")
def q_budget_curve(spark, d):
    return retrieval.budget_curve(retrieval.ranked_lines(*_claims(spark, d)), [1, 2, 4, 8])


@query()
def q_minimal_selector(spark, d):
    return retrieval.select_minimal(retrieval.ranked_lines(*_claims(spark, d)))


@query(f"with w as (select quality = 1 as ok, len({WORDS}) as words, len(regexp_extract_all(text, '[0-9]+')) as items from documents join labels using (doc_id)), g as (select case when words < 1500 then 'short' else 'long' end as length, case when items * 1000.0::double / greatest(words, 1) >= 16 then 'high' else 'low' end as density, count(*) as n, count(*) filter (ok) as passed from w group by 1, 2) select length, density, n, passed, {WILSON('passed', 'n')[0]} as low, {WILSON('passed', 'n')[1]} as high from g")
def q_length_density(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("quality") == 1).alias("ok"), F.size(T.word_tokens(F.col("text"))).alias("words"), F.regexp_count("text", F.lit("[0-9]+")).alias("items"))
    return retrieval.length_density(rows, F.col("words"), F.col("items"), F.col("ok"))


_word = lambda x, p: f"regexp_matches(lower({x}), '(^|[^a-z0-9_])(?:{p})([^a-z0-9_]|$)')"
SENTENCES = r"s as (select doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?;:\n]+[.!?;:]*'), lambda s: trim(s)), lambda s: s <> '')) as s from documents)"
BARE = f"regexp_replace(regexp_replace(' ' || lower(s) || ' ', '([^a-z0-9_])(?:{assertion.PSEUDO})([^a-z0-9_])', '\\1 \\2', 'g'), '([^a-z0-9_])(?:{assertion.PSEUDO})([^a-z0-9_])', '\\1 \\2', 'g')"


@query(f"with {SENTENCES}, a as (select doc_id, case when {_word(BARE, assertion.SPECULATION)} then 'possible' when {_word(BARE, assertion.NEGATION)} then 'absent' else 'present' end as status from s) select status, count(*) as sentences, count(distinct doc_id) as docs from a group by 1")
def q_assertion_sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(segment.sentences(F.col("text"))).alias("s"))
    by = rows.groupBy("doc_id", assertion.of_sentence(F.col("s")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("status").agg(F.sum("n").alias("sentences"), F.count(F.lit(1)).alias("docs"))


SIGNALS_SQL = "with n as (select doc_id, unnest([{" + "}, {".join(f"'domain': '{k}', 'p': '{v}'" for k, v in segment.SIGNALS.items()) + f"}}], recursive := true) as _, text from TABLE), l as (select doc_id, domain, p, unnest(range(1, len({LINES}) + 1)) as o, {LINES} as x from n) select doc_id, domain, count(*) as matches, min(o)::int as first_line from l where regexp_matches(x[o], '(?i)' || p) group by 1, 2"


@query(SIGNALS_SQL.replace("TABLE", "documents"))
def q_signals(spark, d):
    return segment.signals(table(spark, d, "documents"))


SIGNAL_NOTES = [(1, "Medications:aspirin\nfinal diagnoses here\nCT of chest"), (2, "discharge diagnosis\nwbc 9 and XRAY\nfollow-up in clinic"), (3, "premedications: none\nprocedures"), (4, "")]


@query("select * from (values (1, 'medication_changes', 1, 1), (1, 'diagnosis_changes', 1, 2), (1, 'procedures_and_tests', 1, 3), (2, 'procedures_and_tests', 1, 2), (2, 'labs', 1, 2), (2, 'follow_up_actions', 1, 3), (3, 'procedures_and_tests', 1, 2)) t(doc_id, domain, matches, first_line)")
def q_signals_notes(spark, d):
    return segment.signals(spark.createDataFrame(SIGNAL_NOTES, "doc_id int, text string"))


@query(f"with l as (select doc_id, {LINES} as x from documents), p as (select doc_id, x, 1 + doc_id % 3 as f, 1 + doc_id % 7 as t from l) select doc_id, case when greatest(f, t) > len(x) then 'unknown_line' when f > t then 'reversed' else 'as_given' end as status, case when greatest(f, t) <= len(x) then length(array_to_string(x[least(f, t):greatest(f, t)], chr(10))) end::int as chars from p")
def q_pointed_lines(spark, d):
    docs = table(spark, d, "documents")
    return segment.pointed(docs.select("doc_id", (1 + F.col("doc_id") % 3).alias("first"), (1 + F.col("doc_id") % 7).alias("last")), docs).select("doc_id", "status", F.length("quote").alias("chars"))


@query("select l_orderkey, l_linenumber, f as first_at from (select l_orderkey, l_linenumber, min(l_linenumber) over (partition by l_orderkey, l_returnflag, l_linestatus) as f from lineitem) where l_linenumber > f")
def q_repeated_items(spark, d):
    return gates.repeats(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag", "l_linestatus"], "l_linenumber").select("l_orderkey", "l_linenumber", "first_at")


@query("select l_orderkey, l_linestatus, count(distinct l_returnflag) as states from lineitem group by 1, 2 having count(distinct l_returnflag) > 1")
def q_state_conflicts(spark, d):
    return gates.conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linestatus"], "l_returnflag")


@query("with o as (select l_orderkey, count(*) as n, count(distinct l_linestatus) as s, count(distinct l_returnflag) as f, max(l_discount) as m from lineitem group by 1), c as (select n < 2 as short, n > s * f as repeated, f > 2 as conflict, m > 0.095 as missing from o), a as (select case when not (short or repeated or conflict or missing) then 'accept' when short and not (repeated or conflict or missing) then 'summary_only_regeneration' when repeated and not (short or conflict or missing) then 'deterministic_duplicate_review' when missing then 'targeted_evidence_reextraction' when conflict then 'medication_reconciliation_reextraction' else 'full_json_schema_reextraction' end as action from c) select action, count(*) as orders from a group by 1")
def q_recovery_actions(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linestatus").alias("s"), F.count_distinct("l_returnflag").alias("f"), F.max("l_discount").alias("m"))
    rules = {"empty_or_short_summary": F.col("n") < 2, "duplicate_evidence_item": F.col("n") > F.col("s") * F.col("f"), "medication_state_conflict": F.col("f") > 2, "source_quote_not_found": F.col("m") > 0.095}
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return o.groupBy(gates.recovery(codes).alias("action")).agg(F.count(F.lit(1)).alias("orders"))


@query("with f as (select l_suppkey, l_partkey, l_returnflag as r from lineitem group by all), p as (select a, b, l_suppkey, count(*) filter (x and y) / nullif(count(*) filter (x or y), 0)::double as j from (select l_suppkey, l_partkey, p.a, p.b, bool_or(r = p.a) as x, bool_or(r = p.b) as y from f, (values ('A', 'N'), ('A', 'R'), ('N', 'R')) p(a, b) group by all) group by all) select a as first_run, b as second_run, count(*) as cases, round(avg(j), 6) as mean_jaccard, round(min(j), 6) as least_jaccard from p where j is not null group by 1, 2")
def q_run_agreement(spark, d):
    return matching.run_agreement(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_partkey", ["A", "N", "R"])


@query("select votes, count(*) as items from (select count(distinct l_returnflag) as votes from lineitem group by l_suppkey, l_partkey) group by 1")
def q_consensus(spark, d):
    return matching.consensus(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_partkey")


@query()
def q_item_assignment(spark, d):
    """Assistant sentences of a conversation matched one to one with user sentences."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(segment.sentences(F.col("text"))).alias("p", "label"))
    side = lambda role: turns.filter(F.col("role") == role).select(F.col("conv_id").alias("record_id"), F.lit("turn").alias("domain"), (F.col("turn") * 1000 + F.col("p")).alias("item_id"), "label", F.col("label").alias("source_quote"), F.lit("unknown").alias("assertion"))
    predicted, gold = side("assistant"), side("user")
    return matching.matched_scores(predicted, gold, matching.matches(matching.candidates(predicted, gold, 0.3)))


@query(f"{RATERS}, t as (select count(*) filter (gold = 0 and predicted = 0) as tp, count(*) filter (gold = 1 and predicted = 0) as fp, count(*) filter (gold = 0 and predicted = 1) as fn, count(*) filter (gold = 1 and predicted = 1) as tn from r) select *, round(tp / nullif(tp + fn, 0)::double, 6) as sensitivity, round(tn / nullif(tn + fp, 0)::double, 6) as specificity, round(tp / nullif(tp + fp, 0)::double, 6) as ppv, round(tn / nullif(tn + fn, 0)::double, 6) as npv, tp + fn >= 20 and coalesce(tp / nullif(tp + fn, 0)::double >= 0.9, false) as released from t")
def q_judge_validation(spark, d):
    return stats.diagnostic(_raters(spark, d), F.col("gold") == 0, F.col("predicted") == 0)


@query(f"{RATERS}, t as (select count(*) as n, count(*) filter (gold = 1 and predicted = 0) as only_first, count(*) filter (gold = 0 and predicted = 1) as only_second from r), p as (select *, only_first + only_second as m, (only_first - only_second) / n::double as df, 1.96 * sqrt(only_first + only_second - (only_first - only_second)::double * (only_first - only_second) / n) / n as h from t) select n, only_first, only_second, round(df, 6) as difference, round(df - h, 6) as low, round(df + h, 6) as high, round(least(1.0::double, 2 * (select sum(exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) - m * ln(2.0::double))) from range(0, 100000) r(i) where i <= least(only_first, only_second))), 6) as p from p")
def q_mcnemar(spark, d):
    return stats.mcnemar(_raters(spark, d), F.col("gold") == 1, F.col("predicted") == 1)


@query(f"with {SCORED}, x as (select ok, tox, unnest(list_filter([case when lang = 'en' then 'english' end, case when n_chars > 15000 then 'long' end, case when n_chars < 2500 then 'sparse' end], lambda v: v is not null)) as feature from scored), y as (select feature, unnest(list_filter([case when not ok then 'bad' end, case when tox then 'toxic' end], lambda v: v is not null)) as failure from x) select feature, failure, count(*) as n from y group by 1, 2")
def q_cooccurrence(spark, d):
    return stats.together(scored(spark, d), {"english": F.col("lang") == "en", "long": F.col("n_chars") > 15000, "sparse": F.col("n_chars") < 2500}, {"bad": ~F.col("ok"), "toxic": F.col("tox")})


RISK = "least(18.0::double, 3.0::double * len(regexp_extract_all(text, '[|]'))) + least(12.0::double, 2.0::double * len(regexp_extract_all(text, '!!'))) + least(20.0::double, 4.0::double * len(regexp_extract_all(text, '###')))"


def _risk(spark, d):
    count = lambda p: F.regexp_count("text", F.lit(p))
    risk = stats.capped_risk({"bars": (count("[|]"), 3, 18), "marks": (count("!!"), 2, 12), "heads": (count("###"), 4, 20)})
    return table(spark, d, "documents").select("doc_id", risk.alias("risk"))


@query(f"select doc_id, {RISK} as risk from documents")
def q_capped_risk(spark, d):
    return _risk(spark, d)


@query(f"with t as (select count(*) as n, count(*) filter (a) as accepted, count(*) filter (a and b) as unsafe, count(*) filter (b) as bad from (select {RISK} < 4 as a, quality = 0 as b from documents join labels using (doc_id))) select n, accepted, unsafe, bad, round(accepted / nullif(n, 0)::double, 6) as yield, round(unsafe / nullif(accepted, 0)::double, 6) as selective_risk, round(unsafe / nullif(bad, 0)::double, 6) as false_acceptance, round((bad - unsafe) / nullif(bad, 0)::double, 6) as sensitivity, round((accepted - unsafe) / nullif(n - bad, 0)::double, 6) as safe_acceptance from t")
def q_selective_metrics(spark, d):
    return stats.selective(_risk(spark, d).join(table(spark, d, "labels"), "doc_id"), F.col("risk") < 4, F.col("quality") == 0)


@query("with c as (select event_type, user_id, count(*) filter (value > 150) as k from events group by 1, 2), s as (select event_type, case when k >= 4 then '4+' else k::varchar end as size, count(*) as n from c group by 1, 2) select *, round(n / sum(n) over (partition by event_type)::double, 6) as share from s")
def q_span_spread(spark, d):
    by = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count_if(F.col("value") > 150).alias("k"))
    return runlog.spread(by, "event_type", F.col("k"))


@query("with m as (select o_orderkey, o_orderpriority as p from orders) select case when p is null or p = '' then 'none' when contains(lower(p), 'urgent') or contains(lower(p), 'high') then 'rate_limit' when contains(lower(p), 'medium') then 'timeout' when contains(lower(p), 'low') then 'parse' else 'other' end as class, count(*) as n from m group by 1")
def q_error_classes(spark, d):
    kind = runlog.classify(F.col("o_orderpriority"), {"rate_limit": "urgent|high", "timeout": "medium", "parse": "low"})
    return table(spark, d, "orders").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("with i as (select doc_id, list_filter([case when length(text) > 15000 then 'long' end, case when length(text) < 2500 then 'sparse' end, case when contains(text, '|') then 'table' end, case when lang <> 'en' then 'foreign' end], lambda x: x is not null) as issues from documents) select case when list_has_any(issues, ['foreign']) then 'translate' when list_has_any(issues, ['long', 'table']) then 'two_stage' when list_has_any(issues, ['sparse']) then 'review' else 'single_stage' end as route, count(*) as docs, sum(len(issues))::bigint as issues from i group by 1")
def q_routing(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("chars"), F.col("text").contains("|").alias("bars"))
    rules = {"long": F.col("chars") > 15000, "sparse": F.col("chars") < 2500, "table": F.col("bars"), "foreign": F.col("lang") != "en"}
    routed = runlog.allocate(rows, rules, [("translate", ["foreign"]), ("two_stage", ["long", "table"]), ("review", ["sparse"])], "single_stage")
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("issues")).alias("issues"))


from veristrata.plans import fixtures, measures  # noqa: E402, F401  they register their queries
