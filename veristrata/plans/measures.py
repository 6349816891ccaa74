"""More queries on the driver's tables: features, cohorts, scores, conformal reports, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import assertion, attribution, cluster, cohort, conformal, features, matching, runlog, segment, spans
from veristrata.plans.catalogue import NOTES, RATERS, SCORED, SIMHASH, WILSON, WORDS, _raters, notes, query, scored, table

_q = lambda p: p.replace("'", "''")
_matches = lambda x, p: f"regexp_matches({x}, '(?i){_q(p)}')"

RISK_SQL = {"long_note": "length(text) > 15000", "sparse_note": "length(text) < 2500", **{k: _matches("text", p) for k, p in features.RISKS.items()}}


@query(f"with f as (select unnest([{', '.join(f'{{feature: {chr(39)}{k}{chr(39)}, x: {v}}}' for k, v in RISK_SQL.items())}], recursive := true) from documents) select feature, count(*) filter (x) as docs from f group by 1")
def q_source_risks(spark, d):
    rules = features.source_risks(F.col("text"))
    rows = table(spark, d, "documents").select(F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("x")) for k, v in rules.items()))).alias("f")).select("f.*")
    return rows.groupBy("feature").agg(F.count_if("x").alias("docs"))


@query(f"with f as (select case {' '.join(f'when regexp_matches(lower(text), {chr(39)}{p}{chr(39)}) then {chr(39)}{k}{chr(39)}' for k, p in features.FAMILIES.items())} else 'other' end as family from documents) select family, count(*) as docs from f group by 1")
def q_diagnosis_family(spark, d):
    return table(spark, d, "documents").groupBy(features.family(F.col("text")).alias("family")).agg(F.count(F.lit(1)).alias("docs"))


@query(rf"with b as (select item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), '\b(?:{features.SCORING_STOPS})\b', ' ', 'g'), '\s+', ' ', 'g')) as form, coalesce(nullif(regexp_replace(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'view') as slug from benchmark) select * from b")
def q_scoring_forms(spark, d):
    return table(spark, d, "benchmark").select("item_id", features.scoring_form(F.col("text")).alias("form"), features.slug(F.substring("text", 1, 40)).alias("slug"))


@query(r"with l as (select doc_id, arm, case arm when 'none' then text when 'whitespace' then regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') else trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), ' ') end as t from documents, (values ('none'), ('whitespace'), ('rewrap')) a(arm)) select arm, count(*) as docs, sum(length(t))::bigint as chars from l group by 1")
def q_layouts(spark, d):
    return features.layouts(table(spark, d, "documents")).groupBy("arm").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(r"select i as item_id, w as window, l as limit_, o as owner, s as label from (values (1, 'in 2 weeks', '', 'primary care', 'See PCP in 2 weeks'), (2, '', '> 3 kg', 'patient', 'Call if gain > 3 kg'), (3, 'Within 10 days', 'below 90%', 'cardiology', 'Within 10 days cardiologist if below 90%'), (4, '', '', '', 'view'), (5, 'for 3 months', 'over 101 degrees', 'wound clinic', 'wound clinic for 3 months when over 101 degrees')) t(i, w, l, o, s)")
def q_instructions(spark, d):
    rows = spark.createDataFrame([(1, "1. See PCP in 2 weeks"), (2, "- Call if gain > 3 kg"), (3, "Within 10 days cardiologist if below 90%"), (4, "view"), (5, "?????? wound clinic for 3 months when over 101 degrees")], "item_id int, text string")
    x = F.col("text")
    return rows.select("item_id", features.time_window(x).alias("window"), features.limit(x).alias("limit_"), features.owner(x).alias("owner"), features.extractive_label(x).alias("label"))


@query("select * from (values (1, 'aspirin 81 mg' || chr(10) || 'lasix'), (2, ''), (3, 'none')) t(doc_id, section)")
def q_section_text(spark, d):
    rows = [(1, "x\nDischarge Medications:\naspirin 81 mg\nlasix\nFOLLOW UP: clinic"), (2, "no heading"), (3, "HOME MEDICATIONS\n none \n\nALLERGIES:\nnone known")]
    return spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", features.section_text(F.col("text"), ["discharge medications", "home medications"]).alias("section"))


SUPPORT_WORDS = lambda x: f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s./]', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')), ' '), lambda t: t <> '')"


@query(rf"with {NOTES}, w as (select conv_id, {SUPPORT_WORDS('note')} as v, {SUPPORT_WORDS('source')} as q from notes), l as (select conv_id, q, case when len(v) > 0 then len(list_filter(v, lambda t: list_contains(q, t))) / len(v)::double else 0 end as x from w) select conv_id, round(x, 6) as lexical, round(case when regexp_matches(array_to_string(q, ' '), '\b(?:{features.SUPPORT_CUES})\b') then 0 else x end, 6) as cue_aware from l")
def q_support_scores(spark, d):
    return features.support(notes(spark, d), "conv_id", "note", "source").select("conv_id", F.round("lexical", 6).alias("lexical"), F.round("cue_aware", 6).alias("cue_aware"))


@query("select * from (values (1, 'medication'), (2, 'diagnosis'), (3, 'procedure_or_test'), (4, 'lab'), (5, 'follow_up'), (6, 'safety'), (7, 'uncertain'), (8, 'unknown'), (9, 'allergy'), (10, 'procedure_or_test')) t(item_id, domain)")
def q_broad_domain(spark, d):
    names = ["medication_changes.started", "Diagnosis", "procedures", " labs ", "Follow up", "safety_flags", "uncertain_items", None, "Allergy", "lab tests"]
    return spark.createDataFrame(list(enumerate(names, 1)), "item_id int, name string").select("item_id", features.domain(F.col("name")).alias("domain"))


_b = lambda p: rf"\b(?:{p})\b"
BASELINES = rf"""s as (select doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?;:\n]+[.!?;:]*'), lambda s: trim(s)), lambda s: s <> '')) as s from documents), n as (select trim(regexp_replace(lower(s), '[ \t\n\v\f\r]+', ' ', 'g')) as t from s),
c as (select regexp_matches(t, '{_b(assertion.SPECULATION)}') as spec, regexp_matches(regexp_replace(t, '{_b(assertion.PSEUDO)}', ' ', 'g'), '{_b(features.BASELINE_NEGATION)}') as neg from n)"""


@query(f"with {BASELINES}, p as (select unnest([{{method: 'present_majority', status: 'present'}}, {{method: 'negex_style', status: case when neg then 'absent' else 'present' end}}, {{method: 'context_style', status: case when spec then 'possible' when neg then 'absent' else 'present' end}}], recursive := true) from c) select method, status, count(*) as sentences from p group by 1, 2")
def q_status_baselines(spark, d):
    rows = table(spark, d, "documents").select(F.explode(segment.sentences(F.col("text"))).alias("s"))
    made = features.status_baselines(F.col("s"), assertion.SPECULATION, assertion.PSEUDO)
    return rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("method"), v.alias("status")) for k, v in made.items()))).alias("p")).select("p.*").groupBy("method", "status").agg(F.count(F.lit(1)).alias("sentences"))


@query("with o as (select doc_id, sha256('review:' || doc_id) as h from documents), p as (select doc_id, row_number() over (order by h, doc_id) - 1 as p, ceil(count(*) over () * 0.2::double) as k from o) select unnest(case when p < k then ['one', 'two'] when (p - k)::bigint % 2 = 0 then ['one'] else ['two'] end) as reviewer, doc_id from p")
def q_reviewers(spark, d):
    return cohort.reviewers(table(spark, d, "documents"), "doc_id", "review", ("one", "two"), 0.2)


FNV = lambda x: f"list_reduce(list_transform(string_split({x}, ''), lambda c: ord(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint)"


@query(f"with p as (select l_orderkey * 10 + l_linenumber as id, case when l_returnflag = 'A' and l_linestatus = 'F' and l_quantity > 45 then 0 when l_discount > 0.09 then 1 when l_returnflag = 'R' then 2 when l_returnflag = 'N' then 3 else 4 end as priority from lineitem) select id, priority from p order by priority, {FNV('id::varchar')}, id limit 60")
def q_review_priority(spark, d):
    kind = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "medication").when(F.col("l_returnflag") == "R", "safety").when(F.col("l_returnflag") == "N", "lab").otherwise("other")
    rows = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return cohort.by_risk(rows, "id", kind, F.col("l_quantity") > 45, F.col("l_discount") <= 0.09, 60)


@query("select doc_id, ('0x' || substr(sha256(doc_id::varchar), 1, 2))::int % 2 = 1 as swapped from documents")
def q_blinded(spark, d):
    return cohort.blinded(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("with c as (select o_custkey, least(count(*), 2) as a from orders group by 1), b as (select o_custkey, row_number() over (order by o_custkey) - 1 as p, count(*) over () as n from c where a >= 2), w as (select distinct least(n - 1, (i * n) // least(10, n, 15)) as p from (select max(n) as n from b), range(10) t(i) where i < least(10, n, 15)), two as (select o_custkey from b join w using (p)), one as (select o_custkey from c where o_custkey not in (select o_custkey from two) order by 1 limit (select 30 - 2 * count(*) from two)) select o_custkey, 2 as outputs from two union all select o_custkey, 1 from one")
def q_paired_quota(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("available"))
    return cohort.paired_quota(rows, "o_custkey", 30, 10)


@query("select count(*) as n, count(distinct doc_id) as keys, count(distinct source) as subjects, count(*) filter (source in (select source from documents where lang = 'de')) as overlap, false as ready from documents where lang = 'en'")
def q_preflight(spark, d):
    docs = table(spark, d, "documents")
    return cohort.preflight(docs.filter("lang = 'en'"), docs.filter("lang = 'de'"), "doc_id", "source")


@query("select tier, count(*) as customers from (select case when c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') then 'urgent' when c_custkey in (select o_custkey from orders) then 'ordered' else 'untouched' end as tier from customer) group by 1")
def q_exposure_tiers(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return cohort.tiers(table(spark, d, "customer").select("c_custkey"), "c_custkey", {"urgent": orders.filter("o_orderpriority = '1-URGENT'"), "ordered": orders}).groupBy("tier").agg(F.count(F.lit(1)).alias("customers"))


NEAR = "e as (select vec_id, embedding::double[] as v, label from embeddings), s as (select a.vec_id, b.vec_id as neighbour, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12) as s, b.label from e a join e b on a.vec_id <> b.vec_id), n as (select *, row_number() over (partition by vec_id order by s desc, neighbour) as rank from s)"


@query(f"with {NEAR} select vec_id, rank::int as rank, neighbour, round(s, 6) as similarity from n where rank <= 5")
def q_neighbours(spark, d):
    return cohort.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("vec_id", "rank", "neighbour", F.round("similarity", 6).alias("similarity"))


@query(f"with {NEAR} select vec_id, round(sum((greatest(s, 0) + 0.001::double) * (label % 2)) / sum(greatest(s, 0) + 0.001::double), 6) as rate from n where rank <= 10 group by 1")
def q_event_rates(spark, d):
    rows = table(spark, d, "embeddings")
    near = cohort.neighbours(rows, "vec_id", "embedding", 10)
    return cohort.event_rates(near, rows.withColumn("event", F.col("label") % 2), "vec_id", "event").withColumn("rate", F.round("rate", 6))


@query(f"{SIMHASH.replace('w as (', 'with recursive w as (', 1)}, near as (select x.doc_id as a, y.doc_id as b from p x join p y on x.doc_id < y.doc_id where bit_count(xor(x.u::ubigint, y.u::ubigint)) <= 10), e as (select a, b from near union select b, a from near), r(id, root) as (select a, a from e union select e.b, r.root from r join e on e.a = r.id), c as (select id, min(root) as root from r group by 1), m as (select root, u::ubigint as u, id from c join p on id = doc_id), d as (select x.root, bit_count(xor(x.u, y.u))::int as d from m x join m y on x.root = y.root and x.id < y.id) select root as cluster, (select count(*) from m z where z.root = d.root) as members, min(d) as least, max(d) as most from d group by 1")
def q_cluster_range(spark, d):
    prints = cluster.settle(cluster.simhash(table(spark, d, "documents")), "prints")
    return cohort.hamming_range(prints, cluster.near_clusters(prints))


@query("with s as (select l_returnflag as model, l_linenumber as domain, count(*) filter (l_linestatus = 'F') as tp, count(*) filter (l_linestatus = 'O') as fp, count(*) filter (l_discount > 0.08) as fn from lineitem group by 1, 2), t as (select model, domain, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from s group by rollup (model, domain)), p as (select *, tp / nullif(tp + fp, 0)::double as p, tp / nullif(tp + fn, 0)::double as r from t) select model, domain, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p > 0 and r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from p")
def q_micro_scores(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("domain"), *((c.cast("long")).alias(n) for n, c in (("tp", F.col("l_linestatus") == "F"), ("fp", F.col("l_linestatus") == "O"), ("fn", F.col("l_discount") > 0.08))))
    return cohort.micro_scores(rows, ["model", "domain"])


LCG = "recursive g(i, s) as (select 0, 20260721::hugeint union all select i + 1, (1664525 * s + 1013904223) % 4294967296 from g where i < 50 * (select count(*) from c))"


@query(f"with recursive c as (select source, count(*) filter (quality = 1 and not contains(text, '!!')) as tp, count(*) filter (quality = 0 and not contains(text, '!!')) as fp, count(*) filter (quality = 1 and contains(text, '!!')) as fn from documents join labels using (doc_id) group by 1), k as (select *, row_number() over (order by source) - 1 as j, count(*) over () as n from c), {LCG.removeprefix('recursive ')}, x as (select (i - 1) // n as r, ((s * n) // 4294967296)::bigint as j from g, (select max(n) as n from k) where i > 0), f as (select r, sum(tp)::double as tp, sum(fp) as fp, sum(fn) as fn from x join k using (j) group by 1), o as (select case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1 from f), z as (select f1, row_number() over (order by f1) - 1 as p from o) select round(max(f1) filter (p = 1), 6) as low, round(max(f1) filter (p = 47), 6) as high from z")
def q_bootstrap_f1(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(
        F.count_if((F.col("quality") == 1) & ~F.col("text").contains("!!")).alias("tp"), F.count_if((F.col("quality") == 0) & ~F.col("text").contains("!!")).alias("fp"), F.count_if((F.col("quality") == 1) & F.col("text").contains("!!")).alias("fn")
    )
    return cohort.bootstrap_f1(rows, "source", 50).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"with {SCORED}, t as (select *, score >= 0.2 as sel from scored) select count(*) as n, count(*) filter (sel) as selected, count(*) filter (sel and not ok) as false_selected, count(*) filter (ok) as good, coalesce(round(count(*) filter (sel and not ok) / nullif(count(*) filter (sel), 0)::double, 6), 0) as fdr, round(count(*) filter (sel and ok) / nullif(count(*) filter (ok), 0)::double, 6) as power, round(count(*) filter (sel) / count(*)::double, 6) as coverage from t")
def q_fdr_report(spark, d):
    return conformal.fdr_report(scored(spark, d), F.col("score") >= 0.2, F.col("ok"))


def _sets_sql(by: str) -> str:
    return f"""with {SCORED}, r as (select doc_id, case when ok then 'good' else 'bad' end as truth, substr(sha256('split:' || doc_id), 1, 1) < '8' as cal, score as good, 1 - score as bad from scored), c as (select {by} as label, 1 - case truth when 'good' then good else bad end as s from r where cal),
k as (select label, s, row_number() over (partition by label order by s) as k, count(*) over (partition by label) as n from c), q as (select label, coalesce(max(s) filter (k = ceil((n + 1) * 0.8::double - 1e-9)), 'infinity'::double) as q from k group by 1),
x as (select doc_id, unnest([{{label: 'good', s: 1 - good}}, {{label: 'bad', s: 1 - bad}}], recursive := true) from r where not cal), i as (select doc_id, string_agg(x.label, ',' order by x.label) as labels from x join q on {'q.label = x.label' if by == 'truth' else 'true'} where s <= q group by 1) select doc_id, truth, coalesce(labels, '') as labels from r left join i using (doc_id) where not cal"""


def _sets(spark, d, by):
    first = F.substring(F.sha2(F.concat(F.lit("split:"), F.col("doc_id").cast("string")), 256), 1, 1) < "8"
    return conformal.prediction_sets(scored(spark, d), "doc_id", {"good": F.col("score"), "bad": 1 - F.col("score")}, F.when(F.col("ok"), "good").otherwise("bad"), first, 0.2, by)


@query(_sets_sql("truth"))
def q_prediction_sets(spark, d):
    return _sets(spark, d, True)


@query(_sets_sql("''"))
def q_prediction_sets_global(spark, d):
    return _sets(spark, d, False)


@query(f"with {SCORED}, g as (select unnest([lang, source]) as grp, score, ok from scored), t as (select grp, count(*) as n, count(*) filter (score >= 0.2) as accepted, count(*) filter (score >= 0.2 and not ok) as wrong from g group by 1) select grp, n, accepted, round(wrong / nullif(accepted, 0)::double, 6) as risk, round(accepted / n::double, 6) as coverage from t where accepted > 0 order by wrong / accepted::double desc, grp limit 12")
def q_worst_groups(spark, d):
    g = scored(spark, d).select(F.explode(F.array("lang", "source")).alias("grp"), "score", "ok").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.2).alias("accepted"), F.count_if((F.col("score") >= 0.2) & ~F.col("ok")).alias("wrong")).filter("accepted > 0")
    return g.orderBy((F.col("wrong") / F.col("accepted")).desc(), "grp").limit(12).select("grp", "n", "accepted", F.round(T.ratio(F.col("wrong"), F.col("accepted")), 6).alias("risk"), F.round(F.col("accepted") / F.col("n"), 6).alias("coverage"))


@query("select null::double as threshold, null::bigint as accepted, null::double as bound where false union all select v, n, round(b, 6) from (values (0.6::double, 150::bigint, 0.041784::double)) t(v, n, b)")
def q_bounded_threshold(spark, d):
    """Four risk scores of 50 rows each; one unsafe row of the first 150: with delta 0.05 shared by four scores the bound at 0.6 is within 0.08."""
    bad = {0.2: 0, 0.4: 1, 0.6: 0, 0.9: 40}
    rows = spark.createDataFrame([(r, i < k) for r, k in bad.items() for i in range(50)], "risk double, unsafe boolean")
    return conformal.bounded_threshold(rows, "risk", F.col("unsafe"), 0.08)


@query(f"with {SCORED}, h as (select doc_id, ok::int as y, ('0x' || substr(sha256('strata:' || doc_id), 1, 12))::bigint as h from scored), k as (select *, row_number() over (partition by y order by h) as k, count(*) over (partition by y) as n from h) select doc_id, y, k <= ceil(n * 0.6::double) as first from k")
def q_stratified(spark, d):
    return conformal.stratified(scored(spark, d).select("doc_id", F.col("ok").cast("int").alias("y")), "doc_id", "y", "strata", 0.6)


@query(f"with {NOTES}, w as (select {WORDS.replace('text', 'source')} as s, {WORDS.replace('text', 'note')} as t from notes) select count(*) as cases, round(avg(len(s)), 4) as reference_tokens, round(avg(len(t)), 4) as note_tokens, round(avg(len(t) / nullif(len(s), 0)::double), 6) as compression from w")
def q_note_summary(spark, d):
    w = notes(spark, d).select(F.size(T.word_tokens(F.col("source"))).alias("s"), F.size(T.word_tokens(F.col("note"))).alias("t"))
    return w.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("s"), 4).alias("reference_tokens"), F.round(F.avg("t"), 4).alias("note_tokens"), F.round(F.avg(T.ratio(F.col("t"), F.col("s"))), 6).alias("compression"))


@query(rf"with {NOTES}, w as (select conv_id, {WORDS.replace('text', 'source')} as s, {WORDS.replace('text', 'note')} as t, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(note, '([.!?;:])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') as c from notes), f as (select *, ' ' || array_to_string(s, ' ') || ' ' as flat from w), k as (select *, len(list_filter(c, lambda x: contains(flat, array_to_string({WORDS.replace('text', 'x')}, ' ')))) as found from f) select conv_id, len(t)::int as tokens, round(len(list_filter(t, lambda x: not list_contains(s, x))) / nullif(len(t), 0)::double, 6) as novelty, round(found / nullif(len(c), 0)::double, 6) as extractive_rate, (len(c) - found)::int as unsupported from k")
def q_note_novelty(spark, d):
    return attribution.support(notes(spark, d), "conv_id", "source", "note")


NOTE_ROWS = [("a", "Doctor: Start aspirin 81 mg daily. Follow up in two weeks. Patient: ok then. Doctor: Check potassium before the visit.", "Start aspirin 81 mg daily.\nCheck potassium level before visit.\nPatient enjoys gardening outdoors."), ("b", "", "Nothing here."), ("c", "some words", None)]


def _trace(spark):
    return attribution.trace(spark.createDataFrame(NOTE_ROWS, "id string, source string, note string"), "id", "source", "note")


@query(
    "select * from (values ('a', 0, true, 'Doctor: Start aspirin 81 mg daily.', false, true), ('a', 1, false, 'Doctor: Check potassium before the visit.', false, true), ('a', 2, false, 'Doctor: Start aspirin 81 mg daily. Follow up in two weeks.', true, false), ('b', 0, false, null, true, false)) t(id, ordinal, exact, best, weak, high_risk)"
)
def q_attribution(spark, d):
    return _trace(spark).select("id", "ordinal", "exact", "best", "weak", "high_risk")


@query("select 4 as sentences, 1 as exact, 2 as weak, 2 as high_risk, 0 as high_risk_weak, 0.5::double as weak_rate, 0.0::double as high_risk_weak_rate")
def q_attribution_summary(spark, d):
    return attribution.trace_summary(_trace(spark)).drop("mean_score")


@query(
    "select * from (values ('drop_unsupported', 'a', 'Start aspirin 81 mg daily.', 1, 2, 0), ('drop_unsupported', 'b', '', 0, 1, 0), ('replace_unsupported', 'a', 'Start aspirin 81 mg daily. Doctor: Check potassium before the visit.', 2, 1, 1), ('replace_unsupported', 'b', '', 0, 1, 0), ('source_only', 'a', 'Doctor: Start aspirin 81 mg daily. Doctor: Check potassium before the visit.', 2, 1, 1), ('source_only', 'b', '', 0, 1, 0)) t(method, id, text, kept, dropped, replaced)"
)
def q_repaired_notes(spark, d):
    rows, out = _trace(spark), None
    for m in attribution.METHODS:
        part = attribution.repaired(rows, "id", m).select(F.lit(m).alias("method"), "id", "text", "kept", "dropped", "replaced")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{RATERS}, s as (select predicted as model, count(*) as claims, count(*) filter (gold = 0) as errors from r group by 1) select model, claims, errors, round(errors / claims::double, 6) as rate, {WILSON('errors', 'claims')[0]} as low, {WILSON('errors', 'claims')[1]} as high from s")
def q_review_summary(spark, d):
    t = _raters(spark, d).groupBy(F.col("predicted").alias("model")).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("gold") == 0).alias("errors"))
    low, high = T.wilson(F.col("errors"), F.col("claims"))
    return t.select("model", "claims", "errors", F.round(T.ratio(F.col("errors"), F.col("claims")), 6).alias("rate"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("with w as (select user_id, max((value > 150)::int) filter (event_type = 'view') as a, max((value > 150)::int) filter (event_type = 'click') as b from events where event_type in ('view', 'click') group by 1) select count(*) as cases, count(*) filter (a = 1 and b = 0) as only_first, count(*) filter (a = 0 and b = 1) as only_second, round(avg(b - a), 6) as difference from w where a is not null and b is not null")
def q_paired_review(spark, d):
    flag = lambda t: F.max(F.when(F.col("event_type") == t, (F.col("value") > 150).cast("int")))
    w = table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).groupBy("user_id").agg(flag("view").alias("a"), flag("click").alias("b")).dropna(subset=["a", "b"])
    return w.agg(F.count(F.lit(1)).alias("cases"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_first"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_second"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("difference"))


@query("select regexp_matches(event_type, '(?i)^(view|click)$') as matched, count(*) as runs, round(avg(value), 4) as mean_value from events group by 1")
def q_model_split(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").rlike("(?i)^(view|click)$").alias("matched")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("with a as (select user_id, value <= 60 as ok, row_number() over (partition by user_id order by event_id) as k from events), f as (select user_id, min(k) filter (ok) as k from a where k <= 4 group by 1) select k::int as attempt, count(*) as recovered, sum(count(*)) over (order by k)::bigint as so_far from f where k is not null group by k")
def q_recovery_ablation(spark, d):
    return runlog.recovery_by_attempt(table(spark, d, "events"), "user_id", "event_id", F.col("value") <= 60, 4)


@query(f"with {NOTES}, w as (select conv_id, {SUPPORT_WORDS('note')} as v, {SUPPORT_WORDS('source')} as q from notes), l as (select case when len(v) > 0 then len(list_filter(v, lambda t: list_contains(q, t))) / len(v)::double else 0 end as x from w) select count(*) as notes, count(*) filter (x < 0.5) as flagged, round(count(*) filter (x < 0.5) / count(*)::double, 6) as rate from l")
def q_grounding_flags(spark, d):
    s = features.lexical_support(F.col("note"), F.col("source"))
    return notes(spark, d).agg(F.count(F.lit(1)).alias("notes"), F.count_if(s < 0.5).alias("flagged"), F.round(F.count_if(s < 0.5) / F.count(F.lit(1)), 6).alias("rate"))


@query("select i as case_id, case when i % 3 = 0 then 'metformin' when i % 3 = 1 then 'aspirin' else 'lisinopril' end as drug, 2 + i % 3 as drugs, case i % 5 when 0 then 'negated' when 1 then 'historical' when 2 then 'conditional' when 3 then 'subtle_held' else 'subtle_completed' end as distractor from range(40) t(i)")
def q_synthetic(spark, d):
    from veristrata.sources import readers

    return readers.synthetic(spark, 40, {"drug": ["metformin", "aspirin", "lisinopril"], "distractor": ["negated", "historical", "conditional", "subtle_held", "subtle_completed"]}).withColumn("drugs", 2 + F.col("case_id") % 3)


@query("with s as (select source, count(*) as items, count(*) filter (quality = 1) as ok from documents join labels using (doc_id) group by 1) select source, items, ok, round(ok / items::double, 6) as rate from s order by ok / items::double, items - ok desc, source limit 5")
def q_lowest_cases(spark, d):
    s = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("quality") == 1).alias("ok"))
    return s.orderBy(F.col("ok") / F.col("items"), (F.col("items") - F.col("ok")).desc(), "source").limit(5).select("source", "items", "ok", F.round(F.col("ok") / F.col("items"), 6).alias("rate"))


@query("with b as (select l_linenumber as method, l_returnflag as cls, count(*) as n, count(*) filter (l_linestatus = 'F') as hit from lineitem group by 1, 2), m as (select method, round(avg(hit / n::double), 6) as macro, round(sum(hit) / sum(n)::double, 6) as accuracy from b group by 1) select *, rank() over (order by macro desc, accuracy desc) as rank from m")
def q_baseline_ranking(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("method"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("hit"))
    m = b.groupBy("method").agg(F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("macro"), F.round(F.sum("hit") / F.sum("n"), 6).alias("accuracy"))
    from pyspark.sql import Window

    return m.withColumn("rank", F.rank().over(Window.orderBy(F.col("macro").desc(), F.col("accuracy").desc())))


@query("with c as (select o_orderpriority as domain, count(*) as candidates, count(*) filter (o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')) as selected from orders group by 1) select *, round(selected / candidates::double, 6) as rate from c")
def q_section_coverage(spark, d):
    chosen = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("s", F.lit(1))
    c = table(spark, d, "orders").join(chosen, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("domain")).agg(F.count(F.lit(1)).alias("candidates"), F.count("s").alias("selected"))
    return c.withColumn("rate", F.round(F.col("selected") / F.col("candidates"), 6))


@query()
def q_repeated_splits(spark, d):
    return conformal.repeated_splits(scored(spark, d).withColumn("inverse", 1 - F.col("score")), "source", ["score", "inverse"], "ok", [0.1, 0.2], splits=20)


@query()
def q_triage(spark, d):
    first = F.substring(F.sha2(F.concat(F.lit("triage:"), F.col("doc_id").cast("string")), 256), 1, 1) < "8"
    rows = scored(spark, d).withColumn("english", (F.col("lang") == "en").cast("int"))
    return conformal.triage(conformal.logistic_scores(rows, "doc_id", ["score", "english"], (~F.col("ok")).cast("int"), first), "doc_id", 0.1)


@query()
def q_planned_sizes(spark, d):
    return cohort.planned_sizes(spark, [30, 60, 120], 0.05, 0.25, 0.08, 200)


_count = lambda cues: " + ".join(rf"len(regexp_extract_all(t, '\b(?:{c})\b'))" for c in cues)


@query(
    rf"""with recursive {BASELINES.replace('select trim', 'select doc_id, trim').replace('c as (select', 'c as (select doc_id, t,')}, k as (select doc_id, case when spec then 'possible' when neg then 'absent' else 'present' end as d, {_count(features.SCORE_NEGATION)} as n, {_count(features.SCORE_SPECULATION)} as s from c),
r as (select d, case d when 'present' then 0.64::double when 'absent' then case when n > 0 and s > 0 then 0.30 else 0.18 end else case when n > 0 and s > 0 then 0.30 else 0.20 end end as p, case d when 'present' then greatest(0.18::double, 0.26 + n * 0.08::double) when 'absent' then 0.72::double + least(0.12::double, n * 0.04::double) else case when n > 0 and s > 0 then 0.48 else 0.18 + n * 0.04::double end end as a, case d when 'present' then greatest(0.18::double, 0.26 + s * 0.08::double) when 'absent' then case when n > 0 and s > 0 then 0.48 else 0.20 + s * 0.04::double end else 0.72::double + least(0.12::double, s * 0.04::double) end as o from k)
select d as status, count(*) as sentences, round(avg(p / (p + a + o)), 6) as present, round(avg(a / (p + a + o)), 6) as absent, round(avg(o / (p + a + o)), 6) as possible from r group by 1""".replace("with recursive s as", "with s as")
)
def q_status_scores(spark, d):
    rows = table(spark, d, "documents").select(F.explode(segment.sentences(F.col("text"))).alias("s"))
    said = features.status_baselines(F.col("s"), assertion.SPECULATION, assertion.PSEUDO)["context_style"]
    t = F.trim(F.regexp_replace(T.lower(F.col("s")), r"\s+", " "))
    made = rows.select(said.alias("status"), *(v.alias(k) for k, v in features.status_scores(t, said).items()))
    return made.groupBy("status").agg(F.count(F.lit(1)).alias("sentences"), *(F.round(F.avg(c), 6).alias(c) for c in ("present", "absent", "possible")))


@query("select * from (values (1, 1.0::double, round(7 / 20.0::double, 6)), (2, 0.5::double, 0.5::double), (3, 0.0::double, 0.0::double)) t(item_id, overlap, containment)")
def q_overlaps(spark, d):
    rows = spark.createDataFrame([(1, "aspirin", "aspirin 81 mg started"[:20]), (2, "red fox runs away", "red fox sits there"), (3, "", "x")], "item_id int, a string, b string")
    words = lambda c: F.filter(F.split(F.col(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    return rows.select("item_id", F.round(features.overlap(words("a"), words("b")), 6).alias("overlap"), F.round(features.containment(F.col("a"), F.col("b")), 6).alias("containment"))


@query("select * from (values (1, 'present_grounded', true), (2, 'distractor_negated', false), (3, 'value_not_grounded', false), (4, 'non_gold_sentence', false), (5, 'value_not_grounded', false)) t(item_id, reason, supported)")
def q_grounded_labels(spark, d):
    rows = [(1, "aspirin 81 mg", "Started aspirin 81 mg.", True, None), (2, "warfarin", "Denies warfarin use.", False, "negated"), (3, "lasix", "Started aspirin 81 mg", True, None), (4, "lasix 40", "lasix 40 at home", False, None), (5, "", "x", True, None)]
    df = spark.createDataFrame(rows, "item_id int, value string, sentence string, gold boolean, trap string")
    return features.grounded(df, F.col("value"), F.regexp_replace("sentence", r"\.$", ""), F.col("gold"), F.col("trap")).select("item_id", "reason", "supported")


@query("with l as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'abstain_low_overlap' when '2-HIGH' then 'abstain_weak_overlap' when '5-LOW' then 'multi_span_recovered' else 'other' end as status, o_totalprice from orders) select o_orderkey, status from l order by case status when 'abstain_low_overlap' then 0 when 'abstain_weak_overlap' then 1 when 'multi_span_recovered' then 5 else 50 end, o_orderkey % 7, o_totalprice desc, o_orderkey limit 50")
def q_stress_tasks(spark, d):
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "abstain_low_overlap").when(p == "2-HIGH", "abstain_weak_overlap").when(p == "5-LOW", "multi_span_recovered").otherwise("other")
    rows = table(spark, d, "orders").select("o_orderkey", status.alias("status"), (F.col("o_orderkey") % 7).alias("rate"), "o_totalprice")
    return features.stress_tasks(rows, "status", "rate", "o_totalprice", ["o_orderkey"], 50).select("o_orderkey", "status")


@query("select unnest([{rule: 'positive', rows: (select count(*) from events where not coalesce(value > 0, false))}, {rule: 'typed', rows: (select count(*) from events where not coalesce(event_type in ('view', 'click'), false))}, {rule: 'small', rows: (select count(*) from events where not coalesce(value < 100, false))}], recursive := true)")
def q_violations(spark, d):
    return features.violations(table(spark, d, "events"), {"positive": F.col("value") > 0, "typed": F.col("event_type").isin("view", "click"), "small": F.col("value") < 100})


@query(f"with f as (select l_returnflag as model, l_linestatus as arm, unnest([{{measure: 'discounted', x: l_discount > 0.05}}, {{measure: 'large', x: l_quantity > 25}}, {{measure: 'taxed', x: case when l_discount > 0.02 then l_tax > 0.04 end}}], recursive := true) from lineitem), t as (select model, arm, measure, count(*) as n, count(*) filter (x) as hits from f where x is not null group by 1, 2, 3) select *, round(hits / n::double, 6) as rate, {WILSON('hits', 'n')[0]} as low, {WILSON('hits', 'n')[1]} as high from t")
def q_ablation_rates(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("arm"), "l_discount", "l_quantity", "l_tax")
    return features.rates(rows, ["model", "arm"], {"discounted": F.col("l_discount") > 0.05, "large": F.col("l_quantity") > 25, "taxed": F.when(F.col("l_discount") > 0.02, F.col("l_tax") > 0.04)})


@query("select * from (values ('a', 2, 1, 1, 0.666667::double, 0.666667::double, 0.666667::double)) t(record_id, tp, fp, fn, precision, recall, f1)")
def q_derived_gold(spark, d):
    """Candidates of the reference are gold, those of the source predictions: two of three agree."""
    rows = spark.createDataFrame([("a", "DISCHARGE MEDICATIONS:\n1. Aspirin 81 mg daily.\n2. Lasix 40 mg.\nDISCHARGE DIAGNOSES:\n1. Pneumonia.", "DISCHARGE MEDICATIONS:\n1. Aspirin 81 mg daily.\n2. Metoprolol 25 mg.\nDISCHARGE DIAGNOSES:\n1. Pneumonia.")], "record_id string, source string, reference string")
    side = lambda c: spans.candidate_index(rows.select(F.col("record_id").alias("doc_id"), F.col(c).alias("text"))).select(F.col("doc_id").alias("record_id"), "domain", F.col("candidate_id").alias("item_id"), features.extractive_label(F.col("canonical_text")).alias("label"), "source_quote", F.lit("present").alias("assertion"))
    predicted, gold = side("source"), side("reference")
    return matching.matched_scores(predicted, gold, matching.matches(matching.candidates(predicted, gold)))
