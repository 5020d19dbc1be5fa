"""Entities, split audit, learned signal, correlation and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, correlate, entities, learn
from ..operators.ranking import one_row
from ..session import materialize, scratch_path
from ..sources import sinks
from . import views  # noqa: F401
from .domain import TEST_PARAMS, Tables
from .registry import query


@query("entities", "select tx_id, entity_id, is_hub from ent")
def build_entities(t: Tables):
    return entities.build_entities(t.nodes, t.raw_edges, t.params.hub_degree)


@query("entity_time", "select tx_id, entity_id, time_step from ent join nodes using (tx_id)")
def entity_time(t: Tables):
    return entities.entity_times(t.entities, t.nodes).select("tx_id", "entity_id", "time_step")


@query("entity_min_step", "select entity_id, min_step from entstep")
def entity_min_step(t: Tables):
    return entities.entity_min_step(t.entities, t.nodes)


@query("entity_span", "select entity_id, max(time_step) - min(time_step) as span from ent join nodes using (tx_id) group by 1")
def entity_span(t: Tables):
    return entities.entity_span(t.entities, t.nodes)


@query("time_split", "select tx_id, entity_id, is_hub, split from splits")
def time_split(t: Tables):
    return entities.time_split(t.entities, t.nodes, t.params)


@query("entity_numbering", """
    select entity_id, min(tx_id) as first_member, row_number() over (order by min(tx_id)) as entity_no from ent group by 1""")
def entity_numbering(t: Tables):
    return entities.entity_numbering(t.entities).withColumn("entity_no", F.col("entity_no").cast("long"))


@query("split_counts", "select split, count(distinct entity_id) as entities, count(*) as txs from splits group by 1")
def split_counts(t: Tables):
    return entities.split_counts(t.split)


@query("cross_split_edges", """
    select src, dst, a.split as src_split, b.split as dst_split from raw_edges join splits a on a.tx_id = src join splits b on b.tx_id = dst
    where a.split <> b.split""")
def cross_split_edges(t: Tables):
    return entities.cross_split_edges(t.raw_edges, t.split).select("src", "dst", "src_split", "dst_split")


@query("split_overlap", """
    select k.kind, l as left_split, r as right_split, cast(0 as bigint) as shared
    from (values ('tx_id'), ('entity_id')) k(kind), (values ('train', 'val'), ('train', 'test'), ('val', 'test')) p(l, r)""")
def split_overlap(t: Tables):
    return entities.split_overlap(t.split)


LEAKAGE = """
    with s as (select max(time_step) - min(time_step) as span from ent join nodes using (tx_id) group by entity_id),
         x as (select entity_id from splits group by 1 having count(distinct split) > 1)
    select (select count(*) from (select tx_id from splits group by 1 having count(distinct split) > 1)) as tx_overlap_count,
           (select count(*) from x) as entity_overlap_count,
           (select count(*) from splits where split = 'train') as n_train_txs, (select count(*) from splits where split = 'val') as n_val_txs,
           (select count(*) from splits where split = 'test') as n_test_txs, (select count(*) from s) as n_entities,
           (select count(*) from raw_edges join splits a on a.tx_id = src join splits b on b.tx_id = dst where a.split <> b.split) as cross_split_edge_count,
           (select count(*) from s where span > 0) as entity_time_span_violations, (select max(span) from s) as max_entity_time_span,
           (select count(*) from x) = 0 as leakage_free, (select count(*) from s where span > 0) = 0 as time_span_ok,
           (select count(*) from s where span = 0) as n_entities_span0, 'time_respecting' as split_type, true as require_span_zero,
           4 as hub_degree_threshold, 0.7::double as train_fraction"""


@query("leakage_report", LEAKAGE)
def leakage_report(t: Tables):
    return entities.leakage_report(t.split, t.nodes, t.raw_edges, t.params)


@query("sink_split_audit", LEAKAGE)
def sink_split_audit(t: Tables):
    report, path = leakage_report(t), scratch_path(t.spark, "audit")
    sinks.append_audit(path, report, "run-1")
    sinks.append_audit(path, report, "run-2")
    schema = report.withColumn("run_id", F.lit("")).schema
    return sinks.latest_audit(t.spark, path, schema).drop("run_id")


@query("sink_normalised", """
    select tx_id, label, time_step, split, (select count(*) from raw_edges) as edge_rows from nodes join splits using (tx_id)""")
def sink_normalised(t: Tables):
    path = scratch_path(t.spark, "normalised")
    sinks.write_normalised(path, t.nodes, t.raw_edges, t.split)
    nodes, edges, split = sinks.read_normalised(t.spark, path)
    return nodes.join(split.select("tx_id", "split"), "tx_id").withColumn("edge_rows", edges.agg(F.count("*")).scalar())


# learned signal ----------------------------------------------------------------------


@query("train_split", "select tx_id, label, split from nodes join splits using (tx_id) where label in (0, 1) and split in ('train', 'test')")
def train_split(t: Tables):
    return learn.train_split(t.nodes, t.split).select("tx_id", "label", "split")


@query("class_weights", """
    with c as (select label, count(*) as n from nodes join splits using (tx_id) where label in (0, 1) and split = 'train' group by 1)
    select label, n as rows, round((select sum(n) from c) / (2 * n), 6) as weight from c""")
def class_weights(t: Tables):
    return learn.class_weights(learn.train_split(t.nodes, t.split).where("split = 'train'"))


FOREST = f"{TEST_PARAMS.forest_trees} as n_estimators, {TEST_PARAMS.forest_depth} as max_depth, {TEST_PARAMS.seed} as seed"
# What a report says about its rows, whatever the forest: tp + fn and fp + tn are the classes of the test split.
EVALUATED = f"""
    with r as (select label, split from nodes join splits using (tx_id) where label in (0, 1) and split in ('train', 'test') and tx_id in (select l_orderkey from lineitem)),
         n as (select count(*) filter (split = 'test') as n_test, count(*) filter (split = 'test' and label = 1) as i_test,
                      count(*) filter (split = 'train') as n_train, count(*) filter (split = 'train' and label = 1) as i_train from r)
    select n_test, i_test as illicit, n_test - i_test as licit, n_train as n_train_txids, i_test as n_illicit_test, i_train as n_illicit_train,
           round(n_train / (2 * i_train), 6) as weight_illicit, round(n_train / (2 * (n_train - i_train)), 6) as weight_licit, true as consistent, {FOREST} from n"""


def fitted(t: Tables) -> str:
    """A forest of the documented size on the train split, stored with its report."""
    def build() -> str:
        path = scratch_path(t.spark, "model")
        learn.train_and_evaluate(t.features, t.split, t.params, model_path=path, report_path=f"{path}-report")
        return path

    return t.once("forest", build)


def evaluated(report):
    """The columns of a report that follow from its rows, and whether the others follow from them."""
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    near = lambda name, value: F.abs(F.col(name) - value) < 1e-9
    consistent = near("illicit_recall", rate(tp, tp + fn)) & near("illicit_precision", rate(tp, tp + fp)) & near("accuracy", rate(tp + tn, F.col("n_test"))) & (F.col("training_seconds") > 0)
    return report.select(
        "n_test", (tp + fn).alias("illicit"), (fp + tn).alias("licit"), "n_train_txids", "n_illicit_test", "n_illicit_train", "weight_illicit", "weight_licit",
        consistent.alias("consistent"), F.col("n_estimators").cast("int").alias("n_estimators"), F.col("max_depth").cast("int").alias("max_depth"), F.col("seed").cast("int").alias("seed"),
    )


@query("train_model", f"""
    select {TEST_PARAMS.forest_trees} as trees, {TEST_PARAMS.forest_trees} as leaves_less_inner, 0 as bad_values, 0 as bad_links, 0 as bad_splits,
           (select count(*) from nodes join splits using (tx_id) where label in (0, 1) and split = 'train' and tx_id in (select l_orderkey from lineitem)) as train_rows""")
def train_model(t: Tables):
    """A fitted forest as a table: whole trees, shares as values, splits on known features."""
    train = materialize(learn.train_split(t.features, t.split).where("split = 'train'").select("label", "features"), "train")
    faults = learn.forest_faults(learn.forest_table(learn.train_model(train, t.params)), 8)
    return faults.withColumn("train_rows", train.agg(F.count("*")).scalar())


@query("train_and_evaluate", EVALUATED)
def train_and_evaluate(t: Tables):
    return evaluated(learn.train_and_evaluate(t.features, t.split, t.params)[1])


@query("model_eval_report", EVALUATED)
def model_eval_report(t: Tables):
    return evaluated(t.spark.read.json(f"{fitted(t)}-report"))


@query("sink_model", f"""
    select count(distinct l_orderkey) as scored, true as in_range, {TEST_PARAMS.forest_trees} as trees, {TEST_PARAMS.forest_trees} as leaves_less_inner from lineitem""")
def sink_model(t: Tables):
    """Every row with features scored by joins with the stored forest."""
    forest = learn.load_model(t.spark, fitted(t))
    scored = learn.forest_risk(forest, t.features).agg(F.count("*").alias("scored"), F.min(F.col("risk").between(0, 1)).alias("in_range"))
    return one_row(scored, learn.forest_faults(forest, 8).select("trees", "leaves_less_inner"))


@query("score_all", "select distinct l_orderkey as tx_id, true as in_range, true as agrees from lineitem")
def score_all(t: Tables):
    """Risks by the fitted model, within 0 and 1 and equal to those that joins with its table give."""
    train = materialize(learn.train_split(t.features, t.split).where("split = 'train'").select("label", "features"), "train")
    model = learn.train_model(train, t.params)
    joined = learn.forest_risk(learn.forest_table(model), t.features).withColumnRenamed("risk", "by_joins")
    return learn.predict_risk(model, t.features).join(joined, "tx_id").select(
        "tx_id", F.col("risk").between(0, 1).alias("in_range"), (F.abs(F.col("risk") - F.col("by_joins")) < 1e-9).alias("agrees")
    )


@query("score_wallets", """
    select tx_id, risk is not null as classified, round(risk, 6) as risk_score,
           case when risk >= 0.5 then 'illicit' when risk is not null then 'licit' end as prediction,
           coalesce(risk >= 0.5, false) as learned_flag, 0.5::double as flag_threshold from nodes left join riskset using (tx_id)""")
def score_wallets(t: Tables):
    return learn.learned_signal(t.nodes, t.stand_in_risk, t.params)


@query("eval_metrics", """
    with c as (select count(*) as n, count(*) filter (risk >= 0.5 and label = 1) as tp, count(*) filter (risk >= 0.5 and label = 0) as fp,
                      count(*) filter (risk < 0.5 and label = 1) as fn, count(*) filter (risk < 0.5 and label = 0) as tn
               from nodes join splits using (tx_id) join riskset using (tx_id) where label in (0, 1) and split = 'test')
    select n as n_test, tp, fp, fn, tn, tp / (tp + fn) as illicit_recall, tp / (tp + fp) as illicit_precision,
           2 * tp / (2 * tp + fp + fn) as illicit_f1, (tp + tn) / n as accuracy, 0.5::double as flag_threshold from c""")
def eval_metrics(t: Tables):
    test = learn.train_split(t.nodes, t.split).where("split = 'test'")
    return learn.eval_metrics(test.join(t.stand_in_risk, "tx_id"), t.params.learned_threshold)


@query("audit_sample", """
    (select 'licit' as stratum, tx_id, label from nodes where label = 0 order by md5('42:' || tx_id), tx_id limit 25) union all
    (select 'illicit', tx_id, label from nodes where label = 1 order by md5('42:' || tx_id), tx_id limit 25) union all
    (select 'any', tx_id, label from nodes order by md5('42:' || tx_id), tx_id limit 60)""")
def audit_sample(t: Tables):
    return learn.audit_sample(t.nodes, t.params.seed)


# correlation -------------------------------------------------------------------------


@query("correlate", "select tx_id, rule_score, rule_flagged, classified, risk_score, learned_flag, verdict from verdictset")
def correlate_signals(t: Tables):
    return t.verdicts.select("tx_id", "rule_score", "rule_flagged", "classified", "risk_score", "learned_flag", "verdict")


@query("batch_verdicts", "select verdict, count(*) as wallets from verdictset group by 1")
def batch_verdicts(t: Tables):
    return t.verdicts.groupBy("verdict").agg(F.count("*").alias("wallets"))


@query("live_verdict_cap", """
    select tx_id, case when verdict = 'confirmed' and not (label in (0, 1)) then 'watch' else verdict end as verdict,
           case when not (label in (0, 1)) then 'capped at watch: one independent signal' end as correlation_cap from verdictset""")
def live_verdict_cap(t: Tables):
    return correlate.live_verdict_cap(t.verdicts, F.col("label").isin(0, 1)).select("tx_id", "verdict", "correlation_cap")


@query("correlation_invariants", """
    select cast(0 as bigint) as confirmed_without_both, cast(0 as bigint) as raised_without_signal, cast(0 as bigint) as signal_dropped,
           count(*) filter (verdict = 'confirmed' and label = 0) as known_licit_confirmed from verdictset""")
def correlation_invariants(t: Tables):
    return correlate.correlation_invariants(t.verdicts)


@query("signal_overlap", """
    with c as (select count(*) filter (rule_flagged and learned_flag) as b, count(*) filter (rule_flagged and not learned_flag) as ro,
                      count(*) filter (learned_flag and not rule_flagged) as lo, count(*) filter (label = 1) as i,
                      count(*) filter (label = 1 and rule_flagged) as ir, count(*) filter (label = 1 and learned_flag) as il,
                      count(*) filter (label = 1 and (rule_flagged or learned_flag)) as iu from verdictset where label in (0, 1))
    select b as both, ro as rule_only, lo as learned_only, i as illicit, ir as illicit_rule, il as illicit_learned, iu as illicit_union,
           ir / i as rule_recall, il / i as learned_recall, iu / i as union_recall, ir / (b + ro) as rule_precision, il / (b + lo) as learned_precision from c""")
def signal_overlap(t: Tables):
    return correlate.signal_overlap(t.verdicts)


@query("verdict_breakdown", "select label, verdict, count(*) as wallets from verdictset group by 1, 2")
def verdict_breakdown(t: Tables):
    return correlate.verdict_breakdown(t.verdicts)


# clusters and attribution ------------------------------------------------------------


def summary(t: Tables):
    return clusters.cluster_summary(t.entities, t.nodes)


def matches(t: Tables):
    return clusters.match_tags(t.tags, t.address_map, t.entities)


def attributed(t: Tables):
    return clusters.attribute_clusters(summary(t), matches(t))


@query("cluster_summary", "select *, 'elliptic-derived' as confidence_tier from clusterset")
def cluster_summary(t: Tables):
    return summary(t)


@query("member_sample", """
    select entity_id as cluster_id, array_to_string(list_sort(list(tx_id))[1:10], ',') as members, greatest(count(*) - 10, 0) as n_members_truncated
    from ent group by 1""")
def member_sample(t: Tables):
    lists = clusters.member_sample(t.entities, t.params.member_sample)
    text = F.concat_ws(",", F.col("members_sample").cast("array<string>"))
    return lists.select("cluster_id", text.alias("members"), "n_members_truncated")


@query("tag_matches", "select *, 'supplementary-source' as confidence_tier from tagmatch")
def tag_matches(t: Tables):
    return matches(t)


@query("attribute_clusters", """
    select *, case when attributed_name is not null then 'VASP' end as category, 'elliptic-derived' as confidence_tier,
           case when attributed_name is not null then 'supplementary-source' end as attribution_tier from attributed""")
def attribute_clusters(t: Tables):
    return attributed(t)


@query("unmatched_tags", """
    select * from tagset where address not in (select address from tagmatch)
    union all select position, 'ghost-' || address, name, source, jurisdiction from tagset""")
def unmatched_tags(t: Tables):
    ghosts = t.tags.withColumn("address", F.concat(F.lit("ghost-"), "address"))
    return clusters.unmatched_tags(t.tags.unionByName(ghosts), matches(t))


@query("cluster_verdict_join", "select entity_id as cluster_id, tx_id, verdict from verdictset join ent using (tx_id)")
def cluster_verdict_join(t: Tables):
    return clusters.cluster_verdict_join(t.verdicts, t.entities, summary(t))


@query("cluster_verdicts", """
    select entity_id as cluster_id, count(*) filter (verdict = 'confirmed') as confirmed, count(*) filter (verdict = 'watch') as watch,
           count(*) filter (verdict = 'none') as none from verdictset join ent using (tx_id) group by 1""")
def cluster_verdicts(t: Tables):
    return clusters.cluster_verdicts(clusters.cluster_verdict_join(t.verdicts, t.entities, summary(t)), summary(t))


@query("cluster_report_totals", """
    select count(*) as n_clusters, count(attributed_name) as n_attributed_clusters, sum(n_wallets)::bigint as n_wallets,
           (select count(*) > 0 from tagset) as exchange_list_loaded from attributed""")
def cluster_report_totals(t: Tables):
    return clusters.cluster_report_totals(attributed(t), t.tags)


@query("sink_cluster_report", """
    select a.cluster_id, n_wallets, illicit, illicit_fraction, attributed_name, jurisdiction, confirmed, n_members
    from attributed a join (
        select entity_id as cluster_id, count(*) filter (verdict = 'confirmed') as confirmed, least(count(*), 10)::int as n_members
        from verdictset join ent using (tx_id) group by 1) using (cluster_id)""")
def sink_cluster_report(t: Tables):
    named = materialize(attributed(t), "attributed")
    report = clusters.cluster_report(t.entities, named, t.verdicts, t.params.member_sample)
    path = scratch_path(t.spark, "cluster-report")
    sinks.save_cluster_report(path, report, clusters.cluster_report_totals(named, t.tags))
    return sinks.load_cluster_report(t.spark, path, report.schema).select(
        "cluster_id", "n_wallets", "label_counts.illicit", "illicit_fraction", F.col("attribution.name").alias("attributed_name"),
        "attribution.jurisdiction", "verdict_counts.confirmed", F.size("members_sample").alias("n_members"),
    )
