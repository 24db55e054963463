"""Queries over changes between two records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import views as V
from . import serial_queries as S
from .registry import oracle_text, query

_LEVELS = "(SELECT l_orderkey AS record_id, 'L' || l_linenumber::VARCHAR AS lead, (max(round(l_discount * 100)::BIGINT) - 5) / 20.0::DOUBLE AS level FROM lineitem GROUP BY ALL)"
_LEADS = f"""(SELECT prior_id, current_id, a.lead, a.level AS prior, b.level AS current, round(b.level - a.level, 4) AS diff, abs(b.level - a.level) > 0.12 AS significant,
    CASE WHEN b.level > a.level THEN 'elevated' WHEN abs(b.level - a.level) > 0.12 THEN 'depressed' ELSE 'unchanged' END AS direction
    FROM v_pairs JOIN {_LEVELS} a ON a.record_id = prior_id JOIN {_LEVELS} b ON b.record_id = current_id AND b.lead = a.lead)"""
_SPANS = f"""(SELECT g.prior_id, g.current_id, g.measure, a.value AS prior, b.value AS current, b.value - a.value AS diff, significant, direction, suppressed FROM ({oracle_text("P11_gated_changes")}) g
    JOIN {S._LONG} a ON a.record_id = g.prior_id AND a.measure = g.measure JOIN {S._LONG} b ON b.record_id = g.current_id AND b.measure = g.measure)"""
_STUDIES = "(SELECT record_id, ((qrs - 60) / 10)::BIGINT AS beats, CASE WHEN hr < 50 THEN 'noisy' ELSE 'ok' END AS quality FROM v_obs)"
_DELTAS = f"""(WITH l AS MATERIALIZED (SELECT prior_id, current_id, 'interval' AS kind, measure AS name, prior, current, diff, significant, direction, suppressed, false AS rhythm FROM {_SPANS}
    UNION ALL SELECT prior_id, current_id, 'lead', lead, prior, current, diff, significant, direction, NULL, false FROM {_LEADS}
    UNION ALL SELECT prior_id, current_id, 'finding', label, NULL, NULL, NULL, true, change, NULL, rhythm FROM {S._CHANGES} JOIN v_dict ON label = code),
  g AS (SELECT prior_id, current_id, list({{'kind': kind, 'name': name, 'prior': prior, 'current': current, 'diff': diff, 'significant': significant, 'direction': direction, 'suppressed': suppressed, 'rhythm': rhythm}} ORDER BY kind, name) AS c FROM l GROUP BY ALL)
  SELECT p.*, coalesce(c, []) AS c, list_filter([CASE WHEN a.quality <> 'ok' THEN 'prior study flagged ' || a.quality END, CASE WHEN b.quality <> 'ok' THEN 'current study flagged ' || b.quality END,
    CASE WHEN a.beats BETWEEN 1 AND 4 THEN 'prior beat built from only ' || a.beats::VARCHAR || ' beats' END, CASE WHEN b.beats BETWEEN 1 AND 4 THEN 'current beat built from only ' || b.beats::VARCHAR || ' beats' END], lambda x: x IS NOT NULL) AS caveats
  FROM v_pairs p LEFT JOIN g USING (prior_id, current_id) LEFT JOIN {_STUDIES} a ON a.record_id = prior_id LEFT JOIN {_STUDIES} b ON b.record_id = current_id)"""


def _of(kind: str, test: str = "true") -> str:
    return f"list_filter(c, lambda x: x.kind = '{kind}' AND coalesce(x.significant, false) AND {test})"


def _names(items: str) -> str:
    return f"list_transform({items}, lambda x: x.name)"


def _listed(names: str) -> str:
    return f"(CASE WHEN len({names}) <= 1 THEN array_to_string({names}, '') ELSE array_to_string({names}[1:len({names}) - 1], ', ') || ' and ' || {names}[-1] END)"


def _change(items: str, word: str) -> str:
    worst = f"list_sort(list_transform({items}, lambda x: {{'d': -round(abs(x.diff), 4), 'name': x.name, 'prior': x.prior, 'current': x.current}}))[1]"
    lead = f"CASE WHEN len({items}) > 1 THEN {worst}.name || ' ' ELSE '' END"
    opener = f"CASE WHEN len(list_filter({items}, lambda x: abs(x.prior) >= 0.1)) > 0 THEN 'Increased' ELSE 'New' END"
    return f"CASE WHEN len({items}) > 0 THEN {opener} || ' ST-segment {word} in ' || {_listed(_names(items))} || ' (' || {lead} || printf('%+.2f mV', {worst}.prior) || ' to ' || printf('%+.2f mV', {worst}.current) || ')' END"


_WHOLE = "round({}, 0)::BIGINT::VARCHAR"
_LOW, _HIGH = "(x.current <= -0.1 AND x.diff < 0)", "(x.current >= 0.1 AND x.diff > 0)"
_ENDED = "(abs(x.prior) >= 0.1 AND abs(x.current) < 0.1)"
_MOVED = f"""list_transform({_of('interval')}, lambda x: 'The ' || x.name || ' is ' || x.direction || ' from ' || {_WHOLE.format('x.prior')} || ' to ' || {_WHOLE.format('x.current')}
    || ' (' || CASE WHEN round(x.diff, 0) >= 0 THEN '+' ELSE '' END || {_WHOLE.format('x.diff')} || ')')"""
_SOME = "lambda x: x IS NOT NULL"
_REPORT = f"""(WITH d AS MATERIALIZED {_DELTAS},
  n AS (SELECT *, {_of('finding', "x.direction = 'new'")} AS new_all, {_of('finding', "x.direction = 'resolved'")} AS gone_all, {_of('lead', _LOW)} AS low, {_of('lead', _HIGH)} AS high, {_names(_of('lead', _ENDED))} AS ended,
    {_names(_of('lead', f'NOT ({_LOW} OR {_HIGH} OR {_ENDED})'))} AS subtle, {_MOVED} AS moved, {_names(_of('interval'))} AS spans FROM d),
  t AS (SELECT *, len(list_filter(new_all, lambda x: x.rhythm)) = 1 AND len(list_filter(gone_all, lambda x: x.rhythm)) = 1 AS turn FROM n),
  r AS (SELECT *, {_names('list_filter(new_all, lambda x: NOT (turn AND x.rhythm))')} AS new, {_names('list_filter(gone_all, lambda x: NOT (turn AND x.rhythm))')} AS gone,
    list_filter(new_all, lambda x: x.rhythm)[1].name AS into_, list_filter(gone_all, lambda x: x.rhythm)[1].name AS out_, list_filter([{_change('low', 'depression')}, {_change('high', 'elevation')},
    CASE WHEN len(ended) > 0 THEN 'Previously noted ST deviation in ' || {_listed('ended')} || ' has resolved' END, CASE WHEN len(subtle) > 0 THEN 'Sub-threshold ST shift in ' || {_listed('subtle')} END], {_SOME}) AS st FROM t),
  b AS (SELECT *, list_filter([CASE WHEN turn THEN out_ || CASE WHEN into_ = 'NATION_4' THEN ' has reverted to ' ELSE ' has changed to ' END || into_ END, CASE WHEN len(new) > 0 THEN 'New since the prior study: ' || {_listed('new')} END,
    CASE WHEN len(gone) > 0 THEN 'No longer present: ' || {_listed('gone')} END], {_SOME}) || st || moved AS body, list_transform(list_filter(c, lambda x: x.suppressed IS NOT NULL), lambda x: x.name || ': ' || x.suppressed) AS blocked FROM r)
  SELECT prior_id, current_id, c, 'Compared with the prior study of ' || strftime(prior_ts, '%Y-%m-%d') || ': ' || CASE WHEN len(body) > 0 THEN array_to_string(body, '. ') ELSE 'no significant change' END || '.' || chr(10) || 'Impression: '
    || CASE WHEN len(new_all) > 0 THEN 'interval change, new ' || new_all[1].name WHEN len(st) > 0 THEN 'new or evolving repolarization change' WHEN len(moved) > 0 THEN {_listed('spans')} || ' changed; no new finding'
       WHEN len(gone) > 0 THEN 'a finding is no longer present; otherwise no change' ELSE 'no significant change' END || '.'
    || CASE WHEN len(blocked) > 0 THEN chr(10) || 'Not compared: ' || array_to_string(blocked, '; ') || '.' ELSE '' END || CASE WHEN len(caveats) > 0 THEN chr(10) || 'Data quality: ' || array_to_string(caveats, '; ') || '.' ELSE '' END AS report FROM b)"""


def levels(spark, sf):
    level = (F.max(F.round(F.col("l_discount") * 100).cast("long")) - 5) / F.lit(20.0)
    lead = F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("lead")
    lines = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), "l_linenumber", "l_discount").repartition("record_id")
    return lines.groupBy("record_id", lead).agg(level.alias("level"))


def deltas(spark, sf):
    pairs, obs = V.pairs(spark, sf), V.observations(spark, sf)
    rhythm = F.broadcast(V.dictionary(spark, sf).select(F.col("code").alias("label"), "rhythm"))
    spans = S.P.gated_changes(S.seen_diffs(spark, sf), S.floors(spark, sf))
    studies = obs.select("record_id", ((F.col("qrs") - 60) / 10).cast("long").alias("beats"), F.when(F.col("hr") < 50, "noisy").otherwise("ok").alias("quality"))
    return C.delta_rows(pairs, spans, C.lead_changes(pairs, levels(spark, sf)), S.finding_changes(spark, sf).join(rhythm, "label"), studies)


@query("P12_lead_changes", f"SELECT prior_id, current_id, lead, prior, current, diff, significant, direction FROM {_LEADS}")
def leads(spark, sf):
    return C.lead_changes(V.pairs(spark, sf), levels(spark, sf)).select("prior_id", "current_id", "lead", "prior", "current", "diff", "significant", "direction")


@query("P14_delta_rows", f"""SELECT prior_id, current_id, len(c)::INT AS n_changes, {_names(_of('interval'))} AS intervals, {_names(_of('lead'))} AS leads, {_names(_of('finding', "x.direction = 'new'"))} AS new, {_names(_of('finding', "x.direction = 'resolved'"))} AS resolved,
    caveats, len(list_filter(c, lambda x: coalesce(x.significant, false))) > 0 AS any_change FROM {_DELTAS}""")
def delta_rows(spark, sf):
    parts = {"intervals": ("interval",), "leads": ("lead",), "new": ("finding", "new"), "resolved": ("finding", "resolved")}
    return deltas(spark, sf).select("prior_id", "current_id", F.size("changes").alias("n_changes"), *[C.names(C.of_kind(*k)).alias(n) for n, k in parts.items()], "caveats", "any_change")


@query("P16_change_narratives", f"SELECT prior_id, current_id, report FROM {_REPORT}")
def narratives(spark, sf):
    return C.change_narrative(deltas(spark, sf), "NATION_4")


_CLAUSE = "list_filter(regexp_split_to_array(regexp_extract(report, '{}', 1), ', | and '), lambda x: x <> '')"
_WORD = "regexp_extract(report, 'The ' || x.name || ' is (\\w+)', 1)"
_FALSE = f"""(SELECT prior_id, current_id, c, CASE current_id % 3 WHEN 0 THEN replace(report, 'longer from', 'shorter from') WHEN 1 THEN replace(report, 'No longer present', 'New since the prior study') ELSE report END AS report FROM {_REPORT})"""


@query("P17_claim_audit", f"""SELECT prior_id, current_id, unsupported, len(unsupported) = 0 AS consistent FROM (SELECT prior_id, current_id, list_sort(
    list_transform(list_filter(list_distinct({_CLAUSE.format('New since the prior study: ([^.' + chr(92) + 'n]*)')} || {_CLAUSE.format('has (?:changed|reverted) to ([^.' + chr(92) + 'n]*)')}), lambda n: NOT list_contains({_names(_of('finding', "x.direction = 'new'"))}, n)), lambda n: 'new:' || n)
    || list_transform(list_filter(list_distinct({_CLAUSE.format('No longer present: ([^.' + chr(92) + 'n]*)')} || {_CLAUSE.format('[:.] ([^.:' + chr(92) + 'n]*) has (?:changed|reverted) to')}), lambda n: NOT list_contains({_names(_of('finding', "x.direction = 'resolved'"))}, n)), lambda n: 'resolved:' || n)
    || list_filter(list_transform(list_filter(c, lambda x: x.kind = 'interval'), lambda x: CASE WHEN {_WORD} = '' THEN NULL WHEN NOT coalesce(x.significant, false) THEN 'interval:' || x.name
       WHEN ({_WORD} = 'longer' AND x.diff < 0) OR ({_WORD} = 'shorter' AND x.diff > 0) THEN 'direction:' || x.name END), {_SOME})) AS unsupported FROM {_FALSE})""")
def audit(spark, sf):
    k, text = F.col("current_id") % 3, F.col("report")
    told = F.when(k == 0, F.replace(text, F.lit("longer from"), F.lit("shorter from"))).when(k == 1, F.replace(text, F.lit("No longer present"), F.lit("New since the prior study"))).otherwise(text)
    return C.audit_claims(C.change_narrative(deltas(spark, sf), "NATION_4", ["changes"]).withColumn("report", told))
