"""Enrichment joins, inventories, funnels, hunting guides, forensic scopes and response times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.normalize import is_private_v4, is_public_v4

DIMENSION_ROWS = 100_000


def small(df: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows; as it is otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def enrich_with_intel(contracts: DataFrame, indicators: DataFrame, now: Column, generated: Column | None, max_age_s: int = 86_400) -> DataFrame:
    """(id, status, matches, private_guard) for rows (id, verified, src, dst) against (indicator, confidence).

    Unverified provenance is skipped; private end points are annotated and never looked up; without a
    snapshot time the feed is unavailable, and an old one is stale; else matches are exact."""
    ends = contracts.select("id", "verified", F.explode(F.array_distinct(F.array_compact(F.array("src", "dst")))).alias("ip"))
    ends = ends.withColumn("public", is_public_v4(F.col("ip")))
    found = ends.join(small(indicators), F.expr("verified and public and ip = indicator"), "left")
    per = found.groupBy("id").agg(F.bool_or("public").alias("any_public"), F.bool_or(~F.col("public")).alias("guarded"), F.array_sort(F.collect_set(F.when(F.col("indicator").isNotNull(), F.col("ip")))).alias("matches"))
    age = F.lit(None).cast("double") if generated is None else (F.unix_micros(now) - F.unix_micros(generated)) / 1e6
    rows = contracts.select("id", "verified").join(per, "id", "left")
    status = (
        F.when(~F.coalesce("verified", F.lit(False)), "skipped_unverified_provenance").when(F.col("guarded") & ~F.col("any_public"), "internal_lab_entity_annotated")
        .when(age.isNull(), "degraded_enrichment_unavailable").when(age > max_age_s, "degraded_enrichment_stale").when(F.size("matches") > 0, "matched_verified_ioc").otherwise("clean_no_ioc_match")
    )
    usable = status.isin("matched_verified_ioc")
    return rows.select("id", status.alias("status"), F.when(usable, F.col("matches")).otherwise(F.array().cast("array<string>")).alias("matches"), (F.coalesce("verified", F.lit(False)) & F.coalesce("guarded", F.lit(False))).alias("private_guard"))


def upsert_latest(held: DataFrame, new: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Rows of both by key, the latest wins (ties: the larger row)."""
    both = held.unionByName(new)
    rest = [c for c in both.columns if c not in keys and c != at]
    best = both.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in [at, *rest]])


def with_state(alerts: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Alerts with their analyst state; those without one are new."""
    return alerts.join(states, key, "left").withColumn("state", F.coalesce("state", F.lit("new")))


def history_breaks(transitions: DataFrame, key: str, order: str) -> DataFrame:
    """Transitions (old_state, new_state) whose old state is not the state before (the first: new)."""
    before = F.lag("new_state").over(Window.partitionBy(key).orderBy(order))
    return transitions.withColumn("expected", F.coalesce(before, F.lit("new"))).where(F.col("old_state") != F.col("expected"))


def worst_cvss(techniques: DataFrame, technique_cve: DataFrame, cve_score: DataFrame) -> DataFrame:
    """(technique, cves, worst) through the technique-CVE and CVE-score tables."""
    return techniques.join(small(technique_cve), "technique", "left").join(small(cve_score), "cve", "left").groupBy("technique").agg(F.count("cve").alias("cves"), F.max("cvss").alias("worst"))


def registered_only(events: DataFrame, sensors: DataFrame, sensor: str, event_id: str, order: str) -> DataFrame:
    """Events of registered sensors, the first row of every event id."""
    rows = events.join(small(sensors.select(sensor).distinct()), sensor, "left_semi")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(event_id).orderBy(order))).where("_n = 1").drop("_n")


def asset_inventory(flows: DataFrame, src: str, dst: str, t: str, flow_id: str, memory: DataFrame | None = None) -> DataFrame:
    """(entity, flows, first_seen, last_seen, private, notes): every end point once, flows counted once each."""
    ends = flows.select(F.explode(F.array(src, dst)).alias("entity"), F.col(t).alias("t"), F.col(flow_id).alias("f")).where("entity is not null")
    per = ends.groupBy("entity").agg(F.count_distinct("f").alias("flows"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))
    per = per.withColumn("private", is_private_v4(F.col("entity")))
    if memory is None:
        return per.withColumn("notes", F.lit(0).cast("long"))
    return per.join(memory.groupBy("entity").agg(F.count(F.lit(1)).alias("notes")), "entity", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))


def evidence(flows: DataFrame, flow_id: str, src: str, dst: str, service: str, proto: str, score: str, campaign: str) -> DataFrame:
    """Per flow: how often its end points occur (a flow counts once), its (service, protocol) baseline, its campaign's size."""
    ends = flows.select(flow_id, F.explode(F.array_distinct(F.array_compact(F.array(src, dst)))).alias("_e"))
    often = ends.groupBy("_e").agg(F.count(F.lit(1)).alias("_n"))
    per = ends.join(often, "_e").groupBy(flow_id).agg(F.max("_n").alias("entity_flows"))
    base = flows.groupBy(F.col(service).alias("_s"), F.col(proto).alias("_p")).agg(F.count(F.lit(1)).alias("baseline"), F.avg(score).alias("baseline_score"))
    size = flows.where(F.col(campaign).isNotNull()).groupBy(campaign).agg(F.count(F.lit(1)).alias("campaign_size"))
    rows = flows.join(per, flow_id, "left").join(base, F.expr(f"{service} <=> _s and {proto} <=> _p")).drop("_s", "_p").join(size, campaign, "left")
    return rows.withColumn("campaign_size", F.coalesce("campaign_size", F.lit(1)))


def campaign_groups(flows: DataFrame, campaign: str, flow_id: str, t: str, most: int = 20) -> DataFrame:
    """(campaign, flows, first, last, members): a null campaign is a group of its own; members are the first `most` ids,
    taken by rank, so that no group is gathered whole."""
    rows = flows.withColumn("_c", F.coalesce(F.col(campaign).cast("string"), F.concat(F.lit("flow:"), F.col(flow_id).cast("string"))))
    counts = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("flows"), F.min(t).alias("first"), F.max(t).alias("last"))
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_c").orderBy(t, flow_id))).where(F.col("_n") <= most)
    members = top.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_n", F.col(flow_id).cast("string").alias("id")))).alias("m"))
    return counts.join(members, "_c").select(F.col("_c").alias("campaign"), "flows", "first", "last", F.transform("m", lambda x: x.id).alias("members"))


def hunting_guides(flows: DataFrame, guides: DataFrame, technique: str = "technique") -> DataFrame:
    """(guide, flows, percent): flows of each guide's technique and their whole percentage, guides without any kept."""
    per = flows.groupBy(technique).agg(F.count(F.lit(1)).alias("n"))
    total = flows.agg(F.count(F.lit(1)).alias("_t"))
    rows = guides.join(per, technique, "left").crossJoin(total)
    percent = F.when(F.col("_t") > 0, F.least(F.lit(100), F.floor(100 * F.coalesce("n", F.lit(0)) / F.col("_t")))).otherwise(0)
    return rows.select("guide", F.coalesce("n", F.lit(0)).alias("flows"), percent.cast("int").alias("percent"))


def largest_z(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, z): how far the largest value lies above the mean, in deviations of at least 1."""
    return df.groupBy(key).agg(F.round((F.max(value) - F.avg(value)) / F.greatest(F.stddev_pop(value), F.lit(1.0)), 2).alias("z"))


def forensic_scope(flows: DataFrame, campaign: str, t: str, flow_id: str, src: str, dst: str, technique: str, decision: str = "decision", steps: int = 8) -> DataFrame:
    """Per campaign of attack flows (a null decision counts as attack): earliest source, distinct assets, techniques in
    order of first sight, and the first `steps` flow ids."""
    rows = flows.where(F.coalesce(F.col(decision), F.lit("Attack")) == "Attack")
    head = rows.groupBy(campaign).agg(F.min_by(src, F.struct(t, flow_id)).alias("first_host"), F.count(F.lit(1)).alias("flows"))
    assets = rows.select(campaign, F.explode(F.array_compact(F.array(src, dst))).alias("a")).groupBy(campaign).agg(F.count_distinct("a").alias("assets"))
    seen = rows.where(F.col(technique).isNotNull()).groupBy(campaign, technique).agg(F.min(F.struct(t, flow_id)).alias("_at"))
    techniques = seen.groupBy(campaign).agg(F.array_sort(F.collect_list(F.struct("_at", technique))).alias("x")).select(campaign, F.array_join(F.transform("x", lambda v: v[technique]), ",").alias("techniques"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(campaign).orderBy(t, flow_id))).where(F.col("_n") <= steps)
    line = first.groupBy(campaign).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(flow_id).cast("string").alias("id")))).alias("x")).select(campaign, F.array_join(F.transform("x", lambda v: v.id), ",").alias("timeline"))
    return head.join(assets, campaign, "left").join(techniques, campaign, "left").join(line, campaign, "left")


def study_summary(trials: DataFrame, cohort: str, condition: str, seconds: str, correct: str, base: str, tool: str, least: int = 3) -> DataFrame:
    """Per cohort: mean and exact median per condition, speed-up, accuracy gain, and whether both have enough trials; no data gives null."""
    aggs = []
    for name, value in (("base", base), ("tool", tool)):
        here = F.col(condition) == value
        aggs += [F.count_if(here).alias(f"{name}_n"), F.avg(F.when(here, F.col(seconds))).alias(f"{name}_mean"), F.percentile(F.when(here, F.col(seconds)), 0.5).alias(f"{name}_median"), F.avg(F.when(here, F.col(correct).cast("double"))).alias(f"{name}_accuracy")]
    rows = trials.groupBy(cohort).agg(*aggs)
    return rows.withColumns({"speed_up": F.try_divide("base_mean", "tool_mean"), "accuracy_gain": F.col("tool_accuracy") - F.col("base_accuracy"), "eligible": (F.col("base_n") >= least) & (F.col("tool_n") >= least)})


def response_times(incidents: DataFrame, responses: DataFrame, key: str, detected: str, opened: str, closed: str) -> DataFrame:
    """One row: incidents, responded, mean seconds to investigate and to respond (negative gaps count as 0); null without data."""
    both = incidents.join(responses, key, "left")

    def gap(a: str, b: str) -> Column:
        return F.greatest(F.lit(0.0), (F.unix_micros(b) - F.unix_micros(a)) / 1e6)

    return both.agg(F.count(F.lit(1)).alias("incidents"), F.count(closed).alias("responded"), F.avg(F.when(F.col(opened).isNotNull(), gap(detected, opened))).alias("mtti_s"), F.avg(F.when(F.col(closed).isNotNull(), gap(detected, closed))).alias("mttr_s"))


def stage_funnel(flows: DataFrame, decision: str, score: str, campaign: str, sure: float = 0.9) -> DataFrame:
    """One row: flows, attacks, sure attacks, campaigns of attacks, and the share of flows compressed away."""
    attack = F.col(decision) == "Attack"
    row = flows.agg(F.count(F.lit(1)).alias("flows"), F.count_if(attack).alias("attacks"), F.count_if(attack & (F.col(score) >= sure)).alias("sure"), F.count_distinct(F.when(attack, F.col(campaign))).alias("campaigns"))
    return row.withColumn("compressed_pct", F.when(F.col("flows") > 0, 100.0 * (F.col("flows") - F.col("campaigns")) / F.col("flows")))


def queue_page(flows: DataFrame, score: str, row_id: str, size: int, *tests: Column) -> DataFrame:
    """The rows that meet every test, by descending score."""
    for test in tests:
        flows = flows.where(test)
    return flows.orderBy(F.desc(score), row_id).limit(size)


def technique_of(title: Column, scenario: Column, nearest: Column, port: Column, ports: dict[int, str], digits: str = "{4}") -> Column:
    """Title token, else scenario label, else nearest corpus hit, else the destination port's technique. A token's number has
    four digits, as the catalogue's ids have; `digits` is the quantifier for other catalogues."""
    token = F.upper(F.regexp_extract(F.coalesce(title, F.lit("")), rf"(?i)\bT\d{digits}(?:\.\d{{3}})?\b", 0))
    by_port = F.lit(None).cast("string")
    for p, name in ports.items():
        by_port = F.when(port == p, name).otherwise(by_port)
    return F.coalesce(F.when(token != "", token), F.when(scenario != "", scenario), nearest, by_port)


def first_attack_flows(members: DataFrame, attacks: DataFrame, incident: str, order: str, flow_id: str, campaign: str | None = None) -> DataFrame:
    """(incident, flow): the earliest member that is an attack flow, else the first attack of the incident's campaign."""
    own = members.join(attacks.select(flow_id), flow_id, "left_semi").groupBy(incident).agg(F.min_by(flow_id, F.struct(order, flow_id)).alias("_own"))
    rows = members.select(incident, *([campaign] if campaign else [])).distinct().join(own, incident, "left")
    if not campaign:
        return rows.select(incident, F.col("_own").alias("flow"))
    by = attacks.groupBy(campaign).agg(F.min(flow_id).alias("_by"))
    return rows.join(by, campaign, "left").groupBy(incident).agg(F.coalesce(F.min("_own"), F.min("_by")).alias("flow"))


def compression_tiers(row: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(stage, n, compressed_pct) of a one-row funnel against its first stage; null where that is empty."""
    base = F.col(stages[0])
    cells = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("long").alias("n"), F.when(base > 0, 100.0 * (base - F.col(s)) / base).alias("compressed_pct")) for s in stages])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def playbook_of(decision: Column, technique: Column, playbooks: dict[str, str], default: str) -> Column:
    """The candidate playbook of an attack row by its technique; null for others."""
    found = F.lit(default)
    for name, playbook in playbooks.items():
        found = F.when(technique == name, playbook).otherwise(found)
    return F.when(decision == "Attack", found)


def compatibility(features: DataFrame, policy: DataFrame, key: str) -> DataFrame:
    """`features` with the policy's decision (supported or incompatible); unlisted representations are unknown."""
    return features.join(small(policy), key, "left").withColumn("decision", F.coalesce("decision", F.lit("unknown")))
