"""Per-source threat intelligence, response actions and the report tables on top."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.parsing import number_or_zero, to_float, to_int
from ..functions.scores import clamp, indicator, risky_status
from ..schema import BATCH_ALIASES, resolve_column, quoted

SCORE_TYPE = "decimal(18,12)"


def _prepared(df: DataFrame) -> DataFrame:
    """The prediction fields the signals read; an absent field counts as 0."""
    def number(name: str) -> Column:
        return number_or_zero(name) if name in df.columns else F.lit(0.0)

    if "session_duration" in df.columns:
        duration = F.coalesce(F.col("session_duration").try_cast("double"), number("connection_duration"))
    else:
        duration = number("connection_duration")
    flag = R.is_anomaly("anomaly_flag") if "anomaly_flag" in df.columns else F.lit(False)
    return df.select(
        F.coalesce(F.col("src_ip"), F.lit("UNKNOWN_IP")).alias("src_ip"),
        number("threat_score").alias("score"),
        F.lower(F.coalesce(F.col("threat_type").cast("string"), F.lit("normal"))).alias("kind"),
        number("request_rate").alias("rate"),
        duration.alias("duration"),
        flag.alias("odd"),
    )


def _counts(df: DataFrame) -> DataFrame:
    """All signals of a source from one aggregate of counts; rows are folded before the shuffle.

    Scores are summed as decimals, so the result does not depend on how rows are split.
    """
    busy = (F.col("score") >= 0.7) | (F.col("kind") == "traffic_spike") | (F.col("rate") > 300)
    seen = {k: F.max(F.col("kind") == k) for k in (*R.ATTACK_CHAIN, "traffic_spike")}
    return _prepared(df).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("score").try_cast(SCORE_TYPE)).cast("double").alias("score_sum"),
        F.count_if(busy).alias("n_busy"),
        F.count_if(F.col("rate") > 500).alias("n_burst"),
        F.count_if(F.col("kind") == "brute_force").alias("n_brute"),
        F.count_if("odd").alias("n_odd"),
        F.count_if(F.col("duration") > 600).alias("n_long"),
        *[c.alias(f"seen_{k}") for k, c in seen.items()],
    )


def _network() -> Column:
    ratio, burst = F.col("n_busy") / F.col("n"), F.col("n_burst") / F.col("n")
    return F.struct(
        (ratio >= 0.3).alias("traffic_spike"),
        (burst >= 0.2).alias("connection_burst"),
        F.least(F.lit(1.0), F.lit(0.7) * ratio + F.lit(0.3) * burst).alias("score"),
    )


def _behavior() -> Column:
    weighted = F.lit(0.5) * F.col("n_brute") + F.lit(0.3) * F.col("n_odd") + F.lit(0.2) * F.col("n_long")
    return F.struct(
        (F.col("n_brute") > 0).alias("suspicious_login_pattern"),
        (F.col("n_long") > 0).alias("session_duration_deviation"),
        F.least(F.lit(1.0), weighted / F.col("n")).alias("behavior_score"),
    )


def _anomaly() -> Column:
    ratio = F.col("n_odd") / F.col("n")
    return F.struct(F.least(F.lit(1.0), F.lit(1.5) * ratio).alias("unknown_threat_score"), ratio.alias("anomaly_ratio"))


def _prediction(stage_map: Mapping[str, str]) -> Column:
    scan, brute = F.col("seen_port_scan"), F.col("seen_brute_force")
    following = (
        F.when(F.col("seen_privilege_escalation"), "data_exfiltration")
        .when(scan & brute, "privilege_escalation")
        .when(scan, "brute_force")
        .when(F.col("seen_traffic_spike"), "lateral_movement")
        .otherwise("normal")
    )
    chain = F.array_compact(F.array(*[F.when(F.col(f"seen_{k}"), k) for k in R.ATTACK_CHAIN]))
    return F.struct(
        chain.alias("observed_chain"),
        following.alias("predicted_next"),
        R.choose(following, stage_map, R.FALLBACK_STAGE).alias("predicted_stage"),
    )


def source_signals(df: DataFrame, stage_map: Mapping[str, str] = R.STAGE_MAP) -> DataFrame:
    """Per source: flow count, mean score and the four nested signals.

    The anomaly signal averages the table-wide flag. Refitting detectors inside every source, as a
    driver loop would, flags about a tenth of any handful of rows and says nothing.
    """
    return _counts(df).select(
        "src_ip",
        "n",
        (F.col("score_sum") / F.col("n")).alias("avg_score"),
        _network().alias("network"),
        _behavior().alias("behavior"),
        _anomaly().alias("anomaly"),
        _prediction(stage_map).alias("prediction"),
    )


def network_signal(df: DataFrame) -> DataFrame:
    return source_signals(df).select("src_ip", "network.*")


def behavior_signal(df: DataFrame) -> DataFrame:
    return source_signals(df).select("src_ip", "behavior.*")


def anomaly_signal(df: DataFrame) -> DataFrame:
    return source_signals(df).select("src_ip", "anomaly.*")


def stage_signal(df: DataFrame, stage_map: Mapping[str, str] = R.STAGE_MAP) -> DataFrame:
    return source_signals(df, stage_map).select("src_ip", "prediction.*")


def _assessed(df: DataFrame, stage_map: Mapping[str, str]) -> DataFrame:
    following = F.col("prediction.predicted_next")
    forecast = (
        F.when(following.isin("privilege_escalation", "lateral_movement"), F.lit(1.0))
        .when(following.isin("brute_force", "traffic_spike"), F.lit(0.7))
        .otherwise(F.lit(0.0))
    )
    unknown = F.col("anomaly.unknown_threat_score")
    agents = F.least(
        F.lit(1.0),
        F.lit(0.3) * F.col("network.score")
        + F.lit(0.3) * F.col("behavior.behavior_score")
        + F.lit(0.2) * unknown
        + F.lit(0.2) * forecast,
    )
    history = F.least(F.lit(1.0), F.col("n") / F.lit(20.0))
    final = F.lit(0.5) * F.col("avg_score") + F.lit(0.3) * agents + F.lit(0.1) * unknown + F.lit(0.1) * history
    stage = F.col("prediction.predicted_stage")
    scored = source_signals(df, stage_map).withColumn("final", clamp(final, 0.0, 1.0))
    level = R.risk_band("final", R.MEDIUM_FROM_IP)
    return scored.withColumn("risk_level", level).withColumns(
        {
            "risk_score": F.round("final", 4),
            "recommended_action": R.recommend_action(
                "risk_level", F.col("network.traffic_spike"), F.col("anomaly.anomaly_ratio"), following
            ),
            "attack_stage": F.when(stage.isin(*R.KILL_CHAIN), stage).otherwise(R.KILL_CHAIN[0]),
        }
    )


def threat_intelligence(df: DataFrame, stage_map: Mapping[str, str] = R.STAGE_MAP) -> DataFrame:
    """Per source: risk score, level, recommended action, kill-chain stage."""
    return _assessed(df, stage_map).select("src_ip", "risk_score", "risk_level", "recommended_action", "attack_stage")


def agent_decisions(df: DataFrame, stage_map: Mapping[str, str] = R.STAGE_MAP) -> DataFrame:
    """Per source: the signals behind the action, nested."""
    return _assessed(df, stage_map).select(
        "src_ip",
        F.col("network").alias("network_agent"),
        F.col("behavior").alias("behavior_agent"),
        F.col("anomaly").alias("anomaly_agent"),
        F.col("prediction").alias("prediction_agent"),
        "recommended_action",
    )


def _text_or(df: DataFrame, column: str, default: str) -> Column:
    """The column, or the default where it is absent, null or empty."""
    if column not in df.columns:
        return F.lit(default)
    return F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit(default))


def defense_actions(intel: DataFrame) -> DataFrame:
    """One simulated action per record (the given one, else by level); one N/A row when there are none."""
    given = F.when(F.col("recommended_action") != "", F.col("recommended_action")) if (
        "recommended_action" in intel.columns
    ) else F.lit(None).cast("string")
    level = _text_or(intel, "risk_level", "LOW")
    risk = F.coalesce(F.col("risk_score"), F.lit(0.0)) if "risk_score" in intel.columns else F.lit(0.0)

    def alert(score: Column) -> Column:
        return F.concat(F.lit('{"risk_score": '), score.cast("string"), F.lit("}"))

    rows = intel.select(
        _text_or(intel, "src_ip", "UNKNOWN_IP").alias("src_ip"),
        level.alias("risk_level"),
        _text_or(intel, "attack_stage", "Unknown").alias("attack_stage"),
        F.coalesce(given, R.level_action(level)).alias("recommended_action"),
        F.lit("SIMULATED_EXECUTED").alias("action_status"),
        alert(risk.cast("double")).alias("alert"),
    )
    nothing = intel.sparkSession.range(1).where(~intel.exists())
    none = nothing.select(
        F.lit("N/A").alias("src_ip"),
        F.lit("LOW").alias("risk_level"),
        F.lit("No Active Threat").alias("attack_stage"),
        F.lit("LOG_ALERT").alias("recommended_action"),
        F.lit("SIMULATED_EXECUTED").alias("action_status"),
        alert(F.lit(0.0)).alias("alert"),
    )
    return rows.unionByName(none)


def top_sources(intel: DataFrame, n: int) -> DataFrame:
    """The ``n`` riskiest sources, address as tie-break: a top-k, no full sort."""
    return intel.orderBy(F.desc("risk_score"), "src_ip").limit(n)


def with_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """The time of the report as ISO text in UTC, as the jobs store it beside alerts, attacks and the timeline."""
    return df.withColumn(column, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"))


def alerts(intel: DataFrame, n: int = 12) -> DataFrame:
    return top_sources(intel, n).select(
        F.concat(F.lit("alert_"), "src_ip").alias("id"),
        F.coalesce("attack_stage", F.lit("Unknown")).alias("attackType"),
        F.col("src_ip").alias("sourceIp"),
        R.severity(F.coalesce("risk_level", F.lit("MEDIUM"))).alias("severity"),
    )


def timeline(intel: DataFrame, n: int = 10) -> DataFrame:
    event = F.concat(F.coalesce("attack_stage", F.lit("Threat")), F.lit(" detected"))
    return top_sources(intel, n).select(F.concat(F.lit("timeline_"), "src_ip").alias("id"), event.alias("event"))


def attacks(intel: DataFrame, n: int = 8) -> DataFrame:
    return top_sources(intel, n).select(
        F.concat(F.lit("attack_"), "src_ip").alias("id"),
        F.coalesce("attack_stage", F.lit("Threat")).alias("attackType"),
        F.col("src_ip").alias("sourceIp"),
        R.severity(F.coalesce("risk_level", F.lit("MEDIUM"))).alias("severity"),
    )


# --- risk straight from flow files, without models ---------------------------


def _first_given(df: DataFrame, names: Sequence[str]) -> Column:
    """First of the columns that is present and not empty in the row, as text."""
    found = [quoted(c).cast("string") for c in (resolve_column(df, [n]) for n in names) if c]
    return F.coalesce(*[F.when(c != "", c) for c in found], F.lit(None).cast("string"))


def source_totals(df: DataFrame) -> DataFrame:
    """Per source of any flow table: rows, rate sum, failed-login sum, rows with a risky status."""
    rate = to_float(_first_given(df, ("request_rate", "requests_per_second", "flow_rate")))
    failed = to_float(_first_given(df, BATCH_ALIASES["failed_logins"]))
    status = to_int(_first_given(df, ("status_code", "response_code")))
    source = F.coalesce(_first_given(df, BATCH_ALIASES["src_ip"]), F.lit("UNKNOWN"))
    rows = df.select(
        source.alias("src_ip"), rate.alias("rate"), failed.alias("failed"), risky_status(status).alias("risky")
    )
    return rows.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum("rate").alias("rate_sum"),
        F.sum("failed").alias("failed_sum"),
        F.count_if("risky").alias("risky_rows"),
    )


def source_risk(df: DataFrame) -> DataFrame:
    """Every source with clamped risk score, level, stage, action and traffic profile."""
    return _risk_of(source_totals(df))


def busiest(risk: DataFrame, top: int = 30) -> DataFrame:
    """The ``top`` busiest sources, to be shown."""
    return risk.orderBy(F.desc("flows"), "src_ip").limit(top)


def ip_risk_table(df: DataFrame, top: int = 30) -> DataFrame:
    return busiest(source_risk(df), top)


def _score_of_totals() -> Column:
    n = F.col("flows")
    raw = F.col("rate_sum") / n / F.lit(1500.0) + F.col("failed_sum") / n / F.lit(8.0) + F.col("risky_rows") / n * F.lit(0.9)
    return clamp(raw, 0.05, 0.99)


def _level_of_totals() -> Column:
    return R.risk_band(_score_of_totals(), R.MEDIUM_FROM_IP)


def _risk_of(totals: DataFrame) -> DataFrame:
    n = F.col("flows")
    rate, failed, risky = F.col("rate_sum") / n, F.col("failed_sum") / n, F.col("risky_rows") / n
    scored = totals.withColumn("score", _score_of_totals()).withColumn("risk_level", _level_of_totals())
    return scored.select(
        "src_ip",
        "flows",
        F.round("score", 4).alias("risk_score"),
        "risk_level",
        R.level_action("risk_level").alias("recommended_action"),
        R.level_stage("risk_level").alias("attack_stage"),
        F.when(rate > 500, "elevated").otherwise("normal").alias("traffic_profile"),
        F.round(failed, 3).alias("failed_login_ratio"),
        F.round(risky, 3).alias("status_anomaly_ratio"),
    )


def feature_scores(df: DataFrame) -> DataFrame:
    """Five dataset-level importances over all sources: clamped, rounded, normalised to sum 1, largest first."""
    return scores_of_totals(source_totals(df))


def scores_of_totals(totals: DataFrame) -> DataFrame:
    """``feature_scores`` of one row per source, as ``source_totals`` gives them."""
    rows = F.sum("flows")
    risk = totals.withColumn("risk_level", _level_of_totals())
    sums = risk.agg(
        indicator_share(R.high_risk()).alias("dense"),
        (F.sum("rate_sum") / rows / F.lit(1200.0)).alias("rate"),
        (F.sum("failed_sum") / rows / F.lit(4.0)).alias("failed"),
        (F.sum("risky_rows") / rows).alias("risky"),
        (F.count(F.lit(1)) / rows).alias("spread"),
    )
    scores = [
        ("request_rate", clamp(F.col("rate"), 0.05, 0.35)),
        ("failed_login_ratio", clamp(F.col("failed"), 0.04, 0.3)),
        ("status_anomaly_ratio", clamp(F.col("risky"), 0.03, 0.26)),
        ("ip_distribution_score", clamp(F.col("spread"), 0.03, 0.2)),
        ("threat_density", clamp(F.coalesce("dense", F.lit(0.0)), 0.03, 0.22)),
    ]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.round(s, 3).alias("score")) for n, s in scores])
    total = F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + p["score"])
    return (
        sums.select(pairs.alias("pairs"))
        .select(total.alias("total"), F.inline("pairs"))
        .select("feature", F.round(F.col("score") / F.col("total"), 3).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def indicator_share(condition: Column) -> Column:
    return F.avg(indicator(condition))


def risk_distribution(intel: DataFrame) -> DataFrame:
    """Records per level (all four levels, unknown ones as LOW), total and share of high risk."""
    level = F.upper(F.coalesce("risk_level", F.lit("LOW")))
    known = F.when(level.isin(*R.RISK_LEVELS), level).otherwise("LOW").alias("risk_level")
    totals = intel.select(known).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        *[F.count_if(F.col("risk_level") == k).alias(k) for k in R.RISK_LEVELS],
    )
    high = sum((F.col(k) for k in R.HIGH_RISK_LEVELS), F.lit(0))
    rate = F.round(high / F.greatest(F.col("total_predictions"), F.lit(1)), 4)
    pairs = F.array(*[F.struct(F.lit(k).alias("risk_level"), F.col(k).alias("records")) for k in R.RISK_LEVELS])
    return totals.select("total_predictions", rate.alias("threat_detection_rate"), F.inline(pairs))


def risk_metrics(intel: DataFrame) -> DataFrame:
    """Active threats, overall level, blocked addresses, network health: one row."""
    active = F.col("activeThreats")
    risk = F.least(F.lit(100), active * 12)
    level = (
        F.when(risk >= 80, "Critical").when(risk >= 60, "High").when(risk >= 35, "Medium").otherwise("Low")
    )
    return intel.agg(F.count_if(R.high_risk()).alias("activeThreats")).select(
        "activeThreats",
        level.alias("riskLevel"),
        (active * 3).alias("blockedIps"),
        F.greatest(F.lit(0), F.lit(100) - risk).alias("networkHealth"),
    )
