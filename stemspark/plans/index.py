"""The compact index of measurement records and their markings: all of them, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import js_round, js_round_all
from ..functions.labels import safe_path, yes
from ..operators.sampling import numbered
from ..sources import sinks
from ..sources.documents import read_markings, read_records

#: The rounded fields and their digits; fields that pass; flags.
ROUNDED = {"measurement_height_agl_m": 3, "field_aid_measurement_height_agl_m": 3, "field_aid_circumference_cm": 2, "field_aid_diameter_cm": 2, "field_aid_dbh_cm": 2, "legacy_circumference_cm": 2, "angular_coverage_deg": 1, "axis_uncertainty_m": 4}
FLAGS = ("protocol_resolved", "field_aid_is_current_protocol_final", "operationally_excluded", "field_verified")
COUNTS = ("point_count", "inlier_count")
FIELDS = (
    "tree_id", "marking_url", "detection_status", "identity_review_status", "protocol_applicability", "protocol_resolved", "measurement_kind", "measurement_height_agl_m", "field_aid_measurement_height_agl_m",
    "field_aid_status", "field_aid_source", "field_aid_is_current_protocol_final", "field_aid_circumference_cm", "field_aid_diameter_cm", "field_aid_dbh_cm", "legacy_full_resolution_status",
    "legacy_measurement_rule", "legacy_circumference_cm", "acceptance_status", "geometric_status", "fit_model", "point_count", "inlier_count", "angular_coverage_deg", "axis_source", "axis_status",
    "axis_uncertainty_m", "operationally_excluded", "operational_exclusion_decision", "field_verified", "qa_reason_codes",
)
SHOWN = ("READY_FOR_FIELD_USE", "CHECK_ON_SITE")


def compact_ellipse(e: Column) -> Column:
    return F.when(F.coalesce(e["valid"], F.lit(False)), F.struct(F.lit(True).alias("valid"), js_round_all(e["center"]).alias("center"), *(js_round(e[c], 6).alias(c) for c in ("semi_major_axis_m", "semi_minor_axis_m", "rotation_rad"))))


def compact_fit(fit: Column) -> Column:
    ellipse = compact_ellipse(fit["ellipse"])
    center, radius = js_round_all(fit["center"]), js_round(fit["radius_m"], 6)
    return F.when(fit.isNotNull() & (center.isNotNull() | radius.isNotNull() | ellipse.isNotNull()), F.struct(center.alias("center"), radius.alias("radius_m"), ellipse.alias("ellipse")))


def compact_plane(p: Column) -> Column:
    up = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    whole = p.isNotNull() & p["center_xyz"].isNotNull() & p["basis_u"].isNotNull() & p["basis_v"].isNotNull()
    return F.when(whole, F.struct(*(js_round_all(p[c]).alias(c) for c in ("center_xyz", "basis_u", "basis_v")), F.coalesce(js_round_all(p["axis_direction"]), up).alias("axis_direction")))


def compact(joined: DataFrame) -> DataFrame:
    """Records with the columns of their markings (m): the index's rows, in file order."""
    fit = compact_fit(F.coalesce("m.field_aid_fit", "m.fit"))
    shown = F.col("plane").isNotNull() & F.col("fit").isNotNull() & F.col("field_aid_circumference_cm").isNotNull() & ~F.col("operationally_excluded") & F.coalesce(F.col("field_aid_status").isin(*SHOWN), F.lit(False))
    made = {c: js_round(c, d) for c, d in ROUNDED.items()} | {c: yes(c) for c in FLAGS} | {c: F.coalesce(c, F.lit(0)) for c in COUNTS}
    made |= {"fit_model": F.coalesce("m.field_aid_fit_model", "field_aid_fit_model", "fit_model"), "qa_reason_codes": F.coalesce("qa_reason_codes", F.array().cast("array<string>"))}
    rows = joined.select("record_index", *(made.get(c, F.col(c)).alias(c) for c in FIELDS), compact_plane(F.col("m.measurement_plane")).alias("plane"), fit.alias("fit"))
    return rows.select("record_index", *FIELDS, shown.alias("renderable"), "plane", "fit")


def matched(records: DataFrame, markings: DataFrame) -> DataFrame:
    """Each record with its marking (m), and why: what keeps it from having exactly one, else null."""
    left = records.withColumn("marking_path", safe_path("marking_url"))
    keyed = markings.groupBy("marking_path").agg(F.count("*").alias("copies"), F.first(F.struct(*(c for c in markings.columns if c != "marking_path"))).alias("m"))
    why = F.when(F.coalesce("marking_url", F.lit("")) == "", "no marking_url").when(F.col("marking_path").isNull(), "unsafe marking path").when(F.col("copies").isNull(), "no marking").when(F.col("copies") > 1, "several markings")
    return left.join(keyed, "marking_path", "left").withColumn("why", why)


def failures(records: DataFrame, markings: DataFrame) -> DataFrame:
    """record_index, tree_id and why of all records without exactly one marking."""
    return matched(records, markings).where("why IS NOT NULL").select("record_index", F.coalesce("tree_id", F.lit("?")).alias("tree_id"), "why")


def build(records: DataFrame, markings: DataFrame, shown: int = 1000) -> DataFrame:
    """Each record with its marking; one failure fails the whole build. The message gives their number and names the first ones."""
    joined = matched(records, markings).persist()
    try:
        failed = joined.where("why IS NOT NULL")
        n = failed.count()
        if n:
            first = failed.orderBy("record_index").select(F.concat_ws(": ", F.coalesce("tree_id", F.lit("?")), "why").alias("t")).limit(shown).collect()
            raise ValueError(f"{n} of the records have no single marking: " + "; ".join(r["t"] for r in first) + ("" if n <= shown else f"; and {n - shown} more"))
    finally:
        joined.unpersist()
    return compact(joined)


def summary(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").cast("int").alias("record_count"), F.count_if("renderable").cast("int").alias("renderable_ring_count"), F.count_if(~F.col("renderable")).cast("int").alias("marker_only_count"))


def status_counts(records: DataFrame, column: str) -> DataFrame:
    """One row: a map of counts by status; missing ones under 'null'."""
    counts = records.groupBy(F.coalesce(column, F.lit("null")).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"{column}_counts"))


def ids_where(records: DataFrame, condition: Column) -> DataFrame:
    """pos, tree_id: the sorted tree ids that meet a condition, as rows, so that a list may be long."""
    return numbered(records.where(condition).select("tree_id"), ["tree_id"], "pos").withColumn("pos", F.col("pos") - 1)


def document(index: DataFrame, facts: dict[str, str | bool | None], files: dict[str, str]) -> DataFrame:
    """The single published document, records in file order."""
    rows = index.agg(F.transform(F.array_sort(F.collect_list(F.struct("record_index", F.struct(*(c for c in index.columns if c != "record_index")).alias("r")))), lambda s: s["r"]).alias("records"))
    kinds = {"algorithm_version": "string", "field_verified": "boolean", "generated_at_utc": "string"}
    return summary(index).select(F.struct("*").alias("viewer_summary")).crossJoin(rows).select(
        F.lit(1).alias("schema_version"), *(F.lit(facts.get(k)).cast(t).alias(k) for k, t in kinds.items()), "viewer_summary", F.struct(*(F.lit(v).alias(k) for k, v in files.items())).alias("source_files"), "records"
    )


def publish(spark: SparkSession, measurements: str, root: str, out: str) -> DataFrame:
    """Builds the index and writes it as a table and as one document."""
    index = build(read_records(spark, measurements), read_markings(spark, root))
    sinks.publish(index.orderBy("record_index"), f"{out}/viewer_index", force=True)
    done = spark.read.parquet(f"{out}/viewer_index")
    sinks.publish_json(document(done, {}, {"measurements": measurements, "markings": f"{root}/markings"}), f"{out}/viewer-index.json")
    return done
