"""JSON documents: measurement records, markings, metadata. Schemas are explicit, so that unread fields are never parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = """tree_id STRING, marking_url STRING, detection_status STRING, identity_review_status STRING, protocol_applicability STRING, protocol_resolved BOOLEAN,
measurement_kind STRING, measurement_height_agl_m DOUBLE, field_aid_measurement_height_agl_m DOUBLE, field_aid_status STRING, field_aid_source STRING,
field_aid_is_current_protocol_final BOOLEAN, field_aid_circumference_cm DOUBLE, field_aid_diameter_cm DOUBLE, field_aid_dbh_cm DOUBLE,
legacy_full_resolution_status STRING, legacy_measurement_rule STRING, legacy_circumference_cm DOUBLE, legacy_measurement_height_agl_m DOUBLE,
acceptance_status STRING, geometric_status STRING, fit_model STRING, field_aid_fit_model STRING, point_count BIGINT, inlier_count BIGINT,
angular_coverage_deg DOUBLE, axis_source STRING, axis_status STRING, axis_uncertainty_m DOUBLE, axis_supporting_slice_count INT,
candidate_circumference_cm DOUBLE, field_aid_marking_source STRING, protocol_plane_moved_to_cleaner_height BOOLEAN, operationally_excluded BOOLEAN,
operational_exclusion_decision STRING, field_verified BOOLEAN, qa_reason_codes ARRAY<STRING>""".replace("\n", " ")
FIT = "STRUCT<center: ARRAY<DOUBLE>, radius_m: DOUBLE, ellipse: STRUCT<valid: BOOLEAN, center: ARRAY<DOUBLE>, semi_major_axis_m: DOUBLE, semi_minor_axis_m: DOUBLE, rotation_rad: DOUBLE>>"
PLANE = "STRUCT<center_xyz: ARRAY<DOUBLE>, basis_u: ARRAY<DOUBLE>, basis_v: ARRAY<DOUBLE>, axis_direction: ARRAY<DOUBLE>>"
MARKING = f"measurement_plane {PLANE}, fit {FIT}, field_aid_fit {FIT}, field_aid_fit_model STRING"
POINTS = "display_points_xyz ARRAY<ARRAY<DOUBLE>>, accepted_slice_points_xyz ARRAY<ARRAY<DOUBLE>>, accepted_projected_points_xy ARRAY<ARRAY<DOUBLE>>, rejected_projected_points_xy ARRAY<ARRAY<DOUBLE>>"
MEASUREMENTS = f"algorithm_version STRING, field_verified BOOLEAN, generated_at_utc STRING, records ARRAY<STRUCT<{RECORD}>>"
METADATA = """name STRING, description STRING, source STRING, sourcePointCount BIGINT, samplingStride INT, points BIGINT, projection STRING, offset ARRAY<DOUBLE>, scale ARRAY<DOUBLE>,
boundingBox STRUCT<min: ARRAY<DOUBLE>, max: ARRAY<DOUBLE>>, attributes ARRAY<STRUCT<name: STRING, type: STRING, numElements: INT, elementSize: INT, size: INT,
bufferView: STRUCT<uri: STRING, byteLength: BIGINT, byteOffset: BIGINT>, min: ARRAY<DOUBLE>, max: ARRAY<DOUBLE>>>""".replace("\n", " ")

TREES = """source STRING, method STRING, measurementSourcePointCount BIGINT, viewerPointCount BIGINT, breastHeightM DOUBLE, visibleMeasuredTrees INT, trees ARRAY<STRUCT<id: INT, center: ARRAY<DOUBLE>,
groundCenter: ARRAY<DOUBLE>, axis: ARRAY<DOUBLE>, groundZ: DOUBLE, measurementZ: DOUBLE, radiusM: DOUBLE, dbhCm: DOUBLE, circumferenceM: DOUBLE, fitPoints: INT, angularCoverage: DOUBLE, residualM: DOUBLE,
verticality: DOUBLE, validatedSlices: INT, confidence: STRING>>""".replace("\n", " ")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file: its fields and _path. A leading byte-order mark goes; broken JSON fails the query."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("v"), F.input_file_name().alias("_path"))
    parsed = text.select(F.from_json("v", schema, {"mode": "FAILFAST"}).alias("d"), "_path")
    return parsed.select("d.*", "_path")


def fields(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows with the named fields of a JSON column; broken JSON gives nulls."""
    return rows.withColumn("_j", F.from_json(column, schema)).select(*rows.columns, "_j.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record_index (file order) and the record's fields; fails where records is no array."""
    found = read_document(spark, path, MEASUREMENTS)
    checked = found.select(F.when(F.col("records").isNull(), F.raise_error(F.lit("records must be an array"))).otherwise(F.col("records")).alias("records"))
    return checked.select(F.posexplode("records").alias("record_index", "r")).select("record_index", "r.*")


def read_markings(spark: SparkSession, root: str, pattern: str = "markings/*.json", with_points: bool = False) -> DataFrame:
    """One row a marking, with marking_path relative to the root. Point arrays are only parsed when asked for."""
    found = read_document(spark, f"{root}/{pattern}", MARKING + (", " + POINTS if with_points else ""))
    return found.withColumn("marking_path", F.substring_index(F.url_decode("_path"), root.rstrip("/") + "/", -1)).drop("_path")


def attribute(metadata: DataFrame, name: str) -> DataFrame:
    """The named attribute of each metadata document; no row where there is none."""
    return metadata.select(F.filter("attributes", lambda a: a["name"] == name)[0].alias("a")).where("a IS NOT NULL").select("a.*")


def total_bytes(metadata: DataFrame) -> DataFrame:
    """source, n_bytes: the length of all buffers that each metadata document names."""
    return metadata.select("source", F.aggregate("attributes", F.lit(0).cast("long"), lambda s, a: s + a["bufferView"]["byteLength"]).alias("n_bytes"))


def required_count(summary: DataFrame, column: str = "num_points") -> int:
    """A positive whole number, or an error."""
    row = summary.select(F.get_json_object("json", f"$.summary.{column}").try_cast("bigint").alias("n")).first()
    if row is None or row["n"] is None or row["n"] < 1:
        raise ValueError(f"{column} must be a positive whole number")
    return row["n"]
