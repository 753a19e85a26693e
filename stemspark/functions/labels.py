"""Classification of measurement records and text formatting, as Column expressions.

The statuses, kinds, labels and colours are fixed values of the record format; a null counts as false or as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import number

# Texts by status, kind and source, in the order of the viewers' lists.
STATUS_LABELS = {"READY_FOR_FIELD_USE": "พร้อมใช้ช่วยภาคสนาม", "CHECK_ON_SITE": "มีค่าประมาณ · เช็กหน้างาน", "NO_ESTIMATE": "ข้อมูลไม่พอสำหรับวง fit"}
EXCLUDED_LABEL, FINAL_LABEL, UNKNOWN_STATUS = "ตัดออกตามการตรวจยืนยัน", "พร้อมใช้ · protocol ล่าสุด", "ยังไม่ระบุสถานะ"
KIND_LABELS = {
    "STANDARD_DBH_1_30": "Standard DBH ที่ 1.30 ม.",
    "PROP_ROOT_PLUS_030": "Prop-root · จุดเกาะรากสูงสุด +0.30 ม.",
    "LEGACY_STANDARD_DBH_1_30": "Full-LAS รุ่นแรก · Standard 1.30 ม.",
    "LEGACY_ADAPTIVE_IRREGULAR_ZONE_PLUS_030": "Full-LAS รุ่นแรก · ยอดโซนผิดปกติ +0.30 ม.",
}
KIND_DEFAULT = "Screening ที่ 1.30 ม. · ยังไม่ยืนยัน protocol"
KIND_TEXTS = {
    "STANDARD_DBH_1_30": "Standard · DBH ที่ 1.30 ม.",
    "PROP_ROOT_PLUS_030": "Prop-root · จุดเกาะราก +0.30 ม.",
    "LEGACY_STANDARD_DBH_1_30": "Full‑LAS รุ่นแรก · Standard 1.30 ม.",
    "LEGACY_ADAPTIVE_IRREGULAR_ZONE_PLUS_030": "Full‑LAS รุ่นแรก · ยอดโซนผิดปกติ +0.30 ม.",
}
KIND_TEXT_DEFAULT = "Screening ที่ 1.30 ม. · ยังไม่ยืนยันโปรโตคอล"
SOURCE_TEXTS = {
    "HUMAN_OPERATOR_EXCLUSION": "ตัดออกตามคำยืนยันของผู้ใช้",
    "CURRENT_PROTOCOL_FINAL": "Full‑LAS · ยืนยัน protocol ล่าสุด",
    "LEGACY_FULL_RESOLUTION_ACCEPTED": "Full‑LAS รุ่นแรก · ผลที่รับไว้เดิม",
    "FULL_LAS_GEOMETRY_ESTIMATE": "Full‑LAS · วง fit เรขาคณิตสะอาด",
    "FULL_LAS_REVIEW_CANDIDATE": "Full‑LAS · ค่าประมาณสำหรับเช็กหน้างาน",
}
NO_FIT = "ยังไม่มีวง fit ที่ใช้ได้"
EXCLUDED_COLOR, NO_ESTIMATE_COLOR, FINAL_COLOR, ROOT_COLOR, LEGACY_COLOR, READY_COLOR, CHECK_COLOR = 0xF06C5B, 0x82958B, 0x72D8FF, 0xD6A4FF, 0x9FB4FF, 0x6FE0A7, 0xFFBD66


def yes(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def equals(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


def looked_up(column: str, table: dict[str, str], default) -> Column:
    found = None
    for key, text in table.items():
        found = F.when(F.col(column) == key, text) if found is None else found.when(F.col(column) == key, text)
    return found.otherwise(default)


def is_excluded() -> Column:
    return yes("operationally_excluded") | equals("field_aid_status", "EXCLUDED_CONFIRMED_WRONG")


def status_label() -> Column:
    final = equals("field_aid_status", "READY_FOR_FIELD_USE") & yes("field_aid_is_current_protocol_final")
    missing = F.when(F.coalesce("field_aid_status", F.lit("")) == "", UNKNOWN_STATUS).otherwise(F.col("field_aid_status"))
    return F.when(is_excluded(), EXCLUDED_LABEL).when(final, FINAL_LABEL).otherwise(looked_up("field_aid_status", STATUS_LABELS, missing))


def kind_label() -> Column:
    return looked_up("measurement_kind", KIND_LABELS, KIND_DEFAULT)


def kind_text() -> Column:
    return looked_up("measurement_kind", KIND_TEXTS, KIND_TEXT_DEFAULT)


def source_text() -> Column:
    return looked_up("field_aid_source", SOURCE_TEXTS, NO_FIT)


def status_text() -> Column:
    return (
        F.when(equals("field_aid_status", "EXCLUDED_CONFIRMED_WRONG"), "ตัดออก · ผู้ใช้ยืนยันว่าผิด")
        .when(equals("field_aid_source", "CURRENT_PROTOCOL_FINAL"), "พร้อมใช้ · ยืนยัน protocol ล่าสุด")
        .when(equals("field_aid_source", "LEGACY_FULL_RESOLUTION_ACCEPTED"), "พร้อมใช้ · Full‑LAS รุ่นแรก")
        .otherwise(looked_up("field_aid_status", {"READY_FOR_FIELD_USE": "พร้อมใช้ช่วยภาคสนาม", "CHECK_ON_SITE": "มีค่าประมาณ · ควรเช็กหน้างาน"}, "ข้อมูลไม่พอสำหรับวง fit"))
    )


def status_class() -> Column:
    return F.when(is_excluded(), "excluded").otherwise(looked_up("field_aid_status", {"READY_FOR_FIELD_USE": "ready", "CHECK_ON_SITE": "check"}, "none"))


def color() -> Column:
    """By priority: the first that holds."""
    return (
        F.when(is_excluded(), EXCLUDED_COLOR)
        .when(equals("field_aid_status", "NO_ESTIMATE"), NO_ESTIMATE_COLOR)
        .when(yes("field_aid_is_current_protocol_final"), FINAL_COLOR)
        .when(equals("measurement_kind", "PROP_ROOT_PLUS_030"), ROOT_COLOR)
        .when(equals("field_aid_source", "LEGACY_FULL_RESOLUTION_ACCEPTED"), LEGACY_COLOR)
        .when(equals("field_aid_status", "READY_FOR_FIELD_USE"), READY_COLOR)
        .otherwise(CHECK_COLOR)
    )


def dot_class() -> Column:
    legacy = equals("field_aid_source", "LEGACY_FULL_RESOLUTION_ACCEPTED")
    return F.when(equals("field_aid_status", "EXCLUDED_CONFIRMED_WRONG"), "fail").when(legacy, "legacy").otherwise(looked_up("field_aid_status", {"READY_FOR_FIELD_USE": "final", "NO_ESTIMATE": "fail"}, ""))


def badge_class() -> Column:
    return looked_up("field_aid_status", {"READY_FOR_FIELD_USE": "", "CHECK_ON_SITE": "provisional"}, "review")


def is_adaptive() -> Column:
    return equals("measurement_kind", "PROP_ROOT_PLUS_030") | equals("legacy_measurement_rule", "ADAPTIVE_IRREGULAR_ZONE_PLUS_030")


def diameter_label() -> Column:
    return F.when(F.col("field_aid_dbh_cm").isNotNull(), "DBH estimate").when(is_adaptive(), "เส้นผ่านศูนย์กลาง ณ +0.30").otherwise("เส้นผ่านศูนย์กลาง ณ ระนาบ")


def diameter_note() -> Column:
    return F.when(F.col("field_aid_dbh_cm").isNotNull(), "วัดที่ 1.30 ม.").when(is_adaptive(), "ไม่ใช่ DBH ที่ 1.30 ม.").otherwise("เส้นผ่านศูนย์กลางที่ระนาบ marking")


def confidence(inliers="inliers", coverage="coverage", slices="slice_count") -> Column:
    """Steps of (label, least inliers, least coverage, least slices)."""
    found = None
    for label, n, part, k in (("high", 100, 0.55, 5), ("medium", 40, 0.35, 4)):
        hit = (number(inliers) >= n) & (number(coverage) >= part) & (number(slices) >= k)
        found = F.when(hit, label) if found is None else found.when(hit, label)
    return found.otherwise("low")


def hex_color(c) -> Column:
    return F.lower(F.lpad(F.hex(number(c).cast("bigint")), 6, "0"))


def short_id(tree_id="tree_id") -> Column:
    """Without the first TREE_."""
    return F.expr(f"CASE WHEN instr({tree_id}, 'TREE_') > 0 THEN overlay({tree_id} PLACING '' FROM instr({tree_id}, 'TREE_') FOR 5) ELSE {tree_id} END")


def grouped_number(value, digits: int) -> Column:
    """Thousands in groups, at most so many decimals, none that are trailing zeros."""
    full = F.format_number(js_round_half_away(value, digits), digits)
    return F.when(number(value).isNotNull(), F.regexp_replace(F.regexp_replace(full, r"(\.\d*?)0+$", "$1"), r"\.$", "") if digits else full)


def js_round_half_away(value, digits: int) -> Column:
    return F.round(number(value), digits)


def fixed(value, digits: int) -> Column:
    return F.when(number(value).isNotNull(), F.format_string(f"%.{digits}f", number(value))).otherwise("—")


def top_reasons(codes="qa_reason_codes", n: int = 3, none: str = "—") -> Column:
    a = F.coalesce(F.col(codes), F.array().cast("array<string>"))
    return F.when(F.size(a) == 0, none).otherwise(F.array_join(F.slice(a, 1, n), " · "))


def query_link(base: str, tree_id="tree_id") -> Column:
    return F.concat(F.lit(base + "?tree="), F.url_encode(F.col(tree_id)))


def link_tree(url) -> Column:
    """The key a link names; null if there is none, or if the link or its escapes are broken."""
    return F.try_url_decode(F.try_parse_url(number(url), F.lit("QUERY"), F.lit("tree")))


def utc_stamp(ts) -> Column:
    """Whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(number(ts), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def shown(*columns: str) -> Column:
    """The first that is there, for display."""
    return F.coalesce(*columns)


def optional_text(column, default: str = "") -> Column:
    return F.coalesce(F.trim(number(column)), F.lit(default))


def safe_path(url) -> Column:
    """A relative path from a URL path: leading slashes go, `.` and `..` are resolved; null if missing, empty, or if a part climbs out."""
    parts = F.filter(F.split(F.regexp_replace(number(url), "^/+", ""), "/"), lambda s: ~s.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok"))
    up = lambda s: F.struct(F.slice(s["path"], 1, F.greatest(F.size(s["path"]) - 1, F.lit(0))).alias("path"), (s["ok"] & (F.size(s["path"]) > 0)).alias("ok"))
    down = lambda s, x: F.struct(F.concat(s["path"], F.array(x)).alias("path"), s["ok"].alias("ok"))
    found = F.aggregate(parts, start, lambda s, x: F.when(x == "..", up(s)).otherwise(down(s, x)))
    return F.when(found["ok"] & (F.size(found["path"]) > 0), F.array_join(found["path"], "/"))


def decoded_path(url) -> Column:
    """safe_path of a path with percent escapes, decoded before it is judged; null if they are broken."""
    return safe_path(F.try_url_decode(F.replace(number(url), F.lit("+"), F.lit("%2B"))))
