"""What the further queries must return, as SQL for DuckDB: known shapes and paths, and arithmetic on the tables."""

from __future__ import annotations

_FILL = "CAST(CASE WHEN s_suppkey % 10 = 0 THEN 64 ELSE least(greatest(floor((s_acctbal + 1000) / 11000 * 64), 0), 64) END AS BIGINT)"


def _word(count: str, x: str, y: str, w: str, h: str) -> str:
    return f"{count} AS n_words, {x} AS last_x, {y} AS last_y, {w} AS last_w, {h} AS last_h"


MORE_ORACLES = {
    "detection_report": """
SELECT doc_id, CASE WHEN quality <> 1 THEN '0%' WHEN toxic = 1 THEN '42%' ELSE '30%' END AS percent, CASE WHEN quality = 1 THEN doc_id * 2 END AS doubled,
CASE WHEN quality <> 1 THEN 'low quality' END AS failure_reason, true AS is_recent, true AS same_value, quality = 1 AND toxic = 1 AS over FROM labels""",
    "interval_overlaps": """
SELECT c_custkey, (SELECT count(*) FROM range(40) AS r(i) WHERE i BETWEEN c_custkey % 13 AND c_custkey % 13 + c_custkey % 7 AND i BETWEEN c_custkey % 11 AND c_custkey % 11 + c_custkey % 5) AS shared FROM customer""",
    "run_shapes": """
WITH want(pattern, ord, x, y, w, h) AS (VALUES ('neighbours', 0, 5, 10, 20, 10), ('neighbours', 1, 40, 10, 20, 10), ('split', 0, 10, 0, 30, 8), ('merge', 0, 5, 0, 20, 2),
  ('global gap', 0, 0, 0, 10, 1), ('global gap', 1, 0, 2, 10, 1), ('global gap', 2, 30, 0, 10, 3), ('bridged', 0, 0, 0, 10, 4), ('parted', 0, 0, 0, 10, 1), ('parted', 1, 0, 4, 10, 1))
SELECT s_suppkey AS frame_id, pattern, CAST(ord AS BIGINT) AS ord, x + s_suppkey % 7 AS x, y + s_suppkey % 5 AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM supplier, want""",
    "track_paths": """
WITH k AS (SELECT s_suppkey AS stream_id, s_suppkey % 5 + 1 AS k FROM supplier),
steady(t, missed, age, c) AS (VALUES (0, 0, 1, 0.3), (1, 0, 2, 0.5423), (2, 0, 3, 0.699), (3, 1, 3, 0.4194), (4, 2, 3, 0.2516), (5, 0, 4, 0.511), (6, 0, 5, 0.6787), (7, 0, 6, 0.7872)),
other(id, t, x, y, vx, vy, missed, age, c) AS (VALUES
  (2, 0, 500, 100, 0, 0, 0, 1, 0.3), (2, 1, 490, 100, -10, 0, 0, 2, 0.5423), (2, 2, 480, 100, -10, 0, 0, 3, 0.699), (2, 3, 470, 100, -10, 0, 1, 3, 0.4194), (2, 4, 460, 100, -10, 0, 2, 3, 0.2516),
  (3, 1, 510, 100, 0, 0, 0, 1, 0.3), (3, 2, 540, 100, 30, 0, 0, 2, 0.5423), (3, 3, 570, 100, 30, 0, 1, 2, 0.3254), (3, 4, 600, 100, 30, 0, 2, 2, 0.1952),
  (4, 1, 200, 52, 0, 0, 0, 1, 0.3), (4, 2, 200, 54, 0, 2, 0, 2, 0.5423), (4, 3, 200, 56, 0, 2, 1, 2, 0.3254), (4, 4, 200, 58, 0, 2, 2, 2, 0.1952)),
every AS (SELECT stream_id, t, 1 AS id, 10 + k * t AS x, 20 AS y, CASE WHEN t = 0 THEN 0 ELSE k END AS vx, 0 AS vy, missed, age, c FROM k, steady
  UNION ALL SELECT stream_id, t, id, x, y, vx, vy, missed, age, c FROM k, other)
SELECT stream_id, CAST(t AS BIGINT) AS frame_no, CAST(id AS BIGINT) AS track_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(vx AS DOUBLE) AS vx, CAST(vy AS DOUBLE) AS vy, 6.0::DOUBLE AS w, 4.0::DOUBLE AS h,
CAST(missed AS BIGINT) AS missed_frames, CAST(age AS BIGINT) AS age_frames, CAST(t + 1 AS BIGINT) AS frame_index, missed > 0 AS is_predicted, CAST(c AS DOUBLE) AS confidence,
round(CAST(CAST(sqrt(CAST((x - 10) * (x - 10) + (y - 20) * (y - 20) AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) AS from_start FROM every""",
    "ocr_commands": """
SELECT n_nationkey, 'img' || n_nationkey || '.png stdout --oem 3 --psm ' || n_nationkey % 14 || CASE WHEN n_nationkey % 3 <> 0 THEN ' -c tessedit_char_whitelist=0123456789' || substr(n_name, 1, 2) ELSE '' END || ' -c preserve_interword_spaces=1 tsv' AS command FROM nation""",
    "ocr_readings": """
WITH want(part, n, x, y, w, h, scale) AS (VALUES ('track', 2, 5, 2, 384, 48, 6), ('edge', 2, 5, 2, 18, 66, 3), ('outside', NULL, NULL, NULL, NULL, NULL, NULL))
SELECT s_suppkey AS frame_id, part, 'w' || w || ' h' || h || '-11' AS text, CASE WHEN n IS NOT NULL THEN true END AS available, CAST(n AS BIGINT) AS n_words, CAST(x AS BIGINT) AS last_x, CAST(y AS BIGINT) AS last_y, CAST(w AS BIGINT) AS last_w, CAST(h AS BIGINT) AS last_h,
CAST(w // scale AS BIGINT) AS own_w, CAST(h // scale AS BIGINT) AS own_h FROM supplier, want""",
    "ocr_engines": "SELECT * FROM (VALUES ('program', false), ('system', false), ('system reads', false), ('system engine', false)) AS t(engine, available)",
    "swizzled_pixels": "SELECT c_custkey AS frame_id, c_custkey * 29 % 256 AS c0, c_custkey * 13 % 256 AS c1, c_custkey * 7 % 256 AS c2, CAST(255 AS BIGINT) AS c3 FROM customer",
    "windows": "SELECT '' AS title WHERE false",
    "title_search": """SELECT p_partkey, contains(lower(p_name), 'a') AS has_0, contains(lower(p_name), 're') AS has_1, contains(lower(p_name), 'xyzzy') AS has_2, length(p_name) > 0 AS has_3 FROM part""",
    "image_files": """
SELECT CAST(n_nationkey AS VARCHAR) AS name, 96 AS width, 32 AS height, NULL::VARCHAR AS failure_reason,
CASE WHEN n_nationkey * 2 > 32 THEN 21 WHEN n_nationkey % 3 = 0 THEN 7 WHEN n_nationkey % 3 = 1 THEN 21 ELSE 1 END::BIGINT AS bucket_r, 8 * greatest(n_nationkey * 2, 64 - n_nationkey * 2) AS n FROM nation
UNION ALL SELECT 'broken', NULL, NULL, 'image could not be read', NULL, NULL""",
    "pixel_bar_fill": f"""WITH g AS (SELECT s_suppkey AS frame_id, {_FILL} AS fp, s_suppkey % 3 AS kind FROM supplier)
SELECT frame_id, round(CAST(CASE WHEN fp >= 60 OR kind = 2 THEN 100.0 ELSE 100.0 * fp / 64 END AS DOUBLE), 4) AS fill, NULL::VARCHAR AS failure_reason FROM g WHERE fp >= 8""",
}
