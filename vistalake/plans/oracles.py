"""What the queries must return, as SQL for DuckDB.

Rasters have known geometry, so most of this is arithmetic on the tables and doesn't follow the operators' steps.
"""

from __future__ import annotations

from vistalake.functions.glyphs import GLYPHS
from vistalake.plans.more_oracles import MORE_ORACLES

_FILL = "CAST(CASE WHEN s_suppkey % 10 = 0 THEN 64 ELSE least(greatest(floor((s_acctbal + 1000) / 11000 * 64), 0), 64) END AS BIGINT)"
_G = f"g AS (SELECT s_suppkey AS frame_id, {_FILL} AS fp, s_suppkey % 3 AS kind FROM supplier)"
_COLOURS = "c AS (SELECT c_custkey, CAST(c_custkey * 7 % 256 AS FLOAT) AS r, CAST(c_custkey * 13 % 256 AS FLOAT) AS g, CAST(c_custkey * 29 % 256 AS FLOAT) AS b, c_custkey * 3 % 256 AS a FROM customer)"
_HSV = (
    _COLOURS
    + """, n AS (SELECT *, r / CAST(255 AS FLOAT) AS rn, g / CAST(255 AS FLOAT) AS gn, b / CAST(255 AS FLOAT) AS bn FROM c),
m AS (SELECT *, greatest(rn, gn, bn) AS top, greatest(rn, gn, bn) - least(rn, gn, bn) AS delta FROM n),
raw AS (SELECT *, CASE WHEN delta = 0 THEN CAST(0 AS FLOAT)
  WHEN top = rn THEN CAST(60 AS FLOAT) * ((gn - bn) / delta)
  WHEN top = gn THEN CAST(60 AS FLOAT) * ((bn - rn) / delta + CAST(2 AS FLOAT))
  ELSE CAST(60 AS FLOAT) * ((rn - gn) / delta + CAST(4 AS FLOAT)) END AS hue FROM m),
hsv AS (SELECT *, CASE WHEN hue < 0 THEN hue + CAST(360 AS FLOAT) ELSE hue END AS h, CASE WHEN top = 0 THEN CAST(0 AS FLOAT) ELSE delta / top END AS s, top AS v FROM raw)"""
)
_M = """m AS (SELECT s_suppkey AS stream_id, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey % 5 + 4 END AS step, t AS frame_no FROM supplier, range(6) AS r(t)),
f AS (SELECT *, CASE WHEN frame_no = 0 THEN 'warming up: no previous frame to diff against yet' WHEN stream_id % 11 = 5 AND frame_no IN (3, 4) THEN 'frame size changed since previous frame' ELSE 'ok' END AS status,
  CASE WHEN stream_id % 11 = 5 AND frame_no = 3 THEN 63 ELSE 64 END AS width FROM m)"""
_TRIM = r"'^[\p{Z}\s]+|[\p{Z}\s]+$'"
_GLYPH_ROWS = ", ".join(
    f"('{ch.replace(chr(39), chr(39) * 2)}', {col}, {row})" for ch, columns in GLYPHS.items() for col, bits in enumerate(columns) for row in range(7) if bits >> row & 1
)

_ORACLES = {
    "confidence_fold": """
WITH c AS (SELECT doc_id, CAST(quality AS FLOAT) * CAST(0.6 AS FLOAT) AS a, CAST(toxic AS FLOAT) * CAST(0.3 AS FLOAT) AS b FROM labels),
d AS (SELECT doc_id, (a + b - a * b) * CAST(0.9 AS FLOAT) AS v FROM c)
SELECT doc_id, round(CAST(v AS DOUBLE), 5) AS confidence, v >= CAST(0.5 AS FLOAT) AS is_confident FROM d""",
    "hsv_convert": f"WITH {_HSV} SELECT c_custkey, round(CAST(h AS DOUBLE), 3) AS h, round(CAST(s AS DOUBLE), 3) AS s, round(CAST(v AS DOUBLE), 3) AS v FROM hsv",
    "pixel_tests": f"""WITH {_HSV} SELECT c_custkey,
a >= 128 AND (h >= 340 OR h <= 30) AND s >= CAST(0.35 AS FLOAT) AND v >= CAST(0.3 AS FLOAT) AS is_red,
a >= 115 AND CAST(0.299 AS FLOAT) * r + CAST(0.587 AS FLOAT) * g + CAST(0.114 AS FLOAT) * b >= 90 AND s <= CAST(0.55 AS FLOAT) AND v >= CAST(0.45 AS FLOAT) AS is_text,
(299 * CAST(r AS BIGINT) + 587 * CAST(g AS BIGINT) + 114 * CAST(b AS BIGINT)) // 1000 AS luma FROM hsv""",
    "color_pixel_count": f"WITH {_G} SELECT frame_id, fp * 8 AS n FROM g",
    "text_pixel_count": f"WITH {_G} SELECT frame_id, CASE WHEN kind = 1 THEN (64 - fp) * 8 ELSE 0 END AS n FROM g",
    "row_runs": f"WITH {_G} SELECT frame_id, y, CAST(8 AS BIGINT) AS x0, 7 + fp AS x1 FROM g, range(20, 28) AS r(y) WHERE fp >= 8",
    "region_rects": f"""WITH {_G} SELECT frame_id, CAST(8 AS BIGINT) AS x, CAST(20 AS BIGINT) AS y, fp AS w, CAST(8 AS BIGINT) AS h, fp * 8 AS area, 7 + fp AS x2, CAST(27 AS BIGINT) AS y2,
CAST(8 + fp / 2.0 AS DOUBLE) AS cx, CAST(24 AS DOUBLE) AS cy FROM g WHERE fp >= 4""",
    "color_bar": f"WITH {_G} SELECT frame_id, CAST(8 AS BIGINT) AS x, CAST(20 AS BIGINT) AS y, fp AS w, CAST(8 AS BIGINT) AS h FROM g WHERE fp >= 8",
    "color_regions": f"WITH {_G} SELECT frame_id, CAST(0 AS BIGINT) AS ord, CAST(8 AS BIGINT) AS x, CAST(20 AS BIGINT) AS y, fp AS w, CAST(8 AS BIGINT) AS h FROM g WHERE fp >= 20",
    "bar_fill": f"""WITH {_G}, v AS (SELECT frame_id, CASE WHEN fp < 8 THEN NULL WHEN fp >= 60 OR kind = 2 THEN 100.0 ELSE 100.0 * fp / 64 END AS fill FROM g)
SELECT frame_id, round(CAST(fill AS DOUBLE), 4) AS fill, CASE WHEN fill IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence, 'bar' AS source,
CASE WHEN fill IS NULL THEN 'Unreliable' ELSE 'Heuristic' END AS reliability, CASE WHEN fill IS NULL THEN 'no bar found' END AS failure_reason, fill IS NOT NULL AS is_present FROM v""",
    "text_block": f"WITH {_G} SELECT frame_id, 6 + fp AS x, CAST(18 AS BIGINT) AS y, 68 - fp AS w, CAST(12 AS BIGINT) AS h FROM g WHERE kind = 1 AND fp < 64",
    "text_block_in_regions": f"""WITH {_G} SELECT frame_id, CASE WHEN fp < 32 THEN 1 ELSE 2 END::BIGINT AS region_no, 6 + fp AS x, CAST(18 AS BIGINT) AS y,
CASE WHEN fp < 32 THEN 36 - fp ELSE 68 - fp END AS w, CAST(12 AS BIGINT) AS h FROM g WHERE kind = 1 AND fp < 64""",
    "dominant_bucket": f"""WITH {_G}, o AS (SELECT *, CASE WHEN fp > 32 THEN 0 WHEN fp < 32 THEN 1 WHEN kind = 1 THEN 0 ELSE 1 END AS groove FROM g)
SELECT frame_id, CASE WHEN groove = 0 THEN 21 WHEN kind = 0 THEN 7 WHEN kind = 1 THEN 21 ELSE 1 END::BIGINT AS bucket_r,
CASE WHEN groove = 0 THEN 4 WHEN kind = 0 THEN 7 WHEN kind = 1 THEN 21 ELSE 1 END::BIGINT AS bucket_g,
CASE WHEN groove = 0 THEN 4 WHEN kind = 0 THEN 7 WHEN kind = 1 THEN 21 ELSE 1 END::BIGINT AS bucket_b,
8 * greatest(fp, 64 - fp) AS n FROM o""",
    "uniform_panel": "SELECT s_suppkey AS frame_id, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(96 AS BIGINT) AS w, CAST(20 AS BIGINT) AS h FROM supplier",
    "blank_frame": "SELECT s_suppkey AS frame_id, 'whole' AS part, false AS is_blank FROM supplier UNION ALL SELECT s_suppkey, 'top', true FROM supplier",
    "text_quality": f"""
WITH {_G}, p AS (SELECT frame_id, i % 96 AS x, i // 96 AS y, fp, kind FROM g, range(3072) AS r(i)),
l AS (SELECT frame_id, x, y, CASE WHEN NOT (x BETWEEN 8 AND 71 AND y BETWEEN 20 AND 27) THEN (299 * 28 + 587 * 30 + 114 * 34) // 1000 WHEN x < 8 + fp THEN (299 * 210 + 587 * 40 + 114 * 40) // 1000
  WHEN kind = 0 THEN (299 * 70 + 587 * 70 + 114 * 78) // 1000 WHEN kind = 1 THEN 210 ELSE 16 END AS luma FROM p),
s AS (SELECT frame_id, abs(lead(luma) OVER (PARTITION BY frame_id, y ORDER BY x) - luma) AS step FROM l),
c AS (SELECT frame_id, count(*) FILTER (WHERE step >= 18) AS edge_samples, count(*) FILTER (WHERE step >= 70) AS hard FROM s GROUP BY frame_id)
SELECT frame_id, CASE WHEN edge_samples >= 24 THEN round(CAST(CAST(hard AS FLOAT) / CAST(edge_samples AS FLOAT) AS DOUBLE), 4) ELSE 0.0 END AS sharpness, edge_samples,
edge_samples >= 24 AND CAST(hard AS FLOAT) / CAST(edge_samples AS FLOAT) >= CAST(0.35 AS FLOAT) AS is_legible,
CASE WHEN edge_samples < 24 THEN 'NoText' WHEN CAST(hard AS FLOAT) / CAST(edge_samples AS FLOAT) >= CAST(0.35 AS FLOAT) THEN 'Sharp' ELSE 'Blurred' END AS legibility FROM c""",
    "motion_mask_stats": f"""WITH {_M}, n AS (SELECT *, CASE WHEN status = 'ok' THEN 16 * least(step, 8) ELSE 0 END AS moved_pixels FROM f)
SELECT stream_id, frame_no, status, moved_pixels, round(CAST(CAST(moved_pixels AS FLOAT) / (CAST(width AS FLOAT) * CAST(24 AS FLOAT)) AS DOUBLE), 6) AS changed_fraction FROM n""",
    "motion_blobs": f"""WITH {_M} SELECT stream_id, frame_no, 4 + (frame_no - 1) * step AS x, CAST(8 AS BIGINT) AS y, CASE WHEN step = 8 THEN 16 ELSE step END AS w, CAST(8 AS BIGINT) AS h FROM f WHERE status = 'ok' AND step > 0
UNION ALL SELECT stream_id, frame_no, 12 + (frame_no - 1) * step, CAST(8 AS BIGINT), step, CAST(8 AS BIGINT) FROM f WHERE status = 'ok' AND step BETWEEN 1 AND 7""",
    "motion_detect": f"""
WITH {_M}, k AS (SELECT *, CASE WHEN step > 0 AND status = 'ok' THEN CASE WHEN stream_id % 11 = 5 AND frame_no = 5 THEN 3 ELSE frame_no END ELSE 0 END AS hits,
  CASE WHEN step = 0 OR frame_no = 0 THEN 0 WHEN step = 8 THEN 1 ELSE 2 END AS live, status = 'ok' AND step > 0 AS shown,
  CASE WHEN frame_no = 1 THEN 0 WHEN stream_id % 11 = 5 AND frame_no = 5 THEN 3 * step ELSE step END AS speed FROM f),
conf AS (SELECT * FROM (VALUES (1, 0.3), (2, 0.542275), (3, 0.698966), (4, 0.800307), (5, 0.865848)) AS t(hits, c))
SELECT stream_id, frame_no, CASE WHEN status = 'ok' THEN live END::BIGINT AS n_blobs, CASE WHEN status = 'ok' AND live > 0 THEN 1 END::BIGINT AS first_id, CASE WHEN status = 'ok' AND live > 0 THEN live END::BIGINT AS last_id,
CASE WHEN shown THEN 4 + (frame_no - 1) * step END AS first_x, CASE WHEN shown THEN 8 END::BIGINT AS first_y, CASE WHEN shown THEN CASE WHEN step = 8 THEN 16 ELSE step END END AS first_w, CASE WHEN shown THEN 8 END::BIGINT AS first_h,
CASE WHEN shown THEN CASE WHEN step = 8 THEN 4 ELSE 12 END + (frame_no - 1) * step END AS last_x, CASE WHEN shown THEN 8 END::BIGINT AS last_y, CASE WHEN shown THEN CASE WHEN step = 8 THEN 16 ELSE step END END AS last_w, CASE WHEN shown THEN 8 END::BIGINT AS last_h,
CASE WHEN shown THEN speed END::DOUBLE AS first_vx, CASE WHEN shown THEN speed END::DOUBLE AS last_vx, CASE WHEN shown THEN false END AS first_predicted, CASE WHEN shown THEN k.hits END::BIGINT AS first_age,
round(CAST(CAST(CASE WHEN status = 'ok' THEN 16 * least(step, 8) ELSE 0 END AS FLOAT) / CAST(width * 24 AS FLOAT) AS DOUBLE), 6) AS changed_fraction,
round(CAST(CASE WHEN status <> 'ok' THEN 0 WHEN step = 0 THEN 0.6 ELSE c END AS DOUBLE), 4) AS confidence, 'motion' AS source,
CASE WHEN status <> 'ok' THEN 'Unreliable' WHEN k.hits > 3 THEN 'Corroborated' ELSE 'Heuristic' END AS reliability,
CASE WHEN status <> 'ok' THEN status WHEN step = 0 THEN 'no motion above threshold' END AS failure_reason, CAST(live AS BIGINT) AS tracked_blobs
FROM k LEFT JOIN conf ON k.hits = conf.hits""",
    "normalize_text": rf"""
WITH t AS (SELECT conv_id, turn, ' ‘a’–' || chr(13) || chr(10) || chr(10) || chr(9) || text || ' b  ' AS text FROM conversations),
j AS (SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda s: regexp_replace(s, {_TRIM}, '', 'g')), lambda s: s <> ''), ' ') AS line FROM t)
SELECT conv_id, turn, regexp_replace(translate(line, '‘’–—' || chr(160), '''''-- '), {_TRIM}, '', 'g') AS line FROM j""",
    "ocr_tsv_words": """SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS text, l_partkey AS x, l_suppkey AS y, CAST(l_linenumber AS BIGINT) AS w, CAST(trunc(l_quantity) AS BIGINT) AS h
FROM lineitem WHERE l_linenumber NOT IN (3, 4, 5, 6)""",
    "text_width": "SELECT p_partkey, " + ", ".join(f"CAST(CASE WHEN length(p_name) = 0 THEN 0 ELSE length(p_name) * {6 * s} - {s} END AS BIGINT) AS width_{s}, CAST({7 * s} AS BIGINT) AS height_{s}" for s in (1, 2, 3)) + " FROM part",
    "glyph_pixels": f"""
WITH glyph(ch, col, bit) AS (VALUES {_GLYPH_ROWS}),
c AS (SELECT p_partkey, t.i, upper(substr(p_name, CAST(t.i AS INT), 1)) AS ch FROM part, range(1, 40) AS t(i) WHERE t.i <= length(p_name))
SELECT p_partkey, count(*) * 4 AS n, min(3 + (i - 1) * 12 + col * 2) AS px0, max(3 + (i - 1) * 12 + col * 2 + 1) AS px1, CAST(min(5 + bit * 2) AS BIGINT) AS py0, CAST(max(5 + bit * 2 + 1) AS BIGINT) AS py1
FROM c JOIN glyph USING (ch) GROUP BY p_partkey""",
    "overlay_rect": """
WITH p AS (SELECT s_suppkey AS frame_id, s_suppkey % 90 AS x0, s_suppkey % 30 AS y0, i % 96 AS x, i // 96 AS y FROM supplier, range(3072) AS r(i))
SELECT frame_id, count(*) FILTER (WHERE x >= x0 AND x < x0 + 10 AND y >= y0 AND y < y0 + 6 AND (x = x0 OR x = x0 + 9 OR y = y0 OR y = y0 + 5)) AS n_drawn, count(*) AS n FROM p GROUP BY frame_id""",
    "moving_average": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5.0, 6) AS average FROM events",
    "fps": """WITH a AS (SELECT event_id, sum(value / 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4.0 AS v FROM events)
SELECT event_id, round(CASE WHEN v <= 0 THEN 0.0 ELSE 1.0 / v END, 4) AS fps FROM a""",
}
ORACLES = {**_ORACLES, **MORE_ORACLES, "pixel_motion_blobs": _ORACLES["motion_blobs"]}
