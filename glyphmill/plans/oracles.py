"""DuckDB SQL for the queries, written apart from the Spark plans: nested loops and plain windows instead of grids."""

from __future__ import annotations

CTE: dict[str, str] = {}
ORACLE_SQL: dict[str, str] = {}


def sql(ctes: str, select: str) -> str:
    """The named CTEs with all that they need, in order, and a final select."""
    need: list[str] = []

    def visit(name: str) -> None:
        for other in USES.get(name, "").split():
            visit(other)
        if name not in need:
            need.append(name)

    for name in ctes.split():
        visit(name)
    select = select.strip()
    join = ",\n" + select.removeprefix("WITH ") if select.startswith("WITH ") else "\n" + select
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in need) + join


USES = {
    "lined": "", "boxes": "lined", "tier1": "boxes", "dense": "tier1", "live": "dense", "cap": "live", "med": "cap live", "smalls": "live med", "parents": "live med", "child": "smalls parents", "tier2": "dense live med child",
    "chars": "samples", "runs": "chars", "words": "runs", "lines": "chars", "gtwords": "words", "nontext": "words", "comps": "chars", "surv": "comps", "pairs": "surv chars", "compagg": "pairs", "charagg": "pairs compagg", "outcome": "charagg chars",
    "junk": "surv chars pairs nontext", "charfacts": "outcome junk surv samples", "regions": "gtwords lines samples", "rpairs": "surv regions", "covered": "rpairs", "wordfacts": "regions rpairs covered surv samples gtwords", "sliced": "samples",
    "perdoc": "timings", "medians": "perdoc", "hist": "pixels", "otsu": "hist", "inked": "pixels otsu", "receipts": "words", "rlines": "receipts", "srows": "samples gtwords",
}

CTE["lined"] = """
SELECT *, (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 100 AS r, (l_orderkey // 40)::INT AS page FROM lineitem"""
CTE["boxes"] = """
SELECT page, id, x, y, w, h, greatest(1, (w * h * pct) // 100)::INT AS pixel_area, greatest(1, (w * h * pct) // 100) / (w * h)::DOUBLE AS fill_ratio FROM (
  SELECT page, row_number() OVER (PARTITION BY page ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id,
    ((l_partkey * 13 + l_linenumber * 17) % 900)::INT AS x, ((l_orderkey * 11 + l_suppkey * 29) % 900)::INT AS y,
    (CASE WHEN r < 60 THEN 6 + l_partkey % 10 WHEN r < 70 THEN 2 + l_partkey % 3 WHEN r < 75 THEN 200 WHEN r < 78 THEN 2 WHEN r < 81 THEN 700 WHEN r < 84 THEN 650 WHEN r < 87 THEN 60 WHEN r < 90 THEN 200 WHEN r < 93 THEN 1 WHEN r < 96 THEN 24 WHEN r < 98 THEN 300 ELSE 800 END)::INT AS w,
    (CASE WHEN r < 60 THEN 14 + l_suppkey % 10 WHEN r < 70 THEN 2 + l_suppkey % 3 WHEN r < 75 THEN 2 WHEN r < 78 THEN 150 WHEN r < 81 THEN 700 WHEN r < 84 THEN 650 WHEN r < 87 THEN 40 WHEN r < 90 THEN 14 WHEN r < 93 THEN 1 WHEN r < 96 THEN 100 WHEN r < 98 THEN 300 ELSE 20 END)::INT AS h,
    (CASE WHEN r < 60 THEN 40 + l_partkey % 40 WHEN r < 78 THEN 95 WHEN r < 81 THEN 3 WHEN r < 84 THEN 85 WHEN r < 87 THEN 8 WHEN r < 90 THEN 25 WHEN r < 93 THEN 60 WHEN r < 98 THEN 60 ELSE 90 END)::INT AS pct
  FROM lined)"""
CTE["tier1"] = """
SELECT *, CASE WHEN reason IN ('t1:degenerate') THEN 'noise' WHEN reason = 't1:oversized' THEN 'blob' WHEN reason = '' THEN 'text' ELSE 'rule' END AS kind FROM (
  SELECT *, CASE WHEN pixel_area < 4 OR (h < 2 AND w < 2) THEN 't1:degenerate'
    WHEN w > 600 OR h > 600 THEN CASE WHEN fill_ratio < 15e-2 THEN 't1:frame' WHEN (w / h::DOUBLE >= 8 OR w / h::DOUBLE <= 3e-2) AND fill_ratio >= 4e-1 THEN 't1:oversized_rule' ELSE 't1:oversized' END
    WHEN w / h::DOUBLE <= 3e-2 THEN 't1:vertical_rule'
    WHEN w / h::DOUBLE >= 12 THEN CASE WHEN fill_ratio >= 4e-1 THEN 't1:horizontal_rule' ELSE '' END
    WHEN fill_ratio < 15e-2 THEN 't1:hollow' ELSE '' END AS reason FROM boxes)"""
CTE["dense"] = """
SELECT *, first AND count(*) FILTER (kind = 'text' AND NOT dense) OVER (PARTITION BY page) >= 12 AS live FROM (
  SELECT *, first AND kind = 'text' AND pixel_area > 20000 AS dense FROM (SELECT *, count(*) FILTER (kind = 'text') OVER (PARTITION BY page) >= 12 AS first FROM tier1))"""
CTE["live"] = "SELECT * FROM dense WHERE live AND kind = 'text' AND NOT dense"
CTE["cap"] = """
SELECT page, greatest(1, max(pixel_area)) AS cap FROM (SELECT page, pixel_area, row_number() OVER (PARTITION BY page ORDER BY pixel_area) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM live) WHERE i = floor(95e-2 * (n - 1)) GROUP BY page"""
CTE["med"] = """
SELECT page, min(h) AS median FROM (SELECT l.page, l.h, sum(least(pixel_area, cap)) OVER (PARTITION BY l.page ORDER BY l.h) AS c, sum(least(pixel_area, cap)) OVER (PARTITION BY l.page) AS t FROM live l JOIN cap USING (page)) WHERE c * 2 >= t GROUP BY page"""
CTE["smalls"] = "SELECT l.*, median FROM live l JOIN med USING (page) WHERE h < 3e-1 * median"
CTE["parents"] = "SELECT l.*, median FROM live l JOIN med USING (page) WHERE h >= 6e-1 * median"
CTE["child"] = """
SELECT s.page, s.id FROM smalls s WHERE EXISTS (SELECT 1 FROM parents p WHERE p.page = s.page AND p.id <> s.id AND least(s.x + s.w, p.x + p.w) - greatest(s.x, p.x) >= 3e-1 * s.w AND greatest(p.y - (s.y + s.h), s.y - (p.y + p.h), 0) <= 12e-1 * s.median)"""
CTE["tier2"] = """
SELECT d.page, d.id, coalesce(m.median, 0) AS median, d.live, coalesce(
    CASE WHEN d.dense THEN 'blob' WHEN l.id IS NULL THEN NULL WHEN d.h > 4 * m.median THEN 'blob' WHEN d.h < 3e-1 * m.median AND c.id IS NOT NULL THEN 'diacritic' WHEN d.h < 3e-1 * m.median THEN 'noise' END, d.kind) AS kind,
  coalesce(CASE WHEN d.dense THEN 't2:dense_region' WHEN l.id IS NULL THEN NULL WHEN d.h > 4 * m.median THEN 't2:oversized_vs_median' WHEN d.h < 3e-1 * m.median AND c.id IS NOT NULL THEN 't2:diacritic' WHEN d.h < 3e-1 * m.median THEN 't2:small_orphan' END, d.reason) AS reason
FROM dense d LEFT JOIN live l ON d.page = l.page AND d.id = l.id LEFT JOIN med m ON d.page = m.page LEFT JOIN child c ON d.page = c.page AND d.id = c.id"""

_KINDS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("text", "diacritic", "rule", "blob", "noise"))
O = ORACLE_SQL
O["tier1_routing"] = sql("tier1", "SELECT kind, reason, count(*) AS n FROM tier1 GROUP BY ALL")
O["kind_counts"] = sql("tier1", f"SELECT page, {_KINDS} FROM tier1 GROUP BY page")
O["bbox_props"] = sql("boxes", "SELECT page, id, x + w AS x2, y + h AS y2, w * h AS area, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy, CASE WHEN h = 0 THEN 0e0 ELSE w::DOUBLE / h END AS aspect, fill_ratio FROM boxes")
_NEXT = "(SELECT page, id, x AS ax, y AS ay, w AS aw, h AS ah, lead(x) OVER o AS bx, lead(y) OVER o AS b_y, lead(w) OVER o AS bw, lead(h) OVER o AS bh FROM boxes WINDOW o AS (PARTITION BY page ORDER BY id))"
O["bbox_iou_pairs"] = sql("boxes", f"""
SELECT page, id, inter, CASE WHEN aw * ah + bw * bh - inter = 0 THEN 0e0 ELSE inter::DOUBLE / (aw * ah + bw * bh - inter) END AS iou, CASE WHEN bw * bh = 0 THEN 0e0 ELSE inter::DOUBLE / (bw * bh) END AS coverage,
  CASE WHEN dy <= 0 THEN 0e0 ELSE dy::DOUBLE / least(ah, bh) END AS v_overlap
FROM (SELECT *, greatest(dx, 0) * greatest(dy, 0) AS inter FROM (SELECT *, least(ax + aw, bx + bw) - greatest(ax, bx) AS dx, least(ay + ah, b_y + bh) - greatest(ay, b_y) AS dy FROM {_NEXT} WHERE bx IS NOT NULL))""")
O["bbox_scaled"] = sql("boxes", "SELECT page, id, round_even(x * 25e-2, 0)::INT AS x, round_even(y * 25e-2, 0)::INT AS y, greatest(1, round_even(w * 25e-2, 0)::INT) AS w, greatest(1, round_even(h * 25e-2, 0)::INT) AS h FROM boxes")
O["bbox_union"] = sql("boxes", "SELECT page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY page")
O["bbox_pair_union"] = sql("boxes", f"SELECT page, id, least(ax, bx) AS x, least(ay, b_y) AS y, greatest(ax + aw, bx + bw) - least(ax, bx) AS w, greatest(ay + ah, b_y + bh) - least(ay, b_y) AS h FROM {_NEXT} WHERE bx IS NOT NULL")
O["polygon_to_bbox"] = """
WITH p AS (SELECT o_orderkey, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM (
  SELECT o_orderkey, ((o_orderkey * 7 + o_custkey * 3 + i * 37) % 400) / 2e0 AS px, ((o_orderkey * 5 + o_custkey * 11 + i * 37) % 400) / 2e0 AS py FROM orders, range(4) t(i)) GROUP BY o_orderkey)
SELECT o_orderkey, round_even(x0, 0)::INT AS x, round_even(y0, 0)::INT AS y, greatest(1, round_even(x1, 0)::INT - round_even(x0, 0)::INT) AS w, greatest(1, round_even(y1, 0)::INT - round_even(y0, 0)::INT) AS h FROM p"""
_DIMS = "(SELECT o_orderkey, (50 + o_orderkey * 31 % 3000)::INT AS h, (40 + o_custkey * 17 % 3000)::INT AS w FROM orders)"
O["compute_scale"] = f"""
SELECT o_orderkey, scale, greatest(1, round_even(h * scale, 0)::INT) AS new_h, greatest(1, round_even(w * scale, 0)::INT) AS new_w, CASE WHEN scale < 1 THEN 'area' WHEN scale > 1 THEN 'cubic' ELSE 'none' END AS interpolation
FROM (SELECT *, CASE WHEN greatest(h, w) > 1600 THEN 16e2 / greatest(h, w) WHEN greatest(h, w) < 1000 THEN 10e2 / greatest(h, w) ELSE 1e0 END AS scale FROM {_DIMS})"""
O["kernel_size"] = f"SELECT o_orderkey, CASE WHEN k % 2 = 1 THEN k ELSE k + 1 END AS kernel FROM (SELECT o_orderkey, greatest(31, greatest(h, w) // 50) AS k FROM {_DIMS})"
O["xyxy_to_xywh"] = """
SELECT o_orderkey, CASE WHEN ok THEN x0 END AS x, CASE WHEN ok THEN y0 END AS y, CASE WHEN ok THEN x1 - x0 END AS w, CASE WHEN ok THEN y1 - y0 END AS h, CASE WHEN tk THEN t0 END AS tx, CASE WHEN tk THEN u0 END AS ty, CASE WHEN tk THEN t1 - t0 END AS tw, CASE WHEN tk THEN u1 - u0 END AS th
FROM (SELECT *, x1 > x0 AND y1 > y0 AS ok, t1 > t0 AND u1 > u0 AS tk FROM (
  SELECT o_orderkey, round_even(a, 0)::INT AS x0, round_even(b, 0)::INT AS y0, round_even(c, 0)::INT AS x1, round_even(d, 0)::INT AS y1, floor(a)::INT AS t0, floor(b)::INT AS u0, floor(c)::INT AS t1, floor(d)::INT AS u1
  FROM (SELECT o_orderkey, (o_orderkey % 300) / 2e0 AS a, (o_custkey % 200) / 2e0 AS b, ((o_orderkey * 7 + o_custkey) % 500) / 2e0 AS c, ((o_custkey * 3 + o_orderkey) % 400) / 2e0 AS d FROM orders)))"""

CTE["samples"] = """
SELECT conv_id * 1000 + turn AS sample_id, role AS source, ['scan', 'photo', 'digital'][(conv_id % 3 + 1)::INT] AS capture, ['latin', 'han', 'thai', 'latin'][(conv_id % 4 + 1)::INT] AS script,
  (75 + ((conv_id * 1000 + turn) * 37) % 250)::INT AS dpi, ['', 'receipt', 'form', 'id_card'][(turn % 4 + 1)::INT] AS template, conv_id % 5 <> 0 AS gt_complete, (conv_id * 1000 + turn) % 11 <> 0 AS has_image, coalesce(text, '') AS text FROM conversations"""
CTE["chars"] = """
SELECT sample_id, pos, ch, (pos // 60)::INT AS row, (20 + 14 * (pos % 60))::INT AS x, (20 + 30 * (pos // 60))::INT AS y, CASE WHEN ch IN ('.', ',', ';', ':', '!', '?', '''', '"', '-') THEN 4 ELSE 10 END AS w,
  CASE WHEN ch IN ('.', ',', ';', ':', '!', '?', '''', '"', '-') THEN 4 WHEN regexp_matches(ch, '^[a-z]$') THEN 14 ELSE 20 END AS h
FROM (SELECT sample_id, i::INT AS pos, substr(text, i::INT + 1, 1) AS ch FROM (SELECT sample_id, text, unnest(range(length(text))) AS i FROM samples)) WHERE ch NOT IN (' ', chr(10), chr(9), chr(13))"""
CTE["runs"] = "SELECT *, pos - row_number() OVER (PARTITION BY sample_id, row ORDER BY pos) AS run FROM chars"
CTE["words"] = "SELECT sample_id, min(pos) AS pos, string_agg(ch, '' ORDER BY pos) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, row FROM runs GROUP BY sample_id, row, run"
CTE["lines"] = "SELECT sample_id, row AS pos, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM chars GROUP BY sample_id, row"
CTE["gtwords"] = "SELECT * FROM words WHERE sample_id % 4 <> 1"
CTE["nontext"] = "SELECT sample_id, pos, x - 2 AS x, y - 2 AS y, w + 4 AS w, h + 4 AS h FROM words WHERE (sample_id + pos) % 9 = 0"
CTE["comps"] = """
SELECT sample_id, (pos * 2 + k)::BIGINT AS id, x, y, w, h, CASE WHEN r IN (85, 86) THEN 'noise' WHEN r = 87 THEN 'diacritic' WHEN r = 59 THEN 'rule' ELSE 'text' END AS kind FROM (
  SELECT sample_id, pos, r, 0 AS k, x, y, w, h FROM c WHERE r < 60 OR r >= 93
  UNION ALL SELECT sample_id, pos, r, 0, x, y, w + 14, h FROM c WHERE r >= 60 AND r < 70
  UNION ALL SELECT sample_id, pos, r, 0, x, y, w, greatest(1, h * 45 // 100) FROM c WHERE r >= 70 AND r < 78
  UNION ALL SELECT sample_id, pos, r, 1, x, y + h - greatest(1, h * 45 // 100), w, greatest(1, h * 45 // 100) FROM c WHERE r >= 70 AND r < 78
  UNION ALL SELECT sample_id, pos, r, 0, x + 3, y + 4, w, h FROM c WHERE r >= 85 AND r < 93
  UNION ALL SELECT sample_id, pos, r, 1, x, y + 24, 3, 3 FROM c WHERE r >= 93)"""
CTE["comps"] = "WITH c AS (SELECT *, (sample_id * 31 + pos * 17) % 100 AS r FROM chars) " + CTE["comps"]
CTE["surv"] = "SELECT sample_id, id AS cid, x AS cx, y AS cy, w AS cw, h AS ch FROM comps WHERE kind IN ('text', 'diacritic')"
CTE["pairs"] = """
SELECT sample_id, cid, pos, inter, inter::DOUBLE / (cw * ch + w * h - inter) AS iou, inter::DOUBLE / (w * h) AS of_gt, inter::DOUBLE / (cw * ch) AS of_comp FROM (
  SELECT s.sample_id, cid, cw, s.ch, pos, w, h, (least(cx + cw, x + w) - greatest(cx, x)) * (least(cy + s.ch, y + h) - greatest(cy, y)) AS inter
  FROM surv s JOIN chars g ON s.sample_id = g.sample_id AND cx < x + w AND x < cx + cw AND cy < y + h AND y < cy + s.ch)"""
CTE["compagg"] = "SELECT sample_id, cid, count(*) FILTER (iou >= 5e-1) AS cm, count(*) FILTER (of_gt >= 5e-1) AS covers, max(of_comp) AS best FROM pairs GROUP BY ALL"
CTE["charagg"] = """
SELECT p.sample_id, p.pos, count(*) FILTER (iou >= 5e-1) AS matches, coalesce(bool_and(cm = 1) FILTER (iou >= 5e-1), false) AS alone, bool_or(of_gt >= 5e-1 AND covers >= 2) AS in_merged, count(*) FILTER (of_comp >= 5e-1) AS fragments, coalesce(sum(inter) FILTER (of_comp >= 5e-1), 0) AS farea
FROM pairs p JOIN compagg a ON p.sample_id = a.sample_id AND p.cid = a.cid GROUP BY ALL"""
CTE["outcome"] = """
SELECT c.sample_id, c.pos, CASE WHEN matches = 1 AND alone THEN 'isolated' WHEN in_merged THEN 'merged' WHEN fragments >= 2 AND farea >= 5e-1 * w * h THEN 'over_segmented' WHEN matches > 0 THEN 'merged' ELSE 'missed' END AS outcome,
  h < 55e-2 * quantile_cont(h, 0.5) OVER (PARTITION BY c.sample_id) AS small, a.pos IS NOT NULL AS touched
FROM chars c LEFT JOIN charagg a ON c.sample_id = a.sample_id AND c.pos = a.pos"""
CTE["junk"] = """
SELECT s.sample_id, s.cid, coalesce(b.best, 0) < 3e-1 AS junk, EXISTS (SELECT 1 FROM nontext n WHERE n.sample_id = s.sample_id AND greatest(0, least(cx + cw, n.x + n.w) - greatest(cx, n.x)) * greatest(0, least(cy + ch, n.y + n.h) - greatest(cy, n.y)) >= 5e-1 * cw * ch) AS in_nontext
FROM surv s LEFT JOIN (SELECT sample_id, cid, max(of_comp) AS best FROM pairs GROUP BY ALL) b ON s.sample_id = b.sample_id AND s.cid = b.cid WHERE s.sample_id IN (SELECT sample_id FROM chars)"""
CTE["charfacts"] = """
SELECT s.sample_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_surviving, 0) AS n_surviving, coalesce(isolated, 0) AS isolated, coalesce(merged, 0) AS merged, coalesce(over_segmented, 0) AS over_segmented, coalesce(missed, 0) AS missed,
  coalesce(j.junk, 0) AS junk, coalesce(junk_in_nontext, 0) AS junk_in_nontext, coalesce(small_gt, 0) AS small_gt, coalesce(small_retained, 0) AS small_retained, gt_complete
FROM samples s LEFT JOIN (SELECT sample_id, count(*) AS n_gt, count(*) FILTER (outcome = 'isolated') AS isolated, count(*) FILTER (outcome = 'merged') AS merged, count(*) FILTER (outcome = 'over_segmented') AS over_segmented, count(*) FILTER (outcome = 'missed') AS missed,
    count(*) FILTER (small) AS small_gt, count(*) FILTER (small AND (outcome <> 'missed' OR touched)) AS small_retained FROM outcome GROUP BY ALL) o ON s.sample_id = o.sample_id
  LEFT JOIN (SELECT sample_id, count(*) FILTER (junk) AS junk, count(*) FILTER (junk AND in_nontext) AS junk_in_nontext FROM junk GROUP BY ALL) j ON s.sample_id = j.sample_id
  LEFT JOIN (SELECT sample_id, count(*) AS n_surviving FROM surv GROUP BY ALL) v ON s.sample_id = v.sample_id"""
CTE["regions"] = "SELECT sample_id, pos, x, y, w, h FROM gtwords UNION ALL SELECT sample_id, pos, x, y, w, h FROM lines WHERE sample_id NOT IN (SELECT sample_id FROM gtwords)"
_SHARE = "(least(cx + cw, x + w) - greatest(cx, x)) * (least(cy + ch, y + h) - greatest(cy, y)) / (cw * ch)::DOUBLE"
_MEETS = "cx < x + w AND x < cx + cw AND cy < y + h AND y < cy + ch"
CTE["rpairs"] = f"SELECT s.sample_id, cid, pos, cx, cy, cw, ch, x, y, w, h, {_SHARE} AS share FROM surv s JOIN regions r ON s.sample_id = r.sample_id AND {_MEETS}"
#: The union's area by counting its pixels.
_PIXELS = """SELECT sample_id, pos, w, h, count(*) AS covered FROM (SELECT DISTINCT sample_id, pos, w, h, px, py FROM (SELECT sample_id, pos, w, h, px, unnest(range(greatest(cy, y), least(cy + ch, y + h))) AS py FROM (SELECT *, unnest(range(greatest(cx, x), least(cx + cw, x + w))) AS px FROM {pairs} WHERE share >= 5e-1))) GROUP BY ALL"""
CTE["covered"] = _PIXELS.format(pairs="rpairs")
CTE["wordfacts"] = """
SELECT s.sample_id, CASE WHEN s.sample_id IN (SELECT sample_id FROM gtwords) THEN 'word' ELSE 'line' END AS granularity, coalesce(n_gt, 0) AS n_gt, coalesce(n_surviving, 0) AS n_surviving, coalesce(hit, 0) AS hit, coalesce(crossing, 0) AS crossing,
  CASE WHEN coalesce(n_gt, 0) > 0 THEN coalesce(n_surviving, 0) - coalesce(assigned, 0) ELSE 0 END AS junk, coalesce(coverage_sum, 0e0) AS coverage_sum
FROM samples s LEFT JOIN (SELECT r.sample_id, count(*) AS n_gt, count(*) FILTER (inside) AS hit, count(*) FILTER (straddle) AS crossing, sum(coalesce(c.covered::DOUBLE / (r.w * r.h), 0e0)) AS coverage_sum
    FROM regions r LEFT JOIN (SELECT sample_id, pos, bool_or(share >= 5e-1) AS inside, bool_or(share < 5e-1 AND share >= 15e-2) AS straddle FROM rpairs GROUP BY ALL) p ON r.sample_id = p.sample_id AND r.pos = p.pos
    LEFT JOIN covered c ON r.sample_id = c.sample_id AND r.pos = c.pos GROUP BY ALL) o ON s.sample_id = o.sample_id
  LEFT JOIN (SELECT sample_id, count(DISTINCT cid) AS assigned FROM rpairs WHERE share >= 15e-2 GROUP BY ALL) a ON s.sample_id = a.sample_id
  LEFT JOIN (SELECT sample_id, count(*) AS n_surviving FROM surv GROUP BY ALL) v ON s.sample_id = v.sample_id"""
_BUCKET = "CASE WHEN dpi < 100 THEN '<100' WHEN dpi < 150 THEN '100-149' WHEN dpi < 250 THEN '150-249' ELSE '>=250' END"
CTE["sliced"] = f"SELECT sample_id, unnest(['all', 'capture', 'source', 'script', 'dpi', 'template']) AS slice_key, unnest(['all', capture, source, script, {_BUCKET}, CASE WHEN template = '' THEN '-' ELSE template END]) AS slice FROM samples"
_R = lambda a, b, n: f"round(CASE WHEN {b} = 0 THEN 0e0 ELSE {a}::DOUBLE / {b} END, 6) AS {n}"
_CHAR_RATES = ", ".join([_R("sum(isolated)", "sum(n_gt)", "isolation_recall"), _R("sum(over_segmented)", "sum(n_gt)", "over_segmentation_rate"), _R("sum(merged)", "sum(n_gt)", "merge_rate"), _R("sum(missed)", "sum(n_gt)", "miss_rate"),
    "CASE WHEN bool_and(gt_complete) THEN round(CASE WHEN sum(n_surviving) = 0 THEN 0e0 ELSE sum(junk)::DOUBLE / sum(n_surviving) END, 6) END AS junk_rate", "CASE WHEN sum(small_gt) > 0 THEN round(sum(small_retained)::DOUBLE / sum(small_gt), 6) END AS small_retention"])
_WORD_RATES = lambda p="": ", ".join([_R("sum(hit)", "sum(n_gt)", p + "hit_rate"), _R("sum(coverage_sum)", "sum(n_gt)", p + "mean_coverage"), _R("sum(crossing)", "sum(n_gt)", p + "crossing_rate"), _R("sum(junk)", "sum(n_surviving)", p + "junk_rate")])
_GRAIN = "CASE count(DISTINCT granularity) FILTER (n_gt > 0) WHEN 0 THEN 'none' WHEN 1 THEN max(granularity) FILTER (n_gt > 0) ELSE 'mixed' END AS granularity"
_COUNTERS = ("n_gt", "n_surviving", "isolated", "merged", "over_segmented", "missed", "junk", "junk_in_nontext", "small_gt", "small_retained")

O["dpi_bucket"] = sql("samples", f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM samples GROUP BY ALL")
O["effective_dpi"] = sql("samples", "SELECT sample_id, round_even(dpi * (3e-1 + (sample_id % 7) * 1e-1), 0)::INT AS dpi FROM samples")
O["ink_weighted_median"] = sql("tier1", """
SELECT page, min(h) AS median FROM (SELECT t.page, t.h, sum(least(pixel_area, cap)) OVER (PARTITION BY t.page ORDER BY t.h) AS c, sum(least(pixel_area, cap)) OVER (PARTITION BY t.page) AS s FROM tier1 t JOIN
  (SELECT page, greatest(1, max(pixel_area)) AS cap FROM (SELECT page, pixel_area, row_number() OVER (PARTITION BY page ORDER BY pixel_area) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM tier1 WHERE kind = 'text') WHERE i = floor(95e-2 * (n - 1)) GROUP BY page) k USING (page) WHERE kind = 'text') WHERE c * 2 >= s GROUP BY page""")
O["diacritic_parent"] = sql("child", "SELECT page, id FROM child")
O["tier2_routing"] = sql("tier2", "SELECT kind, reason, count(*) AS n FROM tier2 GROUP BY ALL")
O["filter_stats"] = sql("tier2", f"SELECT page, count(*) AS total, round_even(max(median)::DOUBLE, 2) AS median_height, bool_or(live) AS relative_gates_applied, {_KINDS} FROM tier2 GROUP BY page")

CTE["timings"] = "SELECT user_id AS document, json_extract_string(props, '$.k')::INT AS repeat, event_type AS stage, value::DOUBLE AS ms FROM events"
CTE["perdoc"] = "SELECT document, repeat, stage, sum(ms) AS ms FROM timings GROUP BY ALL"
CTE["medians"] = """
SELECT document, stage, quantile_cont(ms, 0.5) AS ms FROM (
  SELECT r.document, r.repeat, s.stage, coalesce(p.ms, 0e0) AS ms FROM (SELECT DISTINCT document, repeat FROM perdoc) r JOIN (SELECT DISTINCT document, stage FROM perdoc) s USING (document) LEFT JOIN perdoc p ON p.document = r.document AND p.repeat = r.repeat AND p.stage = s.stage
  UNION ALL SELECT document, repeat, 'total', sum(ms) FROM perdoc GROUP BY ALL) GROUP BY ALL"""
_P = "round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round(quantile_cont(ms, 0.99), 3) AS p99, round(sum(round_even(ms * 1e6, 0)::BIGINT)::DOUBLE / count(ms) / 1e6, 3) AS mean, round(max(ms), 3) AS max, count(ms) AS n"
O["percentiles"] = sql("timings", f"SELECT stage, {_P} FROM timings GROUP BY stage")
O["stage_totals"] = sql("perdoc", "SELECT document, repeat, stage, round(ms, 6) AS ms FROM perdoc")
O["stage_medians"] = sql("medians", "SELECT document, stage, round(ms, 6) AS ms FROM medians")
O["latency_summary"] = sql("medians", f"SELECT stage, {_P}, (stage = 'total')::INT AS last FROM medians GROUP BY stage")

O["char_pairs"] = sql("pairs", "SELECT sample_id, count(*) AS pairs, sum(inter)::BIGINT AS inter, count(*) FILTER (iou >= 5e-1) AS matches, count(*) FILTER (of_gt >= 5e-1) AS covers, count(*) FILTER (of_comp >= 5e-1) AS fragments FROM pairs GROUP BY ALL")
O["char_outcomes"] = sql("outcome", "SELECT * FROM outcome")
O["junk_components"] = sql("junk", "SELECT sample_id, cid, in_nontext FROM junk WHERE junk")
O["small_retention"] = sql("outcome", "SELECT sample_id, count(*) AS small_gt, count(*) FILTER (outcome <> 'missed' OR touched) AS small_retained FROM outcome WHERE small GROUP BY ALL")
O["char_metrics"] = sql("charfacts", "SELECT * FROM charfacts")
O["word_metrics"] = sql("wordfacts", "SELECT * REPLACE (round(coverage_sum, 6) AS coverage_sum) FROM wordfacts")
O["word_coverage"] = sql("surv words", f"WITH p AS (SELECT s.sample_id, cid, pos, cx, cy, cw, ch, x, y, w, h, {_SHARE} AS share FROM surv s JOIN words r ON s.sample_id = r.sample_id AND {_MEETS}), c AS (" + _PIXELS.format(pairs="p") + ") SELECT sample_id, pos, covered, covered::DOUBLE / (w * h) AS coverage FROM c")
O["aggregate_chars"] = sql("charfacts", "SELECT source, count(*) AS samples, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _COUNTERS) + f", bool_and(f.gt_complete) AS gt_complete, {_CHAR_RATES.replace('bool_and(gt_complete)', 'bool_and(f.gt_complete)')} FROM charfacts f JOIN samples s USING (sample_id) GROUP BY source")
O["aggregate_words"] = sql("wordfacts", f"SELECT source, count(*) AS samples, sum(n_gt)::BIGINT AS n_gt, sum(n_surviving)::BIGINT AS n_surviving, sum(hit)::BIGINT AS hit, sum(crossing)::BIGINT AS crossing, sum(junk)::BIGINT AS junk, round(sum(coverage_sum), 4) AS coverage_sum, {_GRAIN} FROM wordfacts JOIN samples USING (sample_id) GROUP BY source")
O["report_slices"] = sql("charfacts sliced", f"SELECT slice_key, slice, count(*) AS samples, sum(n_gt)::BIGINT AS n_gt, {_CHAR_RATES} FROM charfacts JOIN sliced USING (sample_id) WHERE n_gt > 0 GROUP BY slice_key, slice HAVING sum(n_gt) > 0")
O["report_word_slices"] = sql("wordfacts sliced", f"SELECT slice_key, slice, count(*) AS samples, {_GRAIN}, sum(n_gt)::BIGINT AS n_gt, {_WORD_RATES()} FROM wordfacts JOIN sliced USING (sample_id) GROUP BY slice_key, slice HAVING sum(n_gt) > 0")
O["routing_by_capture"] = sql("comps", f"SELECT capture, {_KINDS} FROM comps JOIN samples USING (sample_id) GROUP BY capture")
O["headline"] = sql("charfacts wordfacts medians", f"SELECT * FROM (SELECT {_CHAR_RATES} FROM charfacts), (SELECT {_WORD_RATES('region_')} FROM wordfacts), (SELECT round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round(quantile_cont(ms, 0.99), 3) AS p99 FROM medians WHERE stage = 'total')")
_RUN = "source IN ('user', 'assistant') AND capture IN ('scan', 'photo') AND script = 'latin'"
O["run_filter"] = sql("samples", f"SELECT sample_id, source, capture, script FROM samples WHERE {_RUN}")
O["skipped_samples"] = sql("samples", f"SELECT sample_id FROM samples WHERE {_RUN} AND NOT has_image")
O["run_limit"] = sql("samples", "SELECT sample_id FROM samples WHERE capture = 'scan' AND has_image ORDER BY sample_id LIMIT 25")

CTE["srows"] = """
SELECT s.*, coalesce(n, 0) AS n_words, CASE WHEN s.sample_id % 3 = 0 AND length(regexp_replace(text, '[ \\n\\t\\r]', '', 'g')) > 0 THEN length(regexp_replace(text, '[ \\n\\t\\r]', '', 'g')) ELSE -1 END AS n_chars FROM samples s LEFT JOIN (SELECT sample_id, count(*) AS n FROM gtwords GROUP BY ALL) w ON s.sample_id = w.sample_id"""
O["manifest"] = sql("srows", "SELECT sample_id::VARCHAR AS sample_id, source, capture, script, dpi, n_chars > 0 AS has_char_gt, n_words, has_image AS image_present FROM srows")
O["source_status"] = sql("samples", """
SELECT source, want, n_gt, n_images, status, status <> 'ok' AS needed FROM (SELECT *, CASE WHEN n_images >= want AND n_gt >= want THEN 'ok' WHEN n_gt > 0 AND n_images = 0 THEN 'ground truth but no images' WHEN n_gt > 0 THEN 'incomplete (' || n_images || '/' || want || ')' ELSE 'missing' END AS status FROM (
  SELECT e.source, want, coalesce(n_gt, 0) AS n_gt, coalesce(n_images, 0) AS n_images FROM (VALUES ('user', 20), ('assistant', 100000), ('system', 5), ('tool', 3)) e(source, want) LEFT JOIN (SELECT source, count(*) AS n_gt, count(*) FILTER (has_image) AS n_images FROM samples GROUP BY ALL) c ON e.source = c.source))""")
CTE["receipts"] = "SELECT sample_id, pos, x, y, w, h, CASE WHEN pos % 13 = 0 THEN '  ' ELSE text END AS text FROM words"
CTE["rlines"] = "SELECT sample_id, sample_id::VARCHAR AS key, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n, x, y, w, h, text FROM receipts WHERE pos % 9 <> 0 AND pos % 13 <> 0"
O["line_rows_to_lines"] = sql("rlines", "SELECT key, i::INT AS i, x, y, w, h, text FROM rlines")
O["entity_to_line"] = sql("rlines", """
WITH v AS (SELECT key, max(substr(text, 1, 3)) FILTER (i = sample_id * 7 % n) AS company, max(text) FILTER (i = sample_id * 11 % n) AS address FROM rlines GROUP BY key)
SELECT r.key, arg_min(x, i) AS x, arg_min(y, i) AS y, arg_min(w, i) AS w, arg_min(h, i) AS h, company AS text, 'name' AS type FROM rlines r JOIN v ON r.key = v.key AND contains(r.text, company) GROUP BY r.key, company
UNION ALL SELECT r.key, arg_min(x, i), arg_min(y, i), arg_min(w, i), arg_min(h, i), address, 'address' FROM rlines r JOIN v ON r.key = v.key AND contains(r.text, address) GROUP BY r.key, address""")
O["nested_form_words"] = sql("words", "SELECT sample_id::VARCHAR AS stem, (row_number() OVER (PARTITION BY sample_id ORDER BY row, pos) - 1)::INT AS i, x, y, w, h, text FROM words WHERE pos % 5 <> 0")
O["field_boxes"] = """
WITH f AS (SELECT o_orderkey, i, t, ((o_orderkey + i * 3) % 90)::INT AS x0, (o_custkey % 70)::INT AS y0, ((o_orderkey * 3 + i) % 200)::INT AS x1, ((o_custkey * 5 + i) % 150)::INT AS y1 FROM orders, (VALUES (0, 'dob'), (1, 'account'), (2, 'account'), (3, 'account'), (4, 'signature'), (5, 'name')) v(i, t) WHERE (o_orderkey + i) % 6 <> 0)
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1)::INT AS i, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h, t AS type FROM f WHERE x1 > x0 AND y1 > y0"""
O["labelled_regions"] = """
WITH p AS (SELECT p_partkey AS k, p_name, (p_partkey % 50) + 5e-1 AS a, (p_partkey % 70) + 9e0 AS b, (p_partkey % 40)::DOUBLE AS c, (p_partkey % 90) + 35e-1 AS d, ['face', 'Photo', 'doc', 'surname', 'number', ''][(p_partkey % 6 + 1)::INT] AS f FROM part),
n AS (SELECT *, lower(CASE WHEN f <> '' THEN f WHEN k % 4 = 0 THEN 'given name' ELSE '' END) AS name FROM p)
SELECT k AS p_partkey, CASE WHEN k % 3 <> 0 THEN round_even(least(a, b), 0)::INT ELSE (k % 33)::INT END AS x, CASE WHEN k % 3 <> 0 THEN round_even(least(c, d), 0)::INT ELSE (k % 44)::INT END AS y,
  CASE WHEN k % 3 <> 0 THEN greatest(1, round_even(greatest(a, b), 0)::INT - round_even(least(a, b), 0)::INT) ELSE 12 END AS w, CASE WHEN k % 3 <> 0 THEN greatest(1, round_even(greatest(c, d), 0)::INT - round_even(least(c, d), 0)::INT) ELSE 8 END AS h,
  p_name AS text, CASE WHEN name IN ('face', 'photo', 'portrait') THEN 'face' WHEN name IN ('document', 'doc', 'card') THEN 'frame' WHEN contains(name, 'name') THEN 'name' ELSE 'passport' END AS type FROM n WHERE k % 3 <> 0 OR k % 6 = 0"""
O["char_word_split"] = sql("words", "SELECT sample_id::VARCHAR AS page, CASE WHEN length(text) = 1 THEN 'char' ELSE 'word' END AS kind, text, x, y, greatest(1, w) AS w, greatest(1, h) AS h FROM words")
O["image_by_stem"] = "SELECT 'p' || page_id AS stem, '/data/p' || page_id || CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.tif' ELSE '.PNG' END AS image FROM pages WHERE page_id % 4 <> 2"
O["review_apply"] = sql("srows", """
SELECT sample_id::VARCHAR AS sample_id, source, CASE WHEN sample_id % 6 = 0 AND source = 'user' THEN 2 ELSE n_words END AS n_words, CASE WHEN sample_id % 6 = 0 AND source = 'user' THEN 'new w' || sample_id ELSE text END AS text FROM srows""")
O["review_unmatched"] = sql("samples", "SELECT 'x' || sample_id AS sample_id FROM samples WHERE source = 'user'")
O["benchmark_union"] = sql("samples", "SELECT CASE source WHEN 'user' THEN 'sroie' WHEN 'assistant' THEN 'funsd' ELSE 'cheque' END AS source, count(*) AS n, 160 AS synth FROM samples WHERE source IN ('user', 'assistant', 'system') GROUP BY ALL")
O["validate_samples"] = sql("srows", "SELECT source, count(*) AS n, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok) AS passed FROM (SELECT source, (n_words > 0 AND dpi % 7 <> 0) OR n_chars > 0 AS ok FROM srows) GROUP BY source")
O["json_round_trip"] = sql("srows", "SELECT sample_id::VARCHAR AS sample_id, source, dpi, n_words, n_chars < 0 AS no_chars, n_chars, template FROM srows")

CTE["pixels"] = "SELECT image, (i // 8)::INT AS y, (i % 8)::INT AS x, least(255, greatest(0, floor(128 + 200 * embedding[i + 1]::DOUBLE)))::INT AS v FROM (SELECT vec_id AS image, embedding, unnest(range(len(embedding))) AS i FROM embeddings)"
CTE["hist"] = "SELECT image, v, sum(count(*)) OVER (PARTITION BY image ORDER BY v) AS w, sum(sum(v)) OVER (PARTITION BY image ORDER BY v) AS s, sum(count(*)) OVER (PARTITION BY image) AS n, sum(sum(v)) OVER (PARTITION BY image) AS t FROM pixels GROUP BY image, v"
CTE["otsu"] = "SELECT image, v AS threshold, w::DOUBLE / n AS dark_fraction FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY CASE WHEN w < n THEN (s * n - w * t)::DOUBLE * (s * n - w * t)::DOUBLE / (w * (n - w))::DOUBLE ELSE -1e0 END DESC, v) AS k FROM hist) WHERE k = 1"
CTE["inked"] = "SELECT image, y, x, CASE WHEN v <= threshold THEN 255 ELSE 0 END AS v FROM pixels JOIN otsu USING (image)"
O["otsu_threshold"] = sql("otsu", "SELECT * FROM otsu")
O["polarity"] = sql("otsu", "SELECT image, threshold, dark_fraction > 5e-1 AS inverted FROM otsu")
O["otsu_binarize"] = sql("inked", "SELECT * FROM inked")
O["inverted_pixels"] = sql("pixels otsu", "SELECT image, y, x, CASE WHEN dark_fraction > 5e-1 THEN 255 - v ELSE v END AS v FROM pixels JOIN otsu USING (image)")
_CCL = """WITH RECURSIVE {ctes}, ink AS (SELECT image, y, x, y * 8 + x AS p FROM inked WHERE v = 255),
reach AS (SELECT image, p, y, x, p AS root FROM ink UNION SELECT i.image, i.p, i.y, i.x, r.root FROM reach r JOIN ink i ON i.image = r.image AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1 {side}),
lab AS (SELECT image, y, x, min(root) AS label FROM reach GROUP BY image, p, y, x)
SELECT image, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS pixel_area FROM lab GROUP BY image, label"""
_BINARY = ", ".join(f"{n} AS ({CTE[n]})" for n in ("pixels", "hist", "otsu", "inked"))
O["connected_components"] = _CCL.format(ctes=_BINARY, side="")
O["connected_components_4"] = _CCL.format(ctes=_BINARY, side="AND abs(i.y - r.y) + abs(i.x - r.x) <= 1")
O["looks_like_text"] = "WITH c AS (" + O["connected_components"] + "), b AS (" + sql("inked", "SELECT image, count(*) FILTER (v = 255) AS ink FROM inked GROUP BY image") + """)
SELECT b.image, ink <= 32 AND coalesce(good, 0) >= 3 AS text FROM b LEFT JOIN (SELECT image, count(*) FILTER (pixel_area >= 4 AND h >= 3 AND h <= 64e-1) AS good FROM c GROUP BY image) g ON b.image = g.image"""
O["inverted_candidates"] = sql("boxes", "SELECT page::BIGINT AS page, rank, id, pixel_area::BIGINT AS pixel_area FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pixel_area DESC, id DESC) AS rank FROM boxes WHERE pixel_area >= 2000 AND fill_ratio >= 55e-2) WHERE rank <= 8")
O["sauvola_binarize"] = sql("pixels", """
WITH s AS (SELECT p.image, p.y, p.x, p.v, sum(q.v) AS s, sum(q.v * q.v) AS ss FROM pixels p, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), pixels q WHERE q.image = p.image AND q.y = least(7, greatest(0, p.y + dy)) AND q.x = least(7, greatest(0, p.x + dx)) GROUP BY ALL)
SELECT image, y, x, CASE WHEN v < (s / 9e0) * (1 + 2e-1 * (sqrt(greatest(ss / 9e0 - (s / 9e0) * (s / 9e0), 0e0)) / 128 - 1)) THEN 255 ELSE 0 END AS v FROM s""")
O["median_denoise"] = sql("pixels", """
SELECT p.image, p.y, p.x, quantile_cont(q.v, 0.5)::INT AS v FROM pixels p, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), pixels q WHERE q.image = p.image AND q.y = least(7, greatest(0, p.y + dy)) AND q.x = least(7, greatest(0, p.x + dx)) GROUP BY p.image, p.y, p.x""")

O["nric_checksum"] = """
WITH d AS (SELECT o_orderkey, substr('STFG', (o_orderkey % 4 + 1)::INT, 1) AS p, lpad(((o_orderkey * 7919 + 13) % 10000000)::VARCHAR, 7, '0') AS n FROM orders),
c AS (SELECT *, (2 * n[1]::INT + 7 * n[2]::INT + 6 * n[3]::INT + 5 * n[4]::INT + 4 * n[5]::INT + 3 * n[6]::INT + 2 * n[7]::INT + CASE WHEN p IN ('T', 'G') THEN 4 ELSE 0 END) % 11 + 1 AS i FROM d),
l AS (SELECT *, CASE WHEN p IN ('S', 'T') THEN substr('JZIHGFEDCBA', i, 1) ELSE substr('XWUTRQPNMLK', i, 1) END AS letter FROM c)
SELECT o_orderkey, p || n || letter AS nric, true AS valid, letter = 'Y' AS y_valid FROM l"""
_UNITS = "['ZERO','ONE','TWO','THREE','FOUR','FIVE','SIX','SEVEN','EIGHT','NINE','TEN','ELEVEN','TWELVE','THIRTEEN','FOURTEEN','FIFTEEN','SIXTEEN','SEVENTEEN','EIGHTEEN','NINETEEN']"
_TENS = "['','','TWENTY','THIRTY','FORTY','FIFTY','SIXTY','SEVENTY','EIGHTY','NINETY']"
O["amount_in_words"] = f"""
WITH u AS (SELECT n, CASE WHEN n < 20 THEN {_UNITS}[n + 1] WHEN n % 10 = 0 THEN {_TENS}[n // 10 + 1] ELSE {_TENS}[n // 10 + 1] || ' ' || {_UNITS}[n % 10 + 1] END AS t FROM range(100) r(n)),
t AS (SELECT h * 100 + n AS n, CASE WHEN h = 0 THEN t WHEN n = 0 THEN {_UNITS}[h + 1] || ' HUNDRED' ELSE {_UNITS}[h + 1] || ' HUNDRED AND ' || t END AS t FROM u, range(10) g(h)),
c AS (SELECT o_orderkey, round_even(o_totalprice * 100, 0)::BIGINT AS c FROM orders)
SELECT o_orderkey, concat_ws(' ', CASE WHEN c // 100000 > 0 THEN a.t || ' THOUSAND' END, CASE WHEN c // 100 % 1000 > 0 OR c // 100000 = 0 THEN b.t END) || ' DOLLARS' || CASE WHEN c % 100 > 0 THEN ' AND ' || d.t || ' CENTS' ELSE '' END || ' ONLY' AS words
FROM c JOIN t a ON a.n = c // 100000 JOIN t b ON b.n = c // 100 % 1000 JOIN t d ON d.n = c % 100"""
O["money_format"] = "SELECT o_orderkey, format('{:,}', c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS money FROM (SELECT o_orderkey, round_even(o_totalprice * 100, 0)::BIGINT AS c FROM orders)"
O["mrz_lines"] = r"""
WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s, c_name AS g, strftime(DATE '1950-01-01' + (c_custkey * 37 % 20000)::INT, '%y%m%d') AS b, strftime(DATE '2031-01-01' + (c_custkey % 300)::INT, '%y%m%d') AS e, lpad((c_custkey * 31 % 100000)::VARCHAR, 5, '0') AS d FROM customer)
SELECT k AS c_custkey, 'P<SGP' || rpad(regexp_replace(upper(s || '<<' || g), '[^A-Z0-9]', '<', 'g'), 39, '<') AS line1, rpad('K' || k, 9, '<') || d[1] || 'SGP' || b || d[2] || substr('MF', (k % 2 + 1)::INT, 1) || e || d[3] || repeat('<', 14) || d[4] || d[5] AS line2 FROM c"""
O["account_numbers"] = "SELECT c_custkey, format('{:03d}-{:06d}-{}', 100 + c_custkey % 899, 100000 + c_custkey * 7 % 899999, c_custkey % 9) AS account FROM customer"
O["word_tokens"] = sql("samples", """
WITH p AS (SELECT sample_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM samples)
SELECT sample_id, start::INT AS start, word FROM (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY sample_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p) WHERE word <> ''""")
O["char_boxes"] = sql("chars", "SELECT * FROM chars")
O["line_boxes"] = sql("lines", "SELECT * FROM lines")
O["word_boxes"] = sql("words", "SELECT sample_id, pos, text, x, y, w, h FROM words")
O["text_joins"] = sql("rlines", "SELECT w.sample_id::VARCHAR AS key, coalesce(string_agg(r.text, chr(10) ORDER BY i), '') AS text FROM (SELECT DISTINCT sample_id FROM words) w LEFT JOIN rlines r USING (sample_id) GROUP BY w.sample_id")
O["homography_boxes"] = sql("boxes", """
WITH c AS (SELECT page, id, x + a.dx * w AS px, y + a.dy * h AS py FROM boxes, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) a(dx, dy)),
m AS (SELECT page, id, (9e-1 * px + 1e-1 * py + -2e1) / z AS qx, (-5e-2 * px + 11e-1 * py + 15e0) / z AS qy FROM (SELECT *, 1e-4 * px + 5e-5 * py + 1e0 AS z FROM c)),
b AS (SELECT page, id, min(qx) AS x0, max(qx) AS x1, min(qy) AS y0, max(qy) AS y1 FROM m GROUP BY ALL),
k AS (SELECT *, greatest(0e0, x0) AS cx0, greatest(0e0, y0) AS cy0, least(9e2, x1) AS cx1, least(8e2, y1) AS cy1 FROM b)
SELECT page, id, round_even(cx0, 0)::INT AS x, round_even(cy0, 0)::INT AS y, round_even(cx1 - cx0, 0)::INT AS w, round_even(cy1 - cy0, 0)::INT AS h FROM k
WHERE cx1 - cx0 >= 1 AND cy1 - cy0 >= 1 AND (cx1 - cx0) * (cy1 - cy0) >= 4e-1 * greatest(1e0, (x1 - x0) * (y1 - y0))""")
O["stratum_sequence"] = sql("samples", "SELECT i, template, format('synth_{}_{:04d}', template, n) AS sample_id FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY i) - 1 AS n FROM (SELECT sample_id AS i, CASE WHEN template = '' THEN 'plain' ELSE template END AS template FROM samples))")
O["script_sets"] = sql("samples", "SELECT DISTINCT script, CASE WHEN script IN ('thai', 'arabic') THEN 'blocked' ELSE 'available' END AS status FROM samples")
O["windowed_latency"] = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY ALL"

O["synth_plan"] = """
SELECT * FROM (VALUES
  (0, 'synth_id_card_0000', 'id_card', 'scan', 'scan', 300009), (1, 'synth_cheque_0000', 'cheque', 'scan', 'scan', 300010), (2, 'synth_form_0000', 'form', 'scan', 'scan', 300011),
  (3, 'synth_id_card_0001', 'id_card', 'hard_photo', 'photo', 300012), (4, 'synth_cheque_0001', 'cheque', 'photo', 'photo', 300013), (5, 'synth_plain_arabic_0000', 'plain_arabic', 'scan', 'scan', 300014),
  (6, 'synth_plain_han_0000', 'plain_han', 'scan', 'scan', 300015), (7, 'synth_form_0001', 'form', 'scan', 'scan', 300016), (8, 'synth_form_0002', 'form', 'photo', 'photo', 300017),
  (9, 'synth_receipt_0000', 'receipt', 'scan', 'scan', 300018), (10, 'synth_form_0003', 'form', 'scan', 'scan', 300019), (11, 'synth_plain_latin_0000', 'plain_latin', 'clean_scan', 'scan', 300020),
  (12, 'synth_cheque_0002', 'cheque', 'photo', 'photo', 300021), (13, 'synth_plain_han_0001', 'plain_han', 'scan', 'scan', 300022), (14, 'synth_form_0004', 'form', 'photo', 'photo', 300023),
  (15, 'synth_form_0005', 'form', 'photo', 'photo', 300024), (16, 'synth_cheque_0003', 'cheque', 'hard_photo', 'photo', 300025), (17, 'synth_receipt_0001', 'receipt', 'hard_photo', 'photo', 300026),
  (18, 'synth_plain_devanagari_0000', 'plain_devanagari', 'scan', 'scan', 300027), (19, 'synth_id_card_0002', 'id_card', 'photo', 'photo', 300028), (20, 'synth_plain_arabic_0001', 'plain_arabic', 'scan', 'scan', 300029),
  (21, 'synth_form_0006', 'form', 'scan', 'scan', 300030), (22, 'synth_receipt_0002', 'receipt', 'photo', 'photo', 300031), (23, 'synth_cheque_0004', 'cheque', 'scan', 'scan', 300032),
  (24, 'synth_form_0007', 'form', 'photo', 'photo', 300033), (25, 'synth_form_0008', 'form', 'photo', 'photo', 300034), (26, 'synth_plain_han_0002', 'plain_han', 'photo', 'photo', 300035),
  (27, 'synth_form_0009', 'form', 'scan', 'scan', 300036), (28, 'synth_plain_han_0003', 'plain_han', 'photo', 'photo', 300037), (29, 'synth_plain_devanagari_0001', 'plain_devanagari', 'scan', 'scan', 300038)) t(i, sample_id, template, profile, capture, seed)"""
O["capture_profiles"] = """
SELECT * FROM (VALUES
  ('digital', 'digital', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0, 1.0::DOUBLE, 1.0::DOUBLE, 0e0),
  ('clean_scan', 'scan', 0.6::DOUBLE, 0.0::DOUBLE, 0.4::DOUBLE, 2.0::DOUBLE, 0.0::DOUBLE, 92, 0.9::DOUBLE, 1.0::DOUBLE, 0e0),
  ('scan', 'scan', 1.8::DOUBLE, 0.0::DOUBLE, 0.8::DOUBLE, 4.0::DOUBLE, 0.12::DOUBLE, 80, 0.55::DOUBLE, 0.9::DOUBLE, 0e0),
  ('photo', 'photo', 2.5::DOUBLE, 0.025::DOUBLE, 1.1::DOUBLE, 6.0::DOUBLE, 0.38::DOUBLE, 72, 0.5::DOUBLE, 0.85::DOUBLE, 0e0),
  ('hard_photo', 'photo', 5.0::DOUBLE, 0.055::DOUBLE, 2.0::DOUBLE, 10.0::DOUBLE, 0.55::DOUBLE, 48, 0.3::DOUBLE, 0.55::DOUBLE, 0.1::DOUBLE)) t(profile, capture, rotation, perspective, blur, noise, illumination, quality, scale_low, scale_high, moire)"""
O["strata_available"] = """
SELECT * FROM (VALUES
  ('id_card', 0.24::DOUBLE, 'photo', 0.5::DOUBLE),
  ('id_card', 0.24::DOUBLE, 'scan', 0.25::DOUBLE),
  ('id_card', 0.24::DOUBLE, 'hard_photo', 0.15::DOUBLE),
  ('id_card', 0.24::DOUBLE, 'clean_scan', 0.1::DOUBLE),
  ('cheque', 0.18::DOUBLE, 'photo', 0.4::DOUBLE),
  ('cheque', 0.18::DOUBLE, 'scan', 0.35::DOUBLE),
  ('cheque', 0.18::DOUBLE, 'hard_photo', 0.15::DOUBLE),
  ('cheque', 0.18::DOUBLE, 'clean_scan', 0.1::DOUBLE),
  ('receipt', 0.16::DOUBLE, 'photo', 0.45::DOUBLE),
  ('receipt', 0.16::DOUBLE, 'scan', 0.35::DOUBLE),
  ('receipt', 0.16::DOUBLE, 'hard_photo', 0.2::DOUBLE),
  ('form', 0.14::DOUBLE, 'scan', 0.55::DOUBLE),
  ('form', 0.14::DOUBLE, 'clean_scan', 0.2::DOUBLE),
  ('form', 0.14::DOUBLE, 'photo', 0.25::DOUBLE),
  ('plain_latin', 0.1::DOUBLE, 'scan', 0.5::DOUBLE),
  ('plain_latin', 0.1::DOUBLE, 'clean_scan', 0.3::DOUBLE),
  ('plain_latin', 0.1::DOUBLE, 'photo', 0.2::DOUBLE),
  ('plain_han', 0.05::DOUBLE, 'scan', 0.6::DOUBLE),
  ('plain_han', 0.05::DOUBLE, 'photo', 0.4::DOUBLE),
  ('plain_devanagari', 0.05::DOUBLE, 'scan', 0.6::DOUBLE),
  ('plain_devanagari', 0.05::DOUBLE, 'photo', 0.4::DOUBLE)) t(template, weight, profile, share)"""
O["cell_size"] = sql("boxes", "SELECT page, greatest(8, floor(quantile_cont(greatest(w, h), 0.5)))::INT AS cell FROM boxes GROUP BY page")
O["overlay_kinds"] = sql("comps", "SELECT sample_id, id, kind FROM comps WHERE kind IN ('diacritic', 'rule')")
O["overlay_sample"] = sql("samples", "SELECT sample_id FROM samples ORDER BY md5(sample_id::VARCHAR || ':7'), sample_id LIMIT 25")
O["review_todo"] = sql("samples", "SELECT sample_id FROM samples WHERE source = 'user' AND has_image AND sample_id % 3 <> 0 ORDER BY sample_id LIMIT 40")
O["review_todo_all"] = sql("samples", "SELECT sample_id FROM samples WHERE source = 'assistant' AND has_image AND sample_id % 3 <> 0")
O["path_capture"] = """
SELECT page_id, 'p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.v1' ELSE '' END AS stem, CASE page_id % 3 WHEN 0 THEN 'Photos' WHEN 1 THEN 'scans' ELSE 'my.photo_set' END AS parent, CASE page_id % 3 WHEN 1 THEN 'scan' ELSE 'photo' END AS capture FROM pages"""
O["percent_format"] = "SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'n/a' ELSE format('{:.1f}%', 100 * ((o_orderkey % 997) / 997e0)) END AS text FROM orders"
O["generation_tallies"] = sql("samples", """
WITH s AS (SELECT *, sample_id % 3 = 0 AS c FROM samples), t AS (
  SELECT 'all' AS tally, 'all' AS value, c FROM s UNION ALL SELECT 'template', template, c FROM s UNION ALL SELECT 'capture', capture, c FROM s UNION ALL SELECT 'source', source, c FROM s)
SELECT tally, value, count(*) AS n, count(*) FILTER (c) AS with_chars FROM t GROUP BY ALL""")
O["person_names"] = """
SELECT c_custkey, ['ALDER', 'BROOK', 'CLAY', 'DUNE', 'ELM', 'FERN', 'GLEN', 'HEATH', 'IVES', 'LARK', 'MOSS', 'NASH'][c_custkey % 12 + 1] || ' ' || ['ANNA', 'BEN', 'CARA', 'DAVID', 'EVA', 'FINN', 'GRETA', 'HUGO', 'INES', 'JONAS'][(c_custkey // 12) % 10 + 1] AS name,
  'BLK ' || (1 + c_custkey * 3 % 899) || ' ' || ['NORTH ROAD', 'HARBOUR STREET', 'MILL LANE', 'STATION AVENUE', 'GARDEN WALK', 'HILL RISE 3'][c_custkey % 6 + 1] || '; #' || lpad((1 + c_custkey % 24)::VARCHAR, 2, '0') || '-' || lpad((1 + c_custkey * 7 % 399)::VARCHAR, 3, '0') || '; SINGAPORE ' || (100000 + c_custkey * 7919 % 729999) AS address
FROM customer"""
O["field_dates"] = """
SELECT c_custkey, strftime(DATE '1950-01-01' + (c_custkey * 37 % 20075)::INT, '%d %b %Y') AS born, strftime(DATE '2026-01-01' + (c_custkey * 13 % 300)::INT, '%d/%m/%Y') AS issued, strftime(DATE '2026-01-01' + (c_custkey * 13 % 300)::INT, '%Y-%m-%d') AS iso FROM customer"""
O["page_layout"] = sql("samples", """
WITH l AS (SELECT sample_id, k - 1 AS line, parts[k] AS t FROM (SELECT sample_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM samples)),
c AS (SELECT sample_id, line, i AS pos, substr(t, i::INT + 1, 1) AS ch FROM (SELECT sample_id, line, t, unnest(range(length(t))) AS i FROM l))
SELECT sample_id, line::INT AS line, pos::INT AS pos, (20 + 14 * pos)::INT AS x, (20 + 30 * line)::INT AS y, 10 AS w, 20 AS h FROM c WHERE ch <> ' '""")
O["zipped_boxes"] = sql("words nontext", """
WITH b AS (SELECT sample_id, 'word' AS what, pos, text, x, y, w, h FROM words UNION ALL SELECT sample_id, 'nontext', pos, '', x, y, w, h FROM nontext),
m AS (SELECT *, x * 5e-1 + 30 AS x0, (x + w) * 5e-1 + 30 AS x1, y * 5e-1 - 20 AS y0, (y + h) * 5e-1 - 20 AS y1 FROM b),
k AS (SELECT *, greatest(x0, 0e0) AS a0, least(x1, 400e0) AS a1, greatest(y0, 0e0) AS b0, least(y1, 300e0) AS b1 FROM m)
SELECT sample_id, what, pos, text, round_even(a0, 0)::INT AS x, round_even(b0, 0)::INT AS y, round_even(a1 - a0, 0)::INT AS w, round_even(b1 - b0, 0)::INT AS h FROM k
WHERE a1 - a0 >= 1 AND b1 - b0 >= 1 AND (a1 - a0) * (b1 - b0) >= 4e-1 * greatest(1e0, (x1 - x0) * (y1 - y0))""")
_GRAY = "least(255, greatest(0, floor(128 + 200 * embedding[{i}]::DOUBLE)))"
O["grayscale"] = f"""
SELECT vec_id AS image, (k // 4)::INT AS y, (k % 4)::INT AS x, round_even(114e-3 * {_GRAY.format(i="3 * k + 1")} + 587e-3 * {_GRAY.format(i="3 * k + 2")} + 299e-3 * {_GRAY.format(i="3 * k + 3")}, 0)::INT AS v FROM embeddings, range(16) t(k)"""
O["resize_half"] = sql("pixels", "SELECT image, y // 2 AS y, x // 2 AS x, round_even(sum(v) / 4e0, 0)::INT AS v FROM pixels GROUP BY ALL")
O["adaptive_gaussian"] = sql("pixels", """
WITH g AS (SELECT i, exp(-((i - 17) * (i - 17)) / (2 * 56e-1 * 56e-1)) AS e FROM range(35) t(i)), n AS (SELECT i, e / sum(e) OVER () AS w FROM g),
m AS (SELECT t, least(7, greatest(0, t + i - 17)) AS s, sum(w) AS w FROM n, range(8) r(t) GROUP BY ALL),
down AS (SELECT image, t AS y, x, sum(w * v) AS f FROM pixels JOIN m ON y = s GROUP BY image, t, x),
mean AS (SELECT image, y, t AS x, round_even(sum(w * f), 0) AS mean FROM down JOIN m ON x = s GROUP BY image, y, t)
SELECT image, y, x, CASE WHEN v <= mean - 10 THEN 255 ELSE 0 END AS v FROM pixels JOIN mean USING (image, y, x)""")
O["illumination_normalise"] = sql("pixels", """
WITH d AS (SELECT p.image, p.y, p.x, p.v, max(q.v) AS m FROM pixels p JOIN pixels q ON q.image = p.image AND abs(q.y - p.y) + abs(q.x - p.x) <= 1 GROUP BY ALL),
e AS (SELECT p.image, p.y, p.x, p.v, greatest(1, min(q.m)) AS bg FROM d p JOIN d q ON q.image = p.image AND abs(q.y - p.y) + abs(q.x - p.x) <= 1 GROUP BY p.image, p.y, p.x, p.v)
SELECT image, y, x, least(255, round_even(v * 255e0 / bg, 0))::INT AS v FROM e""")
O["fill_holes"] = "WITH RECURSIVE " + sql("inked", "SELECT 1").removeprefix("WITH ").removesuffix("\nSELECT 1") + """,
out AS (SELECT image, y, x FROM inked WHERE v = 0 AND (y IN (0, 7) OR x IN (0, 7))
  UNION SELECT i.image, i.y, i.x FROM out o JOIN inked i ON i.image = o.image AND i.v = 0 AND abs(i.y - o.y) + abs(i.x - o.x) = 1)
SELECT i.image, i.y, i.x, CASE WHEN o.image IS NULL THEN 255 ELSE 0 END AS v FROM inked i LEFT JOIN out o ON i.image = o.image AND i.y = o.y AND i.x = o.x"""
O["label_map"] = "WITH RECURSIVE " + sql("inked", "SELECT 1").removeprefix("WITH ").removesuffix("\nSELECT 1") + """,
ink AS (SELECT image, y, x, y * 8 + x AS p FROM inked WHERE v = 255),
reach AS (SELECT image, p, y, x, p AS root FROM ink UNION SELECT i.image, i.p, i.y, i.x, r.root FROM reach r JOIN ink i ON i.image = r.image AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1),
lab AS (SELECT image, y, x, dense_rank() OVER (PARTITION BY image ORDER BY root) AS label FROM (SELECT image, y, x, min(root) AS root FROM reach GROUP BY image, p, y, x))
SELECT i.image, i.y, i.x, coalesce(l.label, 0)::INT AS v FROM inked i LEFT JOIN lab l ON i.image = l.image AND i.y = l.y AND i.x = l.x"""
O["constant_pages"] = """
SELECT p_partkey::VARCHAR AS sample_id, (5 + 8 * k)::INT AS x, 20 AS y, 3 AS w, (4 + p_partkey % 5)::INT AS h, (3 * (4 + p_partkey % 5))::INT AS pixel_area, 'text' AS kind, '' AS reason FROM part, range(13) t(k)"""
