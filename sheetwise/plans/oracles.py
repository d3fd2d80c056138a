"""SQL of the queries of ``queries``, for an engine that knows neither Spark nor this package."""

from __future__ import annotations

# The fixed values that both sides need are written down once.
from ..operators.report import CATEGORY_WEIGHTS, DIMENSIONS, REVISION_WORDS, SYMBOLS, TABLE_WORDS, TITLE_WORDS

NORM_STEPS = [
    r"trim(regexp_replace({x}, '\s+', ' ', 'g'))",
    r"regexp_replace({x}, '(\d),(\d)', '\1.\2', 'g')",
    r"regexp_replace({x}, '(\d),(\d)', '\1.\2', 'g')",
    r"regexp_replace({x}, '(\d+\.\d*?)0+\b', '\1', 'g')",
    r"regexp_replace({x}, '(\d+)\.(\D|$)', '\1\2', 'g')",
    *(f"replace({{x}}, '{a}', '{b}')" for a, b in (("deg", "DEG"), ("½", "1/2"), ("¼", "1/4"), ("¾", "3/4"), ("Ø", "DIA"), ("⌀", "DIA"), ("φ", "DIA"), ("ф", "DIA"), ("°", "DEG"), ("±", "+/-"))),
]


def norm(x: str) -> str:
    for step in NORM_STEPS:
        x = step.replace("{x}", x)
    return x


def edit(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 0.0 ELSE levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b}), 1) AS DOUBLE) END)"


def dist(x: str, y: str, u: str, v: str) -> str:
    return f"sqrt(({x} - {u}) * ({x} - {u}) + ({y} - {v}) * ({y} - {v}))"


def overlap(a: list[str], b: list[str]) -> str:
    dx, dy = f"(least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]}))", f"(least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}))"
    area = f"least(({a[2]} - {a[0]}) * ({a[3]} - {a[1]}), ({b[2]} - {b[0]}) * ({b[3]} - {b[1]}))"
    return f"(CASE WHEN {dx} > 0 AND {dy} > 0 AND {area} > 0 THEN {dx} * {dy} / {area} ELSE 0.0 END)"


def box(p: str = "") -> list[str]:
    return [f"{p}{c}" for c in ("x0", "y0", "x1", "y1")]


LABELS = """
    SELECT page, -1 AS block, CAST(r_regionkey AS INTEGER) AS line, CAST(r_regionkey + 1 AS VARCHAR) AS text, CAST(80 + 140 * r_regionkey AS DOUBLE) AS x0, CAST(10 AS DOUBLE) AS y0 FROM pages_, region
    UNION ALL SELECT page, -2, CAST(r_regionkey AS INTEGER), chr(CAST(65 + r_regionkey AS INTEGER)), CAST(10 AS DOUBLE), CAST(70 + 100 * r_regionkey AS DOUBLE) FROM pages_, region"""


def _numbered(raw: str) -> str:
    return f"""SELECT CASE WHEN page % 3 = 0 THEN 'B' ELSE 'A' END AS pair_id, page, block, line, text, x0, y0, x0 + 6 * length(text) AS x1, y0 + 10 AS y1, {norm('text')} AS norm, CASE WHEN line % 6 = 5 THEN 0.0 ELSE 1.0 END AS dir_x, CASE WHEN line % 6 = 5 THEN 1.0 ELSE 0.0 END AS dir_y,
        x0 + 3.0 * length(text) AS cx, y0 + 5.0 AS cy, CAST(row_number() OVER (PARTITION BY page ORDER BY block, line) - 1 AS INTEGER) AS run_idx FROM ({raw})"""


RUNS = f"""
WITH RECURSIVE items AS MATERIALIZED (
    SELECT ok, ln, CASE ln % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN 'DIA ' || qty || '.50' WHEN 2 THEN qty || '.00 +/- 0.' || ln ELSE 'NOTE ' || ok || ' ' || p_type END AS text,
        CAST(60 + (37 * pk + 101 * ln) % 640 AS DOUBLE) AS x, CAST(60 + (53 * sk + 67 * ln + 29 * ok) % 460 AS DOUBLE) AS y, CAST(ok // 10 + 1 AS INTEGER) AS page, (7 * ok + 11 * ln) % 23 AS v
    FROM (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk, CAST(floor(min(l_quantity)) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = pk),
pages_ AS MATERIALIZED (SELECT DISTINCT page FROM items),
ref AS MATERIALIZED ({_numbered(f"SELECT page, ok AS block, CAST(ln AS INTEGER) AS line, text, x AS x0, y AS y0 FROM items UNION ALL {LABELS}")}),
moved AS (SELECT *, x + 6 + CASE WHEN y > 300 THEN 20 ELSE 0 END AS cx0, y + 4 - CASE WHEN y > 300 THEN 15 ELSE 0 END AS cy0 FROM items),
cand AS MATERIALIZED ({_numbered(f'''SELECT page, ok AS block, CAST(ln AS INTEGER) AS line,
        CASE v WHEN 1 THEN '#' || substring(text, 2) WHEN 2 THEN replace(replace(text, 'DIA ', 'Ø'), '+/-', '±') WHEN 3 THEN replace(text, '.50', '.5') WHEN 5 THEN split_part(text, ' ', 1) ELSE text END AS text, cx0 AS x0, cy0 AS y0 FROM moved WHERE v <> 0
    UNION ALL SELECT page, ok + 1000000, CAST(ln AS INTEGER), 'EXTRA ' || ok, cx0 + 3, cy0 + 3 FROM moved WHERE v = 4
    UNION ALL SELECT page, ok + 2000000, CAST(ln AS INTEGER), substring(text, instr(text, ' ') + 1), cx0 + 6 * instr(text, ' '), cy0 FROM moved WHERE v = 5 UNION ALL {LABELS}''')})"""

ANCHORS = """
anchors AS (
    SELECT CASE WHEN a.page % 3 = 0 THEN 'B' ELSE 'A' END AS pair_id, a.page, a.norm, a.ref_idx, a.ax, a.ay, b.bx, b.b_y AS "by"
    FROM (SELECT page, norm, min(run_idx) AS ref_idx, min(cx) AS ax, min(cy) AS ay FROM ref WHERE norm <> '' GROUP BY page, norm HAVING count(*) = 1) a
    JOIN (SELECT page, norm, min(cx) AS bx, min(cy) AS b_y FROM cand WHERE norm <> '' GROUP BY page, norm HAVING count(*) = 1) b USING (page, norm))"""

FIT = """
means AS (SELECT page, avg(ax) AS ma, avg(ay) AS mb, avg(bx) AS mc, avg("by") AS md, count(*) AS n_anchors FROM anchors GROUP BY page),
sums AS (
    SELECT page, ma, mb, mc, md, n_anchors, sum((ax - ma) * (ax - ma)) AS uu, sum((ax - ma) * (ay - mb)) AS uv, sum((ay - mb) * (ay - mb)) AS vv,
        sum((ax - ma) * (bx - mc)) AS up, sum((ay - mb) * (bx - mc)) AS vp, sum((ax - ma) * ("by" - md)) AS uq, sum((ay - mb) * ("by" - md)) AS vq
    FROM anchors JOIN means USING (page) GROUP BY page, ma, mb, mc, md, n_anchors),
linear AS (
    SELECT *, CASE WHEN abs(uu * vv - uv * uv) > 1e-9 THEN uu * vv - uv * uv END AS det FROM sums),
fit AS (
    SELECT page, n_anchors, (up * vv - vp * uv) / det AS m00, (vp * uu - up * uv) / det AS m01, mc - (up * vv - vp * uv) / det * ma - (vp * uu - up * uv) / det * mb AS m02,
        (uq * vv - vq * uv) / det AS m10, (vq * uu - uq * uv) / det AS m11, md - (uq * vv - vq * uv) / det * ma - (vq * uu - uq * uv) / det * mb AS m12 FROM linear)"""

GRID = """
seen AS (
    SELECT page, CASE WHEN regexp_matches(text, '^\\d{1,3}$') THEN 'col' ELSE 'row' END AS axis, upper(text) AS label, CASE WHEN regexp_matches(text, '^\\d{1,3}$') THEN cx ELSE cy END AS place, run_idx
    FROM cand WHERE (regexp_matches(text, '^\\d{1,3}$') AND (cy < 36 OR cy > 564) AND NOT (cx < 48 OR cx > 752)) OR (regexp_matches(text, '^[A-Za-z]$') AND (cx < 48 OR cx > 752) AND NOT (cy < 36 OR cy > 564))),
labels_ AS (SELECT page, axis, label, median(place) AS place, min(run_idx) AS first FROM seen GROUP BY page, axis, label),
cells_ AS (
    SELECT page, axis, label, CASE axis WHEN 'col' THEN 48 ELSE 36 END + (row_number() OVER (PARTITION BY page, axis ORDER BY place, first) - 0.5) * (CASE axis WHEN 'col' THEN 704.0 ELSE 528.0 END / count(*) OVER (PARTITION BY page, axis)) AS center FROM labels_),
grid AS (SELECT page, count(*) FILTER (WHERE axis = 'col') >= 2 AND count(*) FILTER (WHERE axis = 'row') >= 2 AS valid FROM cells_ GROUP BY page)"""


def zone(x: str, y: str, page: str) -> str:
    near = lambda axis, v: f"(SELECT label FROM cells_ c WHERE c.page = {page} AND c.axis = '{axis}' ORDER BY abs(c.center - {v}), c.center LIMIT 1)"
    return f"""CASE WHEN {x} > 800 * (1 - CAST(0.33 AS DOUBLE)) AND {y} > 600 * (1 - CAST(0.33 AS DOUBLE)) THEN 'title-block' WHEN {x} < 48 OR {x} > 752 OR {y} < 36 OR {y} > 564 THEN 'border'
        WHEN (SELECT valid FROM grid g WHERE g.page = {page}) THEN {near('row', y)} || {near('col', x)} END"""


COSTS = f"""
costs AS (
    SELECT page, ref_idx, cand_idx, distance, equal, distance + 40.0 * edit AS cost FROM (
        SELECT a.page, a.run_idx AS ref_idx, b.run_idx AS cand_idx, {dist('a.cx', 'a.cy', 'b.cx', 'b.cy')} AS distance, a.norm = b.norm AS equal, {edit('a.norm', 'b.norm')} AS edit FROM ref a JOIN cand b ON a.page = b.page))"""

EXACT = """
kref AS (SELECT page, norm, run_idx, row_number() OVER (PARTITION BY page, norm ORDER BY run_idx) AS k FROM ref),
kcand AS (SELECT page, norm, run_idx, row_number() OVER (PARTITION BY page, norm ORDER BY run_idx) AS k FROM cand),
exact AS MATERIALIZED (SELECT a.page, a.run_idx AS ref_idx, b.run_idx AS cand_idx FROM kref a JOIN kcand b USING (page, norm, k)),
free_ref AS (SELECT * FROM ref r WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.page = r.page AND e.ref_idx = r.run_idx)),
free_cand AS (SELECT * FROM cand r WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.page = r.page AND e.cand_idx = r.run_idx))"""

OVERLAPS = f"""
collisions AS (
    SELECT page, ratio, texts, x0, y0, x1, y1, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM (
        SELECT a.page, {overlap(box('a.'), box('b.'))} AS ratio, a.text || ' / ' || b.text AS texts, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1,
            least(a.y1 - a.y0, b.y1 - b.y0) AS h, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS dy, greatest(a.x0, b.x0) - least(a.x1, b.x1) AS gap
        FROM cand a JOIN cand b ON a.page = b.page AND a.run_idx < b.run_idx AND a.block <> b.block)
    WHERE ratio > 0.15 AND NOT (h > 0 AND dy / h > 0.8 AND gap < greatest(12.0, h * 1.5)))"""

FINDINGS = f"""
findings AS (
    SELECT page, 'missing_text' AS class, CAST(0.5 AS DOUBLE) AS confidence, {zone('cx', 'cy', 'r.page')} AS zone, text AS ref_text, CAST(NULL AS VARCHAR) AS cand_text, x0, y0, x1, y1, cx, cy FROM free_ref r
    UNION ALL SELECT * FROM (SELECT page, 'added_text', CAST(1 AS DOUBLE), {zone('cx', 'cy', 'r.page')} AS zone, NULL, text, x0, y0, x1, y1, cx, cy FROM free_cand r WHERE length(trim(text)) > 1 AND NOT (cx < 48 OR cx > 752 OR cy < 36 OR cy > 564)) WHERE zone IS DISTINCT FROM 'title-block'
    UNION ALL SELECT page, 'text_overlap', least(CAST(1 AS DOUBLE), CAST(ratio AS DOUBLE) / CAST(0.3 AS DOUBLE)), {zone('cx', 'cy', 'r.page')}, NULL, texts, x0, y0, x1, y1, cx, cy FROM collisions r)"""

TEMPLATES = {
    "missing_text": ("high", "Missing text, zone {z}.", "Compare both pages at zone {z}.", "Text ''{r}'' missing in candidate"),
    "added_text": ("medium", "Added text, zone {z}.", "Compare both pages at zone {z}.", "Extra text ''{c}'' added in candidate"),
    "text_overlap": ("medium", "Text overlap, zone {z}.", "Compare both pages at zone {z}.", "Overlapping candidate text ''{c}''"),
}


def _template(k: int) -> str:
    fill = lambda t: "'" + t.replace("{r}", "' || coalesce(ref_text, '') || '").replace("{c}", "' || coalesce(cand_text, '') || '").replace("{z}", "' || coalesce(zone, '—') || '") + "'"
    return "CASE class " + " ".join(f"WHEN '{c}' THEN {fill(t[k])}" for c, t in TEMPLATES.items()) + " END"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(said, '{w}')" for w in words) + ")"


RECORDS = f"""
records AS (
    SELECT *, {_template(0)} AS severity, {_template(1)} AS cause, {_template(2)} AS fix, {_template(3)} || CASE WHEN zone IS NULL THEN '' ELSE ' (zone ' || zone || ')' END || '.' AS message,
        CASE WHEN confidence >= 0.5 THEN 'defect' ELSE 'review' END AS status FROM findings WHERE zone IS DISTINCT FROM 'border'),
said AS (SELECT *, upper(message || ' ' || coalesce(ref_text, '') || ' ' || coalesce(cand_text, '')) AS said FROM records),
marked AS (SELECT *, regexp_matches(said, '{SYMBOLS}') AS symbols, regexp_matches(said, '{DIMENSIONS}') OR contains(said, 'DIMENSION') OR contains(said, 'TOLERANCE') AS dims FROM said),
categorised AS (
    SELECT *, CASE class
        WHEN 'added_text' THEN CASE WHEN zone = 'title-block' THEN 'Title Block' WHEN symbols OR dims THEN 'Dimensions & Tolerances' ELSE 'Notes & Annotations' END
        WHEN 'text_overlap' THEN 'Visual Quality'
        ELSE CASE WHEN zone = 'title-block' THEN 'Title Block'
            WHEN x0 / 800 > 0.7 AND y1 / 600 < 0.35 AND {_any(REVISION_WORDS)} THEN 'Revision History'
            WHEN x0 / 800 > 0.65 AND y0 / 600 > 0.65 AND {_any(TITLE_WORDS)} THEN 'Title Block'
            WHEN (x0 / 800 > 0.6 OR contains(said, 'BOM') OR contains(said, 'TABLE')) AND {_any(TABLE_WORDS)} THEN 'BOM / Tables'
            WHEN dims THEN 'Dimensions & Tolerances' ELSE 'Notes & Annotations' END END AS category FROM marked),
weights AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {w})" for c, w in CATEGORY_WEIGHTS.items())}) t(category, weight)),
scores AS (
    SELECT page, CAST(greatest(0, 100 - coalesce(sum(weight), 0)) AS BIGINT) AS score FROM pages_ LEFT JOIN (SELECT DISTINCT page, category FROM categorised) USING (page) LEFT JOIN weights USING (category) GROUP BY page)"""

SLICE = ",".join((RUNS, GRID, EXACT, OVERLAPS, FINDINGS, RECORDS))

BLOCKS = """
zref AS (SELECT page, block, min(run_idx) AS cluster, string_agg(norm, ' ' ORDER BY round(y0, 1), round(x0, 1), run_idx) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ref GROUP BY page, block),
zcand AS (SELECT page, block, min(run_idx) AS cluster, string_agg(norm, ' ' ORDER BY round(y0, 1), round(x0, 1), run_idx) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM cand GROUP BY page, block)"""

STACKS = """
stacks AS (
    SELECT a.page, a.run_idx AS i, b.run_idx AS j FROM ref a JOIN ref b ON a.page = b.page AND a.run_idx < b.run_idx AND a.dir_x = b.dir_x
    WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 AND greatest(0.0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) <= 12) OR (least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 AND greatest(0.0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) <= 12))"""

LEADERS = f"""
ends_ AS (
    SELECT CAST(o_orderkey // 10 + 1 AS INTEGER) AS page, o_orderkey AS seg, 0 AS e, CAST(60 + (17 * o_orderkey) % 640 AS DOUBLE) AS x, CAST(60 + (29 * o_orderkey) % 460 AS DOUBLE) AS y FROM orders
    UNION ALL SELECT CAST(o_orderkey // 10 + 1 AS INTEGER), o_orderkey, 1, CAST(60 + (41 * o_orderkey + 31) % 640 AS DOUBLE), CAST(60 + (23 * o_orderkey + 11) % 460 AS DOUBLE) FROM orders),
touch AS (SELECT e.page, seg, e, run_idx FROM ends_ e JOIN ref r ON e.page = r.page WHERE {dist('x', 'y', 'least(greatest(x, x0), x1)', 'least(greatest(y, y0), y1)')} <= 6),
leaders AS (SELECT DISTINCT page, i, j FROM (SELECT page, min(run_idx) OVER (PARTITION BY page, seg, e) AS i, run_idx AS j FROM touch) WHERE i < j)"""


def reach(edges: str) -> str:
    """(page, run_idx, cluster): least member of each run's component."""
    return f"""
links_ AS (SELECT page, i, j FROM ({edges}) UNION SELECT page, j, i FROM ({edges}) UNION SELECT page, run_idx, run_idx FROM ref),
reach_ AS (SELECT page, i AS node, j AS seen FROM links_ UNION SELECT r.page, r.node, l.j FROM reach_ r JOIN links_ l ON r.page = l.page AND r.seen = l.i)
SELECT CASE WHEN page % 3 = 0 THEN 'B' ELSE 'A' END AS pair_id, page, node AS run_idx, min(seen) AS cluster FROM reach_ GROUP BY page, node"""


NEAR = f"near_ AS (SELECT a.page, a.run_idx AS i, b.run_idx AS j FROM ref a JOIN ref b ON a.page = b.page AND a.run_idx < b.run_idx WHERE {dist('a.cx', 'a.cy', 'b.cx', 'b.cy')} <= 50)"

WORDS = """
WITH sides AS (SELECT * FROM (VALUES ('ref', 0), ('cand', 1)) t(side, s)),
body AS (
    SELECT CAST(p_partkey // 20 + 1 AS INTEGER) AS page, side, s, p_partkey % 20 + 1 AS r, c, CASE c WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN CAST(p_size + CASE WHEN s = 1 AND p_partkey % 17 = 0 THEN 1 ELSE 0 END AS VARCHAR) ELSE replace(p_type, ' ', '-') END AS text
    FROM part, sides, (SELECT unnest([0, 1, 2]) AS c) WHERE s = 0 OR NOT (c = 2 AND p_partkey % 19 = 0) AND NOT (p_partkey % 20 = 19 AND (p_partkey // 20 + 1) % 3 = 0)),
heads AS (SELECT DISTINCT page, side, s, CAST(0 AS BIGINT) AS r, c, CASE c WHEN 0 THEN 'ITEM' WHEN 1 THEN 'QTY' ELSE 'DESCRIPTION' || CASE WHEN s = 1 AND page % 4 = 0 THEN 'S' ELSE '' END END AS text FROM (SELECT page, side, s, unnest([0, 1, 2]) AS c FROM body)),
words AS (
    SELECT CASE WHEN page % 3 = 0 THEN 'B' ELSE 'A' END AS pair_id, page, side, CAST(3 * r + c AS INTEGER) AS word_idx, r, c, text, CASE c WHEN 0 THEN 60.0 WHEN 1 THEN 160.0 ELSE 300.0 END + 6 * s AS x0, 100.0 + 20 * r + 4 * s AS y0 FROM (SELECT * FROM heads UNION ALL SELECT * FROM body)),
boxed AS (SELECT *, x0 + 6 * length(text) AS x1, y0 + 10 AS y1 FROM words),
frame AS (SELECT page, side, min(x0) AS hx0, max(x1) AS hx1 FROM boxed WHERE r = 0 GROUP BY page, side),
kept AS (SELECT boxed.* FROM boxed JOIN frame USING (page, side) WHERE (x0 + x1) / 2 BETWEEN hx0 - 15 AND hx1 + 15),
dense AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY page, side ORDER BY r) - 1 AS INTEGER) AS row_no FROM kept)"""

CELLS = """,
columns AS (SELECT side, c AS col, text AS header, x0 - 10 AS lo, coalesce(lead(x0) OVER (PARTITION BY page, side ORDER BY c), x1 + 10) + 10 AS hi, page FROM boxed WHERE r = 0),
placed AS (SELECT d.page, d.side, d.row_no, d.word_idx, d.text, min(col) AS col FROM dense d JOIN columns k ON d.page = k.page AND d.side = k.side AND (d.x0 + d.x1) / 2 >= lo AND (d.x0 + d.x1) / 2 < hi GROUP BY ALL),
texts AS (SELECT page, side, row_no, col, string_agg(text, ' ' ORDER BY word_idx) AS value FROM placed GROUP BY ALL),
rows_ AS (SELECT page, side, row_no, CAST(dense_rank() OVER (PARTITION BY page, side ORDER BY row_no) - 1 AS INTEGER) AS row FROM (SELECT DISTINCT page, side, row_no FROM texts)),
cells AS (SELECT CASE WHEN k.page % 3 = 0 THEN 'B' ELSE 'A' END AS pair_id, k.page, k.side, 0 AS table_id, row, k.col, header, coalesce(value, '') AS value FROM rows_ JOIN columns k USING (page, side) LEFT JOIN texts t ON t.page = k.page AND t.side = k.side AND t.row_no = rows_.row_no AND t.col = k.col)"""

UPLOADS = """
WITH uploads AS (
    SELECT CASE WHEN page_id % 2 = 0 OR page_id % 11 = 0 THEN 'ref' ELSE 'cand' END AS side, CASE WHEN page_id % 3 = 0 THEN 'Sheet' ELSE 'sheet' END || (page_id // 2) || CASE WHEN page_id % 7 = 0 THEN '.txt' WHEN page_id % 5 = 0 THEN '.PDF' ELSE '.pdf' END AS name,
        page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes FROM pages),
pdfs AS (SELECT side, lower(name) AS name_key, arg_max(name, page_id) AS name, arg_max(bytes, page_id) AS bytes FROM uploads WHERE lower(name) LIKE '%.pdf' GROUP BY side, lower(name)),
paired AS (SELECT a.name_key, a.name, a.bytes AS ref_bytes, b.bytes AS cand_bytes FROM pdfs a JOIN pdfs b ON a.name_key = b.name_key AND a.side = 'ref' AND b.side = 'cand')"""

JOBS = """
WITH jobs AS (
    SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, CAST(floor(epoch(ts)) AS BIGINT) AS created_at, CAST(floor(epoch(ts)) AS BIGINT) AS updated_at FROM events)"""

GREY = """
WITH g AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor(128 + 256 * CAST(x AS DOUBLE)))) AS INTEGER)) AS a FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT id, a, list_transform(a, lambda v, i: CASE WHEN (i - 1 + id) % 5 = 0 THEN 255 - v ELSE v END) AS b FROM g)"""



def _pair(page: str) -> str:
    return f"CASE WHEN {page} % 3 = 0 THEN 'B' ELSE 'A' END AS pair_id"


_n = _pair("page")
_M = ["m00", "m01", "m02", "m10", "m11", "m12"]
_rounded = ", ".join(f"round({m}, 4) AS {m}" for m in _M)
_corners = [(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
_xs, _ys = ", ".join(f"m00 * {x} + m01 * {y} + m02" for x, y in _corners), ", ".join(f"m10 * {x} + m11 * {y} + m12" for x, y in _corners)

# Ruled tables: the same pieces, snapped, merged and crossed, in SQL.
RULED = """
WITH RECURSIVE c AS (
    SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, CAST(c_custkey // 12 + 1 AS INTEGER) AS page, CAST(c_custkey % 12 AS INTEGER) AS r, ((7 * c_custkey) % 3 - 1) * 0.5 AS off FROM customer),
p AS MATERIALIZED (
    SELECT *, CASE WHEN r < 8 THEN [500 + 6 * s, 560 + 6 * s, 640 + 6 * s, 780 + 6 * s] ELSE [520 + 6 * s, 600 + 6 * s, 700 + 6 * s] END AS b, CAST(CASE WHEN r < 8 THEN 100 + 20 * r ELSE 160 + 20 * r END + 4 * s AS DOUBLE) AS top
    FROM c, (VALUES ('ref', 0), ('cand', 1)) o(side, s) WHERE r < 8 OR side = 'ref' OR page % 5 <> 0),
pieces AS (
    SELECT page, side, true AS level, CAST(top + y + off AS DOUBLE) AS spot, CAST(CASE h WHEN 0 THEN b[1] ELSE b[2] + 1 END AS DOUBLE) AS low, CAST(CASE h WHEN 0 THEN b[2] - 1 ELSE b[-1] END AS DOUBLE) AS high FROM p, (VALUES (0), (20)) a(y), (VALUES (0), (1)) g(h)
    UNION ALL SELECT page, side, false, CAST(b[i] + 0.8 * off AS DOUBLE), top, top + 20 FROM p, range(1, 5) t(i) WHERE i <= len(b) AND NOT (i = 3 AND k % 7 = 0 AND r < 8)
    UNION ALL SELECT page, side, false, CAST(b[2] + 40 AS DOUBLE), top, top + 10 FROM p WHERE k % 5 = 0 AND r < 8),
snapped AS (
    SELECT *, sum(new) OVER (PARTITION BY page, side, level ORDER BY spot RANGE UNBOUNDED PRECEDING) AS snap FROM (
        SELECT *, CASE WHEN spot - lag(spot) OVER (PARTITION BY page, side, level ORDER BY spot) > 3 THEN 1 ELSE 0 END AS new FROM pieces)),
islands AS (
    SELECT *, sum(gap) OVER (PARTITION BY page, side, level, snap ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, (min(spot) OVER (PARTITION BY page, side, level, snap) + max(spot) OVER (PARTITION BY page, side, level, snap)) / 2 AS pos,
            CASE WHEN low - max(high) OVER (PARTITION BY page, side, level, snap ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3 THEN 1 ELSE 0 END AS gap FROM snapped)),
edges AS MATERIALIZED (SELECT page, side, level, pos, min(low) AS low, max(high) AS high, row_number() OVER (PARTITION BY page, side, level ORDER BY pos, min(low)) AS edge FROM islands GROUP BY page, side, level, snap, pos, island),
met AS (
    SELECT h.page, h.side, h.edge AS across, v.edge AS down, v.pos AS x, h.pos AS y FROM edges h JOIN edges v ON h.page = v.page AND h.side = v.side AND h.level AND NOT v.level
        AND v.pos BETWEEN h.low - 3 AND h.high + 3 AND h.pos BETWEEN v.low - 3 AND v.high + 3),
crossings AS MATERIALIZED (
    SELECT *, x < max(x) OVER (PARTITION BY page, side, across) AS goes_right, y < max(y) OVER (PARTITION BY page, side, down) AS goes_down FROM (
        SELECT *, count(*) OVER (PARTITION BY page, side, across) AS na, count(*) OVER (PARTITION BY page, side, down) AS nd FROM met) WHERE na > 1 AND nd > 1),
begun AS (
    SELECT a.*, (SELECT min(x) FROM crossings b WHERE b.page = a.page AND b.side = a.side AND b.across = a.across AND b.x > a.x AND b.goes_down) AS x1,
        (SELECT min(y) FROM crossings b WHERE b.page = a.page AND b.side = a.side AND b.down = a.down AND b.y > a.y AND b.goes_right) AS y1 FROM crossings a WHERE goes_right AND goes_down),
cells AS MATERIALIZED (
    SELECT a.page, a.side, a.x AS x0, a.y AS y0, a.x1, a.y1, row_number() OVER (PARTITION BY a.page, a.side ORDER BY a.y, a.x) AS cell FROM begun a
    JOIN crossings r ON r.page = a.page AND r.side = a.side AND r.across = a.across AND r.x = a.x1 JOIN crossings b ON b.page = a.page AND b.side = a.side AND b.down = a.down AND b.y = a.y1
    JOIN crossings c ON c.page = a.page AND c.side = a.side AND c.across = b.across AND c.down = r.down),
near AS MATERIALIZED (SELECT DISTINCT a.page, a.side, a.cell, b.cell AS other FROM cells a JOIN cells b ON a.page = b.page AND a.side = b.side AND (a.x0 IN (b.x0, b.x1) OR a.x1 IN (b.x0, b.x1)) AND (a.y0 IN (b.y0, b.y1) OR a.y1 IN (b.y0, b.y1))),
reach(page, side, cell, other) AS (SELECT * FROM near UNION SELECT r.page, r.side, r.cell, n.other FROM reach r JOIN near n ON n.page = r.page AND n.side = r.side AND n.cell = r.other),
groups_ AS (SELECT page, side, cell, min(other) AS label FROM reach GROUP BY page, side, cell HAVING count(*) > 1),
named AS (SELECT page, side, label, CAST(row_number() OVER (PARTITION BY page, side ORDER BY min(y0), min(x0)) - 1 AS INTEGER) AS table_id FROM groups_ JOIN cells USING (page, side, cell) GROUP BY page, side, label),
placed AS MATERIALIZED (
    SELECT page, side, table_id, cell, x0, y0, x1, y1, CAST(dense_rank() OVER (PARTITION BY page, side, table_id ORDER BY y0) - 1 AS INTEGER) AS row, CAST(dense_rank() OVER (PARTITION BY page, side, table_id ORDER BY x0) - 1 AS INTEGER) AS col
    FROM groups_ JOIN cells USING (page, side, cell) JOIN named USING (page, side, label)),
boxes AS MATERIALIZED (SELECT page, side, table_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols FROM placed GROUP BY page, side, table_id),
spoken AS (
    SELECT page, side, w.text, w.x, w.x + 2.5 * length(w.text) AS cx, top + 9 AS cy FROM (
        SELECT page, side, top, unnest(CASE WHEN r < 8 THEN [{'text': CAST(k AS VARCHAR), 'x': b[1] + 4}, {'text': CAST(n + CASE WHEN side = 'cand' AND k % 17 = 0 THEN 1 ELSE 0 END AS VARCHAR), 'x': b[2] + 4}, {'text': m, 'x': b[3] + 4}, {'text': CASE WHEN k % 4 = 0 THEN 'N' || n END, 'x': b[3] + 68}]
            ELSE [{'text': CAST(k AS VARCHAR), 'x': b[1] + 4}, {'text': m, 'x': b[2] + 4}] END) AS w FROM p) WHERE w.text IS NOT NULL),
texts AS (SELECT t.page, t.side, t.table_id, t.row, t.col, string_agg(text, ' ' ORDER BY x) AS value FROM placed t JOIN spoken s ON s.page = t.page AND s.side = t.side AND cx >= x0 AND cx < x1 AND cy >= y0 AND cy < y1 GROUP BY ALL)"""

ORACLE_SQL = {
    "normalize_text": f"{RUNS} SELECT 'ref' AS side, {_n}, page, run_idx, norm FROM ref UNION ALL SELECT 'cand', CASE WHEN page % 3 = 0 THEN 'B' ELSE 'A' END, page, run_idx, norm FROM cand",
    "symbol_equivalence": f"{RUNS} SELECT {_pair('a.page')}, a.page, a.block, a.line, a.text AS ref_text, b.text AS cand_text, a.norm = b.norm AS equal FROM ref a JOIN cand b USING (page, block, line) WHERE a.text <> b.text",
    "edit_distance_norm": f"{RUNS} SELECT * FROM (SELECT {_pair('a.page')}, a.page, a.block, a.line, round({edit('a.norm', 'b.norm')}, 6) AS distance FROM ref a JOIN cand b USING (page, block, line)) WHERE distance > 0",
    "bbox_centers": f"{RUNS} SELECT {_n}, page, run_idx, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM cand",
    "overlap_ratio": f"{RUNS} SELECT * FROM (SELECT {_pair('a.page')}, a.page, a.run_idx, round({overlap(box('a.'), box('b.'))}, 6) AS ratio FROM cand a JOIN cand b ON a.page = b.page AND b.run_idx = a.run_idx + 1) WHERE ratio > 0",
    "anchors": f"{RUNS}, {ANCHORS} SELECT * FROM anchors",
    "affine_fit": f"{RUNS}, {ANCHORS}, {FIT} SELECT {_n}, page, n_anchors, {_rounded} FROM fit",
    "map_bbox": f"{RUNS}, {ANCHORS}, {FIT} SELECT {_n}, page, run_idx, round(least({_xs}), 3) AS x0, round(least({_ys}), 3) AS y0, round(greatest({_xs}), 3) AS x1, round(greatest({_ys}), 3) AS y1 FROM ref JOIN fit USING (page)",
    "scale_fallback": f"{RUNS} SELECT {_n}, page, CASE WHEN page % 11 = 0 THEN 0 ELSE CAST(800 + page % 7 AS DOUBLE) / 800 END AS m00, CAST(0 AS DOUBLE) AS m01, CAST(0 AS DOUBLE) AS m02, CAST(0 AS DOUBLE) AS m10, CAST(600 - page % 5 AS DOUBLE) / 600 AS m11, CAST(0 AS DOUBLE) AS m12, page % 11 <> 0 AS valid FROM pages_",
    "zone_labels": f"{RUNS}, {GRID} SELECT {_n}, page, axis, label, round(center, 6) AS center FROM cells_",
    "zone_assign": f"{RUNS}, {GRID} SELECT {_n}, page, run_idx, {zone('cx', 'cy', 'r.page')} AS zone FROM cand r",
    "match_cost_stats": f"{RUNS}, {COSTS} SELECT {_n}, page, count(*) AS n_pairs, count(*) FILTER (WHERE cost <= 60) AS n_cheap, count(*) FILTER (WHERE equal) AS n_equal, round(sum(cost), 3) AS total FROM costs GROUP BY page",
    "min_ref_cost": f"{RUNS}, {COSTS} SELECT {_n}, page, ref_idx, round(min(cost), 6) AS min_cost FROM costs GROUP BY page, ref_idx",
    "residual_exact": f"{RUNS}, {EXACT} SELECT {_n}, page, ref_idx, cand_idx FROM exact",
    "unmatched_runs": f"{RUNS}, {EXACT} SELECT 'ref' AS side, {_n}, page, run_idx, text FROM free_ref UNION ALL SELECT 'cand', CASE WHEN page % 3 = 0 THEN 'B' ELSE 'A' END, page, run_idx, text FROM free_cand",
    "text_overlap": f"{RUNS}, {GRID}, {OVERLAPS} SELECT {_n}, page, {zone('cx', 'cy', 'r.page')} AS zone, texts AS cand_text, round(least(1.0, ratio / 0.3), 6) AS confidence, x0, y0, x1, y1 FROM collisions r",
    "stack_edges": f"{RUNS}, {STACKS} SELECT {_n}, page, i, j FROM stacks",
    "leader_edges": f"{RUNS}, {LEADERS} SELECT {_n}, page, i, j FROM leaders",
    "annotation_clusters": f"{RUNS}, {STACKS}, {LEADERS}, {reach('SELECT * FROM stacks UNION ALL SELECT * FROM leaders')}",
    "dbscan_zones": f"{RUNS}, {NEAR}, {reach('SELECT * FROM near_')}",
    "zone_signature": f"{RUNS}, {BLOCKS} SELECT {_n}, page, cluster, text, x0, y0, x1, y1, sha256(text) AS signature FROM zref",
    "missing_zones_exact": f"{RUNS}, {BLOCKS} SELECT {_n}, page, cluster, text FROM zref r WHERE NOT EXISTS (SELECT 1 FROM zcand c WHERE c.page = r.page AND c.text = r.text)",
    "missing_zones": f"""{RUNS}, {BLOCKS} SELECT {_n}, page, cluster, 'Information Zone containing ''' || substring(text, 1, 40) || ''' is missing.' AS message FROM zref r WHERE NOT EXISTS (SELECT 1 FROM zcand c WHERE c.page = r.page AND (c.text = r.text
        OR (1 - {edit('r.text', 'c.text')} > 0.8 AND {dist('(r.x0 + r.x1) / 2', '(r.y0 + r.y1) / 2', '(c.x0 + c.x1) / 2', '(c.y0 + c.y1) / 2')} < 100)))""",
    "missing_groups": f"""{RUNS}, {COSTS}, {EXACT}, cheap AS (SELECT page, ref_idx, min(cost) AS cost FROM costs GROUP BY page, ref_idx), blocks AS (SELECT page, block, min(run_idx) AS cluster FROM ref GROUP BY page, block)
        SELECT {_pair('r.page')}, r.page, cluster, CASE WHEN count(*) > 1 THEN 'missing_annotation' ELSE 'missing_text' END AS class, string_agg(text, ' ' ORDER BY y0, x0, run_idx) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
            round(least(1.0, min(coalesce(cost, 60)) / 120), 6) AS confidence FROM free_ref r JOIN blocks b ON r.page = b.page AND r.block = b.block LEFT JOIN cheap c ON c.page = r.page AND c.ref_idx = r.run_idx GROUP BY r.page, cluster""",
    "bom_rows": f"{WORDS} SELECT pair_id, page, side, word_idx, text, row_no FROM dense",
    "bom_cells": f"{WORDS}{CELLS} SELECT * FROM cells",
    "bom_scan": f"{WORDS}{CELLS} SELECT * FROM cells",
    "words_scan": f"""{RUNS}, split AS (SELECT page, block, line, x0, y0, y1, string_split(text, ' ') AS w FROM ref),
        spread AS (SELECT page, block, line, x0, y0, y1, w, unnest(range(1, len(w) + 1)) AS i FROM split)
        SELECT {_n}, page, block, line, CAST(i - 1 AS INTEGER) AS word, w[i] AS text, x0 + 6 * (i - 1 + coalesce(length(array_to_string(w[1:i - 1], '')), 0)) AS x0, y0, x0 + 6 * (i - 1 + length(array_to_string(w[1:i], ''))) AS x1, y1 FROM spread""",
    "table_match": f"""{WORDS}, boxes AS (SELECT page, side, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM kept GROUP BY page, side)
        SELECT {_pair('a.page')}, a.page, 0 AS table_id, 0 AS cand_id, round({dist('(a.x0 + a.x1) / 2', '(a.y0 + a.y1) / 2', '(b.x0 + b.x1) / 2', '(b.y0 + b.y1) / 2')}, 6) AS distance FROM boxes a JOIN boxes b ON a.page = b.page AND a.side = 'ref' AND b.side = 'cand'""",
    "table_columns": f"{WORDS}{CELLS} SELECT DISTINCT {_n}, page, 0 AS table_id, col, 0 AS cand_id, col AS cand_col, CASE WHEN col = 2 AND page % 4 = 0 THEN 1 - 1 / CAST(12 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS similarity FROM columns",
    "table_cell_diff": f"""{WORDS}{CELLS}, heights AS (SELECT page, max(row) + 1 AS n FROM cells WHERE side = 'cand' GROUP BY page)
        SELECT {_pair('a.page')}, a.page, 0 AS table_id, a.row, a.col, 0 AS cand_id, a.col AS cand_col, a.value AS ref_value, coalesce(b.value, '') AS cand_value, CASE WHEN a.row >= n THEN 'missing_row' WHEN coalesce(b.value, '') = '' THEN 'missing' ELSE 'changed' END AS kind
        FROM cells a JOIN heights h ON a.page = h.page LEFT JOIN cells b ON a.page = b.page AND a.row = b.row AND a.col = b.col AND b.side = 'cand' WHERE a.side = 'ref' AND (a.row >= n OR a.value <> coalesce(b.value, ''))""",
    "added_text": f"{SLICE} SELECT {_n}, page, zone, cand_text, x0, y0, x1, y1 FROM findings WHERE class = 'added_text'",
    "ignore_regions": f"{SLICE} SELECT {_n}, page, class, count(*) AS n FROM findings WHERE class = 'missing_text' AND NOT ((cx BETWEEN 100 AND 300 AND cy BETWEEN 100 AND 250) OR (cx BETWEEN 500 AND 560 AND cy BETWEEN 300 AND 420)) OR class <> 'missing_text' AND NOT ((cx BETWEEN 100 AND 300 AND cy BETWEEN 100 AND 250) OR (cx BETWEEN 500 AND 560 AND cy BETWEEN 300 AND 420)) GROUP BY page, class",
    "table_lattice": f"""{RULED} SELECT {_pair('b.page')}, b.page, b.side, b.table_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(c AS VARCHAR) AS header, CASE WHEN t.cell IS NULL THEN 'None' ELSE coalesce(value, '') END AS value
        FROM boxes b, range(0, 100) i(r), range(0, 100) j(c) LEFT JOIN placed t ON t.page = b.page AND t.side = b.side AND t.table_id = b.table_id AND t.row = r AND t.col = c
        LEFT JOIN texts x ON x.page = b.page AND x.side = b.side AND x.table_id = b.table_id AND x.row = r AND x.col = c WHERE r < n_rows AND c < n_cols""",
    "table_fallback": f"""{RULED}, grid AS ({WORDS}{CELLS}, shape AS (SELECT page, side, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols FROM cells GROUP BY page, side)
            SELECT page, side, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, any_value(n_rows) AS n_rows, any_value(n_cols) AS n_cols FROM kept JOIN shape USING (page, side) GROUP BY page, side)
        SELECT {_pair('page')}, page, side, 0 AS table_id, x0, y0, x1, y1, n_rows, n_cols FROM grid
        UNION ALL SELECT {_pair('page')}, page, side, table_id, x0, y0, x1, y1, n_rows, n_cols FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM grid f WHERE f.page = b.page AND f.side = b.side) AND NOT (x1 - x0 > 640 AND y1 - y0 > 480)""",
    "defect_filters": f"""{SLICE}, {WORDS.replace('WITH ', '', 1).strip()}, tables_ AS (SELECT page, min(x0) AS tx0, min(y0) AS ty0, max(x1) AS tx1, max(y1) AS ty1 FROM kept WHERE side = 'cand' GROUP BY page)
        SELECT {_n}, page, class, count(*) AS n FROM findings f WHERE zone IS DISTINCT FROM 'border' AND NOT EXISTS (SELECT 1 FROM tables_ t WHERE t.page = f.page AND cx BETWEEN tx0 AND tx1 AND cy BETWEEN ty0 AND ty1) GROUP BY page, class""",
    "defect_records": f"{SLICE} SELECT {_n}, page, class, severity, round_even(CAST(confidence AS DOUBLE), 3) AS confidence, status, zone, ref_text, cand_text, message, cause, fix FROM records",
    "defect_ids": f"""{SLICE} SELECT {_n}, printf('D-%03d', row_number() OVER (PARTITION BY page % 3 = 0 ORDER BY page, round(y0, 1), round(x0, 1), CASE class WHEN 'missing_text' THEN 0 WHEN 'text_overlap' THEN 2 ELSE 99 END, text)) AS id, page, class, text
        FROM (SELECT *, coalesce(nullif(cand_text, ''), ref_text, '') AS text FROM records)""",
    "audit_categories": f"{SLICE} SELECT {_n}, page, class, category, count(*) AS n FROM categorised GROUP BY page, class, category",
    "category_matrix": f"""{SLICE}, failed AS (SELECT category, count(DISTINCT page) AS n FROM categorised GROUP BY category)
        SELECT category, coalesce(n, 0) AS failed_pages, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN n > 0 THEN 'FAIL: Discrepancies found on ' || n || ' page(s).' ELSE 'PASS: No discrepancies detected.' END AS justification FROM weights LEFT JOIN failed USING (category)""",
    "page_quality_score": f"{SLICE} SELECT {_n}, page, score FROM scores",
    "pair_quality_score": f"{SLICE} SELECT pair_id, CAST(round_even(avg(score), 0) AS BIGINT) AS quality_score FROM (SELECT {_n}, score FROM scores) GROUP BY pair_id",
    "page_summaries": f"""{SLICE}, found AS (SELECT page, count(*) AS n FROM categorised GROUP BY page), names AS (SELECT page, string_agg(category, ', ' ORDER BY ord) AS list FROM (SELECT DISTINCT page, category FROM categorised) JOIN (SELECT category, row_number() OVER () AS ord FROM weights) USING (category) GROUP BY page)
        SELECT {_n}, page, coalesce(n, 0) AS n_issues, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN n > 0 THEN 'Page ' || page || ' has ' || n || ' identified ' || CASE WHEN n = 1 THEN 'discrepancy' ELSE 'discrepancies' END || '. Failed categories: ' || list || '.' ELSE 'Page ' || page || ' matches the reference drawing in all audit categories.' END AS summary
        FROM pages_ LEFT JOIN found USING (page) LEFT JOIN names USING (page)""",
    "counts_by_class": f"{SLICE} SELECT class, count(r.class) AS n FROM (VALUES ('missing_text'), ('missing_annotation'), ('text_overlap'), ('text_misplacement'), ('font_glyph_corruption'), ('visual_defect'), ('added_text')) t(class) LEFT JOIN records r USING (class) GROUP BY class HAVING count(r.class) > 0 OR class <> 'added_text'",
    "counts_by_status": f"{SLICE} SELECT count(*) FILTER (WHERE status = 'defect') AS defect, count(*) FILTER (WHERE status = 'review') AS review FROM records",
    "severity_counts": f"{SLICE} SELECT count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM records",
    "pair_summary": f"""{SLICE}, found AS (SELECT {_n}, count(*) AS total_defects, count(*) FILTER (WHERE status = 'defect') AS defect, count(*) FILTER (WHERE status = 'review') AS review FROM records GROUP BY 1),
        means_ AS (SELECT pair_id, CAST(round_even(avg(score), 0) AS BIGINT) AS quality_score FROM (SELECT {_n}, score FROM scores) GROUP BY pair_id)
        SELECT pair_id, coalesce(total_defects, 0) AS total_defects, coalesce(defect, 0) AS defect, coalesce(review, 0) AS review, quality_score, CASE WHEN defect > 0 THEN 'defect' ELSE 'clean' END AS status FROM means_ LEFT JOIN found USING (pair_id)""",
    "box_layer": f"{SLICE} SELECT {_n}, page, class, CASE class WHEN 'missing_text' THEN '#ef4444' WHEN 'text_overlap' THEN '#f97316' ELSE '#808080' END AS color, count(*) AS n FROM records GROUP BY page, class",
    "file_pairing": f"{UPLOADS} SELECT name_key, name, ref_bytes, cand_bytes FROM paired",
    "unmatched_files": f"{UPLOADS} SELECT side, name FROM pdfs p WHERE NOT EXISTS (SELECT 1 FROM pdfs q WHERE q.name_key = p.name_key AND q.side <> p.side)",
    "upload_totals": f"{UPLOADS} SELECT name_key, CAST(sum(ref_bytes + cand_bytes) OVER (ORDER BY name_key) AS BIGINT) AS total FROM paired",
    "job_ttl_eviction": f"""{JOBS}, live AS (SELECT * FROM jobs WHERE NOT (status IN ('completed', 'failed') AND (SELECT max(updated_at) FROM jobs) - updated_at > 604800)),
        ended AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, job_id DESC) AS rank FROM live WHERE status IN ('completed', 'failed'))
        SELECT * FROM live WHERE status IN ('queued', 'running') UNION ALL SELECT job_id, status, created_at, updated_at FROM ended WHERE rank <= greatest(0, 500 - (SELECT count(*) FROM live WHERE status IN ('queued', 'running')))""",
    "pending_jobs": f"{JOBS} SELECT count(*) FILTER (WHERE status IN ('queued', 'running')) AS pending FROM jobs",
    "mean_abs_diff": f"{GREY} SELECT id, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) / 64.0 / 255.0, 9) AS diff FROM p",
    "text_over_geometry": f"""{RUNS}, o AS (
            SELECT CAST(o_orderkey // 10 + 1 AS INTEGER) AS page, CAST(60 + (17 * o_orderkey) % 640 AS INTEGER) AS ax, CAST(60 + (29 * o_orderkey) % 460 AS INTEGER) AS ay, CAST(60 + (41 * o_orderkey + 31) % 640 AS INTEGER) AS bx, CAST(60 + (23 * o_orderkey + 11) % 460 AS INTEGER) AS b_y,
                greatest(1, CAST(o_orderkey % 4 AS INTEGER)) AS pen, o_orderkey % 3 = 0 AS boxed FROM orders),
        lines_ AS (SELECT page, ax, ay, bx, b_y, pen FROM o UNION ALL SELECT page, ax, ay, bx, ay, pen FROM o WHERE boxed UNION ALL SELECT page, bx, ay, bx, b_y, pen FROM o WHERE boxed UNION ALL SELECT page, bx, b_y, ax, b_y, pen FROM o WHERE boxed UNION ALL SELECT page, ax, b_y, ax, ay, pen FROM o WHERE boxed),
        turned AS (SELECT page, pen, CASE WHEN ax <= bx THEN ax ELSE bx END AS x, CASE WHEN ax <= bx THEN ay ELSE b_y END AS y, abs(bx - ax) AS dx, abs(b_y - ay) AS dy, CASE WHEN (CASE WHEN ax <= bx THEN b_y - ay ELSE ay - b_y END) < 0 THEN -1 ELSE 1 END AS sy FROM lines_),
        steps AS (SELECT *, greatest(dx, dy) AS major, least(dx, dy) AS minor, unnest(range(0, greatest(dx, dy) + 1)) AS k FROM turned),
        dots AS (SELECT page, pen, CASE WHEN dx >= dy THEN x + k ELSE x + m END AS px, CASE WHEN dx >= dy THEN y + sy * m ELSE y + sy * k END AS py FROM (SELECT *, CASE WHEN major = 0 THEN 0 ELSE (2 * minor * k + major - 1) // (2 * major) END AS m FROM steps)),
        wide AS (SELECT DISTINCT page, px + u AS px, py + v AS py FROM dots, (SELECT unnest([-1, 0, 1]) AS u) a, (SELECT unnest([-1, 0, 1]) AS v) b WHERE u >= -(pen // 2) AND u < pen - pen // 2 AND v >= -(pen // 2) AND v < pen - pen // 2),
        insets AS (SELECT page, run_idx, CAST(trunc(x0 + least(5.0, (x1 - x0) * 0.3)) AS INTEGER) AS a, CAST(trunc(y0 + least(4.0, (y1 - y0) * 0.3)) AS INTEGER) AS b, CAST(trunc(x1 - least(5.0, (x1 - x0) * 0.3)) AS INTEGER) AS c, CAST(trunc(y1 - least(4.0, (y1 - y0) * 0.3)) AS INTEGER) AS d FROM cand),
        rows_ AS (SELECT page, run_idx, greatest(0, a) AS a, least(799, c) AS c, unnest(range(greatest(0, b), least(599, d))) AS py FROM insets WHERE c > a AND d > b)
        SELECT {_pair('r.page')}, r.page, run_idx, CAST(count(*) AS INTEGER) AS pixels FROM rows_ r JOIN wide w ON w.page = r.page AND w.py = r.py AND w.px >= a AND w.px < c GROUP BY r.page, run_idx HAVING count(*) > 3""",
    "visual_merge": f"""{SLICE}, d AS MATERIALIZED (SELECT *, x0 + 2 + region % 60 AS x1, y0 + 2 + region % 25 AS y1, (region % 100) / CAST(100 AS DOUBLE) AS seen FROM (
            SELECT CAST(o_orderkey // 10 + 1 AS INTEGER) AS page, o_orderkey AS region, CAST(60 + (19 * o_orderkey) % 640 AS DOUBLE) AS x0, CAST(20 + (31 * o_orderkey) % 560 AS DOUBLE) AS y0 FROM orders)),
        numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS f FROM findings),
        near_ AS MATERIALIZED (SELECT f.f, d.page, d.region, d.seen, {overlap(box('f.'), box('d.'))} AS ratio FROM numbered f JOIN d ON f.page = d.page AND f.x0 < d.x1 AND d.x0 < f.x1 AND f.y0 < d.y1 AND d.y0 < f.y1),
        best AS MATERIALIZED (SELECT * FROM near_ WHERE ratio > 0.05 QUALIFY row_number() OVER (PARTITION BY f ORDER BY ratio DESC, region) = 1),
        used AS MATERIALIZED (SELECT page, region FROM best UNION SELECT page, region FROM near_ WHERE ratio > 0.1
            UNION SELECT d.page, region FROM d JOIN (SELECT page, x0, y0, x1, y1 FROM ref UNION ALL SELECT page, x0, y0, x1, y1 FROM cand) r ON r.page = d.page AND r.x0 < d.x1 AND d.x0 < r.x1 AND r.y0 < d.y1 AND d.y0 < r.y1 WHERE {overlap(box('r.'), box('d.'))} > 0.01),
        free AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM d WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.page = d.page AND u.region = d.region) AND page IN (SELECT page FROM pages_) AND (x1 - x0) * (y1 - y0) >= 40)
        SELECT {_pair('page')}, page, class, zone, ref_text, cand_text, round(CAST(confidence AS DOUBLE), 6) AS confidence, b.seen AS score, x0, y0, x1, y1 FROM numbered f LEFT JOIN (SELECT f, seen FROM best) b USING (f)
        UNION ALL SELECT {_pair('page')}, page, 'visual_defect', {zone('cx', 'cy', 'r.page')}, NULL, NULL, round(least(1.0, seen / (2 * 0.12)), 6), seen, x0, y0, x1, y1 FROM free r WHERE NOT (cx < 48 OR cx > 752 OR cy < 36 OR cy > 564)""",
    "nested_runs": f"{RUNS} SELECT {_n}, page, block, line, text, x0, y0, x1, y1 FROM ref",
    "drawing_segments": """WITH o AS (SELECT CAST(o_orderkey // 10 + 1 AS INTEGER) AS page, o_orderkey AS item, CAST(60 + (17 * o_orderkey) % 640 AS DOUBLE) AS ax, CAST(60 + (29 * o_orderkey) % 460 AS DOUBLE) AS ay, CAST(60 + (41 * o_orderkey + 31) % 640 AS DOUBLE) AS bx, CAST(60 + (23 * o_orderkey + 11) % 460 AS DOUBLE) AS b_y FROM orders)
        SELECT CASE WHEN page % 3 = 0 THEN 'B' ELSE 'A' END AS pair_id, page, item, 'l' AS kind, 0 AS edge, ax, ay, bx, b_y AS "by" FROM o
        UNION ALL SELECT CASE WHEN page % 3 = 0 THEN 'B' ELSE 'A' END, page, item, 're', e, CASE WHEN e IN (0, 3) THEN ax ELSE bx END, CASE WHEN e IN (0, 1) THEN ay ELSE b_y END, CASE WHEN e IN (0, 1) THEN bx ELSE ax END, CASE WHEN e IN (1, 2) THEN b_y ELSE ay END FROM o, (SELECT unnest([0, 1, 2, 3]) AS e) WHERE item % 3 = 0""",
    "page_sizes": f"{RUNS} SELECT {_n}, page, CAST(800 AS DOUBLE) AS width, CAST(600 AS DOUBLE) AS height, CAST(800 - page % 7 AS DOUBLE) AS ref_width, CAST(600 + page % 5 AS DOUBLE) AS ref_height, round(800 / CAST(800 - page % 7 AS DOUBLE), 6) AS m00, round(600 / CAST(600 + page % 5 AS DOUBLE), 6) AS m11 FROM pages_ WHERE page % 9 <> 0 AND page % 10 <> 0",
    "pair_pages": f"{RUNS} SELECT pair_id, count(*) FILTER (WHERE page % 9 <> 0 AND page % 10 <> 0) AS pages_compared, count(*) FILTER (WHERE page % 9 <> 0) <> count(*) FILTER (WHERE page % 10 <> 0) AS page_count_mismatch FROM (SELECT {_n}, page FROM pages_) GROUP BY pair_id",
    "page_errors": f"""{RUNS} SELECT DISTINCT {_n}, page, CASE block % 97 WHEN 7 THEN 'a run has no text' ELSE 'a run has no box' END AS error FROM ref WHERE line = 1 AND block % 97 IN (7, 9, 11) UNION ALL SELECT {_n}, page, 'a page has no size' FROM pages_ WHERE page % 13 = 0""",
    "pair_errors": f"""{SLICE}, bad AS (SELECT 'B' AS pair_id, min(CASE block % 97 WHEN 7 THEN 'a run has no text' ELSE 'a run has no box' END) AS error FROM ref WHERE line = 1 AND block % 97 IN (7, 9, 11) AND page % 3 = 0),
        found AS (SELECT {_n}, count(*) AS total_defects, count(*) FILTER (WHERE status = 'defect') AS defect FROM records GROUP BY 1), means_ AS (SELECT pair_id, CAST(round_even(avg(score), 0) AS BIGINT) AS quality_score FROM (SELECT {_n}, score FROM scores) GROUP BY pair_id)
        SELECT pair_id, CASE WHEN error IS NULL THEN coalesce(total_defects, 0) ELSE 0 END AS total_defects, CASE WHEN error IS NULL THEN quality_score END AS quality_score, CASE WHEN error IS NOT NULL THEN 'error' WHEN defect > 0 THEN 'defect' ELSE 'clean' END AS status, error
        FROM means_ LEFT JOIN found USING (pair_id) LEFT JOIN bad USING (pair_id)""",
    "scoreboard": f"{SLICE} SELECT {_n}, page, score, CAST(row_number() OVER (PARTITION BY page % 3 = 0 ORDER BY score DESC, page) AS INTEGER) AS place, score >= 80 AS passed FROM scores",
    "page_states": f"{SLICE} SELECT pair_id, count(*) FILTER (WHERE n = 0) AS clean, count(*) FILTER (WHERE n > 0) AS bad FROM (SELECT {_n}, page, (SELECT count(*) FROM categorised c WHERE c.page = p.page) AS n FROM pages_ p) GROUP BY pair_id",
}
