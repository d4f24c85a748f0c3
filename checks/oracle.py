"""The registered queries in SQL, over the same tables.

`CTES` are named building blocks; a query pulls in the ones it mentions.
"""

from __future__ import annotations

import re

from checks.inputs import ASKED, STORED


def _values(rows) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


STAGE_LIST = "['stitch','gate','faces','embed','calibrate','select','segment']"
NAME = "printf('y%03d_%05d.jpg', ([45,135,225,315])[{i} % 4 + 1], {i} // 4)"

CTES = {
    # ---- derived inputs
    "faces": f"""
        SELECT vec_id // 100 AS walk_id, CAST(vec_id % 100 AS INT) AS face_idx,
               CAST((vec_id % 100) // 4 AS INT) AS pano_idx, CAST((vec_id % 100) // 4 AS DOUBLE) * 2 AS t_sec,
               ([45,135,225,315])[vec_id % 4 + 1] AS yaw, {NAME.format(i='(vec_id % 100)')} AS path,
               1 + CAST((vec_id * 7919) % 997 AS DOUBLE) / 10 AS sharpness,
               embedding::DOUBLE[] AS e, vec_id, label FROM embeddings""",
    "mixes": """
        SELECT a.*, list_transform(range(1, 65), lambda i: (1 - 0.02::DOUBLE) * a.e[i] + 0.02::DOUBLE * b.e[i]) AS near,
               list_transform(range(1, 65), lambda i: (1 - 0.25::DOUBLE) * a.e[i] + 0.25::DOUBLE * b.e[i]) AS far_side
        FROM faces a JOIN faces b ON b.vec_id = a.vec_id + 1""",
    "blended": """
        SELECT walk_id, face_idx, e AS original, list_transform(near, lambda x: x / sqrt(list_dot_product(near, near))) AS e,
               list_transform(far_side, lambda x: x / sqrt(list_dot_product(far_side, far_side))) AS after FROM mixes""",
    "neighbours": """
        SELECT walk_id, CAST(round_even((face_idx // 4) * 2.0::DOUBLE * 29.97::DOUBLE, 0) AS BIGINT) + 1 AS frame_no,
               ([45,135,225,315])[face_idx % 4 + 1] AS yaw, after AS e FROM blended WHERE original[1] <= 0.2""",
    "twins": """
        SELECT walk_id, face_idx, pano_idx, t_sec, yaw, path, sharpness, e FROM faces
        UNION ALL
        SELECT f.walk_id, f.face_idx + 100, f.pano_idx + 1000, f.t_sec + 60, f.yaw,
               printf('y%03d_%05d.jpg', f.yaw, f.pano_idx + 1000), f.sharpness / 2, b.e
        FROM faces f JOIN blended b USING (walk_id, face_idx)""",
    "pixels": """
        SELECT vec_id, walk_id, face_idx, path, label, i - 1 AS px, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
               CAST(floor((least(greatest(e[i], -0.5), 0.5) + 0.5) * 255) AS INT) AS v
        FROM faces, range(1, 65) r(i)""",
    "labels_of": "SELECT * FROM (VALUES (0,'wall'), (1,'floor'), (2,'ceiling')) t(class_id, label)",
    "scored": """
        SELECT user_id AS walk_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pano_idx,
               value AS score FROM events""",
    "raw_decisions": """
        SELECT id, walk_id, anchor_idx, action,
               CASE WHEN event_type <> 'purchase' THEN CAST((anchor_idx + 4 * (id % 3)) % 100 AS INT) END AS pick_idx
        FROM (SELECT event_id AS id, event_id % 20 AS walk_id, event_type,
                     CAST(((event_id // 20) % 25) * 4 + user_id % 4 AS INT) AS anchor_idx,
                     CASE event_type WHEN 'click' THEN 'pick' WHEN 'error' THEN 'drop' WHEN 'signup' THEN 'restore'
                          WHEN 'view' THEN 'zoom' ELSE 'pick' END AS action FROM events)""",
    "decisions": f"""
        SELECT id, walk_id, {NAME.format(i='anchor_idx')} AS anchor, action,
               CASE WHEN action = 'pick' THEN {NAME.format(i='pick_idx')} END AS pick
        FROM raw_decisions WHERE action <> 'zoom' AND pick_idx IS NOT NULL""",
    "progress": f"""
        SELECT user_id AS job, {STAGE_LIST}[event_id % 7 + 1] AS stage, event_id AS seq, ts AS moment,
               CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error'
                    ELSE 'queued' END AS status FROM events""",
    "open_failures": f"""
        SELECT walk_id, stage, message, seq FROM (
            SELECT user_id AS walk_id, {STAGE_LIST}[event_id % 7 + 1] AS stage, props AS message, event_id AS seq,
                   event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
            FROM events WHERE event_type IN ('error', 'purchase')) WHERE rn = 1 AND event_type = 'error'""",
    "run_log": """
        SELECT walk_id, seq, row_number() OVER (PARTITION BY walk_id ORDER BY seq DESC) AS recency, faces, anchors, solo
        FROM (SELECT user_id AS walk_id, event_id AS seq, event_type, event_id % 500 + 100 AS faces,
                     event_id % 100 AS anchors, event_id % 7 AS solo,
                     row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS line
              FROM events WHERE event_type <> 'signup') WHERE line <= 20 AND event_type <> 'error'""",
    "recs": """
        SELECT *, round(frames / fps, 1) AS seconds FROM (
            SELECT o_orderkey AS walk_id, ([23.976,25,29.97,30,59.94]::DOUBLE[])[o_orderkey % 5 + 1] AS fps,
                   o_orderkey % 97 AS frames,
                   CASE WHEN o_orderkey % 7 = 0 THEN 3840 ELSE 2880 END AS width,
                   CASE WHEN o_orderkey % 7 = 0 THEN 1920 ELSE 2880 END AS height,
                   CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS lenses FROM orders)""",
    "wanted_frames": """
        SELECT walk_id, fps, unnest(range(0, greatest(frames - 1, 1),
               greatest(1, CAST(round_even(fps / 2, 0) AS BIGINT)))) AS frame_no FROM recs""",
    "stills": "SELECT l_orderkey AS walk_id, CAST((l_linenumber - 1) * 15 AS BIGINT) AS frame_no FROM lineitem",
    "files": """
        SELECT o_orderkey AS recording_id, file_no - 1 AS file_no, 'VID_' || strftime(o_orderdate, '%Y%m%d') || '_'
                   || printf('%02d%02d00', o_orderkey % 24, o_orderkey % 60) || marks[file_no] || o_orderkey || '.insv' AS name,
               CASE WHEN o_orderkey % 7 = 0 THEN 3840 ELSE 2880 END AS width,
               CASE WHEN o_orderkey % 7 = 0 THEN 1920 ELSE 2880 END AS height,
               CASE WHEN o_orderstatus = 'P' THEN '2030-01-01' ELSE '' END AS shot_date
        FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN ['_00_','_10_'] WHEN '5-LOW' THEN ['_10_']
                             ELSE ['_00_'] END AS marks FROM orders), range(1, 3) r(file_no)
        WHERE file_no <= len(marks)""",
    "walks": """
        SELECT c_custkey AS walk_id, n_name AS site, c_mktsegment AS building,
               CASE WHEN c_acctbal < 0 THEN '' ELSE 'L' || (c_custkey % 10) END AS floor,
               CASE WHEN c_acctbal > 5000 THEN 'finishing' ELSE 'structure' END AS stage, c_name AS operator,
               CAST(CASE WHEN c_acctbal <= 9000 THEN 150 + c_custkey % 100 END AS INT) AS mount_height_cm,
               '2024-05-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS shot_date,
               '' AS shot_time, '' AS camera FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "changes": """
        SELECT o_custkey * 2 AS walk_id, o_orderkey AS seq, field,
               CASE WHEN field = 'mount_height_cm' THEN CAST(100 + o_orderkey % 200 AS VARCHAR)
                    WHEN o_orderstatus = 'P' THEN '' ELSE 'v' || o_orderkey END AS value
        FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'site' WHEN '2-HIGH' THEN 'building'
                 WHEN '3-MEDIUM' THEN 'floor' WHEN '4-NOT SPECIFIED' THEN 'mount_height_cm' ELSE 'colour' END AS field
              FROM orders)
        UNION ALL SELECT o_custkey * 2, o_orderkey, 'camera', 'c' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0""",
    "patches": """
        SELECT walk_id, arg_max(value, seq) FILTER (WHERE field = 'site') AS p_site,
               arg_max(value, seq) FILTER (WHERE field = 'building') AS p_building,
               arg_max(value, seq) FILTER (WHERE field = 'floor') AS p_floor,
               arg_max(value, seq) FILTER (WHERE field = 'mount_height_cm') AS p_mount,
               arg_max(value, seq) FILTER (WHERE field = 'camera') AS p_camera
        FROM changes WHERE (walk_id, seq) NOT IN (SELECT (walk_id, seq) FROM changes WHERE field = 'colour') GROUP BY walk_id""",
    "gone": "SELECT DISTINCT o_custkey AS walk_id FROM orders WHERE o_totalprice > 400000",
    # ---- pairs and thresholds
    "far": """
        SELECT a.walk_id, a.yaw, list_dot_product(a.e, b.e) AS c FROM faces a JOIN faces b
        ON a.walk_id = b.walk_id AND a.yaw = b.yaw AND a.face_idx < b.face_idx AND abs(a.t_sec - b.t_sec) > 20""",
    "far_stats": """
        SELECT walk_id, count(*) AS n, round(quantile_cont(c, 0.5), 4) + 0 AS median, round(quantile_cont(c, 0.95), 4) AS p95,
               round(quantile_cont(c, 0.99), 4) AS p99, round(max(c), 4) AS max,
               CASE WHEN count(*) >= 50 THEN round(quantile_cont(c, 0.95), 4) END AS tau FROM far GROUP BY walk_id""",
    "far_ranks": """
        SELECT walk_id, round(c, 4) + 0 AS c, row_number() OVER (PARTITION BY walk_id ORDER BY c) - 1 AS r,
               count(*) OVER (PARTITION BY walk_id) AS n FROM far""",
    "sampled": """
        SELECT walk_id, unnest(list_transform(range(0, 10), lambda i: CAST(round_even(i * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT))) AS pos
        FROM (SELECT walk_id, count(DISTINCT pano_idx) AS n FROM faces GROUP BY walk_id)""",
    "ref_pairs": """
        SELECT f.walk_id, f.pano_idx AS pano, f.yaw, round(f.t_sec, 1) AS t_sec, f.path AS face,
               printf('n%05d_y%03d.jpg', f.pano_idx, f.yaw) AS neighbour, round(list_dot_product(f.e, n.e), 4) AS cosine
        FROM faces f JOIN sampled s ON s.walk_id = f.walk_id AND s.pos = f.pano_idx
        JOIN neighbours n ON n.walk_id = f.walk_id AND n.yaw = f.yaw
         AND n.frame_no = CAST(round_even(f.t_sec * 29.97::DOUBLE, 0) AS BIGINT) + 1""",
    "ref_stats": """
        SELECT walk_id, count(*) AS n, round(quantile_cont(cosine, 0.5), 4) AS median,
               round(quantile_cont(cosine, 0.05), 4) AS p05, min(cosine) AS min FROM ref_pairs GROUP BY walk_id""",
    # ---- selection
    "level": "SELECT walk_id, tau FROM far_stats WHERE tau IS NOT NULL",
    "pool": "SELECT walk_id, face_idx, pano_idx, t_sec, yaw, path, sharpness, e FROM faces",
    "solo_floor": "SELECT 0.5::DOUBLE AS floor",
    "ranked": """
        SELECT p.*, tau, row_number() OVER (PARTITION BY walk_id ORDER BY sharpness DESC, face_idx) AS r
        FROM pool p JOIN level USING (walk_id)""",
    "edges": """
        SELECT b.walk_id, b.r, b.face_idx, a.r AS ar, a.face_idx AS anchor, list_dot_product(a.e, b.e) AS c
        FROM ranked a JOIN ranked b ON a.walk_id = b.walk_id AND a.r < b.r AND a.pano_idx <> b.pano_idx
        WHERE list_dot_product(a.e, b.e) >= b.tau""",
    "earlier": """
        SELECT k.walk_id, k.r, list(g.ar) FILTER (WHERE g.ar IS NOT NULL) AS near
        FROM ranked k LEFT JOIN edges g ON g.walk_id = k.walk_id AND g.r = k.r GROUP BY k.walk_id, k.r""",
    "walked": """
        SELECT walk_id, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept FROM level
        UNION ALL
        SELECT w.walk_id, w.step + 1, CASE WHEN coalesce(list_has_any(w.kept, d.near), false) THEN w.kept
                                           ELSE list_append(w.kept, d.r) END
        FROM walked w JOIN earlier d ON d.walk_id = w.walk_id AND d.r = w.step + 1""",
    "kept_ranks": "SELECT walk_id, unnest(arg_max(kept, step)) AS r FROM walked GROUP BY walk_id",
    "absorbed": """
        SELECT walk_id, face_idx, anchor, c FROM (
            SELECT g.*, row_number() OVER (PARTITION BY g.walk_id, g.face_idx ORDER BY c DESC, ar) AS place
            FROM edges g JOIN kept_ranks k ON k.walk_id = g.walk_id AND k.r = g.ar
            WHERE NOT EXISTS (SELECT 1 FROM kept_ranks o WHERE o.walk_id = g.walk_id AND o.r = g.r)) WHERE place = 1""",
    "greedy": """
        SELECT k.walk_id, k.face_idx, o.r IS NOT NULL AS kept, CAST(a.anchor AS INT) AS anchor, a.c AS cosine
        FROM ranked k LEFT JOIN kept_ranks o ON o.walk_id = k.walk_id AND o.r = k.r
        LEFT JOIN absorbed a ON a.walk_id = k.walk_id AND a.face_idx = k.face_idx""",
    "ratios": """
        SELECT a.walk_id, a.face_idx, CASE WHEN median(b.sharpness) > 0 THEN any_value(a.sharpness) / median(b.sharpness)
                                           ELSE 1 END AS ratio
        FROM pool a JOIN pool b ON a.walk_id = b.walk_id AND a.yaw = b.yaw AND abs(a.t_sec - b.t_sec) <= 45
        GROUP BY a.walk_id, a.face_idx""",
    "chosen": """
        SELECT p.*, g.anchor, g.cosine, g.kept AND NOT s AS kept, g.kept AND s AS solo FROM (
            SELECT g.*, NOT EXISTS (SELECT 1 FROM absorbed a WHERE a.walk_id = g.walk_id AND a.anchor = g.face_idx)
                        AND ratio < (SELECT floor FROM solo_floor) AS s
            FROM greedy g JOIN ratios USING (walk_id, face_idx)) g
        JOIN pool p USING (walk_id, face_idx)""",
    # ---- review
    "review_state": """
        SELECT walk_id, anchor, arg_max(pick, id) FILTER (WHERE action = 'pick') AS pick,
               arg_max(action, id) = 'drop' AS dropped FROM decisions GROUP BY walk_id, anchor""",
    "picks": """
        SELECT a.walk_id, a.face_idx AS anchor_idx, a.path AS anchor,
               CASE WHEN f.face_idx = a.face_idx OR f.anchor = a.face_idx THEN f.face_idx ELSE a.face_idx END AS pick_idx,
               coalesce(s.dropped, false) AS dropped, s.walk_id IS NOT NULL AS decided
        FROM chosen a LEFT JOIN review_state s ON s.walk_id = a.walk_id AND s.anchor = a.path
        LEFT JOIN chosen f ON f.walk_id = a.walk_id AND f.path = s.pick WHERE a.kept""",
    "shipped": """
        SELECT p.walk_id, anchor_idx, pick_idx, path AS source_face, pano_idx, t_sec, yaw, pick_idx <> anchor_idx AS overridden
        FROM picks p JOIN chosen f ON f.walk_id = p.walk_id AND f.face_idx = p.pick_idx WHERE NOT dropped""",
    "counted": """
        SELECT walk_id, count(*) FILTER (WHERE dropped) AS dropped,
               count(*) FILTER (WHERE NOT dropped AND pick_idx <> anchor_idx) AS overridden FROM picks GROUP BY walk_id""",
    "members": """
        SELECT walk_id, CASE WHEN kept THEN face_idx ELSE anchor END AS anchor_idx, face_idx, kept AS is_anchor, cosine, sharpness
        FROM chosen WHERE kept OR anchor IS NOT NULL""",
    # ---- masks
    "shares": """
        SELECT walk_id, path, CAST(row_number() OVER (PARTITION BY walk_id, path ORDER BY n DESC, first) AS INT) AS rank,
               CAST(t.class_id AS INT) AS class_id, coalesce(l.label, CAST(t.class_id AS VARCHAR)) AS class, round_even(n / 64, 4) AS share
        FROM (SELECT walk_id, path, v // 64 AS class_id, count(*) AS n, min(px) AS first FROM pixels GROUP BY ALL) t
        LEFT JOIN labels_of l ON l.class_id = t.class_id WHERE n / 64 >= 0.01""",
    "kept_shares": "SELECT s.* FROM shares s JOIN chosen f ON f.walk_id = s.walk_id AND f.path = s.path WHERE f.kept",
    "mix": """
        SELECT walk_id, CAST(place AS INT) AS rank, class, round_even(total / (n * 10000), 3) AS share FROM (
            SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY total DESC, class) AS place FROM (
                SELECT walk_id, class, sum(CAST(round_even(share * 10000, 0) AS BIGINT)) AS total FROM kept_shares GROUP BY ALL))
        JOIN (SELECT walk_id, count(*) AS n FROM chosen WHERE kept GROUP BY 1) USING (walk_id) WHERE place <= 6""",
    "stored": f"""
        SELECT c_custkey AS walk_id, section, field, CASE WHEN section = 'gate' AND field = 'dead'
               AND c_mktsegment = 'BUILDING' THEN '0.2' ELSE value END AS value
        FROM customer, ({_values(STORED)}) s(section, field, value)""",
    "options": f"SELECT * FROM ({_values([(i, *row) for i, row in enumerate(ASKED)])}) o(i, section, field, value)",
    "requests": f"""
        SELECT request_id, walk_id, section, field, arg_max(value, i) AS value FROM (
            SELECT o_orderkey AS request_id, o_custkey AS walk_id, unnest(list_distinct(
                   [o_orderkey % {len(ASKED)}, (o_orderkey // {len(ASKED)}) % {len(ASKED)}])) AS pick FROM orders) r
        JOIN options o ON o.i = r.pick GROUP BY request_id, walk_id, section, field""",
    # equirectangular pixels and their faces
    "equirect": "SELECT vec_id // 2 AS pano_id, y, x + 8 * (vec_id % 2) AS x, v FROM pixels",
    "rays": """
        SELECT yaw, i, j, mx - floor(mx) AS fx, my - floor(my) AS fy, CAST(floor(mx) AS INT) AS x0, CAST(floor(my) AS INT) AS y0
        FROM (SELECT yaw, i, j, (atan2(dx, dz) / (2 * pi()) + 0.5) * 16 - 0.5 AS mx,
                     (atan2(dy, sqrt(dx * dx + dz * dz)) / pi() + 0.5) * 8 - 0.5 AS my
              FROM (SELECT yaw, i, j, u * cos(phi) + sin(phi) AS dx, w AS dy, -u * sin(phi) + cos(phi) AS dz
                    FROM (SELECT yaw, i, j, radians(yaw) AS phi,
                                 (2 * (j + 0.5::DOUBLE) / 8 - 1) * tan(radians(55)) AS u,
                                 (2 * (i + 0.5::DOUBLE) / 8 - 1) * tan(radians(55)) AS w
                          FROM (VALUES (45), (135), (225), (315)) y(yaw), range(0, 8) a(i), range(0, 8) b(j))))""",
    "strip": """
        SELECT image_id, lead_label, r.px, coalesce(v, 0) AS v FROM (
            SELECT vec_id // 16 AS image_id, arg_min(label, vec_id) AS lead_label FROM embeddings GROUP BY 1) i, range(0, 1024) r(px)
        LEFT JOIN pixels p ON p.vec_id = image_id * 16 + r.px // 64 AND p.px = r.px % 64""",
    "named_det": """
        SELECT vec_id // 4 AS frame_id, vec_id % 4 AS det_idx, e, s1, s2, s3, s4, list_reverse_sort([s1, s2, s3, s4]) AS best FROM (
            SELECT *, (p[1] + p[2]) / 2 AS s1, (p[4] + p[5]) / 2 AS s2, p[7] AS s3, p[8] AS s4 FROM (
                SELECT vec_id, e, list_transform(e[1:8], lambda x: 1 / (1 + exp(-10 * x))) AS p FROM faces))""",
}

# the same selection for other pools of faces
FIXED = {"pool": "SELECT * FROM twins", "level": "SELECT DISTINCT walk_id, 0.94::DOUBLE AS tau FROM twins"}
AGAIN = {"level": """
            SELECT walk_id, round(quantile_cont(c, 0.80), 4) AS tau FROM far_ranks GROUP BY walk_id""",
         "solo_floor": "SELECT 0.3::DOUBLE AS floor"}

# every walk once per threshold
SWEEP = {"pool": "SELECT f.* REPLACE (walk_id * 100 + k AS walk_id) FROM faces f, range(10) t(k)",
         "level": "SELECT DISTINCT walk_id * 100 + k AS walk_id, (15 + 3 * k)::DOUBLE / 100 AS tau FROM faces, range(10) t(k)"}

_MANIFEST_TEXT = """
    SELECT walk_id, face_idx, CAST(pano_idx AS VARCHAR) AS pano_idx, printf('%.1f', t_sec) AS t_sec,
           CAST(yaw AS VARCHAR) AS yaw, path, CASE WHEN kept THEN '1' ELSE '0' END AS kept,
           coalesce(CAST(anchor AS VARCHAR), '') AS anchor, coalesce(printf('%.4f', cosine), '') AS cosine,
           printf('%.2f', sharpness) AS sharpness FROM chosen"""

_EXPORT = """
    SELECT 'frames/' || concat_ws('_', nullif(trim(regexp_replace(lower(w.site), '[^a-z0-9]+', '-', 'g'), '-'), ''),
               nullif(trim(regexp_replace(lower(w.building), '[^a-z0-9]+', '-', 'g'), '-'), ''), s.walk_id)
               || printf('_t%06.1f_y%03d.jpg', s.t_sec, s.yaw) AS file,
           CAST(s.walk_id AS VARCHAR) AS walk, w.site, w.building, w.stage, w.shot_date, round(s.t_sec, 1) AS t_sec,
           s.yaw, s.pano_idx, s.source_face, s.pick_idx, CAST(s.overridden AS INT) AS overridden,
           coalesce(c.classes, '') AS classes
    FROM shipped s LEFT JOIN walks w USING (walk_id)
    LEFT JOIN (SELECT walk_id, path, string_agg(class || ' ' || printf('%.2f', share), '; ' ORDER BY rank) AS classes
               FROM kept_shares WHERE rank <= 6 GROUP BY walk_id, path) c
      ON c.walk_id = s.walk_id AND c.path = s.source_face"""

_META = """
    SELECT {key} AS walk_id, coalesce(p_site, site, '') AS site, coalesce(p_building, building, '') AS building,
           coalesce(p_floor, floor, '') AS floor, coalesce(stage, '') AS stage, coalesce(operator, '') AS operator,
           coalesce(TRY_CAST(p_mount AS INT), mount_height_cm) AS mount_height_cm, coalesce(shot_date, '') AS shot_date,
           coalesce(shot_time, '') AS shot_time, coalesce(p_camera, camera, '') AS camera
    FROM walks w {join} JOIN patches p ON p.walk_id = w.walk_id"""

_WALKS = """
    SELECT w.walk_id, w.site, coalesce(f.n, 0) AS faces, coalesce(f.anchors, 0) - coalesce(r.dropped, 0) AS kept,
           coalesce(f.n, 0) > 0 AS ready, o.stage AS failed_stage
    FROM walks w LEFT JOIN (SELECT walk_id, count(*) AS n, count(*) FILTER (WHERE kept) AS anchors FROM chosen GROUP BY 1) f USING (walk_id)
    LEFT JOIN counted r USING (walk_id) LEFT JOIN open_failures o USING (walk_id)"""

_SELECTED = "SELECT walk_id, face_idx, pano_idx, yaw, path, kept, anchor, round(cosine, 4) AS cosine, solo FROM chosen"

_NEIGHBOUR_EDGE = """
    SELECT p.walk_id, p.path, p.px, bool_or(q.v // 64 <> p.v // 64) AS edge FROM pixels p JOIN pixels q
    ON q.vec_id = p.vec_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY p.walk_id, p.path, p.px"""


def _laplacian(low: int, high: int) -> str:
    """Variance of the Laplacian of rows low..high-1 times the squared pixel count; borders mirror."""
    rows = high - low
    mirror = lambda c, top: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > {top} THEN 2 * {top} - ({c}) ELSE {c} END"
    at = lambda dy, dx: (f"m[({mirror(f'y + {dy}', rows - 1)} + {low}) * 8 + ({mirror(f'x + {dx}', 7)}) + 1]")
    lap = f"CAST({at(-1, 0)} + {at(1, 0)} + {at(0, -1)} + {at(0, 1)} - 4 * {at(0, 0)} AS BIGINT)"
    return f"""
        SELECT vec_id, CAST({rows * 8} * sum(d * d) - sum(d) * sum(d) AS BIGINT) AS s
        FROM (SELECT vec_id, {lap} AS d FROM
              (SELECT vec_id, list(v ORDER BY px) AS m FROM pixels GROUP BY vec_id), range(0, {rows}) a(y), range(0, 8) b(x))
        GROUP BY vec_id"""


QUERIES = {
    "recording_catalogue": """
        SELECT f.recording_id, f.video, s.name AS back_lens, f.files, f.circles,
               f.circles * CASE WHEN s.name IS NULL THEN 1 ELSE 2 END AS lenses,
               CASE WHEN f.shot_date <> '' THEN f.shot_date
                    ELSE substr(video, 5, 4) || '-' || substr(video, 9, 2) || '-' || substr(video, 11, 2) END AS shot_date,
               substr(video, 14, 2) || ':' || substr(video, 16, 2) AS shot_time,
               CASE WHEN has_back AND NOT has_front THEN 'back lens only'
                    WHEN circles = 1 AND files < 2 THEN 'one lens of a pair' ELSE '' END AS problem
        FROM (SELECT recording_id, arg_min(name, (CASE WHEN contains(name, '_00_') THEN 0 ELSE 10 END) + file_no) AS video, count(*) AS files,
                     CASE WHEN max(width) >= 1.5 * max(height) THEN 2 ELSE 1 END AS circles, max(shot_date) AS shot_date,
                     bool_or(contains(name, '_00_')) AS has_front, bool_or(contains(name, '_10_')) AS has_back
              FROM files GROUP BY recording_id) f
        LEFT JOIN files s ON contains(f.video, '_00_') AND s.name = replace(f.video, '_00_', '_10_')""",
    "torn_frames": """
        SELECT d.doc_id, octet_length(encode(d.text)) + 2 AS bytes FROM documents d
        WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) AND octet_length(encode(d.text)) + 2 >= 128""",
    "pano_index": """
        SELECT user_id AS walk_id, event_id AS frame_no, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pano_idx,
               round(event_id / 29.97::DOUBLE, 4) AS t_sec FROM events""",
    "missing_panos": """
        SELECT walk_id, count(*) AS missing, min(pano_idx) AS first_missing FROM (
            SELECT user_id AS walk_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pano_idx
            FROM events) WHERE event_type = 'error' GROUP BY walk_id""",
    "manifest": _MANIFEST_TEXT,
    "manifest_read_back": f"""
        SELECT walk_id, face_idx, CAST(pano_idx AS INT) AS pano_idx, CAST(t_sec AS DOUBLE) AS t_sec, CAST(yaw AS INT) AS yaw, path,
               kept = '1' AS kept, CAST(nullif(anchor, '') AS INT) AS anchor, CAST(nullif(cosine, '') AS DOUBLE) AS cosine,
               CAST(sharpness AS DOUBLE) AS sharpness FROM ({_MANIFEST_TEXT})""",
    "vector_alignment": """
        SELECT walk_id, count(*) AS faces, count(*) FILTER (WHERE e[1] <= 0.25) AS vectors,
               count(*) FILTER (WHERE e[1] > 0.25) AS without_vector, CAST(0 AS BIGINT) AS without_face,
               count(*) FILTER (WHERE e[1] > 0.25) = 0 AS aligned FROM faces GROUP BY walk_id""",
    "run_history": "SELECT walk_id, seq, recency, faces, anchors, solo FROM run_log",
    "segmentation_labels": """
        SELECT DISTINCT p.walk_id, CAST(v // 64 AS INT) AS class_id, l.label FROM pixels p JOIN labels_of l ON l.class_id = v // 64
        JOIN chosen f ON f.walk_id = p.walk_id AND f.path = p.path AND f.kept""",
    "segmentation_record": "SELECT * FROM kept_shares",
    "override_log": "SELECT * FROM decisions ORDER BY id",
    "failure_state": "SELECT walk_id, stage, message, seq FROM open_failures",
    "export_manifest": _EXPORT,
    "export_walk_summary": """
        SELECT c.walk_id, w.site, w.building, coalesce(s.frames, 0) AS frames, c.dropped, c.overridden,
               c.walk_id IN (SELECT walk_id FROM chosen WHERE kept) AS segmented
        FROM counted c LEFT JOIN walks w USING (walk_id)
        LEFT JOIN (SELECT walk_id, count(*) AS frames FROM shipped GROUP BY 1) s USING (walk_id)""",
    "export_payload": f"""
        SELECT file, walk, site, 'calibrated' AS rule, source_face, yaw, CASE overridden WHEN 1 THEN 'true' ELSE 'false' END AS overridden
        FROM ({_EXPORT})""",
    "frame_decimation": "SELECT walk_id, frame_no, round(frame_no / fps, 4) AS t_sec FROM wanted_frames",
    "stitch_completeness": """
        SELECT walk_id, count(a) AS requested, count(h) AS landed, count(*) FILTER (WHERE a AND h) AS wanted,
               count(*) FILTER (WHERE h AND a IS NULL) AS stale, count(a) > 0 AND count(a) = count(*) FILTER (WHERE a AND h) AS complete
        FROM (SELECT walk_id, frame_no, true AS a FROM wanted_frames) FULL JOIN
             (SELECT DISTINCT walk_id, frame_no, true AS h FROM stills) USING (walk_id, frame_no) GROUP BY walk_id""",
    "landed_wanted": """
        SELECT walk_id, frame_no, count(*) AS copies FROM stills
        WHERE (walk_id, frame_no) IN (SELECT (walk_id, frame_no) FROM wanted_frames) GROUP BY walk_id, frame_no""",
    "legibility_gate": """
        SELECT s.walk_id, pano_idx, score FROM scored s JOIN (SELECT walk_id, median(score) AS m FROM scored GROUP BY 1) USING (walk_id)
        WHERE score >= m * 0.15::DOUBLE""",
    "surviving_panos": """
        SELECT walk_id, pano_idx, score FROM scored WHERE (walk_id, pano_idx) IN (SELECT (walk_id, pano_idx) FROM chosen)""",
    "borderline_members": """
        SELECT m.walk_id, m.anchor_idx, m.face_idx, m.is_anchor, round(sharpness / best, 4) AS relative,
               coalesce(cosine < tau + 0.015::DOUBLE, false) AND NOT (m.face_idx = p.pick_idx AND NOT p.dropped) AS borderline
        FROM members m JOIN (SELECT walk_id, anchor_idx, max(sharpness) AS best FROM members GROUP BY ALL) USING (walk_id, anchor_idx)
        JOIN picks p USING (walk_id, anchor_idx)
        LEFT JOIN (SELECT walk_id, CASE WHEN walk_id % 3 = 1 THEN 0.2::DOUBLE ELSE tau END AS tau FROM far_stats WHERE walk_id % 7 <> 6) l USING (walk_id)""",
    "low_reference_pairs": "SELECT walk_id, pano, yaw, face, cosine FROM ref_pairs JOIN ref_stats USING (walk_id) WHERE cosine <= median",
    "intake_missing": """
        SELECT walk_id, missing, missing = '' AS accepted FROM (
            SELECT walk_id, concat_ws(', ', CASE WHEN building = 'MACHINERY' THEN 'building' END, CASE WHEN floor = '' THEN 'floor' END,
                   CASE WHEN walk_id % 11 = 0 THEN 'operator' END, CASE WHEN mount_height_cm IS NULL THEN 'mount height' END) AS missing FROM walks)""",
    "display_labels": """
        SELECT event_id,
               (['DINOv3 ViT-B/16', 'CLIP ViT-S/14', 'resnet50', 'nvidia/segformer-b4-finetuned-ade-512-512',
                 'facebook/mask2former-swin-large-ade-semantic'])[event_id % 5 + 1] AS backbone,
               (['vit_base_patch16_dinov3.lvd1689m', 'vit_small_patch14_clip_384.x', 'resnet50', 'SegFormer-B4 · ADE20K',
                 'Mask2Former-L · ADE20K'])[event_id % 5 + 1] AS segmenter,
               CAST(CAST(round(value) AS BIGINT) // 60 AS VARCHAR) || ':' || printf('%02d', CAST(round(value) AS BIGINT) % 60) AS clock,
               trim(regexp_replace(lower(props), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM events""",
    "sharpness": f"""
        SELECT walk_id, face_idx, w.s AS sharpness, b.s AS band_sharpness FROM faces
        JOIN ({_laplacian(0, 8)}) w USING (vec_id) JOIN ({_laplacian(2, 6)}) b USING (vec_id)""",
    "face_projection": """
        SELECT pano_id // 50 AS walk_id, CAST(pano_id % 50 AS INT) AS pano_idx, yaw,
               printf('y%03d_%05d.jpg', yaw, pano_id % 50) AS path, string_agg(printf('%02X', pixel), '' ORDER BY i, j) AS pixels
        FROM (SELECT pano_id, yaw, i, j, CAST(round_even(
                  (m[(y0 + 8) % 8 * 16 + (x0 + 16) % 16 + 1] * (1 - fx) + m[(y0 + 8) % 8 * 16 + (x0 + 17) % 16 + 1] * fx) * (1 - fy)
                + (m[(y0 + 9) % 8 * 16 + (x0 + 16) % 16 + 1] * (1 - fx) + m[(y0 + 9) % 8 * 16 + (x0 + 17) % 16 + 1] * fx) * fy, 0) AS INT) AS pixel
              FROM (SELECT pano_id, list(v::DOUBLE ORDER BY y, x) AS m FROM equirect GROUP BY pano_id), rays)
        GROUP BY pano_id, yaw""",
    "embed_faces": """
        SELECT walk_id, face_idx, round(v[1]::FLOAT::DOUBLE, 4) + 0 AS v0, round(v[6]::FLOAT::DOUBLE, 4) + 0 AS v5, round(v[16]::FLOAT::DOUBLE, 4) + 0 AS v15
        FROM (SELECT walk_id, face_idx, list_transform(c, lambda z: z / sqrt(list_dot_product(c, c))) AS v
              FROM (SELECT walk_id, face_idx, list_transform(m, lambda z: z - list_avg(m)) AS c
                    FROM (SELECT walk_id, face_idx, list(a ORDER BY cy, cx) AS m
                          FROM (SELECT walk_id, face_idx, y // 2 AS cy, x // 2 AS cx, avg(v) AS a FROM pixels GROUP BY ALL) GROUP BY ALL)))""",
    "l2_normalise": """
        SELECT vec_id, 1.0::DOUBLE AS length, round((e[1] / sqrt(list_dot_product(e, e)))::FLOAT::DOUBLE, 4) + 0 AS v0 FROM faces""",
    "thumbnails": """
        SELECT name, 1 AS height, string_agg(printf('%02X', CASE WHEN image_id % 2 = 1 THEN first
                     ELSE CAST(round_even(mean, 0) AS INT) END), '' ORDER BY cell) AS pixels
        FROM (SELECT image_id, lead_label, 'p' || image_id || CASE WHEN image_id % 2 = 1 THEN '.png' ELSE '.jpg' END AS name,
                     px % 512 // 2 AS cell, avg(v) AS mean, arg_min(v, px) AS first FROM strip GROUP BY image_id, lead_label, cell)
        WHERE lead_label <= 4 OR lead_label = 3 GROUP BY image_id, name""",
    "segment_kept": """
        SELECT p.walk_id, p.path, string_agg(printf('%02X', v // 64), '' ORDER BY px) AS mask FROM pixels p
        JOIN chosen f ON f.walk_id = p.walk_id AND f.path = p.path AND f.kept GROUP BY p.walk_id, p.path""",
    "detection_labels": """
        SELECT frame_id, det_idx, CAST(list_position([s1, s2, s3, s4], best[1]) AS INT) AS class_id, round(best[1], 4) AS score,
               round(((e[9] + 1) / 2 - (e[11] + 1) / 4) * 1024, 4) + 0 AS x0, round(((e[10] + 1) / 2 - (e[12] + 1) / 4) * 1024, 4) + 0 AS y0,
               round(((e[9] + 1) / 2 + (e[11] + 1) / 4) * 1024, 4) + 0 AS x1, round(((e[10] + 1) / 2 + (e[12] + 1) / 4) * 1024, 4) + 0 AS y1
        FROM named_det WHERE best[1] > 0.6 AND best[1] - best[2] >= 0.05""",
    "mask_composite": """
        SELECT frame_id, string_agg(printf('%02X', class_id), '' ORDER BY px) AS mask
        FROM (SELECT frame_id, px, coalesce(arg_max(class_id, (-area, score, det_idx)) FILTER (WHERE v > 128), 0) AS class_id
              FROM (SELECT p.vec_id // 4 AS frame_id, p.vec_id % 4 AS det_idx, px, v, p.label % 5 + 1 AS class_id, abs(e[2]) AS score,
                           count(*) FILTER (WHERE v > 128) OVER (PARTITION BY p.vec_id) AS area
                    FROM pixels p JOIN faces f USING (vec_id)) GROUP BY frame_id, px) GROUP BY frame_id""",
    "mask_boundaries": f"""
        SELECT walk_id, path, count(*) FILTER (WHERE edge) AS edge_pixels,
               string_agg(CASE WHEN edge THEN '01' ELSE '00' END, '' ORDER BY px) AS edges FROM ({_NEIGHBOUR_EDGE}) GROUP BY walk_id, path""",
    "far_pairs": "SELECT walk_id, yaw, round(c, 4) + 0 AS cosine, count(*) AS pairs FROM far GROUP BY ALL",
    "reference_pairs": "SELECT * FROM ref_pairs",
    "similarity_edges": """
        SELECT walk_id, face_idx, count(*) AS neighbours, round(max(c), 4) AS best_cosine, CAST(arg_max(other, c) AS INT) AS best_face
        FROM (SELECT a.walk_id, a.face_idx, b.face_idx AS other, list_dot_product(a.e, b.e) AS c FROM faces a JOIN faces b
              ON a.walk_id = b.walk_id AND a.pano_idx <> b.pano_idx JOIN level l ON l.walk_id = a.walk_id
              WHERE list_dot_product(a.e, b.e) >= tau) GROUP BY walk_id, face_idx""",
    "resolve_pick": "SELECT * FROM picks",
    "effective_picks": "SELECT * FROM shipped",
    "validate_decisions": """
        SELECT id, walk_id, anchor_idx, action, pick_idx, reason, CASE WHEN reason = '' THEN path END AS anchor,
               CASE WHEN reason = '' AND action = 'pick' THEN pick_path END AS pick
        FROM (SELECT d.*, a.path, p.path AS pick_path,
                     CASE WHEN d.action = 'zoom' THEN 'unknown action' WHEN a.path IS NULL THEN 'not a kept anchor'
                          WHEN d.action = 'pick' AND NOT coalesce(p.path IS NOT NULL AND (d.pick_idx = d.anchor_idx OR p.anchor = d.anchor_idx), false)
                          THEN 'not in the group' ELSE '' END AS reason
              FROM raw_decisions d LEFT JOIN chosen a ON a.walk_id = d.walk_id AND a.face_idx = d.anchor_idx AND a.kept
              LEFT JOIN chosen p ON p.walk_id = d.walk_id AND p.face_idx = d.pick_idx)""",
    "review_groups": """
        SELECT m.walk_id, m.anchor_idx, m.face_idx, m.is_anchor, round(m.cosine, 4) AS cosine, p.pick_idx, p.dropped
        FROM members m JOIN picks p USING (walk_id, anchor_idx)""",
    "segmentation_view": """
        SELECT f.walk_id, f.path AS face, CASE WHEN c.kept THEN c.t_sec ELSE 0 END AS t_sec, CASE WHEN c.kept THEN c.yaw ELSE 0 END AS yaw,
               coalesce(s.classes, '') AS classes
        FROM faces f JOIN chosen c ON c.walk_id = f.walk_id AND c.face_idx = f.face_idx
        LEFT JOIN (SELECT walk_id, path, string_agg(class, ';' ORDER BY rank) AS classes FROM kept_shares GROUP BY ALL) s
          ON s.walk_id = f.walk_id AND s.path = f.path""",
    "walk_list": _WALKS,
    "calibrated_tau": "SELECT walk_id, n, tau FROM far_stats",
    "calibration_record": """
        SELECT f.walk_id, f.tau, 5.0::DOUBLE AS false_merge_pct, coalesce(r.n > 0 AND r.median >= 0.95, false) AS healthy,
               coalesce(r.n, 0) AS pairs, f.n AS far_n, f.median AS far_median, f.p95 AS far_p95, f.p99 AS far_p99, f.max AS far_max,
               least(f.n, 5000) AS sketch, coalesce(r.n, 0) AS ref_n, coalesce(r.median, 0) AS ref_median,
               coalesce(r.p05, 0) AS ref_p05, coalesce(r.min, 0) AS ref_min FROM far_stats f LEFT JOIN ref_stats r USING (walk_id)""",
    "record_round_trip": "SELECT f.walk_id, f.tau, f.n AS far_n, coalesce(r.n, 0) AS pairs FROM far_stats f LEFT JOIN ref_stats r USING (walk_id)",
    "far_sketch": """
        SELECT k.walk_id, k.i AS position, f.c AS cosine
        FROM (SELECT walk_id, i, CAST(round_even(i * ((n - 1) / 99.0::DOUBLE), 0) AS BIGINT) AS r
              FROM (SELECT walk_id, count(*) AS n FROM far GROUP BY walk_id), range(0, 100) t(i)) k
        JOIN far_ranks f ON f.walk_id = k.walk_id AND f.r = k.r""",
    "requantile": """
        SELECT walk_id, round(quantile_cont(c, 0.98), 4) AS tau, count(*) AS far_n, round(quantile_cont(c, 0.99), 4) AS far_p99
        FROM far_ranks GROUP BY walk_id""",
    "merged_thresholds": """
        SELECT walk_id, yaw, n, min(c) FILTER (WHERE r >= ceil(round(0.5 * n, 6))) AS median, min(c) FILTER (WHERE r >= ceil(round(0.95 * n, 6))) AS p95,
               min(c) FILTER (WHERE r >= ceil(round(0.99 * n, 6))) AS p99, max(c) AS max,
               CASE WHEN n >= 50 THEN min(c) FILTER (WHERE r >= ceil(round(0.95 * n, 6))) END AS tau
        FROM (SELECT walk_id, yaw, c, row_number() OVER w AS r, count(*) OVER (PARTITION BY walk_id, yaw) AS n
              FROM (SELECT CASE WHEN level < 2 THEN walk_id END AS walk_id, CASE WHEN level < 1 THEN yaw END AS yaw, round(c, 4) + 0 AS c
                    FROM far, range(3) t(level)) WINDOW w AS (PARTITION BY walk_id, yaw ORDER BY c))
        GROUP BY walk_id, yaw, n""",
    "job_counts_stream": f"""
        SELECT user_id AS job, {STAGE_LIST}[event_id % 7 + 1] AS name, arg_max(CAST(floor(value * 10) AS BIGINT), event_id) AS value
        FROM events WHERE event_type <> 'click' GROUP BY ALL""",
    "class_shares": "SELECT * FROM shares",
    "class_mix": "SELECT * FROM mix",
    "stage_counts": """
        SELECT r.walk_id, r.frames, r.seconds, r.width || 'x' || r.height AS source, r.lenses, coalesce(p.n, 0) AS panos,
               coalesce(f.sharp, 0) AS sharp, coalesce(f.n, 0) AS faces, coalesce(rs.n, 0) AS pairs, coalesce(fs.n, 0) AS far_pairs,
               coalesce(f.anchors, 0) AS segmented, coalesce(f.anchors, 0) AS anchors, coalesce(l.solo, 0) AS solo,
               coalesce(c.dropped, 0) AS dropped, coalesce(c.overridden, 0) AS overridden, coalesce(rs.median, 0) AS reference,
               coalesce(fs.tau, 0) AS calib_tau, coalesce(f.n - f.anchors, 0) AS absorbed,
               coalesce(f.anchors, 0) - coalesce(c.dropped, 0) AS kept,
               coalesce(m.class_mix, '') AS class_mix
        FROM recs r LEFT JOIN (SELECT walk_id, string_agg(class, ',' ORDER BY rank) AS class_mix FROM mix GROUP BY 1) m USING (walk_id) LEFT JOIN (SELECT walk_id, count(*) AS n FROM scored GROUP BY 1) p USING (walk_id)
        LEFT JOIN (SELECT walk_id, count(*) AS n, count(DISTINCT pano_idx) AS sharp, count(*) FILTER (WHERE kept) AS anchors FROM chosen GROUP BY 1) f USING (walk_id)
        LEFT JOIN ref_stats rs USING (walk_id) LEFT JOIN far_stats fs USING (walk_id) LEFT JOIN counted c USING (walk_id)
        LEFT JOIN (SELECT walk_id, solo FROM run_log WHERE recency = 1) l USING (walk_id)""",
    "review_counts": "SELECT * FROM counted",
    "selection_summary": """
        SELECT walk_id, 'calibrated' AS rule, fs.tau, c.faces, c.anchors, c.faces - c.anchors AS absorbed, c.solo,
               coalesce(rs.median, 0) AS reference, coalesce(rs.n, 0) AS pairs, fs.n AS far_pairs, fs.p99 AS far_p99,
               5.0::DOUBLE AS false_merge_pct, 'grid' AS backbone, 'gate' AS entered
        FROM (SELECT walk_id, count(*) AS faces, count(*) FILTER (WHERE kept) AS anchors, count(*) FILTER (WHERE solo) AS solo FROM chosen GROUP BY 1) c
        JOIN far_stats fs USING (walk_id) LEFT JOIN ref_stats rs USING (walk_id)""",
    "heading_ratio": "SELECT walk_id, face_idx, round(ratio, 4) AS ratio FROM ratios",
    "sample_panos": """
        SELECT walk_id, pano_idx FROM scored JOIN (SELECT walk_id, count(*) AS n FROM scored GROUP BY 1) USING (walk_id)
        WHERE list_contains(list_transform(range(0, 10), lambda i: CAST(round_even(i * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT)), pano_idx)""",
    "decision_replay": "SELECT * FROM review_state",
    "stage_durations": """
        SELECT job, stage, seq, round((epoch_us(moment) - epoch_us(before)) / 1e6, 1) AS seconds FROM (
            SELECT *, lag(status) OVER w AS was, lag(moment) OVER w AS before FROM progress WHERE status IN ('running', 'done')
            WINDOW w AS (PARTITION BY job, stage ORDER BY seq)) WHERE status = 'done' AND was = 'running'""",
    "greedy_dedup": "SELECT walk_id, face_idx, kept, anchor, round(cosine, 4) AS cosine FROM greedy",
    "solo_drop": "SELECT walk_id, face_idx, path FROM chosen WHERE solo",
    "select": _SELECTED,
    "threshold_rule": """
        SELECT w.walk_id, CASE WHEN building = 'BUILDING' THEN 'fixed' ELSE 'calibrated' END AS rule,
               CASE WHEN building = 'BUILDING' THEN 0.94::DOUBLE ELSE f.tau END AS tau,
               CASE WHEN building = 'BUILDING' THEN '' WHEN f.walk_id IS NULL THEN 'no calibration record'
                    WHEN f.tau IS NULL THEN 'too few far pairs' ELSE '' END AS problem FROM walks w LEFT JOIN far_stats f USING (walk_id)""",
    "meta_upsert": _META.format(key="coalesce(w.walk_id, p.walk_id)", join="FULL"),
    "meta_patch": _META.format(key="w.walk_id", join="LEFT"),
    "meta_patch_missing": """
        SELECT walk_id, count(*) AS changes FROM changes WHERE walk_id NOT IN (SELECT walk_id FROM walks) GROUP BY walk_id""",
    "meta_unknown_fields": "SELECT field, count(*) AS changes FROM changes WHERE field = 'colour' GROUP BY field",
    "forget_walks": "SELECT walk_id, site, building FROM walks WHERE walk_id NOT IN (SELECT walk_id FROM gone)",
    "forget_decisions": "SELECT * FROM decisions WHERE walk_id NOT IN (SELECT walk_id FROM gone)",
    "decision_replay_stream": "SELECT * FROM review_state",
    "stage_board_stream": """
        SELECT job, stage, arg_max(status, seq) AS status, max(seq) AS last_seq, count(*) AS events FROM progress GROUP BY job, stage""",
    "rerun_plan": """
        SELECT request_id, walk_id, outcome, CASE WHEN live THEN first_stage END AS first_stage, CASE WHEN live THEN changed ELSE '' END AS changed,
               live AND first_no <= 5 AS needs_video
        FROM (SELECT *, outcome IN ('inline', 'queued') AS live FROM (
            SELECT *, CASE WHEN NOT ok THEN 'rejected' WHEN first_no IS NULL THEN 'unchanged' WHEN first_no = 6 THEN 'inline' ELSE 'queued' END AS outcome,
                   (['stitch','gate','faces','embed','calibrate','select','segment'])[first_no] AS first_stage
            FROM (SELECT request_id, walk_id, ok, changed,
                         CASE WHEN changed = 'calib.false_merge_pct' AND sketch THEN 6 ELSE stage_no END AS first_no
                  FROM (SELECT q.request_id, q.walk_id, any_value(c.c_acctbal > 0) AS sketch,
                               bool_and(NOT ((q.field = 'dead' AND q.value = '1.0') OR q.value IN ('[0.5,0.2]', '[0,0]', '"unknown"', '["", " "]')
                                             OR (q.field = 'samples' AND (TRY_CAST(q.value AS DOUBLE) < 2 OR TRY_CAST(q.value AS DOUBLE) <> floor(TRY_CAST(q.value AS DOUBLE)))))) AS ok,
                               string_agg(q.section || '.' || q.field, ',' ORDER BY q.section || '.' || q.field) FILTER (WHERE q.new) AS changed,
                               min(CASE q.section WHEN 'gate' THEN 2 WHEN 'faces' THEN 3 WHEN 'embed' THEN 4 WHEN 'calib' THEN 5
                                                  WHEN 'dedup' THEN 6 ELSE 7 END) FILTER (WHERE q.new) AS stage_no
                        FROM (SELECT r.*, CASE WHEN field IN ('band', 'yaws') THEN TRY_CAST(TRY_CAST(r.value AS JSON) AS DOUBLE[]) <> TRY_CAST(TRY_CAST(s.value AS JSON) AS DOUBLE[])
                                               WHEN field IN ('model_name', 'rule', 'classes', 'enabled') THEN r.value <> s.value
                                               ELSE TRY_CAST(r.value AS DOUBLE) <> TRY_CAST(coalesce(s.value, '45.0') AS DOUBLE) END AS new
                              FROM requests r LEFT JOIN stored s USING (walk_id, section, field)) q JOIN customer c ON c.c_custkey = q.walk_id
                        GROUP BY q.request_id, q.walk_id))))""",
    "stalled_runs": """
        SELECT walk_id, CASE WHEN job_stage <> '' THEN job_stage WHEN c_acctbal > 1000 THEN 'gate' ELSE 'stitch' END AS stage,
               CASE WHEN job_stage IS NOT NULL THEN 'unfinished job' ELSE 'no outcome' END AS cause
        FROM (SELECT *, c_custkey AS walk_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'embed' WHEN 'MACHINERY' THEN '' END AS job_stage FROM customer)
        WHERE job_stage IS NOT NULL OR (c_acctbal > -500 AND NOT c_acctbal > 3000 AND NOT c_nationkey < 5)""",
    "retry_plan": """
        SELECT o.walk_id, o.stage AS failed_stage, CASE WHEN c.c_custkey IS NOT NULL THEN CASE WHEN o.stage = 'stitch' THEN 'start' ELSE o.stage END END AS enter_at,
               c.c_custkey IS NULL AS video_missing FROM open_failures o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.walk_id""",
    "stage_states": f"""
        SELECT walk_id, CAST(k - 1 AS INT) AS stage_no, names[k] AS stage,
               CASE WHEN k = 1 THEN 'done' WHEN faces > 0 THEN 'done' WHEN k = 9 OR failed_stage IS NULL THEN 'queued'
                    WHEN k < list_position(names, failed_stage) THEN 'done' WHEN k = list_position(names, failed_stage) THEN 'error' ELSE 'queued' END AS state
        FROM ({_WALKS}), (SELECT ['video','stitch','gate','faces','embed','calibrate','select','segment','review'] AS names), range(1, 10) r(k)""",
}
QUERIES["stage_seconds"] = f"SELECT job, stage, arg_max(seconds, seq) AS seconds FROM ({QUERIES['stage_durations']}) GROUP BY job, stage"


def _assemble(query: str, ctes: dict[str, str]) -> str:
    """The query with the building blocks it mentions, in dependency order."""
    ordered: list[str] = []

    def need(text: str, busy: tuple[str, ...]) -> None:
        for name in ctes:
            if name in ordered or name in busy or not re.search(rf"(?:FROM|JOIN|,)\s+\(?{name}\b", text):
                continue
            need(ctes[name], (*busy, name))
            ordered.append(name)

    need(query, ())
    if not ordered:
        return query
    parts = ",\n".join(f"{n} AS {'MATERIALIZED ' if n != 'walked' else ''}({ctes[n]})" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{query}"


def oracle_sql() -> dict[str, str]:
    built = {name: _assemble(q, CTES) for name, q in QUERIES.items()}
    built["select_fixed"] = _assemble(
        "SELECT walk_id, face_idx, path, kept, anchor, round(cosine, 4) AS cosine, solo FROM chosen", {**CTES, **FIXED})
    built["threshold_sweep"] = _assemble("""
        SELECT walk_id // 100 AS walk_id, (15 + 3 * (walk_id % 100))::DOUBLE / 100 AS tau, count(*) FILTER (WHERE kept) AS kept,
               count(*) FILTER (WHERE anchor IS NOT NULL) AS absorbed, count(*) FILTER (WHERE solo) AS solo
        FROM chosen GROUP BY walk_id""", {**CTES, **SWEEP})
    built["reselect"] = _assemble(
        "SELECT walk_id, face_idx, kept, anchor, round(cosine, 4) AS cosine, solo FROM chosen", {**CTES, **AGAIN})
    return built
