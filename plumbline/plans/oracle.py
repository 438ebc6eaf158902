"""SQL of the registered queries, for DuckDB over the same tables.

``STEPS`` are common table expressions; a query names the ones it needs and
``sql`` puts them, with what they need, before its text.
"""

from __future__ import annotations

import re

from plumbline.functions.dims import CLASS_NAMES, RENAMES

_NAMES = ", ".join(f"'{n}'" for n in CLASS_NAMES)

STEPS = {
    "dim": f"""SELECT sid, class_name, CAST(row_number() OVER (ORDER BY class_name) - 1 AS INTEGER) AS class_id
        FROM (SELECT CAST(i AS INTEGER) AS sid, ([{_NAMES}])[i] AS class_name FROM range(1, 36) t(i))""",
    "keyed": """SELECT l_suppkey AS scene_id,
        CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INTEGER) AS ord,
        CAST(l_partkey % 37 AS INTEGER) AS sid,
        CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE CAST(l_orderkey % 3 AS INTEGER) END AS iid,
        l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem""",
    "corners": """SELECT scene_id, ord, sid, iid,
        CASE WHEN iid = -1 THEN (p * 7) % 85 ELSE (sid * 13 + iid * 29) % 75 END + (o % 40) / 10.0::DOUBLE AS x0,
        CASE WHEN iid = -1 THEN (o * 11) % 85 ELSE (sid * 17 + iid * 23) % 75 END + (p % 40) / 10.0::DOUBLE AS y0,
        q / 2 AS w, (p % 50) / 2.0::DOUBLE AS h FROM keyed""",
    "paths": "SELECT scene_id, ord, sid, iid, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM corners",
    "pixel_paths": """SELECT * FROM (SELECT *, greatest(0, CAST(trunc(x0 * 10.24::DOUBLE) AS INTEGER)) AS px0, greatest(0, CAST(trunc(y0 * 7.68::DOUBLE) AS INTEGER)) AS py0,
        least(1024, CAST(trunc(x1 * 10.24::DOUBLE) AS INTEGER)) AS px1, least(768, CAST(trunc(y1 * 7.68::DOUBLE) AS INTEGER)) AS py1 FROM paths)
        WHERE px1 - px0 >= 8 AND py1 - py0 >= 8""",
    "unions": """SELECT scene_id, sid, iid, min(ord) AS ord, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
        FROM paths GROUP BY scene_id, sid, iid, CASE WHEN iid = -1 THEN ord END""",
    "merged": """SELECT scene_id, sid, iid, min(ord) AS ord, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
        FROM paths GROUP BY scene_id, sid, iid""",
    "boxes": """SELECT * FROM (SELECT u.scene_id, u.sid, iid, ord, coalesce(class_name, 'class_' || lpad(CAST(u.sid AS VARCHAR), 2, '0')) AS class_name, coalesce(class_id, -1) AS class_id,
        greatest(0, CAST(trunc(x0 * 10.24::DOUBLE) AS INTEGER)) AS px0, greatest(0, CAST(trunc(y0 * 7.68::DOUBLE) AS INTEGER)) AS py0,
        least(1024, CAST(trunc(x1 * 10.24::DOUBLE) AS INTEGER)) AS px1, least(768, CAST(trunc(y1 * 7.68::DOUBLE) AS INTEGER)) AS py1
        FROM unions u LEFT JOIN dim USING (sid)) WHERE px1 - px0 >= 8 AND py1 - py0 >= 8""",
    "merged_boxes": """SELECT * FROM (SELECT u.scene_id, u.sid, iid, ord, class_name, class_id,
        greatest(0, CAST(trunc(x0 * 10.24::DOUBLE) AS INTEGER)) AS px0, greatest(0, CAST(trunc(y0 * 7.68::DOUBLE) AS INTEGER)) AS py0,
        least(1024, CAST(trunc(x1 * 10.24::DOUBLE) AS INTEGER)) AS px1, least(768, CAST(trunc(y1 * 7.68::DOUBLE) AS INTEGER)) AS py1
        FROM merged u JOIN dim USING (sid)) WHERE px1 > px0 AND py1 > py0""",
    "expanded": "SELECT DISTINCT scene_id, class_name, class_id FROM boxes WHERE class_id >= 0",
    "samples": """SELECT CAST(row_number() OVER (ORDER BY scene_id, class_name) - 1 AS BIGINT) AS idx, scene_id, class_name, class_id FROM expanded""",
    "counts": "SELECT class_id, class_name, count(*) AS n FROM samples GROUP BY 1, 2",
    "inputs": """SELECT scene_id, class_id, ord, greatest(0.0::DOUBLE, least(511.0::DOUBLE, px0 * 0.5::DOUBLE)) AS ix0, greatest(0.0::DOUBLE, least(511.0::DOUBLE, px1 * 0.5::DOUBLE)) AS ix1,
        greatest(0.0::DOUBLE, least(511.0::DOUBLE, py0 * (512.0::DOUBLE / 768.0::DOUBLE))) AS iy0, greatest(0.0::DOUBLE, least(511.0::DOUBLE, py1 * (512.0::DOUBLE / 768.0::DOUBLE))) AS iy1
        FROM boxes WHERE class_id >= 0""",
    "sized": """SELECT *, (ix1 - ix0) * 0.125::DOUBLE AS w, (iy1 - iy0) * 0.125::DOUBLE AS h, (ix0 * 0.125::DOUBLE + ix1 * 0.125::DOUBLE) / 2 AS cx,
        (iy0 * 0.125::DOUBLE + iy1 * 0.125::DOUBLE) / 2 AS cy FROM inputs WHERE ix1 > ix0 AND iy1 > iy0""",
    "centres": """SELECT *, cx - x AS dx, cy - y AS dy FROM (SELECT *, CAST(floor(cx) AS INTEGER) AS x, CAST(floor(cy) AS INTEGER) AS y, greatest(1, CAST(trunc(least(w, h) / 2.5::DOUBLE) AS INTEGER)) AS radius FROM sized WHERE w > 0 AND h > 0)
        WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63""",
    "heat": """SELECT scene_id, class_id, CAST(y + gy AS INTEGER) AS y, CAST(x + gx AS INTEGER) AS x,
        max(CASE WHEN gx = 0 AND gy = 0 THEN 1.0::DOUBLE ELSE exp(-(gx * gx + gy * gy) / (2 * greatest(radius / 3.0::DOUBLE, 0.5::DOUBLE) * greatest(radius / 3.0::DOUBLE, 0.5::DOUBLE))) END) AS heat
        FROM (SELECT scene_id, class_id, x, y, radius, gy, unnest(range(-radius, radius + 1)) AS gx FROM (SELECT *, unnest(range(-radius, radius + 1)) AS gy FROM centres))
        WHERE x + gx BETWEEN 0 AND 63 AND y + gy BETWEEN 0 AND 63 GROUP BY ALL""",
    "winners": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY scene_id, class_id, y, x) AS n_centres,
        row_number() OVER (PARTITION BY scene_id, class_id, y, x ORDER BY CAST(w * h AS FLOAT) DESC, ord DESC) AS r FROM centres) WHERE r = 1""",
    "preds": """SELECT h.scene_id, h.class_id, h.y, h.x, heat * (0.5::DOUBLE + 0.5::DOUBLE * ((h.scene_id * 131 + h.class_id * 17 + h.y * 448 + h.x * 13) % 1000) / 1000.0::DOUBLE) AS score,
        coalesce(w, 0.0) * 1.5 + 0.25 AS w, coalesce(winners.h, 0.0) * 0.5 + 0.25 AS h, coalesce(dx, 0.5) * 0.5 AS dx, coalesce(dy, 0.5) * 0.5 AS dy
        FROM heat h LEFT JOIN winners USING (scene_id, class_id, y, x)""",
    "cells": """SELECT p.scene_id, p.class_id, p.y, p.x, p.score, t.heat, p.w, p.h, p.dx, p.dy, coalesce(c.w, 0) AS tw, coalesce(c.h, 0) AS th, coalesce(c.dx, 0) AS tdx, coalesce(c.dy, 0) AS tdy,
        CASE WHEN c.r = 1 THEN 1.0::DOUBLE ELSE 0 END AS mask, p.scene_id % 7 AS epoch, p.scene_id AS batch_id
        FROM preds p JOIN heat t USING (scene_id, class_id, y, x) LEFT JOIN winners c USING (scene_id, class_id, y, x)""",
    "focal": """SELECT epoch, batch_id, num_pos, CASE WHEN num_pos = 0 THEN -neg / (4096 * s) ELSE -(pos + neg) / num_pos END AS focal FROM (
        SELECT epoch, batch_id, count(DISTINCT class_id) AS s, sum(CASE WHEN heat = 1 THEN ln(p) * (1 - p) * (1 - p) ELSE 0 END) AS pos, CAST(sum(CASE WHEN heat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS num_pos,
        sum(CASE WHEN heat = 1 THEN 0 ELSE ln(1 - p) * p * p * pow(1 - heat, 4) END) + (4096 * count(DISTINCT class_id) - count(*)) * ln(1 - 1e-4::DOUBLE) * 1e-8::DOUBLE AS neg
        FROM (SELECT *, greatest(1e-4::DOUBLE, least(1 - 1e-4::DOUBLE, score)) AS p FROM cells) GROUP BY epoch, batch_id)""",
    "l1": """SELECT epoch, batch_id, sum((CASE WHEN abs(w - tw) < 1 THEN 0.5 * (w - tw) * (w - tw) ELSE abs(w - tw) - 0.5 END + CASE WHEN abs(h - th) < 1 THEN 0.5 * (h - th) * (h - th) ELSE abs(h - th) - 0.5 END) * mask) / (sum(mask * 2) + 1e-4::DOUBLE) AS size_l1,
        sum((CASE WHEN abs(dx - tdx) < 1 THEN 0.5 * (dx - tdx) * (dx - tdx) ELSE abs(dx - tdx) - 0.5 END + CASE WHEN abs(dy - tdy) < 1 THEN 0.5 * (dy - tdy) * (dy - tdy) ELSE abs(dy - tdy) - 0.5 END) * mask) / (sum(mask * 2) + 1e-4::DOUBLE) AS offset_l1
        FROM cells GROUP BY epoch, batch_id""",
    "losses": "SELECT epoch, batch_id, 10 * focal + size_l1 + offset_l1 AS loss, focal, size_l1, offset_l1, num_pos FROM focal JOIN l1 USING (epoch, batch_id)",
    "maxima": """SELECT * FROM (SELECT *, greatest(score, coalesce(max(score) OVER (PARTITION BY scene_id, class_id ORDER BY y * 65 + x RANGE BETWEEN 66 PRECEDING AND 64 PRECEDING), score),
        max(score) OVER (PARTITION BY scene_id, class_id ORDER BY y * 65 + x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING),
        coalesce(max(score) OVER (PARTITION BY scene_id, class_id ORDER BY y * 65 + x RANGE BETWEEN 64 FOLLOWING AND 66 FOLLOWING), score)) AS best FROM preds) WHERE score = best""",
    "ranked": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scene_id, class_id ORDER BY score DESC, y * 64 + x) AS INTEGER) AS rank FROM maxima) WHERE rank <= 50 AND score >= 0.3",
    "metrics": "SELECT user_id % 5 AS run, event_id % 50 AS epoch, event_id AS step, value AS loss FROM events",
    "epochs": "SELECT run, epoch, avg(loss) AS loss FROM metrics GROUP BY 1, 2",
    "scenes": """SELECT CASE WHEN scene_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN scene_id % 5 = 0 THEN 'test_set' WHEN scene_id % 5 <= 2 THEN 'train_set_1' ELSE 'train_set_2' END AS source_dir,
        s.scene_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT scene_id FROM paths) s LEFT JOIN (SELECT scene_id, count(*) AS n FROM boxes GROUP BY 1) b USING (scene_id)""",
    "crops": """SELECT 'crops/' || CASE WHEN o_orderkey % 50 = 0 THEN 'original' ELSE CASE o_custkey % 9 WHEN 0 THEN 'class_06' WHEN 1 THEN 'class_08' WHEN 2 THEN 'class_10' WHEN 3 THEN 'class_25' WHEN 4 THEN 'class_32'
        WHEN 5 THEN 'class_35' WHEN 6 THEN 'wall' WHEN 7 THEN 'door_single' ELSE 'class_060' END || '_' || CAST(o_orderkey % 1000 AS VARCHAR) END || '.png' AS path, o_orderkey FROM orders""",
    "file_boxes": """SELECT *, greatest(0, CAST(trunc(x0 * (width / view)) AS INTEGER)) AS px0, greatest(0, CAST(trunc(y0 * (height / view)) AS INTEGER)) AS py0,
        least(width, CAST(trunc(x1 * (width / view)) AS INTEGER)) AS px1, least(height, CAST(trunc(y1 * (height / view)) AS INTEGER)) AS py1
        FROM (SELECT *, CAST(CASE WHEN scene_id % 13 = 6 THEN 8 ELSE 512 + 256 * (scene_id % 4) END AS INTEGER) AS width, CAST(CASE WHEN scene_id % 13 = 6 THEN 8 ELSE 384 + 128 * (scene_id % 3) END AS INTEGER) AS height,
        100 * (1 + scene_id % 2)::DOUBLE AS view, CASE WHEN scene_id % 5 = 0 THEN 'test_set' WHEN scene_id % 5 <= 2 THEN 'train_set_1' ELSE 'train_set_2' END AS source_dir FROM unions WHERE scene_id % 7 <> 0)""",
    "file_instances": """SELECT b.*, coalesce(class_name, 'class_' || lpad(CAST(b.sid AS VARCHAR), 2, '0')) AS class_name, class_id, px1 - px0 >= 8 AND py1 - py0 >= 8 AS kept FROM file_boxes b LEFT JOIN dim USING (sid) WHERE scene_id % 11 <> 0""",
    "class_boxes": """SELECT *, greatest(0, CAST(trunc(x0 * (width / view)) AS INTEGER)) AS px0, greatest(0, CAST(trunc(y0 * (height / view)) AS INTEGER)) AS py0,
        least(width, CAST(trunc(x1 * (width / view)) AS INTEGER)) AS px1, least(height, CAST(trunc(y1 * (height / view)) AS INTEGER)) AS py1
        FROM (SELECT m.*, class_name, CAST(CASE WHEN scene_id % 11 = 0 THEN 1000 WHEN scene_id % 13 = 6 THEN 8 ELSE 512 + 256 * (scene_id % 4) END AS INTEGER) AS width,
        CAST(CASE WHEN scene_id % 11 = 0 THEN 1000 WHEN scene_id % 13 = 6 THEN 8 ELSE 384 + 128 * (scene_id % 3) END AS INTEGER) AS height, 100 * (1 + scene_id % 2)::DOUBLE AS view,
        CASE WHEN scene_id % 5 = 0 THEN 'test_set' WHEN scene_id % 5 <= 2 THEN 'train_set_1' ELSE 'train_set_2' END AS source_dir FROM merged m LEFT JOIN dim USING (sid) WHERE scene_id % 7 <> 0)""",
    "subset": "SELECT idx, CAST(round(pow(greatest(1, n), -0.5) * 1073741824) AS BIGINT) AS units FROM samples JOIN counts USING (class_id) WHERE idx < 1000",
    "vectors": "SELECT vec_id, CAST(label AS INTEGER) AS class_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "means": "SELECT class_id, list(a ORDER BY pos) AS v FROM (SELECT class_id, pos, avg(v[pos]) AS a FROM vectors, range(1, 65) r(pos) GROUP BY 1, 2) GROUP BY 1",
    "names": "SELECT path, o_orderkey, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS name FROM crops",
}


#: Steps that others name twice.
ONCE = ("boxes", "centres", "heat", "winners", "preds", "cells")


def sql(query: str) -> str:
    """``query`` after the steps that it needs, in order."""
    needed: set[str] = set()
    text = query
    # A step needs earlier ones only, so one walk backwards finds them all.
    for step in reversed(STEPS):
        if re.search(rf"\b{step}\b", text):
            needed.add(step)
            text += STEPS[step]
    # In order of definition, which is an order of need.
    steps = [s for s in STEPS if s in needed]
    return ("WITH " + ",\n".join(f"{s} AS {'MATERIALIZED ' if s in ONCE else ''}({STEPS[s]})" for s in steps) + "\n" if steps else "") + query


_RENAME = "CASE " + " ".join(f"WHEN starts_with(name, '{a}_') THEN '{b}' || substr(name, {len(a) + 1})" for a, b in RENAMES.items()) + " ELSE name END"
_RULE = "CASE " + " ".join(f"WHEN starts_with(name, '{a}_') THEN '{a}'" for a in RENAMES) + " END"
#: Horner's rule over 16-bit parts of the digest.
_WORD = "1 + list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 30, 4), lambda i: CAST('0x' || substr(md5(w), i, 4) AS BIGINT))), lambda a, x: (a * 65536 + x) % 31999)"
_WORDS = "(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> ''))[1:32]"


def _tokens(text: str) -> str:
    ids = f"list_transform({_WORDS.format(text=text)}, lambda w: {_WORD})"
    return f"array_to_string(list_resize({ids}, 32, 0::BIGINT), ' ')"


_UNIFORM = "((((12345 * 48271 + {a}) % 2147483647) * 48271 + {b}) % 2147483647 * 48271) % 2147483647 / 2147483647.0::DOUBLE"

_HEAD = "round(1 / (1 + exp(-list_dot_product(e.v, m.v))), 6) AS score, round(greatest(list_dot_product(e.v, m.v) - 0.25, 0.0::DOUBLE), 6) AS size"

ORACLE = {
    "class_dim": "SELECT sid, class_name, class_id, n, 'Find ' || class_name || ' in this floor plan drawing' AS prompt FROM dim JOIN (SELECT class_id, n FROM counts) USING (class_id)",
    "pixel_boxes": "SELECT scene_id, ord, sid, iid, px0, py0, px1, py1 FROM pixel_paths",
    "instance_union": "SELECT scene_id, sid, iid, ord, class_name, class_id, px0, py0, px1, py1 FROM boxes",
    "instance_union_merged": "SELECT scene_id, sid, iid, ord, class_name, class_id, px0, py0, px1, py1 FROM merged_boxes",
    "sample_expand": "SELECT idx, scene_id, class_name, class_id FROM samples",
    "class_counts": "SELECT class_id, class_name, n FROM counts",
    "class_stats_rare_common": """SELECT * FROM (SELECT class_id, class_name, n, CAST(row_number() OVER (ORDER BY n, f) AS INTEGER) AS low, CAST(row_number() OVER (ORDER BY n DESC, f DESC) AS INTEGER) AS high, min(n) OVER () AS least, max(n) OVER () AS most
        FROM (SELECT class_id, class_name, count(*) AS n, min(idx) AS f FROM samples GROUP BY 1, 2)) WHERE low <= 5 OR high <= 5""",
    "sample_weights": "SELECT idx, s.class_id, n, round(pow(greatest(1, n), -0.5), 6) AS weight FROM samples s JOIN counts USING (class_id)",
    "weighted_sample": f"""SELECT draw, c.class_id, r.idx AS pick FROM (SELECT draw, class_id, least(CAST(floor(v * n) AS BIGINT), n - 1) AS rank FROM (
        SELECT draw, v, d.class_id, d.n, row_number() OVER (PARTITION BY draw ORDER BY d.upper) AS k FROM (SELECT idx AS draw, {_UNIFORM.format(a="idx", b=1)} AS u, {_UNIFORM.format(a="idx", b=2)} AS v FROM samples) JOIN
        (SELECT class_id, n, sum(n * pow(n, -0.5)) OVER (ORDER BY class_id) / sum(n * pow(n, -0.5)) OVER () AS upper FROM counts) d ON d.upper > u) WHERE k = 1) c
        JOIN (SELECT idx, class_id, row_number() OVER (PARTITION BY class_id ORDER BY idx) - 1 AS rank FROM samples) r ON c.class_id = r.class_id AND c.rank = r.rank""",
    "batch_assign": "SELECT idx, scene_id, class_id, idx // 4 AS batch_id FROM samples",
    "batch_collate": """SELECT idx // 4 AS batch_id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(class_id AS VARCHAR), ',' ORDER BY idx) AS class_ids, string_agg(class_name, ',' ORDER BY idx) AS class_names,
        string_agg(CAST(scene_id AS VARCHAR), ',' ORDER BY idx) AS sample_ids FROM samples GROUP BY 1""",
    "grid_project": "SELECT scene_id, class_id, ord, x, y, radius, round(w, 6) AS w, round(h, 6) AS h, round(dx, 6) AS dx, round(dy, 6) AS dy FROM centres",
    "heatmap_target": "SELECT scene_id, class_id, y, x, round(heat, 6) AS heat FROM heat",
    "size_offset_target": "SELECT scene_id, class_id, y, x, ord, n_centres, round(w, 6) AS w, round(h, 6) AS h, round(dx, 6) AS dx, round(dy, 6) AS dy FROM winners",
    "target_boxes": """SELECT scene_id, class_id, count(*) AS n_boxes, round(sum((ix1 - ix0) * (iy1 - iy0)), 3) AS area FROM centres GROUP BY 1, 2""",
    "box_decode_roundtrip": """SELECT scene_id, class_id, CAST(row_number() OVER (PARTITION BY scene_id, class_id ORDER BY y, x) - 1 AS BIGINT) AS number, round((x + dx) * 8 - w * 4, 6) AS x0, round((y + dy) * 8 - h * 4, 6) AS y0,
        round((x + dx) * 8 + w * 4, 6) AS x1, round((y + dy) * 8 + h * 4, 6) AS y1 FROM winners""",
    "local_maxima": "SELECT scene_id, class_id, y, x, round(score, 6) AS score FROM maxima",
    "decode_topk": "SELECT scene_id, class_id, rank, y, x, round(score, 6) AS score, round((x + dx) * 8 - w * 4, 6) AS x0, round((y + dy) * 8 + h * 4, 6) AS y1 FROM ranked",
    "decode_top5": """SELECT scene_id, class_id, rank, y, x, round(score, 6) AS score, round((x + dx) * 8 - w * 4, 6) AS x0, round((y + dy) * 8 + h * 4, 6) AS y1
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scene_id, class_id ORDER BY score DESC, y * 64 + x) AS INTEGER) AS rank FROM maxima) WHERE rank <= 5 AND score >= 0.7""",
    "class_best_score": "SELECT class_id, round(max(score), 6) AS score FROM preds GROUP BY 1 ORDER BY max(score) DESC, class_id LIMIT 5",
    "focal_loss": "SELECT batch_id, num_pos, round(focal, 6) AS focal FROM focal",
    "smooth_l1_masked": "SELECT batch_id, round(size_l1, 6) AS size_l1, round(offset_l1, 6) AS offset_l1 FROM l1",
    "total_loss": "SELECT batch_id, round(loss, 5) AS loss, num_pos FROM losses",
    "epoch_means": "SELECT epoch, round(avg(loss), 5) AS loss, round(avg(focal), 6) AS focal, round(avg(num_pos), 6) AS num_pos, count(*) AS n_batches FROM losses GROUP BY 1",
    "lr_schedule": """SELECT t AS step, round(CASE WHEN t < rise THEN 1e-4::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * t / rise) ELSE 1e-6::DOUBLE + (1e-4::DOUBLE - 1e-6::DOUBLE) * (1 + cos(pi() * (t - rise) / greatest(1, total - rise))) / 2 END, 10) AS lr
        FROM (SELECT total, least(500, greatest(1, total - 1)) AS rise, unnest(range(total)) AS t FROM (SELECT greatest(1, 10 * ((count(*) + 3) // 4)) AS total FROM expanded))""",
    "running_best": """SELECT run, epoch, round(loss, 6) AS loss FROM (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM epochs) WHERE before IS NULL OR loss < before""",
    "running_mean_log": """SELECT run, epoch, step, round(m + 1e-9, 6) AS mean_loss FROM (SELECT *, avg(loss) OVER (PARTITION BY run, epoch ORDER BY step ROWS UNBOUNDED PRECEDING) AS m FROM metrics) WHERE step % 20 = 0""",
    "periodic_epochs": "SELECT run, epoch, round(loss, 6) AS loss FROM epochs WHERE epoch % 5 = 0",
    "run_totals_rollup": "SELECT split, source_dir, count(*) AS samples, CAST(sum(n) AS BIGINT) AS instances, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM scenes GROUP BY ROLLUP (split, source_dir)",
    "progress_cumsum": "SELECT source_dir, scene_id, CAST(sum(n) OVER w AS BIGINT) AS running, count(*) OVER w AS done FROM scenes WINDOW w AS (PARTITION BY source_dir ORDER BY scene_id ROWS UNBOUNDED PRECEDING)",
    "stream_totals": """SELECT source_dir, CAST(sum(CASE WHEN scene_id % 7 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS processed, CAST(sum(CASE WHEN scene_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
        CAST(sum(CASE WHEN scene_id % 7 <> 0 THEN n ELSE 0 END) AS BIGINT) AS instances FROM scenes GROUP BY 1""",
    "union_splits": "SELECT split, source_dir, scene_id FROM scenes",
    "tokenize_prompts": f"SELECT class_id, {_tokens(chr(39) + 'Find ' + chr(39) + ' || class_name || ' + chr(39) + ' in this floor plan drawing' + chr(39))} AS ids FROM dim WHERE class_id IN (SELECT class_id FROM counts)",
    "tokenize_documents": f"SELECT doc_id, {_tokens('text')} AS ids FROM documents",
    "extract_class": "SELECT o_orderkey, CASE WHEN name <> 'original' THEN regexp_replace(name, '_[0-9]+$', '') END AS class_name FROM names",
    "collect_classes": "SELECT string_agg(c, ',' ORDER BY c) AS classes, count(*) AS n FROM (SELECT DISTINCT regexp_replace(name, '_[0-9]+$', '') AS c FROM names WHERE name <> 'original')",
    "rename_prefix": f"SELECT o_orderkey, name, {_RENAME} AS new_name FROM names",
    "rename_counts": f"SELECT {_RULE} AS rule, count(*) AS n FROM names WHERE {_RULE} IS NOT NULL GROUP BY 1",
    "value_counts_top10": "SELECT source AS value, count(*) AS n, repeat('█', CAST(trunc(count(*) / (SELECT count(*) FROM documents) * 30) AS INTEGER)) AS bar FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 10",
    "size_histogram": """SELECT bin, mean, count(*) AS n FROM (SELECT CAST(least(29, floor((n_chars - low) / ((high - low) / 30))) AS INTEGER) AS bin, mean FROM documents, (SELECT min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high, CAST(sum(n_chars) // count(n_chars) AS BIGINT) AS mean FROM documents)) GROUP BY 1, 2""",
    "pending_anti": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "ready_semi": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "size_default_left": "SELECT o_orderkey, coalesce(CAST(trunc(w) AS INTEGER), 1000) AS width FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS w FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    "file_inventory": """SELECT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS source_dir, name AS stem, '.png' AS suffix, o_orderkey FROM names WHERE name <> 'original'""",
    "svg_roundtrip": "SELECT scene_id, ord + 2 AS ord, sid, iid, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM paths",
    "incremental_build": "SELECT scene_id, sid, iid, ord + 2 AS ord, class_name, class_id, px0, py0, px1, py1 FROM boxes",
    "metadata_json_roundtrip": """SELECT scene_id, CAST(count(*) OVER (PARTITION BY scene_id) AS INTEGER) AS num_instances, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY ord) - 1 AS INTEGER) AS pos, class_name AS class, class_id, CAST(iid AS BIGINT) AS instance_id,
        concat_ws(' ', px0, py0, px1, py1) AS bbox FROM boxes""",
    "all_class_grid": """SELECT scene_id, d.class_id, round(1 / (1 + exp(-((scene_id * 31 + d.class_id * 7) % 41 - 20) / 5.0::DOUBLE)), 6) AS score, greatest(0.0::DOUBLE, ((scene_id * 17 + d.class_id * 3) % 21 - 10) / 4.0::DOUBLE) AS size FROM (SELECT DISTINCT scene_id FROM samples) s, dim d""",
    "class_routing": f"SELECT vec_id AS sample_id, e.class_id, {_HEAD} FROM vectors e JOIN means m USING (class_id)",
    "class_routing_every": f"SELECT vec_id AS sample_id, m.class_id, {_HEAD} FROM vectors e, means m",
    "subset_weights": "SELECT idx, class_id, round(1 / sqrt(n), 6) AS weight FROM samples JOIN counts USING (class_id) WHERE idx < 100",
    "files_per_folder": """SELECT source_dir, suffix, count(*) AS n FROM (SELECT source_dir, unnest(CASE WHEN scene_id % 11 = 0 THEN ['.svg'] ELSE ['.svg', '.png'] END) AS suffix FROM scenes
        UNION ALL SELECT source_dir, '.json' FROM (SELECT DISTINCT source_dir, scene_id FROM file_instances)) GROUP BY 1, 2""",
    "subset_draws": f"""SELECT draw, pick FROM (SELECT idx AS draw, least(CAST(floor({_UNIFORM.format(a="idx", b=5)} * CAST(total AS DOUBLE)) AS BIGINT), total - 1) AS point FROM subset, (SELECT CAST(sum(units) AS BIGINT) AS total FROM subset)) d
        ASOF JOIN (SELECT idx AS pick, CAST(sum(units) OVER (ORDER BY idx) AS BIGINT) - units AS low FROM subset) c ON d.point >= c.low""",
    "record_ordinals": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes, md5(text) AS digest FROM documents WHERE doc_id % 4 <> 0",
    "archive_members": """SELECT 'part' || part || CASE WHEN part % 5 = 4 THEN '.tar.gz' ELSE '.zip' END AS archive, 'docs/' || doc_id || '.txt' AS member, size, "offset", md5(content[CAST("offset" + 1 AS INTEGER):CAST("offset" + 16384 AS INTEGER)]) AS digest, false AS failed
        FROM (SELECT doc_id, doc_id // 64 AS part, encode(text) AS content, octet_length(encode(text)) AS size, unnest(range(0, greatest(1, octet_length(encode(text))), 16384)) AS "offset" FROM documents)""",
    "ingested_folders": "SELECT 'part' || (doc_id // 64) AS folder, count(*) AS n_files FROM documents GROUP BY 1",
    "image_normalise_colour": """WITH px AS (SELECT vec_id, CAST(trunc(greatest(0, least(255, (embedding[p + 1]::DOUBLE * 0.5 + 0.5) * 255))) AS DOUBLE) AS v, p // 21 AS y, p // 3 % 7 AS x, 2 - p % 3 AS c FROM embeddings, range(63) r(p)),
        wide AS (SELECT o, i, greatest(0, 1 - abs(i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * (7 / 5.0::DOUBLE)) / (7 / 5.0::DOUBLE)) AS w FROM range(5) a(o), range(7) b(i)),
        high AS (SELECT o, i, greatest(0, 1 - abs(i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * (3 / 5.0::DOUBLE))) AS w FROM range(5) a(o), range(3) b(i)),
        across AS (SELECT vec_id, c, y, o AS x, floor(sum(w * v) / sum(w) + 0.5) AS v FROM px JOIN wide ON i = x GROUP BY 1, 2, 3, 4),
        square AS (SELECT vec_id, c, o AS y, x, floor(sum(w * v) / sum(w) + 0.5) AS v FROM across JOIN high ON i = y GROUP BY 1, 2, 3, 4)
        SELECT vec_id, c * 25 + y * 5 + x AS pos, round(CAST(CAST(v / 127.5 - 1 AS FLOAT) AS DOUBLE), 5) AS value FROM square""",
    "magic_bytes": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'zip' WHEN 1 THEN 'xz' WHEN 2 THEN 'xz' WHEN 3 THEN 'gz' ELSE 'unknown' END AS format FROM documents",
    "archive_formats": """SELECT 'part' || part || CASE WHEN part % 5 = 4 THEN '.tar.gz' ELSE '.zip' END AS name, CASE WHEN part % 5 = 4 THEN 'gz' ELSE 'zip' END AS format FROM (SELECT DISTINCT doc_id // 64 AS part FROM documents)
        UNION ALL SELECT scene_id || '.png', 'unknown' FROM scenes WHERE scene_id % 11 <> 0""",
    "png_dims": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN CAST(n_chars AS INTEGER) END AS width, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN CAST(doc_id + 1 AS INTEGER) END AS height FROM documents",
    "composited": """WITH px AS (SELECT vec_id, vec_id % 3 AS kind, list_transform(embedding, lambda v: CAST(trunc(greatest(0, least(255, (v::DOUBLE * 0.5 + 0.5) * 255))) AS INTEGER)) AS b FROM embeddings),
        flat AS (SELECT vec_id, CASE kind WHEN 0 THEN b[p // 3 * 4 + p % 3 + 1] WHEN 1 THEN b[p // 3 * 2 + 1] ELSE CASE WHEN b[p // 3 + 1] % 20 < 16 THEN b[b[p // 3 + 1] % 20 * 4 + p % 3 + 1] ELSE 0 END END AS v,
        CASE kind WHEN 0 THEN b[p // 3 * 4 + 4] WHEN 1 THEN b[p // 3 * 2 + 2] ELSE CASE WHEN b[p // 3 + 1] % 20 < 16 THEN b[b[p // 3 + 1] % 20 * 4 + 4] ELSE 0 END END AS a, p
        FROM px, range(192) r(p) WHERE p < CASE kind WHEN 0 THEN 48 WHEN 1 THEN 96 ELSE 192 END)
        SELECT vec_id, CAST(p AS INTEGER) AS pos, CAST((255 * (255 - a) + v * a + 127) // 255 AS INTEGER) AS value FROM flat""",
    "annotate_files": """SELECT s.scene_id, source_dir, CAST(CASE WHEN s.scene_id % 13 = 6 THEN 8 ELSE 512 + 256 * (s.scene_id % 4) END AS INTEGER) AS width, CAST(CASE WHEN s.scene_id % 13 = 6 THEN 8 ELSE 384 + 128 * (s.scene_id % 3) END AS INTEGER) AS height,
        coalesce(k, 0) AS num_instances, CAST(coalesce(area, 0) AS BIGINT) AS area
        FROM scenes s LEFT JOIN (SELECT scene_id, count(*) AS k, sum((px1 - px0) * (py1 - py0)) AS area FROM file_instances WHERE kept GROUP BY 1) b USING (scene_id) WHERE s.scene_id % 11 <> 0""",
    "sidecar_files": """SELECT source_dir, CAST(scene_id AS VARCHAR) AS stem, width || 'x' || height AS image_size, view AS view_w, CAST(sum(CASE WHEN kept THEN 1 ELSE 0 END) AS INTEGER) AS num_instances,
        coalesce(string_agg(class_name || ':' || iid || ':' || concat_ws(' ', px0, py0, px1, py1), ',' ORDER BY ord) FILTER (kept), '') AS instances FROM file_instances GROUP BY source_dir, scene_id, width, height, view""",
    "sidecar_files_by_class": """SELECT s.source_dir, CAST(s.scene_id AS VARCHAR) AS stem, s.width, CAST(k.pos AS INTEGER) AS pos, k.class_name AS class, CAST(k.iid AS BIGINT) AS instance_id, CASE WHEN k.pos IS NOT NULL THEN concat_ws(' ', k.px0, k.py0, k.px1, k.py1) END AS bbox
        FROM (SELECT DISTINCT source_dir, scene_id, width FROM class_boxes) s LEFT JOIN
        (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY iid <> -1, ord) - 1 AS pos FROM class_boxes WHERE class_name IS NOT NULL AND px1 > px0 AND py1 > py0) k USING (scene_id)""",
    "file_index": """SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY source_dir, stem || '.png', class_name) - 1 AS BIGINT) AS idx FROM (
        SELECT DISTINCT CASE WHEN source_dir = 'test_set' THEN 'test' ELSE 'train' END AS split, source_dir, CAST(scene_id AS VARCHAR) AS stem, class_name, class_id FROM file_instances WHERE kept AND class_id IS NOT NULL)""",
    "pixel_denorm": "SELECT vec_id, pos - 1 AS pos, CAST(trunc(greatest(0, least(255, (embedding[pos]::DOUBLE * 0.5 + 0.5) * 255))) AS INTEGER) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)",
    "index_files": "SELECT DISTINCT source_dir, CAST(scene_id AS VARCHAR) AS stem, class_name, class_id FROM file_instances WHERE kept AND class_id IS NOT NULL",
    "image_normalise": """WITH px AS (SELECT vec_id, CAST(trunc(greatest(0, least(255, (embedding[p + 1]::DOUBLE * 0.5 + 0.5) * 255))) AS DOUBLE) AS v, p // 8 AS y, p % 8 AS x FROM embeddings, range(64) r(p)),
        taps AS (SELECT o, i, greatest(0, 1 - abs(i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * 2) / 2) AS w FROM range(4) a(o), range(8) b(i)),
        across AS (SELECT vec_id, y, o AS x, floor(sum(w * v) / sum(w) + 0.5) AS v FROM px JOIN taps ON i = x GROUP BY 1, 2, 3),
        square AS (SELECT vec_id, o AS y, x, floor(sum(w * v) / sum(w) + 0.5) AS v FROM across JOIN taps ON i = y GROUP BY 1, 2, 3)
        SELECT vec_id, c * 16 + y * 4 + x AS pos, round(CAST(CAST(v / 127.5 - 1 AS FLOAT) AS DOUBLE), 5) AS value FROM square, range(3) k(c)""",
    "image_files": """WITH px AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(trunc(greatest(0, least(255, (v::DOUBLE * 0.5 + 0.5) * 255))) AS INTEGER)) AS b FROM embeddings WHERE vec_id % 4 <> 0)
        SELECT vec_id, 4 AS width, 4 AS height, CAST(p AS INTEGER) AS pos, CAST((255 * (255 - b[p // 3 * 4 + 4]) + b[p // 3 * 4 + p % 3 + 1] * b[p // 3 * 4 + 4] + 127) // 255 AS INTEGER) AS value FROM px, range(48) r(p)""",
    "heat_image": """SELECT scene_id, class_id, CAST(floor(heat * 255) AS INTEGER) AS red, CAST(floor(heat * 80) AS INTEGER) AS green, CAST(floor(heat * 170) AS INTEGER) AS alpha,
        x * 8 AS px0, y * 8 AS py0, (x + 1) * 8 AS px1, (y + 1) * 8 AS py1 FROM heat""",
    "legacy_labels": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS label, {c} AS value, count(*) AS n, repeat('█', CAST(trunc(count(*) / (SELECT count(*) FROM documents) * 30) AS INTEGER)) AS bar FROM documents WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, min(doc_id) LIMIT 10)"
        for c in ("lang", "source")
    ) + " UNION ALL SELECT * FROM (SELECT 'sizes' AS label, '[' || n_chars || ']' AS value, count(*) AS n, repeat('█', CAST(trunc(count(*) / (SELECT count(*) FROM documents) * 30) AS INTEGER)) AS bar FROM documents GROUP BY n_chars ORDER BY n DESC, min(doc_id) LIMIT 10)",
    "first_n_slice": "SELECT scene_id, array_to_string((list(class_name ORDER BY ord))[1:4], ',') AS first_four FROM boxes GROUP BY 1",
    "hash_sample": f"SELECT doc_id FROM documents ORDER BY {_UNIFORM.format(a='doc_id', b=3)}, doc_id LIMIT 200",
    "hash_shuffle": f"SELECT idx, CAST(row_number() OVER (ORDER BY CAST(floor({_UNIFORM.format(a='idx', b=4)} * 64) AS INTEGER), {_UNIFORM.format(a='idx', b=4)}, idx) - 1 AS BIGINT) AS place FROM samples",
}
ORACLE_SQL = {name: sql(text) for name, text in ORACLE.items()}
