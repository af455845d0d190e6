"""DuckDB SQL of the queries in queries.py."""

from __future__ import annotations

from .standins import ACCEPTED, POLYGONS, SCREEN

_DAY = 86400000.0
_BIN = 5 * _DAY

_GAZE = """g AS (SELECT user_id::VARCHAR AS participant_id, (day(ts) % 3 + 1)::BIGINT AS scene_id, event_id AS seq,
 epoch_us(ts) // 1000 AS t_ms, (epoch_us(ts) // 1000) % 86400000 AS clock_ms, (props->>'$.k')::DOUBLE AS x, value AS y, event_id % 8 AS fix_id,
 value AS fix_dur, event_type AS val_l, value AS pupil_l, CASE WHEN event_id % 3 > 0 THEN (props->>'$.k')::DOUBLE END AS pupil_r, event_type AS type FROM events)"""
_VALID = f"v AS (SELECT * FROM g WHERE x BETWEEN 0 AND {SCREEN[0]} AND y BETWEEN 0 AND {SCREEN[1]} AND val_l IN ({', '.join(repr(a) for a in ACCEPTED)}))"
_EDGES = "e(class_name, ax, ay, bx, by_) AS (VALUES " + ", ".join(f"('{n}', {float(a[0])}::DOUBLE, {float(a[1])}::DOUBLE, {float(b[0])}::DOUBLE, {float(b[1])}::DOUBLE)" for n, p in POLYGONS.items() for a, b in zip(p, p[1:] + p[:1], strict=True)) + ")"
_HITS = """h AS (SELECT v.*, q.class_name FROM v JOIN (SELECT v.seq, e.class_name FROM v, e GROUP BY v.seq, e.class_name HAVING
 bool_or(abs((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) <= 1e-6 AND x BETWEEN least(ax, bx) - 1e-6 AND greatest(ax, bx) + 1e-6 AND y BETWEEN least(ay, by_) - 1e-6 AND greatest(ay, by_) + 1e-6)
 OR sum(CASE WHEN (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay + 1e-12) + ax THEN 1 ELSE 0 END) % 2 = 1) q USING (seq))"""
_NAMES = "c(class_name) AS (VALUES " + ", ".join(f"('{n}')" for n in POLYGONS) + ")"


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _metric(by: str, gap: float = 3 * _DAY) -> list[str]:
    """Common tables of the AOI metrics per `by`."""
    return [
        f"s0 AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY {by} ORDER BY seq) AS step FROM b)",
        f"s1 AS (SELECT *, sum(CASE WHEN step < 0 OR step > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment FROM s0)",
        f"s AS (SELECT *, min(t_ms) OVER (PARTITION BY {by}, segment) AS baseline FROM s1)",
        "hs AS (SELECT s.*, h.class_name FROM s JOIN h USING (seq))",
        f"tf AS (SELECT {by}, fix_id, min(t_ms) AS first_ts, max(fix_dur) AS dur FROM s GROUP BY ALL)",
        f"tt AS (SELECT {by}, sum(dur) AS total_tfd, count(*) AS total_fc FROM tf GROUP BY ALL)",
        f"td AS (SELECT {by}, CASE WHEN count(*) > 1 THEN (max(t_ms) - min(t_ms)) / 1000.0::DOUBLE END AS dur_s FROM s GROUP BY ALL)",
        f"fx AS (SELECT {by}, class_name, fix_id, min(t_ms) AS first_ts, max(fix_dur) AS dur FROM hs GROUP BY ALL)",
        f"m1 AS (SELECT {by}, class_name, count(*) AS fc, sum(dur) AS tfd, avg(dur) AS mfd, first(dur ORDER BY first_ts, fix_id) AS ffd FROM fx GROUP BY ALL)",
        f"m2 AS (SELECT {by}, class_name, count(*) AS samples, first(t_ms - baseline ORDER BY t_ms, seq) AS ttff, avg((pupil_l + coalesce(pupil_r, 0)) / (1 + (pupil_r IS NOT NULL)::INT)) AS mpd FROM hs GROUP BY ALL)",
        f"r0 AS (SELECT tf.*, c.class_name, fx.fix_id IS NOT NULL AS inside FROM tf CROSS JOIN c LEFT JOIN fx ON {' AND '.join(f'tf.{k} = fx.{k}' for k in by.split(', '))} AND c.class_name = fx.class_name AND tf.fix_id = fx.fix_id)",
        f"r1 AS (SELECT *, inside AND NOT lag(inside, 1, false) OVER (PARTITION BY {by}, class_name ORDER BY first_ts, fix_id) AS entry FROM r0)",
        f"rf AS (SELECT {by}, class_name, greatest(sum(entry::INT) - 1, 0)::BIGINT AS rff FROM r1 GROUP BY ALL)",
        f"a AS (SELECT td.*, c.class_name, total_tfd, total_fc, coalesce(samples, 0) AS samples, coalesce(fc, 0) AS fc, tfd, ttff, ffd, mfd, mpd, rff FROM td CROSS JOIN c JOIN tt USING ({by}) LEFT JOIN m1 USING ({by}, class_name) LEFT JOIN m2 USING ({by}, class_name) LEFT JOIN rf USING ({by}, class_name))",
    ]


_K = "participant_id, scene_id"
#: For each log variance ratio u of `start`: the profile of a random-intercept model with one slope, from sums by group size.
_LMM = """SELECT *, syy_ - b0 * y1 - b1 * y2 AS rss FROM (SELECT *, (a22 * y1 - a12 * y2) / (a11 * a22 - a12 * a12) AS b0, (a11 * y2 - a12 * y1) / (a11 * a22 - a12 * a12) AS b1
 FROM (SELECT i, u, h, n, groups, n - sum(w * m * m * k) AS a11, any_value(sx) - sum(w * m * gx) AS a12, any_value(sxx) - sum(w * gxx) AS a22, any_value(sy) - sum(w * m * gy) AS y1, any_value(sxy) - sum(w * gxy) AS y2,
 any_value(syy) - sum(w * gyy) AS syy_, sum(k * ln(1 + m * exp(u))) AS ld FROM (SELECT q.*, z.*, c.n, c.groups, c.sx, c.sy, c.sxx, c.sxy, c.syy, exp(u) / (1 + m * exp(u)) AS w FROM ({start}) q, z, c) GROUP BY i, u, h, n, groups))"""
_NEWTON = """SELECT i, b0, b1, sum(s - n * q) AS g0, sum(x * (s - n * q)) AS g1, sum(n * q * (1 - q)) AS h00, sum(x * n * q * (1 - q)) AS h01, sum(x * x * n * q * (1 - q)) AS h11
 FROM (SELECT r.*, p.*, 1 / (1 + exp(-b0 - b1 * x)) AS q FROM r, p)"""
_ANSWERS = """a AS (SELECT o_custkey::VARCHAR AS participant_id, l_orderkey AS scene_id, CASE o_orderstatus WHEN 'F' THEN 15 WHEN 'O' THEN 45 WHEN 'P' THEN 75 END AS WWR,
 l_quantity AS S1, l_discount * 100 AS S2, l_tax * 100 AS S3, l_linenumber::DOUBLE AS S4, c_mktsegment AS ExperienceGroup, l_returnflag AS Complexity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
_LONG = "l AS (SELECT participant_id, WWR, Complexity, ExperienceGroup, unnest(['S1', 'S2', 'S3', 'S4']) AS item, unnest([S1, S2, S3, S4]) AS v FROM a)"
_EEG = """e AS (SELECT o_custkey::VARCHAR AS participant_id, o_orderkey AS scene_id, rms, hf, dur FROM orders LEFT JOIN
 (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS rms, round(avg(l_discount), 6) AS hf, count(*)::DOUBLE AS dur FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""
_SYNC = """y AS (SELECT e.participant_id, e.scene_id, eye_s, dur AS eeg_s, eye_s - dur AS delta, coalesce(abs(eye_s - dur) > 2.0, true) AS mismatch,
 count(e.scene_id) OVER (PARTITION BY e.participant_id) AS scenes FROM e LEFT JOIN (SELECT o_orderkey, floor(o_totalprice / 1000) / 100 AS eye_s FROM orders WHERE floor(o_totalprice / 1000) / 100 > 0.5) ON o_orderkey = e.scene_id)"""
_FLAGS = """th AS (SELECT max(mh + 3 * dh) AS th_h, max(mr + 3 * dr) AS th_r FROM (SELECT median(abs(hf - mh)) AS dh, median(abs(rms - mr)) AS dr, any_value(mh) AS mh, any_value(mr) AS mr FROM e, (SELECT median(hf) AS mh, median(rms) AS mr FROM e))),
f AS (SELECT participant_id, scene_id, hf, rms, dur, concat_ws(';', CASE WHEN dur IS NULL OR dur < 2 THEN 'segment_duration' END, CASE WHEN hf > th_h THEN 'robust_hf_ratio_20_40Hz' END, CASE WHEN rms > th_r THEN 'robust_rms_mean_uV' END) AS reasons,
 concat_ws(';', CASE WHEN dur IS NULL OR dur < 2 THEN 'segment_duration' END, CASE WHEN hf > th_h THEN 'robust_hf_ratio_20_40Hz' END, CASE WHEN rms > th_r THEN 'robust_rms_mean_uV' END, CASE WHEN hf > 0.4 THEN 'legacy_hf_ratio' END) AS candidates FROM e, th)"""
_SUBJ = "s AS (SELECT *, participant_id IS NOT NULL AND avg((reasons <> '')::INT) OVER (PARTITION BY participant_id) > 0.2 AS gone FROM f)"
_TIMES = """x AS (SELECT o_custkey::VARCHAR AS participant_id, ascii(o_orderstatus)::BIGINT AS scene_id, epoch_ms(min(o_orderdate)) / 1000 AS x_start, epoch_ms(max(o_orderdate)) / 1000 AS x_end FROM orders GROUP BY ALL),
z AS (SELECT o_custkey::VARCHAR AS participant_id, ascii(o_orderstatus)::BIGINT AS scene_id, epoch_ms(min(l_shipdate)) / 1000 AS y_start, epoch_ms(max(l_shipdate)) / 1000 AS y_end FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
_MARKS = f"""{_TIMES}, t AS (SELECT *, abs((x_end - x_start) - (y_end - y_start)) > {100 * _DAY / 1000} AS outlier FROM x JOIN z USING (participant_id, scene_id)),
u AS (SELECT *, n_ok < 2 OR NOT outlier AS used FROM (SELECT *, sum((NOT outlier)::INT) OVER (PARTITION BY participant_id) AS n_ok FROM t)),
ma AS (SELECT participant_id, scene_id, outlier, used, unnest(['start', 'end']) AS edge, unnest([x_start, x_end]) AS x, unnest([y_start, y_end]) AS y FROM u),
m AS (SELECT * FROM ma WHERE used),
f1 AS (SELECT participant_id, count(*) AS n, coalesce(covar_pop(x, y) / nullif(var_pop(x), 0), 1.0) AS s, avg(y) - coalesce(covar_pop(x, y) / nullif(var_pop(x), 0), 1.0) * avg(x) AS i FROM m GROUP BY ALL),
f2 AS (SELECT m.participant_id, count(*) AS n, coalesce(covar_pop(x, y) / nullif(var_pop(x), 0), 1.0) AS s, avg(y) - coalesce(covar_pop(x, y) / nullif(var_pop(x), 0), 1.0) * avg(x) AS i FROM m JOIN f1 USING (participant_id) WHERE abs(y - s * x - i) <= {60 * _DAY / 1000} GROUP BY ALL HAVING count(*) >= 4),
f AS (SELECT participant_id, coalesce(f2.s, f1.s) AS slope, coalesce(f2.i, f1.i) AS intercept, f1.n AS n_landmarks, coalesce(f2.n, f1.n) AS n_used FROM f1 LEFT JOIN f2 USING (participant_id))"""
_RES = f"{_MARKS}, r AS (SELECT ma.*, slope * x + intercept AS predicted, slope * x + intercept - y AS res FROM ma JOIN f USING (participant_id))"
_STATE = "CASE WHEN type = 'click' AND nt = 'view' THEN 'view' WHEN type = 'view' AND nt IN ('click', 'purchase') THEN 'gray' WHEN type = 'signup' AND nt = 'view' THEN 'view' END"
_SEGS = f"""{_GAZE}, k0 AS (SELECT participant_id AS subject_id, seq AS ev_ix, type, t_ms AS latency, lead(type) OVER w AS nt, lead(t_ms) OVER w AS end_latency FROM g WINDOW w AS (PARTITION BY participant_id ORDER BY seq)),
k1 AS (SELECT *, {_STATE} AS condition FROM k0), k2 AS (SELECT *, (sum((condition = 'view')::INT) OVER (PARTITION BY subject_id ORDER BY ev_ix ROWS UNBOUNDED PRECEDING))::BIGINT AS scene_id FROM k1 WHERE condition IS NOT NULL)"""
_FLAG = "CASE WHEN c_acctbal < 0 THEN 'Yes' WHEN c_nationkey = 3 THEN 'y' END"
_CONTRAST = """p AS (SELECT item, participant_id, avg(v) FILTER (WWR = 15) AS m0, avg(v) FILTER (WWR = 45) AS m1, avg(v) FILTER (WWR = 75) AS m2 FROM l GROUP BY ALL HAVING count(v) FILTER (WWR = 15) > 0 AND count(v) FILTER (WWR = 45) > 0 AND count(v) FILTER (WWR = 75) > 0),
q AS (SELECT item, unnest(['Linear', 'Quadratic']) AS term, unnest([m2 - m0, m0 - 2 * m1 + m2]) AS s FROM p),
d AS (SELECT item AS outcome, term, count(*) AS n, avg(s) AS mean, stddev_samp(s) AS sd FROM q GROUP BY ALL)"""

_metric_columns = f"""SELECT {_K}, class_name, samples, fc AS FC, round(tfd, 8) AS TFD, ttff AS TTFF, round(ffd, 8) AS FFD, round(mfd, 8) AS MFD, round(mpd, 8) AS MPD, coalesce(rff, 0) AS RFF, fc > 0 OR samples > 0 AS visited,
 round(tfd / nullif(total_tfd, 0), 8) AS attention_share, round(tfd / nullif(total_tfd, 0) * 100, 8) AS share_pct, round(fc / nullif(total_fc, 0), 8) AS FC_share, round(fc / nullif(dur_s, 0), 8) AS FC_rate FROM a"""

#: p of |t| by Simpson's rule over cos(x) ** (nu - 1).
_TAIL = """tail AS (SELECT t, nu, 1 - 2 * exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(pi()) * sum(cos(atan(abs(t) / sqrt(nu)) * i / 2000.0) ** (nu - 1) * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * atan(abs(t) / sqrt(nu)) / 6000.0 AS p
 FROM (SELECT DISTINCT t, nu FROM w), (SELECT unnest(range(0, 2001)) AS i) GROUP BY t, nu)"""
_FOLDER = """CASE p_size % 5 WHEN 0 THEN concat(1 + p_partkey % 5 % 2, '-C', p_partkey % 2, 'W', 15 + 30 * (p_partkey % 3)) WHEN 1 THEN concat('(1-', 1 + p_partkey % 5 % 2, '-', 1 + p_partkey % 6, '、2-', 1 + p_partkey % 5 % 2, '-', 7 - (1 + p_partkey % 6), ') 组', p_partkey % 2, '-C', p_partkey % 2, 'W', 15 + 30 * (p_partkey % 3))
 WHEN 2 THEN concat(1 + p_partkey % 5 % 2, '-c', p_partkey % 2, 'w', 15 + 30 * (p_partkey % 3)) WHEN 3 THEN '适应 1' ELSE concat('folder ', p_partkey) END"""
#: What parse_scene_folder() finds, from the keys that the names are made of.
_PARSED = """CASE WHEN p_size % 5 = 1 THEN concat('1-', 1 + p_partkey % 5 % 2, '-', 1 + p_partkey % 6) END AS order_code_1, CASE WHEN p_size % 5 = 1 THEN concat('2-', 1 + p_partkey % 5 % 2, '-', 6 - p_partkey % 6) END AS order_code_2,
 CASE WHEN p_size % 5 IN (0, 2) THEN (1 + p_partkey % 5 % 2)::VARCHAR WHEN p_size % 5 = 1 THEN concat('组', p_partkey % 2) END AS scene_group, CASE WHEN p_size % 5 < 3 THEN concat('C', p_partkey % 2, 'W', 15 + 30 * (p_partkey % 3)) END AS condition_code,
 CASE WHEN p_size % 5 < 3 THEN concat('C', p_partkey % 2) END AS Cond, CASE WHEN p_size % 5 < 3 THEN 15 + 30 * (p_partkey % 3) END AS WWR, CASE WHEN p_size % 5 < 3 THEN p_partkey % 2 END AS Complexity, CASE WHEN p_size % 5 IN (0, 2) THEN 1 + p_partkey % 5 % 2 END AS folder_block,
 CASE WHEN p_size % 5 IN (0, 2) THEN 1 + p_partkey % 3 + 3 * (p_partkey % 2) END AS folder_position, CASE WHEN p_size % 5 IN (0, 2) THEN (p_partkey % 5 % 2) * 6 + 1 + p_partkey % 3 + 3 * (p_partkey % 2) END AS folder_scene_id,
 CASE WHEN p_size % 5 IN (0, 2) THEN 'simple_condition_folder' WHEN p_size % 5 = 1 THEN 'coded_folder' END AS folder_order_scheme"""
_LISTING = f"""SELECT *, concat('/root/', f, '/', CASE WHEN p_size % 11 = 0 THEN 'notes.csv' ELSE concat('raw_name', p_partkey % 40, CASE WHEN p_partkey % 7 = 0 THEN '-12-3' ELSE '' END, '_', strftime(day, '%y%m%d'), '1200_', p_partkey, '.csv') END) AS path
 FROM (SELECT *, {_FOLDER} AS f, (DATE '2026-04-01' + (p_partkey % 60)::INT)::DATE AS day FROM part)"""
_FILE = "regexp_extract(path, 'raw_(name[^_]*)_', 1) AS subject, regexp_extract(path, 'raw_name[^_]*_([0-9]+)_', 1) AS record_id, p_partkey::VARCHAR AS split_id"
_NEW = "(1, 'C0W75', '1', 1), (1, 'C1W15', '2', 2), (1, 'C0W45', '3', 3), (1, 'C1W75', '4', 4), (1, 'C0W15', '5', 5), (1, 'C1W45', '6', 6), (2, 'C1W15', 'a', 1), (2, 'C0W15', 'b', 2), (2, 'C1W75', 'c', 3), (2, 'C0W75', 'd', 4), (2, 'C1W45', 'e', 5), (2, 'C0W45', 'f', 6)"
_PEOPLE = """SELECT c_custkey::VARCHAR AS participant_id, ['从不', '每月1-2次', '每月3-4次', '≥5次', 'Often', 'rarely', '', 'nan', 'other'][1 + c_nationkey % 9] AS Experience, ['男', 'F', '女生', 'man', 'none', '', 'x'][1 + c_custkey % 7] AS Gender,
 CASE WHEN c_nationkey > 3 THEN c_acctbal::VARCHAR ELSE '?' END AS Age, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Supplement' ELSE 'Original' END AS RecruitmentBatch, c_acctbal < 0 AS exclude FROM customer"""
_GROUP = "CASE WHEN Experience IN ('', 'nan') THEN 'Unknown' WHEN Experience IN ('从不', '每月1-2次', 'rarely') THEN 'Low' WHEN Experience = 'other' THEN 'other' WHEN Experience IS NOT NULL THEN 'High' END"
_GENDER = "CASE WHEN Gender IN ('男', 'man') THEN 'Male' WHEN Gender IN ('F', '女生') THEN 'Female' WHEN Gender IN ('none', '') THEN 'Unknown' ELSE Gender END"

ORACLE_SQL: dict[str, str] = {
    "aoi_metrics": _with(_GAZE, _VALID, _EDGES, _NAMES, _HITS, "b AS (SELECT * FROM v)", *_metric(_K), select=_metric_columns),
    "batch_from_files": _with(_GAZE, f"v AS (SELECT * REPLACE ('P' || (participant_id::BIGINT % 10) AS participant_id) FROM g WHERE x BETWEEN 0 AND {SCREEN[0]} AND y BETWEEN 0 AND {SCREEN[1]})", _EDGES, _NAMES, _HITS, "b AS (SELECT * FROM v)", *_metric(_K),
        select=f"SELECT {_K}, class_name, samples, fc AS FC, round(tfd, 6) AS TFD, ttff AS TTFF, ffd AS FFD, round(mfd, 6) AS MFD, rff AS RFF, fc > 0 OR samples > 0 AS visited, round(tfd / nullif(total_tfd, 0), 6) AS attention_share, round(fc / total_fc, 6) AS FC_share, round(fc / nullif(dur_s, 0), 6) AS FC_rate FROM a WHERE participant_id <> 'P9'"),
    "batch_file_qc": _with(_GAZE, select="SELECT 'P' || (participant_id::BIGINT % 10) AS participant_id, scene_id, false AS missing_eye_file, false AS missing_aoi_file, count(*) AS sample_count, min(t_ms)::DOUBLE AS first_ts, max(t_ms)::DOUBLE AS last_ts, (max(t_ms) - min(t_ms))::DOUBLE AS duration_ms, ceil((max(t_ms) - min(t_ms)) / 2000)::BIGINT AS timebin_count FROM g GROUP BY ALL"),
    "lmm_slope": _with(_ANSWERS, "d AS (SELECT participant_id AS g, S4 AS x, S1 + 3 * (participant_id::BIGINT % 7) AS y FROM a WHERE S4 IS NOT NULL AND S1 IS NOT NULL)",
        "c AS (SELECT count(*) AS n, count(DISTINCT g) AS groups, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM d)",
        "s AS (SELECT count(*)::DOUBLE AS m, sum(x) AS gx, sum(y) AS gy FROM d GROUP BY g)",
        "z AS (SELECT m, count(*) AS k, sum(gx) AS gx, sum(gy) AS gy, sum(gx * gx) AS gxx, sum(gx * gy) AS gxy, sum(gy * gy) AS gyy FROM s GROUP BY m)",
        f"r AS (SELECT 0 AS i, -14.0::DOUBLE AS lo, 14.0::DOUBLE AS hi UNION ALL SELECT i + 1, u - h, u + h FROM (SELECT *, row_number() OVER (ORDER BY n * ln(rss / n) + ld, u) AS rk FROM ({_LMM.format(start='SELECT i, lo + (hi - lo) * j / 20 AS u, (hi - lo) / 20 AS h FROM r, (SELECT unnest(range(0, 21)) AS j) WHERE i < 13')})) WHERE rk = 1)",
        f"f AS ({_LMM.format(start='SELECT 0 AS i, (lo + hi) / 2 AS u, 0.0 AS h FROM r WHERE i = 13')})",
        select="SELECT unnest(['Intercept', 'S4']) AS term, round(unnest([b0, b1]), 4) AS estimate, round(sqrt(rss / n * unnest([a22, a11]) / (a11 * a22 - a12 * a12)), 4) AS se, n, groups AS n_groups, round(exp(u) * rss / n, 4) AS group_variance FROM f").replace("WITH ", "WITH RECURSIVE ", 1),
    "logit_slope": _with(_ANSWERS, "p AS (SELECT S4 AS x, count(*)::DOUBLE AS n, count_if(S1 + 3 * S4 > 30)::DOUBLE AS s FROM a WHERE S4 IS NOT NULL AND S1 IS NOT NULL GROUP BY S4)",
        f"r AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 UNION ALL SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM ({_NEWTON} WHERE i < 25 GROUP BY i, b0, b1))",
        f"f AS ({_NEWTON} WHERE i = 25 GROUP BY i, b0, b1)",
        select="SELECT unnest(['Intercept', 'S4']) AS term, round(unnest([b0, b1]), 5) AS estimate, round(sqrt(unnest([h11, h00]) / (h00 * h11 - h01 * h01)), 5) AS se, (SELECT sum(n)::BIGINT FROM p) AS n FROM f").replace("WITH ", "WITH RECURSIVE ", 1),
    "aoi_metrics_rows_mode": _with(_GAZE, _VALID, _EDGES, _NAMES, _HITS, f"t AS (SELECT {_K}, sum(fix_dur) AS total FROM v GROUP BY ALL)", f"m AS (SELECT {_K}, class_name, count(*) AS n, sum(fix_dur) AS d FROM h GROUP BY ALL)",
        select=f"SELECT {_K}, class_name, 1 AS polygon_id, coalesce(n, 0) AS samples, round(d, 6) AS TFD, round(d / nullif(total, 0), 6) AS attention_share FROM t CROSS JOIN c LEFT JOIN m USING ({_K}, class_name)"),
    "whole_scene": _with(_GAZE, _VALID, f"f AS (SELECT {_K}, fix_id, max(fix_dur) AS d, count(*) AS n FROM v GROUP BY ALL)", f"t AS (SELECT {_K}, CASE WHEN count(*) > 1 THEN (max(t_ms) - min(t_ms)) / 1000.0 END AS s FROM v GROUP BY ALL)",
        select=f"SELECT {_K}, sum(n)::BIGINT AS samples, count(*) AS FC, round(sum(d), 6) AS TFD, round(avg(d), 6) AS MFD, round(count(*) / nullif(any_value(s), 0)::DOUBLE, 6) AS FC_rate, sum(n) > 0 AS visited FROM f JOIN t USING ({_K}) GROUP BY {_K}"),
    "aoi_overlap": _with(_GAZE, _VALID, _EDGES, _HITS, "n AS (SELECT class_name, count(*) AS n FROM h GROUP BY ALL)",
        select="SELECT p.class_name AS class_a, q.class_name AS class_b, any_value(na.n) AS n_a, any_value(nb.n) AS n_b, count(*) AS n_both, round(count(*) / any_value(na.n), 6) AS ratio_a, round(count(*) / any_value(nb.n), 6) AS ratio_b, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS jaccard FROM h p JOIN h q ON p.seq = q.seq AND p.class_name < q.class_name JOIN n na ON na.class_name = p.class_name JOIN n nb ON nb.class_name = q.class_name GROUP BY ALL"),
    "aoi_validation": _with(_GAZE, _VALID, _EDGES, _HITS, f"t AS (SELECT count(*) AS n FROM (SELECT DISTINCT {_K} FROM v))", f"r AS (SELECT class_name, count(*) AS k FROM (SELECT DISTINCT {_K}, class_name FROM h) GROUP BY ALL)",
        select="SELECT class_name, 1 AS polygon_id, count(*)::INT AS n_points, round(abs(sum(ax * by_ - bx * ay)) / 2, 6) AS area, max(ax) - min(ax) AS bbox_w, max(ay) - min(ay) AS bbox_h, round(any_value(k) / any_value(n), 6) AS visited_rate FROM e JOIN r USING (class_name), t GROUP BY class_name"),
    "gaze_valid_qc": _with(_GAZE, f"k AS (SELECT {_K}, x IS NOT NULL AND y IS NOT NULL AS a, coalesce(x BETWEEN 0 AND {SCREEN[0]} AND y BETWEEN 0 AND {SCREEN[1]}, false) AS b, coalesce(val_l IN ({', '.join(repr(x) for x in ACCEPTED)}), false) AS c FROM g)",
        select=f"SELECT {_K}, count(*) AS n_samples, count_if(a)::BIGINT AS n_finite_xy, count_if(b)::BIGINT AS n_in_screen, count_if(c)::BIGINT AS n_validity_ok, count_if(a AND b AND c)::BIGINT AS n_valid, round(avg(a::INT), 6) AS finite_xy_ratio, round(avg(b::INT), 6) AS in_screen_ratio, round(avg(c::INT), 6) AS validity_ok_ratio, round(avg((a AND b AND c)::INT), 6) AS valid_ratio FROM k GROUP BY {_K}"),
    "screen_filter": _with(_GAZE, _VALID, select=f"SELECT {_K}, seq, x, y FROM v"),
    "time_segments": _with(_GAZE, f"s AS (SELECT *, clock_ms - lag(clock_ms) OVER (PARTITION BY {_K} ORDER BY seq) AS step FROM g)", f"q AS (SELECT *, coalesce(step < 0, false) AS is_reset, coalesce(step > 21600000, false) AS is_gap, (sum(CASE WHEN step < 0 OR step > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM s)",
        select=f"SELECT {_K}, seq, is_reset, is_gap, segment, min(clock_ms) OVER (PARTITION BY {_K}, segment) AS baseline FROM q"),
    "segment_counts": _with(_GAZE, f"s AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY {_K} ORDER BY seq) AS step FROM g)", select=f"SELECT {_K}, count_if(step > {3 * _DAY})::BIGINT AS gap_count, count_if(step < 0)::BIGINT AS reset_count, (1 + count_if(step < 0 OR step > {3 * _DAY}))::BIGINT AS segments FROM s GROUP BY {_K}"),
    "gaze_file_stats": _with(_GAZE, select=f"SELECT {_K}, count(*) AS sample_count, min(t_ms) AS first_ts, max(t_ms) AS last_ts, max(t_ms) - min(t_ms) AS duration_ms, ceil((max(t_ms) - min(t_ms)) / {_BIN})::BIGINT AS timebin_count FROM g GROUP BY {_K}"),
    "timebin_assign": _with(_GAZE, _VALID, select=f"SELECT {_K}, seq, floor((t_ms - min(t_ms) OVER (PARTITION BY {_K})) / {_BIN})::BIGINT AS bin_index FROM v"),
    "timebin_metrics": _with(_GAZE, _VALID, _EDGES, _NAMES, _HITS, f"b AS (SELECT *, floor((t_ms - min(t_ms) OVER (PARTITION BY {_K})) / {_BIN})::BIGINT AS bin_index FROM v)", *_metric(f"{_K}, bin_index"),
        select=f"SELECT {_K}, bin_index, class_name, samples, fc AS FC, round(tfd, 6) AS TFD, ttff AS TTFF, round(mfd, 6) AS MFD, coalesce(rff, 0) AS RFF, fc > 0 OR samples > 0 AS visited, round(tfd / nullif(total_tfd, 0), 6) AS attention_share FROM a"),
    "timebin_whole_scene": _with(_GAZE, _VALID, f"b AS (SELECT *, floor((t_ms - min(t_ms) OVER (PARTITION BY {_K})) / {_BIN})::BIGINT AS bin_index FROM v)", f"f AS (SELECT {_K}, bin_index, fix_id, max(fix_dur) AS d, count(*) AS n FROM b GROUP BY ALL)",
        select=f"SELECT {_K}, bin_index, sum(n)::BIGINT AS samples, count(*) AS FC, round(sum(d), 6) AS TFD, round(avg(d), 6) AS MFD FROM f GROUP BY ALL"),
    "clock_fit": _with(_MARKS, select="SELECT participant_id, round(slope, 2) AS slope, round(intercept, 2) AS intercept, n_landmarks, n_used FROM f"),
    "clock_residuals": _with(_RES, select="SELECT participant_id, scene_id, edge, outlier, x, y, round(predicted, 2) AS predicted, round(res, 2) AS residual_ms FROM r"),
    "clock_quality": _with(_RES, "k AS (SELECT *, sum((NOT outlier)::INT) OVER (PARTITION BY participant_id) AS ok FROM r)", select="SELECT participant_id, round(quantile_cont(abs(res), 0.5), 2) AS median_abs_ms, round(quantile_cont(abs(res), 0.95), 2) AS p95_abs_ms, round(max(abs(res)), 2) AS max_abs_ms, count(*) AS n FROM k WHERE ok = 0 OR NOT outlier GROUP BY participant_id"),
    "scene_alignment": _with(_TIMES, select=f"SELECT {_K}, x_start AS eye_start, x_end AS eye_end, y_start AS eeg_start, y_end AS eeg_end, round((x_end - x_start) - (y_end - y_start), 6) AS duration_delta_s, coalesce(abs((x_end - x_start) - (y_end - y_start)) > {_DAY / 10}, false) AS outlier FROM x LEFT JOIN z USING ({_K})"),
    "sync_qc": _with(_EEG, _SYNC, select=f"SELECT {_K}, eye_s AS eye_duration_s, eeg_s AS eeg_duration_s, scenes AS scene_count, round(delta, 6) AS duration_delta_s, mismatch AS duration_mismatch, scenes <> 10 AS scene_count_mismatch FROM y"),
    "qc_exclusions": _with(_EEG, _SYNC, _FLAGS, _ANSWERS, "r AS (SELECT y.participant_id, y.scene_id, concat_ws(';', CASE WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.scene_id = y.scene_id AND S1 > 5) THEN 'missing_questionnaire' END, CASE WHEN eye_s IS NULL THEN 'missing_eye' END, CASE WHEN eeg_s IS NULL THEN 'missing_eeg' END, CASE WHEN f.reasons <> '' THEN 'bad_eeg_quality' END, CASE WHEN mismatch THEN 'duration_mismatch' END, CASE WHEN scenes <> 10 THEN 'scene_count_mismatch' END) AS reasons FROM y JOIN f USING (scene_id))",
        select=f"SELECT {_K}, reasons, reasons = '' AS keep FROM r"),
    "qc_kept_rows": _with(_EEG, _SYNC, _FLAGS, _ANSWERS, select=f"SELECT y.participant_id, y.scene_id, dur AS view_dur_s FROM y JOIN f USING (scene_id) WHERE EXISTS (SELECT 1 FROM a WHERE a.scene_id = y.scene_id AND S1 > 5) AND eye_s IS NOT NULL AND eeg_s IS NOT NULL AND f.reasons = '' AND NOT mismatch AND scenes = 10"),
    "robust_mad_thresholds": _with(_EEG, "l AS (SELECT unnest(['hf_ratio_20_40Hz', 'rms_mean_uV']) AS metric, unnest([hf, rms]) AS v FROM e)", "m AS (SELECT metric, count(v) AS n, median(v) AS median FROM l WHERE v IS NOT NULL GROUP BY ALL)", "d AS (SELECT metric, median(abs(v - median)) AS mad FROM l JOIN m USING (metric) WHERE v IS NOT NULL GROUP BY ALL)",
        select="SELECT metric, n, round(median, 6) AS median, round(mad, 6) AS mad, round(CASE WHEN n >= 20 THEN median + 3 * mad END, 6) AS threshold FROM m JOIN d USING (metric)"),
    "robust_mad_flags": _with(_EEG, _FLAGS, select=f"SELECT {_K}, 'robust' AS qc_policy, candidates AS candidate_reasons, reasons, reasons <> '' AS bad_eeg_quality FROM f"),
    "subject_exclusion": _with(_EEG, _FLAGS, _SUBJ, select=f"SELECT {_K}, gone AS subject_excluded, concat_ws(';', nullif(reasons, ''), CASE WHEN gone THEN 'eeg_subject_quality_exclusion' END) AS reasons, reasons <> '' OR gone AS bad_eeg_quality FROM s"),
    "subject_qc": _with(_EEG, _FLAGS, _SUBJ, select="SELECT participant_id, count(*) AS n_scenes, count_if(reasons <> '' OR gone)::BIGINT AS n_bad, round(avg((reasons <> '' OR gone)::INT), 6) AS bad_fraction, bool_or(gone) AS any_exclusion FROM s GROUP BY ALL"),
    "eeg_metric_summary": _with(_EEG, _FLAGS, "l AS (SELECT (reasons <> '')::INT AS bad, unnest(['hf_ratio_20_40Hz', 'rms_mean_uV', 'view_dur_s']) AS metric, unnest([hf, rms, dur]) AS v FROM f)", select="SELECT metric, count(v) AS n, count_if(v IS NULL)::BIGINT AS missing, round(avg(v), 6) AS mean, sum(bad)::BIGINT AS n_bad FROM l GROUP BY ALL"),
    "contract": "SELECT 'warning' AS severity, unnest(['missing_view_start_s', 'missing_view_end_s', 'missing_rms_mean_uV', 'missing_peak_to_peak_uV', 'missing_nan_fraction', 'missing_flat_fraction', 'missing_segment_valid_duration']) AS finding, 1::BIGINT AS n UNION ALL SELECT 'error', 'duplicate_keys', sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey, o_orderkey % 50)",
    "group_balance": "WITH l AS (SELECT unnest(['c_mktsegment', 'c_nationkey']) AS factor, unnest([c_mktsegment, c_nationkey::VARCHAR]) AS level FROM customer) SELECT factor, coalesce(level, 'Unknown') AS level, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer) * 100, 6) AS percent FROM l GROUP BY ALL",
    "design_balance": _with(_ANSWERS, "l AS (SELECT unnest(['WWR', 'Complexity']) AS factor, unnest([WWR::VARCHAR, Complexity]) AS level FROM a)", select="SELECT factor, coalesce(level, 'NA') AS level, count(*) AS n FROM l GROUP BY ALL"),
    "participant_flow": f"WITH c AS (SELECT *, coalesce(lower({_FLAG}) IN ('true', '1', 'yes'), false) AS x FROM customer) SELECT 'total' AS step, count(*) AS n FROM c UNION ALL SELECT 'excluded', count_if(x)::BIGINT FROM c UNION ALL SELECT 'active', count_if(NOT x)::BIGINT FROM c UNION ALL SELECT 'batch_' || coalesce(c_mktsegment, 'Unknown'), count(*) FROM c GROUP BY 1",
    "active_participants": f"SELECT c_custkey, c_name FROM customer WHERE {_FLAG} IS NULL",
    "trial_index": "SELECT o_custkey AS participant_id, o_orderkey AS scene_id, c_mktsegment AS ExperienceGroup FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT c_acctbal < 0",
    "dup_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "keep_first_rows": "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1",
    "presence_reasons": "WITH a AS (SELECT DISTINCT o_custkey::VARCHAR AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_discount > 0.09), b AS (SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders), c AS (SELECT DISTINCT c_custkey::VARCHAR AS id FROM customer WHERE c_acctbal > 0), u AS (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c), f AS (SELECT id, id IN (FROM a) AS x, id IN (FROM b) AS y, id IN (FROM c) AS z FROM u) SELECT id AS participant_id, x AS has_eeg, y AS has_eye, z AS has_questionnaire, x AND y AND z AS complete, concat_ws(';', CASE WHEN NOT x THEN 'missing_eeg' END, CASE WHEN NOT y THEN 'missing_eye' END, CASE WHEN NOT z THEN 'missing_questionnaire' END) AS reasons FROM f",
    "alias_resolution": """WITH r AS (SELECT o_orderkey, o_orderkey % 4000 AS rec, o_orderkey % 3 = 0 AS generic, CASE WHEN o_orderkey % 3 = 0 THEN 'User' || o_orderkey ELSE 'name' || o_custkey || CASE WHEN o_orderkey % 5 = 0 THEN '-32-40' ELSE '' END END AS subject,
 CASE WHEN o_orderkey % 3 = 0 THEN 'User' || o_orderkey ELSE 'name' || o_custkey END AS base FROM orders),
o AS (SELECT rec, min(base) FILTER (NOT generic) AS name FROM r GROUP BY rec HAVING count(DISTINCT base) FILTER (NOT generic) = 1 AND count_if(generic) > 0),
n AS (SELECT r.*, CASE WHEN generic AND name IS NOT NULL THEN name ELSE base END AS now, generic AND name IS NOT NULL AS taken FROM r LEFT JOIN o USING (rec)),
m AS (SELECT 'name' || c_custkey AS alias, c_name FROM customer WHERE c_custkey % 50 = 0)
SELECT o_orderkey, subject, coalesce(c_name, now) AS participant_id, CASE WHEN c_name IS NOT NULL THEN 'manual' WHEN taken THEN 'record_id' WHEN base <> subject THEN 'suffix_note' ELSE '' END AS alias_source
FROM n LEFT JOIN m ON alias = now""",
    "analysis_master": _with(_EEG, _ANSWERS, f"q AS (SELECT {_K}, avg(S1) AS q1, avg(S2) AS q2 FROM a GROUP BY ALL)", f"y AS (SELECT {_K}, Complexity AS class_name, count(*) AS FC, sum(S1) AS TFD FROM a GROUP BY ALL)", select=f"SELECT e.participant_id, e.scene_id, round(q1, 6) AS q_S1, round(q2, 6) AS q_S2, hf AS eeg_hf_ratio_20_40Hz, dur AS eeg_view_dur_s, class_name, FC, round(TFD, 6) AS TFD FROM e LEFT JOIN q USING ({_K}) LEFT JOIN y USING ({_K})"),
    "aligned_scenes": _with(_EEG, _ANSWERS, f"y AS (SELECT {_K}, max(S1) AS eye_max FROM a GROUP BY ALL)", select=f"SELECT e.participant_id, e.scene_id, eye_max, CASE WHEN hf < 0.06 THEN dur END AS view_dur_s, coalesce(hf >= 0.06, true) OR dur IS NULL AS missing_eeg_scene FROM e LEFT JOIN y USING ({_K})"),
    "scene_fallback": _with(_EEG, _ANSWERS, f"u AS (SELECT DISTINCT {_K}, 'answers' AS Cond, 0 AS r FROM a WHERE S4 > 3 UNION ALL SELECT {_K}, 'eeg', 1 FROM e WHERE dur > 2)", select=f"SELECT {_K}, first(Cond ORDER BY r) AS Cond FROM u GROUP BY {_K}"),
    "id_sets": "WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000), o AS (SELECT DISTINCT o_custkey AS id FROM orders) SELECT id, CASE WHEN id IN (FROM c) THEN 'both' ELSE 'orders_only' END AS kind FROM o",
    "wide_to_long": _with(_ANSWERS, "p AS (SELECT DISTINCT participant_id FROM a WHERE WWR IS NOT NULL)", "m AS (SELECT participant_id, WWR, round(avg(S1), 6) AS S1, round(avg(S2), 6) AS S2 FROM a GROUP BY ALL)", "w AS (SELECT unnest([15, 45, 75]) AS WWR, unnest([1, 2, 3])::BIGINT AS scene_id)", select="SELECT p.participant_id, w.scene_id, S1, S2 FROM p CROSS JOIN w LEFT JOIN m ON m.participant_id = p.participant_id AND m.WWR = w.WWR"),
    "composites": _with(_ANSWERS, "n AS (SELECT participant_id, scene_id, CASE WHEN S1 < 40 THEN S1 END AS S1, CASE WHEN S2 > 2 THEN S2 END AS S2, S3, S4, S4 + 1 AS S5 FROM a)", "i AS (SELECT participant_id, (avg(S3) + avg(S4)) / 2 AS ipq FROM n GROUP BY ALL)", "t AS (SELECT max(S5) AS top FROM n)",
        select=f"SELECT {_K}, round(S1, 6) AS S1, round(S2, 6) AS S2, round(S3, 6) AS S3, S4, round(CASE WHEN (S1 IS NOT NULL)::INT + (S2 IS NOT NULL)::INT + 2 >= 3 THEN (coalesce(S1, 0) + coalesce(S2, 0) + S3 + S4) / ((S1 IS NOT NULL)::INT + (S2 IS NOT NULL)::INT + 2) END, 6) AS Afford4, round(CASE WHEN top > 7 AND top <= 9 THEN 1 + (S5 - 1) * 6 / 8 END, 6) AS S5_7, round(ipq, 6) AS IPQ_mean FROM n JOIN i USING (participant_id), t"),
    "item_qc": _with(_ANSWERS, "l AS (SELECT unnest(['S1', 'S2', 'S3', 'S4']) AS item, unnest([S1, CASE WHEN S2 > 2 THEN S2 END, S3, S4]) AS v FROM a)", select="SELECT item, count(v) AS n, count_if(v IS NULL)::BIGINT AS missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max FROM l GROUP BY ALL"),
    "scale_range_qc": _with(_ANSWERS, _LONG, select="SELECT item, round(min(v), 6) AS min, round(max(v), 6) AS max, CASE WHEN min(v) < 1 OR max(v) > 7 THEN 'outside_1_7_expected_range_review_required' ELSE 'within_1_7_expected_range' END AS status FROM l GROUP BY item"),
    "c1_only_qc": _with(_ANSWERS, "b AS (SELECT participant_id, scene_id::VARCHAR AS scene_id, 'c0_row_has_b_values_review_required' AS status FROM a WHERE Complexity <> 'A' AND S1 > 48)", select="SELECT * FROM b UNION ALL SELECT NULL, NULL, 'pass' WHERE NOT EXISTS (FROM b)"),
    "item_descriptives": _with(_ANSWERS, _LONG, select="SELECT item, WWR, Complexity, ExperienceGroup, count(DISTINCT participant_id) AS n_subjects, count(v) AS n_obs, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, round(median(v), 5) AS median, round(min(v), 5) AS min, round(max(v), 5) AS max, round(CASE WHEN count(v) > 2 AND var_pop(v) > 0 THEN skewness(v) END, 5) AS skew, round(CASE WHEN count(v) > 3 AND var_pop(v) > 0 THEN kurtosis(v) END, 5) AS kurtosis FROM l GROUP BY item, WWR, Complexity, ExperienceGroup"),
    "subject_means": _with(_ANSWERS, select="SELECT participant_id, round(avg(S1), 6) AS S1, round(avg(S2), 6) AS S2, round(avg(S3), 6) AS S3, round(avg(S4), 6) AS S4 FROM a GROUP BY ALL"),
    "cronbach_alpha": _with(_ANSWERS, "d AS (SELECT ExperienceGroup, count(*) AS n, (1 - (var_samp(S1) + var_samp(S2) + var_samp(S3) + var_samp(S4)) / var_samp(S1 + S2 + S3 + S4)) * 4 / 3 AS alpha FROM a GROUP BY ALL)", select="SELECT ExperienceGroup, 'scale' AS scale, 4 AS n_items, n, round(alpha, 6) AS alpha, CASE WHEN alpha >= 0.7 THEN 'acceptable_diagnostic' WHEN alpha >= 0.6 THEN 'check_before_composite' ELSE 'low_do_not_force_composite' END AS status FROM d"),
    "poly_contrasts": _with(_ANSWERS, _LONG, _CONTRAST, select="SELECT outcome, term, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(sd / sqrt(n), 5) AS se, round(mean / (sd / sqrt(n)), 5) AS t, round((mean / (sd / sqrt(n))) ** 2, 5) AS F, round((mean / (sd / sqrt(n))) ** 2 / ((mean / (sd / sqrt(n))) ** 2 + n - 1), 5) AS partial_eta_sq, CASE WHEN term = 'Linear' THEN CASE WHEN mean > 0 THEN 'linear_increase_15_to_75' WHEN mean < 0 THEN 'linear_decrease_15_to_75' ELSE 'linear_flat' END WHEN mean > 0 THEN 'u_shape_45_lowest' WHEN mean < 0 THEN 'inverted_u_45_highest' ELSE 'quadratic_flat' END AS direction FROM d"),
    "welch_pairs": _with(_ANSWERS, "g AS (SELECT ExperienceGroup AS lv, count(*) AS n, avg(S1) AS m, var_samp(S1) AS s FROM a GROUP BY ALL)", select="SELECT x.lv AS level_a, y.lv AS level_b, x.n AS n_a, y.n AS n_b, round(x.m, 5) AS mean_a, round(y.m, 5) AS mean_b, round((x.m - y.m) / sqrt(x.s / x.n + y.s / y.n), 5) AS t, round((x.s / x.n + y.s / y.n) ** 2 / ((x.s / x.n) ** 2 / (x.n - 1) + (y.s / y.n) ** 2 / (y.n - 1)), 5) AS df FROM g x JOIN g y ON x.lv < y.lv"),
    "marginal_means": _with(_ANSWERS, "l AS (SELECT S1 AS v, unnest(['WWR', 'Complexity', 'ExperienceGroup']) AS factor, unnest([WWR::VARCHAR, Complexity, ExperienceGroup]) AS level FROM a)", select="SELECT factor, level, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM l WHERE level IS NOT NULL GROUP BY ALL"),
    "order_corr": _with(_ANSWERS, select="SELECT unnest(['S1', 'S2', 'S3', 'flat']) AS outcome, unnest([n, n, n, n]) AS n, unnest([r1, r2, r3, NULL]) AS r FROM (SELECT count(*) AS n, round(corr(S4, S1), 6) AS r1, round(corr(S4, S2), 6) AS r2, round(corr(S4, S3), 6) AS r3 FROM a)"),
    "factor_sensitivity": _with(_ANSWERS, "l AS (SELECT unnest(['S1', 'S1', 'S2', 'S2']) AS outcome, unnest(['WWR', 'Complexity', 'WWR', 'Complexity']) AS factor, unnest([WWR::VARCHAR, Complexity, WWR::VARCHAR, Complexity]) AS level, unnest([S1, S1, S2, S2]) AS v FROM a)", select="SELECT outcome, factor, level, count(v) AS n, round(avg(v), 6) AS mean FROM l GROUP BY ALL"),
    "peak_index": _with(_ANSWERS, _LONG, "m AS (SELECT item AS outcome, avg(v) FILTER (WWR = 15) AS m0, avg(v) FILTER (WWR = 45) AS m1, avg(v) FILTER (WWR = 75) AS m2 FROM l GROUP BY item)", select="SELECT outcome, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m1 - (m0 + m2) / 2, 6) AS peak, CASE WHEN m1 - (m0 + m2) / 2 IS NULL THEN 'insufficient_wwr_granularity' ELSE 'exploratory_only_three_levels' END AS claim FROM m"),
    "subject_peak_index": _with(_ANSWERS, "m AS (SELECT participant_id, ExperienceGroup, avg(S1) FILTER (WWR = 15) AS m0, avg(S1) FILTER (WWR = 45) AS m1, avg(S1) FILTER (WWR = 75) AS m2 FROM a GROUP BY ALL)", select="SELECT participant_id, ExperienceGroup, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m1 - (m0 + m2) / 2, 6) AS peak FROM m WHERE m0 IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL"),
    "power_sensitivity": _with(_ANSWERS, "g AS (SELECT ExperienceGroup AS group_name, count(DISTINCT participant_id) AS n FROM a GROUP BY ALL)", select="SELECT * FROM g UNION ALL SELECT 'min_group_n', min(n) FROM g"),
    "level_contrasts": _with(_ANSWERS, "m AS (SELECT avg(S1) FILTER (WWR = 15) AS m0, avg(S1) FILTER (WWR = 45) AS m1, avg(S1) FILTER (WWR = 75) AS m2 FROM a)", select="SELECT 'S1' AS outcome, unnest(['mean_15', 'mean_45', 'mean_75', 'peak']) AS term, unnest([round(m0, 6), round(m1, 6), round(m2, 6), round(m1 - (m0 + m2) / 2, 6)]) AS estimate FROM m"),
    "modality_convergence": _with(_EEG, "l AS (SELECT unnest(['hf_ratio_20_40Hz', 'rms_mean_uV', 'view_dur_s']) AS metric, unnest([hf, rms, dur]) AS v FROM e)", select="SELECT metric, count(v) AS n, round(avg(v), 4) AS mean, CASE metric WHEN 'view_dur_s' THEN 'timing' ELSE 'eeg' END AS modality FROM l GROUP BY metric"),
    "weighted_rollup": _with(_ANSWERS, "d AS (SELECT ExperienceGroup, Complexity, WWR, avg(S1) AS mean, count(S1) AS n FROM a GROUP BY ALL)", select="SELECT ExperienceGroup, round(sum(mean * n) / sum(n), 6) AS weighted_mean, round(stddev_samp(mean) / sqrt(count(mean)), 6) AS sem, sum(n)::BIGINT AS n FROM d GROUP BY ExperienceGroup"),
    "claim_support": "WITH p AS (SELECT p_partkey AS claim_id, string_split(p_name, ' ') AS r FROM part), q AS (SELECT claim_id, r, list_sort(list_distinct(list_filter(r, lambda x: x NOT IN ('ring', 'red', 'small')))) AS miss FROM p) SELECT claim_id, array_to_string(miss, ';') AS missing, CASE WHEN len(miss) = 0 THEN 'moderate_pending_effect_tests' ELSE 'exploratory_incomplete_modalities' END AS level FROM q",
    "top_correlations": _with(_ANSWERS, "c AS (SELECT unnest(['S1', 'S2', 'S3', 'S4']) AS outcome, unnest([n, n, n, n]) AS n, unnest([r1, r2, r3, r4]) AS r FROM (SELECT count(WWR) AS n, corr(WWR, S1) AS r1, corr(WWR, S2) AS r2, corr(WWR, S3) AS r3, corr(WWR, S4) AS r4 FROM a))", select="SELECT outcome, n, round(r, 6) AS r FROM c ORDER BY abs(r) DESC LIMIT 3"),
    "source_index": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS source FROM part",
    "coding_columns": "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+(\\.[0-9]+)?)', 1)::DOUBLE AS brand_number, 'C' || CASE WHEN p_size % 2 = 0 THEN (p_size % 3)::VARCHAR ELSE 'X' END || '_W' || CASE WHEN p_size > 5 THEN p_size::VARCHAR ELSE 'NA' END AS condition_id, CASE WHEN contains(p_name, 'small') OR contains(p_name, 'red') THEN 'Low' WHEN contains(p_name, 'large') OR contains(p_name, 'blue') THEN 'High' ELSE p_name END AS coded, lower(p_type) IN ('true', '1', 'yes', 'y') AS truthy FROM part",
    "polygon_area": "SELECT p_partkey, round(p_size * (p_partkey % 11) / 2.0, 6)::DOUBLE AS area FROM part",
    "ols_coefficients": _with(_ANSWERS, select="SELECT unnest(['S1', 'S1', 'S2', 'S2']) AS outcome, unnest(['Intercept', 'S4', 'Intercept', 'S4']) AS term, unnest([round(regr_intercept(S1, S4), 6), round(regr_slope(S1, S4), 6), round(regr_intercept(S2, S4), 6), round(regr_slope(S2, S4), 6)]) AS estimate, unnest([count(*), count(*), count(*), count(*)]) AS n FROM a"),
    "marker_segments": _with(_SEGS, select="SELECT subject_id, ev_ix, condition, latency, end_latency, scene_id, ceil(scene_id / 6)::BIGINT AS block, CASE WHEN scene_id > 0 THEN (scene_id - 1) % 6 + 1 END AS position FROM k2"),
    "view_gray_pairs": _with(_SEGS, "k3 AS (SELECT *, first_value(CASE WHEN condition = 'gray' THEN {'i': ev_ix, 's': latency, 'e': end_latency} END IGNORE NULLS) OVER (PARTITION BY subject_id, scene_id ORDER BY ev_ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM k2)", select="SELECT subject_id, scene_id, ev_ix AS view_ix, latency AS view_start, end_latency AS view_end, nx.i AS gray_ix, nx.s AS gray_start, nx.e AS gray_end FROM k3 WHERE condition = 'view'"),
    "signal_qc": "WITH s AS (SELECT vec_id AS segment, (i - 1) % 4 AS channel, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), c AS (SELECT segment, channel, count(*) AS n, sqrt(avg(v * v)) AS rms, max(v) - min(v) AS ptp, stddev_samp(v) AS sd FROM s GROUP BY ALL) SELECT segment, round(avg(rms), 6) AS rms_mean_uV, round(avg(ptp), 6) AS peak_to_peak_uV, 0.0::DOUBLE AS nan_fraction, round(avg((coalesce(sd, 0) < 1e-6)::INT), 6) AS flat_fraction, sum(n)::BIGINT AS n_samples FROM c GROUP BY segment",
    "stream_bins": "SELECT (epoch_us(ts) // 21600000000) * 21600000000 AS bin_start, (epoch_us(ts) // 21600000000 + 1) * 21600000000 AS bin_end, user_id AS participant_id, count(*) AS samples, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2, 3",
    "stream_segments": "WITH s AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), q AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM s) SELECT min(t) AS segment_start, max(t) + 21600000000 AS segment_end, user_id AS participant_id, count(*) AS samples FROM q GROUP BY user_id, k",
    "root_summary": "WITH o AS (SELECT DISTINCT o_custkey AS id FROM orders), c AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal > 0), e AS (SELECT DISTINCT user_id AS id FROM events), u AS (SELECT id FROM o UNION SELECT id FROM c UNION SELECT id FROM e), f AS (SELECT id IN (FROM o) AS x, id IN (FROM c) AS y, id IN (FROM e) AS z FROM u), w AS (SELECT count_if(x) AS a, count_if(y) AS b, count_if(z) AS c, count_if(NOT x) AS na, count_if(NOT y) AS nb, count_if(NOT z) AS nc, count_if(x AND y AND z) AS al FROM f) SELECT unnest(['orders_ids', 'customer_ids', 'events_ids', 'missing_orders', 'missing_customer', 'missing_events', 'in_all']) AS metric, unnest([a, b, c, na, nb, nc, al])::BIGINT AS n FROM w",
    "eye_timing": _with(_GAZE, f"t AS (SELECT {_K}, min(t_ms) AS a, max(t_ms) AS z, count(*) AS n FROM g WHERE val_l <> 'error' AND fix_id < 6 GROUP BY ALL)", select=f"SELECT k.participant_id, k.scene_id, a AS eye_start_ms, z AS eye_end_ms, coalesce(n, 0) AS n_samples, CASE WHEN n > 1 THEN (z - a) / 1000.0::DOUBLE END AS eye_duration_s, n IS NULL AS missing_eye, n IS NULL AS missing_time FROM (SELECT DISTINCT {_K} FROM g) k LEFT JOIN t USING ({_K})"),
    "eye_qc_table": _with(_GAZE, f"s AS (SELECT *, coalesce(x BETWEEN 0 AND {SCREEN[0]} AND y BETWEEN 0 AND {SCREEN[1]} AND val_l IN ({', '.join(repr(x) for x in ACCEPTED)}), false) AS ok, t_ms - lag(t_ms) OVER (PARTITION BY {_K} ORDER BY seq) AS step FROM g)", select=f"SELECT {_K}, count(*) AS n_samples, count_if(ok)::BIGINT AS n_valid, round(avg(ok::INT), 6) AS valid_ratio, count_if(step > {3 * _DAY})::BIGINT AS gap_count, count_if(step < 0)::BIGINT AS reset_count, (1 + count_if(step < 0 OR step > {3 * _DAY}))::BIGINT AS segments, 'gaze' AS point_source, false AS missing_file FROM s GROUP BY {_K}"),
    "eeg_scene_qc": _with(_EEG, _FLAGS, _SUBJ, select=f"SELECT {_K}, dur AS view_dur_s, hf AS hf_ratio_20_40Hz, rms AS rms_mean_uV, 'robust' AS qc_policy, gone AS subject_excluded, reasons <> '' OR gone AS bad_eeg_quality FROM s"),
    "eeg_derived": _with(_EEG, select=f"SELECT {_K}, dur AS dur_s, rms AS gray_O_alpha, hf AS view_O_alpha, dur AS view_dur_s, round(rms - hf, 6) AS delta_O_alpha FROM e"),
    "scale_reliability": _with(_ANSWERS, "m AS (SELECT avg(S2) AS S2, avg(S3) AS S3 FROM a GROUP BY participant_id)", "d AS (SELECT 'four' AS scale, 4 AS n_items, count(*) AS n, (1 - (var_samp(S1) + var_samp(S2) + var_samp(S3) + var_samp(S4)) / var_samp(S1 + S2 + S3 + S4)) * 4 / 3 AS alpha FROM a UNION ALL SELECT 'two', 2, count(*), (1 - (var_samp(S1) + var_samp(S4)) / var_samp(S1 + S4)) * 2 FROM a WHERE Complexity = 'A' UNION ALL SELECT 'means', 2, count(*), (1 - (var_samp(S2) + var_samp(S3)) / var_samp(S2 + S3)) * 2 FROM m)", select="SELECT scale, n_items, n, round(alpha, 6) AS alpha, CASE WHEN alpha >= 0.7 THEN 'acceptable_diagnostic' WHEN alpha >= 0.6 THEN 'check_before_composite' ELSE 'low_do_not_force_composite' END AS status FROM d"),
    "panel_sources": _with(_ANSWERS, _LONG, _CONTRAST, _EEG, "cr AS (SELECT unnest(['S1', 'S2', 'S3', 'S4']) AS o, unnest([n, n, n, n]) AS n, unnest([r1, r2, r3, r4]) AS r FROM (SELECT count(WWR) AS n, corr(WWR, S1) AS r1, corr(WWR, S2) AS r2, corr(WWR, S3) AS r3, corr(WWR, S4) AS r4 FROM a))", "cl AS (SELECT p_partkey, string_split(p_name, ' ') AS r, list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('ring', 'red', 'small')) AS miss FROM part)", "lv AS (SELECT p_partkey, CASE WHEN len(miss) = 0 THEN 'moderate_pending_effect_tests' ELSE 'exploratory_incomplete_modalities' END AS level FROM cl)",
        select="""SELECT 'a' AS panel, 'S1' AS metric, WWR::VARCHAR AS group_name, Complexity AS subgroup, NULL::DOUBLE AS value, round(avg(S1), 5) AS mean, round(stddev_samp(S1) / sqrt(count(S1)), 5) AS sem, count(S1) AS n, NULL::VARCHAR AS label, 'descriptives' AS source FROM a GROUP BY WWR, Complexity
UNION ALL SELECT 'b', outcome, term, NULL, round(mean / (sd / sqrt(n)), 5), round(mean, 5), round(sd / sqrt(n), 5), n, CASE WHEN term = 'Linear' THEN CASE WHEN mean > 0 THEN 'linear_increase_15_to_75' WHEN mean < 0 THEN 'linear_decrease_15_to_75' ELSE 'linear_flat' END WHEN mean > 0 THEN 'u_shape_45_lowest' WHEN mean < 0 THEN 'inverted_u_45_highest' ELSE 'quadratic_flat' END, 'contrasts' FROM d WHERE outcome IN ('S1', 'S2')
UNION ALL SELECT 'c', 'view_dur_s', 'timing', NULL, round(avg(dur), 5), NULL, NULL, count(dur), NULL, 'convergence' FROM e
UNION ALL SELECT * FROM (SELECT 'd', o, NULL, NULL, round(r, 5), NULL, NULL, n, NULL, 'order_correlation' FROM cr ORDER BY abs(r) DESC LIMIT 3)
UNION ALL SELECT 'e', p_partkey::VARCHAR, NULL, NULL, CASE level WHEN 'moderate_pending_effect_tests' THEN 2.0 ELSE 1.0 END, NULL, NULL, NULL, level, 'claims' FROM lv"""),
    "scene_folders": f"SELECT p_partkey, {_PARSED} FROM (SELECT *, {_FOLDER} AS f FROM part)",
    "gaze_scan": f"SELECT path, {_FILE}, condition_code, folder_scene_id FROM (SELECT *, {_PARSED} FROM ({_LISTING})) WHERE NOT contains(f, '适应') AND path NOT LIKE '%notes%'",
    "resolved_orders": f"""SELECT p_partkey::VARCHAR AS split_id, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS participant_order, p_partkey % 3 = 2 AS order_missing,
 CASE WHEN folder_scene_id IS NOT NULL THEN 'simple_condition_folder' WHEN new THEN 'neworder2' WHEN p_partkey % 3 = 0 THEN 'order2' ELSE 'order1' END AS order_scheme,
 CASE WHEN folder_scene_id IS NOT NULL THEN condition_code WHEN new THEN label WHEN p_partkey % 3 = 0 THEN order_code_2 ELSE order_code_1 END AS order_code, coalesce(folder_block, b) AS block,
 CASE WHEN folder_scene_id IS NOT NULL THEN folder_position WHEN new THEN place WHEN p_partkey % 3 = 0 THEN 7 - spot ELSE spot END AS position, (coalesce(folder_block, b) - 1) * 6 + position AS scene_id
 FROM (SELECT *, {_PARSED}, 1 + p_partkey % 5 % 2 AS b, 1 + p_partkey % 6 AS spot, p_partkey % 3 = 0 AND day >= DATE '2026-05-01' AS new FROM ({_LISTING})) LEFT JOIN (VALUES {_NEW}) AS o(ob, oc, label, place) ON ob = b AND oc = condition_code
 WHERE condition_code IS NOT NULL AND path NOT LIKE '%notes%'""",
    "recording_aliases": f"SELECT p_partkey::VARCHAR AS split_id, regexp_extract(path, 'raw_(name[^_]*)_', 1) AS subject, 'name' || p_partkey % 40 AS participant_id, CASE WHEN p_partkey % 7 = 0 THEN 'suffix_note' ELSE '' END AS alias_source FROM ({_LISTING}) WHERE NOT contains(f, '适应') AND path NOT LIKE '%notes%'",
    "participants": f"SELECT participant_id, Experience AS ExperienceRaw, {_GROUP} AS ExperienceGroup, {_GENDER} AS Gender, Gender AS GenderRaw, TRY_CAST(Age AS DOUBLE) AS Age, RecruitmentBatch, RecruitmentBatch = 'Supplement' AS SupplementFlag, exclude FROM ({_PEOPLE})",
    "scene_table": "SELECT p_brand AS participant_id, p_partkey AS scene_id, p_size::DOUBLE AS WWR_numeric, '/data/' || p_brand || '.csv' AS eye_csv_path, true AS no_block FROM part",
    "answers_with_design": f"SELECT o_custkey::VARCHAR AS participant_id, o_orderkey AS scene_id, n::DOUBLE AS S1, o_orderstatus AS Cond, o_orderpriority AS block, {_GROUP} AS ExperienceGroup, {_GENDER} AS Gender FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey LEFT JOIN ({_PEOPLE}) ON participant_id = o_custkey::VARCHAR",
    "survey_long": """WITH s AS (SELECT c_custkey::VARCHAR AS participant_id, c_nationkey AS k, c_acctbal FROM customer)
SELECT participant_id, unnest([1, 6, 7, 12])::BIGINT AS scene_id, unnest([NULL, k % 6, NULL, NULL])::DOUBLE AS B1, unnest([NULL, NULL, NULL, CASE WHEN c_acctbal > 0 THEN k % 3 END])::DOUBLE AS B2, unnest([k % 7, NULL, k % 4, NULL])::DOUBLE AS S1, unnest([k % 5, NULL, NULL, NULL])::DOUBLE AS S5, (k % 2)::DOUBLE AS IPQ1 FROM s""",
    "survey_metadata": f"SELECT participant_id || '·x' AS questionnaire_subject_id, participant_id, ((length(participant_id) + 1) % 3)::BIGINT AS \"Order\", Experience, {_GENDER} AS Gender, Gender AS GenderRaw, '' AS Age FROM ({_PEOPLE})",
    "name_coding": "SELECT p_partkey, p_brand AS canonical, '·' || p_brand AS single, p_brand || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-' || p_size || 'x' END AS bare FROM part",
    "term_support": "WITH t AS (SELECT lower(p_type) AS t, CASE WHEN p_type LIKE '%STEEL%' THEN 0.5 ELSE (p_partkey % 97) / 100.0 END AS p FROM part) SELECT f AS fragment, CASE WHEN count(*) = 0 THEN 'unsupported_no_model' WHEN count_if(contains(t, f) AND p < 0.05) > 0 THEN 'moderate' WHEN count_if(contains(t, f)) > 0 THEN 'exploratory' ELSE 'unsupported_no_term' END AS level FROM t, (SELECT unnest(['promo', 'steel', 'absent']) AS f) GROUP BY f",
    "support_scores": "SELECT p_partkey, [2.0, 1.5, 1.0, 0.0, NULL][1 + p_size % 5]::DOUBLE AS score FROM part",
    "empty_bins": _with(_GAZE, _VALID, select=f"SELECT DISTINCT {_K}, floor((t_ms - f) / {_BIN})::BIGINT AS bin_index, floor((t_ms - f) / {_BIN}) * {_BIN} AS bin_start_ms, floor((t_ms - f) / {_BIN}) * {_BIN} + {_BIN} AS bin_end_ms, '' AS class_name, 0::BIGINT AS samples, false AS visited FROM (SELECT *, min(t_ms) OVER (PARTITION BY {_K}) AS f FROM v)"),
    "eeg_durations": _with(_EEG, select=f"SELECT {_K}, dur AS eeg_view_dur_s FROM e"),
    "recording_summary": f"""WITH s AS (SELECT *, 'name' || p_partkey % 40 AS who, 'name' || p_partkey % 40 || CASE WHEN p_partkey % 7 = 0 THEN '-12-3' ELSE '' END AS raw FROM ({_LISTING}) WHERE NOT contains(f, '适应') AND path NOT LIKE '%notes%'),
 g AS (SELECT 'name' || c_custkey AS who, c_acctbal > 0 AS ok FROM customer)
SELECT unnest(['eye_csv_count', 'eye_subject_count_raw', 'eye_scene_folder_count', 'eye_aoi_json_count', 'eye_missing_aoi_json_rows', 'eye_subject_count_after_alias', 'eye_suffix_note_alias_rows', 'aliased_eye_rows', 'eeg_set_count', 'eeg_fdt_count', 'matched_subject_count']) AS metric,
 unnest([n, raws, folders, 0, n, whos, notes, notes, (SELECT count(*) FROM g), (SELECT count_if(ok) FROM g), (SELECT count(DISTINCT s.who) FROM s JOIN g USING (who))])::BIGINT AS n
FROM (SELECT count(*) AS n, count(DISTINCT raw) AS raws, count(DISTINCT f) AS folders, count(DISTINCT who) AS whos, count_if(p_partkey % 7 = 0) AS notes FROM s)""",
    "hf_ratio": """WITH s AS (SELECT vec_id AS segment, i - 1 AS t, embedding[i]::DOUBLE * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / 63)) AS y FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
p AS (SELECT segment, k, (sum(y * cos(2 * pi() * k * t / 64)) ** 2 + sum(y * sin(2 * pi() * k * t / 64)) ** 2) * CASE WHEN k = 32 THEN 1 ELSE 2 END AS v FROM s, (SELECT unnest(range(1, 33)) AS k) GROUP BY segment, k),
r AS (SELECT segment, sum(v * CASE WHEN k IN (20, 32) THEN 0.5 ELSE 1 END) FILTER (k >= 20) / sum(v * CASE WHEN k IN (1, 32) THEN 0.5 ELSE 1 END) AS share FROM p GROUP BY segment)
SELECT segment, round(share, 6) AS hf_ratio_20_40Hz, share > 0.4 AS eeg_legacy_hf_flag FROM r""",
    "recording_lists": f"""WITH s AS (SELECT *, 'name' || p_partkey % 40 AS who, 'name' || p_partkey % 40 || CASE WHEN p_partkey % 7 = 0 THEN '-12-3' ELSE '' END AS raw FROM ({_LISTING}) WHERE NOT contains(f, '适应') AND path NOT LIKE '%notes%'),
 g AS (SELECT 'name' || c_custkey AS who FROM customer WHERE c_custkey % 3 > 0), q AS (SELECT 'name' || c_custkey AS who FROM customer WHERE c_custkey % 4 > 0)
SELECT DISTINCT 'eye_only_subjects' AS list, who AS value FROM s WHERE who NOT IN (FROM g) UNION ALL SELECT 'eeg_only_subjects', who FROM g WHERE who NOT IN (SELECT who FROM s)
UNION ALL SELECT DISTINCT 'eye_suffix_note_alias_subjects', raw FROM s WHERE raw <> who UNION ALL SELECT DISTINCT 'scene_folders', f FROM s
UNION ALL SELECT DISTINCT 'questionnaire_missing_for_eye_subjects', who FROM s WHERE who NOT IN (FROM q)""",
    "alias_list": f"""SELECT DISTINCT 'name' || p_partkey % 40 || '-12-3' AS subject, 'name' || p_partkey % 40 AS participant_id, strftime(DATE '2026-04-01' + (p_partkey % 60)::INT, '%y%m%d') || '1200' AS record_id, 'suffix_note' AS alias_source
FROM ({_LISTING}) WHERE NOT contains(f, '适应') AND path NOT LIKE '%notes%' AND p_partkey % 7 = 0""",
    "run_summary": _with(_GAZE, _VALID, select=f"SELECT unnest(['gaze_valid', 'trials', 'answers', 'eeg_scenes']) AS stage, unnest([(SELECT count(*) FROM v), (SELECT count(*) FROM (SELECT DISTINCT {_K} FROM v)), (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), (SELECT count(*) FROM orders)]) AS rows"),
    "segment_marks": _with(_SEGS, select="SELECT subject_id, ev_ix, round((end_latency / 1000 - latency / 1000) / 3600.0, 6) AS view_dur_s, false AS near_boundary, coalesce((end_latency / 1000 - latency / 1000) / 3600.0 >= 0.5, false) AS segment_valid_duration FROM k2"),
    "band_power": """WITH s AS (SELECT vec_id AS segment, 'roi' || label AS roi, i - 1 AS t, embedding[i]::DOUBLE * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / 63)) AS y FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
p AS (SELECT segment, roi, k / 2.0 AS f, (sum(y * cos(2 * pi() * k * t / 64)) ** 2 + sum(y * sin(2 * pi() * k * t / 64)) ** 2) * 2 / (32.0 * (SELECT sum((0.54 - 0.46 * cos(2 * pi() * j / 63)) ** 2) FROM range(64) r(j))) AS v FROM s, (SELECT unnest(range(1, 32)) AS k) GROUP BY segment, roi, k),
b AS (SELECT segment, roi, sum(v * CASE WHEN f IN (4, 8) THEN 0.25 ELSE 0.5 END) FILTER (f BETWEEN 4 AND 8) AS theta, sum(v * CASE WHEN f IN (8, 13) THEN 0.25 ELSE 0.5 END) FILTER (f BETWEEN 8 AND 13) AS alpha, sum(v * CASE WHEN f IN (13, 15.5) THEN 0.25 ELSE 0.5 END) FILTER (f BETWEEN 13 AND 15.5) AS beta0, max(v) FILTER (f = 15.5) AS v31 FROM p GROUP BY ALL),
z AS (SELECT segment, roi, sum(y * (CASE WHEN t % 2 = 0 THEN 1 ELSE -1 END)) ** 2 / (32.0 * (SELECT sum((0.54 - 0.46 * cos(2 * pi() * j / 63)) ** 2) FROM range(64) r(j))) AS v32 FROM s GROUP BY ALL),
c AS (SELECT segment, roi, theta, alpha, beta0 + 0.25 * v31 + 0.25 * v32 AS beta FROM b JOIN z USING (segment, roi))
SELECT segment, roi, round(theta, 6) AS theta, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(theta / alpha, 6) AS TAR, round(theta / beta, 6) AS TBR, round(beta / alpha, 6) AS BA FROM c""",
    "contrast_p_values": _with(_ANSWERS, _LONG, _CONTRAST, f"w AS (SELECT *, mean / (sd / sqrt(n)) AS t, n - 1 AS nu FROM d), {_TAIL}", select="SELECT outcome, term, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(sd / sqrt(n), 5) AS se, round(t, 5) AS t, round(t * t, 5) AS F, round(t * t / (t * t + n - 1), 5) AS partial_eta_sq, CASE WHEN term = 'Linear' THEN CASE WHEN mean > 0 THEN 'linear_increase_15_to_75' WHEN mean < 0 THEN 'linear_decrease_15_to_75' ELSE 'linear_flat' END WHEN mean > 0 THEN 'u_shape_45_lowest' WHEN mean < 0 THEN 'inverted_u_45_highest' ELSE 'quadratic_flat' END AS direction, round(p, 5) AS p_value FROM w JOIN tail USING (t, nu)"),
    "welch_p_values": _with(_ANSWERS, "g AS (SELECT Complexity AS lv, count(*) AS n, avg(S2) AS m, var_samp(S2) AS s FROM a GROUP BY ALL)", f"w AS (SELECT x.lv AS level_a, y.lv AS level_b, x.n AS n_a, y.n AS n_b, x.m AS mean_a, y.m AS mean_b, (x.m - y.m) / sqrt(x.s / x.n + y.s / y.n) AS t, (x.s / x.n + y.s / y.n) ** 2 / ((x.s / x.n) ** 2 / (x.n - 1) + (y.s / y.n) ** 2 / (y.n - 1)) AS nu FROM g x JOIN g y ON x.lv < y.lv), {_TAIL}", select="SELECT level_a, level_b, n_a, n_b, round(mean_a, 5) AS mean_a, round(mean_b, 5) AS mean_b, round(t, 5) AS t, round(nu, 5) AS df, round(p, 5) AS p_value FROM w JOIN tail USING (t, nu)"),
}
