"""The SQL twins of the library's queries, for DuckDB: named pieces that are put together as far as a query needs them."""

from __future__ import annotations

import re

from busloom.operators import rules
from busloom.operators.windows import FS_A_RAW, FS_B

N, K = 16, 48

PIECES: dict[str, str] = {}


def piece(name: str, sql: str) -> None:
    PIECES[name] = sql


def with_pieces(sql: str) -> str:
    """sql with the pieces that it names, directly or through others, before it, in the order of their definition."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in PIECES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(PIECES[name])

    visit(sql)
    parts = [f"{n} AS ({PIECES[n]})" for n in PIECES if n in need]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


piece(
    "fr",
    """SELECT 'v' || (user_id % 3) AS vehicle, 'v' || (user_id % 3) || '_' || event_type AS capture,
    CASE event_type WHEN 'view' THEN 'benign' WHEN 'click' THEN 'benign' WHEN 'error' THEN 'dos' WHEN 'signup' THEN 'fuzzing' ELSE 'suspension' END AS family,
    event_id AS seq, epoch_us(ts) AS us,
    CASE WHEN event_type = 'signup' AND k < 3 THEN 900 + k ELSE user_id % 40 + 20 * (user_id % 3) END::INT AS aid,
    k % 9 AS dlc, [CASE WHEN i < k % 9 THEN (event_id * (i + 3) + k) % 256 ELSE -1 END::INT FOR i IN range(8)] AS b,
    CASE WHEN event_type IN ('error', 'signup') AND k < 3 THEN 1 ELSE 0 END AS y,
    CASE WHEN event_type = 'purchase' THEN 1704844800000000 END AS s0, CASE WHEN event_type = 'purchase' THEN 1705017600000000 END AS s1
    FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events)""",
)
piece("gaps", "SELECT *, (us - lag(us) OVER (PARTITION BY vehicle, capture, aid ORDER BY us, seq)) / 1e6 AS gap FROM fr WHERE family = 'benign'")
piece("modal", "SELECT vehicle, aid, dlc AS ref_dlc FROM (SELECT vehicle, aid, dlc, row_number() OVER (PARTITION BY vehicle, aid ORDER BY count(*) DESC, dlc) AS r FROM gaps GROUP BY vehicle, aid, dlc) WHERE r = 1")
piece("timing", "SELECT vehicle, aid, count(*) AS cnt, quantile_cont(CASE WHEN gap > 0 THEN gap END, [0.25, 0.5, 0.75]) AS p FROM gaps GROUP BY vehicle, aid")
piece(
    "idp",
    """SELECT vehicle, aid, cnt, p[2] AS period, p[3] - p[1] AS iqr, ref_dlc,
    coalesce(cnt >= 5 AND p[2] > 0 AND p[2] <= 1e9 AND (p[3] - p[1]) / greatest(p[2], 1e-9) <= 5e0, false) AS is_periodic FROM timing JOIN modal USING (vehicle, aid)""",
)
piece("bcap", "SELECT vehicle, capture, count(*) AS n, (max(us) - min(us)) / 1e6 AS dur FROM fr WHERE family = 'benign' GROUP BY vehicle, capture")
piece(
    "vp",
    """SELECT vehicle, n_frames, seconds, n_frames / greatest(seconds, 1e-6) AS bus_rate, n_ids FROM
    (SELECT vehicle, sum(n)::BIGINT AS n_frames, sum(dur) AS seconds FROM bcap GROUP BY vehicle) JOIN (SELECT vehicle, count(DISTINCT aid) AS n_ids FROM fr WHERE family = 'benign' GROUP BY vehicle) USING (vehicle)""",
)
piece("voc", f"SELECT vehicle, aid, cnt, r - 1 AS pos FROM (SELECT vehicle, aid, count(*) AS cnt, row_number() OVER (PARTITION BY vehicle ORDER BY count(*) DESC, aid) AS r FROM fr WHERE family = 'benign' GROUP BY vehicle, aid) WHERE r <= {K}")
piece("shares", "SELECT vehicle, aid, count(*) / sum(count(*)) OVER (PARTITION BY vehicle) AS share FROM fr WHERE family = 'benign' GROUP BY vehicle, aid")
piece("targets", "SELECT DISTINCT vehicle AS target FROM fr WHERE family = 'benign'")
piece("pvoc", f"SELECT target, aid, share, r - 1 AS pos FROM (SELECT target, aid, sum(share) AS share, row_number() OVER (PARTITION BY target ORDER BY round(sum(share), 9) DESC, aid) AS r FROM shares JOIN targets ON vehicle <> target GROUP BY target, aid) WHERE r <= {K}")
piece(
    "m0",
    """SELECT *, lag(b) OVER same AS b0, (us - lag(us) OVER same) / 1e6 AS dt_id, coalesce((us - lag(us) OVER bus) / 1e6, 0e0) AS dt, row_number() OVER bus - 1 AS ord, count(*) OVER (PARTITION BY capture) AS n_capture
    FROM fr WINDOW bus AS (PARTITION BY capture ORDER BY seq), same AS (PARTITION BY capture, aid ORDER BY us, seq)""",
)
piece(
    "msg",
    """SELECT m0.*, period, ref_dlc, CASE WHEN b0 IS NOT NULL THEN len([i FOR i IN range(1, 9) IF b[i] <> b0[i]])::DOUBLE END AS ham, dt_id / (period + 1e-9) AS period_ratio,
    CASE WHEN idp.aid IS NULL THEN 1e0 ELSE 0e0 END AS unseen, CASE WHEN ref_dlc <> m0.dlc THEN 1e0 ELSE 0e0 END AS dlc_mismatch,
    coalesce(list_sum([-(len([z FOR z IN pr IF z = x]) / len(pr)::DOUBLE) * log2(len([z FOR z IN pr IF z = x]) / len(pr)::DOUBLE + 1e-9) FOR x IN list_distinct(pr)]), 0e0) AS ent,
    CASE WHEN len(pr) > 0 AND len([z FOR z IN pr IF z <> 0]) = 0 THEN 1e0 ELSE 0e0 END AS allzero, CASE WHEN len(pr) > 0 AND len([z FOR z IN pr IF z <> 255]) = 0 THEN 1e0 ELSE 0e0 END AS allff
    FROM (SELECT *, [z FOR z IN b IF z >= 0] AS pr FROM m0) m0 LEFT JOIN idp ON m0.vehicle = idp.vehicle AND m0.aid = idp.aid""",
)
piece("w", f"SELECT *, ord // {N} AS widx FROM msg WHERE ord // {N} < n_capture // {N} AND n_capture // {N} >= 2")
piece("wl", f"SELECT *, ord // {N} AS widx FROM m0 WHERE ord // {N} < n_capture // {N} AND n_capture // {N} >= 2")
piece("ids", f"SELECT capture, widx, sum(-(c / {N}e0) * log2(c / {N}e0 + 1e-9)) AS id_entropy, count(*)::DOUBLE AS id_unique, max(c / {N}e0) AS id_max_share FROM (SELECT capture, widx, aid, count(*) AS c FROM wl GROUP BY capture, widx, aid) GROUP BY capture, widx")
piece("ends", "SELECT vehicle, capture, widx, arg_max(us, seq) AS us FROM wl GROUP BY vehicle, capture, widx")
piece("probes", "SELECT e.capture, e.widx, e.us, p.aid, p.period FROM ends e JOIN idp p ON e.vehicle = p.vehicle AND p.is_periodic")
piece(
    "stale",
    """SELECT capture, widx, max(s) AS stale_max, count(CASE WHEN s > 3 THEN 1 END) / greatest(count(s), 1)::DOUBLE AS stale_frac FROM
    (SELECT p.capture, p.widx, (p.us - f.us) / 1e6 / p.period AS s FROM probes p ASOF LEFT JOIN fr f ON p.capture = f.capture AND p.aid = f.aid AND p.us >= f.us) GROUP BY capture, widx""",
)
_share = lambda c: f"count(CASE WHEN {c} THEN 1 END) / {N}e0"
piece(
    "base",
    f"""SELECT vehicle, capture, family, widx, avg(dt) AS dt_mean, stddev_pop(dt) AS dt_std, quantile_cont(dt, 0.95) AS dt_p95, max(dt) AS dt_max, sum(dt) AS dt_sum, list(dt) AS dts,
    avg(unseen) AS unseen_rate, avg(dlc_mismatch) AS dlc_mismatch_rate, avg(period_ratio) AS pr_mean, stddev_pop(period_ratio) AS pr_std, quantile_cont(period_ratio, 0.05) AS pr_p05, quantile_cont(period_ratio, 0.95) AS pr_p95,
    {_share("period_ratio < 0.5e0")} AS pr_lt_half, {_share("period_ratio > 2e0")} AS pr_gt_two, avg(abs(period_ratio - 1)) AS pr_absdev_mean, max(abs(period_ratio - 1)) AS pr_absdev_max, {_share("dt_id IS NULL")} AS dtid_nan_frac,
    avg(ham) AS ham_mean, stddev_pop(ham) AS ham_std, max(ham) AS ham_max, {_share("ham = 0")} AS ham_zero_frac, avg(ent) AS ent_mean, stddev_pop(ent) AS ent_std, min(ent) AS ent_min, avg(allzero) AS allzero_frac, avg(allff) AS allff_frac,
    avg(dlc) AS dlc_mean, stddev_pop(dlc) AS dlc_std FROM w GROUP BY vehicle, capture, family, widx""",
)
piece(
    "full0",
    f"""SELECT base.*, ids.id_entropy, ids.id_unique, ids.id_max_share, stale.stale_max, stale.stale_frac, dt_std / (dt_mean + 1e-9) AS dt_cv, {N}e0 / (dt_sum + 1e-9) / (bus_rate + 1e-9) AS bus_rate_norm,
    len([x FOR x IN dts IF x > dt_mean * 3]) / {N}e0 AS idle_frac, (dt_std - dt_mean) / (dt_std + dt_mean + 1e-9) AS burstiness, id_entropy / (log2(id_unique + 1e-9) + 1e-9) AS id_entropy_norm, id_unique / {N}e0 AS id_unique_frac,
    dt_mean / (1 / greatest(bus_rate, 1e-9)) AS dt_mean_norm, dt_p95 / (1 / greatest(bus_rate, 1e-9)) AS dt_p95_norm, dt_max / (1 / greatest(bus_rate, 1e-9)) AS dt_max_norm, id_unique / greatest(n_ids, 1) AS id_unique_norm
    FROM base JOIN ids USING (capture, widx) LEFT JOIN stale USING (capture, widx) JOIN vp USING (vehicle)""",
)
piece("fsb", "SELECT vehicle, capture, family, widx, " + ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in FS_B) + " FROM full0")
_byte = [f"greatest(b[{i + 1}], 0)" for i in range(8)]
_raw = ["avg(aid)", "stddev_pop(aid)", "min(aid)", "max(aid)", "quantile_cont(aid, 0.25)", "quantile_cont(aid, 0.75)", "avg(dt)", "stddev_pop(dt)", "max(dt)", "avg(dlc)", "stddev_pop(dlc)"]
_raw += [f"avg({x})" for x in _byte] + [f"stddev_pop({x})" for x in _byte]
piece("fsa", "SELECT vehicle, capture, family, widx, " + ", ".join(f"({x})::DOUBLE AS {c}" for x, c in zip(_raw, FS_A_RAW, strict=True)) + " FROM wl GROUP BY vehicle, capture, family, widx")
piece("lab", "SELECT vehicle, capture, family, widx, greatest(max(y), coalesce((arg_max(us, seq) >= any_value(s0) AND arg_min(us, seq) <= any_value(s1))::INT, 0)) AS y FROM wl GROUP BY vehicle, capture, family, widx")
piece("lq", "SELECT *, (4 * (row_number() OVER (PARTITION BY capture, y ORDER BY widx) - 1)) // count(*) OVER (PARTITION BY capture, y) AS q FROM lab")
piece(
    "winsec",
    f"""SELECT vehicle, sum(CASE WHEN family = 'benign' THEN dur ELSE 0 END) / greatest(sum(CASE WHEN family = 'benign' THEN k ELSE 0 END), 1) AS win_seconds, sum(dur) / greatest(sum(k), 1) AS win_seconds_all FROM
    (SELECT vehicle, capture, family, count(*) // {N} AS k, (arg_max(us, seq) - arg_min(us, seq)) / 1e6 AS dur FROM fr GROUP BY vehicle, capture, family HAVING count(*) // {N} >= 2) GROUP BY vehicle""",
)
_features = list(dict.fromkeys([*rules.HIGH, *rules.TWO_SIDED, *rules.TWO_SIDED34]))
piece("feat", "SELECT f.*, l.y, l.q, (l.y = 0 AND l.q <= 1) AS is_calib, (l.q >= 2 OR l.y = 1) AS is_eval FROM fsb f JOIN lq l USING (vehicle, capture, family, widx)")
piece("long", " UNION ALL ".join(f"SELECT vehicle, capture, family, widx, y, q, is_calib, is_eval, '{f}' AS feature, {f} AS x FROM feat" for f in _features))
piece(
    "refs",
    """SELECT target, scope, feature, p[2] AS med, greatest(p[3] - p[1], 1e-6) AS scale FROM (SELECT target, scope, feature, quantile_cont(x, [0.25, 0.5, 0.75]) AS p FROM
    (SELECT target, 'fleet' AS scope, feature, x FROM long JOIN targets ON vehicle <> target WHERE y = 0 UNION ALL SELECT vehicle, 'target', feature, x FROM long WHERE is_calib) GROUP BY target, scope, feature)""",
)
piece("zed", "SELECT l.vehicle AS target, r.scope, l.capture, l.family, l.widx, l.y, l.is_calib, l.is_eval, l.feature, l.x, (l.x - r.med) / r.scale AS z FROM long l JOIN refs r ON l.vehicle = r.target AND l.feature = r.feature")
_in = lambda fs: ", ".join(f"'{f}'" for f in fs)
piece(
    "zref",
    f"""SELECT target, scope, feature, CASE WHEN feature IN ({_in(rules.TWO_SIDED)}) THEN abs(z) ELSE z END AS v FROM (SELECT f.target, f.scope, f.feature, (f.x - r.med) / r.scale AS z FROM
    (SELECT target, 'fleet' AS scope, feature, x FROM long JOIN targets ON vehicle <> target WHERE y = 0 UNION ALL SELECT vehicle, 'target', feature, x FROM long WHERE is_calib) f JOIN refs r USING (target, scope, feature))""",
)
piece("ztop", "SELECT target, scope, feature, count(*) AS n, max(v) AS top, quantile_cont(v, 0.99) AS p99 FROM zref GROUP BY target, scope, feature")
_b34 = "CASE WHEN feature IN ('id_entropy', 'id_unique_frac', 'dt_mean', 'ent_mean') THEN abs(z) ELSE z END"
piece(
    "zref34",
    f"""SELECT target, scope, feature, {_b34} AS v FROM (SELECT f.target, f.scope, f.feature, (f.x - r.med) / r.scale AS z FROM
    (SELECT target, 'fleet' AS scope, feature, x FROM long JOIN targets ON vehicle <> target WHERE y = 0 UNION ALL SELECT vehicle, 'target', feature, x FROM long WHERE is_calib) f JOIN refs r USING (target, scope, feature)) WHERE feature NOT IN ('stale_max', 'dt_mean_norm')""",
)
piece("ztop34", "SELECT target, scope, feature, count(*) AS n, max(v) AS top, quantile_cont(v, 0.99) AS p99 FROM zref34 GROUP BY target, scope, feature")
_single = " ".join(f"max(CASE WHEN feature = '{f}' THEN z END) * {s} AS \"{m}\"," for m, (f, s) in rules.SINGLE.items())
piece(
    "wide",
    f"""SELECT target, scope, capture, family, widx, y, is_calib, is_eval, {_single} max(CASE WHEN feature = 'unseen_rate' THEN x END) * 1000 AS "Rule:UnseenID",
    max(CASE WHEN feature IN ({_in(rules.HIGH)}) THEN z WHEN feature IN ({_in(rules.TWO_SIDED)}) THEN abs(z) END) AS "Rule:Combined" FROM zed GROUP BY ALL""",
)
_models = [*rules.SINGLE, "Rule:UnseenID", "Rule:Combined"]
piece("scores", " UNION ALL ".join(f"SELECT target, CASE WHEN scope = 'target' THEN '{m}@target' ELSE '{m}' END AS model, capture, family, widx, y, is_calib, is_eval, round(\"{m}\", 6) + 0e0 AS score FROM wide" for m in _models))
piece("sizes", "SELECT target, model, count(*) AS n_calib, any_value(win_seconds) AS win_seconds FROM scores JOIN winsec ON target = vehicle WHERE is_calib GROUP BY target, model")
piece(
    "points",
    """SELECT target, model, n_calib, win_seconds, tag, allowed, floor(allowed * n_calib) AS k, allowed * n_calib >= 1 AS resolvable FROM
    (SELECT *, CASE WHEN hourly THEN least(greatest(budget * win_seconds / 3600, 0e0), 1e0) ELSE budget END AS allowed FROM sizes, (VALUES ('fa1', 1e0, true), ('fa10', 1e1, true), ('fa100', 1e2, true), ('fpr0.001', 1e-3, false), ('fpr0.01', 1e-2, false)) t(tag, budget, hourly))""",
)
piece("steps", "SELECT target, model, score, sum(count(*)) OVER (PARTITION BY target, model ORDER BY score DESC) AS ge FROM scores WHERE is_calib GROUP BY target, model, score")
piece("limits", "SELECT p.target, p.model, p.n_calib, p.win_seconds, p.tag, p.k, p.resolvable, min(CASE WHEN s.ge <= p.k THEN s.score END) AS thr, max(s.score) AS top FROM points p LEFT JOIN steps s USING (target, model) GROUP BY ALL")
piece("preds", "SELECT s.*, l.tag, l.win_seconds, CASE WHEN thr IS NOT NULL THEN score >= thr ELSE score > top END::INT AS pred FROM scores s JOIN limits l USING (target, model) WHERE is_eval")
piece("conf", "SELECT target, model, tag, sum(pred * y) AS tp, sum(pred * (1 - y)) AS fp, sum(y) AS pos, count(*) AS n, any_value(win_seconds) AS win_seconds FROM preds GROUP BY target, model, tag")
piece("rsteps", "SELECT target, model, score, sum(y) AS p, sum(1 - y) AS m FROM scores WHERE is_eval GROUP BY target, model, score")
piece("rcum", "SELECT *, sum(p) OVER d AS tp, sum(m) OVER d AS fp FROM rsteps WINDOW d AS (PARTITION BY target, model ORDER BY score DESC)")
piece("auc", "SELECT target, model, sum(p) AS pos, sum(m) AS neg, CASE WHEN sum(p) > 0 AND sum(m) > 0 THEN sum(m * (tp - p / 2e0)) / (sum(p) * sum(m)) END AS roc_auc, CASE WHEN sum(p) > 0 AND sum(m) > 0 THEN sum(p * (tp / (tp + fp)::DOUBLE)) / sum(p) END AS pr_auc FROM rcum GROUP BY target, model")
# the fold means of a small result table: five rules, three vehicles, two protocols
piece("infold", "SELECT f.fold, l.*, CASE WHEN f.fold = 0 THEN l.y = 0 AND l.q = 2 ELSE l.y = 0 AND l.q = 1 END AS f_calib, CASE WHEN f.fold = 0 THEN l.q = 3 OR (l.y = 1 AND l.q = 2) ELSE l.q = 0 OR (l.y = 1 AND l.q = 1) END AS f_eval, CASE WHEN f.fold = 0 THEN l.q <= 1 ELSE l.q >= 2 END AS f_train FROM lq l, (VALUES (0), (1)) f(fold)")
