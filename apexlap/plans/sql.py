"""The registered queries as SQL, written apart from the DataFrame code."""

from .fixtures import PATH, SESSIONS

PX = "[" + ",".join(str(p[0]) for p in PATH) + "]"
PY = "[" + ",".join(str(p[1]) for p in PATH) + "]"

BASE = f"""
ev as (select *, user_id % {SESSIONS} as sid, row_number() over (partition by user_id % {SESSIONS} order by ts, event_id) - 1 as rn from events),
st as (select *, rn - case when rn % 50 = 49 then 1 else 0 end as st from ev),
trk as (select cast(sid as varchar) as session_id, rn as sample_idx, cast(1700000000000 + st * 1000 + 13 * (st % 7) as double) as timestamp_ms,
  case when rn % 37 <> 36 then 40.0::double + {PY}[(rn % 44 + 1)::int] * 5e-5::double + ((cast(round(value * 100) as bigint) % 7 + 7) % 7 - 3) * 1e-7::double end as lat,
  case when rn % 37 <> 36 then -80.0::double + {PX}[(rn % 44 + 1)::int] * 5e-5::double end as lon, value / 7.0::double as speed_mps from st)"""

METRICS = """,
m0 as (select session_id, sample_idx, timestamp_ms, speed_mps, (timestamp_ms - first_value(timestamp_ms) over w) / 1000.0::double as elapsed_s,
  avg(lat) over (partition by session_id order by sample_idx rows between 2 preceding and 2 following) as lat,
  avg(lon) over (partition by session_id order by sample_idx rows between 2 preceding and 2 following) as lon
  from trk window w as (partition by session_id order by sample_idx)),
m1 as (select *, nullif(elapsed_s - lag(elapsed_s) over w, 0) as dt_s, first_value(lat) over w as lat0, first_value(lon) over w as lon0,
  speed_mps * 2.23694::double as speed_mph from m0 window w as (partition by session_id order by sample_idx)),
m2 as (select *, radians(lon - lon0) * cos(radians(lat0)) * 6378137.0::double as x_m, radians(lat - lat0) * 6378137.0::double as y_m, speed_mps * coalesce(dt_s, 0) as segment_distance_m from m1),
m3 as (select *, x_m - lag(x_m) over w as dx, y_m - lag(y_m) over w as dy,
  sum(segment_distance_m) over (partition by session_id order by sample_idx rows unbounded preceding) as distance_along_m from m2 window w as (partition by session_id order by sample_idx)),
m4 as (select *, atan2(coalesce(dx, 0), coalesce(dy, 0)) as course from m3),
m5 as (select *, course - lag(course) over (partition by session_id order by sample_idx) as turn from m4),
m6 as (select *, turn + pi() - floor((turn + pi()) / (2 * pi())) * 2 * pi() - pi() as w0 from m5),
m7 as (select *, case when abs(turn) < pi() then 0 else coalesce((case when w0 = -pi() and turn > 0 then pi() else w0 end) - turn, 0) end as jump from m6),
m8 as (select *, course + sum(jump) over (partition by session_id order by sample_idx rows unbounded preceding) as h from m7),
m9 as (select *, elapsed_s - lag(elapsed_s) over w as h1, lead(elapsed_s) over w - elapsed_s as h2, lag(h) over w as f0, lead(h) over w as f2, lag(speed_mps) over w as v0 from m8 window w as (partition by session_id order by sample_idx)),
metrics as (select *, degrees(h) as heading_deg, coalesce((speed_mps - v0) / dt_s, 0) as long_accel_mps2,
  coalesce(speed_mps * case when f0 is null then (f2 - h) / nullif(h2, 0) when f2 is null then (h - f0) / nullif(h1, 0)
    else -h2 / nullif(h1 * (h1 + h2), 0) * f0 + (h2 - h1) / nullif(h1 * h2, 0) * h + h1 / nullif(h2 * (h1 + h2), 0) * f2 end, 0) as lat_accel_mps2 from m9),
tel as (select session_id, sample_idx, cast(timestamp_ms as bigint) as ms, lat, lon, distance_along_m as distance_m, round(elapsed_s, 3) as elapsed_s, round(speed_mps, 3) as speed_mps,
  round(speed_mph, 3) as speed_mph, round(long_accel_mps2, 3) as long_accel_mps2, round(lat_accel_mps2, 3) as lat_accel_mps2, round(heading_deg, 2) as heading_deg from metrics)"""

LAPS = """,
hav as (select session_id, sample_idx, lat, lon, pow(sin(radians(40.0::double - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.0::double)) * pow(sin(radians(-80.0::double - lon) / 2), 2) as a from tel),
cand as (select session_id, sample_idx from hav where 2 * 6371000.0::double * atan2(sqrt(a), sqrt(1 - a)) < 5),
bnd(session_id, b) as (
  select session_id, min(sample_idx) from cand where sample_idx > 4 group by 1
  union all
  select * from (select q.session_id, (select min(c.sample_idx) from cand c where c.session_id = q.session_id and c.sample_idx > q.b + 4) as b from bnd q) where b is not null),
size_ as (select session_id, max(sample_idx) as n from tel group by 1),
open_ as (select session_id, cast(0 as bigint) as s from size_ union all select session_id, b from bnd),
rng as (select o.session_id, o.s, coalesce(lead(o.s) over (partition by o.session_id order by o.s), z.n) as e from open_ o join size_ z on z.session_id = o.session_id),
rng2 as (select * from rng where e > s),
rec as (select r.session_id, r.s, r.e, round((y.ms - x.ms) / 1000.0::double, 5) as lap_time_s, round(y.distance_m - x.distance_m, 3) as distance_m,
  row_number() over (partition by r.session_id order by r.s) as k, count(*) over (partition by r.session_id) as c
  from rng2 r join tel x on x.session_id = r.session_id and x.sample_idx = r.s join tel y on y.session_id = r.session_id and y.sample_idx = r.e),
laps as (select session_id, case when c = 1 or k = 1 or k = c then k else k - 1 end as lap_number, c > 1 and (k = 1 or k = c) as is_partial, lap_time_s, distance_m, s as start_sample_idx, e as end_sample_idx from rec),
lsam as (select l.session_id, l.lap_number, l.is_partial, l.start_sample_idx, l.end_sample_idx, t.* exclude (session_id), t.sample_idx - l.start_sample_idx as pos from laps l join tel t on t.session_id = l.session_id and t.sample_idx between l.start_sample_idx and l.end_sample_idx),
ann as (select t.*, z.lap_number as lap_index, case when z.lap_number is not null then round(t.elapsed_s - z.e0, 3) end as lap_elapsed_s, case when z.lap_number is not null then t.distance_m - z.d0 end as lap_distance_m
  from tel t left join (
    select l.session_id, l.lap_number, l.start_sample_idx as s, l.end_sample_idx as e, x.elapsed_s as e0, x.distance_m as d0,
      lead(l.start_sample_idx) over (partition by l.session_id order by l.start_sample_idx) as nxt
    from laps l join tel x on x.session_id = l.session_id and x.sample_idx = l.start_sample_idx where not l.is_partial) z
  on z.session_id = t.session_id and t.sample_idx >= z.s and t.sample_idx <= z.e and (z.nxt is null or t.sample_idx < z.nxt))"""

CURVE = """,
k0 as (select *, lon - lag(lon, 2) over w as ux, lat - lag(lat, 2) over w as uy, lead(lon, 2) over w - lon as vx, lead(lat, 2) over w - lat as vy from lsam where not is_partial
  window w as (partition by session_id, start_sample_idx order by sample_idx)),
curve as (select *, case when pos >= 2 and sample_idx < end_sample_idx - 2 then coalesce(2 * (ux * vy - uy * vx) / nullif(sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy) * sqrt((ux + vx) * (ux + vx) + (uy + vy) * (uy + vy)), 0), 0) else 0 end as k from k0),
crn(session_id, lap_number, start_sample_idx, corner_id, t, a, b) as (
  select session_id, lap_number, start_sample_idx, 0, cast(-1 as bigint), cast(-1 as bigint), cast(-1 as bigint) from laps where not is_partial
  union all
  select session_id, lap_number, start_sample_idx, corner_id + 1, t2,
    coalesce((select max(c.pos) from curve c where c.session_id = q.session_id and c.start_sample_idx = q.start_sample_idx and c.pos >= 2 and c.pos < q.t2 and (abs(c.k) <= 3e3 or sign(c.k) <> sign(q.kt))), 2),
    (select min(c.pos) from curve c where c.session_id = q.session_id and c.start_sample_idx = q.start_sample_idx and c.pos > q.t2 and (abs(c.k) <= 3e3 or sign(c.k) <> sign(q.kt)))
  from (select p.*, h.pos as t2, h.k as kt from crn p join lateral (
    select c.pos, c.k from curve c where c.session_id = p.session_id and c.start_sample_idx = p.start_sample_idx and c.pos > p.b and abs(c.k) >= 6e3 order by c.pos limit 1) h on true) q),
corner as (select session_id, lap_number, start_sample_idx, corner_id, start_sample_idx + a as a, start_sample_idx + b as b from crn where corner_id > 0)"""


def exact(sql: str) -> str:
    """Every round(x, n) by decimals of nine digits, so that noise in the last bits can't turn a tie."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, comma, j = 0, -1, i + 5
        while True:
            c = sql[j]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = j
            if not depth:
                break
            j += 1
        if comma < 0:
            out, at = out + sql[at : i + 6], i + 6
            continue
        out += sql[at:i] + f"cast(round(cast({exact(sql[i + 6 : comma])} as decimal(38, 9)), {sql[comma + 1 : j].strip()}) as double)"
        at = j + 1
    return out + sql[at:]


def with_(*parts: str, recursive: bool = True) -> str:
    return f"with {'recursive ' if recursive else ''}" + "".join(parts).lstrip()


SMOOTH = """, sm as (select session_id, sample_idx, lat, count(*) over (partition by session_id) as n, row_number() over w as nth,
  first_value(lat) over w as fst, last_value(lat) over (partition by session_id order by sample_idx rows between unbounded preceding and unbounded following) as lst,
  {lags} from trk window w as (partition by session_id order by sample_idx))"""
LAGS = ", ".join(f"lag(lat, {-j}) over w as l{j + 3}" if j < 0 else f"lead(lat, {j}) over w as l{j + 3}" for j in range(-3, 4))
GAUSS = [f"exp(-0.5 * pow({j - 3} / (7.0::double / 3), 2))" for j in range(7)]
SAVGOL = [3 * (3 * 9 + 9 - 1 - 5 * j * j) / (5 * 7 * 9) for j in range(-3, 4)]

SQL: dict[str, str] = {
    "metrics": with_(BASE, METRICS, recursive=False) + " select session_id, sample_idx, round(elapsed_s, 6) as elapsed_s, round(dt_s, 6) as dt_s, round(x_m, 4) as x_m, round(y_m, 4) as y_m, round(speed_mph, 6) as speed_mph, round(distance_along_m, 4) as distance_along_m, round(distance_along_m * 0.000621371::double, 6) as distance_along_mi, round(sqrt(dx * dx + dy * dy) / dt_s, 4) as speed_course_mps, round(heading_deg, 4) as heading_deg, round(long_accel_mps2, 4) as long_accel_mps2, round(lat_accel_mps2, 4) as lat_accel_mps2 from metrics",
    "smoothing": with_(BASE, SMOOTH.format(lags=LAGS), recursive=False)
    + " select session_id, sample_idx, round(avg(lat) over (partition by session_id order by sample_idx rows between 3 preceding and 3 following), 8) as ma, round((" + " + ".join(f"coalesce({g} * l{j}, 0)" for j, g in enumerate(GAUSS)) + ") / nullif(" + " + ".join(f"case when l{j} is not null then {g} else 0 end" for j, g in enumerate(GAUSS)) + ", 0), 8) as gaussian, round(" + " + ".join(f"{c!r}::double * case when nth + ({j}) < 1 then fst when nth + ({j}) > n then lst else l{j + 3} end" for j, c in zip(range(-3, 4), SAVGOL, strict=True)) + ", 8) as savgol from sm",
    "telemetry": with_(BASE, METRICS, recursive=False) + " select session_id, sample_idx, elapsed_s, speed_mps, speed_mph, long_accel_mps2, lat_accel_mps2, heading_deg, cast(null as double) as alt, cast(null as double) as imu_accel_x, cast(null as double) as imu_accel_y, cast(null as double) as imu_accel_z, cast(null as double) as imu_gyro_z, cast(null as double) as pos_accuracy_m, round(distance_m, 4) as distance_m, round(lat, 8) as lat, round(lon, 8) as lon from tel",
    "laps": with_(BASE, METRICS, LAPS) + " select session_id, lap_number, is_partial, lap_time_s, distance_m, start_sample_idx, end_sample_idx from laps",
    "plausible_laps": with_(BASE, METRICS, LAPS) + " select session_id, row_number() over (partition by session_id order by start_sample_idx) as lap_number, lap_time_s, distance_m, start_sample_idx, end_sample_idx from (select session_id, lap_time_s, distance_m, start_sample_idx, end_sample_idx from laps where lap_time_s >= 20 and distance_m >= 150 union all select z.session_id, round((y.ms - x.ms) / 1000.0::double, 5), round(y.distance_m - x.distance_m, 3), cast(0 as bigint), z.n from size_ z join tel x on x.session_id = z.session_id and x.sample_idx = 0 join tel y on y.session_id = z.session_id and y.sample_idx = z.n where z.session_id not in (select session_id from laps where lap_time_s >= 20 and distance_m >= 150))",
    "raw_lap_ids": with_(BASE, METRICS, LAPS) + " select t.session_id, t.sample_idx, count(b.b) as lap from tel t left join bnd b on b.session_id = t.session_id and b.b < t.sample_idx group by 1, 2",
    "lap_annotation": with_(BASE, METRICS, LAPS) + " select session_id, sample_idx, lap_index, lap_elapsed_s, round(lap_distance_m, 3) as lap_distance_m from ann",
    "sectors": with_(BASE, METRICS, LAPS)
    + """, pr as (select *, lag(distance_m) over w as d1, lag(ms) over w as ms1, first_value(distance_m) over w as d0, first_value(ms) over w as ms0, last_value(distance_m) over (partition by session_id, start_sample_idx order by sample_idx rows between unbounded preceding and unbounded following) as dn from lsam window w as (partition by session_id, start_sample_idx order by sample_idx)),
kb as (select *, unnest([1, 2, 3]) as k from pr where dn > d0), kc as (select *, case when k = 3 then dn else d0 + (dn - d0) * k / 3 end as bd from kb),
sc(session_id, start_sample_idx, k, pos) as (
  select distinct session_id, start_sample_idx, 0, cast(0 as bigint) from kc
  union all
  select q.session_id, q.start_sample_idx, q.k + 1, (select min(c.pos) from kc c where c.session_id = q.session_id and c.start_sample_idx = q.start_sample_idx and c.k = q.k + 1 and c.d1 <= c.bd and c.bd <= c.distance_m and c.pos > q.pos) from sc q where q.k < 3 and q.pos is not null),
tt as (select c.session_id, c.start_sample_idx, c.k, c.ms0, (c.ms1 - c.ms0) + (c.ms - c.ms1) * coalesce((c.bd - c.d1) / nullif(c.distance_m - c.d1, 0), 0) as ta, c.bd - c.d0 as split from sc join kc c on c.session_id = sc.session_id and c.start_sample_idx = sc.start_sample_idx and c.k = sc.k and c.pos = sc.pos)
select session_id, start_sample_idx, k as sector, round((ta - coalesce(lag(ta) over (partition by session_id, start_sample_idx order by k), 0)) / 1000.0::double, 5) as sector_time_s, round(split, 3) as split_m from tt""",
    "lap_deltas": with_(BASE, METRICS, LAPS)
    + """, fl as (select session_id, lap_number, lap_time_s from laps where not is_partial and lap_time_s > 0),
rf as (select session_id, lap_number as ref from (select *, row_number() over (partition by session_id order by lap_time_s, lap_number) as r, count(*) over (partition by session_id) as n from fl) where r = 1 and n > 1),
sm as (select l.session_id, l.lap_number, l.sample_idx, a.lap_distance_m as d, a.lap_elapsed_s as t from lsam l join ann a on a.session_id = l.session_id and a.sample_idx = l.sample_idx where not l.is_partial and a.lap_distance_m is not null),
cv as (select session_id, d, t, sample_idx from (select sm.*, lag(d) over (partition by sm.session_id order by d, sample_idx) as db from sm join rf on rf.session_id = sm.session_id and rf.ref = sm.lap_number) where db is null or d - db > 1e-6),
c2 as (select *, lead(d) over w as d2, lead(t) over w as t2, row_number() over w as i, count(*) over (partition by session_id) as n from cv window w as (partition by session_id order by d)),
ot as (select sm.*, rf.ref, (select max(c.i) from c2 c where c.session_id = sm.session_id and c.d <= sm.d) as i from sm join rf on rf.session_id = sm.session_id and rf.ref <> sm.lap_number join fl on fl.session_id = sm.session_id and fl.lap_number = sm.lap_number)
select o.session_id, o.lap_number, o.ref as reference_lap, o.sample_idx, round(o.d, 2) as distance_m, round(o.t - case when o.i is null or c.d2 is null then c.t else c.t + (c.t2 - c.t) * (o.d - c.d) / (c.d2 - c.d) end, 3) as time_delta_s
from ot o join c2 c on c.session_id = o.session_id and c.i = coalesce(o.i, 1) and c.n > 1""",
    "curvature": with_(BASE, METRICS, LAPS, CURVE) + " select session_id, lap_number, start_sample_idx, sample_idx, round(k, 2) as k from curve",
    "corners": with_(BASE, METRICS, LAPS, CURVE)
    + " select c.session_id, c.lap_number, c.corner_id, c.a, c.b, round(arg_min(t.speed_mph, t.sample_idx), 1) as entry_speed_mph, round(arg_max(t.speed_mph, t.sample_idx), 1) as exit_speed_mph, round(min(t.speed_mph), 1) as min_speed_mph, round(max(abs(t.lat_accel_mps2)) / 9.80665::double, 3) as max_lat_g, round(arg_min(t.lon, t.sample_idx), 8) as first_lon, round(arg_min(t.lat, t.sample_idx), 8) as first_lat, round(arg_max(t.lon, t.sample_idx), 8) as last_lon, round(arg_max(t.lat, t.sample_idx), 8) as last_lat, round(arg_min(t.lat, (t.speed_mph, t.sample_idx)), 8) as apex_lat, round(arg_min(t.lon, (t.speed_mph, t.sample_idx)), 8) as apex_lon, round(max(t.elapsed_s) - min(t.elapsed_s), 3) as duration_s, count(t.lat) as points from corner c join tel t on t.session_id = c.session_id and t.sample_idx between c.a and c.b group by 1, 2, 3, 4, 5",
    "heatmap": with_(BASE, METRICS, recursive=False)
    + ", u as (select session_id, sample_idx, lat, lon, 'brake' as layer, greatest(-long_accel_mps2, 0) as v from tel union all select session_id, sample_idx, lat, lon, 'throttle', greatest(long_accel_mps2, 0) from tel union all select session_id, sample_idx, lat, lon, 'lateral', lat_accel_mps2 from tel), x as (select *, max(abs(v)) over (partition by session_id, layer) as most from u) select session_id, layer, sample_idx, round(least(1, abs(v) / most), 3) as intensity, round(v, 3) as value, round(lat, 8) as lat, round(lon, 8) as lon from x where v <> 0 and most > 0 and lat is not null and lon is not null",
    "speed_legend": with_(BASE, METRICS, recursive=False)
    + ", s as (select session_id, greatest(10, ceil(max(speed_mph) / 10) * 10) as m from tel group by 1), b as (select *, unnest([0, 1, 2, 3, 4]) as band from s) select session_id, band, ['#0088ff', '#00ff00', '#ffff00', '#ff8800', '#ff0000'][band + 1] as color, m * band / 5 as low_mph, m * (band + 1) / 5 as high_mph from b",
    "log_series": f"""with ev as (select *, user_id % {SESSIONS} as sid, row_number() over (partition by user_id % {SESSIONS} order by ts, event_id) - 1 as rn from events),
st as (select *, rn - case when rn % 50 = 49 then 1 else 0 end as st, cast(cast(round(value * 100) as bigint) as varchar) as v from ev),
z as (select sid, rn, event_type, event_id, v, 1700000000000 + st * 1000 + 13 * (st % 7) as ms, event_type = 'signup' as fix, coalesce(lag(event_type = 'signup') over (partition by sid order by rn), true) as pf from st),
q as (select *, sum(case when fix and not pf then 1 else 0 end) over (partition by sid order by rn) as step from z),
g as (select sid, step, avg(case when fix then cast('40.' || v as double) end) as lat, avg(case when fix then cast('-80.' || v as double) end) as lon, avg(case when fix then cast(v as double) end) as speed_mps, max(event_type = 'view') as gyro, arg_min(cast(v as double), rn) filter (event_type = 'view') as gx,
  coalesce(case when arg_min(event_id, rn) filter (fix) % 11 = 0 then null else arg_min(ms, rn) filter (fix) end, arg_min(ms, rn) filter (event_type not in ('signup', 'click', 'error', 'view'))) as ms,
  coalesce(arg_min(cast(v as double), rn) filter (event_type = 'click'), arg_min(cast(v as double), rn) filter (event_type = 'error')) as ax, max(event_type in ('click', 'error')) as acc from q group by 1, 2),
h as (select *, max(acc) over (partition by sid) as has_accel from g)
select cast(sid as varchar) as session_id, row_number() over (partition by sid order by ms, step) - 1 as sample_idx, step as timestep, cast(ms as bigint) as timestamp_ms, round(lat, 6) as lat, round(lon, 6) as lon, round(speed_mps, 6) as speed_mps, cast(null as double) as alt, cast(null as double) as pos_accuracy_m, ax as imu_accel_x, case when acc then 0.5::double end as imu_accel_y, case when acc then 1.0::double end as imu_accel_z, gx as imu_gyro_x, case when gyro then 1.0::double end as imu_gyro_z, has_accel from h where ms is not null""",
}

ROADS = f""",
edge as (select unnest(range(44)) as edge_id), seg as (select {PX}[(edge_id + 1)::int] as x1, {PY}[(edge_id + 1)::int] as y1, {PX}[((edge_id + 1) % 44 + 1)::int] as x2, {PY}[((edge_id + 1) % 44 + 1)::int] as y2 from edge),
sp as (select session_id, sample_idx, lat as lat_raw, lon as lon_raw, avg(lat) over w as lat_smooth, avg(lon) over w as lon_smooth from trk window w as (partition by session_id order by sample_idx rows between 3 preceding and 3 following)),
cen as (select session_id, avg(lat_smooth) as lat0, avg(lon_smooth) as lon0 from sp group by 1),
cn as (select *, 6378137.0::double / sqrt(1 - 6.69437999014e-3::double * pow(sin(radians(lat0)), 2)) as nn, cos(radians(lat0)) as cc from cen),
pt as (select session_id, sample_idx, 'raw' as series, lat_raw as lat, lon_raw as lon from sp union all select session_id, sample_idx, 'smooth', lat_smooth, lon_smooth from sp),
px as (select p.session_id, p.sample_idx, p.series, radians(lon - lon0) * cc * nn as x, radians(lat - lat0) * nn as y from pt p join cn using (session_id) where lat is not null),
sx as (select session_id, radians(-80 + x1 * 5e-5::double - lon0) * cc * nn as ax, radians(40 + y1 * 5e-5::double - lat0) * nn as ay, radians(-80 + x2 * 5e-5::double - lon0) * cc * nn as bx, radians(40 + y2 * 5e-5::double - lat0) * nn as by_ from seg, cn),
tx as (select p.*, ax, ay, bx, by_, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) as t from px p join sx s on s.session_id = p.session_id),
er as (select session_id, series, sample_idx, min(sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by_ - ay)), 2))) as error_m from tx group by 1, 2, 3)"""

SQL["road_errors"] = with_(BASE, ROADS, recursive=False) + " select session_id, series, sample_idx, round(error_m, 4) as error_m from er"
SQL["accuracy"] = with_(BASE, ROADS, recursive=False) + " select session_id, series, count(*) as n_points, round(avg(error_m), 4) as mean_m, round(sqrt(avg(error_m * error_m)), 4) as rms_m, round(stddev_samp(error_m), 4) as std_m, round(quantile_cont(error_m, 0.5), 4) as median_m, round(quantile_cont(error_m, 0.5), 4) as p50_m, round(quantile_cont(error_m, 0.75), 4) as p75_m, round(quantile_cont(error_m, 0.9), 4) as p90_m, round(quantile_cont(error_m, 0.95), 4) as p95_m, round(quantile_cont(error_m, 0.99), 4) as p99_m, round(max(error_m), 4) as max_m, round(min(error_m), 4) as min_m from er group by 1, 2"
SQL["nearest_samples"] = f"""with {BASE.lstrip()},
pq as (select cast(p_partkey % {SESSIONS} as varchar) as session_id, p_partkey as point_id, 40 + (p_partkey % 9) * 5e-5::double + 1e-5::double as lat, -80 + (p_partkey % 7) * 5e-5::double + 1.3e-5::double as lon from part),
hh as (select q.session_id, q.point_id, t.sample_idx, pow(sin(radians(t.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - q.lon) / 2), 2) as a from pq q join trk t on t.session_id = q.session_id where t.lat is not null),
dd as (select *, round(2 * 6371000.0::double * atan2(sqrt(a), sqrt(1 - a)), 6) as d from hh)
select session_id, point_id, arg_min(sample_idx, (d, sample_idx)) as sample_idx, round(min(d), 4) as distance_m from dd group by 1, 2"""

POINTS = f"""pq as (select cast(p_partkey % {SESSIONS} as varchar) as session_id, p_partkey as point_id, 40 + (p_partkey % 9) * 5e-5::double + 1e-5::double as plat, -80 + (p_partkey % 7) * 5e-5::double + 1.3e-5::double as plon from part)"""
SQL["nearest_in_lap"] = with_(BASE, METRICS, LAPS) + f""", {POINTS},
one as (select session_id, min(lap_number) as lap_number from laps where not is_partial group by 1),
hh as (select q.session_id, q.point_id, t.sample_idx, pow(sin(radians(t.lat - q.plat) / 2), 2) + cos(radians(q.plat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - q.plon) / 2), 2) as a
  from pq q join one on one.session_id = q.session_id join lsam t on t.session_id = q.session_id and t.lap_number = one.lap_number and not t.is_partial where t.lat is not null),
dd as (select *, round(2 * 6371000.0::double * atan2(sqrt(a), sqrt(1 - a)), 6) as d from hh)
select session_id, point_id, arg_min(sample_idx, (d, sample_idx)) as sample_idx, round(min(d), 4) as distance_m from dd group by 1, 2"""

SQL["imu_metrics"] = with_(BASE, METRICS, recursive=False) + " select session_id, sample_idx, round(case when cast(session_id as int) % 2 = 0 then speed_mps * 0.3::double else long_accel_mps2 end, 4) as long_accel_mps2, round(case when cast(session_id as int) % 2 = 0 then speed_mps * -0.2::double else lat_accel_mps2 end, 4) as lat_accel_mps2 from metrics"

WIDE = """,
fst as (select session_id, arg_min(lat, sample_idx) as la, arg_min(lon, sample_idx) as lo from tel where lat is not null and lon is not null group by 1),
hav as (select t.session_id, t.sample_idx, pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2) as a from tel t join fst using (session_id)),
cand as (select session_id, sample_idx, case when cast(session_id as int) % 2 = 0 then 10 else 4 end as skip from hav where session_id <> '3' and 2 * 6371000.0::double * atan2(sqrt(a), sqrt(1 - a)) < case when cast(session_id as int) % 2 = 0 then 9 else 5 end),
bnd(session_id, b) as (
  select session_id, min(sample_idx) from cand where sample_idx > skip group by 1
  union all
  select * from (select q.session_id, (select min(c.sample_idx) from cand c where c.session_id = q.session_id and c.sample_idx > q.b + c.skip) as b from bnd q) where b is not null),
size_ as (select session_id, max(sample_idx) as n from tel group by 1),
open_ as (select session_id, cast(0 as bigint) as s from size_ union all select session_id, b from bnd),
rng as (select o.session_id, o.s, coalesce(lead(o.s) over (partition by o.session_id order by o.s), z.n) as e from open_ o join size_ z on z.session_id = o.session_id),
rng2 as (select * from rng where e > s),
rec as (select *, row_number() over (partition by session_id order by s) as k, count(*) over (partition by session_id) as c from rng2)"""
SQL["wide_laps"] = with_(BASE, METRICS, WIDE) + " select case when session_id = '3' then '3 Jackson' else session_id end as session_id, case when c = 1 or k = 1 or k = c then k else k - 1 end as lap_number, c > 1 and (k = 1 or k = c) as is_partial, s as start_sample_idx, e as end_sample_idx from rec"

SQL["delta_at_distance"] = with_(BASE, METRICS, LAPS) + """,
sm as (select l.session_id, l.lap_number, l.pos, a.lap_distance_m as d, a.lap_elapsed_s as t from lsam l join ann a on a.session_id = l.session_id and a.sample_idx = l.sample_idx where not l.is_partial and a.lap_distance_m is not null),
pr as (select *, row_number() over w - 1 as i, lag(d) over w as d0, lag(t) over w as t0, last_value(t) over (partition by session_id, lap_number order by d, pos rows between unbounded preceding and unbounded following) as tn
  from sm window w as (partition by session_id, lap_number order by d, pos)),
ask as (select session_id, lap_number as lap1, lap_number + 1 as lap2, unnest([-5.0::double, 0, 100, 250, 9999]) as x from laps where not is_partial),
side as (select distinct session_id, lap1 as lap, x from ask union select distinct session_id, lap2, x from ask),
hit as (select s.session_id, s.lap, s.x, min(p.i) filter (s.x <= p.d) as i, any_value(p.tn) as tn from side s join pr p on p.session_id = s.session_id and p.lap_number = s.lap and p.i >= 1 group by 1, 2, 3),
tm as (select h.session_id, h.lap, h.x, case when h.i is null then h.tn else p.t0 + (p.t - p.t0) * (h.x - p.d0) / greatest(p.d - p.d0, 1e-6::double) end as t from hit h left join pr p on p.session_id = h.session_id and p.lap_number = h.lap and p.i = h.i)
select a.session_id, a.lap1, a.lap2, a.x as distance_m, round(round(t1.t - t2.t, 6), 4) as delta_s from ask a
  left join tm t1 on t1.session_id = a.session_id and t1.lap = a.lap1 and t1.x = a.x left join tm t2 on t2.session_id = a.session_id and t2.lap = a.lap2 and t2.x = a.x"""

SQL["comparable_laps"] = with_(BASE, METRICS, LAPS) + " select session_id, lap_number, lap_time_s from (select *, min(lap_number) over (partition by session_id) as one from laps where not is_partial) where lap_number <> one"


def _channel(values: list[int]) -> str:
    bands = " ".join(f"when ratio < {hi}::double then cast(floor({a}.0::double + ({b - a}) * (ratio - {lo}::double) / ({hi}::double - {lo}::double)) as int)" for a, b, lo, hi in zip(values, values[1:], ("0.0", "0.2", "0.4", "0.6"), ("0.2", "0.4", "0.6", "0.8"), strict=False))
    return f"case {bands} else {values[-1]} end"


SEGMENTS = f""",
sc as (select session_id, greatest(10, ceil(max(speed_mph) / 10) * 10) as scale from tel group by 1),
od as (select *, row_number() over (partition by session_id, is_partial order by start_sample_idx) - 1 as place from laps),
sg as (select l.session_id, l.lap_number, l.is_partial, l.start_sample_idx, l.sample_idx, lag(l.lat) over w as from_lat, lag(l.lon) over w as from_lon, l.lat, l.lon, greatest(0.0::double, least(1.0::double, l.speed_mph / sc.scale)) as ratio
  from lsam l join sc on sc.session_id = l.session_id where l.lat is not null and l.lon is not null window w as (partition by l.session_id, l.start_sample_idx order by l.sample_idx)),
sh as (select sg.*, ['#ff2d55', '#00ffa3', '#ffd60a', '#28a2ff', '#b28dff', '#ff8a5b'][(od.place % 6 + 1)::int] as lap_color, od.lap_time_s,
  case when not sg.is_partial then '#' || printf('%02x', {_channel([0, 0, 255, 255, 255])}) || printf('%02x', {_channel([136, 255, 255, 136, 0])}) || printf('%02x', {_channel([255, 0, 0, 0, 0])}) end as color
  from sg join od on od.session_id = sg.session_id and od.start_sample_idx = sg.start_sample_idx where from_lat is not null)"""
SQL["lap_segments"] = with_(BASE, METRICS, LAPS, SEGMENTS) + " select session_id, lap_number, is_partial, start_sample_idx, sample_idx, round(from_lat, 8) as from_lat, round(from_lon, 8) as from_lon, round(lat, 8) as lat, round(lon, 8) as lon, color, lap_color from sh"
SQL["lap_features"] = with_(BASE, METRICS, LAPS, SEGMENTS) + " select session_id, start_sample_idx, is_partial, any_value(lap_time_s) as lap_time_s, 'LineString' as kind, cast(any_value(lap_number) as int) as lap_number, case when not is_partial then any_value(lap_color) end as stroke, case when not is_partial then 5 end as stroke_width, arg_min(color, sample_idx) as first_color, count(*) + 1 as points, round(arg_min(from_lon, sample_idx), 8) as first_lon from sh group by 1, 2, 3"
SQL["track_geojson"] = with_(BASE, METRICS, recursive=False) + " select session_id, 'LineString' as line, count(*) as samples, round(arg_min(lat, sample_idx), 8) as first_lat, 'start_finish' as marker, -80.0::double as start_lon, 40.0::double as start_lat, cast(null as varchar) as error from tel where lat is not null and lon is not null group by 1"

LOGS = SQL["log_series"][: SQL["log_series"].index("g as (select sid, step,")].rstrip().rstrip(",")
SQL["log_records"] = LOGS + ", k as (select *, case event_type when 'signup' then 'Fix' when 'click' then 'Accel' when 'error' then 'UncalAccel' when 'view' then 'Gyro' else 'Raw' end as record_type from q) select cast(sid as varchar) as session_id, step as timestep, record_type, row_number() over (partition by sid, step, record_type order by rn) - 1 as entry_no, rn as line_no from k"
SQL["log_files"] = f"select session_id, sample_idx, timestep, timestamp_ms, lat, speed_mps, 40.0::double as start_lat, -80.0::double as start_lon from ({SQL['log_series']})"
SQL["exported_laps"] = with_(BASE, METRICS, LAPS) + " select cast(l.session_id as int) as session_id, cast(l.lap_number as int) as lap, count(*) as samples, round(sum(l.speed_mph), 3) as speed_sum, round(max(a.lap_elapsed_s), 3) as longest_s from lsam l join ann a on a.session_id = l.session_id and a.sample_idx = l.sample_idx where not l.is_partial group by 1, 2"
SQL["session_documents"] = with_(BASE, METRICS, LAPS, CURVE) + """,
hv as (select session_id, max(greatest(-long_accel_mps2, 0)) as b, max(greatest(long_accel_mps2, 0)) as t, max(abs(lat_accel_mps2)) as l from tel group by 1),
ht as (select t.session_id, sum(case when long_accel_mps2 < 0 and b > 0 then 1 else 0 end + case when long_accel_mps2 > 0 and hv.t > 0 then 1 else 0 end + case when lat_accel_mps2 <> 0 and l > 0 then 1 else 0 end) as heat from tel t join hv using (session_id) where lat is not null and lon is not null group by 1),
lp as (select session_id, count(*) filter (not is_partial) as n, min(start_sample_idx) filter (not is_partial) as s from laps group by 1),
cr as (select session_id, count(*) as n from corner group by 1)
select z.session_id, cast(z.n + 1 as int) as samples, cast(lp.n as int) as laps, cast(coalesce(cr.n, 0) as int) as corners, cast(ht.heat as int) as heat, cast(lp.n as int) as features, 11::bigint as twelfth, lp.s as first_start
from size_ z left join lp using (session_id) left join cr using (session_id) left join ht using (session_id)"""

SQL["validation_rows"] = with_(BASE, ROADS, recursive=False) + " select p.session_id, p.sample_idx, round(lat_raw, 8) as lat_raw, round(lon_raw, 8) as lon_raw, round(lat_smooth, 8) as lat_smooth, round(lon_smooth, 8) as lon_smooth, round(a.error_m, 4) as dist_error_raw_m, round(b.error_m, 4) as dist_error_smooth_m from sp p left join er a on a.session_id = p.session_id and a.sample_idx = p.sample_idx and a.series = 'raw' left join er b on b.session_id = p.session_id and b.sample_idx = p.sample_idx and b.series = 'smooth'"
SQL["accuracy_summary"] = with_(BASE, ROADS, recursive=False) + """,
ms as (select session_id, count(*)::double as n_points, avg(error_m) as mean_m, sqrt(avg(error_m * error_m)) as rms_m, stddev_samp(error_m) as std_m, quantile_cont(error_m, 0.5) as median_m, quantile_cont(error_m, 0.75) as p75_m, quantile_cont(error_m, 0.9) as p90_m, quantile_cont(error_m, 0.95) as p95_m, quantile_cont(error_m, 0.99) as p99_m, max(error_m) as max_m, min(error_m) as min_m from er where series = 'smooth' group by 1)
select session_id, metric, round(value, 4) as value from (unpivot ms on n_points, mean_m, rms_m, std_m, median_m, p75_m, p90_m, p95_m, p99_m, max_m, min_m into name metric value value)"""
SQL["box_plot"] = with_(BASE, ROADS, recursive=False) + """,
qu as (select session_id, series, quantile_cont(error_m, 0.25) as q1, quantile_cont(error_m, 0.5) as median, quantile_cont(error_m, 0.75) as q3 from er group by 1, 2)
select q.session_id, q.series, round(any_value(q1), 4) as q1, round(any_value(median), 4) as median, round(any_value(q3), 4) as q3,
  round(min(error_m) filter (error_m >= q1 - 1.5 * (q3 - q1)), 4) as whisker_low, round(max(error_m) filter (error_m <= q3 + 1.5 * (q3 - q1)), 4) as whisker_high
from qu q join er e on e.session_id = q.session_id and e.series = q.series group by 1, 2"""
SQL["track_distance"] = with_(BASE, recursive=False) + """,
sp as (select session_id, sample_idx, avg(lat) over w as la, avg(lon) over w as lo from trk window w as (partition by session_id order by sample_idx rows between 2 preceding and 2 following)),
cn as (select session_id, avg(la) as lat0, avg(lo) as lon0 from sp group by 1),
xy as (select p.session_id, sample_idx, radians(lo - lon0) * cos(radians(lat0)) * 6378137.0::double / sqrt(1 - 6.69437999014e-3::double * pow(sin(radians(lat0)), 2)) as x, radians(la - lat0) * 6378137.0::double / sqrt(1 - 6.69437999014e-3::double * pow(sin(radians(lat0)), 2)) as y from sp p join cn using (session_id)),
st2 as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) as step from xy window w as (partition by session_id order by sample_idx))
select session_id, sample_idx, round(x, 4) as x, round(y, 4) as y, round(sum(step) over (partition by session_id order by sample_idx rows unbounded preceding), 4) as track_m from st2"""
SQL["error_histogram"] = with_(BASE, ROADS, recursive=False) + """,
tp as (select session_id, least(max(error_m) filter (series = 'raw'), max(error_m) filter (series = 'smooth'), 20) as top from er group by 1),
bn as (select e.session_id, e.series, least(cast(floor(error_m * 39 / top) as int), 38) as bin, top from er e join tp using (session_id) where error_m between 0 and top),
ct as (select session_id, series, bin, count(*) as n, any_value(top) as top from bn group by 1, 2, 3)
select session_id, series, bin, n, round(n / (sum(n) over (partition by session_id, series) * top / 39), 6) as density from ct"""


def _smooth(c: str) -> str:
    lags = [f"lag({c}, {-j}) over w" if j < 0 else f"lead({c}, {j}) over w" if j else c for j in range(-3, 4)]
    gauss = "(" + " + ".join(f"coalesce({g} * {x}, 0)" for g, x in zip(GAUSS, lags, strict=True)) + ") / nullif(" + " + ".join(f"case when {x} is not null then {g} else 0 end" for g, x in zip(GAUSS, lags, strict=True)) + ", 0)"
    ends = f"first_value({c}) over w", f"last_value({c}) over (partition by session_id order by sample_idx rows between unbounded preceding and unbounded following)"
    savgol = " + ".join(f"{k!r}::double * case when nth + ({j}) < 1 then {ends[0]} when nth + ({j}) > n then {ends[1]} else {x} end" for j, k, x in zip(range(-3, 4), SAVGOL, lags, strict=True))
    return f"{gauss} as {c}_gaussian, {savgol} as {c}_savgol, avg({c}) over (partition by session_id order by sample_idx rows between 3 preceding and 3 following) as {c}_ma"


THREE = f""",
tn as (select *, count(*) over (partition by session_id) as n, row_number() over (partition by session_id order by sample_idx) as nth from trk),
s3 as (select session_id, sample_idx, {_smooth("lat")}, {_smooth("lon")} from tn window w as (partition by session_id order by sample_idx)),
sm3 as (select session_id, sample_idx, 'gaussian' as method, lat_gaussian as lat, lon_gaussian as lon from s3 union all select session_id, sample_idx, 'savgol', lat_savgol, lon_savgol from s3 union all select session_id, sample_idx, 'ma', lat_ma, lon_ma from s3),
cn as (select *, 6378137.0::double / sqrt(1 - 6.69437999014e-3::double * pow(sin(radians(lat0)), 2)) as nn, cos(radians(lat0)) as cc from (select session_id, avg(lat) as lat0, avg(lon) as lon0 from sm3 group by 1)),
px as (select p.session_id, p.sample_idx, p.method, radians(lon - lon0) * cc * nn as x, radians(lat - lat0) * nn as y from sm3 p join cn using (session_id) where lat is not null and lon is not null),
edge as (select unnest(range(44)) as edge_id), seg as (select {PX}[(edge_id + 1)::int] as x1, {PY}[(edge_id + 1)::int] as y1, {PX}[((edge_id + 1) % 44 + 1)::int] as x2, {PY}[((edge_id + 1) % 44 + 1)::int] as y2 from edge),
sx as (select session_id, radians(-80 + x1 * 5e-5::double - lon0) * cc * nn as ax, radians(40 + y1 * 5e-5::double - lat0) * nn as ay, radians(-80 + x2 * 5e-5::double - lon0) * cc * nn as bx, radians(40 + y2 * 5e-5::double - lat0) * nn as by_ from seg, cn),
tx as (select p.*, ax, ay, bx, by_, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) as t from px p join sx s on s.session_id = p.session_id),
er as (select session_id, method, sample_idx, min(sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by_ - ay)), 2))) as error_m from tx group by 1, 2, 3),
ms as (select session_id, method, count(*) as n_points, avg(error_m) as mean_m, sqrt(avg(error_m * error_m)) as rms_m, stddev_samp(error_m) as std_m, quantile_cont(error_m, 0.5) as median_m, quantile_cont(error_m, 0.9) as p90_m, quantile_cont(error_m, 0.95) as p95_m, max(error_m) as max_m from er group by 1, 2)"""
SQL["method_comparison"] = with_(BASE, THREE, recursive=False) + " select session_id, metric, arg_min(method, (value, case method when 'gaussian' then 1 when 'savgol' then 2 else 3 end)) as method, round(min(value), 4) as value from (unpivot (select session_id, method, mean_m, rms_m, std_m, median_m, p90_m, p95_m, max_m from ms) on mean_m, rms_m, std_m, median_m, p90_m, p95_m, max_m into name metric value value) group by 1, 2"
SQL["comparison_table"] = with_(BASE, THREE, recursive=False) + """ select session_id, method as "Method", n_points, round(mean_m, 4) as mean_m, round(rms_m, 4) as rms_m, round(p95_m, 4) as p95_m from ms"""

XY = """,
sp as (select session_id, sample_idx, avg(lat) over w as la, avg(lon) over w as lo from trk window w as (partition by session_id order by sample_idx rows between 2 preceding and 2 following)),
cn as (select session_id, avg(la) as lat0, avg(lo) as lon0 from sp group by 1),
xy as (select p.session_id, sample_idx, radians(lo - lon0) * cos(radians(lat0)) * 6378137.0::double / sqrt(1 - 6.69437999014e-3::double * pow(sin(radians(lat0)), 2)) as x,
  radians(la - lat0) * 6378137.0::double / sqrt(1 - 6.69437999014e-3::double * pow(sin(radians(lat0)), 2)) as y from sp p join cn using (session_id))"""
SQL["lap_markers"] = with_(BASE, METRICS, LAPS, XY) + """,
en as (select session_id, lap_number, 'start' as marker, start_sample_idx as sample_idx from laps where not is_partial union all select session_id, lap_number, 'end', end_sample_idx from laps where not is_partial)
select e.session_id, e.lap_number, e.marker, e.sample_idx, round(x, 4) as x, round(y, 4) as y from en e join xy on xy.session_id = e.session_id and xy.sample_idx = e.sample_idx where x is not null and y is not null"""
SQL["trajectory"] = with_(BASE, METRICS, LAPS) + """,
ok as (select session_id, start_sample_idx as s, end_sample_idx as e from laps where lap_time_s >= 20 and distance_m >= 150),
pl as (select * from ok union all select session_id, 0, n from size_ where n > 0 and session_id not in (select session_id from ok)),
pn as (select *, row_number() over (partition by session_id order by s) as k from pl),
z as (select t.session_id, t.sample_idx, arg_max(pn.k, pn.s) as k, max(pn.s) as s from tel t join pn on pn.session_id = t.session_id and t.sample_idx between pn.s and pn.e group by 1, 2)
select t.session_id, t.sample_idx, cast(z.k as int) as lap_index, round(t.elapsed_s - x.elapsed_s, 3) as lap_elapsed_s, round(t.distance_m - x.distance_m, 3) as lap_distance_m
from tel t left join z on z.session_id = t.session_id and z.sample_idx = t.sample_idx left join tel x on x.session_id = z.session_id and x.sample_idx = z.s"""
SQL["stored_session"] = with_(BASE, METRICS, recursive=False) + " select session_id, sample_idx, speed_mph, round(distance_m, 4) as distance_m from tel where session_id = '3'"
SQL["validation_files"] = with_(BASE, ROADS, recursive=False) + """
select p.session_id, 'ma' as method, p.sample_idx, cast(t.timestamp_ms as bigint) as timestamp, round(lat_raw, 8) as lat_raw, round(lon_raw, 8) as lon_raw, round(lat_smooth, 8) as lat_smooth, round(lon_smooth, 8) as lon_smooth,
  round(a.error_m, 4) as dist_error_raw_m, round(b.error_m, 4) as dist_error_smooth_m
from sp p join trk t on t.session_id = p.session_id and t.sample_idx = p.sample_idx
  left join er a on a.session_id = p.session_id and a.sample_idx = p.sample_idx and a.series = 'raw' left join er b on b.session_id = p.session_id and b.sample_idx = p.sample_idx and b.series = 'smooth'"""
SQL["overall_accuracy"] = SQL["accuracy"].replace("select session_id, series, count(*)", "select series, count(*)").replace("from er group by 1, 2", "from er group by 1")
TWO = THREE.replace("from sm3 group by 1)", "from sm3 where method = '{m}' group by 1)").replace("from sm3 p join cn", "from sm3 p join cn").replace("where lat is not null and lon is not null)", "where lat is not null and lon is not null and method = '{m}')")
SQL["stored_accuracy"] = " union all ".join(f"select session_id, method, n_points, 'gaussian' as second_call, round(mean_m, 4) as mean_m, round(p95_m, 4) as p95_m, round(max_m, 4) as max_m from ({with_(BASE, TWO.replace('{m}', m), recursive=False)} select * from ms)" for m in ("ma", "gaussian"))
SQL["log_quality"] = LOGS.replace("select sid, rn, event_type, event_id, v,", "select sid, rn, event_type as kind, case when rn % 13 <> 5 and rn % 17 = 3 then 'none' else event_type end as event_type, event_id, v,").replace("event_type = 'signup' as fix, coalesce(lag(event_type = 'signup') over", "event_type = 'signup' and not (rn % 13 <> 5 and rn % 17 = 3) as fix, coalesce(lag(event_type = 'signup' and not (rn % 13 <> 5 and rn % 17 = 3)) over") + """,
r as (select *, event_type = 'none' as unknown, rn % 13 = 5 as cut from q),
g as (select sid, step, count(*) as n, count(*) filter (cut and event_type in ('signup', 'click', 'error', 'view')) as short,
  coalesce(first(case when cut then null when event_id % 11 = 0 then null else ms end order by rn) filter (event_type = 'signup'), first(ms order by rn) filter (event_type not in ('signup', 'click', 'error', 'view'))) as ms,
  avg(cast('40.' || v as double)) filter (event_type = 'signup') as lat, avg(cast('-80.' || v as double)) filter (event_type = 'signup' and not cut) as lon from r where not unknown group by 1, 2)
select cast(r.sid as varchar) as session_id, count(*) as n_lines, count(*) filter (unknown) as n_unknown, any_value(x.n_short)::bigint as n_short, any_value(x.n_steps) as n_steps, any_value(x.n_untimed) as n_untimed, any_value(x.n_placed) as n_placed, any_value(x.n_placed) > 0 as has_position
from r join (select sid, sum(short) as n_short, count(*) as n_steps, count(*) filter (ms is null) as n_untimed, count(*) filter (ms is not null and lat is not null and lon is not null) as n_placed from g group by 1) x on x.sid = r.sid group by 1"""

SQL = {name: exact(text) for name, text in SQL.items()}
