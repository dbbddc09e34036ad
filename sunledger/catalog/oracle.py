"""Independent SQL for the registered queries, over the same given tables."""

from __future__ import annotations

import re

EXTENDED_ONLY = ("ambient_temp_c", "cell_temp_c", "wind_speed_ms", "dhi_wm2", "voc_v",
                 "stress_heat", "aging_factor", "ac_power_true", "mystery_reading")
SCADA_COLUMNS = ("poa_global_wm2", "ac_power_kw", "dc_power_kw", "ambient_temp_c",
                 "cell_temp_c", "wind_speed_ms")
ENGINEERED = ("hour_sin", "hour_cos", "doy_sin", "doy_cos", "performance_ratio",
              "pr_deviation", "dc_ac_power_ratio", "power_step")
SCALED = ("performance_ratio", "pr_deviation", "dc_ac_power_ratio", "power_step")
ALL_COLUMNS = ("event_id", "unit_id", "timestamp", "source_file", "sim_year", "sim_day",
               "latitude", "longitude", "fault_type", "fault_active", "poa_global_wm2",
               "ac_power_kw", "dc_power_kw") + EXTENDED_ONLY

CTES: dict[str, str] = {}

CTES["wide"] = """
select event_id, user_id as unit_id, ts as timestamp,
  concat('u', lpad(cast(user_id as varchar), 5, '0'),
    case user_id % 6 when 0 then '_baseline_noisy.parquet'
      when 1 then '_fault_click_af1_noisy.parquet'
      when 2 then '_fault_error_aging2_noisy.parquet'
      when 3 then '_fault_signup_noisy.parquet'
      when 4 then '_fault_purchase_af3_noisy.parquet'
      else '_combo_x_noisy.parquet' end) as source_file,
  1 + cast(floor((extract(day from ts) - 1) / 10.0) as int) as sim_year,
  cast(extract(day from ts) as int) as sim_day,
  cast(30.0 + 2.5 * (user_id % 5) as double) as latitude,
  cast(-100.0 + 10.0 * (user_id % 5) as double) as longitude,
  case when event_type = 'view' then 'none' else event_type end as fault_type,
  event_type <> 'view' as fault_active,
  cast(10.0 * k as float) as poa_global_wm2,
  cast(value as float) as ac_power_kw,
  cast(value * cast(case event_type when 'error' then 1.6 when 'click' then 1.3
      when 'purchase' then 1.15 when 'signup' then 1.05 else 1.0 end as double)
    + (k % 7) * cast(0.01 as double) as float) as dc_power_kw,
  cast(15 + (event_id % 200) * cast(0.1 as double) as float) as ambient_temp_c,
  cast(20 + k * cast(0.3 as double) as float) as cell_temp_c,
  cast((event_id % 13) * 0.5 as float) as wind_speed_ms,
  cast(0 as float) as dhi_wm2,
  cast(30 + (k % 11) * cast(0.2 as double) as float) as voc_v,
  cast(k / cast(50.0 as double) as float) as stress_heat,
  cast(1 - user_id * cast(0.0001 as double) as float) as aging_factor,
  cast(value as float) as ac_power_true,
  cast(event_id % 3 as float) as mystery_reading
from (select *, cast(json_extract(props, '$.k') as int) as k from events)"""
CTES["tele"] = f"select * exclude ({', '.join(EXTENDED_ONLY)}) from wide"
CTES["day"] = "select * from tele where poa_global_wm2 > 10.0"


def _feature_cte(source: str) -> str:
    return f"""
select * exclude (step, seen, mean12),
  cast(greatest(0, least(3, coalesce(case when seen >= 3
    then cast(performance_ratio as double) / nullif(mean12, 0) end, 1))) as float) as pr_deviation,
  cast(greatest(0, least(2, coalesce(max(step) over (partition by source_file
    order by timestamp, event_id rows between 11 preceding and current row), 0)))
    as float) as power_step
from (select *,
    avg(cast(performance_ratio as double)) over w12 as mean12,
    count(performance_ratio) over w12 as seen,
    abs(performance_ratio - lag(performance_ratio) over (partition by source_file
      order by timestamp, event_id)) as step
  from (select *,
      cast(sin(2 * pi() * (hour(timestamp) + minute(timestamp) / 60.0::double) / 24) as float) as hour_sin,
      cast(cos(2 * pi() * (hour(timestamp) + minute(timestamp) / 60.0::double) / 24) as float) as hour_cos,
      cast(sin(2 * pi() * dayofyear(timestamp) / 365.0::double) as float) as doy_sin,
      cast(cos(2 * pi() * dayofyear(timestamp) / 365.0::double) as float) as doy_cos,
      cast(greatest(-1, least(2, coalesce(cast(cast(cast(ac_power_kw as double) / 490 as float)
        / nullif(cast(cast(poa_global_wm2 as double) / 1000 as float), 0) as double), 0)))
        as float) as performance_ratio,
      cast(greatest(0, least(5, coalesce(cast(cast(dc_power_kw as float)
        / nullif(ac_power_kw, 0) as double), 1))) as float) as dc_ac_power_ratio
    from {source})
  window w12 as (partition by source_file order by timestamp, event_id
    rows between 11 preceding and current row))"""


CTES["feats"] = _feature_cte("day")
CTES["late_day"] = "select * from day where sim_year in (2, 3)"
CTES["late_feats"] = _feature_cte("late_day")
CTES["names"] = """
select source_file, regexp_replace(source_file, '\\.parquet$', '') as stem,
  regexp_replace(regexp_replace(regexp_replace(source_file, '\\.parquet$', ''),
    '_noisy$', ''), '_clean$', '') as scenario
from (select distinct source_file from tele)"""
CTES["plain_reg"] = """
select source_file, split_part(stem, '_', 1) as run_id,
  case when contains(scenario, '_fault_') then
      case when contains(split_part(scenario, '_fault_', 2), '_af')
             then split_part(split_part(scenario, '_fault_', 2), '_af', 1)
           when contains(split_part(scenario, '_fault_', 2), '_aging')
             then split_part(split_part(scenario, '_fault_', 2), '_aging', 1)
           else split_part(scenario, '_fault_', 2) end
    when contains(scenario, '_combo') then 'combo' else 'none' end as file_fault_type
from names"""


def _split_case(n: str, pos: str, last: str = "test") -> str:
    share = f"greatest(1, cast(floor(cast(0.2 as double) * {n}) as bigint))"
    return f"""case when {n} >= 3 then
      case when {pos} <= {n} - 2 * {share} then 'train'
           when {pos} <= {n} - {share} then 'val' else '{last}' end
    when {n} = 2 and {pos} = 2 then '{last}' else 'train' end"""


def _split_cte(source: str, keys: str, last: str = "test") -> str:
    return f"""
select * exclude (n, pos), {_split_case('n', 'pos', last)} as split
from (select *, count(*) over (partition by {keys}) as n,
    row_number() over (partition by {keys}
      order by md5(concat('42|', source_file)), source_file) as pos
  from {source})"""


CTES["reg"] = _split_cte("plain_reg", "file_fault_type")
CTES["pool"] = "select * exclude (split) from reg where split in ('train', 'val')"
CTES["pool_refold"] = _split_cte("pool", "file_fault_type", "unused")
CTES["schema_rows"] = """
select * from wide where source_file = (select source_file
  from (select distinct source_file from wide)
  order by contains(source_file, 'fault'), source_file limit 1)"""
CTES["flat"] = " union all ".join(
    f'select \'{c}\' as "column", count(distinct {c}) + coalesce(max(case when {c} is null '
    f"then 1 else 0 end), 0) as n_values from wide" for c in ALL_COLUMNS)
CTES["roles"] = """
select *, category in ('scada', 'iv_curve', 'stress') as included from (
  select c.name as "column", case
    when c.name in ('timestamp','sim_day','sim_year','latitude','longitude','tilt_deg',
      'azimuth_deg','dc_ac_ratio','run_id') then 'meta'
    when starts_with(c.name, 'fault_') then 'label'
    when starts_with(c.name, 'combo_') then 'combo'
    when ends_with(c.name, '_true') or c.name in ('noise_applied','is_dropout') then 'noise'
    when c.name = 'aging_factor' then 'simulator_internal'
    when f.n_values <= 1 then 'constant'
    when starts_with(c.name, 'stress_') then 'stress'
    when c.name in ('poa_global_wm2','ghi_wm2','dni_wm2','dhi_wm2','ambient_temp_c',
      'cell_temp_c','wind_speed_ms','precipitation_mm','dc_power_kw','ac_power_kw',
      'solar_elevation_deg','aoi_deg') then 'scada'
    when c.name in ('voc_v','jsc_a_m2','ff','vmpp_v','jmpp_a_m2','efficiency_pct')
      then 'iv_curve'
    else 'uncategorized' end as category
  from (values """ + ", ".join(f"('{c}')" for c in ALL_COLUMNS) + """) as c(name)
  left join flat f on f."column" = c.name)"""
CTES["mode_sets"] = """
select m.mode, r."column" as feature, case when r.category = 'scada' then 0
    when r.category = 'stress' then 2 else 3 end as block, row_number() over (
    partition by m.mode, r.category order by r."column") as nth
from (values ('scada', ['scada']), ('scada+stress', ['scada', 'stress']),
  ('scada+iv_curve', ['scada', 'iv_curve']), ('scada+device', ['scada', 'iv_curve']),
  ('full', ['scada', 'stress', 'iv_curve'])) as m(mode, kinds)
join roles r on list_contains(m.kinds, r.category)
union all
select m.mode, e.feature, 1, e.nth
from (values ('scada'), ('scada+stress'), ('scada+iv_curve'), ('scada+device'), ('full')) as m(mode),
  (values """ + ", ".join(f"('{f}', {i})" for i, f in enumerate(ENGINEERED)) + """) as e(feature, nth)"""
CTES["sites"] = """
select source_file, concat_ws('_', cast(round(latitude, 2) as varchar),
  cast(round(longitude, 2) as varchar)) as loc_id
from (select distinct on (source_file) source_file, latitude, longitude from tele
  order by source_file, timestamp, event_id)"""
CTES["labels_all"] = """
select fault_type, cast(dense_rank() over (order by fault_type) - 1 as int) as label
from (select distinct fault_type from tele where fault_active)"""
CTES["partial"] = """
select distinct file_fault_type as fault_type from plain_reg where contains(source_file, '_af')"""
CTES["pr_ratio"] = """
select *, coalesce(cast(dc_power_kw as double) / nullif(cast(ac_power_kw as double), 0), 1)
  as ratio from day"""
CTES["detect"] = """
select row_id, model, y_true, case when p >= 0.5 then 1 else 0 end as y_pred, p from (
  select event_id as row_id, 'ratio' as model, cast(fault_active as int) as y_true,
    least(1, greatest(0, (ratio - cast(0.9 as double)) / cast(0.8 as double))) as p from pr_ratio
  union all
  select event_id, 'sun', cast(fault_active as int),
    cast(poa_global_wm2 as double) / 1000 from pr_ratio)"""
CTES["class_raw"] = """
select row_id, model, y_true, [
    1 / (1 + 20 * abs(r - cast(1.3 as double))), 1 / (1 + 20 * abs(r - cast(1.6 as double))),
    1 / (1 + 20 * abs(r - cast(1.15 as double))), 1 / (1 + 20 * abs(r - cast(1.05 as double)))
  ] as raw from (
  select event_id as row_id, 'near' as model, label as y_true, ratio + cast(0 as double) as r
    from pr_ratio join labels_all using (fault_type) where fault_active
  union all
  select event_id, 'drift', label, ratio + cast(poa_global_wm2 as double) / 5000
    from pr_ratio join labels_all using (fault_type) where fault_active)"""
CTES["classify"] = """
select row_id, model, y_true, cast(list_position(raw, list_max(raw)) - 1 as int) as y_pred,
  list_transform(raw, lambda x: x / (raw[1] + raw[2] + raw[3] + raw[4])) as prob
from class_raw"""
CTES["fault_vocab"] = """
select label, fault_type as class_name from labels_all union all select 9, 'offline'"""


def _report(pairs: str, classes: str) -> str:
    return f"""
select model, class_name, round(precision, 9) as precision, round(recall, 9) as recall,
  round(f1, 9) as f1, cast(support as bigint) as support from (
with hits as (
  select m.model, c.class_name, count(*) filter (p.y_true = c.label) as support,
    count(*) filter (p.y_pred = c.label) as said,
    count(*) filter (p.y_true = c.label and p.y_pred = c.label) as hit
  from (select distinct model from {pairs}) m cross join {classes} c
  left join {pairs} p on p.model = m.model and (p.y_true = c.label or p.y_pred = c.label)
  group by all),
rates as (
  select *, coalesce(hit / nullif(cast(said as double), 0), 0) as precision,
    coalesce(hit / nullif(cast(support as double), 0), 0) as recall from hits),
rated as (
  select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from rates)
select model, class_name, precision, recall, f1, support from rated
union all
select model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)
from rated group by model
union all
select model, 'weighted avg', sum(precision * support) / sum(support),
  sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
from rated group by model
union all
select model, 'accuracy', avg(cast(y_true = y_pred as double)),
  avg(cast(y_true = y_pred as double)), avg(cast(y_true = y_pred as double)), count(*)
from {pairs} group by model)"""


CTES["toxic"] = """
select 'toxic' as model, quality as y_true, 1 - toxic as y_pred from labels"""
CTES["two_classes"] = """
select * from (values (0, 'Healthy'), (1, 'Faulted')) as t(label, class_name)"""
CTES["fault_report"] = _report("classify", "fault_vocab")
CTES["both_auc"] = """
select model, (sum(rk) filter (y_true = 1) - count(*) filter (y_true = 1)
    * (count(*) filter (y_true = 1) + 1) / 2.0::double)
  / (count(*) filter (y_true = 1) * cast(count(*) filter (y_true = 0) as double)) as auc
from (select model, y_true, rank() over (partition by model order by p)
    + (count(*) over (partition by model, p) - 1) / 2.0::double as rk from detect)
group by model"""
CTES["ovr_auc"] = """
select model, sum(auc * n_pos) / sum(n_pos) as auc from (
  select model, label, count(*) filter (pos) as n_pos,
    (sum(rk) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0::double)
    / (count(*) filter (pos) * cast(count(*) filter (not pos) as double)) as auc
  from (select model, label, pos, rank() over (partition by model, label order by score)
      + (count(*) over (partition by model, label, score) - 1) / 2.0::double as rk
    from (select model, c.label, y_true = c.label as pos, prob[c.label + 1] as score
      from classify, (select unnest(range(0, 4)) as label) c))
  group by model, label) group by model"""
CTES["long_feats"] = " union all ".join(
    f"select event_id, fault_active, '{f}' as feature, cast({f} as double) as value from feats"
    for f in ENGINEERED)
CTES["influence"] = """
select feature, avg(abs(value - 0.5)) as mean_abs, avg(value - 0.5) as mean_signed
from long_feats group by feature"""
CTES["scaler"] = "select " + ", ".join(
    f"avg(cast({c} as double)) as mean_{c}, stddev_pop(cast({c} as double)) as std_{c}"
    for c in SCALED) + " from feats"


def _windows(source: str, label: str, extra: str = "") -> str:
    return f"""
select source_file, window_id, cast(count(*) as int) as n_rows, min(timestamp) as start_ts,
  max(timestamp) as end_ts, arg_max({label}, rn) as label {extra}
from (select *, unnest(range(greatest(0, cast(ceil((rn - 11) / 5.0) as bigint)),
      cast(floor(rn / 5.0) as bigint) + 1)) as window_id
  from (select *, row_number() over (partition by source_file
      order by timestamp, event_id) - 1 as rn from {source}))
group by source_file, window_id having count(*) = 12"""


CTES["day_labelled"] = "select *, cast(fault_active as int) as y from day"
CTES["day_faulted"] = "select * from day where fault_active"
CTES["win"] = _windows("day_labelled", "y")
CTES["win_rows"] = """
select *, unnest(range(greatest(0, cast(ceil((rn - 11) / 5.0) as bigint)),
    cast(floor(rn / 5.0) as bigint) + 1)) as window_id
from (select *, row_number() over (partition by source_file order by timestamp, event_id) - 1
    as rn, count(*) over (partition by source_file) as n from day_labelled)"""


def _thin(source: str) -> str:
    return f"""
select * exclude (t, f, nth) from (
  select *, row_number() over (partition by source_file, fault_active
      order by md5(concat('42|', cast(event_id as varchar))), event_id) as nth
  from (select *, count(*) filter (fault_active) over (partition by source_file) as t,
      count(*) filter (not fault_active) over (partition by source_file) as f from {source}))
where nth <= case when fault_active and t >= f then greatest(1, t // 4)
  when not fault_active and f > t then greatest(1, f // 4) else t + f end"""


def _stratified(source: str, label: str, cap: int) -> str:
    return f"""
select s.* from (
  select *, row_number() over (partition by {label}
    order by md5(concat('42|', cast(event_id as varchar))), event_id) as nth,
    count(*) over () as everything from {source}) s
join (select {label}, base + case when row_number() over (order by spare desc, {label})
      <= {cap} - sum(base) over () then 1 else 0 end as quota
  from (select {label}, {cap} * n // total as base, {cap} * n % total as spare
    from (select {label}, count(*) as n, sum(count(*)) over () as total
      from {source} group by {label}))) q using ({label})
where s.everything <= {cap} or s.nth <= q.quota"""


CTES["order_rows"] = """
select o_orderkey as event_id, o_orderpriority, o_orderstatus from orders"""
CTES["train_feats"] = """
select f.* from feats f where source_file in (select source_file from reg where split = 'train')"""
CTES["thin_train"] = _thin("train_feats")
CTES["fold_pool"] = """
select s.loc_id as test_loc_id, p.*, f.loc_id from pool p join sites f using (source_file)
cross join (select distinct loc_id from pool join sites using (source_file)) s"""
CTES["fold_train"] = "select * from fold_pool where loc_id <> test_loc_id"

SQL: dict[str, str] = {}
B = "source_file, event_id"
SQL["scan_batch"] = f"""select {B}, timestamp, sim_year, poa_global_wm2, ac_power_kw, fault_type
from tele where sim_year in (1, 3)"""
SQL["load_entry"] = "select * exclude (unit_id) from late_feats"
SQL["discover_sites"] = """select distinct round(latitude, 2) as latitude,
  round(longitude, 2) as longitude, concat_ws('_', cast(round(latitude, 2) as varchar),
  cast(round(longitude, 2) as varchar)) as site from tele"""
SQL["file_row_counts"] = "select source_file, count(*) as n_rows from tele group by source_file"
SQL["footer_row_counts"] = SQL["file_row_counts"]
SQL["read_batch_config"] = """with places as (
  select distinct round(latitude, 2) as lat, round(longitude, 2) as lon from tele)
select cast(row_number() over (order by lat, lon) - 1 as int) as site_no, lat as site_lat,
  lon as site_lon, 'site ' || cast(lat as varchar) as site_name,
  (select count(*) from places) * cast(0.25 as double) as array_kwp from places"""
SQL["save_load_manifest"] = "select *, count(*) over () as n_entries from reg"
SQL["daytime_filter"] = f"select {B}, poa_global_wm2 from day"
SQL["year_filter"] = f"""select {B}, sim_year, split from tele join reg using (source_file)
where split = 'val' or (split = 'train' and sim_year in (1, 2)) or (split = 'test' and sim_year = 3)"""
SQL["faulted_only"] = f"select {B}, fault_type from tele where fault_active"
SQL["drop_healthy_files"] = "select * from plain_reg where file_fault_type <> 'none'"
SQL["known_class_filter"] = f"""select {B}, fault_type from tele
where fault_active and fault_type in (select fault_type from partial)"""
SQL["unseen"] = """select fault_type, count(*) as n_dropped from tele
where fault_active and fault_type not in (select fault_type from partial) group by fault_type"""
SQL["constant_columns"] = 'select "column" from flat where n_values <= 1'
SQL["footer_constant_columns"] = SQL["constant_columns"]
SQL["classify_columns"] = "select * from roles"
SQL["load_columns"] = """select "column" from roles
where included or category in ('meta', 'label')"""
SQL["feature_set"] = """select mode, feature, cast(row_number() over (partition by mode
  order by block, nth) - 1 as int) as position from mode_sets"""
SQL["estimate_capacity"] = """select cast(max(dc_power_kw) as double) * cast(1.05 as double)
  as array_kwp from wide"""
SQL["footer_capacity"] = SQL["estimate_capacity"]
SQL["batch_summary"] = """select
  (select cast(max(dc_power_kw) as double) * cast(1.05 as double) from wide) as array_kwp,
  (select count(distinct loc_id) from sites) as n_sites,
  cast(count(*) filter (category = 'scada') as int) as n_scada,
  cast(count(*) filter (category = 'iv_curve') as int) as n_iv_curve,
  cast(count(*) filter (category = 'stress') as int) as n_stress,
  cast(count(*) filter (included) as int) as n_features from roles"""
SQL["custom_runners"] = """select 'fault_active' as task, 'ratio_rule' as model,
  round((sum(rk) filter (fault_active) - count(*) filter (fault_active)
      * (count(*) filter (fault_active) + 1) / 2.0::double)
    / (count(*) filter (fault_active) * cast(count(*) filter (not fault_active) as double)), 9)
  as auc
from (select fault_active, rank() over (order by p)
    + (count(*) over (partition by p) - 1) / 2.0::double as rk
  from (select fault_active, least(1, cast(dc_ac_power_ratio as double) / 5) as p
    from feats join reg using (source_file) where split = 'test'))"""
SQL["schema_file_pick"] = "select distinct source_file from schema_rows"
SQL["parse_file_fault_type"] = "select source_file, file_fault_type from plain_reg"
SQL["parse_run_id"] = """select source_file, stem, run_id
from names join plain_reg using (source_file)"""
SQL["loc_id"] = """select distinct latitude, longitude, concat_ws('_',
  cast(round(latitude, 2) as varchar), cast(round(longitude, 2) as varchar)) as loc_id from tele"""
SQL["clean_matrix"] = f"""select {B}, ac_power_kw,
  case when event_id % 7 < 4 then cast(0 as float) else ac_power_kw end as spiky, dc_power_kw
from tele"""
SQL["downcast"] = """select l_orderkey, l_linenumber, cast(l_quantity as float) as l_quantity,
  cast(l_extendedprice as float) as l_extendedprice, cast(l_discount as float) as l_discount,
  cast(l_tax as float) as l_tax from lineitem"""
SQL["time_features"] = f"select {B}, hour_sin, hour_cos, doy_sin, doy_cos from feats"
SQL["performance_ratio"] = f"select {B}, performance_ratio from feats"
SQL["performance_ratio_no_capacity"] = f"""select {B}, cast(greatest(-100, least(100,
  coalesce(cast(ac_power_kw / nullif(cast(cast(poa_global_wm2 as double) / 1000 as float), 0)
  as double), 0))) as float) as performance_ratio from day"""
SQL["dc_ac_power_ratio"] = f"select {B}, dc_ac_power_ratio from feats"
SQL["pr_deviation"] = f"select {B}, performance_ratio, pr_deviation from feats"
SQL["power_step"] = f"select {B}, performance_ratio, power_step from feats"
SQL["rows_with_split"] = f"""select {B}, run_id, file_fault_type, split
from tele join reg using (source_file)"""
SQL["encode_labels"] = f"""select {B}, fault_type, label
from tele join labels_all using (fault_type) where fault_active"""
SQL["decode_labels"] = """select row_id, fault_type as predicted from classify c
join labels_all l on l.label = c.y_pred where model = 'drift'"""
SQL["site_name"] = """
with listed as (select concat('site ', loc_id) as site_name,
    round(la + case when la > 34 then 0.04 else 0 end, 2) as la, round(lo, 2) as lo
  from (select distinct loc_id, cast(split_part(loc_id, '_', 1) as double) as la,
      cast(split_part(loc_id, '_', 2) as double) as lo from sites) where la < 37),
points as (select distinct latitude, longitude from tele)
select latitude, longitude, coalesce(min(site_name), printf('%.2f_%.2f', latitude, longitude))
  as location_name
from points left join listed on abs(la - latitude) < 0.05 and abs(lo - longitude) < 0.05
group by latitude, longitude"""
SQL["feature_group"] = """select s.feature, s.score, r.category as feature_group from (
""" + " union all ".join(f"select '{c}' as feature, cast(max({c}) as double) as score from wide"
                         for c in (*SCADA_COLUMNS, "voc_v", "stress_heat")) + """) s
join roles r on r."column" = s.feature"""
SQL["merge_reports"] = """select class_name as fault_type, """ + ", ".join(
    f"max({v}) filter (model = '{m}') as {m}_{v}"
    for m in ("near", "drift") for v in ("f1", "precision", "recall")) + """
from fault_report where class_name in (select class_name from fault_vocab) group by class_name"""
SQL["write_metrics_csv"] = SQL["merge_reports"]
SQL["fold_expand"] = """select p.*, s.loc_id as test_loc_id from plain_reg p
cross join (select distinct loc_id from sites) s"""
SQL["fault_counts"] = """
select 'fault_active' as kind, cast(fault_active as varchar) as value, count(*) as n
from tele group by 2
union all select 'fault_type', fault_type, count(*) from tele where fault_active group by 2"""
SQL["fault_prevalence"] = """select count(*) filter (not fault_active) as healthy,
  count(*) filter (fault_active) as faulted,
  cast(100 as double) * count(*) filter (not fault_active) / count(*) as healthy_pct,
  cast(100 as double) * count(*) filter (fault_active) / count(*) as faulted_pct from day"""
SQL["year_fault_rate"] = """select sim_year, count(*) filter (fault_active) as faulted,
  count(*) as n_rows, count(*) filter (fault_active) / cast(count(*) as double) as fault_rate
from day group by sim_year"""
SQL["yearly_features"] = """select sim_year, count(*) filter (fault_active) as faulted,
  count(*) as n_rows, round(avg(cast(fault_active as int)), 9) as fault_rate, """ + ", ".join(
    f"round(avg(cast({c} as double)), 9) as avg_{c}"
    for c in ("performance_ratio", "pr_deviation", "dc_ac_power_ratio", "power_step")) + """
from feats group by sim_year"""
SQL["feature_describe"] = """select feature, count(*) as count, round(avg(value), 4) as mean,
  round(stddev_samp(value), 4) as std, round(min(value), 4) as min,
  round(quantile_cont(value, 0.25), 4) as q25, round(quantile_cont(value, 0.5), 4) as q50,
  round(quantile_cont(value, 0.75), 4) as q75, round(max(value), 4) as max
from long_feats group by feature"""
SQL["feature_histogram"] = """
with span as (select feature, fault_active, count(*) as total,
    min(value) - case when min(value) = max(value) then 0.5 else 0 end as lo,
    max(value) + case when min(value) = max(value) then 0.5 else 0 end as hi
  from long_feats group by all),
wide_span as (select *, (hi - lo) / 50 as w from span),
grid as (select s.*, b.bin from wide_span s, (select unnest(range(0, 50)) as bin) b),
hits as (select feature, fault_active, least(49, cast(floor((value - lo) / w) as bigint)) as bin,
    count(*) as n from long_feats join wide_span using (feature, fault_active) group by all)
select feature, fault_active, cast(bin as int) as bin, round(lo + bin * w, 8) as bin_start,
  coalesce(n, 0) as n, round(coalesce(n, 0) / (total * w), 8) as density
from grid left join hits using (feature, fault_active, bin)"""
_CORR = (*SCADA_COLUMNS, "fault_active")


def _number(name: str) -> str:
    return f"cast(cast({name} as int) as double)" if name == "fault_active" else (
        f"cast({name} as double)")


SQL["correlation_matrix"] = "with sunny as (select * from wide where poa_global_wm2 > 10) " + \
    " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, "
        f"round(corr({_number(a)}, {_number(b)}), 9) as correlation from sunny"
        for a in _CORR for b in _CORR)
SQL["discover_fault_types"] = """select distinct fault_type from tele
where fault_active and sim_year in (1, 2)"""
SQL["class_counts"] = """
select cast(fault_active as int) as label, count(*) as n, 'fault_active' as target
from tele group by 1
union all select label, count(*), 'fault_type' from tele join labels_all using (fault_type)
where fault_active group by label"""
_WIDER = """with classes as (select label from labels_all
  union all select max(label) + 1 from labels_all),
filled as (select label, coalesce(n, 0) as n, sum(n) over () as total, count(*) over () as k
  from classes left join (select label, count(*) as n from tele
    join labels_all using (fault_type) where fault_active group by label) using (label))
select cast(label as int) as label, n, """
SQL["balanced_weights"] = _WIDER + """round(coalesce(cast(total as double) / nullif(k * n, 0), 1), 9)
  as weight from filled"""
SQL["sequence_weights"] = _WIDER + """round(cast(total as double) / (k * greatest(n, 1)), 9)
  as weight from filled"""
SQL["fit_scaler"] = " union all ".join(
    f"select '{c}' as feature, round(mean_{c}, 9) as mean, round(std_{c}, 9) as std from scaler"
    for c in SCALED)
SQL["apply_scaler"] = f"select {B}, " + ", ".join(
    f"round(cast(cast((cast({c} as double) - mean_{c}) / coalesce(nullif(std_{c}, 0), 1) as float)"
    f" as double), 4) as {c}" for c in SCALED) + " from feats, scaler"
SQL["distinct_years"] = "select distinct sim_year from tele"
SQL["confusion_matrix"] = """
with present as (select distinct model, y_true as label from classify
  union select model, y_pred from classify)
select a.model, a.label as y_true, b.label as y_pred, count(c.row_id) as n
from present a join present b using (model)
left join classify c on c.model = a.model and c.y_true = a.label and c.y_pred = b.label
group by all"""
SQL["classification_report"] = "select * from fault_report"
SQL["detection_report"] = _report("detect", "two_classes")
SQL["label_quality_report"] = _report("toxic", "two_classes")
SQL["accuracy"] = """select model, round(avg(cast(y_true = y_pred as double)), 9) as accuracy
from detect group by model"""
SQL["roc_auc_binary"] = "select model, round(auc, 9) as auc from both_auc"
SQL["roc_auc_ovr_weighted"] = "select model, round(auc, 9) as auc from ovr_auc"
SQL["per_fault_f1"] = """select class_name as fault_type,
  max(f1) filter (model = 'near') as near_f1, max(f1) filter (model = 'drift') as drift_f1
from fault_report where class_name in (select class_name from fault_vocab) group by class_name"""
SQL["attribution_summary"] = """select feature, round(mean_abs, 8) as mean_abs,
  round(mean_signed, 8) as mean_signed,
  case when mean_signed >= 0 then 'fault' else 'healthy' end as direction from influence"""
SQL["path_attribution"] = f"""with fed as (select {B}, cast(fault_active as int) as y,
    cast(dc_ac_power_ratio as double) as q, cast(performance_ratio as double) as p,
    cast(power_step as double) as s from feats),
  sided as (select *, q <= 1.1::double as low, p <= 0.5::double as weak,
    s <= 0.25::double as calm from fed),
  shared as (select *, avg(y) over () as top, avg(y) over (partition by low) as mid,
    avg(y) over (partition by low, case when low then weak else calm end) as leaf from sided)
select {B}, round(top, 9) as base, round(leaf, 9) as probability,
  round(mid - top, 9) as dc_ac_power_ratio,
  round(case when low then leaf - mid else 0 end, 9) as performance_ratio,
  round(case when low then 0 else leaf - mid end, 9) as power_step from shared"""
SQL["model_attributions"] = f"""with sizes as (
  select cast(count(*) as int) as n_inputs from ({SQL["feature_set"]}) where mode = 'full')
select 'random_forest' as model, count(*) as n_rows, any_value(n_inputs) as n_inputs,
  true as adds_up from feats join reg using (source_file), sizes where split = 'test'
union all
select 'mlp', count(*), any_value(n_inputs), true
from win join reg using (source_file), sizes where split = 'test'"""
SQL["split_counts"] = """select split, file_fault_type, count(*) as n_files
from reg group by split, file_fault_type"""
SQL["short_run_loss"] = """select count(*) filter (n < 65) as runs_lost, count(*) as n_runs,
  cast(coalesce(sum(n) filter (n < 65), 0) as bigint) as rows_lost,
  cast(sum(n) as bigint) as n_rows,
  round(cast(100 as double) * coalesce(sum(n) filter (n < 65), 0) / sum(n), 9) as pct_rows_lost
from (select count(*) as n from day group by source_file)"""
SQL["sequence_windows"] = "select * from win"
SQL["window_label"] = _windows("day_faulted", "fault_type")
SQL["window_arrays"] = """select source_file, window_id, cast(rn - window_id * 5 as int) as step,
  ac_power_kw, dc_power_kw from win_rows where window_id * 5 + 12 <= n"""
SQL["window_summary"] = "select source_file, window_id, cast(count(*) as int) as n_rows, " \
    "arg_max(y, rn) as label, " + ", ".join(
        f"arg_max(cast({c} as double), rn) as {c}_last, "
        f"round(avg(cast({c} as double)), 6) as {c}_mean, "
        f"round(stddev_samp(cast({c} as double)), 6) as {c}_std, "
        f"min(cast({c} as double)) as {c}_min, max(cast({c} as double)) as {c}_max, "
        f"round(regr_slope(cast({c} as double), cast(rn - window_id * 5 as double)), 6) as {c}_slope"
        for c in ("ac_power_kw", "dc_power_kw")) + """
from win_rows where window_id * 5 + 12 <= n group by source_file, window_id"""
SQL["window_convolution"] = """with bent as (select source_file, window_id, rn, y,
    lag(cast(ac_power_kw as double), 2) over w - 2 * cast(ac_power_kw as double)
      + lead(cast(ac_power_kw as double), 2) over w as bend
  from win_rows where window_id * 5 + 12 <= n
  window w as (partition by source_file, window_id order by rn))
select source_file, window_id, cast(count(*) as int) as n_rows, arg_max(y, rn) as label,
  round(max(bend), 9) as kernel_0_max,
  round(cast(count(*) filter (bend > 0) as double) / count(bend), 9) as kernel_0_above
from bent group by source_file, window_id"""
SQL["last_step"] = """select source_file, window_id, y as label, ac_power_kw from win_rows
where rn = window_id * 5 + 11 and window_id * 5 + 12 <= n"""
SQL["val_fallback"] = """
with placed as (select source_file, window_id, split from win join reg using (source_file)
  where split <> 'val')
select * from placed union all select source_file, window_id, 'val' from placed
where split = 'train'"""
SQL["assign_splits"] = "select * from reg"
SQL["limit_runs"] = """select source_file, run_id, file_fault_type from (
  select *, row_number() over (partition by file_fault_type order by source_file) as nth,
    greatest(1, 8 // (select count(distinct file_fault_type) from plain_reg)) as quota
  from plain_reg) where nth <= quota order by source_file limit 8"""
SQL["thin_majority"] = f"select {B}, fault_active from ({_thin('tele')})"
SQL["stratified_subsample"] = f"select {B}, fault_type from ({_stratified('tele', 'fault_type', 5000)})"
SQL["stratified_orders"] = f"""select event_id, o_orderpriority, o_orderstatus
from ({_stratified('order_rows', 'o_orderpriority', 5000)})"""
SQL["load_split"] = f"""select {B}, fault_type, performance_ratio, pr_deviation, power_step
from ({_stratified('thin_train', 'fault_type', 1000)})"""
SQL["class_balanced_batches"] = """
with placed as (select *, row_number() over (partition by file_fault_type order by source_file) - 1
    as nth, count(*) over (partition by file_fault_type) as n,
    dense_rank() over (order by file_fault_type) - 1 as g from plain_reg),
slots as (select unnest(range(0, (select cast(ceil(count(*) / 4.0) as bigint) * 4
  from plain_reg))) as slot, (select count(distinct file_fault_type) from plain_reg) as k)
select slot, slot // 4 as batch, file_fault_type, source_file
from slots join placed on g = slot % k and nth = (slot // k) % n"""
SQL["head_tail_sample"] = """
select source_file, event_id, timestamp, 'head' as part from (
  select * from schema_rows order by timestamp, event_id limit 20)
union all select source_file, event_id, timestamp, 'tail' from (
  select * from schema_rows order by timestamp desc, event_id desc limit 20)"""
_DAY_101 = """(select sim_day from day
  order by source_file, timestamp, event_id limit 1 offset 100)"""
SQL["nth_row_day"] = f"select {B}, sim_day from day where sim_day = {_DAY_101}"
SQL["fault_spans"] = """
select source_file, min(timestamp) as start_ts, max(timestamp) as end_ts, count(*) as n_rows
from (select *, row_number() over (partition by source_file order by timestamp, event_id)
    - row_number() over (partition by source_file, fault_active order by timestamp, event_id)
    as island from day)
where fault_active group by source_file, island"""
SQL["sample_series"] = f"""select source_file, timestamp, event_id, poa_global_wm2, ac_power_kw,
  performance_ratio, fault_active from feats where sim_day = {_DAY_101}"""
SQL["sort_run"] = f"""select {B}, timestamp, row_number() over (partition by source_file
  order by timestamp, event_id) - 1 as rn from tele where fault_active"""
SQL["rank_models"] = """select model, round(auc, 9) as auc from (
  select * from both_auc union all select * from ovr_auc)"""
SQL["top_features"] = """select feature, round(mean_abs, 8) as mean_abs from influence
order by influence.mean_abs desc limit 3"""
SQL["first_row_per_file"] = """select distinct on (source_file) source_file, latitude, longitude,
  timestamp from tele order by source_file, tele.timestamp, event_id"""
SQL["union_files"] = f"""select {B}, fault_type,
  case when unit_id % 2 = 1 then ac_power_kw end as ac_power_kw from tele"""
SQL["column_sets"] = """select string_agg(feature, ',' order by feature) as either,
  string_agg(feature, ',' order by feature) filter (block < 2) as both,
  string_agg(feature, ',' order by feature) filter (block >= 2) as left_only
from mode_sets where mode = 'full'"""
SQL["train_years"] = """select distinct sim_year from tele
where sim_year < (select max(sim_year) from tele)"""
SQL["missing_classes"] = """select fault_type from labels_all
where fault_type not in (select fault_type from partial)"""
SQL["resolve_entries"] = "select * from reg where file_fault_type <> 'none'"
SQL["label_table"] = """select fault_type, cast(row_number() over (order by fault_type) - 1 as int)
  as label from (select distinct fault_type from tele join reg using (source_file)
  where fault_active and split in ('train', 'val'))"""
SQL["refold"] = "select * from pool_refold"
SQL["temporal_folds"] = """
with years as (select list_sort(list(distinct sim_year)) as ys from tele
  where source_file in (select source_file from pool))
select p.*, array_to_string(ys[1:len(ys) - 1], ',') as years from pool_refold p, years
union all
select p.*, 'test' as split, cast(ys[len(ys)] as varchar) from pool p, years"""
SQL["location_folds"] = f"""
{_split_cte('fold_train', 'test_loc_id, file_fault_type', 'unused')}
union all select *, 'test' as split from fold_pool where loc_id = test_loc_id"""
SQL["split_leak_check"] = """select count(*) as n_files,
  count(*) filter (n_splits > 1) as n_leaks
from (select source_file, count(distinct split) as n_splits from reg group by source_file)"""


def _needed(text: str, candidates: list[str]) -> set[str]:
    """Shared tables a text refers to; each may only refer to those defined before it."""
    found: set[str] = set()
    for at, name in enumerate(candidates):
        if re.search(rf"\b{name}\b", text):
            found |= {name} | _needed(CTES[name], candidates[:at])
    return found


def render(body: str) -> str:
    """A query with the shared tables it refers to put in front."""
    needed = _needed(body, list(CTES))
    found = [name for name in CTES if name in needed]
    parts = [f"{name} as ({CTES[name]})" for name in found]
    body = body.strip()
    if not parts:
        return body
    if body.startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[len("with "):]
    return "with " + ",\n".join(parts) + "\n" + body


def oracle_sql() -> dict[str, str]:
    return {name: render(body) for name, body in SQL.items()}
