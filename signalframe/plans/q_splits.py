"""Split, selection and corpus-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import tables
from ..operators import rank, splits, stats, windowing
from . import fixtures as X
from .q_labels import DATASETS_SQL, dataset_of, dataset_of_sql
from .registry import query, rnd, scratch, sql_digest, sql_rnd, sql_uniform

# -- splits: a supplier's line item is a window of recording l_orderkey ----------

_SPLIT = lambda u: f"case when {u} < 0.8::double then 'train' when {u} < (0.8::double + 0.1::double) then 'val' else 'test' end"


@query("split_subject_hash", f"select c_custkey as subject_id, {_SPLIT(sql_uniform(42, 'c_custkey'))} as split from customer")
def _(T):
    return splits.subject_split(T.customer.withColumnRenamed("c_custkey", "subject_id"))


@query("split_records_by_subject", f"""select l_suppkey as subject_id, {_SPLIT(sql_uniform(42, 'l_suppkey'))} as split, count(*) as n, sum(l_orderkey)::bigint as keys from lineitem group by 1, 2""")
def _(T):
    rows = T.lineitem.select(F.col("l_suppkey").alias("subject_id"), "l_orderkey")
    got = splits.split_records(rows, recording="subject_id")
    return got.groupBy("subject_id", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("join_split_to_windows", f"""with {X.windows_sql()}, a as (select s_suppkey as recording_id, {_SPLIT(sql_uniform(42, 's_suppkey'))} as split from supplier)
select recording_id, channel, start, split from windows join a using (recording_id)""")
def _(T):
    a = splits.subject_split(T.supplier.withColumnRenamed("s_suppkey", "recording_id"), subject="recording_id")
    return splits.attach_split(T.windows(), a, "recording_id").select("recording_id", "channel", "start", "split")


@query("split_leakage_report", f"""with w as (select l_orderkey as recording_id, {_SPLIT(sql_uniform(42, 'l_orderkey', 'l_partkey'))} as split from lineitem)
select recording_id, min(split) as first_split, max(split) as last_split from w group by 1 having min(split) <> max(split)""")
def _(T):
    w = T.lineitem.select(F.col("l_orderkey").alias("recording_id"), splits.subject_split_expr(F.concat_ws("::", "l_orderkey", "l_partkey")).alias("split"))
    return splits.leaks(w, "recording_id")


@query("split_overlap_pairs", f"""with w as (select l_orderkey as recording_id, {_SPLIT(sql_uniform(42, 'l_orderkey', 'l_partkey'))} as split from lineitem)
select recording_id from w where split = 'train' intersect select recording_id from w where split = 'test'""")
def _(T):
    w = T.lineitem.select(F.col("l_orderkey").alias("recording_id"), splits.subject_split_expr(F.concat_ws("::", "l_orderkey", "l_partkey")).alias("split"))
    ids = lambda s: w.filter(F.col("split") == s).select("recording_id")
    return ids("train").intersect(ids("test"))


def _ranked(src, key, seed):
    return f"""ids as (select distinct {key} as id from {src}),
rk as (select id, row_number() over (order by {sql_digest(seed, 'id')}, id) - 1 as r, count(*) over () as n from ids)"""


@query("split_ratio_ceil", f"""with {_ranked('orders', 'o_orderkey', 42)},
s as (select *, ceil(n * 0.3::double) as held from rk), q as (select *, ceil(held * (0.1::double / (0.2::double + 0.1::double))) as last from s)
select id as o_orderkey, case when r < n - held then 'train' when r < n - last then 'val' else 'test' end as split from q""")
def _(T):
    return splits.ratio_split(T.orders, "o_orderkey")


@query("split_ratio_two_way", f"""with {_ranked('orders', 'o_orderkey', 42)}
select id as o_orderkey, case when r < n - ceil(n * 0.15::double) then 'train' else 'val' end as split from rk""")
def _(T):
    return splits.ratio_split(T.orders, "o_orderkey", (0.85, 0.15))


@query("split_ratio_floor", f"""with {_ranked('orders', 'o_orderkey', 42)}
select id as o_orderkey, case when r < floor(n * 0.7::double) then 'train' when r < floor(n * 0.7::double) + floor(n * 0.2::double) then 'val' else 'test' end as split from rk""")
def _(T):
    return splits.ratio_split(T.orders, "o_orderkey", sizing="floor")


@query("split_random_val_fraction", f"""with {_ranked('events', 'event_id', 9)}
select id as event_id, case when r < n - floor(n * 0.2::double) then 'train' else 'val' end as split from rk""")
def _(T):
    return splits.ratio_split(T.events, "event_id", (0.8, 0.2), 9, "floor")


@query("split_predefined_fold", """select o_orderkey, case when o_orderkey % 10 + 1 <= 8 then 'train' when o_orderkey % 10 + 1 = 9 then 'val' else 'test' end as split from orders""")
def _(T):
    return splits.fold_split(T.orders.withColumn("strat_fold", F.col("o_orderkey") % 10 + 1), "strat_fold").select("o_orderkey", "split")


@query("split_subject_holdout", f"""with {_ranked('customer', 'c_custkey', 7)},
t as (select *, least(greatest(1, floor(0.6::double * n)), n - 2) as tr from rk), v as (select *, least(greatest(1, floor(0.2::double * n)), n - tr - 1) as va from t)
select id as c_custkey, case when r < tr then 'train' when r < tr + va then 'val' else 'test' end as split from v""")
def _(T):
    return splits.holdout_split(T.customer, "c_custkey")


@query("split_list_fold", f"""with l as (select c_custkey as id, row_number() over (order by c_custkey) - 1 as pos, count(*) over () as n from customer),
h as (select *, pos >= 3 * (n // 10) and pos < 4 * (n // 10) as held from l),
rk as (select id, row_number() over (order by {sql_digest(10, 'id')}, id) - 1 as r, count(*) over () as n from h where not held)
select id as c_custkey, case when r < greatest(1, floor(0.15::double * n)) then 'val' else 'train' end as split from rk
union all select id, 'test' from h where held""")
def _(T):
    return splits.list_fold_split(T.customer, 3, key="c_custkey")


@query("split_leave_one_subject_out", f"""with l as (select c_custkey as id, row_number() over (order by c_custkey) - 1 as pos from customer),
v as (select id from l where pos <> 4 order by {sql_digest(11, 'id')}, id limit 1)
select id as c_custkey, case when pos = 4 then 'test' when id in (select id from v) then 'val' else 'train' end as split from l""")
def _(T):
    return splits.loso_split(T.customer, 4, "c_custkey")


@query("split_explicit_units", """select l_linenumber, split, count(*) as n from (select l_linenumber, case when l_linenumber in (1,3,4,6) then 'train' when l_linenumber = 2 then 'val' when l_linenumber = 5 then 'test' end as split from lineitem) where split is not null group by 1, 2""")
def _(T):
    got = splits.unit_split(T.lineitem, "l_linenumber", {"train": [1, 3, 4, 6], "val": [2], "test": [5]})
    return got.groupBy("l_linenumber", "split").agg(F.count(F.lit(1)).alias("n"))


@query("split_explicit_subjects", """select l_suppkey, case when l_suppkey in (3, 7) then 'val' when l_suppkey in (4, 9) then 'test' else 'train' end as split, count(*) as n from lineitem group by 1, 2""")
def _(T):
    got = splits.unit_split(T.lineitem, "l_suppkey", {"val": [3, 7], "test": [4, 9]}, unlisted="train")
    return got.groupBy("l_suppkey", "split").agg(F.count(F.lit(1)).alias("n"))


@query("split_carve_val", f"""with o as (select o_orderkey, o_custkey, case when o_custkey % 5 = 0 then 'eval' else 'train' end as split from orders),
ids as (select distinct o_custkey as id from o where split = 'train'),
rk as (select id, row_number() over (order by {sql_digest(42, 'id')}, id) - 1 as r, count(*) over () as n from ids),
v as (select id from rk where r < greatest(1, round_even(n * 0.1::double, 0)))
select o_orderkey, case when split = 'train' and o_custkey in (select id from v) then 'val' else split end as split from o""")
def _(T):
    o = T.orders.withColumn("split", F.when(F.col("o_custkey") % 5 == 0, "eval").otherwise("train"))
    return splits.carve_val(o, 0.1, "o_custkey").select("o_orderkey", "split")


_ROLE = """r as (select user_id, event_type as gesture, event_id as sample, case when user_id % 2 = 0 then 'train' else 'test' end as role, case when event_id % 3 = 0 then 'test' else 'train' end as part from events)"""


def _roles(T):
    return T.events.select("user_id", F.col("event_type").alias("gesture"), F.col("event_id").alias("sample"),
                           F.when(F.col("user_id") % 2 == 0, "train").otherwise("test").alias("role"),
                           F.when(F.col("event_id") % 3 == 0, "test").otherwise("train").alias("part"))


@query("split_by_role", f"""with {_ROLE}, t as (select *, row_number() over (partition by user_id, gesture order by sample) as rn from r where role = 'test' and part = 'train')
select user_id, sample, case when part = 'train' then 'train' else 'val' end as split from r where role = 'train'
union all select user_id, sample, case when rn <= 10 then 'train' else 'test' end from t""")
def _(T):
    return splits.role_split(_roles(T)).select("user_id", "sample", "split")


@query("split_modality_mask", f"""with d as (select o_orderkey as window_id, {sql_uniform(5, 'o_orderkey', "'eeg'")} > 0.6 as e, {sql_uniform(5, 'o_orderkey', "'ecg'")} > 0.6 as c, {sql_uniform(5, 'o_orderkey', "'semg'")} > 0.6 as s from orders)
select window_id, e or not (e or c or s) as has_eeg, c as has_ecg, s as has_semg from d""")
def _(T):
    return splits.modality_mask(T.orders.select(F.col("o_orderkey").alias("window_id")), ["eeg", "ecg", "semg"], 0.6, 5)


# -- selection -------------------------------------------------------------------

_LAB = f"""lab as (select event_id as window_id, user_id, (case when event_type = 'click' then 0 when event_type = 'view' then 1 else 2 + (user_id % 4) end)::int as label, {_SPLIT(sql_uniform(42, 'user_id'))} as split from events)"""


def _lab(T):
    label = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2 + F.col("user_id") % 4).cast("int")
    return T.events.select(F.col("event_id").alias("window_id"), "user_id", label.alias("label"), splits.subject_split_expr(F.col("user_id")).alias("split"))


@query("rank_change_flags", f"""with {X.A} select recording_id, t, flag, lag(flag) over (partition by recording_id order by t) as prev_flag from samples_wide""")
def _(T):
    from ..operators.order import previous

    return previous(T.samples_wide.select("recording_id", "t", "flag"), ["recording_id"], "t", {"prev_flag": "flag"}, 100)


@query("rank_ordinal_blocks", f"with {X.A} select recording_id, t, qty from samples_wide")
def _(T):
    return T.samples_wide.select("recording_id", "t", "qty")


@query("rank_head_per_group", f"""with {_ROLE} select user_id, gesture, sample, row_number() over (partition by user_id, gesture order by sample) <= 3 as is_head from r""")
def _(T):
    return rank.head_per_group(_roles(T), ["user_id", "gesture"], ["sample"], 3).select("user_id", "gesture", "sample", "is_head")


@query("rank_cap_rest_class", f"""with {_LAB},
cnt as (select split, label, count(*) as c from lab where label <> 0 group by 1, 2),
cap as (select split, floor(0.5::double * quantile_cont(c, 0.5)) as cap from cnt group by 1),
rr as (select l.*, row_number() over (partition by split order by {sql_digest(42, 'window_id')}, window_id) - 1 as r from lab l where label = 0)
select window_id, label, split from lab where label <> 0
union all select window_id, label, split from rr left join cap using (split) where cap is null or r < cap""")
def _(T):
    return rank.cap_class(_lab(T), 0, 0.5).select("window_id", "label", "split")


@query("rank_cap_per_class", f"""with {_LAB},
rr as (select l.*, row_number() over (partition by split, label order by {sql_digest(42, 'window_id')}, window_id) as r from lab l)
select window_id, label, split from rr where r <= 20""")
def _(T):
    return rank.cap_per_class(_lab(T), 20).select("window_id", "label", "split")


@query("rank_global_shuffle", f"select event_id as window_id, row_number() over (order by {sql_digest(42, 'event_id')}, event_id) - 1 as position from events")
def _(T):
    from ..operators.order import hash_ordinal

    shuffled = rank.shuffle(T.events.select(F.col("event_id").alias("window_id")))
    return hash_ordinal(shuffled, [], H.digest(42, "window_id"), ["window_id"], "position")


_MIX = {"click": 0.4, "view": 0.25, "purchase": 0.2, "signup": 0.1, "error": 0.05}


@query("rank_weighted_sample", f"""with types as (select event_type, count(*) as n from events group by 1),
d as (select event_id as draw_id, {sql_uniform('3:corpus', 'event_id')} as u from events),
c as (select draw_id, case when u < 0.4::double then 'click' when u < 0.65::double then 'view' when u < 0.85::double then 'purchase' when u < 0.95::double then 'signup' else 'error' end as dataset_id from d),
pos as (select c.*, least(floor({sql_uniform('3:item', 'draw_id')} * n), n - 1)::bigint as pos from c join types on event_type = dataset_id),
it as (select event_type as dataset_id, event_id as item_id, row_number() over (partition by event_type order by {sql_digest('3:order', 'event_id')}, event_id) - 1 as pos from events)
select draw_id, dataset_id, item_id from pos join it using (dataset_id, pos)""")
def _(T):
    items = T.events.select(F.col("event_type").alias("dataset_id"), F.col("event_id").alias("item_id"))
    draws = T.events.select(F.col("event_id").alias("draw_id"))
    return rank.weighted_sample(items, draws, _MIX, 3)


@query("rank_runs_by_metric", """with r as (select o_orderkey as run_id, case when o_orderkey % 7 = 0 then 'nan?' else (o_orderkey % 1000)::varchar || '.5' end as metric from orders),
v as (select run_id, metric, try_cast(metric as double) as x from r)
select run_id, metric, row_number() over (order by x desc nulls last, run_id) as place from v""")
def _(T):
    metric = F.when(F.col("o_orderkey") % 7 == 0, "nan?").otherwise(F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit(".5")))
    runs = T.orders.select(F.col("o_orderkey").alias("run_id"), metric.alias("metric"))
    return rank.place_runs(runs, "metric", "run_id").select("run_id", "metric", "place")


_HIST = """h as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) - 1 as epoch, case when event_id % 29 = 0 then null else value end as metric from events)"""


def _hist(T):
    return T.event_samples.select(F.col("recording_id").alias("run_id"), F.col("t").alias("epoch"), F.when(F.col("event_id") % 29 == 0, F.lit(float("nan"))).otherwise(F.col("v")).alias("metric"))


_FOLD = """with recursive {hist},
ok as (select run_id, metric, epoch, row_number() over (partition by run_id order by epoch) as k from h where metric is not null),
step(run_id, k, e, v) as (
  select run_id, k, epoch, metric from ok where k = 1
  union all
  select s.run_id, o.k, case when o.metric > s.v + {delta} then o.epoch else s.e end, case when o.metric > s.v + {delta} then o.metric else s.v end
  from step s join ok o on o.run_id = s.run_id and o.k = s.k + 1)
select run_id, e as best_epoch, v as best_value from step qualify row_number() over (partition by run_id order by k desc) = 1"""


@query("rank_best_epoch", _FOLD.format(hist=_HIST, delta="5.0::double"))
def _(T):
    return rank.best_epoch(_hist(T), "metric", 5.0)


@query("results_best_rows", f"""with {_HIST},
b as (select run_id, max(metric) as m from h group by 1),
f as (select h.run_id, min(h.epoch) as best_epoch from h join b on b.run_id = h.run_id and h.metric = b.m group by 1)
select f.run_id, f.best_epoch, h.metric as val_metric, {sql_rnd('h.metric * 0.5::double')} as test_metric from f join h on h.run_id = f.run_id and h.epoch = f.best_epoch""")
def _(T):
    from ..operators import results

    h = _hist(T)
    history = h.select("run_id", "epoch", F.lit("val").alias("split"), "metric").unionByName(h.select("run_id", "epoch", F.lit("test").alias("split"), (F.col("metric") * 0.5).alias("metric")))
    got = results.best_rows(history, "metric")
    return got.select("run_id", "best_epoch", "val_metric", rnd("test_metric").alias("test_metric"))


@query("rank_pareto_front", """with r as (select o_orderkey as id, o_custkey % 997 as perf, floor(o_totalprice / 100) as cost from orders)
select id, perf, cost from r a where not exists (select 1 from r b where b.perf >= a.perf and b.cost <= a.cost and (b.perf > a.perf or b.cost < a.cost))""")
def _(T):
    r = T.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 997).alias("perf"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("cost"))
    return rank.pareto_front(r, "perf", "cost")


# -- statistics -------------------------------------------------------------------

FILES_SQL = f"""{DATASETS_SQL}, files as (
  select '/corpus/' || {dataset_of_sql('c_custkey')} || '/S' || c_nationkey || '/R' || c_custkey || '.h5' as path, {dataset_of_sql('c_custkey')} as dataset_id, (c_custkey % 6 + 1)::int as n_windows, (1000 + 10 * (c_custkey % 7))::bigint as num_samples, sha1(c_name) as checksum from customer)"""
MANIFEST_SQL = f"""{FILES_SQL}, manifest as (
  select dataset_id, modality, path, regexp_extract(path, '/(S\\d+)/', 1) as subject_id, regexp_extract(path, '([^/]+)\\.h5$', 1) as recording_id, sampling_rate, coalesce(num_channels, 19) as num_channels, num_samples,
    has_coordinates, i::int as index, i * (num_samples / sampling_rate) as window_start, (i + 1) * (num_samples / sampling_rate) as window_end
  from files join datasets using (dataset_id), unnest(range(0, n_windows)) as u(i))"""


def files(T):
    d = dataset_of(F.col("c_custkey"))
    return T.customer.select(
        F.concat(F.lit("/corpus/"), d, F.lit("/S"), "c_nationkey", F.lit("/R"), "c_custkey", F.lit(".h5")).alias("path"),
        d.alias("dataset_id"), (F.col("c_custkey") % 6 + 1).cast("int").alias("n_windows"), (1000 + 10 * (F.col("c_custkey") % 7)).alias("num_samples"),
        F.lit(None).cast("int").alias("num_channels"), F.sha1(F.encode("c_name", "utf-8")).alias("checksum"))


def manifest(T):
    from ..sources.manifest import build_manifest

    return build_manifest(files(T), tables.datasets(T.spark), r"/(S\d+)/", default_channels=19)


@query("manifest_build", f"""with {MANIFEST_SQL} select dataset_id, path, subject_id, recording_id, num_channels, num_samples, index, {sql_rnd('window_start')} as window_start, {sql_rnd('window_end')} as window_end from manifest""")
def _(T):
    return manifest(T).select("dataset_id", "path", "subject_id", "recording_id", "num_channels", "num_samples", "index", rnd("window_start").alias("window_start"), rnd("window_end").alias("window_end"))


@query("manifest_round_trip", f"""with {MANIFEST_SQL} select dataset_id, path, recording_id, num_samples, index, {sql_rnd('window_end')} as window_end from manifest""")
def _(T):
    from ..sources.manifest import read_manifest, write_manifest

    path = scratch(T.spark, "manifest")
    write_manifest(manifest(T), path)
    return read_manifest(T.spark, path).select("dataset_id", "path", "recording_id", "num_samples", "index", rnd("window_end").alias("window_end"))


@query("manifest_statistics", f"""with {MANIFEST_SQL} select count(*) as "count", array_to_string(list_sort(list(distinct dataset_id)), ',') as datasets, array_to_string(list_sort(list(distinct modality)), ',') as modalities, count(distinct subject_id) as num_subjects, count(distinct recording_id) as num_recordings,
  array_to_string(list_sort(list(distinct num_channels)), ',') as channels, array_to_string(list_sort(list(distinct sampling_rate::int)), ',') as sampling_rates, round(sum(window_end - window_start) / 3600.0, 3) as total_hours,
  array_to_string(list_sort(list(distinct dataset_id) filter (not has_coordinates)), ',') as without_coordinates from manifest""")
def _(T):
    s = stats.manifest_stats(manifest(T))
    text = lambda c, t="string": F.array_join(F.col(c).cast(f"array<{t}>").cast("array<string>"), ",").alias(c)
    return s.select("count", text("datasets"), text("modalities"), "num_subjects", "num_recordings", text("channels"), text("sampling_rates", "int"), "total_hours", text("without_coordinates"))


@query("stats_per_file_and_total", f"""with {X.windows_sql(starts=f"range(0, n, {X.STEP})")},
v as (select channel, len(x) as len, unnest(x) as e, start from windows),
r as (select channel, min(len) as min_length, max(len) as max_length, min(e) as lo, max(e) as hi, avg(e) as mean, stddev_pop(e) as std, count(*) as n from v group by rollup(channel)),
c as (select channel, count(*) as n_rows from windows group by rollup(channel))
select r.channel as path, n_rows, min_length::bigint as min_length, max_length::bigint as max_length, lo as "min", hi as "max", {sql_rnd('mean', 4)} as mean, {sql_rnd('std', 4)} as std from r join c on c.channel is not distinct from r.channel""")
def _(T):
    got = stats.dataset_stats(T.windows(tail="all").withColumnRenamed("channel", "path"))
    return got.select("path", "n_rows", "min_length", "max_length", "min", "max", rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"))


@query("stats_class_distribution", f"""select k::int as label, coalesce(n, 0) as n, {sql_rnd('100.0::double * coalesce(n, 0) / (select count(*) from embeddings)')} as percent from unnest(range(0, 12)) as r(k) left join (select label, count(*) as n from embeddings group by 1) on label = k""")
def _(T):
    return stats.class_distribution(T.embedded, 12).select("label", "n", rnd("percent").alias("percent"))


_PAIRS = """pr as (select distinct l_orderkey as record_id, l_linenumber as class_id from lineitem where l_returnflag = 'R')"""


@query("stats_multilabel_distribution", f"""with {_PAIRS} select class_id, count(*) as n, {sql_rnd('100.0::double * count(*) / (select count(*) from orders)')} as percent from pr group by 1""")
def _(T):
    pairs = T.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("class_id")).distinct()
    return stats.multilabel_distribution(pairs, T.orders).select("class_id", "n", rnd("percent").alias("percent"))


@query("stats_multilabel_windows", f"""with {_PAIRS}, w as (select l_orderkey as record_id, l_partkey, l_suppkey, l_quantity from lineitem)
select class_id, count(*) as n, {sql_rnd('100.0::double * count(*) / (select count(*) from lineitem)')} as percent from w join pr using (record_id) group by 1""")
def _(T):
    pairs = T.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("class_id")).distinct()
    w = T.lineitem.select(F.col("l_orderkey").alias("record_id"), "l_partkey")
    return stats.multilabel_distribution(w.join(pairs, "record_id"), w).select("class_id", "n", rnd("percent").alias("percent"))


@query("stats_multilabel_summary", f"""with c as (select o_orderkey, count(distinct case when l_returnflag = 'R' then l_linenumber end) as k from orders left join lineitem on l_orderkey = o_orderkey group by 1)
select count(*) as n_items, {sql_rnd('avg(k)')} as avg_labels, count_if(k = 0)::bigint as no_label, count_if(k > 1)::bigint as multi_label from c""")
def _(T):
    hits = T.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_linenumber").alias("s"))
    hot = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.when(F.array_contains(F.coalesce("s", F.array().cast("array<int>")), k), 1.0).otherwise(0.0))
    got = stats.multilabel_summary(T.orders.join(hits, "o_orderkey", "left").select("o_orderkey", hot.alias("labels")))
    return got.select("n_items", rnd("avg_labels").alias("avg_labels"), "no_label", "multi_label")


@query("stats_skip_accounting", f"""with o as (select {_SPLIT(sql_uniform(42, 'o_custkey'))} as split, (['valid','no_label','leads','read_error'])[(o_orderkey % 4)::int + 1] as reason, o_orderkey % 5 as n_windows from orders)
select split, count_if(reason = 'valid')::bigint as n_valid, count_if(reason = 'no_label')::bigint as n_no_label, count_if(reason = 'leads')::bigint as n_leads, count_if(reason = 'read_error')::bigint as n_read_error, sum(case when reason = 'valid' then n_windows else 0 end)::bigint as total_windows from o group by 1""")
def _(T):
    reasons = ["valid", "no_label", "leads", "read_error"]
    o = T.orders.select(splits.subject_split_expr(F.col("o_custkey")).alias("split"), F.element_at(F.array(*[F.lit(r) for r in reasons]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("reason"), (F.col("o_orderkey") % 5).alias("n_windows"))
    return stats.skip_report(o, reasons)


@query("stats_class_weights", f"""with c as (select k, (select count(*) from embeddings where label = k) as n from unnest(range(0, 12)) as r(k)),
w as (select k, n, case when n > 0 then (select sum(n) from c) / (12.0::double * n) else 0 end as w from c)
select k::int as label, {sql_rnd('w / (select avg(w) from w where n > 0)')} as weight from w""")
def _(T):
    return stats.class_weights(T.embedded, 12).select("label", rnd("weight").alias("weight"))


@query("stats_item_weights", f"""with s as (select event_type, count(*) as n from events group by 1)
select event_id, {sql_rnd("case event_type when 'click' then 0.4::double when 'view' then 0.25::double when 'purchase' then 0.2::double when 'signup' then 0.1::double when 'error' then 0.05::double end / n", 9)} as weight from events join s using (event_type)""")
def _(T):
    mix = stats.mixture_weights({"click": 8.0, "view": 5.0, "purchase": 4.0, "signup": 2.0, "error": 1.0}, list(_MIX))
    return stats.item_weights(T.events, mix, "event_type").select("event_id", rnd("weight", 9).alias("weight"))


_POOL = {
    "mean": "avg(v)", "max": "max(v)", "first": "min_by(v, channel)", "last": "max_by(v, channel)",
}


def _pool_query(how):
    @query(f"stats_pool_{how}", f"with {X.C} select vec_id, t::int as k, {sql_rnd(_POOL[how])} as v from samples4 group by 1, 2")
    def _(T):
        got = stats.pool(T.windows4, how, ["vec_id"], "channel")
        return got.select("vec_id", F.posexplode("x").alias("k", "v")).select("vec_id", "k", rnd("v").alias("v"))


for _h in _POOL:
    _pool_query(_h)


@query("stats_pool_attention", f"""with {X.C}, m as (select vec_id, channel, avg(v) as m from samples4 group by 1, 2), w as (select vec_id, channel, exp(m) / sum(exp(m)) over (partition by vec_id) as w from m)
select vec_id, t::int as k, {sql_rnd('sum(v * w)')} as v from samples4 join w using (vec_id, channel) group by 1, 2""")
def _(T):
    got = stats.pool(T.windows4, "attention", ["vec_id"], "channel")
    return got.select("vec_id", F.posexplode("x").alias("k", "v")).select("vec_id", "k", rnd("v").alias("v"))


@query("stats_channel_mean_masked", f"""with {X.C}, p as (select vec_id, channel, t // 8 as patch, t % 8 as i, v, case when (vec_id + channel) % 3 = 0 or vec_id % 11 = 0 then 0.0 else 1.0 end::double as m from samples4)
select vec_id, patch::int as patch, i::int as i, {sql_rnd('sum(v * m) / greatest(sum(m), 1.0::double)')} as v from p group by 1, 2, 3""")
def _(T):
    good = ~((F.pmod(F.col("vec_id") + F.col("channel"), F.lit(3)) == 0) | (F.col("vec_id") % 11 == 0))
    patches = windowing.patchify(T.windows4.withColumn("good", good), 8)
    return stats.channel_mean(patches, ["vec_id", "patch"]).select("vec_id", "patch", "i", rnd("v").alias("v"))


@query("results_group_mean_std", f"""with {X.H_}, r as (select *, fold = 3 as synthetic from runs)
select variant, count(distinct seed) as n_seeds, bool_or(synthetic) as synthetic, {sql_rnd('avg(test_acc)')} as test_acc, {sql_rnd('stddev_samp(test_acc)')} as test_acc_std, {sql_rnd('avg(cost)', 4)} as cost, {sql_rnd('stddev_samp(cost)', 4)} as cost_std from r group by 1""")
def _(T):
    got = stats.aggregate_results(T.runs.withColumn("synthetic", F.col("fold") == 3), ["variant"], ["test_acc", "cost"])
    return got.select("variant", "n_seeds", "synthetic", rnd("test_acc").alias("test_acc"), rnd("test_acc_std").alias("test_acc_std"), rnd("cost", 4).alias("cost"), rnd("cost_std", 4).alias("cost_std"))


@query("set_union_corpora", f"""with {X.A} select 'lines' as corpus, count(*) as n, {sql_rnd('sum(v)', 2)} as total from samples union all select 'events', count(*), {sql_rnd('sum(value)', 2)} from events""")
def _(T):
    lines = T.samples.select(F.lit("lines").alias("corpus"), "v")
    ev = T.events.select(F.col("value").alias("v"), F.lit("events").alias("corpus"))
    return lines.unionByName(ev).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("v"), 2).alias("total"))


@query("set_distinct_subjects", "select distinct o_custkey as subject_id from orders")
def _(T):
    return T.orders.select(F.col("o_custkey").alias("subject_id")).distinct()
