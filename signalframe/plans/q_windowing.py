"""Layout, windowing and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import layout, normalize, windowing
from . import fixtures as X
from .registry import query, rnd, sql_rnd, sql_uniform

CHECK = ["sum_x", "weighted_x"]


def digest_rows(df, keys):
    """Two numbers that pin down an array: its sum and its position-weighted sum."""
    x = A.doubles(F.col("x"))
    return df.select(
        *keys,
        F.size("x").cast("bigint").alias("len"),
        rnd(A.total(x), 5).alias("sum_x"),
        rnd(A.total(F.transform(x, lambda v, i: v * (i + 1))), 4).alias("weighted_x"),
    )


def digest_sql(src: str, keys: str) -> str:
    return f"""select {keys}, len(x)::bigint as len, {sql_rnd("coalesce(list_sum(x), 0)", 5)} as sum_x,
  {sql_rnd("coalesce(list_sum(list_transform(x, lambda v, i: v * i)), 0)", 4)} as weighted_x from {src}"""


@query("layout_to_signals", f"""with {X.A},
framed as (select recording_id, channel, (t // 256) * 256 as t0, list(v order by t) as x from samples group by 1, 2, 3)
{digest_sql('framed', 'recording_id, channel, t0')}""")
def _(T):
    return digest_rows(T.signals(256, 0), ["recording_id", "channel", "t0"])


@query("layout_to_samples", f"""with {X.A} select recording_id, channel, t, {sql_rnd('v')} as v from samples""")
def _(T):
    return layout.to_samples(T.signals(128, 32)).select("recording_id", "channel", "t", rnd("v").alias("v"))


@query("layout_nan_to_zero", f"""with {X.A},
holed as (select recording_id, channel, t // 256 as frame, t, case when (t * 7 + recording_id) % 11 = 0 then 0.0::double else v end as v from samples),
framed as (select recording_id, channel, frame * 256 as t0, list(v order by t) as x from holed group by all)
{digest_sql('framed', 'recording_id, channel, t0')}""")
def _(T):
    hole = F.pmod(F.col("t") * 7 + F.col("recording_id"), F.lit(11)) == 0
    holed = T.samples.withColumn("v", F.when(hole, F.lit(float("nan"))).otherwise(F.col("v")))
    return digest_rows(layout.nan_to_zero(layout.to_signals(holed, 256)), ["recording_id", "channel", "t0"])


W, S = X.WINDOW, X.STEP
_full = f"case when n >= {W} then range(0, n - {W} + 1, {S}) else []::bigint[] end"
_last = f"((n - {W}) // {S}) * {S}"
STARTS = {
    "drop": _full,
    "floor": f"list_concat({_full}, case when n % {S} <> 0 then [(n // {S}) * {S}] else []::bigint[] end)",
    "all": f"range(0, n, {S})",
    "keep": f"case when n < {W} then [0::bigint] when {_last} + {W} < n and {_last} + {S} < n then list_concat({_full}, [{_last} + {S}]) else {_full} end",
    "next": f"case when n < {W} then [0::bigint] when {_last} + {S} < n then list_concat({_full}, [{_last} + {S}]) else {_full} end",
}


def _tail_query(tail):
    sql = f"""with {X.windows_sql(starts=STARTS[tail])}
{digest_sql('windows', 'recording_id, channel, start, n_pad::bigint as n_pad')}"""

    @query(f"windows_tail_{tail}", sql)
    def _(T):
        w = T.windows(tail=tail).withColumn("n_pad", F.col("n_pad").cast("bigint"))
        return digest_rows(w, ["recording_id", "channel", "start", "n_pad"])


for _tail in windowing.TAILS:
    _tail_query(_tail)

SEGMENTS = f"""{X.A},
marked as (select recording_id, t, flag, status, case when t > 0 and lag(flag) over w = flag and lag(status) over w = status then 0 else 1 end as brk
  from samples_wide window w as (partition by recording_id order by t)),
grouped as (select *, sum(brk) over (partition by recording_id order by t rows unbounded preceding) - 1 as segment from marked),
segs as (select recording_id, segment::bigint as segment, min(t) as start, max(t) + 1 as stop, any_value(flag) as flag, any_value(status) as status from grouped group by 1, 2)"""


@query("segments_run_length", f"with {SEGMENTS} select * from segs")
def _(T):
    return windowing.segments(T.samples_wide, ["flag", "status"], block=128)


@query("segments_windows", f"""with {SEGMENTS},
picked as (select *, case when flag = 'A' then 'train' when flag = 'N' then 'val' else 'test' end as split from segs where not (flag = 'R' and status = 'O')),
starts as (select recording_id, split, flag, unnest(range(start, stop - 4 + 1, 2)) as start from picked where stop - start >= 4),
cutw as (select s.recording_id, s.split, s.flag, s.start, p.channel, list(p.v order by p.t) as x
  from starts s join samples p on p.recording_id = s.recording_id and p.t >= s.start and p.t < s.start + 4 group by 1, 2, 3, 4, 5)
{digest_sql('cutw', 'recording_id, split, flag, start, channel')}""")
def _(T):
    segs = windowing.segments(T.samples_wide, ["flag", "status"], block=128)
    split = F.when(F.col("flag") == "A", "train").when(F.col("flag") == "N", "val").otherwise("test")
    picked = segs.filter(~((F.col("flag") == "R") & (F.col("status") == "O"))).select(
        "recording_id", split.alias("split"), "flag", "start", "stop"
    )
    cut = windowing.segment_windows(T.samples_wide, picked, 4, 2, channels=X.CHANNELS)
    return digest_rows(cut, ["recording_id", "split", "flag", "start", "channel"])


EVENT_CLOCK = f"""{X.B}, {X.E},
clocked as (select recording_id, event_id, epoch(ts) - epoch(timestamp '2024-01-01') as sec, v from event_samples)"""


def event_clock(T):
    sec = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)") / 1e6
    return T.events.select(F.col("user_id").alias("recording_id"), "event_id", sec.alias("sec"), F.col("value").alias("v"))


@query("join_interval_label", f"""with {EVENT_CLOCK},
hours as (select recording_id, o_orderkey, onset, 86400.0::double * 3 as duration, code from annotations)
select c.recording_id, c.event_id, h.o_orderkey, h.code from clocked c join hours h
on c.recording_id = h.recording_id and c.sec >= h.onset and c.sec < h.onset + h.duration""")
def _(T):
    wide = T.annotations.withColumn("duration", F.lit(86400.0 * 3))
    got = windowing.interval_label(event_clock(T), wide, at="sec", bin_width=86400.0)
    return got.select("recording_id", "event_id", "o_orderkey", "code")


EPOCH_EVENTS = f"""{X.A},
ev as (select recording_id, t as event_t, min(flag) as code from samples_wide where qty >= 49 group by 1, 2)"""


@query("join_epochs", f"""with {EPOCH_EVENTS},
hit as (select e.recording_id, e.event_t, e.code, s.channel, list(s.v order by s.t) as x
  from ev e join samples s on s.recording_id = e.recording_id and s.t between e.event_t - 2 and e.event_t + 6
  group by 1, 2, 3, 4 having count(*) = 9)
{digest_sql('hit', 'recording_id, event_t, code, channel')}""")
def _(T):
    ev = T.samples_wide.filter(F.col("qty") >= 49).select("recording_id", F.col("t").alias("event_t"), F.col("flag").alias("code"))
    got = windowing.epochs(T.samples_wide, ev, tmin=-0.2, tmax=0.6, fs=10.0, channels=X.CHANNELS)
    return digest_rows(got, ["recording_id", "event_t", "code", "channel"])


@query("epochs_crop_first", f"""with {EPOCH_EVENTS},
doubled as (select recording_id, event_t, code from ev union all select recording_id, event_t, code || 'x' from ev),
once as (select recording_id, event_t, min(code) as code from doubled group by 1, 2),
hit as (select e.recording_id, e.event_t, e.code, s.channel, (list(s.v order by s.t))[1:5] as x
  from once e join samples s on s.recording_id = e.recording_id and s.t between e.event_t and e.event_t + 7
  group by 1, 2, 3, 4 having count(*) = 8)
{digest_sql('hit', 'recording_id, event_t, code, channel')}""")
def _(T):
    ev = T.samples_wide.filter(F.col("qty") >= 49).select("recording_id", F.col("t").alias("event_t"), F.col("flag").alias("code"))
    twice = ev.unionByName(ev.withColumn("code", F.concat("code", F.lit("x"))))
    got = windowing.epochs(T.samples_wide, twice, tmin=0.0, tmax=0.7, fs=10.0, n=5, channels=X.CHANNELS)
    return digest_rows(got, ["recording_id", "event_t", "code", "channel"])


@query("windows_inside_annotations", f"""with {X.E},
varied as (select recording_id, o_orderkey, onset, duration + (o_orderkey % 7) * 100.0 as duration, code from annotations),
k as (select *, floor(duration / 250.0)::int as n from varied),
starts as (select recording_id, o_orderkey, code, unnest(list_concat(list_transform(range(0, n), lambda i: onset + i * 250.0::double),
  case when duration - n * 250.0 > 0 then [onset + duration - 250.0::double] else []::double[] end)) as start from k where n >= 1)
select recording_id, o_orderkey, code, start from starts""")
def _(T):
    varied = T.annotations.withColumn("duration", F.col("duration") + F.pmod(F.col("o_orderkey"), F.lit(7)) * 100.0)
    return windowing.annotation_windows(varied, 250.0).select("recording_id", "o_orderkey", "code", "start")


@query("annotations_crop_wake", f"""with {X.E},
span as (select recording_id, min(case when code <> 'O' then onset end) as lo, max(case when code <> 'O' then onset + duration end) as hi from annotations group by 1)
select a.recording_id, a.o_orderkey, a.code, greatest(a.onset, lo - 1800.0) as onset,
  least(a.onset + a.duration, hi + 1800.0) - greatest(a.onset, lo - 1800.0) as duration
from annotations a join span using (recording_id)
where a.onset + a.duration > lo - 1800.0 and a.onset < hi + 1800.0""")
def _(T):
    got = windowing.crop_wake(T.annotations, 30.0, "O")
    return got.select("recording_id", "o_orderkey", "code", "onset", "duration")


def _fit_sql(start):
    return f"""with {X.windows_sql(40, 40, "range(0, n, 40)")},
short as (select *, x[1:40 - n_pad] as y from windows),
placed as (select *, {start} as s0 from short),
fitted as (select recording_id, channel, start, list_concat(y[s0+1:s0+32], list_transform(range(0, greatest(32 - len(y), 0)), lambda i: 0.0::double)) as x from placed)
{digest_sql('fitted', 'recording_id, channel, start')}"""


def _ragged(T):
    w = T.windows(40, 40, "all")
    return w.withColumn("x", F.slice(F.col("x"), 1, 40 - F.col("n_pad")))


@query("windows_adjust_length", f"""with {X.windows_sql(40, 40, "range(0, n, 40)")},
short as (select *, x[1:40 - n_pad] as y from windows),
fitted as (select recording_id, channel, start, list_concat(y[1:32], list_transform(range(0, greatest(32 - len(y), 0)), lambda i: 0.0::double)) as x from short)
{digest_sql('fitted', 'recording_id, channel, start')}""")
def _(T):
    return digest_rows(windowing.adjust_length(_ragged(T), 32), ["recording_id", "channel", "start"])


@query("windows_fit_center", _fit_sql("greatest(len(y) - 32, 0) // 2"))
def _(T):
    return digest_rows(windowing.fit_length(_ragged(T), 32), ["recording_id", "channel", "start"])


@query("windows_fit_random", _fit_sql(
    f"least(floor({sql_uniform(3, 'window_id', 'channel')} * (greatest(len(y) - 32, 0) + 1))::int, greatest(len(y) - 32, 0))"))
def _(T):
    got = windowing.fit_length(_ragged(T), 32, "random", 3, ("window_id", "channel"))
    return digest_rows(got, ["recording_id", "channel", "start"])


@query("windows_patchify", f"""with {X.windows_sql()},
patches as (select recording_id, channel, start, p::int as patch, x[p*16+1:p*16+16] as x from windows, unnest(range(0, 4)) as u(p))
{digest_sql('patches', 'recording_id, channel, start, patch')}""")
def _(T):
    return digest_rows(windowing.patchify(T.windows(), 16, 2), ["recording_id", "channel", "start", "patch"])


@query("windows_limit_per_recording", f"""with {X.windows_sql()},
ranked as (select *, row_number() over (partition by recording_id, channel order by start) as rn from windows)
{digest_sql('ranked', 'recording_id, channel, start')} where rn <= 3""")
def _(T):
    got = windowing.limit_per_recording(T.windows(), 3, ["recording_id", "channel"])
    return digest_rows(got, ["recording_id", "channel", "start"])


# -- normalisation ----------------------------------------------------------

_sd = "list_stddev_pop(x)"
ZRULES = {
    "add": f"{_sd} + 1e-8::double",
    "floor": f"greatest({_sd}, 1e-8::double)",
    "one": f"case when {_sd} = 0 then 1.0::double else {_sd} end",
    "sample": "list_stddev_samp(x) + 1e-12::double",
}


def _mapped_sql(expr, stats, tail="all"):
    return f"""with {X.windows_sql(starts=STARTS[tail])},
st as (select *, {stats} from windows),
mapped as (select recording_id, channel, start, list_transform(x, lambda v: {expr}) as x from st)
{digest_sql('mapped', 'recording_id, channel, start')}"""


def _zscore_query(mode):
    @query(f"normalize_zscore_{mode}", _mapped_sql("(v - m) / s", f"list_avg(x) as m, {ZRULES[mode]} as s"))
    def _(T):
        got = normalize.zscore(T.windows(tail="all"), mode)
        return digest_rows(got, ["recording_id", "channel", "start"])


for _m in ZRULES:
    _zscore_query(_m)


@query("normalize_minmax_zero", _mapped_sql(
    "case when hi = lo then 0.0::double else 2.0::double * (v - lo) / (hi - lo) - 1.0::double end", "list_min(x) as lo, list_max(x) as hi"))
def _(T):
    return digest_rows(normalize.minmax(T.windows(tail="all"), "zero"), ["recording_id", "channel", "start"])


@query("normalize_minmax_floor", _mapped_sql(
    "2.0::double * (v - lo) / greatest(hi - lo, 1e-8::double) - 1.0::double", "list_min(x) as lo, list_max(x) as hi"))
def _(T):
    return digest_rows(normalize.minmax(T.windows(tail="all"), "floor"), ["recording_id", "channel", "start"])


@query("normalize_maxabs", _mapped_sql(
    "v / case when p = 0 then 1.0::double else p end", "list_max(list_transform(x, lambda v: abs(v))) as p"))
def _(T):
    return digest_rows(normalize.maxabs(T.windows(tail="all")), ["recording_id", "channel", "start"])


@query("normalize_maxabs_floor", _mapped_sql(
    "v / greatest(p, 1e-8::double)", "list_max(list_transform(x, lambda v: abs(v))) as p"))
def _(T):
    return digest_rows(normalize.maxabs(T.windows(tail="all"), "floor"), ["recording_id", "channel", "start"])


@query("normalize_fixed_scale", _mapped_sql("v * 0.0078125::double", "1 as one"))
def _(T):
    return digest_rows(normalize.scale(T.windows(tail="all"), 1 / 128), ["recording_id", "channel", "start"])


@query("normalize_sigma_clip", _mapped_sql(
    "greatest(least((v - m) / s, 1.5::double), -1.5::double)", f"list_avg(x) as m, {ZRULES['floor']} as s"))
def _(T):
    got = normalize.normalise(T.windows(tail="all"), "zscore", 1.5)
    return digest_rows(got, ["recording_id", "channel", "start"])


@query("normalize_recording_scope", f"""with {X.A},
st as (select recording_id, channel, avg(v) as m, greatest(stddev_pop(v), 1e-8::double) as s from samples group by 1, 2)
select recording_id, channel, t, {sql_rnd('(v - m) / s', 5)} as z from samples join st using (recording_id, channel)""")
def _(T):
    got = layout.to_samples(normalize.scoped_zscore(T.signals(256, 0)))
    return got.select("recording_id", "channel", "t", rnd("v", 5).alias("z"))


@query("normalize_run_scope", f"""with {X.A},
runs as (select *, t // 100 as run from samples),
st as (select recording_id, run, channel, avg(v) as m, stddev_pop(v) as sd from runs group by 1, 2, 3)
select recording_id, channel, run, t, {sql_rnd('(v - m) / case when sd = 0 then 1.0::double else sd end', 5)} as z from runs join st using (recording_id, run, channel)""")
def _(T):
    runs = T.samples_wide.withColumn("run", F.floor(F.col("t") / 100)).withColumn("t", F.col("t") - F.col("run") * 100)
    keys = ["recording_id", "run"]
    z = normalize.scoped_zscore(layout.to_signals(runs, 64, 0, keys, X.CHANNELS), keys, "one")
    got = layout.to_samples(z, [*keys, "channel"])
    return got.select("recording_id", "channel", "run", (F.col("t") + F.col("run") * 100).alias("t"), rnd("v", 5).alias("z"))


@query("normalize_pad_then_stats", f"""with {X.windows_sql(starts=STARTS['floor'])},
st as (select recording_id, channel, start, n_pad, x, list_avg(x) as m, list_stddev_pop(x) + 1e-8::double as s from windows),
before as (select recording_id, channel, start, n_pad::bigint as n_pad, list_transform(x, lambda v: (v - m) / s) as x from st)
{digest_sql('before', 'recording_id, channel, start, n_pad')}""")
def _(T):
    padded = T.windows(tail="floor").withColumn("n_pad", F.col("n_pad").cast("bigint"))
    return digest_rows(normalize.zscore(padded, "add"), ["recording_id", "channel", "start", "n_pad"])


@query("normalize_stats_then_pad", f"""with {X.A},
st as (select recording_id, channel, avg(v) as m, stddev_pop(v) + 1e-8::double as s from samples group by 1, 2),
z as (select recording_id, channel, list((v - m) / s order by t) as x, count(*) as n from samples join st using (recording_id, channel) group by 1, 2),
cuts as (select *, unnest({STARTS['next']}) as start from z),
padded as (select recording_id, channel, start, list_concat(x[start+1:start+{W}], list_transform(range(0, greatest(start+{W}-n, 0)), lambda i: 0.0::double)) as x from cuts)
{digest_sql('padded', 'recording_id, channel, start')}""")
def _(T):
    z = normalize.scoped_zscore(T.signals(256, W - S), eps_mode="add")
    cut = windowing.windows(z, W, S, "next")
    return digest_rows(cut, ["recording_id", "channel", "start"])
