"""Label mapping, channel selection and metadata queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import electrodes, tables
from ..operators import channels, labels
from . import fixtures as X
from .registry import query, rnd, sql_case, sql_rnd, sql_values

# -- diagnosis codes: an order is a record, its parts are its codes ----------

CODES = [c for v in tables.NINE_CLASS_CODES.values() for c in v] + ["111", "222", "333"]
RHYTHM = [c for v in tables.FOUR_CLASS_CODES.values() for c in v] + [a for v in tables.FOUR_CLASS_ACRONYMS.values() for a in v] + ["999"]


def _codes(T, values):
    code = F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("l_partkey"), F.lit(len(values))) + 1).cast("int"))
    return T.lineitem.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_set(code).alias("codes"))


def _codes_sql(values):
    arr = "[" + ",".join(f"'{v}'" for v in values) + "]"
    return f"rec as (select distinct l_orderkey as record_id, {arr}[(l_partkey % {len(values)})::int + 1] as code from lineitem)"


def _dict_rows(mapping):
    return [(c, i) for i, cs in enumerate(mapping.values()) for c in cs]


def _hot_sql(k):
    return "concat(" + ", ".join(f"max(case when class_id = {c} then '1' else '0' end)" for c in range(k)) + ")"


def _hot_text(k):
    return F.concat(*[F.when(F.get(F.col("labels"), F.lit(i)) > 0, "1").otherwise("0") for i in range(k)])


@query("labels_multi_hot_codes", f"""with {_codes_sql(CODES)}, {sql_values('d', ['code', 'class_id'], _dict_rows(tables.NINE_CLASS_CODES))}
select record_id, {_hot_sql(9)} as labels from rec join d using (code) group by 1""")
def _(T):
    got = labels.multi_hot(_codes(T, CODES), tables.dictionary(T.spark, tables.NINE_CLASS_CODES), 9)
    return got.select("record_id", _hot_text(9).alias("labels"))


@query("labels_multi_hot_aliases", f"""with {_codes_sql(RHYTHM)},
{sql_values('d', ['code', 'class_id'], _dict_rows(tables.FOUR_CLASS_CODES) + _dict_rows(tables.FOUR_CLASS_ACRONYMS))}
select record_id, {_hot_sql(4)} as labels from rec join d using (code) group by 1""")
def _(T):
    got = labels.multi_hot(
        _codes(T, RHYTHM), tables.dictionary(T.spark, tables.FOUR_CLASS_CODES), 4,
        tables.dictionary(T.spark, tables.FOUR_CLASS_ACRONYMS),
    )
    return got.select("record_id", _hot_text(4).alias("labels"))


_CLASSES = ["NORM", "MI", "STTC", "CD", "HYP", "OTHER"]


@query("labels_priority_superclass", f"""with lk as (
  select l_orderkey as record_id, p.p_type as code, max(l_quantity * 2) as likelihood from lineitem l join part p on p.p_partkey = l.l_partkey group by 1, 2),
types as (select p_type as code, (['NORM','MI','STTC','CD','HYP','OTHER'])[((row_number() over (order by p_type) - 1) % 6)::int + 1] as diagnostic_class from (select distinct p_type from part))
select record_id, max({sql_case('diagnostic_class', tables.SUPERCLASS_PRIORITY)}) as label
from lk join types using (code) where likelihood >= 80 group by 1 having max({sql_case('diagnostic_class', tables.SUPERCLASS_PRIORITY)}) is not null""")
def _(T):
    coded = T.lineitem.join(T.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "p_type").agg(F.max(F.col("l_quantity") * 2).alias("lk"))
    text = F.concat(F.lit("{"), F.concat_ws(", ", F.collect_list(F.concat(F.lit("'"), "p_type", F.lit("': "), F.col("lk").cast("string")))), F.lit("}"))
    records = coded.groupBy(F.col("l_orderkey").alias("record_id")).agg(text.alias("scp")).select("record_id", labels.parse_codes(F.col("scp")).alias("codes"))
    from pyspark.sql import Window as W

    kinds = T.part.select(F.col("p_type").alias("code")).distinct()
    klass = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), ((F.row_number().over(W.orderBy("code")) - 1) % 6 + 1).cast("int"))
    return labels.priority_label(records, kinds.withColumn("diagnostic_class", klass), tables.SUPERCLASS_PRIORITY)


_GEST = ["noGesture", "waveIn", "waveOut", "pinch", "open", "fist", "notProvided", "scribble"]


@query("labels_map_invalid_dropped", f"""with g as (select o_orderkey, (['{"','".join(_GEST)}'])[(o_custkey % 8)::int + 1] as name from orders)
select o_orderkey, coalesce({sql_case('name', tables.GESTURES)}, 6) as label from g where coalesce({sql_case('name', tables.GESTURES)}, 6) <> 6""")
def _(T):
    name = F.element_at(F.array(*[F.lit(g) for g in _GEST]), (F.col("o_custkey") % 8 + 1).cast("int"))
    got = labels.map_label(T.orders.select("o_orderkey", name.alias("name")), "name", tables.GESTURES, invalid=tables.INVALID_GESTURE)
    return got.select("o_orderkey", "label")


_STAGE = list(tables.SLEEP_STAGES) + ["Movement time", "Sleep stage ?"]


@query("labels_stage_merge", f"""with g as (select o_orderkey, (['{"','".join(_STAGE)}'])[(o_custkey % 8)::int + 1] as stage from orders)
select o_orderkey, {sql_case('stage', tables.SLEEP_STAGES)} as label from g where {sql_case('stage', tables.SLEEP_STAGES)} is not null""")
def _(T):
    name = F.element_at(F.array(*[F.lit(g) for g in _STAGE]), (F.col("o_custkey") % 8 + 1).cast("int"))
    return labels.map_label(T.orders.select("o_orderkey", name.alias("stage")), "stage", tables.SLEEP_STAGES).select("o_orderkey", "label")


OFFSETS, MOVEMENTS = {1: 0, 2: 12, 3: 29}, {1: 12, 2: 17, 3: 23}
_RAW = "select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, (l_suppkey % 3 + 1)::int as exercise, (l_partkey % (10 + 5 * (l_suppkey % 3 + 1)))::int as raw from lineitem"


def _raw(T):
    ex = (F.col("l_suppkey") % 3 + 1).cast("int")
    return T.lineitem.select("l_suppkey", "l_partkey", ex.alias("exercise"), (F.col("l_partkey") % (10 + 5 * ex)).cast("int").alias("raw"))


@query("labels_exercise_offset", f"""with r as ({_RAW}),
lab as (select l_suppkey, case when raw = 0 then 0 else raw + {sql_case('exercise', OFFSETS)} end as label from r)
select l_suppkey, label, count(*) as n from lab group by 1, 2""")
def _(T):
    return labels.offset_label(_raw(T), OFFSETS).groupBy("l_suppkey", "label").agg(F.count(F.lit(1)).alias("n"))


@query("labels_exercise_consistency", f"""with r as ({_RAW}),
m as (select l_suppkey, exercise, max(raw) as seen, {sql_case('exercise', MOVEMENTS)} as expected from r group by 1, 2)
select *, seen <> expected as mismatch from m""")
def _(T):
    return labels.check_offsets(_raw(T), MOVEMENTS, ["l_suppkey"])


@query("labels_distinct_count_check", f"""with r as ({_RAW}),
c as (select l_suppkey, count(distinct case when raw <> 0 then raw end) as distinct_labels from r group by 1)
select *, distinct_labels <> 14 as mismatch from c""")
def _(T):
    return labels.check_label_count(_raw(T), 14, ["l_suppkey"], "raw")


_PATHS = "select o_orderkey, '/edf/' || (['train','eval','Test','dev'])[(o_orderkey % 4)::int + 1] || '/' || (['normal','Abnormal','other','normal/abnormal'])[(o_custkey % 4)::int + 1] || '/s' || o_custkey || '_t' || o_orderkey || '.edf' as path from orders"


def _paths(T):
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(c) % 4 + 1).cast("int"))
    return T.orders.select("o_orderkey", F.concat(
        F.lit("/edf/"), pick(["train", "eval", "Test", "dev"], "o_orderkey"), F.lit("/"),
        pick(["normal", "Abnormal", "other", "normal/abnormal"], "o_custkey"),
        F.lit("/s"), F.col("o_custkey"), F.lit("_t"), F.col("o_orderkey"), F.lit(".edf")).alias("path"))


@query("labels_from_path", f"""with p as ({_PATHS}),
c as (select *, string_split(lower(path), '/') as parts from p)
select o_orderkey,
  case when list_contains(parts, 'normal') and not list_contains(parts, 'abnormal') then 0
       when list_contains(parts, 'abnormal') and not list_contains(parts, 'normal') then 1 else -1 end as label,
  case when list_contains(parts, 'eval') or list_contains(parts, 'test') then 'eval' when list_contains(parts, 'train') then 'train' end as split
from c""")
def _(T):
    return _paths(T).select(
        "o_orderkey",
        labels.path_label(F.col("path"), {"normal": 0, "abnormal": 1}).alias("label"),
        labels.path_split(F.col("path")).alias("split"),
    )


_CODE = """select user_id as run_id, event_id,
  case when event_id % 53 = 0 and user_id % 3 <> 0 then '#Tgt' || upper(substr(sha256(user_id::varchar), 1, 1)) || '_R01' when event_id % 71 = 0 then '#end'
       else upper(substr(sha256(event_id::varchar), 1, 6)) end as code from events"""


@query("labels_target_flash", f"""with ev as ({_CODE}),
tg as (select run_id, min(case when starts_with(code, '#Tgt') then substr(code, 5, 1) end) as target from ev group by 1)
select run_id, event_id, case when contains(code, target) then 1 else 0 end as label from ev join tg using (run_id)
where target is not null and not starts_with(code, '#')""")
def _(T):
    e = T.events
    head = lambda c, n: F.upper(F.substring(F.sha2(F.col(c).cast("string"), 256), 1, n))
    code = (
        F.when((F.col("event_id") % 53 == 0) & (F.col("user_id") % 3 != 0), F.concat(F.lit("#Tgt"), head("user_id", 1), F.lit("_R01")))
        .when(F.col("event_id") % 71 == 0, "#end").otherwise(head("event_id", 6))
    )
    ev = e.select(F.col("user_id").alias("run_id"), "event_id", code.alias("code"))
    return labels.target_label(ev).select("run_id", "event_id", "label")


@query("labels_contiguous_remap", f"""with r as ({_RAW}),
lab as (select l_suppkey, case when raw = 0 then 0 else raw + {sql_case('exercise', OFFSETS)} end * 3 as label from r),
d as (select label, (row_number() over (order by label) - 1)::int as class_id from (select distinct label from lab))
select l_suppkey, label, class_id, count(*) as n from lab join d using (label) group by 1, 2, 3""")
def _(T):
    lab = labels.offset_label(_raw(T), OFFSETS).withColumn("label", F.col("label") * 3)
    return labels.contiguous_labels(lab).groupBy("l_suppkey", "label", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query("join_record_label_to_windows", f"""with {X.windows_sql()},
rec as (select s_suppkey as recording_id, s_nationkey % 5 as label from supplier)
select w.recording_id, w.channel, w.start, r.label from windows w join rec r using (recording_id)""")
def _(T):
    rec = T.supplier.select(F.col("s_suppkey").alias("recording_id"), (F.col("s_nationkey") % 5).alias("label"))
    return labels.lookup(T.windows(), rec, "recording_id", "inner").select("recording_id", "channel", "start", "label")


@query("join_dictionary_forms", """select 'inner' as form, count(*) as n from supplier s join nation n on n.n_nationkey = s.s_nationkey and n.n_regionkey < 3
union all select 'left', count(n.n_name) from supplier s left join nation n on n.n_nationkey = s.s_nationkey and n.n_regionkey < 3
union all select 'semi', count(*) from supplier s where exists (select 1 from nation n where n.n_nationkey = s.s_nationkey and n.n_regionkey < 3)
union all select 'anti', count(*) from supplier s where not exists (select 1 from nation n where n.n_nationkey = s.s_nationkey and n.n_regionkey < 3)""")
def _(T):
    codes = T.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    forms = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}
    out = None
    for form, how in forms.items():
        joined = labels.lookup(T.supplier, codes, "s_nationkey", how)
        n = F.count("n_name") if form == "left" else F.count(F.lit(1))
        part = joined.agg(F.lit(form).alias("form"), n.alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# -- channels ------------------------------------------------------------------

RAW_NAMES = ["EEG FP1-REF", "fp2-LE", " F7 ", "T3", "EEG T4-REF", "cz-AVG", "EEG CZ-REF", "O1-A2", "Foo", "EEGPz", "EEG  P8-M1-ref", "iz", "t5-le", "EKG1", ""]


def _raw_names(T):
    name = F.element_at(F.array(*[F.lit(n) for n in RAW_NAMES]), (F.pmod(F.col("l_partkey"), F.lit(len(RAW_NAMES))) + 1).cast("int"))
    return T.lineitem.groupBy(F.col("l_orderkey").alias("recording_id"), name.alias("raw_name")).agg(F.min("l_partkey").alias("idx"))


_RAW_NAMES_SQL = f"""rawc as (select l_orderkey as recording_id, (['{"','".join(RAW_NAMES)}'])[(l_partkey % {len(RAW_NAMES)})::int + 1] as raw_name, min(l_partkey) as idx
  from lineitem group by 1, 2)"""


def _canon_sql(col):
    e = f"trim({col})"
    for s in electrodes.NAME_SUFFIXES:
        e = f"regexp_replace({e}, '{s}$', '', 'i')"
    return f"trim(replace(replace({e}, 'EEG ', ''), 'EEG', ''))"


_CANON = f"""{_RAW_NAMES_SQL}, cleaned as (select *, {_canon_sql('raw_name')} as clean from rawc),
{sql_values('names', ['spelling', 'name'], list(electrodes.name_map().items()))},
named as (select recording_id, idx, raw_name, coalesce(n.name, clean) as channel from cleaned c left join names n on n.spelling = upper(c.clean))"""


@query("channels_canonical_name", f"with {_CANON} select raw_name, channel, count(*) as n, sum(idx)::bigint as s from named group by 1, 2")
def _(T):
    named = _raw_names(T).withColumn("channel", electrodes.canonical_name(F.col("raw_name")))
    return named.groupBy("raw_name", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("s"))


_TEMPLATE = ["Fp1", "Cz", "P8"]


@query("channels_align_montage", f"""with {_CANON},
pos as (select *, {sql_case('channel', {n: i for i, n in enumerate(_TEMPLATE)})} as pos from named),
firsts as (select *, row_number() over (partition by recording_id, channel order by idx) as rn from pos where pos is not null),
one as (select * from firsts where rn = 1),
good as (select recording_id from one group by 1 having count(*) >= 2)
select recording_id, pos, channel, raw_name, idx from one join good using (recording_id)""")
def _(T):
    got = channels.align_montage(_raw_names(T), _TEMPLATE, min_fraction=2 / 3)
    return got.select("recording_id", "pos", "channel", "raw_name", "idx")


@query("channels_required_check", f"""with {_CANON},
fsd as (select recording_id, channel, case when recording_id % 10 = 0 then 100.0 else 256.0 end::double as fs from named),
grid as (select r.recording_id, r.fs, w.channel from (select distinct recording_id, fs from fsd) r, (values ('Fp1'), ('Cz')) w(channel)),
cnt as (select g.recording_id, g.fs, g.channel, count(f.channel) as n from grid g left join fsd f on f.recording_id = g.recording_id and f.channel = g.channel group by 1, 2, 3)
select recording_id, channel, n, case when fs <> 256 then 'rate' when n = 0 then 'absent' else 'duplicate' end as problem from cnt where fs <> 256 or n <> 1""")
def _(T):
    named = _raw_names(T).withColumn("channel", electrodes.canonical_name(F.col("raw_name")))
    fs = F.when(F.col("recording_id") % 10 == 0, 100.0).otherwise(256.0)
    got = channels.require_channels(named.withColumn("fs", fs), ["Fp1", "Cz"], 256.0)
    return got.select("recording_id", "channel", "n", "problem")


@query("channels_first_occurrence", f"""with {_CANON},
r as (select *, row_number() over (partition by recording_id, channel order by idx) as rn from named)
select recording_id, channel, raw_name, idx from r where rn = 1""")
def _(T):
    from ..operators import rank

    named = _raw_names(T).withColumn("channel", electrodes.canonical_name(F.col("raw_name")))
    return rank.first_occurrence(named, ["recording_id", "channel"], ["idx"]).select("recording_id", "channel", "raw_name", "idx")


_LIVE = f"""{X.A},
flatd as (select 'f' || lpad(recording_id::varchar, 9, '0') as path, channel, case when (recording_id + length(channel)) % 4 = 0 or (recording_id < 6 and channel = 'tax') then 3.0::double else v end as v from samples),
spread as (select path, channel, stddev_pop(v) > 1e-12 as live from flatd group by 1, 2),
kept as (select distinct channel from spread where live)"""


@query("channels_live_detection", f"""with {_LIVE}
select path, channel, live, channel in (select channel from kept) as kept,
  case when channel in (select channel from kept) and not live then 'flat' when channel not in (select channel from kept) and live then 'extra' else 'ok' end as flag from spread""")
def _(T):
    rid = F.col("recording_id")
    dead = (F.pmod(rid + F.length("channel"), F.lit(4)) == 0) | ((rid < 6) & (F.col("channel") == "tax"))
    named = T.samples.select(
        F.concat(F.lit("f"), F.lpad(rid.cast("string"), 9, "0")).alias("path"), "channel", F.when(dead, 3.0).otherwise(F.col("v")).alias("v"))
    return channels.live_channels(named)


@query("channels_set_difference", f"""with {_LIVE},
want(channel) as (values ('qty'), ('tax'), ('emg')),
sets as (select path, list_sort(list(channel)) as have from spread where live group by 1)
select path, array_to_string(list_sort(list_distinct(list_concat(have, ['qty','tax','emg']))), ',') as u,
  array_to_string(list_sort(list_filter(have, lambda c: not list_contains(['qty','tax','emg'], c))), ',') as extra from sets""")
def _(T):
    rid = F.col("recording_id")
    dead = (F.pmod(rid + F.length("channel"), F.lit(4)) == 0) | ((rid < 6) & (F.col("channel") == "tax"))
    named = T.samples.select(F.concat(F.lit("f"), F.lpad(rid.cast("string"), 9, "0")).alias("path"), "channel", F.when(dead, 3.0).otherwise(F.col("v")).alias("v"))
    have = named.groupBy("path", "channel").agg(F.stddev_pop("v").alias("s")).filter(F.col("s") > 1e-12).groupBy("path").agg(F.collect_set("channel").alias("h"))
    want = F.array(F.lit("qty"), F.lit("tax"), F.lit("emg"))
    return have.select("path", F.array_join(F.sort_array(F.array_union("h", want)), ",").alias("u"), F.array_join(F.sort_array(F.array_except("h", want)), ",").alias("extra"))


@query("channels_select_by_index", f"""with {X.C}
select vec_id, row_number() over (partition by vec_id order by i)::int - 1 as idx, {sql_rnd('v')} as v from emb where i not in (8, 9) qualify row_number() over (partition by vec_id order by i) <= 48""")
def _(T):
    long = T.embedded.select("vec_id", F.posexplode("x").alias("idx", "v"))
    return channels.select_channels(long, drop=(8, 9), keep=48).select("vec_id", "idx", rnd("v").alias("v"))


_VOC = sql_values("voc", ["channel", "channel_id"], [(n, i) for i, n in enumerate(tables.CHANNEL_VOCABULARY)])


@query("channels_vocabulary_id", f"with {_CANON}, {_VOC} select recording_id, channel, idx, coalesce(channel_id, 1) as channel_id from named left join voc using (channel)")
def _(T):
    named = _raw_names(T).withColumn("channel", electrodes.canonical_name(F.col("raw_name")))
    return channels.channel_id(named).select("recording_id", "channel", "idx", "channel_id")


_CRC = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(channel) + 1), lambda i: ord(substr(channel, i, 1))::bigint)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384::bigint))), 4294967295::bigint)"


@query("channels_hashed_name_slot", f"""with {_CANON}, {sql_values('known', ['channel', 'slot'], [(n, i + 1) for i, n in enumerate(sorted(electrodes.POSITIONS))])},
s as (select raw_name, case when channel = '' then 0 else coalesce(slot, 68 + {_CRC} % (512 - 68)) end::int as slot from named left join known using (channel))
select raw_name, slot, count(*) as n from s group by 1, 2""")
def _(T):
    return _raw_names(T).groupBy("raw_name", electrodes.name_slot(F.col("raw_name")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


_POS = sql_values("pos", ["channel", "x", "y", "z"], [(n, *map(float, p)) for n, p in electrodes.POSITIONS.items()])


@query("channels_template_positions", f"""with {_CANON}, {_POS}
select recording_id, raw_name, channel, {sql_rnd('coalesce(x, 0)')} as x, {sql_rnd('coalesce(y, 0)')} as y, {sql_rnd('coalesce(z, 0)')} as z, x is not null as known from named left join pos using (channel)""")
def _(T):
    got = channels.positions(_raw_names(T))
    return got.select("recording_id", "raw_name", "channel", rnd("x").alias("x"), rnd("y").alias("y"), rnd("z").alias("z"), "known")


_EL = list(electrodes.STANDARD_19)
_PAIRS_SQL = f"""ch as (select distinct l_orderkey as montage_id, l_partkey as channel, (['{"','".join(_EL)}'])[(l_partkey % 19)::int + 1] as positive, (['{"','".join(_EL)}'])[((l_partkey // 19 + l_partkey) % 19)::int + 1] as negative from lineitem), {_POS},
u as (select channel, x / greatest(sqrt(x*x+y*y+z*z), 1e-8) as x, y / greatest(sqrt(x*x+y*y+z*z), 1e-8) as y, z / greatest(sqrt(x*x+y*y+z*z), 1e-8) as z from pos),
g as (select ch.*, 0.5*(p.x+n.x) as mx, 0.5*(p.y+n.y) as my, 0.5*(p.z+n.z) as mz, p.x-n.x as dx, p.y-n.y as dy, p.z-n.z as dz from ch join u p on p.channel = ch.positive join u n on n.channel = ch.negative)"""


@query("channels_derivation_geometry", f"""with {_PAIRS_SQL}
select montage_id, channel, positive, negative, {sql_rnd('mx / greatest(sqrt(mx*mx+my*my+mz*mz), 1e-8)')} as center_x, {sql_rnd('my / greatest(sqrt(mx*mx+my*my+mz*mz), 1e-8)')} as center_y,
 {sql_rnd('mz / greatest(sqrt(mx*mx+my*my+mz*mz), 1e-8)')} as center_z, {sql_rnd('dx')} as direction_x, {sql_rnd('dy')} as direction_y, {sql_rnd('dz')} as direction_z, positive <> negative as bipolar from g""")
def _(T):
    pick = lambda e: F.element_at(F.array(*[F.lit(n) for n in _EL]), (F.pmod(e, F.lit(19)) + 1).cast("int"))
    pk = F.col("l_partkey")
    ch = T.lineitem.select(F.col("l_orderkey").alias("montage_id"), pk.alias("channel"), pick(pk).alias("positive"), pick(F.floor(pk / 19) + pk).alias("negative")).distinct()
    got = channels.derivation_geometry(ch, electrodes.electrode_table(T.spark))
    vals = [c for c in got.columns if c.startswith(("center", "direction"))]
    return got.select("montage_id", "channel", "positive", "negative", *[rnd(c).alias(c) for c in vals], "bipolar")


@query("metadata_digest", """with kv as (select l_orderkey as montage_id, 'k' || l_linenumber || '_' || l_partkey as name, l_suppkey::varchar as value from lineitem),
d as (select distinct * from kv)
select montage_id, substr(sha256(array_to_string(list_sort(list(name || '=' || value)), '|')), 1, 32) as metadata_hash from d group by 1""")
def _(T):
    kv = T.lineitem.select(F.col("l_orderkey").alias("montage_id"), F.concat(F.lit("k"), "l_linenumber", F.lit("_"), "l_partkey").alias("name"), F.col("l_suppkey").cast("string").alias("value")).distinct()
    return channels.metadata_hash(kv, ["montage_id"])


_XYZ = "xyz as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)"


def _xyz(T):
    return T.embedded.select("vec_id", "label", *[F.get("x", F.lit(i)).alias(a) for i, a in enumerate("xyz")])


@query("features_spherical_basis", f"""with {_XYZ}, u as (select vec_id, x/r as x, y/r as y, z/r as z from (select *, greatest(sqrt(x*x+y*y+z*z), 1e-8) as r from xyz)),
b as (select vec_id, [x, y, z, x*y, x*z, y*z, x*x-y*y, 3.0*z*z-1.0] as basis from u)
select vec_id, k::int as k, {sql_rnd('basis[k+1]')} as v from b, unnest(range(0, 8)) as r(k)""")
def _(T):
    return channels.spherical_basis(_xyz(T)).select("vec_id", F.posexplode("basis").alias("k", "v")).select("vec_id", "k", rnd("v").alias("v"))


@query("features_fourier_position", f"""with {_XYZ},
long as (select vec_id, unnest([0,1,2]) as axis, unnest([x,y,z]) as p from xyz),
f as (select vec_id, axis as k, p as v from long
 union all select vec_id, 3 + axis*4 + j, sin(p * (2.0::double * pow(2.0::double, j) * {math.pi!r}::double)) from long, unnest(range(0,4)) as r(j)
 union all select vec_id, 15 + axis*4 + j, cos(p * (2.0::double * pow(2.0::double, j) * {math.pi!r}::double)) from long, unnest(range(0,4)) as r(j))
select vec_id, k::int as k, {sql_rnd('v')} as v from f""")
def _(T):
    got = channels.fourier_features(_xyz(T), 4, 2.0)
    return got.select("vec_id", F.posexplode("features").alias("k", "v")).select("vec_id", "k", rnd("v").alias("v"))


_WMETA = """wm as (select o_orderkey as window_id, (['eeg','ecg','semg','meg'])[(o_custkey % 4)::int + 1] as modality, (['limb','facial','elbow'])[(o_orderkey % 3)::int + 1] as emg_region,
  case when o_orderkey % 17 = 0 then 0.0 else 256.0 end::double as sampling_rate, 4 + (o_custkey % 2)::int as n_channels, 4 + (o_custkey % 2)::int - case when o_orderkey % 13 = 0 then 1 else 0 end as n_names,
  4 + (o_custkey % 2)::int as n_xyz, 4 + (o_orderkey % 2)::int as n_mask, o_custkey as batch from orders)"""


def _wmeta(T):
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(c) % len(names) + 1).cast("int"))
    n = (4 + F.col("o_custkey") % 2).cast("int")
    return T.orders.select(
        F.col("o_orderkey").alias("window_id"), pick(["eeg", "ecg", "semg", "meg"], "o_custkey").alias("modality"),
        pick(["limb", "facial", "elbow"], "o_orderkey").alias("emg_region"),
        F.when(F.col("o_orderkey") % 17 == 0, 0.0).otherwise(256.0).alias("sampling_rate"),
        n.alias("n_channels"), (n - F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0)).alias("n_names"),
        n.alias("n_xyz"), (4 + F.col("o_orderkey") % 2).cast("int").alias("n_mask"), (F.col("o_orderkey") % 50).alias("batch"))


@query("validate_window_constraints", f"""with {_WMETA} select window_id, modality not in ('eeg','ecg','semg') as bad_modality, n_names <> n_channels as bad_names, n_xyz <> n_channels as bad_xyz,
 n_mask <> n_channels as bad_mask, sampling_rate <= 0 as bad_rate, modality = 'semg' and emg_region not in ('limb','facial','trunk','unknown') as bad_region from wm""")
def _(T):
    return channels.validate_windows(_wmeta(T))


@query("validate_batch_channel_count", f"with {_WMETA} select window_id % 50 as batch, min(n_channels) as lo, max(n_channels) as hi from wm group by 1 having min(n_channels) <> max(n_channels)")
def _(T):
    return channels.mixed_batches(_wmeta(T), "batch")


@query("filter_recordings_with_reasons", f"""with {X.A},
rec as (select recording_id, case when recording_id % 9 = 0 then 11 else 12 end as n_channels, count(*) as n_samples from samples_wide group by 1),
rs as (select *, case when n_channels <> 12 then 'channels' when n_samples < 595 then 'short' end as reason from rec)
select coalesce(reason, 'valid') as reason, count(*) as n from rs group by 1""")
def _(T):
    rec = T.samples_wide.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_samples")).withColumn("n_channels", F.when(F.col("recording_id") % 9 == 0, 11).otherwise(12))
    return channels.skip_counts(channels.filter_recordings(rec, 12, 595))


# -- dataset registry ------------------------------------------------------------

DATASETS_SQL = sql_values("datasets", tables.DATASET_COLUMNS, tables.DATASETS)
_IDS = [r[0] for r in tables.DATASETS]


def dataset_of(key):
    return F.element_at(F.array(*[F.lit(i) for i in _IDS]), (F.pmod(key, F.lit(len(_IDS))) + 1).cast("int"))


def dataset_of_sql(key):
    arr = "','".join(_IDS)
    return f"(['{arr}'])[({key} % {len(_IDS)})::int + 1]"


@query("datasets_registry_join", f"""with {DATASETS_SQL}, f as (select c_custkey, {dataset_of_sql('c_custkey')} as dataset_id from customer)
select modality, dataset_id, task, sampling_rate, num_channels, derivation_type, count(*) as n_files from f join datasets using (dataset_id) where modality <> 'ecg' group by all""")
def _(T):
    f = T.customer.select(dataset_of(F.col("c_custkey")).alias("dataset_id"))
    spec = tables.datasets(T.spark).filter("modality <> 'ecg'")
    keys = ["modality", "dataset_id", "task", "sampling_rate", "num_channels", "derivation_type"]
    return labels.lookup(f, spec, "dataset_id", "inner").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"))


@query("datasets_non_limb_gate", f"""with f as (select c_custkey, {dataset_of_sql('c_custkey')} as dataset_id, (['eeg','semg','semg'])[(c_custkey % 3)::int + 1] as modality, (['limb','unknown','facial','limb'])[(c_custkey % 4)::int + 1] as emg_region from customer)
select c_custkey, dataset_id, modality, emg_region from f where modality = 'semg' and emg_region <> 'limb'""")
def _(T):
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % len(names) + 1).cast("int"))
    f = T.customer.select("c_custkey", dataset_of(F.col("c_custkey")).alias("dataset_id"), pick(["eeg", "semg", "semg"]).alias("modality"), pick(["limb", "unknown", "facial", "limb"]).alias("emg_region"))
    return channels.non_limb(f)


@query("datasets_surface_laplacian_admissible", f"""with {DATASETS_SQL}, f as (select c_custkey, {dataset_of_sql('c_custkey')} as dataset_id, c_nationkey from customer),
j as (select c_custkey, modality, has_coordinates and c_nationkey % 2 = 0 as has_coordinates, case when c_nationkey % 3 = 0 then 'Bipolar_TCP' else derivation_type end as derivation_type from f join datasets using (dataset_id))
select c_custkey, modality = 'eeg' and has_coordinates and not starts_with(lower(derivation_type), 'bipolar') as admissible from j""")
def _(T):
    f = T.customer.select("c_custkey", "c_nationkey", dataset_of(F.col("c_custkey")).alias("dataset_id")).join(tables.datasets(T.spark), "dataset_id")
    j = f.withColumn("has_coordinates", F.col("has_coordinates") & (F.col("c_nationkey") % 2 == 0)).withColumn(
        "derivation_type", F.when(F.col("c_nationkey") % 3 == 0, "Bipolar_TCP").otherwise(F.col("derivation_type")))
    return j.select("c_custkey", channels.uses_surface_laplacian().alias("admissible"))
