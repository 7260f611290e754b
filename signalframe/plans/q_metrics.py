"""Evaluation-metric and result-analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from ..operators import layout, metrics, results, wavelet
from . import fixtures as X
from .q_wavelet import HAAR2
from .registry import query, rnd, sql_digest, sql_normal, sql_rnd, sql_uniform, sql_values

P = X.F_

CONF = f"""{P}, conf as (select a.k::int as y_true, b.k::int as y_pred, count(p.item_id) as n from unnest(range(0, 11)) as a(k) cross join unnest(range(0, 11)) as b(k)
 left join predictions p on p.y_true = a.k and p.y_pred = b.k group by 1, 2),
cls as (select c.k::int as label, sum(case when y_true = c.k and y_pred = c.k then n else 0 end)::bigint as tp, sum(case when y_true = c.k then n else 0 end)::bigint as support, sum(case when y_pred = c.k then n else 0 end)::bigint as predicted from conf, unnest(range(0, 11)) as c(k) group by 1),
f as (select *, case when predicted = 0 then 0 else tp / predicted end as prec, case when support = 0 then 0 else tp / support end as rec, case when support + predicted = 0 then 0 else 2.0::double * tp / (support + predicted) end as f1 from cls)"""


@query("metrics_confusion_matrix", f"with {CONF} select y_true, y_pred, n from conf")
def _(T):
    return metrics.confusion_matrix(T.predictions, 11)


@query("metrics_per_class", f"with {CONF} select label, tp, support, predicted, {sql_rnd('prec')} as prec, {sql_rnd('rec')} as rec, {sql_rnd('f1')} as f1 from f")
def _(T):
    got = metrics.per_class(metrics.confusion_matrix(T.predictions, 11))
    return got.select("label", "tp", "support", "predicted", rnd("precision").alias("prec"), rnd("recall").alias("rec"), rnd("f1").alias("f1"))


@query("metrics_classification", f"""with {CONF}, s as (select sum(support)::double as n, sum(tp)::double / sum(support) as po, sum(support::double * predicted) / (sum(support)::double ** 2) as pe, avg(case when support > 0 then rec end) as bal, sum(f1 * support) / sum(support) as wf1 from f)
select n::bigint as n, {sql_rnd('po')} as accuracy, {sql_rnd('bal')} as balanced_accuracy, {sql_rnd('(po - pe) / (1 - pe)')} as kappa, {sql_rnd('wf1')} as weighted_f1 from s""")
def _(T):
    got = metrics.classification_metrics(T.predictions, 11)
    return got.select("n", *[rnd(c).alias(c) for c in ("accuracy", "balanced_accuracy", "kappa", "weighted_f1")])


@query("metrics_pooled_over_shards", f"""with {P}, a as (select item_id % 4 as shard, y_true, y_pred from predictions)
select shard, count(*) as n, {sql_rnd('avg(case when y_true = y_pred then 1.0 else 0.0 end)')} as accuracy from a group by 1
union all select -1, count(*), {sql_rnd('avg(case when y_true = y_pred then 1.0 else 0.0 end)')} from a""")
def _(T):
    sharded = T.predictions.withColumn("shard", F.col("item_id") % 4)
    per = metrics.classification_metrics(sharded, 11, ["shard"]).select("shard", "n", rnd("accuracy").alias("accuracy"))
    whole = metrics.classification_metrics(T.predictions, 11).select(F.lit(-1).cast("long").alias("shard"), "n", rnd("accuracy").alias("accuracy"))
    return per.unionByName(whole)


@query("metrics_argmax_prediction", f"with {P} select item_id, list_position(logits, list_max(logits))::int - 1 as y_pred from predictions")
def _(T):
    return metrics.predict(T.predictions.drop("y_pred")).select("item_id", "y_pred")


_SM = f"""{P}, lg as (select item_id, y_true, unnest(logits) as z, unnest(range(0, 10)) as k from predictions),
sm as (select item_id, y_true, k, z, exp(z) / sum(exp(z)) over (partition by item_id) as p from lg)"""


@query("metrics_softmax_sigmoid", f"with {_SM} select item_id, k::int as k, {sql_rnd('p')} as p, {sql_rnd('1 / (1 + exp(-z))')} as s from sm")
def _(T):
    both = metrics.sigmoid(metrics.softmax(T.predictions), out="sig")
    z = F.posexplode(F.arrays_zip("probs", "sig")).alias("k", "z")
    return both.select("item_id", z).select("item_id", "k", rnd("z.probs").alias("p"), rnd("z.sig").alias("s"))


def _auc_sql(src, keys):
    part = f"partition by {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    grp = f"group by {keys}" if keys else ""
    win = f"{keys + ', ' if keys else ''}score"
    return f"""select {sel}(sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y)::double * sum(1 - y), 0) as auroc
 from (select *, rank() over ({part} order by score) + (count(*) over (partition by {win}) - 1) / 2.0 as r from {src}) {grp}"""


@query("metrics_auroc_binary", f"""with {X.G}, b as (select class_id, y_true as y, score from ml_predictions), a as ({_auc_sql('b', 'class_id')})
select class_id, {sql_rnd('auroc')} as auroc from a""")
def _(T):
    got = metrics.auroc(T.ml_predictions.withColumnRenamed("y_true", "y"), ["class_id"])
    return got.select("class_id", rnd("auroc").alias("auroc"))


@query("metrics_auroc_single_class_null", f"""with {_SM}, b as (select k, case when y_true = k and k <> 2 then 1 else 0 end as y, p as score from sm), a as ({_auc_sql('b', 'k')})
select k::int as k, {sql_rnd('auroc')} as auroc from a""")
def _(T):
    long = metrics.softmax(T.predictions).select("y_true", F.posexplode("probs").alias("k", "score"))
    long = long.withColumn("y", ((F.col("y_true") == F.col("k")) & (F.col("k") != 2)).cast("int"))
    return metrics.auroc(long, ["k"]).select("k", rnd("auroc").alias("auroc"))


@query("metrics_auroc_ovr", f"""with {_SM}, rn as (select item_id, y_true, k, p / greatest(sum(p) over (partition by item_id), 1e-12::double) as p from sm where k in (select y_true from predictions)),
b as (select k, case when y_true = k then 1 else 0 end as y, p as score from rn), a as ({_auc_sql('b', 'k')})
select {sql_rnd('avg(auroc)')} as auroc, count(auroc) as n_classes from a""")
def _(T):
    got = metrics.auroc_ovr(metrics.softmax(T.predictions), 10)
    return got.select(rnd("auroc").alias("auroc"), "n_classes")


@query("metrics_auroc_ovo", f"""with {_SM}, o as (select distinct y_true as k from predictions),
b as (select least(s.y_true, o.k) as a, greatest(s.y_true, o.k) as b, s.k as target, case when s.y_true = s.k then 1 else 0 end as y, s.p as score from sm s join o on o.k <> s.y_true and (s.k = s.y_true or s.k = o.k)),
au as ({_auc_sql('b', 'a, b, target')}), pr as (select a, b, avg(auroc) as v from au group by 1, 2)
select {sql_rnd('avg(v)')} as auroc, count(*) as n_pairs from pr""")
def _(T):
    got = metrics.auroc_ovo(metrics.softmax(T.predictions))
    return got.select(rnd("auroc").alias("auroc"), "n_pairs")


def _ap_sql(src, keys):
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    grp = f"group by {keys}" if keys else ""
    return f"""select {k}sum(p * cp / (cp + cn)) / nullif(sum(p), 0) as ap from (
 select {k}score, p, sum(p) over ({part} order by score desc) as cp, sum(n) over ({part} order by score desc) as cn from (select {k}score, sum(y)::double as p, sum(1 - y)::double as n from {src} group by {k}score)) {grp}"""


_ML = f"""{X.G}, b as (select class_id, y_true as y, score from ml_predictions),
cn as (select class_id, sum(y_true * pr)::double as tp, sum((1 - y_true) * pr)::double as fp, sum(y_true * (1 - pr))::double as fn, count(*) as n from (select *, case when score >= 0.5 then 1 else 0 end as pr from ml_predictions) group by 1)"""


@query("metrics_multilabel", f"""with {_ML},
s as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(n) as n from cn)
select {sql_rnd('tp / (tp + fp)')} as precision_micro, {sql_rnd('(select avg(coalesce(tp / nullif(tp + fp, 0), 0)) from cn)')} as precision_macro,
 {sql_rnd('tp / (tp + fn)')} as recall_micro, {sql_rnd('(select avg(coalesce(tp / nullif(tp + fn, 0), 0)) from cn)')} as recall_macro,
 {sql_rnd('2 * tp / (2 * tp + fp + fn)')} as f1_micro, {sql_rnd('(select avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) from cn)')} as f1_macro,
 {sql_rnd('tp / (tp + fp + fn)')} as jaccard_micro, {sql_rnd('(select avg(coalesce(tp / nullif(tp + fp + fn, 0), 0)) from cn)')} as jaccard_macro,
 {sql_rnd('(fp + fn) / n')} as hamming_loss,
 {sql_rnd(f"(select auroc from ({_auc_sql('b', '')}))")} as auroc_micro, {sql_rnd(f"(select avg(auroc) from ({_auc_sql('b', 'class_id')}))")} as auroc_macro,
 {sql_rnd(f"(select ap from ({_ap_sql('b', '')}))")} as ap_micro, {sql_rnd(f"(select avg(ap) from ({_ap_sql('b', 'class_id')}))")} as ap_macro from s""")
def _(T):
    got = metrics.multilabel_metrics(T.ml_predictions, 0.5)
    return got.select(*[rnd(c).alias(c) for c in got.columns])


@query("metrics_average_precision", f"with {_ML}, a as ({_ap_sql('b', 'class_id')}) select class_id, {sql_rnd('ap')} as ap from a")
def _(T):
    got = metrics.average_precision(T.ml_predictions.withColumnRenamed("y_true", "y"), ["class_id"])
    return got.select("class_id", rnd("ap").alias("ap"))


# Reconstruction: channels 0/1 of an embedding predict channels 2/3.
_REC = f"""{X.C}, pt as (select vec_id, channel, x as target, list_transform(x, lambda v, i: v + 0.05::double * ((i - 1 + vec_id) % 3 - 1)) as pred, (vec_id + channel) % 3 = 0 as masked from windows4)"""


def _recon(T):
    return T.windows4.select(
        "vec_id", "channel", F.col("x").alias("target"),
        F.transform("x", lambda v, i: v + 0.05 * (F.pmod(i + F.col("vec_id"), F.lit(3)) - 1)).alias("pred"),
        (F.pmod(F.col("vec_id") + F.col("channel"), F.lit(3)) == 0).alias("masked"))


@query("metrics_masked_reconstruction", f"""with {_REC}, e as (select unnest(pred) as p, unnest(target) as t from pt where masked)
select count(*) as n, {sql_rnd('avg((p-t)**2)', 8)} as mse, {sql_rnd('sqrt(avg((p-t)**2))', 8)} as rmse, {sql_rnd('avg(abs(p-t))', 8)} as mae, {sql_rnd('avg(case when abs(p-t)/(abs(t)+1e-8) < 0.1 then 1.0 else 0.0 end)')} as accuracy from e""")
def _(T):
    got = metrics.masked_error(_recon(T))
    return got.select("n", rnd("mse", 8).alias("mse"), rnd("rmse", 8).alias("rmse"), rnd("mae", 8).alias("mae"), rnd("accuracy").alias("accuracy"))


def _haar_of(col):
    return HAAR2.replace("from patches", f"from (select vec_id, channel, masked, {col} as x from pt)").replace("d1 as", f"d1_{col} as").replace("d2 as", f"d2_{col} as").replace("from d1", f"from d1_{col}")


@query("metrics_coefficient_error", f"""with {_REC}, {_haar_of('pred')}, {_haar_of('target')},
j as (select p.masked, unnest(['A2','D2','D1']) as band, unnest([p.a2, p.c2, p.c1]) as p, unnest([t.a2, t.c2, t.c1]) as t from d2_pred p join d2_target t using (vec_id, channel)),
l as (select band, case when masked then 1.0 else 0.0 end as m, unnest(p) as p, unnest(t) as t from j)
select band, {sql_rnd('sum((p-t)**2 * m) / greatest(sum(m), 1) / greatest(avg(t*t) + avg(p*p), 1e-8)')} as error from l group by 1""")
def _(T):
    r = _recon(T)
    both = wavelet.dwt(wavelet.dwt(r, 16, "haar", 2, value="pred", out="cp"), 16, "haar", 2, value="target", out="ct")
    bands = wavelet.split_bands(both.drop("target", "pred"), 16, 2, "cp", "p")
    bands_t = wavelet.split_bands(both.drop("target", "pred"), 16, 2, "ct", "t")
    j = bands.select("vec_id", "channel", "masked", "band", "p").join(bands_t.select("vec_id", "channel", "band", "t"), ["vec_id", "channel", "band"])
    return metrics.coefficient_error(j).select("band", rnd("error").alias("error"))


_VIEWS = f"""{X.C}, vw as (select vec_id as item_id, channel as view, x as z from windows4), nm as (select item_id, view, z, sqrt(list_sum(list_transform(z, lambda v: v*v))) as n from vw)"""
_COS = "list_sum(list_transform(list_zip(a.z, b.z), lambda q: q[1]*q[2])) / (greatest(a.n, 1e-8) * greatest(b.n, 1e-8))"


@query("metrics_view_consistency_anchor", f"""with {_VIEWS}, d as (select a.view, avg(1 - {_COS}) as v from nm a join nm b on b.item_id = a.item_id and b.view = 0 where a.view > 0 group by 1) select {sql_rnd('avg(v)')} as consistency from d""")
def _(T):
    views = T.windows4.select(F.col("vec_id").alias("item_id"), F.col("channel").alias("view"), F.col("x").alias("z"))
    got = metrics.view_consistency(views.filter("view > 0"), views.filter("view = 0").select("item_id", "z"))
    return got.select(rnd("consistency").alias("consistency"))


@query("metrics_view_consistency_pairwise", f"""with {_VIEWS}, d as (select a.view, b.view as w, avg(1 - {_COS}) as v from nm a join nm b on b.item_id = a.item_id and b.view > a.view group by 1, 2) select {sql_rnd('avg(v)')} as consistency from d""")
def _(T):
    views = T.windows4.select(F.col("vec_id").alias("item_id"), F.col("channel").alias("view"), F.col("x").alias("z"))
    return metrics.view_consistency(views).select(rnd("consistency").alias("consistency"))


_SHIFT = f"""{X.C}, ab as (select vec_id, list_transform(x, lambda v: v * 3) as a, list_transform(x, lambda v, i: v * 3 + 0.1::double * ((i - 1 + vec_id) % 3 - 1)) as b from embedded)"""


def _ab(T):
    return T.embedded.select(F.transform("x", lambda v: v * 3.0).alias("a"), F.transform("x", lambda v, i: v * 3.0 + 0.1 * (F.pmod(i + F.col("vec_id"), F.lit(3)) - 1)).alias("b"))


@query("metrics_embedding_shift", f"""with {_SHIFT}, m as (select list_sum(list_transform(list_zip(a, b), lambda q: q[1]*q[2])) as ab, sqrt(list_sum(list_transform(a, lambda v: v*v))) as na, sqrt(list_sum(list_transform(b, lambda v: v*v))) as nb, sqrt(list_sum(list_transform(list_zip(a, b), lambda q: (q[1]-q[2])**2))) as d from ab)
select {sql_rnd('avg(ab / (greatest(na, 1e-8) * greatest(nb, 1e-8)))')} as cosine_similarity, {sql_rnd('avg(d / greatest(na, 1e-8))')} as relative_l2 from m""")
def _(T):
    got = metrics.embedding_shift(_ab(T))
    return got.select(rnd("cosine_similarity").alias("cosine_similarity"), rnd("relative_l2").alias("relative_l2"))


@query("metrics_symmetric_kl", f"""with {_SHIFT}, l as (select vec_id, unnest(a) as a, unnest(b) as b from ab), s as (select vec_id, a - ln(sum(exp(a)) over w) as la, b - ln(sum(exp(b)) over w) as lb from l window w as (partition by vec_id)),
k as (select vec_id, sum(exp(la) * (la - lb)) + sum(exp(lb) * (lb - la)) as v from s group by 1) select {sql_rnd('0.5::double * avg(v)', 8)} as symmetric_kl from k""")
def _(T):
    return metrics.symmetric_kl(_ab(T)).select(rnd("symmetric_kl", 8).alias("symmetric_kl"))


_REL = f"""rl as (select o_orderkey as item_id, unnest(['eeg','ecg','semg']) as modality, o_custkey from orders),
r as (select item_id, modality, {sql_uniform(1, 'item_id', 'modality')} as reliability, 1 - {sql_uniform(2, 'item_id', 'modality')} as target, {sql_uniform(3, 'item_id', 'modality')} > 0.3::double as present from rl)"""


def _reliab(T):
    m = F.explode(F.array(*[F.lit(v) for v in ("eeg", "ecg", "semg")]))
    u = lambda s: H.uniform(s, "item_id", "modality")
    return T.orders.select(F.col("o_orderkey").alias("item_id"), m.alias("modality")).select("item_id", "modality", u(1).alias("reliability"), (1.0 - u(2)).alias("target"), (u(3) > 0.3).alias("present"))


@query("metrics_reliability_error", f"with {_REL}, e as (select modality, sum(case when present then (reliability - target)**2 else 0 end) / count_if(present) as e from r group by 1) select {sql_rnd('avg(e)')} as error from e")
def _(T):
    return metrics.reliability_error(_reliab(T)).select(rnd("error").alias("error"))


@query("metrics_score_fusion", f"""with {_REL}, u as (select r.*, k::int as class_id, {sql_uniform(4, 'item_id', 'modality', 'k')} as logit from r, unnest(range(0, 3)) as c(k)),
m as (select item_id, class_id, sum(case when present then reliability * logit else 0 end) / greatest(sum(case when present then reliability else 0 end), 1e-6) as m from u group by 1, 2)
select item_id, class_id, {sql_rnd(f"{sql_uniform(5, 'item_id', 'class_id')} + 0.5::double * m")} as logit from m""")
def _(T):
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    uni = _reliab(T).withColumn("class_id", k).withColumn("logit", H.uniform(4, "item_id", "modality", "class_id"))
    fused = T.orders.select(F.col("o_orderkey").alias("item_id"), k.alias("class_id")).withColumn("logit", H.uniform(5, "item_id", "class_id"))
    return metrics.fuse_scores(fused, uni).select("item_id", "class_id", rnd("logit").alias("logit"))


_W10 = [0.5 + 0.1 * i for i in range(10)]


@query("metrics_log_loss_smoothed", f"""with {_SM}, {sql_values('cw', ['k', 'w'], list(enumerate(_W10)))}, l as (select item_id, y_true, -sum((case when k = y_true then 0.9::double else 0 end + 0.1::double / 10) * ln(p)) as l from sm group by 1, 2)
select {sql_rnd('sum(l * w) / sum(w)')} as loss from l join cw on cw.k = y_true""")
def _(T):
    return metrics.log_loss(T.predictions, 10, 0.1, _W10).select(rnd("loss").alias("loss"))


@query("metrics_log_loss_plain", f"with {_SM} select {sql_rnd('avg(-ln(p))')} as loss from sm where k = y_true")
def _(T):
    return metrics.log_loss(T.predictions, 10).select(rnd("loss").alias("loss"))


@query("metrics_log_loss_multilabel", f"""with {X.G}, l as (select score * 4 - 2 as x, y_true * (1 - 0.1::double) + 0.5::double * 0.1::double as t from ml_predictions)
select {sql_rnd('avg(-(t * ln(1 / (1 + exp(-x))) + (1 - t) * ln(1 - 1 / (1 + exp(-x)))))')} as loss from l""")
def _(T):
    long = T.ml_predictions.withColumn("logit", F.col("score") * 4 - 2)
    return metrics.binary_log_loss(long, 0.1).select(rnd("loss").alias("loss"))


def _order_sql(tag):
    return f"(select list(c order by {sql_digest('6:' + tag, 'c')}) from unnest(range(0, 4)) as r(c))"


@query("perturb_channels", f"""with {X.C}, cond as (select {_order_sql('perm')} as perm, {_order_sql('missing_10pct')} as m10, {_order_sql('missing_25pct')} as m25, {_order_sql('bad')} as bad),
r as (select 'permutation' as condition, s.vec_id, p.pos - 1 as pos, s.t, s.v, true as good from samples4 s, cond, unnest(range(1, 5)) as p(pos) where cond.perm[p.pos] = s.channel
 union all select 'missing_10pct', vec_id, channel, t, case when channel = m10[1] then 0 else v end, channel <> m10[1] from samples4, cond
 union all select 'missing_25pct', vec_id, channel, t, case when channel = m25[1] then 0 else v end, channel <> m25[1] from samples4, cond
 union all select 'bad_channel', vec_id, channel, t, case when channel = bad[1] then 10.0::double * {sql_normal('6:noise', 'channel', 't')} else v end, true from samples4, cond
 union all select 'unknown_montage', vec_id, channel, t, v, true from samples4)
select condition, vec_id, pos::int as pos, bool_and(good) as good, {sql_rnd('sum(v * (t + 1))')} as s from r group by 1, 2, 3""")
def _(T):
    got = metrics.perturb(layout.pack_channels(T.windows4, ["vec_id"]), 6, "vec_id")
    z = F.posexplode(F.arrays_zip("x", "good")).alias("pos", "z")
    weighted = A.total(F.transform("z.x", lambda v, t: v * (t + 1)))
    return got.select("condition", "vec_id", z).select("condition", "vec_id", "pos", F.col("z.good").alias("good"), rnd(weighted).alias("s"))


_CONDITIONS = [
    {"id": "all", "modalities": ["eeg", "ecg", "semg"]},
    {"id": "no_ecg", "modalities": ["eeg", "semg"]},
    {"id": "eeg_saturated", "modalities": ["eeg", "ecg", "semg"], "corrupt": {"eeg": "saturation"}},
    {"id": "semg_drop", "modalities": ["eeg", "semg"], "corrupt": {"semg": "dropout"}},
]
_COND_SQL = sql_values("cond", ["condition", "modality", "corruption"], [(c["id"], m, (c.get("corrupt") or {}).get(m)) for c in _CONDITIONS for m in c["modalities"]])


@query("condition_grid", f"""with {X.C}, {_COND_SQL}, w as (select vec_id as window_id, (['eeg','ecg','semg'])[(vec_id % 3)::int + 1] as modality from embedded)
select window_id, modality, condition, coalesce(corruption, 'none') as kind, {sql_rnd(f"case when corruption is null then 0 else {sql_uniform('2:level', 'window_id', 'modality', 'condition')} end")} as level from w join cond using (modality)""")
def _(T):
    packed = layout.pack_channels(T.windows4, ["vec_id"])
    modal = packed.select(F.col("vec_id").alias("window_id"), F.element_at(F.array(*[F.lit(m) for m in ("eeg", "ecg", "semg")]), (F.col("vec_id") % 3 + 1).cast("int")).alias("modality"), "x")
    return metrics.condition_grid(modal, _CONDITIONS, 2).select("window_id", "modality", "condition", "kind", rnd("level").alias("level"))


@query("join_align_modalities", """with a as (select distinct user_id as k from events where event_type = 'click'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'O'), c as (select s_suppkey as k from supplier)
select coalesce(a.k, b.k, c.k) as window_id, a.k is not null as has_eeg, b.k is not null as has_ecg, c.k is not null as has_semg from a full join b on a.k = b.k full join c on c.k = coalesce(a.k, b.k)""")
def _(T):
    from ..operators import joins

    a = T.events.filter("event_type = 'click'").select(F.col("user_id").alias("window_id")).distinct()
    b = T.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("window_id")).distinct()
    c = T.supplier.select(F.col("s_suppkey").alias("window_id"))
    return joins.align_modalities({"eeg": a, "ecg": b, "semg": c}).select("window_id", "has_eeg", "has_ecg", "has_semg")


# -- result analytics ----------------------------------------------------------------

@query("results_variant_summary", f"""with {X.H_}, l as (select variant, unnest(['test_acc','test_f1','cost']) as metric, unnest([test_acc, test_f1, cost]) as v from runs)
select variant, metric, {sql_rnd('avg(v)', 4)} as mean, {sql_rnd('case when count(v) > 1 then stddev_samp(v) else 0 end', 4)} as sd, count(v) as n from l group by 1, 2""")
def _(T):
    got = results.variant_summary(T.runs, ["test_acc", "test_f1", "cost"])
    return got.select("variant", "metric", rnd("mean", 4).alias("mean"), rnd("sd", 4).alias("sd"), "n")


@query("results_paired_delta", f"""with {X.H_}, l as (select variant, fold, seed, unnest(['test_acc','cost']) as metric, unnest([test_acc, cost]) as v from runs),
d as (select a.variant, a.metric, a.v - b.v as d from l a join l b on b.fold = a.fold and b.seed = a.seed and b.metric = a.metric and b.variant = 'A' where a.variant <> 'A')
select variant, metric, {sql_rnd('avg(d)', 4)} as mean, {sql_rnd('case when count(d) > 1 then stddev_samp(d) else 0 end', 4)} as sd, count(d) as n from d group by 1, 2""")
def _(T):
    got = results.paired_delta(T.runs, "A", ["test_acc", "cost"])
    return got.select("variant", "metric", rnd("mean", 4).alias("mean"), rnd("sd", 4).alias("sd"), "n")


_CM = """cm as (select l_returnflag as variant, l_linenumber as fold, i, list(n order by j) as row from (
  select l_returnflag, l_linenumber, i, j, count(case when l_suppkey % 3 = i and l_partkey % 3 = j then 1 end) as n from lineitem, unnest(range(0, 3)) as a(i), unnest(range(0, 3)) as b(j) group by 1, 2, 3, 4) group by 1, 2, 3)"""


def _nested_runs(T):
    cell = lambda i, j: F.count_if((F.col("l_suppkey") % 3 == i) & (F.col("l_partkey") % 3 == j))
    return T.lineitem.groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("fold")).agg(
        F.array(*[F.array(*[cell(i, j) for j in range(3)]) for i in range(3)]).alias("confusion_matrix"))


@query("results_sum_confusions", f"""with {_CM} select variant, i::int as y_true, j::int as y_pred, sum(row[j+1])::bigint as n from cm, unnest(range(0, 3)) as b(j) group by 1, 2, 3""")
def _(T):
    return results.sum_confusions(_nested_runs(T))


@query("results_flatten_runs", """select l_returnflag as variant, l_linenumber as fold, l_linestatus as seed, count(*) as n_rows, 'enc' || l_returnflag as encoding, 'inj' || l_linenumber as injection, substr(md5(l_linestatus), 1, 12) as metadata_hash,
 substr(sha1(l_returnflag), 1, 8) as git_commit, max(l_linenumber)::bigint as best_epoch, min(l_quantity) as f1_W, max(l_quantity) as f1_N1, null::double as f1_N2 from lineitem group by 1, 2, 3""")
def _(T):
    k = [F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("fold"), F.col("l_linestatus").alias("seed")]
    runs = T.lineitem.groupBy(*k).agg(F.count(F.lit(1)).alias("n_rows"), F.array(F.min("l_quantity"), F.max("l_quantity")).alias("per_class_f1"), F.max("l_linenumber").cast("long").alias("best_epoch"))
    prov = F.struct(F.concat(F.lit("enc"), "variant").alias("channel_encoding"), F.concat(F.lit("inj"), "fold").alias("channel_injection"),
                    F.substring(F.md5(F.encode("seed", "utf-8")), 1, 12).alias("metadata_hash"), F.sha1(F.encode("variant", "utf-8")).alias("git_commit"))
    return results.flatten_runs(runs.withColumn("provenance", prov), ["n_rows"], ["W", "N1", "N2"])


@query("results_fold_summary", f"""with fr as (select 'fold' || l_linenumber as fold, avg(l_quantity) / 100 as auroc, avg(l_discount) as kappa from lineitem group by 1),
l as (select fold, unnest(['auroc','kappa']) as metric, unnest([auroc, kappa]) as v from fr)
select metric, {sql_rnd('avg(v)')} as mean, {sql_rnd('stddev_samp(v)')} as sd, count(*) as n, (select count(distinct fold) from fr) = 9 as complete,
 (select string_agg('fold' || i, ',' order by 'fold' || i) from unnest(range(0, 9)) as r(i) where 'fold' || i not in (select fold from fr)) as missing, {sql_rnd("avg(v) - case metric when 'auroc' then 0.7168 when 'kappa' then 0.2999 end")} as delta from l group by 1""")
def _(T):
    fr = T.lineitem.groupBy(F.concat(F.lit("fold"), "l_linenumber").alias("fold")).agg((F.avg("l_quantity") / 100).alias("auroc"), F.avg("l_discount").alias("kappa"))
    got = results.fold_summary(fr, ["auroc", "kappa"], 9, results.PUBLISHED_P300["EEGPT (NeurIPS'24)"])
    return got.select("metric", rnd("mean").alias("mean"), rnd("sd").alias("sd"), "n", "complete", "missing", rnd("delta").alias("delta"))


@query("results_missing_cells", """with r as (select o_custkey % 10 as fold, o_orderstatus as variant, o_orderpriority as seed from orders where (o_custkey % 10 + length(o_orderpriority)) % 4 <> 0)
select f.fold, v.variant, s.seed from (select distinct fold from r) f, (select distinct variant from r) v, (select distinct seed from r) s
where not exists (select 1 from r where r.fold = f.fold and r.variant = v.variant and r.seed = s.seed)""")
def _(T):
    r = T.orders.select((F.col("o_custkey") % 10).alias("fold"), F.col("o_orderstatus").alias("variant"), F.col("o_orderpriority").alias("seed"))
    return results.missing_cells(r.filter(F.pmod(F.col("fold") + F.length("seed"), F.lit(4)) != 0))


_STALE = """rs as (select o_orderkey as run_id, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then 1 else 2 end as schema_version,
 case when o_orderkey % 15 = 0 then null else o_custkey end as scored_rows, case when o_orderkey % 2 = 0 then o_custkey else o_custkey * 4 end as test_rows, o_orderkey % 11 = 0 as bare,
 case when o_orderkey % 3 = 0 then '3e-4' when o_orderkey % 3 = 1 then '0.0003' else '0.001' end as lr, case when o_orderkey % 4 = 0 then null else '7' end as seed, case when o_custkey % 2 = 0 then 'True' else 'token' end as enc from orders),
j as (select *, case when schema_version < 2 then 'old schema' when schema_version is null and (scored_rows is null or test_rows is null) then 'unknown test size'
  when schema_version is null and scored_rows <> test_rows then 'partial test set' when bare then 'no provenance' end as reason from rs)"""


@query("results_stale_runs", f"""with {_STALE}
select run_id, reason from j where reason is not null
union all select run_id, 'differs: LR' from j where reason is null and lr = '0.001'
union all select run_id, 'differs: SEED' from j where reason is null and seed is null
union all select run_id, 'differs: CHANNEL_ENCODING' from j where reason is null and enc = 'token'""")
def _(T):
    k = F.col("o_orderkey")
    nothing = F.lit(None)
    settings = F.map_from_arrays(
        F.array(F.lit("LR"), F.lit("SEED"), F.lit("CHANNEL_ENCODING")),
        F.array(F.when(k % 3 == 0, "3e-4").when(k % 3 == 1, "0.0003").otherwise("0.001"), F.when(k % 4 != 0, "7"), F.when(F.col("o_custkey") % 2 == 0, "True").otherwise("token")))
    rs = T.orders.select(
        k.alias("run_id"), F.when(k % 5 == 0, nothing).when(k % 7 == 0, 1).otherwise(2).cast("int").alias("schema_version"),
        F.when(k % 15 != 0, F.col("o_custkey")).alias("scored_rows"), F.when(k % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") * 4).alias("test_rows"),
        F.when(k % 11 != 0, settings).alias("settings"))
    wanted = T.spark.createDataFrame([("LR", "0.0003"), ("SEED", "7"), ("CHANNEL_ENCODING", "true")], "name string, want string")
    return results.stale_runs(rs, wanted)


_RESULT_FILES = """rf as (select o_orderkey as run_id, o_custkey, o_orderkey % 13 = 0 as broken, o_orderkey % 17 = 0 as nothing, o_orderkey % 11 = 0 as bare, o_orderkey % 10 = 0 as unversioned, o_orderkey % 7 = 0 as old,
  o_orderkey % 3 as lr, o_orderkey % 4 = 0 as other_seed, o_custkey % 2 = 0 as flag, o_orderkey % 19 <> 0 as sized from orders),
rj as (select *, case when nothing then 'missing' when broken then 'unreadable' when unversioned then case when not sized then 'no result_schema_version, test set not available' when lr = 0 then 'scored on ' || (o_custkey + 2) || ' of ' || (o_custkey + 3) when bare then 'no provenance' end
  when old then 'result_schema_version 1' when bare then 'no provenance' end as reason from rf)"""


@query("results_stale_from_json", f"""with {_RESULT_FILES}
select run_id, reason, true as stale from rj where reason is not null
union all select run_id, 'differs: LR', true from rj where reason is null and lr = 2
union all select run_id, 'differs: SEED', true from rj where reason is null and other_seed
union all select run_id, 'differs: CHANNEL_ENCODING', true from rj where reason is null and flag
union all select run_id, 'uncheckable: MIN_LR', false from rj where reason is null""")
def _(T):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    when = lambda n: k % n == 0
    # Numbers, text and flags as experiment runners write them; an order is one result file.
    lr = F.when(k % 3 == 0, "3e-4").when(k % 3 == 1, "0.0003").otherwise("0.001")
    config = F.concat(F.lit('{"lr": '), lr, F.lit(', "epochs": 20}'))
    seed = F.when(when(4), '"none"').otherwise("42")
    encoding = F.when(c % 2 == 0, "true").otherwise('"signed"')
    provenance = F.when(when(11), "{}").otherwise(F.concat(F.lit('{"seed": '), seed, F.lit(', "channel_encoding": '), encoding, F.lit(', "resolved_model_config": '), config, F.lit("}")))
    version = F.when(when(10), "").when(when(7), '"result_schema_version": 1, ').otherwise('"result_schema_version": 2, ')
    last = F.when(k % 3 == 0, 1).otherwise(2)
    text = F.concat(F.lit("{"), version, F.lit('"per_class_support": ['), c.cast("string"), F.lit(", 1, "), last.cast("string"), F.lit('], "provenance": '), provenance, F.lit("}"))
    text = F.when(when(17), F.lit(None)).when(when(13), F.concat(text, F.lit(","))).otherwise(text)
    documents = T.orders.select(k.alias("run_id"), text.alias("text"))
    sizes = T.orders.filter(~when(19)).select(k.alias("run_id"), (c + 3).alias("test_rows"))
    wanted = T.spark.createDataFrame([("LR", "0.00030"), ("SEED", "42"), ("CHANNEL_ENCODING", "signed"), ("EPOCHS", "20"), ("MIN_LR", "0")], "name string, want string")
    return results.stale_results(documents, wanted, sizes)
