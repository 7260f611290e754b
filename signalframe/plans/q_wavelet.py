"""Wavelet, spectral, mask and augmentation queries, and the flagship query."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import augment, layout, normalize, rank, spectral, splits, wavelet, windowing
from . import fixtures as X
from .q_splits import _SPLIT
from .registry import query, rnd, sql_digest, sql_normal, sql_rnd, sql_uniform, sql_values

_R2 = repr(math.sqrt(0.5)) + "::double"
# Haar, two levels, periodised: the direct formula.
HAAR2 = f"""d1 as (select *, list_transform(range(0, len(x) // 2), lambda i: (x[2*i+1] + x[2*i+2]) * {_R2}) as a1, list_transform(range(0, len(x) // 2), lambda i: (x[2*i+2] - x[2*i+1]) * {_R2}) as c1 from patches),
d2 as (select *, list_transform(range(0, len(a1) // 2), lambda i: (a1[2*i+1] + a1[2*i+2]) * {_R2}) as a2, list_transform(range(0, len(a1) // 2), lambda i: (a1[2*i+2] - a1[2*i+1]) * {_R2}) as c2 from d1)"""

FLAGSHIP = f"""with {X.windows_sql()},
z as (select recording_id, channel, start, list_avg(x) as m, list_stddev_pop(x) + 1e-8::double as s, x from windows),
patches as (select recording_id, channel, start, p as patch, list_transform(x[p*16+1:p*16+16], lambda v: (v - m) / s) as x from z, unnest(range(0, 4)) as u(p)),
{HAAR2},
e as (select recording_id, channel, unnest(['A2','D2','D1']) as band, unnest([list_avg(list_transform(a2, lambda v: v*v)), list_avg(list_transform(c2, lambda v: v*v)), list_avg(list_transform(c1, lambda v: v*v))]) as energy from d2)
select {_SPLIT(sql_uniform(42, 'recording_id'))} as split, channel, band, count(*) as n_patches, {sql_rnd('avg(energy)')} as mean_energy from e group by 1, 2, 3"""


@query("flagship_band_energy_by_split", FLAGSHIP)
def flagship(T):
    z = normalize.zscore(T.windows(), "add").withColumn("split", splits.subject_split_expr(F.col("recording_id")))
    patches = windowing.patchify(z.select("split", "recording_id", "channel", "start", "x"), 16, 2)
    coeffs = wavelet.dwt(patches, 16, "haar", 2, "periodization")
    energy = wavelet.band_energy(wavelet.split_bands(coeffs, 16, 2))
    return energy.groupBy("split", "channel", "band").agg(F.count(F.lit(1)).alias("n_patches"), rnd(F.avg("energy")).alias("mean_energy"))


# Published analysis taps, so that the oracles owe nothing to the code they check.
_BIOR44 = (
    [0.0, 0.03782845550726404, -0.023849465019556843, -0.11062440441843718, 0.37740285561283066,
     0.8526986790088938, 0.37740285561283066, -0.11062440441843718, -0.023849465019556843, 0.03782845550726404],
    [0.0, -0.06453888262869706, 0.04068941760916406, 0.41809227322161724, -0.7884856164055829,
     0.41809227322161724, 0.04068941760916406, -0.06453888262869706, 0.0, 0.0],
)
_DB4 = (
    [-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
     -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965],
    [-0.2303778133088965, 0.7148465705529157, -0.6308807679298589, -0.027983769416859854,
     0.18703481171909309, 0.030841381835560764, -0.0328830116668852, -0.010597401785069032],
)
_REST = {
    "reflect": "list_reverse(x)", "symmetric": "list_reverse(x)", "periodization": "x",
    "zero": "list_transform(x, lambda v: 0.0::double)", "constant": "list_transform(x, lambda v: x[len(x)])",
}


def _list_sql(values) -> str:
    return "[" + ", ".join(f"{v!r}::double" for v in values) + "]"


def _dwt_sql(taps, levels, mode) -> str:
    """The signal and its continuation, filtered around the circle and halved level by level; the first half of every band stays."""
    n = len(taps[0])
    part = lambda w, a: f"list_transform(range(0, len({a}) // 2), lambda n: list_sum(list_transform(range(0, {n}), lambda k: {_list_sql(w)}[k + 1] * {a}[(2 * (n + {(n - 2) // 2 // 2}) + k - {n - 2} + len({a})) % len({a}) + 1])))"
    ctes = [f"l0 as (select vec_id, channel, list_concat(x, {_REST[mode]}) as a0 from windows4)"]
    for j in range(1, levels + 1):
        ctes.append(f"l{j} as (select *, {part(taps[0], f'a{j - 1}')} as a{j}, {part(taps[1], f'a{j - 1}')} as d{j} from l{j - 1})")
    out = f"a{levels}[1:len(a{levels}) // 2]"
    for j in range(levels, 0, -1):
        out = f"list_concat({out}, d{j}[1:len(d{j}) // 2])"
    return ",\n".join([*ctes, f"c as (select vec_id, channel, {out} as c from l{levels})"])


def _dwt_query(name, wave, levels, mode, taps, as_mode=None):
    sql = f"""with {X.C}, {_dwt_sql(taps, levels, as_mode or mode)}
select vec_id, channel::int as channel, k::int as k, {sql_rnd('c[k + 1]')} as c from c, unnest(range(0, 16)) as r(k)"""

    @query(name, sql)
    def _(T):
        got = wavelet.dwt(T.windows4, 16, wave, levels, mode)
        return got.select("vec_id", "channel", F.posexplode("coeffs").alias("k", "c")).select("vec_id", "channel", "k", rnd("c").alias("c"))


_dwt_query("wavelet_dwt_bior_reflect", "bior4.4", 2, "reflect", _BIOR44)
_dwt_query("wavelet_dwt_bior_symmetric", "bior4.4", 1, "symmetric", _BIOR44)
_dwt_query("wavelet_dwt_bior_zero", "bior4.4", 3, "zero", _BIOR44)
_dwt_query("wavelet_dwt_bior_constant", "bior4.4", 2, "constant", _BIOR44)
_dwt_query("wavelet_dwt_db4_falls_back", "db4", 2, "reflect", _DB4, "periodization")


@query("wavelet_dwt_haar", f"""with {X.C}, patches as (select vec_id, channel, x from windows4), {HAAR2},
c as (select vec_id, channel, list_concat(a2, c2, c1) as c from d2)
select vec_id, channel::int as channel, k::int as k, {sql_rnd('c[k+1]')} as c from c, unnest(range(0, 16)) as r(k)""")
def _(T):
    got = wavelet.dwt(T.windows4, 16, "haar", 2, "reflect")
    return got.select("vec_id", "channel", F.posexplode("coeffs").alias("k", "c")).select("vec_id", "channel", "k", rnd("c").alias("c"))


@query("wavelet_inverse_round_trip", f"""with {X.SIGNALS}, {X.C} select vec_id, channel::int as channel, t::int as t, {sql_rnd('v')} as v from samples4""")
def _(T):
    there = wavelet.dwt(T.windows4, 16, "bior4.4", 3, "reflect").drop("x")
    back = wavelet.idwt(there, 16, "bior4.4", 3, "reflect")
    return back.select("vec_id", "channel", F.posexplode("x").alias("t", "v")).select("vec_id", "channel", "t", rnd("v").alias("v"))


@query("wavelet_band_energy", f"""with {X.C}, patches as (select vec_id, channel, p::int as patch, x[p*8+1:p*8+8] as x from windows4, unnest(range(0, 2)) as u(p)), {HAAR2},
e as (select vec_id, channel, patch, unnest(['A2','D2','D1']) as band, unnest([a2, c2, c1]) as c from d2)
select vec_id, channel::int as channel, patch, band, {sql_rnd('list_avg(list_transform(c, lambda v: v*v))', 8)} as energy from e""")
def _(T):
    patches = windowing.patchify(T.windows4, 8, 2)
    got = wavelet.band_energy(wavelet.split_bands(wavelet.dwt(patches, 8, "haar", 2, "periodization"), 8, 2))
    return got.select("vec_id", "channel", "patch", "band", rnd("energy", 8).alias("energy"))


@query("wavelet_pooled_energy", f"""with {X.C}, patches as (select vec_id, x from embedded), {HAAR2},
b as (select vec_id, unnest(['A2','D2','D1']) as band, unnest([a2, c2, c1]) as c from d2)
select vec_id, band, s::int as patch, {sql_rnd('list_avg(list_transform(c[(s*len(c))//6+1:ceil((s+1)*len(c)/6.0)::int], lambda v: v*v))', 8)} as energy from b, unnest(range(0, 6)) as u(s)""")
def _(T):
    bands = wavelet.split_bands(wavelet.dwt(T.embedded.select("vec_id", "x"), 64, "haar", 2, "periodization"), 64, 2)
    return wavelet.pooled_energy(bands, 6).select("vec_id", "band", "patch", rnd("energy", 8).alias("energy"))


def _stack_sql():
    lo, hi = _DB4
    off = (16 - len(lo)) // 2 - 8
    kept = (64 + 16 - 16) // 2 + 1
    taps = sql_values("taps", ["k", "lo", "hi"], [(k + off, float(a), float(b)) for k, (a, b) in enumerate(zip(lo, hi))])
    step = lambda src, w: f"""select s.vec_id, i.i, coalesce(sum(x.v * t.{w}), 0) as v from (select distinct vec_id from emb) s, unnest(range(0, 64)) as i(i), taps t
  left join {src} x on x.vec_id = s.vec_id and x.i = ((i.i * {kept}) // 64) * 2 + t.k group by 1, 2"""
    return f"""with {X.C}, {taps}, dd1 as ({step('emb', 'hi')}), aa1 as ({step('emb', 'lo')}), dd2 as ({step('aa1', 'hi')}), aa2 as ({step('aa1', 'lo')})
select vec_id, 'D1' as band, i::int as i, {sql_rnd('v')} as v from dd1 union all select vec_id, 'D2', i::int, {sql_rnd('v')} from dd2 union all select vec_id, 'A', i::int, {sql_rnd('v')} from aa2"""


@query("wavelet_stack_upsampled", _stack_sql())
def _(T):
    got = wavelet.dwt_stack(T.embedded.select("vec_id", "x"), 64, "db4", 2, 16)
    return got.select("vec_id", "band", F.posexplode("x").alias("i", "v")).select("vec_id", "band", "i", rnd("v").alias("v"))


@query("wavelet_block_statistics", f"""with {X.C}, b as (select vec_id, i // 24 as block, v from (select vec_id, i, v from emb union all select vec_id, 64 + k, x[64] from embedded, unnest(range(0, 8)) as u(k))),
m as (select vec_id, block, avg(v) as m, sum(v*v) as p from b group by 1, 2),
j as (select b.vec_id, b.block, v - m as d, v*v / greatest(p, 1e-6::double) as share, p from b join m using (vec_id, block))
select vec_id, block::int as block, {sql_rnd('ln(sqrt(greatest(max(p) / 24, 1e-6::double)))')} as log_rms, {sql_rnd('-sum(share * ln(greatest(share, 1e-6::double))) / ln(24::double)')} as entropy,
 {sql_rnd('ln(1 + greatest(avg(d*d*d*d) / (greatest(avg(d*d), 1e-6::double) ** 2), 0))')} as kurtosis from j group by 1, 2""")
def _(T):
    got = wavelet.block_stats(T.embedded.select("vec_id", "x"), 24)
    return got.select("vec_id", "block", *[rnd(c).alias(c) for c in ("log_rms", "entropy", "kurtosis")])


# -- spectral ---------------------------------------------------------------------

FS = 128.0
_BANDS_SQL = sql_values("bands", ["band", "lo", "hi"], [(b, lo, hi) for b, (lo, hi) in spectral.BANDS.items()])


@query("spectral_band_filter", f"""with {X.C}, {_BANDS_SQL},
bins as (select band, k from bands, unnest(range(0, 32)) as r(k) where k * {FS}::double / 64 >= lo and k * {FS}::double / 64 < hi),
kern as (select band, d, 2.0::double / 64 * sum(cos(2 * pi() * k * d / 64)) as g from bins, unnest(range(-63, 64)) as r(d) group by 1, 2)
select e.vec_id, kern.band, (e.i + kern.d)::int as i, {sql_rnd('sum(e.v * kern.g)')} as v from emb e join kern on e.i + kern.d between 0 and 63 group by 1, 2, 3""")
def _(T):
    got = spectral.band_filter(T.embedded, ["vec_id"], FS)
    return got.select("vec_id", "band", F.posexplode("x").alias("i", "v")).select("vec_id", "band", "i", rnd("v").alias("v"))


@query("spectral_band_coefficients", f"""with {X.C}, {_BANDS_SQL},
bins as (select band, k from bands, unnest(range(0, 17)) as r(k) where k * {FS}::double / 32 >= lo and k * {FS}::double / 32 < hi
  union all select band, 1 from bands where not exists (select 1 from unnest(range(0, 17)) as r(k) where k * {FS}::double / 32 >= lo and k * {FS}::double / 32 < hi)),
seg as (select vec_id, i // 32 as s, i % 32 as n, v * (0.5::double - 0.5::double * cos(2 * pi() * (i % 32) / 32)) as v from emb),
bk as (select band, k, row_number() over (partition by band order by k) - 1 as b, count(*) over (partition by band) as nb from bins)
select vec_id, band, (s * nb + b)::int as obs, {sql_rnd('sum(v * cos(2 * pi() * k * n / 32))')} as re, {sql_rnd('-sum(v * sin(2 * pi() * k * n / 32))')} as im from seg, bk group by vec_id, band, s, nb, b""")
def _(T):
    got = spectral.band_coefficients(T.embedded, ["vec_id"], FS)
    z = F.posexplode(F.arrays_zip("re", "im")).alias("obs", "z")
    return got.select("vec_id", "band", z).select("vec_id", "band", "obs", rnd("z.re").alias("re"), rnd("z.im").alias("im"))


# -- patch scores and masks --------------------------------------------------------

_ENERGY = f"""{X.C}, patches as (select vec_id, channel, p::int as patch, x[p*4+1:p*4+4] as x from windows4, unnest(range(0, 4)) as u(p)), {HAAR2},
en as (select vec_id, channel, patch, unnest(['A2','D2','D1']) as band, unnest([list_avg(list_transform(a2, lambda v: v*v)), list_avg(list_transform(c2, lambda v: v*v)), list_avg(list_transform(c1, lambda v: v*v))]) as energy from d2),
le as (select *, ln(1 + energy) as e, (vec_id + channel) % 4 <> 0 as good from en),
st as (select vec_id, band, avg(e) as m, greatest(stddev_samp(e), 1e-6::double) as s from le group by 1, 2),
zz as (select vec_id, channel, patch, good, (e - m) / s * case band when 'A2' then 0.5::double when 'D2' then 1.0::double else 1.5::double end as z from le join st using (vec_id, band)),
pc as (select vec_id, channel, patch, good, avg(z) as z from zz group by 1, 2, 3, 4),
scores as (select vec_id, patch, sum(case when good then z else 0 end) / greatest(count_if(good), 1) as score from pc group by 1, 2)"""


def _scores(T):
    good = F.pmod(F.col("vec_id") + F.col("channel"), F.lit(4)) != 0
    patches = windowing.patchify(T.windows4.withColumn("good", good), 4, 2)
    energy = wavelet.band_energy(wavelet.split_bands(wavelet.dwt(patches, 4, "haar", 2, "periodization"), 4, 2))
    return rank.patch_scores(energy, weights={"A2": 0.5, "D2": 1.0, "D1": 1.5}, keys=("vec_id",))


@query("mask_patch_scores", f"with {_ENERGY} select vec_id, patch, {sql_rnd('score')} as score from scores")
def _(T):
    return _scores(T).select("vec_id", "patch", rnd("score").alias("score"))


def _mask_sql(mix, size, src):
    return f"""mixed as (select vec_id, patch, {mix} as mix, count(*) over (partition by vec_id) as s from {src}),
ranked as (select *, row_number() over (partition by vec_id order by mix desc, patch) as rn from mixed)
select vec_id, patch::int as patch, rn <= {size} as masked from ranked"""


@query("mask_importance", f"""with {_ENERGY}, rs as (select vec_id, patch, round(score, 9) as score from scores),
{_mask_sql("0.6::double * (score - avg(score) over (partition by vec_id)) / greatest(stddev_samp(score) over (partition by vec_id), 1e-6::double) + 0.4::double * " + sql_uniform(5, 'vec_id', 'patch'), 'greatest(1, round_even(s * 0.625::double, 0))', 'rs')}""")
def _(T):
    scores = _scores(T).withColumn("score", F.round("score", 9))
    return rank.importance_mask(scores, 0.625, 0.6, 5, ("vec_id",)).select("vec_id", "patch", "masked")


@query("mask_random", f"""with {X.C}, p as (select vec_id, unnest(range(0, 16)) as patch from embedded),
{_mask_sql(sql_uniform(6, 'vec_id', 'patch'), 'greatest(1, round_even(s * 0.15625::double, 0))', 'p')}""")
def _(T):
    p = T.embedded.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("patch"))
    return rank.random_mask(p, 0.15625, 6, ("vec_id",)).select("vec_id", "patch", "masked")


@query("mask_random_shared", f"""with {X.C}, p as (select vec_id, unnest(range(0, 16)) as patch from embedded),
{_mask_sql(sql_uniform(6, 'patch'), 'floor(s * 0.3::double)', 'p')}""")
def _(T):
    p = T.embedded.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("patch"))
    return rank.shared_random_mask(p, 0.3, 6, ("vec_id",)).select("vec_id", "patch", "masked")


_TOKENS = f"""{X.C}, tok as (select vec_id, i // 4 as l, i % 4 as d, v from emb),
dft as (select vec_id, d, k, sqrt(sum(v * cos(2 * pi() * k * l / 16)) ** 2 + sum(v * sin(2 * pi() * k * l / 16)) ** 2) as mag from tok, unnest(range(0, 9)) as r(k) group by 1, 2, 3),
imp as (select vec_id, k, sum(mag) as s from dft group by 1, 2),
pos as (select p as patch, p * 8.0::double / 15 as x from unnest(range(0, 16)) as r(p)),
sc as (select a.vec_id, patch, a.s * (1 - (x - floor(x))) + coalesce(b.s, 0) * (x - floor(x)) as score from pos join imp a on a.k = floor(x) left join imp b on b.vec_id = a.vec_id and b.k = floor(x) + 1)"""


def _token_scores(T):
    tok = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(F.col("x"), i * 4 + 1, 4))
    return spectral.token_spectrum_scores(T.embedded.select("vec_id", tok.alias("x")), ["vec_id"])


@query("mask_spectral_scores", f"with {_TOKENS} select vec_id, patch::int as patch, {sql_rnd('score')} as score from sc")
def _(T):
    return _token_scores(T).select("vec_id", "patch", rnd("score").alias("score"))


@query("mask_spectral", f"""with {_TOKENS}, rs as (select vec_id, patch, round(score, 9) as score from sc),
{_mask_sql("0.6::double * score + 0.4::double * " + sql_uniform(8, 'vec_id', 'patch'), 'floor(s * 0.3::double)', 'rs')}""")
def _(T):
    return rank.spectral_mask(_token_scores(T).withColumn("score", F.round("score", 9)), 0.3, 0.6, 8, ("vec_id",)).select("vec_id", "patch", "masked")


# -- augmentation and corruption -----------------------------------------------------


@query("augment_noise_and_scale", f"""with {X.C}
select vec_id, i::int as i, {sql_rnd(f"case when {sql_uniform('4:on', 'vec_id')} > 0.5::double then v else (v + 0.01::double * {sql_normal('4:noise', 'vec_id', 'i')}) * (0.8::double + (1.2::double - 0.8::double) * {sql_uniform('4:scale', 'vec_id')}) end")} as v from emb""")
def _(T):
    got = augment.augment(T.embedded, 4, keys=("vec_id",), prob=0.5, noise_std=0.01, scale_range=(0.8, 1.2))
    return got.select("vec_id", F.posexplode("x").alias("i", "v")).select("vec_id", "i", rnd("v").alias("v"))


@query("augment_time_stretch", f"""with {X.C}, f as (select vec_id, x, floor(64 * (0.8::double + (vec_id % 5) * 0.1::double) + 1e-9)::int as n from embedded),
g as (select vec_id, x, n, i, greatest((i + 0.5::double) * 64 / n - 0.5::double, 0) as p from f, unnest(range(0, 80)) as r(i) where i < n),
s as (select vec_id, n, i, x[least(floor(p)::int, 63) + 1] * (1 - (p - floor(p))) + x[least(floor(p)::int + 1, 63) + 1] * (p - floor(p)) as v from g),
c as (select vec_id, case when n > 64 then i - (n - 64) // 2 else i end as i, v from s)
select e.vec_id, e.i::int as i, {sql_rnd('coalesce(c.v, 0)')} as v from emb e left join c on c.vec_id = e.vec_id and c.i = e.i""")
def _(T):
    got = augment.time_stretch(T.embedded, 0.8 + (F.col("vec_id") % 5) * 0.1 + 1e-11)
    return got.select("vec_id", F.posexplode("x").alias("i", "v")).select("vec_id", "i", rnd("v").alias("v"))


_KINDS = "['noise','drift','saturation','bad_channel','dropout']"
_CORR = f"""{X.C}, k as (select vec_id, case when {sql_uniform('9:on', 'vec_id')} > 0.7::double then 'none' else ({_KINDS})[least(floor({sql_uniform('9:kind', 'vec_id')} * 5)::int, 4) + 1] end as kind,
  {sql_uniform('9:level', 'vec_id')} as sev from embedded),
lv as (select vec_id, kind, case when kind = 'none' then 0 else sev end as level from k)"""


def _corrupted(T, **kw):
    packed = layout.pack_channels(T.windows4, ["vec_id"])
    return augment.corrupt(packed, 9, keys=("vec_id",), prob=0.7, **kw)


@query("corrupt_kind_and_level", f"with {_CORR} select vec_id, kind, {sql_rnd('level')} as level, {sql_rnd('greatest(least(1 - level, 1), 0)')} as target from lv")
def _(T):
    got = augment.reliability_target(_corrupted(T))
    return got.select("vec_id", "kind", rnd("level").alias("level"), rnd("target").alias("target"))


@query("corrupt_saturation_dropout", f"""with {_CORR},
q as (select vec_id, kind, level, greatest(least(0.999::double + (0.5::double - 0.999::double) * level, 0.9999::double), 0.01::double) as q, greatest(1, round_even(16 * (0.5::double * level), 0)) as n from lv where kind in ('saturation', 'dropout', 'none')),
th as (select q.*, list_sort(list_transform(x, lambda v: abs(v))) as s from q join embedded using (vec_id)),
t2 as (select *, s[floor(q * 63)::int + 1] + (q * 63 - floor(q * 63)) * (s[ceil(q * 63)::int + 1] - s[floor(q * 63)::int + 1]) as thr, least(floor({sql_uniform('9:start', 'vec_id')} * greatest(16 - n, 1)), greatest(16 - n, 1) - 1) as st from th)
select vec_id, kind, channel::int as channel, t::int as t, {sql_rnd("case when kind = 'saturation' then greatest(least(v, thr), -thr) when kind = 'dropout' and t >= st and t < st + n then 0 else v end")} as v from t2 join samples4 using (vec_id)""")
def _(T):
    got = _corrupted(T).filter(F.col("kind").isin("saturation", "dropout", "none"))
    return got.select("vec_id", "kind", F.posexplode("x").alias("channel", "c")).select("vec_id", "kind", "channel", F.posexplode("c").alias("t", "v")).select("vec_id", "kind", "channel", "t", rnd("v").alias("v"))


_BAD_RANK = f"row_number() over (partition by vec_id, t order by {sql_digest('9:bad', 'vec_id', 'channel')}, channel)"


@query("corrupt_random_kinds", f"""with {_CORR},
st as (select vec_id, greatest(avg(v * v), 1e-12::double) as power, greatest(stddev_samp(v), 1e-6::double) as sd from samples4 group by 1),
j as (select s.*, lv.kind, lv.level, st.power, st.sd, {_BAD_RANK.replace('vec_id', 's.vec_id').replace('channel', 's.channel').replace('by s.vec_id, t', 'by s.vec_id, s.t')} as rk from samples4 s join lv on lv.vec_id = s.vec_id join st on st.vec_id = s.vec_id where lv.kind in ('noise', 'drift', 'bad_channel')),
y as (select vec_id, kind, channel, t, case kind
  when 'noise' then v + {sql_normal('9:noise', 'vec_id', 'channel', 't')} * sqrt(power / pow(10.0::double, (20 + (-5 - 20) * level) / 10.0))
  when 'drift' then v + (0.1::double + (3.0::double - 0.1::double) * level) * sd * sin(6.283::double * (0.5::double + 2.0::double * {sql_uniform('9:freq', 'vec_id', 'channel')}) * t / 15.0 + {sql_uniform('9:phase', 'vec_id', 'channel')} * 6.283::double)
  else case when rk <= round_even(4 * 0.5::double * level, 0) then {sql_normal('9:bad', 'vec_id', 'channel', 't')} * 1e-3::double else v end end as v from j)
select vec_id, kind, channel::int as channel, {sql_rnd('sum(v)')} as s from y group by 1, 2, 3""")
def _(T):
    got = _corrupted(T).filter(F.col("kind").isin("noise", "drift", "bad_channel"))
    return got.select("vec_id", "kind", F.posexplode("x").alias("channel", "c")).select("vec_id", "kind", "channel", rnd(A.total(F.col("c"))).alias("s"))
