"""Channel operators: re-referencing, geometry, surface Laplacian, blending.

A montage has at most a few hundred channels, so anything per montage (including
a channels x channels table) is bounded; recordings refer to montages by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import electrodes
from ..functions import hashing as H

STANDARD_VIEWS = ("original", "common_average", "linked_mastoids")
HARD_VIEWS = ("left_ear", "right_ear", "left_mastoid", "right_mastoid", "random_channel")
# Electrodes that serve as single references, in order of preference.
SIDE_LABELS = {
    "left_mastoid": ("M1", "TP9"), "right_mastoid": ("M2", "TP10"), "left_ear": ("A1",), "right_ear": ("A2",),
}
OPERATOR_SCHEMA = "operator_id string, out_ch int, in_ch int, w double"


# -- re-referencing ------------------------------------------------------------

#: What many rows share (a hash of montages, a montage of windows) is dealt to so many groups, so that it is no single task.
_SHARES = 32


def reference_channels(montage: DataFrame, views=STANDARD_VIEWS + HARD_VIEWS, car_min: int = 32, seed=0) -> DataFrame:
    """Per (montage, view): tier, the channel positions averaged into the
    reference (``ref``, empty for the original) and ``skipped`` with the reason.

    ``montage(montage_id, channel, pos, good, derivation_type)``.
    """
    named = montage.withColumn("__c", electrodes.canonical_name(F.col("channel")))
    labels = sorted({l for ls in SIDE_LABELS.values() for l in ls})
    firsts = [F.min(F.when(F.col("__c") == l, F.col("pos"))).alias(f"__{l}") for l in labels]
    drawn = F.min_by("pos", F.when(F.col("good"), H.digest(seed, "montage_id", "channel")))
    m = named.groupBy("montage_id").agg(
        F.sort_array(F.collect_list("pos")).alias("positions"),
        F.sort_array(F.collect_list(F.when(F.col("good"), F.col("pos")))).alias("good"),
        F.min("derivation_type").alias("derivation_type"),
        drawn.alias("__drawn"), *firsts,
    )
    side = {v: F.coalesce(*[F.col(f"__{l}") for l in ls]) for v, ls in SIDE_LABELS.items()}
    masts = side["left_mastoid"].isNotNull() & side["right_mastoid"].isNotNull()
    ears = side["left_ear"].isNotNull() & side["right_ear"].isNotNull()
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    refs = {
        "original": F.array().cast("array<int>"),
        "common_average": F.when(F.size("good") >= car_min, F.col("good")),
        "linked_mastoids": F.when(masts, F.array(side["left_mastoid"], side["right_mastoid"])).when(ears, F.array(side["left_ear"], side["right_ear"])),
        "random_channel": one(F.when(F.size("good") > 0, F.col("__drawn"))),
        **{v: one(c) for v, c in side.items()},
    }
    why = {
        "common_average": F.concat(F.size("good").cast("string"), F.lit(f" good channels < {car_min}")),
        "linked_mastoids": F.lit("no mastoid or ear pair"),
        "random_channel": F.lit("no good channels"),
        **{v: F.lit(f"none of {', '.join(ls)} present") for v, ls in SIDE_LABELS.items()},
    }
    bipolar = F.lower(F.coalesce("derivation_type", F.lit(""))).startswith("bipolar")

    def entry(v):
        if v not in refs:
            raise ValueError(f"unknown reference view {v!r}")
        ref = refs[v] if v == "original" else F.when(~bipolar, refs[v])
        reason = F.lit(None).cast("string") if v == "original" else F.when(bipolar, "bipolar montage").when(refs[v].isNull(), why[v])
        return F.struct(F.lit(v).alias("view"), F.lit("hard" if v in HARD_VIEWS else "standard").alias("tier"), ref.alias("ref"), reason.alias("skipped"))

    return m.select("montage_id", "positions", F.explode(F.array(*[entry(v) for v in views])).alias("__v")).select("montage_id", "positions", "__v.*")


def reference_operator(references: DataFrame) -> DataFrame:
    """``operator`` rows ``(operator_id, montage_id, view, out_ch, in_ch, w)``: identity
    minus the mean of the reference channels."""
    usable = references.filter(F.col("skipped").isNull())
    grid = usable.withColumn("out_ch", F.explode("positions")).withColumn("in_ch", F.explode("positions"))
    share = F.when(F.array_contains("ref", F.col("in_ch")), 1.0 / F.size("ref")).otherwise(0.0)
    w = F.when(F.col("out_ch") == F.col("in_ch"), 1.0).otherwise(0.0) - share
    return grid.select(F.concat_ws("/", "montage_id", "view").alias("operator_id"), "montage_id", "view", "out_ch", "in_ch", w.alias("w"))


def reference_views(packed: DataFrame, references: DataFrame, requested: DataFrame | None = None, keys=("window_id",)) -> DataFrame:
    """Re-referenced copies of channel-major windows ``(keys, montage_id, x)``.

    Subtracting a mean of rows needs no channel matrix. ``requested(keys, view)``
    limits the views per window; a window whose requested views are all
    impossible keeps its original.
    """
    keys = list(keys)
    usable = references.filter(F.col("skipped").isNull()).select("montage_id", "view", "tier", "ref")
    if requested is None:
        wanted = packed.join(usable, "montage_id")
    else:
        hit = packed.select(*keys, "montage_id").join(requested, keys).join(usable, ["montage_id", "view"])
        none = packed.select(*keys, "montage_id").join(hit.select(*keys).distinct(), keys, "left_anti").select(
            *keys, "montage_id", F.lit("original").alias("view"), F.lit("standard").alias("tier"), F.array().cast("array<int>").alias("ref"))
        chosen = hit.select(*keys, "montage_id", "view", "tier", "ref").unionByName(none)
        wanted = packed.join(chosen.drop("montage_id"), keys)
    x = F.col("x")
    width = F.size(F.get(x, F.lit(0)))
    summed = F.aggregate("ref", F.array_repeat(F.lit(0.0), width), lambda a, p: F.zip_with(a, F.get(x, p), lambda u, v: u + v))

    def shift(s):
        return F.transform(x, lambda row: F.zip_with(row, s, lambda v, r: v - r / F.size("ref")))

    return wanted.withColumn("x", F.when(F.size("ref") == 0, x).otherwise(A.let(summed, shift))).drop("ref")


def sample_views(windows: DataFrame, n: int = 2, hard_prob: float = 0.2, standard=STANDARD_VIEWS, hard=HARD_VIEWS, seed=0, key: str = "window_id") -> DataFrame:
    """``n`` view names per window; each is a hard one with probability ``hard_prob``."""
    slot = windows.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    pick = lambda names, tag: F.element_at(F.array(*[F.lit(v) for v in names]), H.choice(H.uniform(f"{seed}:{tag}", key, "slot"), len(names)) + 1)
    view = pick(standard, "standard")
    if hard:
        view = F.when(H.uniform(f"{seed}:tier", key, "slot") < hard_prob, pick(hard, "hard")).otherwise(view)
    return slot.withColumn("view", view)


# -- applying operators ----------------------------------------------------------

def pack_operator(operator: DataFrame, key: str = "operator_id") -> DataFrame:
    """One row per operator holding its sparse entries (at most channels squared)."""
    return operator.groupBy(key).agg(F.collect_list(F.struct("out_ch", "in_ch", "w")).alias("__e")).select(
        key, *[F.col(f"__e.{c}").alias(f"__{c}") for c in ("out_ch", "in_ch", "w")]
    )


#: Numbers of windows that are multiplied at once.
_NUMBERS = 1 << 19


def _flat(column: pa.Array):
    """Rows of a list array: first item of each, sizes, and all items."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return ends[:-1], np.diff(ends), column.values


def _multiplier(key: str, names: list[str], n_out: int | None):
    """Windows of one operator and shape share a matrix; Arrow arrays are read and written as they are, a bounded number of windows at a time."""

    def run(batches):
        for batch in batches:
            of = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            first, c, rows = _flat(of["x"])
            at, t, values = _flat(rows)
            values = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            lengths = np.where(c > 0, t[np.minimum(first, max(len(t) - 1, 0))] if len(t) else 0, 0)
            operator = of[key].dictionary_encode().indices.to_numpy()
            kinds, which = np.unique(np.stack([operator, c, lengths], axis=1), axis=0, return_inverse=True)
            for k, (_, n, length) in enumerate(kinds.tolist()):
                alike = np.flatnonzero(which.ravel() == k)
                o, i, w = (of[f"__{e}"][int(alike[0])].values.to_numpy() for e in ("out_ch", "in_ch", "w"))
                matrix = np.zeros((n_out or max(n, int(o.max()) + 1), n))
                matrix[o, i] = w
                out = len(matrix)
                step = max(1, _NUMBERS // max(n * length, out * length, 1))
                for some in (alike[b : b + step] for b in range(0, len(alike), step)):
                    inner = first[some, None] + np.arange(n)
                    if (t[inner] != length).any():
                        raise ValueError("channels of one window differ in length")
                    y = matrix @ values[at[inner][:, :, None] + np.arange(length)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) * out + 1, dtype=np.int32) * length, pa.int32()), pa.array(y.reshape(-1)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * out, pa.int32()), lists)
                    taken = pa.array(some)
                    yield pa.RecordBatch.from_arrays([lists if name == "x" else of[name].take(taken) for name in names], names)

    return run


def apply_operator(packed: DataFrame, operator: DataFrame, key: str = "operator_id", n_out: int | None = None) -> DataFrame:
    """``y = W x`` for channel-major windows, one product per operator and piece of a batch.

    The result has ``n_out`` channels, by default as many as the window; an output
    without any entry is zero. The join is on the operator id; Spark broadcasts
    the operators when their measured size allows and shuffles otherwise.
    """
    joined = packed.join(pack_operator(operator, key), key)
    fields = [f for f in joined.schema if f.name not in ("__out_ch", "__in_ch", "__w")]
    wide = T.ArrayType(T.ArrayType(T.DoubleType()))
    schema = T.StructType([T.StructField("x", wide) if f.name == "x" else f for f in fields])
    return joined.mapInArrow(_multiplier(key, schema.names, n_out), schema)


def blend_operator(operators: list[tuple[DataFrame, float]], key: str = "operator_id") -> DataFrame:
    """``I + sum_k g_k L_k`` as one operator, so windows are multiplied once."""
    parts = [op.select(key, "out_ch", "in_ch", (F.col("w") * float(g)).alias("w")) for op, g in operators]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    ids = union.select(key, F.explode(F.array("out_ch", "in_ch")).alias("c")).distinct()
    eye = ids.select(key, F.col("c").alias("out_ch"), F.col("c").alias("in_ch"), F.lit(1.0).alias("w"))
    return union.unionByName(eye).groupBy(key, "out_ch", "in_ch").agg(F.sum("w").alias("w"))


def spatial_blend(packed: DataFrame, geometric: DataFrame, surface: DataFrame, gates=(0.1, 0.1), key: str = "operator_id") -> DataFrame:
    return apply_operator(packed, blend_operator([(geometric, gates[0]), (surface, gates[1])], key), key)


# -- geometry ----------------------------------------------------------------------

def sphere(montage: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Centre each montage and project it radially onto the unit sphere."""
    per = W.partitionBy("montage_id")
    c = montage.withColumns({f"__{a}": F.col(a) - F.avg(a).over(per) for a in "xyz"})
    r = F.sqrt(sum((F.col(f"__{a}") * F.col(f"__{a}") for a in "xyz"), F.lit(0.0)))
    c = c.withColumn("__r", r)
    unit = lambda a: F.when(F.col("__r") > eps, F.col(f"__{a}") / F.col("__r")).otherwise(0.0)
    return c.withColumns({a: unit(a) for a in "xyz"}).drop("__x", "__y", "__z", "__r")


def _pairs(montage: DataFrame, cols) -> DataFrame:
    """Channel pairs of one montage (bounded by its square)."""
    side = lambda s: montage.select("montage_id", *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side("i").join(side("j"), "montage_id")


def pair_distance(montage: DataFrame) -> DataFrame:
    """Cosine and Euclidean distance of every ordered channel pair."""
    p = _pairs(montage, ["pos", "x", "y", "z"])
    dot = sum((F.col(f"{a}_i") * F.col(f"{a}_j") for a in "xyz"), F.lit(0.0))
    d2 = sum((F.pow(F.col(f"{a}_i") - F.col(f"{a}_j"), 2) for a in "xyz"), F.lit(0.0))
    return p.select("montage_id", F.col("pos_i").alias("ch_i"), F.col("pos_j").alias("ch_j"),
                    F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)).alias("cosine"), F.sqrt(d2).alias("distance"))


def geometric_graph(montage: DataFrame, sigma: float = 0.3, self_loops: bool = True) -> DataFrame:
    """Affinity ``exp(-d^2 / sigma^2)``; edges of bad channels are zero."""
    p = _pairs(montage, ["pos", "x", "y", "z", "good"])
    d2 = sum((F.pow(F.col(f"{a}_i") - F.col(f"{a}_j"), 2) for a in "xyz"), F.lit(0.0))
    off = F.lit(True) if self_loops else F.col("pos_i") != F.col("pos_j")
    value = F.when(F.col("good_i") & F.col("good_j") & off, F.exp(-d2 / (sigma * sigma))).otherwise(0.0)
    return p.select("montage_id", F.col("pos_i").alias("ch_i"), F.col("pos_j").alias("ch_j"), value.alias("value"))


def graph_laplacian(edges: DataFrame, eps: float = 1e-8) -> DataFrame:
    """``I - D^-1/2 A D^-1/2`` of a symmetric graph that lists both directions of an
    edge; isolated channels keep the identity row."""
    def inverse_root(side):
        d = F.sum("value").over(W.partitionBy("montage_id", side))
        return F.when(d > eps, 1.0 / F.sqrt(d)).otherwise(0.0)

    e = edges.withColumn("__i", inverse_root("ch_i")).withColumn("__j", inverse_root("ch_j"))
    eye = F.when(F.col("ch_i") == F.col("ch_j"), 1.0).otherwise(0.0)
    return e.select("montage_id", "ch_i", "ch_j", (eye - F.col("__i") * F.col("value") * F.col("__j")).alias("value"))


def as_operator(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("montage_id").cast("string").alias("operator_id"), F.col("ch_i").alias("out_ch"), F.col("ch_j").alias("in_ch"), F.col("value").alias("w"))


def combine_graphs(a: DataFrame, b: DataFrame, l1: float, l2: float, keys=("montage_id",)) -> DataFrame:
    """Weighted sum of two edge tables; an edge missing on one side counts zero."""
    on = [*keys, "ch_i", "ch_j"]
    j = a.withColumnRenamed("value", "__a").join(b.withColumnRenamed("value", "__b"), on, "full")
    return j.select(*on, (l1 * F.coalesce("__a", F.lit(0.0)) + l2 * F.coalesce("__b", F.lit(0.0))).alias("value"))


def total_affinity(geo: DataFrame, dyn: DataFrame, montage: DataFrame, windows: DataFrame, l_geo: float = 1.0, l_dyn: float = 1.0, keys=("recording_id", "start")) -> DataFrame:
    """``l_geo * A_geo + l_dyn * A_dyn`` of every window as ``(keys, ch_i, ch_j, value)``, both directions, channels by position.

    ``geo(montage_id, ch_i, ch_j, value)`` lists both directions by montage position,
    ``dyn(keys, ch_i, ch_j, value)`` the upper triangle by channel name, ``windows(keys,
    montage_id)`` says which montage a window was recorded with and
    ``montage(montage_id, pos, channel)`` where a name stands in it; the same name may
    stand elsewhere in another montage. An edge that one side lacks counts zero there.
    A channel that its window's montage does not have is an error.

    The names of a statistic are few next to its windows, so the montage meets the
    edges by (montage, name); both graphs then add up in one aggregation.
    """
    keys = list(keys)
    share = F.xxhash64(*keys).bitwiseAND(F.lit(_SHARES - 1))
    windows = windows.select(*keys, "montage_id", share.alias("__share"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SHARES - 1).cast("long")))
    dealt = lambda table: table.withColumn("__share", every)
    at = ["montage_id", "__share"]
    wide = windows.join(dealt(geo.select("montage_id", "ch_i", "ch_j", "value")), at)
    wide = wide.select(*keys, "ch_i", "ch_j", (l_geo * F.col("value")).alias("value"))
    named = dyn.join(windows, keys)
    place = lambda side: dealt(montage.select("montage_id", F.col("channel").alias(side), F.col("pos").alias(f"__{side}")))
    named = named.join(place("ch_i"), [*at, "ch_i"], "left").join(place("ch_j"), [*at, "ch_j"], "left")

    def known(side):
        gone = F.raise_error(F.concat(F.lit("not in its window's montage: "), F.col(side).cast("string")))
        return F.coalesce(F.col(f"__{side}"), gone.cast("int"))

    i, j = known("ch_i"), known("ch_j")
    there = F.struct(i.alias("ch_i"), j.alias("ch_j"))
    both = F.when(i == j, F.array(there)).otherwise(F.array(there, F.struct(j.alias("ch_i"), i.alias("ch_j"))))
    near = named.select(*keys, F.explode(both).alias("e"), (l_dyn * F.col("value")).alias("value")).select(*keys, "e.ch_i", "e.ch_j", "value")
    return wide.unionByName(near).groupBy(*keys, "ch_i", "ch_j").agg(F.sum("value").alias("value"))


# -- spherical splines ---------------------------------------------------------------

def _hash_of(montage: DataFrame, decimals: int):
    """The aggregate behind ``montage_hash``."""
    own = [F.coalesce("derivation_type", F.lit(""))] if "derivation_type" in montage.columns else []
    part = F.concat_ws(":", F.lpad(F.col("pos").cast("string"), 6, "0"), "channel", *[F.format_number(F.round(F.col(a), decimals) + 0.0, decimals) for a in "xyz"], F.col("good").cast("string"), *own)
    return F.substring(F.sha1(F.encode(F.concat_ws("|", F.sort_array(F.collect_list(part))), "utf-8")), 1, 16).alias("montage_hash")


def montage_hash(montage: DataFrame, decimals: int = 4) -> DataFrame:
    """``(montage_id, montage_hash)`` over names, rounded coordinates, good pattern and,
    where the column is there, the derivation: a bipolar montage has no Laplacian."""
    return montage.groupBy("montage_id").agg(_hash_of(montage, decimals))


def _spline_terms(cos: np.ndarray, order: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, terms + 1, dtype=float)
    g = np.concatenate([[0.0], (2 * n + 1) / (n * (n + 1)) ** order]) / (4 * np.pi)
    h = np.concatenate([[0.0], -(2 * n + 1) / (n * (n + 1)) ** (order - 1)]) / (4 * np.pi)
    return np.polynomial.legendre.legval(cos, g), np.polynomial.legendre.legval(cos, h)


def _unit(xyz: np.ndarray) -> np.ndarray:
    c = xyz - xyz.mean(axis=0)
    r = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(r > 1e-8, c / np.maximum(r, 1e-8), 0.0)


def _fit(sphere_xyz, good, order, lam, terms):
    """Map from good-channel potentials to spline coefficients and its offset row."""
    g, _ = _spline_terms(np.clip(sphere_xyz[good] @ sphere_xyz[good].T, -1, 1), order, terms)
    n = len(g)
    system = np.block([[g + lam * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    inverse = np.linalg.inv(system)
    return inverse[:n, :n], inverse[n:, :n]


def _spline_job(montages: DataFrame, build, min_channels, order, lam, terms):
    """Build once per distinct montage hash, give every montage its rows.

    A montage travels as one row with its electrodes. No join may broadcast: tables
    that rows are exploded from look far smaller to the planner than they are.
    """
    fields = ["pos", "channel", "x", "y", "z", "good"] + (["derivation_type"] if "derivation_type" in montages.columns else [])
    packed = montages.groupBy("montage_id").agg(_hash_of(montages, 4), F.collect_list(F.struct(*fields)).alias("electrodes"))
    hashes = montage_hash(montages).filter(F.col("montage_hash").isNotNull())
    hashes = hashes.withColumn("share", F.xxhash64("montage_id").bitwiseAND(F.lit(_SHARES - 1))).repartition("montage_hash", "share")
    # One representative montage per hash; its rows go to every share that has the hash.
    needed = hashes.groupBy("montage_hash", "share").agg(F.min("montage_id").alias("montage_id"))
    chosen = needed.groupBy("montage_hash").agg(F.min("montage_id").alias("montage_id")).select("montage_id")
    distinct = packed.join(chosen.hint("shuffle_hash"), "montage_id", "left_semi")

    def one(electrodes):
        pdf = pd.DataFrame(list(electrodes)).sort_values("pos")
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        good = pdf["good"].to_numpy(bool) & (np.linalg.norm(xyz, axis=1) > 1e-8)
        bipolar = pdf["derivation_type"].astype(str).str.lower().str.startswith("bipolar").any() if "derivation_type" in pdf else False
        reason = "bipolar montage" if bipolar else "" if good.sum() >= min_channels else f"{int(good.sum())} usable electrodes < {min_channels}"
        if reason:
            return {"out_ch": [None], "in_ch": [None], "w": [None], "skipped": reason}
        m = build(_unit(xyz), good, order, lam, terms)
        pos = pdf["pos"].to_numpy()
        rows, cols = np.nonzero(m)
        return {"out_ch": pos[rows], "in_ch": pos[cols], "w": m[rows, cols], "skipped": None}

    def run(batches):
        for pdf in batches:
            for key, electrodes in zip(pdf["montage_hash"], pdf["electrodes"]):
                yield pd.DataFrame([{"montage_hash": key, **one(electrodes)}])

    built = distinct.select("montage_hash", "electrodes").mapInPandas(run, "montage_hash string, out_ch array<int>, in_ch array<int>, w array<double>, skipped string")
    shared = needed.drop("montage_id").join(built.hint("merge"), "montage_hash")
    every = hashes.join(shared.hint("merge"), ["montage_hash", "share"])
    cells = F.explode(F.arrays_zip("out_ch", "in_ch", "w")).alias("c")
    return every.select("montage_id", "montage_hash", "skipped", cells).select("montage_id", "montage_hash", "c.out_ch", "c.in_ch", "c.w", "skipped")


def _laplacian_matrix(s, good, order, lam, terms):
    coef, _ = _fit(s, good, order, lam, terms)
    _, h = _spline_terms(np.clip(s @ s[good].T, -1, 1), order, terms)
    out = np.zeros((len(s), len(s)))
    out[:, good] = h @ coef
    return out


def _interpolation_matrix(s, good, order, lam, terms):
    coef, offset = _fit(s, good, order, lam, terms)
    g, _ = _spline_terms(np.clip(s @ s[good].T, -1, 1), order, terms)
    out = np.zeros((len(s), len(s)))
    out[:, good] = g @ coef + offset
    out[good] = 0.0
    out[good, good] = 1.0
    return out


def surface_laplacian(montages: DataFrame, min_channels: int = 16, order: int = 4, lam: float = 1e-5, terms: int = 50) -> DataFrame:
    """Spherical-spline surface Laplacian per montage, as sparse operator rows.

    Bad channels and channels without coordinates have zero columns; a montage
    that is bipolar or too sparse gives one row with the reason in ``skipped``.
    """
    return _spline_job(montages, _laplacian_matrix, min_channels, order, lam, terms)


def interpolate_bad(montages: DataFrame, min_channels: int = 4, order: int = 4, lam: float = 1e-5, terms: int = 50) -> DataFrame:
    """Potential-domain interpolation: good rows are one-hot, bad rows spline weights."""
    return _spline_job(montages, _interpolation_matrix, min_channels, order, lam, terms)


def reference_invariance(operator: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Per montage: largest row sum relative to the largest weight."""
    rows = operator.filter(F.col("w").isNotNull()).groupBy("montage_id", "out_ch").agg(F.sum("w").alias("s"), F.max(F.abs("w")).alias("m"))
    rel = F.max(F.abs("s")) / (F.max("m") + 1e-12)
    return rows.groupBy("montage_id").agg(F.count(F.lit(1)).alias("n_rows"), (rel < tol).alias("invariant"))
