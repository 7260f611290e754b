"""Evaluation metrics over prediction tables.

Every metric is computed from pooled counts (never averaged over partitions) and
the tables after the first aggregation are classes x classes or distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .order import prefix_sum, spread


def confusion_matrix(df: DataFrame, k: int, keys=()) -> DataFrame:
    """``(keys, y_true, y_pred, n)`` over the full K x K grid."""
    keys = list(keys)
    counts = df.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    labels = F.sequence(F.lit(0), F.lit(k - 1))
    groups = counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = groups.withColumn("y_true", F.explode(labels)).withColumn("y_pred", F.explode(labels))
    return grid.join(counts, [*keys, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(confusion: DataFrame, keys=()) -> DataFrame:
    """tp, support, predicted, precision, recall and F1 per class."""
    keys = list(keys)
    diag = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    rows = confusion.groupBy(*keys, F.col("y_true").alias("label")).agg(F.sum(diag).alias("tp"), F.sum("n").alias("support"))
    cols = confusion.groupBy(*keys, F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    out = rows.join(cols, [*keys, "label"])
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0))
    return out.select(
        *keys, "label", "tp", "support", "predicted",
        F.coalesce(F.col("tp") / F.nullif(F.col("predicted"), F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0)).alias("recall"),
        f1.alias("f1"),
    )


def classification_metrics(df: DataFrame, k: int, keys=()) -> DataFrame:
    """Accuracy, balanced accuracy (classes present in truth), Cohen kappa, weighted F1."""
    keys = list(keys)
    c = per_class(confusion_matrix(df, k, keys), keys)
    n = F.sum("support")
    po = F.sum("tp") / n
    pe = F.sum(F.col("support") * F.col("predicted")) / (n * n)
    return c.groupBy(*keys).agg(
        n.alias("n"),
        po.alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        ((po - pe) / F.nullif(1.0 - pe, F.lit(0.0))).alias("kappa"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
    )


def predict(df: DataFrame, scores: str = "logits", out: str = "y_pred") -> DataFrame:
    """Class of the highest score, the first one on ties."""
    return df.withColumn(out, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def softmax(df: DataFrame, logits: str = "logits", out: str = "probs") -> DataFrame:
    return df.withColumn(out, A.softmax(F.col(logits)))


def sigmoid(df: DataFrame, logits: str = "logits", out: str = "probs") -> DataFrame:
    return df.withColumn(out, F.transform(logits, lambda v: 1.0 / (1.0 + F.exp(-v))))


def ranking_metrics(df: DataFrame, keys=(), y: str = "y", score: str = "score") -> DataFrame:
    """``(keys, auroc, ap)``: binary AUROC with ties counted half and average precision.

    Rows collapse to distinct scores first; running totals over scores are
    two-level in buckets of about equally many distinct scores, so neither a popular
    score nor a big key nor a narrow range of scores makes a hot task. Values
    that need a class that does not occur are null.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(score).alias("__s")).agg(
        F.sum(F.col(y).cast("long")).alias("__p"), F.sum((1 - F.col(y)).cast("long")).alias("__n")
    )
    return _ranked(counts, keys)


def _ranked(counts: DataFrame, keys) -> DataFrame:
    down = spread(counts.withColumn("__o", -F.col("__s")), "__o")
    c = prefix_sum(down, keys, ["__o"], F.col("__spread"), {"__cp": F.col("__p"), "__cn": F.col("__n")})
    above = F.col("__cp") - F.col("__p")
    positives, negatives = F.sum("__p").cast("double"), F.sum("__n").cast("double")
    wins = F.sum(F.col("__n") * (above + 0.5 * F.col("__p")))
    gain = F.sum(F.col("__p") * F.col("__cp") / (F.col("__cp") + F.col("__cn")))
    return c.groupBy(*keys).agg(
        (wins / F.nullif(positives * negatives, F.lit(0.0))).alias("auroc"),
        (gain / F.nullif(positives, F.lit(0.0))).alias("ap"),
    )


def auroc(df: DataFrame, keys=(), y: str = "y", score: str = "score") -> DataFrame:
    """Binary AUROC per key, null when only one class occurs."""
    return ranking_metrics(df, keys, y, score).drop("ap")


def average_precision(df: DataFrame, keys=(), y: str = "y", score: str = "score") -> DataFrame:
    """Sum over distinct scores of recall gain times precision."""
    return ranking_metrics(df, keys, y, score).drop("auroc")


def auroc_ovr(df: DataFrame, k: int, probs: str = "probs", renormalise: bool = True) -> DataFrame:
    """Macro one-vs-rest over classes present in truth, rows renormalised to them."""
    present = df.agg(F.sort_array(F.collect_set("y_true")).alias("c")).scalar()
    x = F.col(probs)
    row = df.withColumn("__cls", present)
    mass = F.aggregate("__cls", F.lit(0.0), lambda a, c: a + F.get(x, c)) if renormalise else F.lit(1.0)
    long = row.select("y_true", x.alias("__x"), F.greatest(mass, F.lit(1e-12)).alias("__t"), F.explode("__cls").alias("label")).select(
        "label", (F.col("y_true") == F.col("label")).cast("int").alias("y"), (F.get("__x", F.col("label")) / F.col("__t")).alias("score")
    )
    return auroc(long, ["label"]).agg(F.avg("auroc").alias("auroc"), F.count("auroc").alias("n_classes"))


def auroc_ovo(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Macro one-vs-one: mean over class pairs of both directions' AUROC.

    Items collapse to counts per (class, target, score) before pairs are formed: an
    item of another class than the target stands against the target in one pair,
    and only counts of the target's own items are repeated, once per other class.
    """
    present = df.agg(F.sort_array(F.collect_set("y_true")).alias("c")).scalar()
    scores = df.select("y_true", F.col(probs).alias("__x"), F.explode(present).alias("target"))
    counts = scores.groupBy("y_true", "target", F.get("__x", F.col("target")).alias("__s")).agg(F.count(F.lit(1)).alias("__c"))
    own = F.col("y_true") == F.col("target")
    zero = F.lit(0).cast("long")
    others = counts.filter(~own).select(F.col("y_true").alias("__o"), "target", "__s", zero.alias("__p"), F.col("__c").alias("__n"))
    mine = counts.filter(own).select(F.explode(present).alias("__o"), "target", "__s", F.col("__c").alias("__p"), zero.alias("__n"))
    sides = others.unionByName(mine.filter(F.col("__o") != F.col("target")))
    keys = [F.least("target", "__o").alias("a"), F.greatest("target", "__o").alias("b"), "target"]
    sides = sides.groupBy(*keys, "__s").agg(F.sum("__p").alias("__p"), F.sum("__n").alias("__n"))
    pairs = _ranked(sides, ["a", "b", "target"])
    return pairs.groupBy("a", "b").agg(F.avg("auroc").alias("v")).agg(F.avg("v").alias("auroc"), F.count(F.lit(1)).alias("n_pairs"))


def multilabel_metrics(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All multi-label scores in one row from ``(item_id, class_id, y_true, score)``."""
    pred = (F.col("score") >= threshold).cast("int")
    y = F.col("y_true")
    counts = long.groupBy("class_id").agg(
        F.sum(y * pred).alias("tp"), F.sum((1 - y) * pred).alias("fp"), F.sum(y * (1 - pred)).alias("fn"), F.count(F.lit(1)).alias("n")
    )

    def ratio(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    parts = {"precision": (tp, tp + fp), "recall": (tp, tp + fn), "f1": (2 * tp, 2 * tp + fp + fn), "jaccard": (tp, tp + fp + fn)}
    aggs = []
    for m, (num, den) in parts.items():
        aggs += [ratio(F.sum(num), F.sum(den)).alias(f"{m}_micro"), F.avg(ratio(num, den)).alias(f"{m}_macro")]
    base = counts.agg(*aggs, (F.sum(fp + fn) / F.sum("n")).alias("hamming_loss"))
    # One ranking over the classes and, as one more group, over all of them pooled.
    by_score = long.groupBy("class_id", F.col("score").alias("__s")).agg(
        F.sum(y.cast("long")).alias("__p"), F.sum((1 - y).cast("long")).alias("__n")
    )
    group = F.explode(F.array(F.concat(F.lit("c"), F.col("class_id").cast("string")), F.lit("pooled")))
    pooled = by_score.select(group.alias("__g"), "__s", "__p", "__n").groupBy("__g", "__s").agg(F.sum("__p").alias("__p"), F.sum("__n").alias("__n"))
    is_class = F.col("__g") != "pooled"

    def both(m):
        defined = F.count(F.when(is_class, F.col(m))) == F.count(F.when(is_class, 1))
        macro = F.when(defined, F.avg(F.when(is_class, F.col(m))))
        return [F.max(F.when(~is_class, F.col(m))).alias(f"{m}_micro"), macro.alias(f"{m}_macro")]

    ranks = _ranked(pooled, ["__g"]).agg(*both("auroc"), *both("ap"))
    ranks = ranks.select(F.struct(*ranks.columns).alias("r"))
    return base.withColumn("__r", ranks.scalar()).select(*base.columns, "__r.*")


def masked_error(df: DataFrame, rel: float = 0.1) -> DataFrame:
    """MSE, RMSE, MAE and share of small relative errors over masked patches.

    ``df(pred ARRAY, target ARRAY, masked)``; zeros when nothing is masked.
    """
    pair = F.explode(F.arrays_zip("pred", "target")).alias("z")
    e = df.filter("masked").select(pair).select((F.col("z.pred") - F.col("z.target")).alias("d"), F.col("z.target").alias("t"))
    close = (F.abs("d") / (F.abs("t") + 1e-8) < rel).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return e.agg(
        F.count(F.lit(1)).alias("n"), zero(F.avg(F.col("d") * F.col("d"))).alias("mse"), zero(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rmse"),
        zero(F.avg(F.abs("d"))).alias("mae"), zero(F.avg(close)).alias("accuracy"),
    )


def coefficient_error(bands: DataFrame, pred: str = "p", target: str = "t") -> DataFrame:
    """Error per band in the coefficient domain, scaled by ``mean(t^2) + mean(p^2)``
    over all patches, summed over the masked ones; one row per band."""
    z = bands.select("band", "masked", F.explode(F.arrays_zip(F.col(pred).alias("p"), F.col(target).alias("t"))).alias("z"))
    z = z.select("band", F.col("masked").cast("double").alias("m"), F.col("z.p").alias("p"), F.col("z.t").alias("t"))
    scale = F.greatest(F.avg(F.col("t") * F.col("t")) + F.avg(F.col("p") * F.col("p")), F.lit(1e-8))
    err = F.sum(F.pow(F.col("p") - F.col("t"), 2) * F.col("m")) / F.greatest(F.sum("m"), F.lit(1.0))
    return z.groupBy("band").agg(F.when(F.sum("m") > 0, err / scale).otherwise(0.0).alias("error"))


def covariance_error(recon: DataFrame, target: DataFrame, keys=("window_id", "band", "ch_i", "ch_j")) -> DataFrame:
    """``mean((Cr - Ct)^2) / sqrt(mean(Ct^2))`` over two edge tables that hold each
    unordered pair once; off-diagonal entries count twice."""
    keys = list(keys)
    r = recon.select(*keys, F.col("value").alias("__r"))
    j = target.select(*keys, F.col("value").alias("__t")).join(r, keys)
    w = F.when(F.col(keys[-2]) == F.col(keys[-1]), 1.0).otherwise(2.0)
    mean = lambda e: F.sum(w * e) / F.sum(w)
    return j.agg((mean(F.pow(F.col("__r") - F.col("__t"), 2)) / F.sqrt(F.greatest(mean(F.col("__t") * F.col("__t")), F.lit(1e-10)))).alias("error"))


def view_consistency(views: DataFrame, anchor: DataFrame | None = None, metric: str = "cosine", key: str = "item_id") -> DataFrame:
    """Mean distance of view embeddings to an anchor, or pairwise without one.

    ``views(key, view, z)``, ``anchor(key, z)``. Without an anchor the views of one
    item (two or three) are compared inside the item's row.
    """
    def dist(a, b):
        if metric == "cosine":
            return 1.0 - A.cosine(a, b)
        return A.mean(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))

    if anchor is not None:
        j = views.join(anchor.withColumnRenamed("z", "__a"), key)
        return j.groupBy("view").agg(F.avg(dist(F.col("z"), F.col("__a"))).alias("v")).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("consistency"))
    packed = views.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("view", "z"))).alias("s"))
    first = packed.select(key, F.posexplode("s").alias("i", "a"), "s")
    pairs = first.select(F.col("a.view").alias("va"), F.col("a.z").alias("za"), F.explode(F.slice(F.col("s"), F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("b"))
    per = pairs.select("va", F.col("b.view").alias("vb"), dist(F.col("za"), F.col("b.z")).alias("d"))
    return per.groupBy("va", "vb").agg(F.avg("d").alias("v")).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("consistency"))


def embedding_shift(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Mean cosine similarity and mean relative L2 distance."""
    diff = F.zip_with(F.col(a), F.col(b), lambda u, v: u - v)
    return pairs.agg(
        F.avg(A.cosine(F.col(a), F.col(b))).alias("cosine_similarity"),
        F.avg(A.norm(diff) / F.greatest(A.norm(F.col(a)), F.lit(1e-8))).alias("relative_l2"),
    )


def symmetric_kl(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Mean over items of half the sum of both KL divergences of the softmaxes."""
    p = pairs.select(A.softmax(F.col(a)).alias("p"), A.softmax(F.col(b)).alias("q"))
    both = A.total(F.zip_with("p", "q", lambda u, v: (u - v) * (F.log(u) - F.log(v))))
    return p.agg((0.5 * F.avg(both)).alias("symmetric_kl"))


def reliability_error(df: DataFrame) -> DataFrame:
    """Mean over modalities of the presence-weighted squared error to ``1 - level``."""
    w = F.col("present").cast("double")
    per = df.groupBy("modality").agg((F.sum(w * F.pow(F.col("reliability") - F.col("target"), 2)) / F.nullif(F.sum(w), F.lit(0.0))).alias("e"))
    return per.agg(F.coalesce(F.avg("e"), F.lit(0.0)).alias("error"))


def fuse_scores(fused: DataFrame, unimodal: DataFrame, weight: float = 0.5, key: str = "item_id") -> DataFrame:
    """``fused + w * sum(r p logit) / max(sum(r p), 1e-6)`` per item and class.

    ``fused(key, class_id, logit)``, ``unimodal(key, modality, class_id, logit,
    reliability, present)``.
    """
    rp = F.col("reliability") * F.col("present").cast("double")
    mix = unimodal.groupBy(key, "class_id").agg((F.sum(rp * F.col("logit")) / F.greatest(F.sum(rp), F.lit(1e-6))).alias("__m"))
    return fused.join(mix, [key, "class_id"], "left").withColumn("logit", F.col("logit") + weight * F.coalesce("__m", F.lit(0.0))).drop("__m")


def log_loss(df: DataFrame, k: int, smoothing: float = 0.0, weights: list[float] | None = None, logits: str = "logits") -> DataFrame:
    """Label-smoothed cross-entropy, weighted by the true class when weights are given."""
    x = F.col(logits)
    log_z = A.let(F.array_max(x), lambda top: top + F.log(A.total(F.transform(x, lambda v: F.exp(v - top)))))
    mean_logit = A.total(x) / k
    loss = log_z - (1.0 - smoothing) * F.get(x, F.col("y_true")) - smoothing * mean_logit
    w = F.get(F.array(*[F.lit(float(v)) for v in weights]), F.col("y_true")) if weights else F.lit(1.0)
    staged = df.select(loss.alias("l"), w.alias("w"))
    return staged.agg((F.sum(F.col("l") * F.col("w")) / F.greatest(F.sum("w"), F.lit(2.220446049250313e-16))).alias("loss"))


def binary_log_loss(long: DataFrame, smoothing: float = 0.0, logit: str = "logit", y: str = "y_true") -> DataFrame:
    """Binary cross-entropy with logits over (item, class) rows."""
    x = F.col(logit)
    t = F.col(y) * (1.0 - smoothing) + 0.5 * smoothing
    return long.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def perturb(windows: DataFrame, seed=0, key: str = "window_id", fractions=(0.1, 0.25), noise_scale: float = 10.0) -> DataFrame:
    """Robustness conditions of a packed window ``(key, channels, x)``.

    One output row per condition: permutation, missing_10pct, missing_25pct,
    bad_channel, unknown_montage. Channel choices depend on (seed, channel) only,
    so one condition hits the same channels in every window.
    """
    from ..functions import hashing as H

    n = F.size("x")
    order = lambda tag: F.transform(
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.struct(H.digest(f"{seed}:{tag}", c).alias("d"), c.alias("c")))), lambda s: s["c"]
    )
    x = F.col("x")

    def permuted(p):
        return F.struct(F.lit("permutation").alias("condition"), F.transform(p, lambda c: F.get("channels", c)).alias("channels"), F.transform(p, lambda c: F.get(x, c)).alias("x"), F.transform(p, lambda c: F.lit(True)).alias("good"), F.lit(True).alias("known_positions"))

    def plain(name, new_x, good, known=True):
        return F.struct(F.lit(name).alias("condition"), F.col("channels").alias("channels"), new_x.alias("x"), good.alias("good"), F.lit(known).alias("known_positions"))

    all_good = F.transform(x, lambda r: F.lit(True))
    conditions = [A.let(order("perm"), permuted)]

    def missing(f):
        count = F.greatest(F.lit(1), F.bround(n * f).cast("int"))
        tag = f"missing_{int(f * 100)}pct"
        return A.let(F.slice(order(tag), 1, count), lambda hit: _hit(plain, tag, x, hit))

    conditions += [missing(f) for f in fractions]
    bad = F.greatest(F.lit(1), F.floor(n / 10).cast("int"))
    conditions.append(A.let(F.slice(order("bad"), 1, bad), lambda hit: plain(
        "bad_channel",
        F.transform(x, lambda r, c: F.when(F.array_contains(hit, c), F.transform(H.normals(f"{seed}:noise", c, count=F.size(r)), lambda z: noise_scale * z)).otherwise(r)),
        all_good,
    )))
    conditions.append(plain("unknown_montage", x, all_good, False))
    return windows.select(key, F.explode(F.array(*conditions)).alias("__c")).select(key, "__c.*")


def _hit(plain, tag, x, hit):
    return plain(
        tag,
        F.transform(x, lambda r, c: F.when(F.array_contains(hit, c), F.transform(r, lambda v: v * 0.0)).otherwise(r)),
        F.transform(x, lambda r, c: ~F.array_contains(hit, c)),
    )


def condition_grid(modal: DataFrame, conditions: list[dict], seed=0, key: str = "window_id") -> DataFrame:
    """One row per (window, condition, kept modality), corrupted where asked.

    ``modal(key, modality, x ARRAY<ARRAY<DOUBLE>>)``; a condition is
    ``{"id", "modalities", "corrupt": {modality: kind}}``. The grid is an explode
    of constants, not a join.
    """
    from .augment import corrupt

    rows = [
        F.struct(F.lit(c["id"]).alias("condition"), F.lit(m).alias("modality"), F.lit((c.get("corrupt") or {}).get(m)).cast("string").alias("corruption"))
        for c in conditions for m in c["modalities"]
    ]
    spread = modal.withColumn("__c", F.explode(F.filter(F.array(*rows), lambda r: r["modality"] == F.col("modality"))))
    spread = spread.select(key, "modality", "__c.condition", "__c.corruption", "x")
    kinds = sorted({k for c in conditions for k in (c.get("corrupt") or {}).values()})
    out = spread.filter(F.col("corruption").isNull()).drop("corruption").withColumn("kind", F.lit("none")).withColumn("level", F.lit(0.0))
    for k in kinds:
        part = corrupt(spread.filter(F.col("corruption") == k).drop("corruption"), seed, (key, "modality", "condition"), prob=1.0, kinds=[k])
        out = out.unionByName(part)
    return out
