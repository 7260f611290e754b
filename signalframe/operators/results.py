"""Experiment results: per-run tables, summaries, paired deltas, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .labels import literal_map
from .rank import best_epoch

MIN_SCHEMA = 2

# Published rows for the P300 comparison.
PUBLISHED_P300 = {
    "EEGPT (NeurIPS'24)": {"balanced_acc": 0.6502, "kappa": 0.2999, "auroc": 0.7168},
    "LaBraM (ICLR'24)": {"balanced_acc": 0.6477, "kappa": 0.2935, "auroc": 0.7068},
    "BENDR": {"balanced_acc": 0.6114, "kappa": 0.2227, "auroc": 0.6588},
    "BIOT (NeurIPS'23)": {"balanced_acc": 0.5485, "kappa": 0.0968, "auroc": 0.5308},
}


def flatten_runs(runs: DataFrame, metrics, classes, keys=("fold", "variant", "seed")) -> DataFrame:
    """One flat row per run from nested results: metrics, provenance, per-class F1."""
    prov = lambda f: F.col(f"provenance.{f}")
    per_class = [F.get("per_class_f1", F.lit(i)).alias(f"f1_{c}") for i, c in enumerate(classes)]
    return runs.select(
        *keys, *metrics,
        prov("channel_encoding").alias("encoding"), prov("channel_injection").alias("injection"),
        prov("metadata_hash").alias("metadata_hash"), F.substring(F.coalesce(prov("git_commit"), F.lit("")), 1, 8).alias("git_commit"),
        "best_epoch", *per_class,
    )


def unpivot_metrics(runs: DataFrame, metrics, keys) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return runs.select(*keys, rows.alias("__m")).select(*keys, "__m.metric", "__m.value")


def variant_summary(runs: DataFrame, metrics, variant: str = "variant") -> DataFrame:
    """Mean, sample sd (0 for one run) and n per variant and metric."""
    long = unpivot_metrics(runs, metrics, [variant])
    sd = F.when(F.count("value") > 1, F.stddev_samp("value")).when(F.count("value") == 1, 0.0)
    return long.groupBy(variant, "metric").agg(F.avg("value").alias("mean"), sd.alias("sd"), F.count("value").alias("n"))


def paired_delta(runs: DataFrame, baseline, metrics, keys=("fold", "seed"), variant: str = "variant") -> DataFrame:
    """Variant minus baseline inside each matched cell, then mean, sd and n."""
    keys = list(keys)
    long = unpivot_metrics(runs, metrics, [*keys, variant]).filter(F.col("value").isNotNull())
    base = long.filter(F.col(variant) == baseline).select(*keys, "metric", F.col("value").alias("__base"))
    delta = long.filter(F.col(variant) != baseline).join(base, [*keys, "metric"]).withColumn("__d", F.col("value") - F.col("__base"))
    sd = F.when(F.count("__d") > 1, F.stddev_samp("__d")).otherwise(0.0)
    return delta.groupBy(variant, "metric").agg(F.avg("__d").alias("mean"), sd.alias("sd"), F.count("__d").alias("n"))


def sum_confusions(runs: DataFrame, matrix: str = "confusion_matrix", keys=("variant",)) -> DataFrame:
    """Nested ``[K][K]`` matrices to summed ``(true, pred, n)`` cells."""
    rows = runs.select(*keys, F.posexplode(matrix).alias("y_true", "__row"))
    cells = rows.select(*keys, "y_true", F.posexplode("__row").alias("y_pred", "__n"))
    return cells.groupBy(*keys, "y_true", "y_pred").agg(F.sum("__n").alias("n"))


def fold_summary(folds: DataFrame, metrics, expected: int, published: dict[str, float] | None = None, fold: str = "fold") -> DataFrame:
    """Per metric: mean, sample sd, n, completeness against ``expected`` folds and
    the difference to a published value."""
    long = unpivot_metrics(folds, metrics, [fold])
    ids = folds.select(fold).distinct()
    want = folds.sparkSession.range(expected).select(F.concat(F.lit("fold"), "id").alias(fold))
    missing = want.join(ids, fold, "left_anti").agg(F.array_join(F.sort_array(F.collect_list(fold)), ",").alias("m")).scalar()
    n_folds = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.when(F.count("value") > 1, F.stddev_samp("value")).alias("sd"), F.count("value").alias("n")
    )
    ref = F.try_element_at(literal_map(published), F.col("metric")) if published else F.lit(None).cast("double")
    return out.select("metric", "mean", "sd", "n", (n_folds == expected).alias("complete"), missing.alias("missing"), (F.col("mean") - ref).alias("delta"))


def missing_cells(runs: DataFrame, axes=("fold", "variant", "seed")) -> DataFrame:
    """Cells of the full experiment matrix without a run.

    The matrix is the product of each axis' distinct values, which is about what
    comes out; it is made row by row from distributed tables, never in one row,
    and the anti join runs on all axes.
    """
    axes = list(axes)
    grid = runs.select(axes[0]).distinct()
    for a in axes[1:]:
        grid = grid.crossJoin(runs.select(a).distinct())
    return grid.join(runs.select(*axes).distinct(), axes, "left_anti")


def same_setting(want: Column, got: Column) -> Column:
    """Recorded text equals the wanted one; numbers compare with relative 1e-9."""
    a, b = want.try_cast("double"), got.try_cast("double")
    close = F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    flags = F.lower(got).isin("true", "false") & (F.lower(got) == F.lower(F.trim(want)))
    return F.when(got.isNull(), False).otherwise(F.coalesce(flags | F.coalesce(close, F.lit(False)) | (got == want), F.lit(False)))


# Where a sweep's variable is recorded in a result's provenance, in the
# resolved model configuration ("cfg") or in the provenance itself ("top").
RECORDED = {
    "EPOCHS": ("cfg", "epochs"),
    "WARMUP_EPOCHS": ("cfg", "warmup_epochs"),
    "BATCH_SIZE": ("cfg", "batch_size"),
    "LR": ("cfg", "lr"),
    "WEIGHT_DECAY": ("cfg", "weight_decay"),
    "DROPOUT": ("cfg", "dropout"),
    "HEAD_DROPOUT": ("cfg", "head_dropout"),
    "LABEL_SMOOTHING": ("cfg", "label_smoothing"),
    "FOLD_KL": ("cfg", "fold_kl"),
    "SELECT_BY": ("cfg", "select_by"),
    "IN_CHANNELS": ("cfg", "in_channels"),
    "CHANNEL_ENCODING": ("top", "channel_encoding"),
    "CHANNEL_INJECTION": ("top", "channel_injection"),
    "SEED": ("top", "seed"),
    "GIT_COMMIT": ("top", "git_commit"),
    "METADATA_HASH": ("top", "metadata_hash"),
}

_PLACES = {"cfg": "$[0].provenance.resolved_model_config", "top": "$[0].provenance"}


def read_results(documents: DataFrame, run: str = "run_id", text: str = "text", recorded: dict = RECORDED, carried=()) -> DataFrame:
    """Result files of unknown shape as ``(run, state, schema_version, scored_rows, settings)``.

    ``state`` is ``missing`` (null or empty text), ``unreadable`` (no JSON object),
    ``no provenance`` or ``ok``. ``scored_rows`` is the recorded number of test samples
    or, without it, the sum of the per-class support. ``settings`` maps each name of
    ``recorded`` to ``(kind, value)``: the JSON kind tells a number from its text.
    Columns named in ``carried`` follow as they are.
    """
    v = F.col("__v")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    root = get("$[0]", "variant")
    one_object = F.coalesce(F.schema_of_variant(root), F.lit("")).startswith("OBJECT") & get("$[1]", "variant").isNull()
    support = F.aggregate(get("$[0].per_class_support", "array<bigint>"), F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n, F.lit(0)))
    provenance = get("$[0].provenance", "variant")
    # An empty object counts as none, as a missing or null one does.
    bare = provenance.isNull() | F.coalesce(F.schema_of_variant(provenance), F.lit("VOID")).isin("VOID", "OBJECT<>")
    state = (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "missing").when(~one_object, "unreadable").when(bare, "no provenance").otherwise("ok")
    )

    def entry(place, key):
        path = f"{_PLACES[place]}.{key}"
        return F.struct(F.schema_of_variant(get(path, "variant")).alias("kind"), get(path, "string").alias("value"))

    settings = F.map_from_arrays(F.array(*[F.lit(n) for n in recorded]), F.array(*[entry(*at) for at in recorded.values()]))
    # As the only element of a list, a document with anything behind it does not parse.
    parsed = documents.withColumn("__v", F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit("]"))))
    return parsed.select(
        run, state.alias("state"), get("$[0].result_schema_version", "bigint").alias("schema_version"),
        F.coalesce(get("$[0].test_samples", "bigint"), F.when(F.size(get("$[0].per_class_support", "array<bigint>")) > 0, support)).alias("scored_rows"),
        settings.alias("settings"), *carried,
    )


def same_recorded(want: Column, kind: Column, value: Column) -> Column:
    """A recorded value equals the wanted text: numbers within 1e-9, flags whatever their case, text exactly."""
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    a, b = want.try_cast("double"), value.try_cast("double")
    close = F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    equal = F.when(kind == "BOOLEAN", F.lower(value) == F.lower(F.trim(want))).when(number, close).otherwise(value == want)
    return F.coalesce(equal, F.lit(False))


def stale_results(documents: DataFrame, wanted: DataFrame, test_sizes: DataFrame | None = None, run: str = "run_id", text: str = "text", recorded: dict = RECORDED) -> DataFrame:
    """``(run, reason, stale)`` from result JSON, one row per reason; a current run yields none.

    ``wanted(name, want)`` are the sweep's settings, ``test_sizes(run, test_rows)`` the
    lengths of the test sets. A result without a schema version is kept only if it
    was scored on its whole test set. A wanted name that no result records cannot
    be compared: it gives a row with ``stale`` false, so it does not pass as checked.
    """
    # Texts are joined before they are parsed: a map of all settings is several times a file's text.
    files = documents.select(run, text)
    files = files.join(test_sizes.select(run, "test_rows"), run, "left") if test_sizes is not None else files.withColumn("test_rows", F.lit(None).cast("long"))
    read = read_results(files, run, text, recorded, ["test_rows"])
    number = lambda c: F.col(c).cast("string")
    version = (
        F.when(F.col("schema_version") < MIN_SCHEMA, F.concat(F.lit("result_schema_version "), number("schema_version")))
        .when(F.col("schema_version").isNotNull(), None)
        .when(F.col("scored_rows").isNull() | F.col("test_rows").isNull(), "no result_schema_version, test set not available")
        .when(F.col("scored_rows") != F.col("test_rows"), F.concat(F.lit("scored on "), number("scored_rows"), F.lit(" of "), number("test_rows")))
    )
    first = F.when(F.col("state").isin("missing", "unreadable"), F.col("state")).otherwise(F.coalesce(version, F.when(F.col("state") != "ok", F.col("state"))))
    names = wanted.agg(F.collect_list(F.struct("name", "want")).alias("w")).scalar()
    entry = lambda reason, stale: F.struct(reason.alias("reason"), stale.alias("stale"))

    def compared(settings, w):
        got = F.try_element_at(settings, w["name"])
        known = w["name"].isin(*recorded)
        differs = ~same_recorded(w["want"], got["kind"], got["value"])
        return entry(F.when(~known, F.concat(F.lit("uncheckable: "), w["name"])).when(differs, F.concat(F.lit("differs: "), w["name"])), known)

    each = A.let(F.col("settings"), lambda s: F.filter(F.transform("__names", lambda w: compared(s, w)), lambda r: r["reason"].isNotNull()))
    reasons = A.let(first, lambda why: F.when(why.isNotNull(), F.array(entry(why, F.lit(True)))).otherwise(each))
    return read.withColumn("__names", names).select(run, F.explode(reasons).alias("r")).select(run, "r.reason", "r.stale")


def stale_runs(results: DataFrame, wanted: DataFrame, run: str = "run_id") -> DataFrame:
    """``(run, reason)``, one row per reason; a current run yields none.

    ``results(run, schema_version, scored_rows, test_rows, settings MAP)`` with a
    null map when provenance is missing; ``wanted(name, want)``.
    """
    schema = (
        F.when(F.col("schema_version").isNotNull() & (F.col("schema_version") < MIN_SCHEMA), "old schema")
        .when(F.col("schema_version").isNull() & (F.col("scored_rows").isNull() | F.col("test_rows").isNull()), "unknown test size")
        .when(F.col("schema_version").isNull() & (F.col("scored_rows") != F.col("test_rows")), "partial test set")
    )
    first = F.coalesce(schema, F.when(F.col("settings").isNull(), "no provenance"))
    judged = results.withColumn("__reason", first)
    blocked = judged.filter(F.col("__reason").isNotNull()).select(run, F.col("__reason").alias("reason"))
    names = wanted.agg(F.collect_list(F.struct("name", "want")).alias("w")).scalar()
    pairs = judged.filter(F.col("__reason").isNull()).select(run, "settings", F.explode(names).alias("__w")).select(
        run, F.col("__w.name").alias("name"), F.col("__w.want").alias("want"), F.try_element_at("settings", F.col("__w.name")).alias("got")
    )
    differs = pairs.filter(~same_setting(F.col("want"), F.col("got"))).select(run, F.concat(F.lit("differs: "), "name").alias("reason"))
    return blocked.unionByName(differs)


def best_rows(history: DataFrame, metric: str, min_delta: float = 0.0, keys=("run_id",), epoch: str = "epoch") -> DataFrame:
    """Best validation epoch and the test row of the same epoch.

    ``history(keys, epoch, split, metric)`` with split val/test.
    """
    keys = list(keys)
    best = best_epoch(history.filter("split = 'val'"), metric, min_delta, keys=keys, epoch=epoch)
    test = history.filter("split = 'test'").select(*keys, F.col(epoch).cast("long").alias("best_epoch"), F.col(metric).alias(f"test_{metric}"))
    return best.withColumnRenamed("best_value", f"val_{metric}").join(test, [*keys, "best_epoch"], "left")
