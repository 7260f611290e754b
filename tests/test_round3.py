"""Cases of the third round of findings: no broadcast of exploded rows, bounded batches."""

import numpy as np
from pyspark.sql import functions as F

from signalframe.functions import electrodes
from signalframe.operators import spatial


def _heads(spark, n):
    e = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("channel"), *[F.lit(float(v)).alias(a) for a, v in zip("xyz", electrodes.POSITIONS[c])]) for i, c in enumerate(electrodes.STANDARD_19)])
    m = spark.range(n).select(F.col("id").alias("montage_id"), F.explode(e).alias("e")).select("montage_id", "e.*")
    return m.withColumn("good", F.col("pos") >= F.col("montage_id") % 5).withColumn("derivation_type", F.lit("monopolar"))


def test_spline_rows_are_never_broadcast(spark):
    m = _heads(spark, 200)
    got = spatial.surface_laplacian(m)
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Broadcast" not in plan
    rows = got.groupBy("montage_id").agg(F.count("w").alias("n"), F.max("skipped").alias("why")).collect()
    assert len(rows) == 200
    assert all((r.why is None and r.n == 19 * (19 - r.montage_id % 5)) if r.montage_id % 5 < 4 else r.why == "15 usable electrodes < 16" for r in rows)
    hashes = {}
    for r in got.filter("out_ch = 0 and in_ch = 4").select("montage_hash", "w").distinct().collect():
        assert hashes.setdefault(r.montage_hash, r.w) == r.w


def test_cubes_are_bounded_and_keep_shapes(spark):
    import pyarrow as pa

    from signalframe.operators import pairs

    x = [[[1.0 * i, 2.0], [3.0, 4.0]] if i % 3 else [[5.0], [6.0], [7.0 + i]] for i in range(50_000)]
    names = [["a", "b"] if i % 3 else ["a", "b", "c"] for i in range(50_000)]
    seen = []
    for at, _, cube in pairs._cubes(pa.array(names).slice(7), pa.array(x).slice(7)):
        assert cube.size <= pairs._NUMBERS and len(at) * cube.shape[1] * (cube.shape[1] + 1) // 2 <= pairs._ROWS
        assert all(cube[k].tolist() == x[7 + i] for k, i in enumerate(at[:5]))
        seen += at.tolist()
    assert sorted(seen) == list(range(50_000 - 7))


def test_packed_windows_are_the_regrouped_ones(spark):
    from signalframe.operators import layout, normalize, windowing

    rows = [(r, t, float((t * 7 + k) % 13), float(t)) for r, n in (("p", 1), ("q", 64), ("r", 700)) for k, t in enumerate(range(n))]
    df = spark.createDataFrame(rows, "recording_id string, t long, b double, a double")
    cut = windowing.cut(df, 64, 24, channels=["b", "a"])
    want = layout.pack_channels(normalize.zscore(cut, "add"), ["recording_id", "start"])
    got = normalize.zscore_rows(windowing.packed(df, 64, 24, ["b", "a"], frame=48), "add")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 28
    assert spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple").count("Exchange") < spark._jvm.PythonSQLUtils.explainString(want._jdf.queryExecution(), "simple").count("Exchange")


def test_result_texts_are_joined_before_they_are_parsed(spark):
    import re

    from signalframe.operators import results

    docs = spark.createDataFrame([(i, '{"provenance": {"seed": %d}, "per_class_support": [4], "result_schema_version": 2}' % i) for i in range(40)], "run_id long, text string")
    sizes = docs.select("run_id", F.lit(4).cast("long").alias("test_rows"))
    wanted = spark.createDataFrame([("SEED", "7"), ("NONE", "1")], "name string, want string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = results.stale_results(docs, wanted, sizes)
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert moved and not any("settings" in m for m in moved)
    assert sorted((r.run_id, r.reason, r.stale) for r in rows) == sorted(
        [(i, "differs: SEED", True) for i in range(40) if i != 7] + [(i, "uncheckable: NONE", False) for i in range(40)])


def test_operators_are_applied_to_arrow_arrays(spark, monkeypatch):
    """No pandas objects per channel; pieces smaller than a batch, shapes and operators mixed, more outputs than channels."""
    import numpy as np

    from signalframe.operators import spatial

    monkeypatch.setattr(spatial, "_NUMBERS", 7)
    rng = np.random.default_rng(2)
    shape = {"a": (3, 4), "b": (2, 5), "c": (3, 0)}
    rows = [(k, name, rng.normal(size=shape[name]).tolist()) for k, name in enumerate("abacbaabcab")]
    entries = [("a", 0, 2, 2.0), ("a", 3, 1, -1.0), ("b", 1, 0, 0.5), ("c", 0, 0, 1.0)]
    packed = spark.createDataFrame(rows, "id int, operator_id string, x array<array<double>>").coalesce(1)
    op = spark.createDataFrame(entries, "operator_id string, out_ch int, in_ch int, w double")
    out = spatial.apply_operator(packed, op)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    got = {r.id: r.x for r in out.collect()}
    assert len(got) == len(rows)
    for k, name, x in rows:
        n, length = shape[name]
        matrix = np.zeros((4 if name == "a" else n, n))
        for o, i, w in [e[1:] for e in entries if e[0] == name]:
            matrix[o, i] = w
        assert np.allclose(np.array(got[k]).reshape(len(matrix), length), matrix @ np.array(x).reshape(n, length))
