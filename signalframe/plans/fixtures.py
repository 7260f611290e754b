"""The driver tables re-read as recordings, annotations, predictions and runs.

Each fixture exists twice with one meaning: a DataFrame method on ``Tables`` and
a list of DuckDB common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import layout
from ..operators.order import ordinal
from .registry import sql_uniform

CHANNELS = ("qty", "price", "disc", "tax")
WINDOW, STEP = 64, 32

_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # A: line items of a supplier, by ship date, are one four-channel recording.
    @cached_property
    def samples_wide(self) -> DataFrame:
        indexed = ordinal(
            self.lineitem.select(*_ORDER, "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"),
            ["l_suppkey"], _ORDER, F.date_trunc("month", F.col("l_shipdate")), "t",
        )
        return indexed.select(
            F.col("l_suppkey").alias("recording_id"),
            "t",
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_discount") + 0.0).alias("disc"),
            (F.col("l_tax") + 0.0).alias("tax"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        return layout.unpivot(self.samples_wide, CHANNELS)

    def signals(self, frame: int = 256, halo: int = WINDOW - STEP) -> DataFrame:
        return layout.to_signals(self.samples_wide, frame, halo, channels=CHANNELS)

    def windows(self, window: int = WINDOW, step: int = STEP, tail: str = "drop") -> DataFrame:
        from ..operators import windowing

        frame = step * max(1, -(-256 // step))
        cut = windowing.windows(self.signals(frame, max(window - step, 0)), window, step, tail)
        return cut.withColumn("window_id", F.concat_ws("_", "recording_id", "start"))

    # B: events of a user.
    @cached_property
    def event_samples(self) -> DataFrame:
        day = F.date_trunc("day", F.col("ts"))
        return ordinal(
            self.events.select("event_id", "ts", "user_id", "event_type", "value"),
            ["user_id"], ["ts", "event_id"], day, "t",
        ).select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("channel"), "t", F.col("value").alias("v"), "ts", "event_id")

    # C: an embedding is a window of 4 channels x 16 samples.
    @cached_property
    def embedded(self) -> DataFrame:
        return self.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))

    @cached_property
    def windows4(self) -> DataFrame:
        return layout.split_row(self.embedded, "x", 4, 16)

    # E: orders are 30-day annotation intervals of a user, on the event clock (seconds).
    @cached_property
    def annotations(self) -> DataFrame:
        onset = F.pmod(F.datediff(F.col("o_orderdate"), F.to_date(F.lit("1992-01-01"))), F.lit(30)) * 86400.0
        return self.orders.select(
            F.col("o_custkey").alias("recording_id"), "o_orderkey",
            onset.alias("onset"),
            F.lit(30.0 * 60.0).alias("duration"),
            F.col("o_orderstatus").alias("code"),
        )

    # F: single-label predictions.
    @cached_property
    def predictions(self) -> DataFrame:
        return self.embeddings.select(
            F.col("vec_id").alias("item_id"),
            F.col("label").alias("y_true"),
            F.pmod(F.col("label") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0), F.lit(10)).cast("int").alias("y_pred"),
            F.slice("embedding", 1, 10).cast("array<double>").alias("logits"),
        )

    # G: multi-label predictions of documents, long form.
    @cached_property
    def ml_predictions(self) -> DataFrame:
        rows = F.explode(F.array(
            F.struct(F.lit("quality").alias("class_id"), F.col("quality").alias("y")),
            F.struct(F.lit("toxic").alias("class_id"), F.col("toxic").alias("y")),
        ))
        long = self.labels.select("doc_id", rows.alias("c")).select(F.col("doc_id").alias("item_id"), "c.class_id", "c.y")
        coarse = F.floor(H.uniform(7, "item_id", "class_id") * 1000) / 1000.0
        return long.select("item_id", "class_id", F.col("y").cast("int").alias("y_true"), coarse.alias("score"))

    # H: experiment runs.
    @cached_property
    def runs(self) -> DataFrame:
        return self.lineitem.groupBy(
            F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("fold"), F.col("l_linestatus").alias("seed")
        ).agg(
            F.round(F.avg("l_quantity") + 1.7e-9, 6).alias("test_acc"),
            F.round(F.avg("l_discount") + 1.7e-9, 6).alias("test_f1"),
            F.round(F.avg("l_extendedprice") + 1.7e-9, 6).alias("cost"),
        )


A = f"""samples_wide as (
  select l_suppkey as recording_id,
         row_number() over (partition by l_suppkey order by {', '.join(_ORDER)}) - 1 as t,
         l_quantity as qty, l_extendedprice as price, l_discount + 0.0 as disc, l_tax + 0.0 as tax,
         l_returnflag as flag, l_linestatus as status
  from lineitem),
samples as (
  select recording_id, t, unnest(['qty','price','disc','tax']) as channel, unnest([qty,price,disc,tax]) as v
  from samples_wide)"""

SIGNALS = f"""{A},
signals as (select recording_id, channel, list(v order by t) as x, count(*) as n from samples group by 1, 2)"""


def windows_sql(window: int = WINDOW, step: int = STEP, starts: str | None = None) -> str:
    """CTE ``windows``; ``starts`` is a list expression over ``n`` (drop policy if omitted)."""
    starts = starts or f"case when n >= {window} then range(0, n - {window} + 1, {step}) else []::bigint[] end"
    return f"""{SIGNALS},
cuts as (select recording_id, channel, x, n, unnest({starts}) as start from signals),
windows as (
  select recording_id, channel, start, recording_id || '_' || start as window_id,
         list_concat(x[start+1:start+{window}], list_transform(range(0, greatest(start+{window}-n, 0)), lambda i: 0.0::double)) as x,
         greatest(start+{window}-n, 0) as n_pad
  from cuts)"""


B = """event_samples as (
  select user_id as recording_id, event_type as channel,
         row_number() over (partition by user_id order by ts, event_id) - 1 as t, value as v, ts, event_id
  from events)"""

C = """embedded as (select vec_id, label, list_transform(embedding, lambda e: e::double) as x from embeddings),
emb as (select vec_id, label, unnest(x) as v, unnest(range(0, 64)) as i from embedded),
windows4 as (
  select vec_id, label, unnest(range(0, 4)) as channel,
         unnest(list_transform(range(0, 4), lambda k: x[k*16+1:k*16+16])) as x
  from embedded),
samples4 as (select vec_id, label, i // 16 as channel, i % 16 as t, v from emb)"""

E = """annotations as (
  select o_custkey as recording_id, o_orderkey,
         (datediff('day', date '1992-01-01', o_orderdate::date) % 30) * 86400.0::double as onset,
         1800.0::double as duration, o_orderstatus as code
  from orders)"""

F_ = """predictions as (
  select vec_id as item_id, label as y_true,
         ((label + case when vec_id % 7 = 0 then 1 else 0 end) % 10)::int as y_pred,
         list_transform(embedding[1:10], lambda e: e::double) as logits
  from embeddings)"""

G = f"""ml_long as (
  select doc_id as item_id, unnest(['quality','toxic']) as class_id, unnest([quality, toxic]) as y from labels),
ml_predictions as (
  select item_id, class_id, y::int as y_true,
         floor({sql_uniform(7, 'item_id', 'class_id')} * 1000) / 1000.0::double as score
  from ml_long)"""

H_ = """runs as (
  select l_returnflag as variant, l_linenumber as fold, l_linestatus as seed,
         round(avg(l_quantity) + 1.7e-9, 6) as test_acc, round(avg(l_discount) + 1.7e-9, 6) as test_f1,
         round(avg(l_extendedprice) + 1.7e-9, 6) as cost
  from lineitem group by 1, 2, 3)"""


def split_row_names(n: int) -> list[str]:
    return [f"ch{k}" for k in range(n)]
