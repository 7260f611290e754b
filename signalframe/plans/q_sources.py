"""Source, guard and preprocessing-chain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, joins
from ..sources import files as S
from ..sources import results as R
from ..sources import windows as SW
from . import fixtures as X
from .q_splits import FILES_SQL
from .q_splits import files as corpus_files
from .registry import query, rnd, scratch, sql_rnd


@query("source_catalog_path_fields", f"""with {FILES_SQL} select path, regexp_extract(path, '/S(\\d+)/', 1) as subject, regexp_extract(path, '([^/]+)/[^/]*$', 1) as folder,
 case when regexp_extract(path, '/R(\\d*7)\\.h5', 1) <> '' then regexp_extract(path, '/R(\\d*7)\\.h5', 1) else regexp_extract(path, '([^/]+)\\.h5$', 1) end as day from files""")
def _(T):
    paths = corpus_files(T).select("path")
    got = S.parse_path(paths, {"subject": r"/S(\d+)/", "day": r"/R(\d*7)\.h5"})
    return got.select("path", "subject", S.parent_of(F.col("path")).alias("folder"), "day")


@query("source_content_checksum", "select doc_id, sha1(text) as checksum from documents")
def _(T):
    return T.documents.select("doc_id", S.checksum(F.encode("text", "utf-8")).alias("checksum"))


_SUMS = f"""{FILES_SQL}, sums as (select path, case when n_windows = 2 then upper(checksum) when n_windows = 3 then reverse(checksum) else checksum end as checksum from files where n_windows <> 5)"""


@query("source_verify_checksums", f"""with {_SUMS}, j as (select f.path, case when s.path is null then 'unlisted' when f.checksum = lower(s.checksum) then 'ok' else 'corrupt' end as status from files f left join sums s using (path))
select status, count(*) as n from j group by 1""")
def _(T):
    f = corpus_files(T)
    sums = f.filter("n_windows <> 5").select("path", F.when(F.col("n_windows") == 2, F.upper("checksum")).when(F.col("n_windows") == 3, F.reverse("checksum")).otherwise(F.col("checksum")).alias("checksum"))
    return S.verify_checksums(f, sums).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("source_dx_header_scan", """with h as (select o_orderkey, 'rec 12 500' || chr(10) || case when o_orderkey % 5 = 0 then '# Age: 44' || chr(10) else '' end ||
  case when o_orderkey % 4 = 0 then '#Dx: ' when o_orderkey % 4 = 1 then '# Dx: ' when o_orderkey % 4 = 2 then '#Dx ' else '# Sex: ' end || o_custkey || ',12a; ' || o_orderkey || '  7x 55' || chr(10) || '#Dx: 999' as txt from orders),
c as (select o_orderkey, list_filter(string_split_regex(regexp_extract(txt, '(?:^|\\n)[ \\t]*# ?Dx:?[ \\t]*([^\\n]*)', 1), '[,\\s;]+'), lambda t: regexp_full_match(t, '\\d+')) as codes from h)
select o_orderkey, array_to_string(codes, ',') as codes from c""")
def _(T):
    k = F.col("o_orderkey")
    head = F.when(k % 4 == 0, "#Dx: ").when(k % 4 == 1, "# Dx: ").when(k % 4 == 2, "#Dx ").otherwise("# Sex: ")
    text = F.concat(F.lit("rec 12 500\n"), F.when(k % 5 == 0, "# Age: 44\n").otherwise(""), head, F.col("o_custkey").cast("string"), F.lit(",12a; "), k.cast("string"), F.lit("  7x 55\n#Dx: 999"))
    return T.orders.select("o_orderkey", F.array_join(S.dx_codes(text), ",").alias("codes"))


@query("source_pair_headers_with_signals", "select o_orderkey as stem from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def _(T):
    headers = T.orders.select(F.col("o_orderkey").alias("stem"))
    signals = T.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("stem"))
    return joins.pair_records(headers, signals)


@query("source_user_documents", """select l_orderkey as user_id, case when l_returnflag = 'R' then 'test' else 'train' end as part, l_partkey || '_' || l_suppkey || '_' || l_linenumber as sample,
 case when l_linenumber = 7 then 'notProvided' else 'g' || l_linenumber end as gesture, count(*) as n, count(distinct ch) as channels from lineitem, unnest(['ch1','ch2']) as u(ch) group by 1, 2, 3, 4""")
def _(T):
    sample = F.concat_ws("_", "l_partkey", "l_suppkey", "l_linenumber")
    body = F.struct(F.when(F.col("l_linenumber") != 7, F.concat(F.lit("g"), "l_linenumber")).alias("gestureName"),
                    F.create_map(F.lit("ch1"), F.array("l_quantity", "l_discount"), F.lit("ch2"), F.array("l_tax")).alias("emg"))
    rows = T.lineitem.select("l_orderkey", (F.col("l_returnflag") == "R").alias("held"), sample.alias("k"), body.alias("b")).dropDuplicates(["l_orderkey", "held", "k"])
    pick = lambda held: F.map_from_entries(F.collect_list(F.when(F.col("held") == held, F.struct("k", "b"))))
    docs = rows.groupBy(F.col("l_orderkey").alias("user_id")).agg(pick(False).alias("trainingSamples"), pick(True).alias("testingSamples"))
    got = S.user_samples(docs, "user_id").groupBy("user_id", "part", "sample", "gesture").agg(F.countDistinct("channel").alias("channels"))
    multiplicity = T.lineitem.groupBy(F.col("l_orderkey").alias("user_id"), F.when(F.col("l_returnflag") == "R", "test").otherwise("train").alias("part"), sample.alias("sample")).agg((F.count(F.lit(1)) * 2).alias("n"))
    return got.join(multiplicity, ["user_id", "part", "sample"])


@query("source_union_with_aliases", f"select label, count(*) as n, {sql_rnd('sum(x)', 2)} as s from (select l_quantity as x, l_linenumber as label from lineitem where l_linestatus = 'O' union all select l_tax + 1, l_linenumber from lineitem where l_linestatus = 'F' union all select value, 0 from events) group by 1")
def _(T):
    a = T.lineitem.filter("l_linestatus = 'O'").select(F.col("l_quantity").alias("data"), F.col("l_linenumber").alias("label"))
    b = T.lineitem.filter("l_linestatus = 'F'").select(F.col("l_linenumber").alias("Y"), (F.col("l_tax") + 1).alias("X"))
    c = T.events.select(F.col("value").alias("input"), F.lit(0).alias("labels"))
    return SW.union_windows([a, b, c]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("x"), 2).alias("s"))


@query("source_metadata_agreement", """with f as (select c_custkey, c_nationkey, case when c_custkey % 50 = 0 and c_nationkey % 2 = 0 then 'h2' when c_nationkey % 5 = 4 and c_custkey % 3 = 0 then null else 'h1' end as h from customer)
select c_nationkey from f group by 1 having count(distinct coalesce(h, '-')) > 1""")
def _(T):
    h = F.when((F.col("c_custkey") % 50 == 0) & (F.col("c_nationkey") % 2 == 0), "h2").when((F.col("c_nationkey") % 5 == 4) & (F.col("c_custkey") % 3 == 0), F.lit(None)).otherwise("h1")
    f = T.customer.select("c_nationkey", h.alias("metadata_hash"), F.lit(1).alias("schema_version"))
    return SW.metadata_conflicts(f, ("metadata_hash", "schema_version"), ["c_nationkey"]).select("c_nationkey")


@query("source_empty_split_guard", "select split from (values ('train'), ('val'), ('test'), ('eval')) v(split) where split not in (select case when l_linenumber < 5 then 'train' else 'test' end from lineitem)")
def _(T):
    w = T.lineitem.select(F.when(F.col("l_linenumber") < 5, "train").otherwise("test").alias("split"))
    return SW.empty_splits(w, ("train", "val", "test", "eval"))


@query("source_missing_subjects", "select c_custkey as subject_id from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def _(T):
    return joins.missing_subjects(T.customer.select(F.col("c_custkey").alias("subject_id")), T.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("subject_id")))


@query("source_preparation_summary", "select case when l_linenumber < 5 then 'train' else 'test' end as split, l_returnflag as label, count(*) as n, 64 as window from lineitem group by 1, 2")
def _(T):
    w = T.lineitem.select(F.when(F.col("l_linenumber") < 5, "train").otherwise("test").alias("split"), F.col("l_returnflag").alias("label"))
    doc = SW.prep_summary(w, {"window": 64})
    parsed = doc.select(F.from_json("summary", "splits map<string,struct<n:bigint,classes:map<string,bigint>>>, parameters string").alias("s"))
    per = parsed.select("s.parameters", F.explode("s.splits").alias("split", "v"))
    return per.select("split", F.explode("v.classes").alias("label", "n"), F.get_json_object("parameters", "$.window").cast("int").alias("window"))


_CFG = {"bandpass": [1, 40], "normalise": "zscore"}
_CK = SW.config_key(_CFG)


@query("source_preprocessing_cache", f"""with k as (select 'rec' || o_orderkey as item_key, substr(sha1('rec' || o_orderkey || '::{_CK}'), 1, 20) as cache_key, o_orderkey % 3 = 0 as hit from orders)
select item_key, cache_key, hit from k""")
def _(T):
    items = T.orders.select(F.concat(F.lit("rec"), "o_orderkey").alias("item_key"))
    cached = T.orders.filter("o_orderkey % 3 = 0").select(SW.cache_key(F.concat(F.lit("rec"), "o_orderkey"), _CFG).alias("cache_key"))
    return SW.cache_status(items, cached, _CFG).select("item_key", "cache_key", "hit")


@query("source_result_bundles", f"""with {X.H_} select 'v' || variant || '.json' as source, fold, test_acc, case when fold % 2 = 0 then 'own' || fold else 'top' || variant end as seed, variant = 'A' as synthetic from runs""")
def _(T):
    row = F.struct("fold", "test_acc", F.when(F.col("fold") % 2 == 0, F.concat(F.lit("own"), "fold")).alias("seed"))
    docs = T.runs.groupBy("variant").agg(F.collect_list(row).alias("rows")).select(
        F.concat(F.lit("v"), "variant", F.lit(".json")).alias("source"), "rows", F.concat(F.lit("top"), "variant").alias("seed"), (F.col("variant") == "A").alias("synthetic"))
    return R.flatten_bundles(docs).select("source", "fold", "test_acc", "seed", "synthetic")


@query("source_report_field_union", f"""with {X.H_} select variant, fold, test_acc, null::double as cost from runs where seed = 'O' union all select variant, fold, null, cost from runs where seed = 'F'""")
def _(T):
    a = T.runs.filter("seed = 'O'").select("variant", "fold", "test_acc")
    b = T.runs.filter("seed = 'F'").select("cost", "variant", "fold")
    return R.union_rows([a, b])


@query("source_cache_counts", "select count(*) filter (where o_orderkey % 3 = 0)::bigint as hits, count(*) filter (where o_orderkey % 3 <> 0)::bigint as misses from orders")
def _(T):
    items = T.orders.select(F.concat(F.lit("rec"), "o_orderkey").alias("item_key"))
    cached = T.orders.filter("o_orderkey % 3 = 0").select(SW.cache_key(F.concat(F.lit("rec"), "o_orderkey"), _CFG).alias("cache_key"))
    return SW.cache_counts(SW.cache_status(items, cached, _CFG))


@query("source_cache_fills_misses", "select 'rec' || o_orderkey as item_key, length('rec' || o_orderkey)::int as y from orders")
def _(T):
    path = scratch(T.spark, "cache")
    compute = lambda df: df.select("item_key", "cache_key", F.length("item_key").alias("y"))
    items = lambda df: df.select(F.concat(F.lit("rec"), "o_orderkey").alias("item_key"))
    SW.with_cache(items(T.orders.filter("o_orderkey % 3 = 0")), _CFG, path, compute)
    return SW.with_cache(items(T.orders), _CFG, path, compute).rows.select("item_key", "y")


@query("source_publish_windows", "select case when l_linenumber < 4 then 'train' when l_linenumber < 6 then 'val' else 'test' end as split, l_returnflag as dataset_id, count(*) as n, sum(l_orderkey)::bigint as keys from lineitem group by 1, 2")
def _(T):
    path = scratch(T.spark, "windows")
    split = F.when(F.col("l_linenumber") < 4, "train").when(F.col("l_linenumber") < 6, "val").otherwise("test")
    rows = T.lineitem.select(F.col("l_returnflag").alias("dataset_id"), split.alias("split"), F.col("l_orderkey").alias("recording_id"), F.col("l_linenumber").alias("start"), "l_quantity")
    # A second write replaces the folders it has and leaves the others.
    SW.write_windows(rows.filter("split <> 'test' or dataset_id = 'A'"), path, splits=("train", "val"))
    SW.write_windows(rows, path, splits=("train", "val", "test"))
    return SW.read_published(T.spark, path).groupBy("split", "dataset_id").agg(F.count(F.lit(1)).alias("n"), F.sum("recording_id").alias("keys"))


@query("source_record_list", "select 'files/p' || o_custkey || '/s' || o_orderkey as path from orders union all select 'plain/' || c_custkey from customer")
def _(T):
    lists = []
    named = T.orders.select("o_orderstatus", F.concat(F.lit("files/p"), "o_custkey", F.lit("/s"), "o_orderkey").alias("path"))
    bare = T.customer.select(F.concat(F.lit("plain/"), "c_custkey").alias("file"), "c_nationkey")
    for what, table in (("named", named), ("bare", bare)):
        lists.append(scratch(T.spark, f"records-{what}"))
        table.write.option("header", "true").csv(lists[-1])
    return S.read_record_list(T.spark, lists[0]).unionByName(S.read_record_list(T.spark, lists[1]))


@query("source_run_folders", f"""with {X.H_} select 'fold' || fold as fold, 'v' || variant as variant, 's' || seed as seed, test_acc from runs""")
def _(T):
    root = scratch(T.spark, "runs")
    rows = T.runs.select(F.concat(F.lit("fold"), "fold").alias("fold"), F.concat(F.lit("v"), "variant").alias("variant"), F.concat(F.lit("s"), "seed").alias("seed"), "test_acc")
    # One folder per run, as experiment runners leave them; the writer puts "name=" before each key.
    rows.repartition("fold", "variant", "seed").write.partitionBy("fold", "variant", "seed").json(root)
    got = R.read_runs(T.spark, root, "test_acc double", "*.json")
    return got.select(*[F.substring_index(c, "=", -1).alias(c) for c in ("fold", "variant", "seed")], "test_acc")


# -- preprocessing chain ------------------------------------------------------------
#
# The oracles compute everything from the filters' definitions: sections from their
# poles, samples one after another by a recursive table, taps from the Kaiser window.

_SIGNALS = "sig as (select recording_id, channel, list(v order by t) as x from samples group by 1, 2)"


def _sections_sql(rows: list[dict[str, str]]) -> str:
    """One row of section coefficients ``b0_1, b1_1, ..`` from expressions per section."""
    return ", ".join(f"({e})::double as {n}_{k}" for k, row in enumerate(rows, 1) for n, e in row.items())


def _lowpass_sql(fs: float, cut: float) -> str:
    """Order 4: two sections with damping 2 cos(pi/8), 2 cos(3 pi/8) on the warped frequency."""
    k = f"tan(pi() * {cut} / {fs})"
    rows = []
    for part in ("pi() / 8", "3 * pi() / 8"):
        a0, d = f"(1 + 2 * cos({part}) * {k} + {k} * {k})", f"2 * cos({part}) * {k}"
        rows.append({"b0": f"{k} * {k} / {a0}", "b1": f"2 * {k} * {k} / {a0}", "b2": f"{k} * {k} / {a0}", "a1": f"2 * ({k} * {k} - 1) / {a0}", "a2": f"(1 - {d} + {k} * {k}) / {a0}"})
    return f"select {_sections_sql(rows)}"


def _notch_sql(fs: float, freq: float, q: float) -> str:
    w = f"(2 * pi() * {freq} / {fs})"
    g = f"(1 / (1 + tan({w} / {q} / 2)))"
    return f"select {_sections_sql([{'b0': g, 'b1': f'-2 * {g} * cos({w})', 'b2': g, 'a1': f'-2 * {g} * cos({w})', 'a2': f'2 * {g} - 1'}])}"


def _bandpass_sql(fs: float, lo: float, hi: float) -> str:
    """Order 4: each upper pole of the low-pass gives two poles of the band; a section is one with its conjugate."""
    first = f"select tan(pi() * {hi} / {fs}) - tan(pi() * {lo} / {fs}) as bw, tan(pi() * {lo} / {fs}) * tan(pi() * {hi} / {fs}) as w2"
    half = "select *, " + ", ".join(f"cos({k} * pi() / 8) * bw / 2 as h{k}, sin({k} * pi() / 8) * bw / 2 as g{k}" for k in (5, 7)) + f" from ({first})"
    root = "select *, " + ", ".join(f"h{k} * h{k} - g{k} * g{k} - w2 as u{k}, 2 * h{k} * g{k} as v{k}" for k in (5, 7)) + f" from ({half})"
    poles, at = [], []
    for k in (5, 7):
        size = f"sqrt(u{k} * u{k} + v{k} * v{k})"
        re, im = f"sqrt(({size} + u{k}) / 2)", f"sign(v{k}) * sqrt(({size} - u{k}) / 2)"
        for sign, n in (("+", len(at) + 1), ("-", len(at) + 2)):
            poles.append(f"h{k} {sign} {re} as x{n}, g{k} {sign} {im} as y{n}")
            at.append(n)
    placed = f"select *, {', '.join(poles)} from ({root})"
    sized = "select *, " + ", ".join(f"pow(1 - x{n}, 2) + y{n} * y{n} as d{n}" for n in at) + f" from ({placed})"
    gain = "bw / pow(d1 * d2 * d3 * d4, 0.25)"
    rows = [{"b0": gain, "b1": "0", "b2": f"-{gain}", "a1": f"-2 * (1 - x{n} * x{n} - y{n} * y{n}) / d{n}", "a2": f"(pow(1 + x{n}, 2) + y{n} * y{n}) / d{n}"} for n in at]
    return f"select {_sections_sql(rows)} from ({sized})"


def _zero_phase_sql(name: str, src: str, coefficients: str, sections: int) -> str:
    """CTEs up to ``name(recording_id, channel, x)``: forward and backward over the oddly extended signal."""
    pad, ks = 9 if sections == 1 else 3 * (2 * sections + 1), range(1, sections + 1)
    states = ", ".join(f"z1_{k}, z2_{k}" for k in ks)
    steady, u = [], "e[1]"
    for k in ks:
        steady.append(f"{u} * (b0_{k} + b1_{k} + b2_{k}) / (1 + a1_{k} + a2_{k}) as y{k}, y{k} - b0_{k} * {u} as z1_{k}, b2_{k} * {u} - a2_{k} * y{k} as z2_{k}")
        u = f"y{k}"
    step, u = [], "e[i + 2]"
    for k in ks:
        step.append(f"b0_{k} * {u} + z1_{k} as y{k}, b1_{k} * {u} - a1_{k} * y{k} + z2_{k} as n1_{k}, b2_{k} * {u} - a2_{k} * y{k} as n2_{k}")
        u = f"y{k}"
    last = f"y{sections}"

    def run(out, source):
        return f"""{out}(recording_id, channel, i, y, {states}) as (
  select recording_id, channel, 0::bigint, {last}, {states} from (select recording_id, channel, {', '.join(steady)} from {source}, {name}_c)
  union all select recording_id, channel, i + 1, {last}, {', '.join(f'n1_{k}, n2_{k}' for k in ks)} from (select f.recording_id, f.channel, i, {', '.join(step)} from {out} f join {source} s on s.recording_id = f.recording_id and s.channel = f.channel and f.i + 1 < len(s.e), {name}_c))"""

    return f"""{name}_c as materialized ({coefficients}),
{name}_p as (select *, least({pad}, len(x) - 1) as p from {src}),
{name}_e as materialized (select recording_id, channel, p, len(x) as n, list_concat(list_transform(range(1, p + 1), lambda k: 2 * x[1] - x[p + 2 - k]), list_concat(x, list_transform(range(1, p + 1), lambda k: 2 * x[len(x)] - x[len(x) - k]))) as e from {name}_p),
{run(f'{name}_f', f'{name}_e')},
{name}_g as materialized (select recording_id, channel, list(y order by i desc) as e from {name}_f group by 1, 2),
{run(f'{name}_b', f'{name}_g')},
{name}_h as (select recording_id, channel, list(y order by i desc) as y from {name}_b group by 1, 2),
{name} as materialized (select recording_id, channel, y[p + 1:p + n] as x from {name}_h join {name}_e using (recording_id, channel))"""


def _taps_sql(up: int, down: int) -> str:
    top = max(up, down)
    i0 = lambda x: f"list_sum(list_transform(range(0, 40), lambda k: pow({x} / 4, k) / pow(gamma(k + 1), 2)))"
    return f"""raw as (select n + {10 * top} as j, case when n = 0 then 1 else sin(pi() * n / {top}) / (pi() * n / {top}) end * {i0(f'(25.0::double * (1 - pow(n / {10 * top}.0::double, 2)))')} as h from unnest(range({-10 * top}, {10 * top + 1})) as r(n)),
taps as materialized (select j, {up} * h / sum(h) over () as h from raw)"""


def _resample_sql(src: str, up: int, down: int) -> str:
    """CTEs up to ``resampled(recording_id, channel, t, v)`` from ``src(recording_id, channel, x)``."""
    half, reach = 10 * max(up, down), 10 * max(up, down) // up + 2
    return f"""{_taps_sql(up, down)},
outs as (select recording_id, channel, x, unnest(range(0, (len(x) * {up} + {down - 1}) // {down})) as m from {src}),
resampled as (select recording_id, channel, m as t, sum(x[q + 1] * h) as v from (select recording_id, channel, x, m, unnest(range(greatest(m * {down} // {up} - {reach}, 0), least(m * {down} // {up} + {reach + 1}, len(x)))) as q from outs) join taps on j = m * {down} - q * {up} + {half} group by 1, 2, 3)"""


@query("filters_polyphase_resample", f"""with {X.A}, {_SIGNALS}, {_resample_sql('sig', 3, 4)}
select recording_id, channel, t, {sql_rnd('v', 5)} as v from resampled""")
def _(T):
    cfg = filters.Preprocess(target_rate=3.0, normalise="none")
    got = filters.preprocess(T.samples_wide, 4.0, cfg, frame=256, channels=X.CHANNELS)
    return got.select("recording_id", "channel", "t", rnd("v", 5).alias("v"))


_CHAIN = filters.Preprocess(notch=50.0, bandpass=(1.0, 40.0), target_rate=64.0, normalise="zscore", clip_sigma=5.0)


@query("filters_preprocess_chain", f"""with recursive {X.A}, {_SIGNALS},
{_zero_phase_sql('no', 'sig', _notch_sql(128.0, 50.0, 30.0), 1)},
{_zero_phase_sql('bp', 'no', _bandpass_sql(128.0, 1.0, 40.0), 4)},
{_resample_sql('bp', 1, 2)},
st as (select *, greatest(least((v - avg(v) over w) / greatest(stddev_pop(v) over w, 1e-8), 5), -5) as z from resampled window w as (partition by recording_id, channel))
select recording_id, channel, count(*) as n, {sql_rnd('avg(z)', 4)} as mean, {sql_rnd('max(z)', 4)} as top, {sql_rnd('avg(z * (t % 7))', 4)} as ordered from st group by 1, 2""")
def _(T):
    got = filters.preprocess(T.samples_wide, 128.0, _CHAIN, channels=X.CHANNELS)
    ordered = F.avg(F.col("v") * (F.col("t") % 7))
    return got.groupBy("recording_id", "channel").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("v"), 4).alias("mean"), rnd(F.max("v"), 4).alias("top"), rnd(ordered, 4).alias("ordered"))


@query("filters_lowpass_only", f"""with recursive {X.A}, {_SIGNALS}, {_zero_phase_sql('lp', 'sig', _lowpass_sql(100.0, 30.0), 2)},
long as (select recording_id, channel, unnest(x) as v, unnest(range(0, len(x))) as t from lp)
select recording_id, channel, count(*) as n, {sql_rnd('avg(v)', 4)} as mean, {sql_rnd('avg(v * (t % 7))', 3)} as ordered from long group by 1, 2""")
def _(T):
    got = filters.preprocess(T.samples_wide, 100.0, filters.Preprocess(lowpass=30.0, normalise="none"), channels=X.CHANNELS)
    return got.groupBy("recording_id", "channel").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("v"), 4).alias("mean"), rnd(F.avg(F.col("v") * (F.col("t") % 7)), 3).alias("ordered"))
