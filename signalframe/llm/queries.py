"""One query per operator over the whole ``documents`` table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from .common import documents, shared_path, text_of, words_of
from .fingerprints import compare
from .licenses import TEMPLATES, scan
from .line_dedup import dedup_lines
from .lm import score
from .mixing import mix
from .periodic import find_runs, planted
from .pieces import segmentations
from .quality import cascade
from .simhash import near_groups
from .token_counts import attribute
from .token_files import read_tokens, with_crc, write_tokens
from .topk import top_k
from .whitening import whiten

#: Where the public tokenizers' files lie; the same on every worker.
TOKENIZERS = "/opt/tokenizers"

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op8_quality_rules(spark, sf_dir):
    # The result's own features are measured everywhere, all others behind earlier rules.
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    df = cascade(documents(spark, sf_dir), features=names)
    base_failed = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    return df.select(
        "doc_id", *[F.col(f"__{n}").alias(n) for n in names], base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept")
    )


# DuckDB drops nothing a row needs: windows are counted per document by their words.
ORACLES["op8_quality_rules"] = r"""
with d as (select doc_id, row_number() over () r, coalesce(text, '') t from documents),
w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
b as (select *, len(ws) n_words, len(array_to_string(ws, '')) word_chars,
        len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
        len(t) - len(regexp_replace(t, '\p{Lu}', '', 'g')) n_upper, len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines from w),
p as (select r, unnest(range(1, len(ws) - 1)) i, ws from b where len(ws) >= 4),
g as (select r, i, count(*) over (partition by r, ws[i], ws[i+1], ws[i+2]) c from p),
h as (select distinct r, i + k pos from g, (values (0), (1), (2)) o(k) where c > 1),
q as (select r, count(*) n_repeat_words from h group by r),
f as (select b.*, coalesce(q.n_repeat_words, 0) n_repeat_words from b left join q using (r)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from f)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
  n_repeat_words::bigint n_repeat_words, base_failed,
  not (base_failed or 100 * n_upper > 50 * word_chars or word_chars < 3 * n_words or word_chars > 12 * n_words or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 40 * n_lines) kept
from v
"""


@_query
def op1_source_mix(spark, sf_dir):
    return mix(documents(spark, sf_dir)).drop("row")


@_query
def op5_simhash(spark, sf_dir):
    return near_groups(documents(spark, sf_dir))


@_query
def op6_token_files(spark, sf_dir):
    folder = shared_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), folder, f"{TOKENIZERS}/word_bpe_49k.json")
    return with_crc(read_tokens(spark, folder))


@_query
def op10_line_dedup(spark, sf_dir):
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


@_query
def op9_sampled_pieces(spark, sf_dir):
    out = segmentations(documents(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")
    return out.select("doc_id", "draw", "n_pieces", "log_prob", "value", "log_inclusion", "ids", "decoded")


@_query
def op4_fingerprints(spark, sf_dir):
    return compare(documents(spark, sf_dir))


@_query
def op7_lm_scores(spark, sf_dir):
    return score(documents(spark, sf_dir))


@_query
def op2_license_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir))


_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)

# Exact containment by joining shingles; a template of up to five words is one shingle.
ORACLES["op2_license_scan"] = rf"""
with t(license, text) as (values {_TEMPLATES}),
every_text as (select license id, null::bigint doc_id, text from t union all select 'd' || row_number() over (), doc_id, text from documents where text is not null),
w as (select id, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') ws from every_text),
s as (select id, doc_id, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i, ws from w where len(ws) > 0),
h as (select id, doc_id, i - 1 i, array_to_string(ws[i:i+4], ' ') s from s),
n as (select id license, count(distinct s) n from h where id in (select license from t) group by 1),
m as (select d.id, d.doc_id, n.license, count(distinct d.s) c, min(d.i) a, max(d.i) b, any_value(n.n) n
      from h d join (select distinct id, s from h where id in (select license from t)) x on d.s = x.s join n on n.license = x.id
      where d.id not in (select license from t) group by d.id, d.doc_id, n.license)
select doc_id, license, c / n contained, a::int first_shingle, b::int last_shingle from m where c >= 0.8 * n
"""


@_query
def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return attribute(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)


@_query
def op11_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op12_top_k(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


# Every query against every row, as the blocks of one product do.
ORACLES["op12_top_k"] = """
with v as (select row_number() over () r, vec_id, list_transform(embedding, lambda c: floor(64 * c::double)::bigint::double) x from embeddings
           where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.r, q.vec_id query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint score from v q join v c on q.vec_id % 20 = 0 and c.r <> q.r),
t as (select *, row_number() over (partition by r order by score desc, vec_id nulls last) "rank" from s)
select query_id, "rank"::int "rank", vec_id, score from t where "rank" <= 20
"""


@_query
def op13_periodic_runs(spark, sf_dir):
    df = find_runs(documents(spark, sf_dir), planted(words_of(text_of()), F.col("doc_id")))
    order = lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"))
    top = F.array_min(F.transform("runs", order))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["b"].alias("start"), (-top["a"]).alias("length"), top["c"].alias("period"),
        F.floor(1000 * -top["a"] / top["c"]).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
