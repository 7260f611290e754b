import re
from collections import Counter

import pytest

from signalframe.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def brute_rejects(text):
    n, chars, symbols, dup, rep = brute(text)
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    upper = sum(c.isupper() for c in text or "")
    return n < 50 or not 3 * n <= chars <= 12 * n or 100 * symbols > 10 * n or 100 * upper > 50 * chars or 100 * dup > 40 * len(lines) or 100 * rep > 50 * n


def test_features_and_verdicts(odd):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    full = quality.cascade(odd, features=tuple(quality.FEATURES)).collect()
    assert len(full) == odd.count()
    for r in full:
        want = [(*brute(t), not brute_rejects(t)) for t in texts[r.doc_id]]
        assert (r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"], r["kept"]) in want


@pytest.mark.parametrize("turn", [1, -1])
def test_order_does_not_change_the_verdict(odd, empty, turn):
    order = [{"rule": r} for r in quality.default_rules()[::turn]]
    out = quality.cascade(odd, order=order)
    assert set(out.columns) == {*odd.columns, "rejected_by"}
    for r in out.collect():
        assert r.kept == (r.rejected_by is None) == (not brute_rejects(r.text))
    assert quality.cascade(empty).collect() == []


def test_rejected_rows_are_hidden_from_later_rules(spark, odd, monkeypatch):
    """A feature that fails on every text an earlier rule rejects is never evaluated there."""
    from pyspark.sql import functions as F

    def fails(df):
        few = F.size(F.filter(F.split("__text", quality.GAP), lambda w: w != "")) < 50
        return df.withColumn("__n_upper", F.when(few, F.raise_error(F.lit("evaluated"))).otherwise(F.regexp_count("__text", F.lit(r"\p{Lu}"))).cast("long"))

    monkeypatch.setitem(quality.FEATURES, "n_upper", fails)
    rules = {r.name: r for r in quality.default_rules()}
    first = [{"rule": rules[n]} for n in ("few_words", "capitals", "word_length", "symbols", "repeated_lines", "repeated_words")]
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality.cascade(odd, order=first, features=base).collect():
        assert r.kept == (not brute_rejects(r.text)) and r["__n_words"] == brute(r.text)[0]
    with pytest.raises(Exception, match="evaluated"):
        quality.cascade(odd, order=[first[1], first[0], *first[2:]], features=base).collect()


def test_order_by_rejections_per_cost(odd):
    rules = quality.default_rules()
    found = quality.rule_order(quality.sample_of(odd), rules)
    score = [f["rejected"] / f["cost"] for f in found]
    assert score == sorted(score, reverse=True) and len(found) == len(rules)


def test_no_python_in_the_plan(odd):
    plan = quality.cascade(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
