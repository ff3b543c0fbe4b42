"""Quality rules with risk-controlled thresholds, native throughout.

Rates of each text (symbols a word, repeated lines a line, repeated words a word) are compared with
cutoffs. For each stratum and rate the cutoffs of a fixed grid are tried from the most lenient down on
the labelled holdout of good documents: a cutoff stands if the exact binomial test rejects, at its
corrected level, that it would reject more than `risk` of the good documents. The first cutoff that
fails ends the search (fixed sequence, so the grid needs no correction); strata and rates are
corrected by Bonferroni, and `risk` is split evenly over the rates, so that with probability 1 - `level`
no stratum loses more than `risk` of its good documents to all rates together. A stratum with too
few labels to prove anything gets no cutoff and keeps all.

Windows of three words are compared by XXH64 and then, where hashes agree, nothing else: two different
windows of one text agree with probability 2^-64.

Edge cases. A null text has no words and fails the base rule; a null stratum is one of its own (that of the empty
name); a document with several labels counts as good if any says so; labels of unknown ids are ignored; repeated rows
get a row each; an empty table gives none, and without labels there is no cutoff; whole texts are read whatever their
length; columns named as those that are made (MADE) are replaced, any others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, column, materialize, packed, unpacked, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
RISK, LEVEL = 0.06, 0.05
MADE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "symbol_rate", "line_rate", "repeat_rate", "kept")
GRIDS = {
    "symbol_rate": ("n_symbols", "n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "line_rate": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "repeat_rate": ("n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
}


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    return rated_rows(docs, text_col).select(*unpacked(docs, (text_col, *MADE)), *MADE[:7])


def rated_rows(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """The features, with docs' columns in one struct `_row`, and more columns."""
    text = F.coalesce(column(text_col), F.lit(""))
    kept = ["_row", *(f"_x{i}" for i in range(len(more)))]
    stages = docs.select(packed(docs, (text_col, *MADE)), *[x.alias(f"_x{i}") for i, x in enumerate(more)], text.alias("_t"), words_of(column(text_col)).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("_l"))
    n = F.size("_w")
    at = lambda i: F.get(F.col("_w"), i)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))
    stages = stages.withColumn("_s", F.array_sort(F.when(n >= 3, windows)))
    same = lambda x, k: F.coalesce(F.get(F.col("_s"), k)["h"] == x["h"], F.lit(False))
    around = lambda x, k: same(x, k - 1) | same(x, k + 1)
    stages = stages.withColumn("_h", F.sort_array(F.transform(F.filter("_s", around), lambda x: x["i"])))
    covered = F.aggregate("_h", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(3))).alias("n"), i.alias("last")), lambda a: a["n"])
    out = stages.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def cutoffs(rated: DataFrame, good_ids: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(_stratum, and for each rate the smallest cutoff that was proved harmless, null where none was).

    rated: features with `_id` and `_stratum`; good_ids: the ids (`_id`) of documents that were labelled good.
    """
    held = rated.where("NOT base_failed").join(good_ids.where("_id IS NOT NULL").distinct(), "_id")
    each = risk / len(GRIDS)
    over = [F.sum(F.when(F.col(a) > c * F.col(b), 1).otherwise(0)).cast("long").alias(f"{name}_{i}") for name, (a, b, grid) in GRIDS.items() for i, c in enumerate(grid)]
    tested = materialize(held.groupBy("_stratum").agg(F.count("*").alias("_n"), *over), "strata")
    strata = tested.count()
    log_odds = math.log(each / (1 - each))
    for name, (_, _, grid) in GRIDS.items():
        stacked = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{name}_{i}").alias("k")) for i, c in enumerate(grid)])

        def tail(k: Column) -> Column:  # P(X <= k), X binomial(n, each), from the logarithms of its terms
            first = F.struct((F.col("_n") * math.log1p(-each)).alias("t"), F.exp(F.col("_n") * math.log1p(-each)).alias("s"))
            step = lambda a, i: F.struct((a["t"] + F.log((F.col("_n") - i + 1) / i) + log_odds).alias("t"), (a["s"] + F.exp(a["t"] + F.log((F.col("_n") - i + 1) / i) + log_odds)).alias("s"))
            return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), first, step, lambda a: a["s"])

        passed = F.filter(stacked, lambda x: tail(x["k"]) <= F.lit(level / len(GRIDS)) / F.lit(float(max(strata, 1))))
        tested = tested.withColumn(name, F.array_min(F.transform(passed, lambda x: x["c"])))
    return tested.select("_stratum", *GRIDS)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", *, good: Column | None = None, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """docs without the text, with the features, the cutoffs of the document's stratum and kept.

    labels: (id, quality, ...); `good` picks the good ones, quality = 1 unless given.
    """
    good = F.col("quality") == 1 if good is None else good
    rated = rated_rows(docs, text_col, column(id_col), F.coalesce(column(stratum).cast("string"), F.lit("")))
    rated = materialize(rated.withColumnsRenamed({"_x0": "_id", "_x1": "_stratum"}), "rated")
    cuts = cutoffs(rated, labels.where(good).select(column(id_col).alias("_id")), risk, level)
    joined = rated.join(cuts, "_stratum", "left")
    rejected = F.lit(False)
    for name, (a, b, _) in GRIDS.items():
        rejected |= F.coalesce(F.col(a) > F.col(name) * F.col(b), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).select(*unpacked(docs, (text_col, *MADE)), *MADE)


def judge_sql() -> str:
    """DuckDB SQL for op2's rows over documents and labels."""
    each, tests = RISK / len(GRIDS), len(GRIDS)
    grids = ", ".join(f"('{name}', {c!r}::double)" for name, (_, _, grid) in GRIDS.items() for c in grid)
    rate = lambda name: f"case when {name} = 'symbol_rate' then n_symbols when {name} = 'line_rate' then n_dup_lines else n_repeat_words end > c * (case when {name} = 'line_rate' then n_lines else n_words end)"
    return f"""with t as (select doc_id, lang, coalesce(text, '') t from documents),
w as (select doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from t),
win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
hit as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, sum(least(3, gap)) n from (select doc_id, coalesce(i - lag(i) over (partition by doc_id order by i), 3) gap from hit) group by doc_id),
f as (select w.doc_id, coalesce(lang, '') stratum, len(ws)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint word_chars,
 (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols, len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
 coalesce(cov.n, 0)::bigint n_repeat_words from w left join cov on cov.doc_id = w.doc_id),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words base_failed from f),
held as (select b.* from b where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
strata as (select count(distinct stratum) s from held),
counted as (select stratum, name, c, count(*) n, count(*) filter ({rate('name')}) k from held, (values {grids}) g(name, c) group by all),
passed as (select stratum, name, min(c) c from counted, strata
 where list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({each!r}) + (n - i) * ln(1 - {each!r})))) <= {LEVEL / tests!r} / s group by all),
bad as (select distinct b.doc_id from b join passed using (stratum) where {rate('name')})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from bad) kept from b"""
