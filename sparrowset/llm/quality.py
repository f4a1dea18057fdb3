"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base rules are fixed. Beside them, each stratum (language) has one cutoff per signal, chosen on labelled documents:
a cutoff may be used only if an exact binomial bound shows that it rejects at most its part of a share `alpha` of good
documents, so that all signals together reject at most `alpha`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowset.llm.common import SPACE_CHARS, checkpointed, fresh, text_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Signal:
    """Documents whose score is over the cutoff are rejected. Cutoffs go from loose to strict."""

    name: str
    score: str  # whole numbers, so that cutoffs compare exactly; null without words
    cutoffs: tuple[int, ...]

    def over(self, cutoff: Column | int, names: dict[str, str] | None = None) -> Column:
        """Whether the score is over the cutoff; false if either is missing."""
        return F.coalesce(F.expr(self.score.format_map({c: f"`{(names or {}).get(c, c)}`" for c in MEASURES})) > cutoff, F.lit(False))


#: Per 1000 words; word_length in hundredths of a code point.
SIGNALS = (
    Signal("symbols", "1000 * {n_symbols} div nullif({n_words}, 0)", (2000, 1500, 1000, 750, 500, 350, 250, 150, 100, 50)),
    Signal("dup_lines", "1000 * {n_dup_lines} div nullif({n_words}, 0)", (300, 200, 150, 100, 75, 50, 35, 25, 15, 10)),
    Signal("repeat_words", "1000 * {n_repeat_words} div nullif({n_words}, 0)", (200, 180, 160, 140, 120, 100, 80, 60, 40, 20)),
    Signal("word_length", "100 * {word_chars} div nullif({n_words}, 0)", (3000, 2400, 2000, 1700, 1500, 1300, 1150, 1000, 900, 800)),
)


@dataclass(frozen=True)
class Risk:
    """With probability 1 - delta over all strata together, the cutoffs of a stratum reject at most a share alpha of its
    good documents (those that pass the base rules). alpha is shared out evenly over the signals, whose rejections add
    up at most; delta (Bonferroni) over strata x signals. Within one signal the cutoffs are tested from loose to strict
    and testing stops at the first that fails, which needs no further share."""

    alpha: float = 0.02
    delta: float = 0.05
    strata: tuple[str, ...] = ("de", "en", "es", "fr")
    other: str = "other"

    @property
    def signal_alpha(self) -> float:
        return self.alpha / len(SIGNALS)

    @property
    def level(self) -> float:
        return self.delta / ((len(self.strata) + 1) * len(SIGNALS))


def measures(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and the names they got.

    Null text has no words. Each number comes from the row's own whole text: nothing is shuffled. Repeated windows are
    found by sorting the window hashes of one document, and only in documents that repeat one.
    """
    names: dict[str, str] = {}
    for c in (*MEASURES, "base_failed", "t", "w", "l", "h", "s", "p"):
        names[c] = fresh(c if len(c) > 1 else f"quality_{c}", [*df.columns, *names.values()])
    n = {k: f"`{v}`" for k, v in names.items()}
    keep = [f"`{c}`" for c in df.columns]
    t = F.col(names["t"])
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    d = df.withColumn(names["t"], text_of(text_col)).select(
        "*",
        words(t).alias(names["w"]),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias(names["n_symbols"]),
        F.when(F.instr(t, "\n") > 0, lines).alias(names["l"]),
    )
    window = ", ".join(f"get({n['w']}, i + {k})" if k else f"get({n['w']}, i)" for k in range(WINDOW))
    d = d.withColumn(names["h"], F.expr(f"if(size({n['w']}) > {WINDOW}, transform(sequence(0, size({n['w']}) - {WINDOW}), i -> xxhash64({window})), cast(array() as array<bigint>))"))
    d = d.withColumn(names["s"], F.expr(f"if(size(array_distinct({n['h']})) < size({n['h']}), sort_array(transform({n['h']}, (x, i) -> named_struct('h', x, 'i', i))), null)"))
    s = n["s"]
    same = f"get({s}, j - 1).h <=> x.h or get({s}, j + 1).h <=> x.h"
    d = d.withColumn(names["p"], F.expr(f"if({s} is null, null, sort_array(transform(filter({s}, (x, j) -> {same}), x -> x.i)))"))
    covered = f"aggregate(transform({n['p']}, (x, j) -> least({WINDOW}, coalesce(get({n['p']}, j + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)"
    # a generator of one row: what filters on these columns stays above it, and doesn't compute the arrays anew
    d = d.select(
        *keep,
        F.inline(
            F.array(
                F.struct(
                    F.size(names["w"]).cast("long").alias(names["n_words"]),
                    F.length(F.array_join(F.col(names["w"]), "")).cast("long").alias(names["word_chars"]),
                    F.col(names["n_symbols"]).alias(names["n_symbols"]),
                    F.expr(f"coalesce(size({n['l']}) - size(array_distinct({n['l']})), 0)").cast("long").alias(names["n_dup_lines"]),
                    F.expr(f"coalesce({covered}, 0L)").alias(names["n_repeat_words"]),
                )
            )
        ),
    )
    return d.withColumn(names["base_failed"], F.expr(f"{n['n_words']} < 10 or 100 * {n['n_repeat_words']} > 20 * {n['n_words']}")), {k: names[k] for k in (*MEASURES, "base_failed")}


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: the recurrence lifts x by 8, where Stirling's series is exact to 1e-14."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    lift = F.lit(0.0)
    for k in range(8):
        lift = lift + F.log(x + float(k))
    return series - lift


def binomial_below(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact but for rounding, at any size; 1 where k is not under n * p.

    Added from the largest term (that of k) down: in logarithms first, then by ratios, so that no n underflows. Where
    k < n * p, the term d places down is at most exp(-d * (d - 1) / (2 k)) of the largest, so that what lies beyond
    10 * sqrt(k) + 50 places is under 1e-20 of the sum: no term that a double can tell is left out.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    steps = F.least(kd, F.ceil(10 * F.sqrt(kd)) + 50).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] * (kd - j + 1) / (nd - kd + j) * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), zero, add, lambda a: a["sum"])
    return F.when(kd >= nd * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def stratum(lang_col: str, risk: Risk) -> Column:
    """A language of the list, else `other` (null too): so the number of strata is fixed."""
    lang = F.col(f"`{lang_col}`")
    return F.when(lang.isin(*risk.strata), lang).otherwise(risk.other)


def fit_cutoffs(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """stratum, signal, cutoff: at most one row for each of them, (len(strata) + 1) * len(SIGNALS) rows at most.

    labelled: stratum, quality (1 good, 0 bad, else not used) and the measures, base failures left out. Every row
    counts, in one aggregation whose partial sums are a few hundred numbers a task. Of the cutoffs that pass, the one
    that rejects the most bad documents less good ones is taken (of equals the loosest), and none unless that is over 0.
    """
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    # how many of its cutoffs a score is over: cutoffs fall from step to step, so it is over those of the last steps
    met = F.array(*[F.struct(F.lit(s.name).alias("signal"), sum((s.over(c).cast("int") for c in s.cutoffs), F.lit(0)).alias("met")) for s in SIGNALS])
    steps = F.create_map(*[x for s in SIGNALS for x in (F.lit(s.name), F.array(*map(F.lit, s.cutoffs)))])
    each_met = labelled.select("stratum", "quality", F.explode(met).alias("m")).groupBy("stratum", "m.signal", "m.met").agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    by = each_met.groupBy("stratum", "signal").agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("met", "good", "bad")).alias("mets"))  # one for each cutoff and 0
    by = by.withColumn("cutoffs", steps[F.col("signal")])
    cell = by.select("stratum", "signal", "n_good", "mets", F.posexplode("cutoffs").alias("step", "cutoff"), F.size("cutoffs").alias("steps"))
    hits = F.filter("mets", lambda m: m["met"] >= F.col("steps") - F.col("step"))
    total = lambda name: F.aggregate(F.transform(hits, lambda m: m[name]), F.lit(0).cast("long"), lambda a, x: a + x)
    cell = checkpointed(cell.select("stratum", "signal", "n_good", "step", F.col("cutoff").cast("long").alias("cutoff"), total("good").alias("good_hit"), total("bad").alias("bad_hit")))
    tested = cell.withColumn("passed", (F.col("n_good") > 0) & (binomial_below(F.col("good_hit"), F.col("n_good"), risk.signal_alpha) <= risk.level))
    failed_at = F.min(F.when(~F.col("passed"), F.col("step")))
    usable = F.struct((F.col("bad_hit") - F.col("good_hit")).alias("gain"), (-F.col("step")).alias("loose"), F.col("cutoff"), F.col("step"))
    each = tested.groupBy("stratum", "signal").agg(failed_at.alias("failed_at"), F.array_sort(F.collect_list(usable)).alias("all"))  # ten cells
    best = F.array_max(F.filter("all", lambda x: (x["gain"] > 0) & (F.col("failed_at").isNull() | (x["step"] < F.col("failed_at")))))
    return each.select("stratum", "signal", best["cutoff"].alias("cutoff")).filter("cutoff is not null")


def cutoffs_for(measured: DataFrame, names: dict[str, str], labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The cutoffs learnt from the labelled rows of what measures() gave. Only numbers are shuffled to meet the labels."""
    rows = measured.select(F.col(f"`{id_col}`").alias("id"), stratum(lang_col, risk).alias("stratum"), *[F.col(f"`{names[c]}`").alias(c) for c in (*MEASURES, "base_failed")])
    known = labels.select(F.col("doc_id").alias("id"), "quality").filter("id is not null and quality in (0, 1)")
    return fit_cutoffs(rows.filter("not base_failed").join(known, "id"), risk)


def judge(measured: DataFrame, names: dict[str, str], cutoffs: DataFrame, risk: Risk = Risk(), lang_col: str = "lang") -> tuple[DataFrame, dict[str, str]]:
    """What measures() gave, with kept: neither the base rules nor a cutoff of the row's stratum rejects it."""
    own: list[str] = []
    for c in ("kept", "quality_key", "quality_stratum", "quality_cuts"):
        own.append(fresh(c, [*measured.columns, *own]))
    kept, key, other, cuts = own
    # five rows of four numbers at most, as strata and signals are fixed lists
    table = cutoffs.groupBy(F.col("stratum").alias(other)).agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias(cuts))
    joined = measured.withColumn(key, stratum(lang_col, risk)).join(F.broadcast(table), F.col(key) == F.col(other), "left")
    rejected = F.lit(False)
    for s in SIGNALS:
        rejected = rejected | s.over(F.col(cuts)[s.name], names)
    return joined.withColumn(kept, ~F.col(names["base_failed"]) & ~rejected).drop(key, other, cuts), names | {"kept": kept}


def quality_rules(df: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, dict[str, str]]:
    """df with the measures, base_failed and kept, and the names they got.

    labels: doc_id, quality. A label counts once for each document row with its id; null ids and null labels match
    nothing. Null text is empty; documents without words fail the base rules. Equal scores fare alike, and repeated rows
    get one verdict. Without enough labelled good documents in a stratum no cutoff passes, and only the base rules
    reject there. An empty table stays empty. Columns of any name are allowed.

    Each text is measured once: df with its numbers is checkpointed in the shared folder, where the cutoffs and the
    verdicts read it. Texts are never shuffled.
    """
    measured, names = measures(df, text_col)
    measured = checkpointed(measured)
    return judge(measured, names, cutoffs_for(measured, names, labels, risk, id_col, lang_col), risk, lang_col)
