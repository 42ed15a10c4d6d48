"""Operator 9: quality rules whose cutoffs carry a finite-sample guarantee.

A rule rejects a document when one metric lies beyond a cutoff. Labelled documents that pass the base rule are split by a
hash of their id into a design half and a holdout half. The design half proposes, for each stratum, a path of rule sets: at
level q of LEVELS each rule has the loosest of its best cutoffs among those that falsely reject at most a share q of good
design documents, and is off where it would take less than LEAST_GAIN of the bad ones. The rule sets tighten along the path.
The holdout half certifies: if a rule set falsely rejects k of the n good holdout documents of a stratum, the exact binomial
tail P(Bin(n, alpha) <= k) is the p-value of "its rules together reject more than a share alpha of good documents". Levels
are tested in order and testing stops at the first failure (fixed-sequence testing), so a path needs no correction for its
length; strata are corrected by Bonferroni. With probability 1 - delta all rule sets in use hold at once. Of the certified
levels the one with the largest (bad share - good share / alpha) on the design half is used.

A stratum with fewer good holdout documents than could certify a rule set without any false rejection,
ln(delta / strata) / ln(1 - alpha), is pooled with the others of this kind: they share one rule set, and the guarantee is the
pool's. If the pool is too small as well, its rules are off. The guarantee is about good documents that pass the base rule;
what the base rule rejects is not the method's doing.

Everything is DataFrame functions: no Python runs on executors and nothing but the schema and a number reaches the driver.

Edge cases: a null or blank text has no words and fails the base rule; a null stratum is a stratum of its own; strata
without labels keep all that passes the base rule; labels for unknown documents and null labels are ignored; of
repeated labels for an id the lowest quality counts; an empty documents table gives an empty result; extra columns,
also ones named like the metrics, don't take part in the measuring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WS, checked_broadcast, fresh_name, words, write_table

_POSITION_BITS = 20
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Reject when metric > cutoff (or < cutoff); cutoffs go from loose to tight in equal steps."""

    name: str
    metric: str
    upper: bool
    loose: float
    tight: float


#: Metrics are shares or means, so that one grid serves texts of every length.
RULES = (
    Rule("symbols", "symbol_share", True, 0.60, 0.01),
    Rule("dup_lines", "dup_line_share", True, 0.95, 0.05),
    Rule("repeats", "repeat_share", True, 0.50, 0.02),
    Rule("long_words", "mean_word", True, 24.0, 6.0),
    Rule("short_words", "mean_word", False, 1.0, 4.0),
)
GRID = 48
#: False-rejection shares of the design half that make the path, and the share of bad documents below which a rule stays off.
LEVELS = (0.0, 0.0025, 0.005, 0.01, 0.02, 0.03)
LEAST_GAIN = 0.05
ALPHA, DELTA = 0.05, 0.05


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus one struct column `quality_m` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    The columns of docs stay as they are. The name of the struct gets underscores until it is free.
    """
    names = docs.columns
    t, w, h, c, g, out = (fresh_name(names, f"quality_{x}") for x in ("t", "w", "h", "c", "g", "m"))
    mask = (1 << _POSITION_BITS) - 1
    at = lambda a, i: F.get(F.col(a), i)
    df = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(w, words(F.col(t)))
    n = F.size(w)
    # Each three-word window as one long: 44 hash bits above, 20 position bits below. Sorting longs is a primitive sort,
    # and windows that can be equal become neighbours. Longer texts compare all their windows as strings at once.
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")),
    )
    none = F.array().cast("array<bigint>")
    df = df.withColumn(h, F.when((n >= 4) & (n <= mask), F.sort_array(packed)).otherwise(none))
    top = lambda x: F.shiftright(x, _POSITION_BITS)
    near = F.filter(
        F.col(h),
        lambda x, j: F.coalesce(top(x) == top(at(h, j - 1)), F.lit(False)) | F.coalesce(top(x) == top(at(h, j + 1)), F.lit(False)),
    )
    df = df.withColumn(
        c,
        F.when(n > mask, F.sequence(F.lit(0), n - 3)).otherwise(F.transform(near, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))),
    )
    # The few windows that remain are compared as strings, so the count does not rest on hashes.
    grams = F.transform(
        F.col(c), lambda i: F.struct(F.concat_ws(" ", at(w, i), at(w, i + 1), at(w, i + 2)).alias("g"), i.alias("i"))
    )
    df = df.withColumn(g, F.when(F.size(c) > 0, F.sort_array(grams)))
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    twice = F.filter(F.col(g), lambda x, j: same(x, at(g, j - 1)) | same(x, at(g, j + 1)))
    df = df.withColumn(g, F.when(F.col(g).isNull(), F.array().cast("array<int>")).otherwise(F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform(F.col(g), lambda p, j: F.least(F.lit(3), F.coalesce(at(g, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0)
    df = df.withColumn(c, lines)
    return df.withColumn(
        out,
        F.struct(
            n.cast("long").alias("n_words"),
            F.char_length(F.translate(F.col(t), WS, "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(F.col(t), SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(c).cast("long").alias("n_lines"),
            (F.size(c) - F.size(F.array_distinct(c))).cast("long").alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"),
        ),
    ).drop(t, w, h, c, g)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def metric(m: Column, name: str) -> Column:
    """A rule's metric from the measured struct; 0 where its denominator is 0."""
    share = lambda a, b: F.when(m[b] > 0, m[a] / m[b]).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word": share("word_chars", "n_words"),
    }[name]


def cutoff(rule: Rule, step: Column | int) -> Column:
    """The cutoff at a step of the rule's grid."""
    return F.lit(rule.loose) + (F.lit(rule.tight) - F.lit(rule.loose)) * step / F.lit(GRID - 1)


def _first_step(rule: Rule, value: Column) -> Column:
    """The loosest step that rejects the value, GRID if none does. Beyond means strictly beyond."""
    way = (value - rule.loose) * (1 if rule.tight > rule.loose else -1)
    width = abs(rule.tight - rule.loose) / (GRID - 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(GRID), (F.ceil(way / width) if (rule.tight < rule.loose) == rule.upper else F.floor(way / width)).cast("int") - 2))
    beyond = lambda k: (value > cutoff(rule, k)) if rule.upper else (value < cutoff(rule, k))
    out = F.lit(GRID)
    for d in (4, 3, 2, 1, 0):  # rounding may shift the guess, the comparison itself decides
        k = guess + d
        out = F.when((k < GRID) & beyond(k), k).otherwise(out)
    return out


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 10, brought back by the recurrence; x >= 1."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    low = F.log(x)
    for i in range(1, 10):
        low = low + F.log(x + i)
    return series - low


def log_binomial_tail(k: Column, n: Column, p: float, terms: int = 400) -> Column:
    """log P(Bin(n, p) <= k) for k <= n p, from the largest term down.

    After `terms` terms the rest is bounded by a geometric series, so the value is never below the exact one by more
    than rounding: a guarantee drawn from it holds.
    """
    k, n = k.cast("double"), n.cast("double")
    odds = p / (1 - p)
    first = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int"))
    grow = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] * F.greatest(k - i, F.lit(0.0)) / (n - k + i + 1) / odds).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"] + F.when(k > terms, a["t"] / F.greatest(F.lit(1e-9), 1 - (k - terms) / (n - k + terms + 1) / odds)).otherwise(0.0),
    )
    return first + F.log(grow)


def in_design(doc_id: Column) -> Column:
    """Whether a labelled document is in the design half: a hash that SQL engines share."""
    return F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 1) < "8"


def _design_steps(design: DataFrame, alpha: float) -> DataFrame:
    """pool, key, level, steps: the rule set (a step for each rule, null if off) that the design half proposes at each level."""
    counted = (
        design.select("pool", "key", "good", F.posexplode("steps").alias("rule", "step"))
        .groupBy("pool", "key", "rule", "step").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    )
    per = counted.groupBy("pool", "key", "rule").agg(
        F.map_from_entries(F.collect_list(F.struct("step", F.struct("good", "bad")))).alias("at"), F.sum("good").alias("n"), F.sum("bad").alias("n_bad")
    )  # at most GRID + 1 cells
    got = lambda f: F.coalesce(F.try_element_at(F.col("at"), F.col("step"))[f], F.lit(0))
    w = Window.partitionBy("pool", "key", "rule").orderBy("step")
    steps = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("step"))
    steps = steps.select("pool", "key", "rule", "step", "n", "n_bad", F.sum(got("good")).over(w).alias("k"), F.sum(got("bad")).over(w).alias("k_bad"))
    steps = steps.where((F.col("k_bad") > 0) & (F.col("k_bad") >= LEAST_GAIN * F.col("n_bad"))).withColumn("gain", _gain("k", "n", "k_bad", "n_bad", alpha))
    steps = steps.select("*", F.posexplode(F.array(*[F.lit(q) for q in LEVELS])).alias("level", "q")).where(F.col("k") <= F.col("q") * F.col("n"))
    best = steps.groupBy("pool", "key", "level", "rule").agg(F.max_by("step", F.struct("gain", -F.col("step"))).alias("step"))
    return best.groupBy("pool", "key", "level").agg(F.array(*[F.max(F.when(F.col("rule") == i, F.col("step"))) for i in range(len(RULES))]).alias("path"))


def _gain(k: str, n: str, k_bad: str, n_bad: str, alpha: float) -> Column:
    """What a cutoff is worth: using up the whole risk costs as much as all bad documents bring."""
    return F.col(k_bad) / F.greatest(F.col(n_bad), F.lit(1)) - F.col(k) / F.greatest(F.col(n), F.lit(1)) / alpha


def fit_cutoffs(measured: DataFrame, labels: DataFrame, m: str, stratum: str = "lang", doc_id: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified rule set: `stratum`, and for each rule of RULES its cutoff (null: the rule is off).

    Counting is over all labelled documents, pre-aggregated to (stratum, rule, step) and (stratum, level) cells.
    """
    good = labels.groupBy(F.col(doc_id).alias("label_id")).agg(F.min("quality").alias("label"))
    rows = measured.select(F.col(doc_id).alias("label_id"), F.col(stratum).alias("stratum"), F.col(m).alias("m")).where(~base_failed(F.col("m")))
    rows = rows.join(good.where(F.col("label").isNotNull()), "label_id")
    steps = F.array(*[_first_step(r, metric(F.col("m"), r.metric)) for r in RULES])
    rows = write_table(rows.select("stratum", (F.col("label") > 0).alias("good"), in_design(F.col("label_id")).alias("design"), steps.alias("steps")), "labelled")
    holdout = F.sum((F.col("good") & ~F.col("design")).cast("long"))
    strata = write_table(rows.groupBy("stratum").agg(holdout.alias("n")), "strata")
    tests = strata.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata")).scalar()
    small = F.col("n") < F.ceil(F.log(F.lit(delta) / tests) / math.log(1 - alpha))
    strata = strata.select(F.col("stratum").alias("of"), small.alias("pool"), F.when(~small, F.col("stratum")).alias("key"))
    rows = rows.join(checked_broadcast(strata), F.col("stratum").eqNullSafe(F.col("of"))).select("pool", "key", "good", "design", "steps")
    path = write_table(_design_steps(rows.where("design"), alpha), "path")  # a few rows for each stratum
    side = checked_broadcast(path.select(F.col("pool").alias("p_pool"), F.col("key").alias("p_key"), "level", "path"))
    tried = rows.join(side, F.col("pool").eqNullSafe(F.col("p_pool")) & F.col("key").eqNullSafe(F.col("p_key")))
    fires = F.exists(F.zip_with("steps", "path", lambda x, y: F.coalesce(x <= y, F.lit(False))), lambda x: x)
    count = lambda where: F.sum(where.cast("long"))
    good_, design = F.col("good"), F.col("design")
    tried = tried.withColumn("fires", fires).groupBy("pool", "key", "level").agg(
        count(good_ & ~design).alias("n"), count(good_ & ~design & F.col("fires")).alias("k"),
        count(good_ & design).alias("d_n"), count(good_ & design & F.col("fires")).alias("d_k"), count(~good_ & design).alias("d_bad"), count(~good_ & design & F.col("fires")).alias("d_k_bad"),
    )
    passed = (F.col("n") > 0) & (F.col("k") <= alpha * F.col("n")) & (log_binomial_tail(F.col("k"), F.col("n"), alpha) <= F.log(F.lit(delta) / tests))
    tried = tried.withColumn("ok", F.min(F.coalesce(passed, F.lit(False)).cast("int")).over(Window.partitionBy("pool", "key").orderBy("level")) == 1)
    tried = tried.withColumn("gain", _gain("d_k", "d_n", "d_k_bad", "d_bad", alpha)).where("ok AND gain > 0")
    best = tried.groupBy(F.col("pool").alias("c_pool"), F.col("key").alias("c_key")).agg(F.max_by("level", F.struct("gain", -F.col("level"))).alias("c_level"))
    chosen = path.join(best, F.col("pool").eqNullSafe(F.col("c_pool")) & F.col("key").eqNullSafe(F.col("c_key")) & (F.col("level") == F.col("c_level"))).select("c_pool", "c_key", "path")
    out = strata.join(chosen, F.col("pool").eqNullSafe(F.col("c_pool")) & F.col("key").eqNullSafe(F.col("c_key")))
    return out.select(F.col("of").alias("stratum"), *[cutoff(r, F.get(F.col("path"), F.lit(i))).alias(r.name) for i, r in enumerate(RULES)])


def judge(measured: DataFrame, cutoffs: DataFrame, m: str, stratum: str = "lang") -> tuple[DataFrame, str]:
    """measured plus a boolean column (its name is the second result): passes the base rule and all cutoffs of its stratum."""
    taken = measured.columns
    key, cut, kept = fresh_name(taken, "cut_stratum"), fresh_name(taken, "cut_at"), fresh_name(taken, "quality_kept")
    side = checked_broadcast(cutoffs.select(F.col("stratum").alias(key), F.struct(*[r.name for r in RULES]).alias(cut)))
    df = measured.join(side, F.col(stratum).eqNullSafe(F.col(key)), "left")
    ok = ~base_failed(F.col(m))
    for r in RULES:
        value, at = metric(F.col(m), r.metric), F.col(f"{cut}.{r.name}")
        ok = ok & ~F.coalesce((value > at) if r.upper else (value < at), F.lit(False))
    return df.withColumn(kept, ok).drop(key, cut), kept


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text", **risk) -> DataFrame:
    """One row per document row: doc_id, stratum, `m` (the measured struct), base_failed, kept."""
    measured = measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text")))
    table = write_table(measured.select("doc_id", "stratum", F.col("quality_m").alias("m")), "quality")
    out, kept = judge(table, fit_cutoffs(table, labels.withColumnRenamed(doc_id, "doc_id"), "m", "stratum", **risk), "m", "stratum")
    return out.select("doc_id", "stratum", "m", base_failed(F.col("m")).alias("base_failed"), F.col(kept).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text", **risk) -> DataFrame:
    """The rows of docs that are kept, with all their columns and nothing else.

    Texts are measured once, into a table that holds the documents with what was measured, and never shuffled.
    """
    m = fresh_name(docs.columns, "quality_m")
    measured = measure(docs, text)
    table = write_table(measured, "measured")
    plain = table.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(m).alias("m"))
    cutoffs = fit_cutoffs(plain, labels.withColumnRenamed(doc_id, "doc_id"), "m", "stratum", **risk)
    out, kept = judge(table, cutoffs, m, stratum)
    return out.where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
