"""Quality rules: base limits and a learned decision list, in Column expressions only.

``signals`` measures each text. ``learn`` grows a decision list from labelled rows by sequential
covering: a rule is a conjunction of thresholds grown on two thirds of the rows by FOIL gain until
it covers no row of the other verdict, pruned on the last third to its most precise prefix, kept if
precise enough there, and the rows it covers are taken away before the next rule. Rules that reject
are sought first; where no more is precise enough, a rule that keeps takes good rows away, and with
these gone further rules may reject. So a rule holds for what the rules before it left. At most
``MAX_RULES`` rules of ``MAX_CONDITIONS`` conditions are learned. The list comes out as an ordered
Spark conditional expression.

Learning takes at most ``SAMPLE_ROWS`` labelled rows, those with the least hash of the id: a bounded
sample whose signals go to the driver. All else covers all rows and shuffles nothing.

Nulls: a null text has no words and fails the base limits; labels without id or verdict are left
out, and of several labels of an id the worst counts. Repeated rows stay. Without labels the list
is empty and the base limits alone decide. An empty table gives no rows. All other columns pass
through; the columns added start with ``quality_``, or where a column of the user's does so, with
another underscore (``columns.free_prefix``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farglass.llm.columns import all_of, free_prefix, own
from farglass.llm.words import solid_words

SAMPLE_ROWS = 6000
WINDOW = 5
MIN_PRECISION = 0.97
MIN_COVERED = 8
MAX_RULES = 16
MAX_CONDITIONS = 4
SYMBOLS = "[#*$%&|<>]"
PREFIX = "quality_"


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and the ratios that rules are made of."""
    p = free_prefix(docs.columns, PREFIX)
    text = F.coalesce(own(text_col), F.lit(""))
    out = docs.withColumn(f"{p}words", solid_words(own(text_col)))
    following = ", ".join(f"get({p}words, i + {k})" for k in range(1, WINDOW))
    hashes = F.expr(f"if(size({p}words) < {WINDOW}, array(), transform(slice({p}words, 1, size({p}words) - {WINDOW - 1}), (w, i) -> xxhash64(w, {following})))")
    out = out.withColumn(f"{p}windows", hashes.cast("array<bigint>"))
    # Most texts repeat no window; only in the others are windows sorted to find which.
    repeats = F.size(F.array_distinct(f"{p}windows")) < F.size(f"{p}windows")
    out = out.withColumn(f"{p}sorted", F.when(repeats, F.sort_array(F.expr(f"transform({p}windows, (h, i) -> struct(h as h, i as i))"))))
    starts = F.expr(f"array_sort(array_distinct(flatten(filter(zip_with({p}sorted, slice({p}sorted, 2, size({p}sorted)), (a, b) -> if(a.h = b.h, array(a.i, b.i), null)), x -> x is not null))))")
    out = out.withColumn(f"{p}starts", F.when(F.col(f"{p}sorted").isNotNull(), starts))
    covered = F.expr(f"aggregate(zip_with({p}starts, slice({p}starts, 2, size({p}starts)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0, (s, x) -> s + x)")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(f"{p}lines", lines)
    counts = {
        "n_words": F.size(f"{p}words"),
        "word_chars": F.char_length(F.array_join(f"{p}words", "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_lines": F.size(f"{p}lines"),
        "n_dup_lines": F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines")),
        "n_repeat_words": F.coalesce(F.when(F.col(f"{p}starts").isNotNull(), covered), F.lit(0)),
        "n_distinct": F.size(F.array_distinct(f"{p}words")),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")),
        "n_marks": F.regexp_count(text, F.lit("[!?]")),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")),
    }
    # A generator of one row: a filter on the counts stays above it, so that none is computed twice
    # and no array is computed again inside a lambda.
    once = F.inline_outer(F.array(F.struct(*(c.cast("long").alias(f"{p}{k}") for k, c in counts.items()))))
    out = out.select(*all_of(docs), once)

    def ratio(a: str, b: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(f"{p}{a}"), F.col(f"{p}{b}")), F.lit(0.0)), 6)

    return out.withColumns({f"{p}{k}": ratio(a, b) for k, (a, b) in RATIOS.items()})


#: Signals of the rules: each a quotient of counts.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
}
FEATURES = tuple(RATIOS)


def base_failed(p: str = PREFIX) -> Column:
    return (F.col(f"{p}n_words") < 10) | (100 * F.col(f"{p}n_repeat_words") > 20 * F.col(f"{p}n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self, p: str = PREFIX) -> Column:
        c = F.col(f"{p}{self.feature}")
        return c > self.cut if self.above else c <= self.cut


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keeps: bool
    right: int
    wrong: int

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)


def verdict(rules: list[Rule], row: dict) -> bool:
    """Whether the list keeps a row: the first rule that holds says; else it stays."""
    return next((r.keeps for r in rules if r.holds(row)), True)


def _best_condition(rows: list[dict], wanted: int) -> Condition | None:
    """The threshold of the greatest FOIL gain for rows whose ``bad`` is ``wanted``; of equal gains
    the first feature's lowest cut."""
    p0 = sum(r["bad"] == wanted for r in rows)
    n0 = len(rows) - p0
    if not p0 or not n0:
        return None
    start, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
    for feature in FEATURES:
        ordered = sorted(rows, key=lambda r: r[feature])
        p = n = 0
        for k, r in enumerate(ordered[:-1]):
            hit = r["bad"] == wanted
            p, n = p + hit, n + (not hit)
            a, b = r[feature], ordered[k + 1][feature]
            if a == b:
                continue
            cut = (a + b) / 2
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                if pp and (gain := pp * (math.log2(pp / (pp + nn)) - start)) > best[0]:
                    best = (gain, Condition(feature, above, cut))
    return best[1]


def _grow(grow: list[dict], prune: list[dict], wanted: int, min_precision: float, min_covered: int) -> Rule | None:
    """One rule for rows whose ``bad`` is ``wanted``, or None if none is precise enough."""
    covered, conditions = grow, []
    while len(conditions) < MAX_CONDITIONS and (c := _best_condition(covered, wanted)) is not None:
        conditions.append(c)
        covered = [r for r in covered if c.holds(r)]
    best = None
    for size in range(1, len(conditions) + 1):
        rule = tuple(conditions[:size])
        held = [r for r in prune if all(c.holds(r) for c in rule)]
        p = sum(r["bad"] == wanted for r in held)
        key = ((p + 1) / (len(held) + 2), -size)
        if p and p / len(held) >= min_precision and (best is None or key > best[0]):
            best = (key, rule)
    if best is None:
        return None
    hit = [r for r in grow + prune if all(c.holds(r) for c in best[1])]
    p = sum(r["bad"] == wanted for r in hit)
    return Rule(best[1], not wanted, p, len(hit) - p) if len(hit) >= min_covered and p / len(hit) >= min_precision else None


def learn_list(rows: list[dict], min_precision: float = MIN_PRECISION, min_covered: int = MIN_COVERED) -> list[Rule]:
    """A decision list from rows with ``bad`` (1 or 0), the features, and ``fold`` (2: for pruning)."""
    grow, prune = [r for r in rows if r["fold"] != 2], [r for r in rows if r["fold"] == 2]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = next((r for wanted in (1, 0) if (r := _grow(grow, prune, wanted, min_precision, min_covered))), None)
        if rule is None:
            break
        rules.append(rule)
        grow, prune = ([r for r in x if not rule.holds(r)] for x in (grow, prune))
    while rules and rules[-1].keeps:  # what no rule holds for stays anyway
        rules.pop()
    return rules


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The decision list for texts that pass the base limits."""
    chosen_labels = labels.select(own(id_col).alias("own_id"), own(label_col).alias("verdict")).dropna()
    marked = chosen_labels.groupBy("own_id").agg(F.min("verdict").alias("verdict"))
    chosen = marked.orderBy(F.xxhash64("own_id"), "own_id").limit(sample_rows)
    slim = docs.select(own(id_col).alias("own_id"), own(text_col).alias("text"))
    found = signals(slim.join(F.broadcast(chosen), "own_id")).where(~base_failed())
    rows = found.select((F.col("verdict") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64("own_id", F.lit(7)), F.lit(3)).alias("fold"), *(F.col(f"{PREFIX}{x}").alias(x) for x in FEATURES), "own_id")
    # Rows that repeat an id may differ: the one with the least signals counts, so reruns agree.
    once = rows.groupBy("own_id").agg(F.min(F.struct("bad", "fold", *FEATURES)).alias("row")).select("own_id", "row.*").limit(sample_rows)
    return learn_list([r.asDict() for r in once.orderBy("own_id").collect()])


def accepts(rules: list[Rule], p: str = PREFIX) -> Column:
    """The list as an ordered conditional: the first rule that holds says; else the text stays."""
    out = None
    for rule in rules:
        condition = rule.conditions[0].column(p)
        for c in rule.conditions[1:]:
            condition = condition & c.column(p)
        out = F.when(condition, F.lit(rule.keeps)) if out is None else out.when(condition, F.lit(rule.keeps))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with signals, ``quality_base_failed`` and ``quality_kept``."""
    p = free_prefix(docs.columns, PREFIX)
    return signals(docs, text_col).withColumn(f"{p}base_failed", base_failed(p)).withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & accepts(rules, p))


def keep(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns they had."""
    judged = judge(docs, rules, text_col)
    return judged.where(own(judged.columns[-1])).select(*all_of(docs))
