"""License scans with ordered signature rules, in Column expressions only.

A text that holds none of the anchor words has no match and is passed over after a few substring
searches. Else its words are put between single spaces, the rules whose gates are all met are
applied, and each match becomes an interval of words. A detection inside the interval of another
one of the same or a higher priority is suppressed; of equal intervals the higher priority stays,
then the earlier rule. Everything happens within the row: no join, no shuffle.

Nulls: a null text has no words and no detections. Repeated rows stay, an empty table gives no
rows, and all other columns pass through; the columns added start with ``license_``, or where a
column of the user's does so, with another underscore (``columns.free_prefix``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farglass.llm import license_rules
from farglass.llm.columns import all_of, free_prefix, own
from farglass.llm.words import SEPARATORS, spaced

RULE = "array<struct<number:int,label:string,priority:int,confidence:double,base:boolean,gates:array<array<string>>,pattern:string>>"
FOUND = "array<struct<first:int,stop:int,number:int,label:string,priority:int,confidence:double,base:boolean,kept:boolean>>"
#: A text without any of these has no match: every rule's matches hold one of them.
ANCHORS = ("licen", "hereby", "redistribut", "domain", "creative", "copyleft", "copyright", "warrant", "prohibited", "proprietary", "reserved", "disassemble")
LEVELS = 4
PREFIX = "license_"


def has_anchor(low: Column) -> Column:
    """Whether a lower-case text may hold a match."""
    found = [F.contains(low, F.lit(a)) for a in ANCHORS]
    cc = F.contains(low, F.lit("cc")) & low.rlike(f"cc{SEPARATORS}by{SEPARATORS}nc")
    return F.coalesce(F.greatest(*found, cc), F.lit(False))


def rules_literal(rules: list[license_rules.Rule]) -> Column:
    rows = [{"number": r.number, "label": r.label, "priority": r.priority, "confidence": r.confidence, "base": r.base, "gates": [g.split("|") for g in r.gates], "pattern": r.pattern} for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), RULE)


#: A rule's matches in the text: their ends are marked, and the marked words tell the places. A text of
#: n words costs n for each rule that matches, however often it does.
MATCHES = """
flatten(transform(
  filter(license_rules, r -> forall(r.gates, g -> exists(g, a -> contains(license_text, a))) and rlike(license_text, r.pattern)),
  r -> flatten(transform(
    array(split(trim(regexp_replace(license_text, r.pattern, '\\x01$0\\x02')), ' ')),
    words -> zip_with(
      filter(transform(words, (w, i) -> if(startswith(w, '\\x01'), i, null)), i -> i is not null),
      filter(transform(words, (w, i) -> if(endswith(w, '\\x02'), i + 1, null)), i -> i is not null),
      (first, stop) -> struct(
        first, stop, r.number as number, r.label as label, r.priority as priority, r.confidence as confidence, r.base as base, true as kept))))))
"""

#: Detections that one inner fold goes through: arrays grow by copying, so a fold over n of them in two
#: levels copies about n * FOLD / 2 + (n / FOLD)^2 / 2 elements.
FOLD = 256
_TOPS = ", ".join(f"0 as t{k}" for k in range(1, LEVELS + 1))
_RAISED = ", ".join(f"if(x.d.priority >= {k}, greatest(acc.t{k}, x.d.stop), acc.t{k}) as t{k}" for k in range(1, LEVELS + 1))
_TOP = "case x.d.priority " + " ".join(f"when {k} then acc.t{k}" for k in range(1, LEVELS + 1)) + " end"
_TYPE = ", ".join(f"t{k}:int" for k in range(1, LEVELS + 1)).replace(" ", "")
#: Going through detections by start, the longest and strongest first, one is inside another if an
#: earlier one of its priority or more ends no sooner. tK is the last end for priorities from K up.
_INNER = f"""
aggregate(block, struct({", ".join(f"run.t{k} as t{k}" for k in range(1, LEVELS + 1))}, cast(array() as {FOUND}) as found),
  (acc, x) -> struct({_RAISED}, concat(acc.found, array(struct(
     x.d.first as first, x.d.stop as stop, x.d.number as number, x.d.label as label, x.d.priority as priority,
     x.d.confidence as confidence, x.d.base as base, {_TOP} < x.d.stop as kept))) as found))
"""
SUPPRESSED = f"""
flatten(aggregate(
  transform(
    array(array_sort(transform(license_matches, d -> struct(d.first as a, -d.stop as b, -d.priority as c, d.number as e, d as d)))),
    s -> transform(sequence(0, (size(s) - 1) div {FOLD}), k -> slice(s, cast(k * {FOLD} + 1 as int), {FOLD})))[0],
  cast(struct({_TOPS}, array() as found) as struct<{_TYPE},found:array<{FOUND}>>),
  (run, block) -> transform(array({_INNER}), x -> struct({", ".join(f"x.t{k} as t{k}" for k in range(1, LEVELS + 1))}, concat(run.found, array(x.found)) as found))[0],
  run -> run.found))
"""


def scan(docs: DataFrame, *, text_col: str = "text", rules: list[license_rules.Rule] | None = None) -> DataFrame:
    """``docs`` with ``license_found`` (all detections, ``kept`` or suppressed), ``license_labels``
    (sorted, of kept ones and of all base ones) and ``license_score`` (best confidence, else 0)."""
    rules = license_rules.build() if rules is None else rules
    none = F.array().cast(FOUND)
    p = free_prefix(docs.columns, PREFIX)
    matches, suppressed = (x.replace(PREFIX, p) for x in (MATCHES, SUPPRESSED))
    scanned = (
        docs.withColumn(f"{p}rules", rules_literal(rules))
        .withColumn(f"{p}low", F.lower(own(text_col)))
        .withColumn(f"{p}text", F.when(has_anchor(F.col(f"{p}low")), spaced(own(text_col))))
        .withColumn(f"{p}matches", F.when(F.col(f"{p}text").isNotNull(), F.expr(matches)))
        .withColumn(f"{p}all", F.when(F.size(f"{p}matches") > 0, F.expr(suppressed)).otherwise(none))
    )
    # A generator of one row: filters on the detections stay above it, so that nothing is computed
    # a second time inside a lambda.
    scanned = scanned.select(*all_of(docs), F.inline_outer(F.array(F.struct(F.col(f"{p}all").alias(f"{p}found")))))
    found = F.col(f"{p}found")
    counted = F.filter(found, lambda d: d["kept"] | d["base"])
    return scanned.withColumns(
        {
            f"{p}labels": F.array_sort(F.array_distinct(F.transform(counted, lambda d: d["label"]))),
            f"{p}score": F.coalesce(F.array_max(F.transform(F.filter(found, lambda d: d["kept"]), lambda d: d["confidence"])), F.lit(0.0)),
        }
    )
