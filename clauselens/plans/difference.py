"""Re-analysis by what has changed in the rules (R22), from stored hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.operators.clauses import assemble_clauses, collapse_clauses, with_texts
from clauselens.operators.matching import apply_threshold, match_rules, merge_labels
from clauselens.operators.rules import pin_rules
from clauselens.operators.scoring import choose_advice, score_documents
from clauselens.plans.report import report_changes
from clauselens.sources.tables import materialise

# What decides which chunks a rule finds, and what decides a clause and its score.
FOUND_BY = ("category", "keywords")
SCORED_BY = (*FOUND_BY, "default_risk_level", "confidence_threshold", "weight", "description")

_SCORES = ("composite_risk_score", "overall_risk", "total_risks_found")


@dataclass
class Matched:
    """Hits (doc_id, chunk_index, rule_id, evidence, rule_print) and the rules (rule_id, rule_print) they are of.

    A rule that finds nothing has no hits, so the rules are kept beside them.
    """

    hits: DataFrame
    rules: DataFrame


def rule_prints(rules: DataFrame, columns=FOUND_BY) -> DataFrame:
    """(rule_id, rule_print) of the active rules: a hash of these columns, nulls apart from empty texts."""
    form = F.to_json(F.struct(*columns))
    return rules.filter("is_active").select("rule_id", F.sha2(form, 256).alias("rule_print"))


def _hits_of(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    return match_rules(chunks, rules).drop("page_number").join(rule_prints(rules), "rule_id").select(
        "doc_id", "chunk_index", "rule_id", "evidence", "rule_print")


def match_all(chunks: DataFrame, rules: DataFrame) -> Matched:
    """The first run: every chunk meets every active rule.  ``rule_id`` is the key of the rules."""
    rules = pin_rules(rules)
    return Matched(materialise(_hits_of(chunks, rules), "matched"), pin_rules(rule_prints(rules)))


def match_changed(chunks: DataFrame, before: Matched, rules: DataFrame) -> Matched:
    """The hits of the given rules when those of ``before`` are known.

    Only rules that are new, active again or changed in what they look for are
    matched; hits of rules that are gone are dropped, all others are taken over.
    """
    rules = pin_rules(rules)
    prints = pin_rules(rule_prints(rules))
    key = ["rule_id", "rule_print"]
    fresh = pin_rules(prints.join(before.rules, key, "left_anti"))
    kept = before.hits.join(prints, key, "left_semi")
    found = _hits_of(chunks, pin_rules(rules.join(fresh, "rule_id", "left_semi")))
    return Matched(materialise(kept.unionByName(found), "matched"), prints)


def changed_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rule_id, category) of active rules, old or new, whose clauses or scores may differ, in either form."""
    of = lambda rules: rules.filter("is_active").select(
        "rule_id", "category", F.sha2(F.to_json(F.struct(*SCORED_BY)), 256).alias("_print"))
    key = ["rule_id", "_print"]
    a, b = of(pin_rules(old)), of(pin_rules(new))
    either = a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))
    return pin_rules(either.select("rule_id", "category"))


def touched_documents(before: Matched, after: Matched, changed: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Documents with a hit, then or now, or a model label of a changed rule."""
    ids = changed.select("rule_id").distinct()
    docs = before.hits.select("doc_id", "rule_id").unionByName(after.hits.select("doc_id", "rule_id")).join(
        ids, "rule_id", "left_semi").select("doc_id")
    if labels is not None:
        named = changed.select("category").distinct()
        docs = docs.unionByName(labels.join(named, "category", "left_semi").select("doc_id"))
    return docs.distinct()


def reanalyse_changed(
    chunks: DataFrame, before: Matched, old_rules: DataFrame, rules: DataFrame, previous: DataFrame,
    labels: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, Matched]:
    """R22 by difference: (reports, changes, hits to keep), equal to a full run over ``chunks``.

    ``previous`` holds the reports under ``old_rules``, one per document, and
    ``before`` their hits.  Documents without a hit of a changed rule keep their
    row; of the others only the scores are new, so key entities and whatever
    else a report holds stay.  Labels, if given, are those of the run before.
    """
    rules = pin_rules(rules)
    after = match_changed(chunks, before, rules)
    touched = materialise(touched_documents(before, after, changed_rules(old_rules, rules), labels), "touched")
    hits = after.hits.drop("rule_print").join(touched, "doc_id", "left_semi")
    if labels is None:
        hits = hits.withColumn("confirmed", F.lit(False))
    else:
        hits = merge_labels(hits, labels.join(touched, "doc_id", "left_semi"), rules)
    raw = assemble_clauses(with_texts(apply_threshold(hits, rules), chunks), rules)
    scored = score_documents(touched, choose_advice(collapse_clauses(raw)))
    new = scored.select("doc_id", F.struct(*_SCORES).alias("_new"))
    both = previous.join(new, "doc_id", "left")
    reports = both.select(*[
        F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col("_new")[c]).alias(c) if c in _SCORES else F.col(c)
        for c in previous.columns])
    return reports, report_changes(reports, previous), after
