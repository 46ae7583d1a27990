"""Analysis with a model in the loop as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from clauselens.operators.chunking import chunk
from clauselens.operators.clauses import collapse_clauses
from clauselens.operators.matching import labels_from_categories, match_rules, model_candidates, parse_labels
from clauselens.operators.prompts import advice_prompts, classify_prompts, parse_advice, score_distinct
from clauselens.operators.rules import pin_rules
from clauselens.operators.scoring import choose_advice, score_documents
from clauselens.plans.report import Analysis, document_entities, raw_clauses
from clauselens.sources.tables import materialise

Model = Callable[[pd.Series], pd.Series]


@dataclass
class Answers:
    """Answers by prompt, of both questions, to be handed to the next run."""

    labels: DataFrame
    advice: DataFrame


def analyse_scored(
    pages: DataFrame, rules: DataFrame, classify: Model, advise: Model, answers: Answers | None = None,
    single_page: bool = False, k: int | None = None, m: int | None = None,
) -> tuple[Analysis, Answers]:
    """R21 with a model: its labels join the rules' hits, its advice the curated one.

    ``classify`` answers the prompts of candidate chunks (``k`` and ``m`` as in
    ``model_candidates``), ``advise`` those of documents with clauses.  An answer
    that failed or cannot be read gives no label and curated advice.  Chunks,
    hits, answers and clauses are written once and read by all that follows.
    """
    rules = pin_rules(rules)
    entities, failed = document_entities(pages, single_page)
    chunks = materialise(chunk(pages, single_page=single_page), "chunks")
    hits = materialise(match_rules(chunks, rules), "hits")
    asked = classify_prompts(model_candidates(chunks, hits, k, m), rules)
    labelled, label_answers = score_distinct(asked, classify, answers and answers.labels)
    labels = labels_from_categories(parse_labels(labelled, rules))
    clauses = materialise(collapse_clauses(raw_clauses(chunks, rules, labels, hits)), "clauses")
    advised, advice_answers = score_distinct(advice_prompts(clauses), advise, answers and answers.advice)
    advice = parse_advice(advised).select("doc_id", "advice")
    final = choose_advice(clauses, advice)
    made = Analysis(chunks, final, score_documents(entities, final), failed)
    return made, Answers(label_answers, advice_answers)
