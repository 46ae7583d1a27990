"""Batch model scoring around a user-supplied function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens import fixed_values as fv
from clauselens.functions.text import clip, strip
from clauselens.operators.matching import strict_json, unfence
from clauselens.sources.tables import materialise

CLASSIFY_TEMPLATE = (
    "Below is a list of risk categories and one passage of a contract. Answer with a JSON "
    "array holding the names of the categories that apply to the passage, spelled as "
    "listed, or [] if there are none. Answer with the array alone.\n\n"
    "CATEGORIES:\n{categories}\n\nPASSAGE:\n\"{passage}\""
)
ADVICE_TEMPLATE = (
    "You advise a client on a contract. For each clause below give one or two short "
    "suggestions for negotiation. Answer with one JSON object whose keys are the "
    "category names as given and whose values are the suggestions.\n\n"
    "CLAUSES:\n{clauses}\n"
)
SUMMARY_TEMPLATE = (
    "Sum up the contract below in plain English: its purpose, the main duties, the term, "
    "the payments and how it can be ended.\n\nCONTRACT:\n{passage}"
)


def _fill(template: str, **parts: Column) -> Column:
    """The template with its {names} replaced by columns."""
    pieces = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), parts[name]]
    return F.concat(*pieces, F.lit(rest))


def _passage(col: Column, most_chars: int | None) -> Column:
    return col if most_chars is None else clip(col, most_chars)


def classify_prompts(
    chunks: DataFrame, rules: DataFrame, template: str = CLASSIFY_TEMPLATE, most_chars: int | None = None,
) -> DataFrame:
    """B1: one prompt per candidate chunk, listing the active rules.

    The list is one aggregated value of the (configuration-sized) rules table,
    joined as a single row.
    """
    line = F.concat(
        F.lit("- "), F.col("category"), F.lit(": "),
        F.coalesce(F.nullif("description", F.lit("")), F.lit(fv.NO_DESCRIPTION)))
    listed = rules.filter("is_active").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rule_id", line.alias("line")))),
                lambda x: x["line"]),
            "\n").alias("_listed"),
        F.lit(1).alias("_one"))
    return (
        chunks.withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one")
        .select(
            "doc_id", "chunk_index",
            _fill(
                template, categories=F.col("_listed"),
                passage=_passage(F.col("chunk_text"), most_chars)).alias("prompt"))
    )


def advice_prompts(
    clauses: DataFrame, template: str = ADVICE_TEMPLATE, most_clauses: int | None = None,
    most_chars: int | None = None,
) -> DataFrame:
    """B2: one prompt per document from all its clauses, or the first ``most_clauses``.

    A prompt is one text for one model call, so its clauses meet in one row.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "rule_id")
    excerpt = strip(F.replace(
        _passage(F.col("clause_text"), most_chars), F.lit("\n"), F.lit(" ")))
    line = F.concat(
        F.lit('- Category: "'), F.col("category"), F.lit('" | Excerpt: "'), excerpt, F.lit('"'))
    first = (
        clauses.select("doc_id", "chunk_index", "rule_id", line.alias("line"))
        .withColumn("_rank", F.row_number().over(order))
    )
    if most_clauses is not None:
        first = first.filter(F.col("_rank") <= most_clauses)
    return first.groupBy("doc_id").agg(
        _fill(
            template,
            clauses=F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_rank", "line"))), lambda x: x["line"]),
                "\n")).alias("prompt"))


def summary_prompts(docs: DataFrame, template: str = SUMMARY_TEMPLATE, most_chars: int | None = None) -> DataFrame:
    """One prompt per document from its text, or the start of it."""
    return docs.select(
        "doc_id",
        _fill(template, passage=_passage(F.col("text"), most_chars)).alias("prompt"))


def score_prompts(prompts: DataFrame, fn: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Applies ``fn`` (prompts in, responses out) to Arrow batches.

    A batch that fails is halved until it succeeds or is one prompt, which then
    has a null response and the message in ``error``: one bad prompt among n
    costs about 2 log2(n) further calls.  An answer of another length than the
    batch counts as a failure.  Thinking tags are removed.
    """
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema if f.name != "prompt"]

    def answer(asked: list) -> list:
        """(response, error) of every prompt."""
        if not asked:
            return []
        try:
            given = list(fn(pd.Series(asked)))
            if len(given) != len(asked):
                raise ValueError(f"{len(given)} answers to {len(asked)} prompts")
            return [(x, None) for x in given]
        except Exception as failure:
            if len(asked) == 1:
                return [(None, str(failure))]
        half = len(asked) // 2
        return answer(asked[:half]) + answer(asked[half:])

    def run(batches):
        for batch in batches:
            answers = answer(list(batch["prompt"]))
            out = batch.drop(columns="prompt")
            out["response"], out["error"] = [r for r, _ in answers], [e for _, e in answers]
            yield out

    scored = prompts.mapInPandas(run, ", ".join([*fields, "response string", "error string"]))
    return scored.withColumn("response", drop_thinking(F.col("response")))


def score_distinct(
    prompts: DataFrame, fn: Callable[[pd.Series], pd.Series], answers: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """B4 with stored answers: (scored prompts, answers to keep).

    Equal prompts are asked once, under their SHA-256.  ``answers`` (prompt_key,
    response, error) of earlier runs are used as they are, failed ones are asked
    again.  New answers are written before they are used, so a model is never
    asked twice for one plan.  A null prompt is not asked and has no response.
    """
    keyed = prompts.withColumn("prompt_key", F.sha2("prompt", 256))
    # Partial aggregation first: a prompt of very many rows leaves every task once.
    asked = keyed.filter("prompt is not null").groupBy("prompt_key").agg(F.any_value("prompt").alias("prompt"))
    known = None if answers is None else answers.filter("error is null")
    if known is not None:
        asked = asked.join(known, "prompt_key", "left_anti")
    given = materialise(score_prompts(asked, fn), "answers")
    kept = given if known is None else known.select(*given.columns).unionByName(given)
    return keyed.drop("prompt").join(kept, "prompt_key", "left").drop("prompt_key"), kept


def drop_thinking(raw: Column) -> Column:
    return strip(F.regexp_replace(strip(raw), r"(?s)<think>.*?</think>", ""))


def parse_advice_text(raw: Column) -> Column:
    """Map of category to advice, or null when the text is no JSON object of texts."""
    return strict_json(unfence(raw), "{", "map<string,string>")


def parse_advice(responses: DataFrame) -> DataFrame:
    return responses.withColumn("advice", parse_advice_text(F.col("response")))
