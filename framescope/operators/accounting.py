"""Accounts of recorded model calls: context plans, outcomes, totals that an unknown part leaves unknown, retries, tool rounds, credentials."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.operators.integrity import violations

#: Tokens held back for one repair, most tokens of tool history, and most calls in a tool round (fixed values).
REPAIR_RESERVE, TOOL_HISTORY, MOST_CALLS = 8192, 16000, 6


def fits_context(estimate: Column, max_tokens: Column, context: Column) -> Column:
    return estimate + max_tokens <= context


def context_plan(initial: Column, max_tokens: Column, context: Column, tools: Column) -> Column:
    """struct(fits, tool_history, largest_prompt) of a run's first prompt: what is left for tool output and the largest prompt allowed; null if it doesn't fit."""
    left = context - max_tokens - initial - REPAIR_RESERVE
    history = F.when(tools, F.least(F.lit(TOOL_HISTORY), left)).otherwise(0)
    return F.struct((left >= 0).alias("fits"), F.when(left >= 0, history).alias("tool_history"), F.when(left >= 0, initial + history + REPAIR_RESERVE).alias("largest_prompt"))


def truncation_suspected(prompt: Column, context: Column) -> Column:
    """Whether a prompt fills 98 of 100 parts of the context; false where its size is unknown."""
    return F.coalesce(prompt * 100 >= context * 98, F.lit(False))


def run_outcomes(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome, finish_reason, n_calls) from a run's last call.

    calls: keys, call_index, estimate, largest_prompt, finish_reason, error, stage ('diagnosis' for an answer that holds). A last call beyond its
    plan is CONTEXT_REJECTED; else one cut off is TRUNCATED, one that failed ERROR, an answer DIAGNOSED, anything else SCHEMA_FAILURE.
    """
    last = calls.groupBy(*keys).agg(F.max_by(F.struct("estimate", "largest_prompt", "finish_reason", "error", "stage"), "call_index").alias("c"), F.count("*").alias("n_calls"))
    c = F.col("c")
    outcome = F.when(c["estimate"] > c["largest_prompt"], "CONTEXT_REJECTED").when(c["finish_reason"] == "length", "TRUNCATED").when(c["error"].isNotNull(), "ERROR").when(c["stage"] == "diagnosis", "DIAGNOSED").otherwise("SCHEMA_FAILURE")
    return last.select(*keys, outcome.alias("outcome"), c["finish_reason"].alias("finish_reason"), "n_calls")


def run_totals(calls: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums over a run's calls, each null unless every call has a value."""
    return calls.groupBy(*keys).agg(*(F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in columns))


def recorded_attempts(traces: DataFrame, keys: list[str], trace: str = "trace") -> DataFrame:
    """(keys, attempts): the attempts of recorded calls, JSON documents with an array `attempts` of objects with status and error; as `retries` takes them.

    The documents stay as they are (VARIANT): members of other names, and attempts of other shapes, do no harm. What is no JSON, or has no attempts, gives
    an empty array."""
    said = F.try_parse_json(trace)
    opened = traces.select(*keys, F.try_variant_get(said, "$.attempts", "array<variant>").alias("held"))
    one = "transform(coalesce(held, array()), (a, i) -> named_struct('index', i, 'status', try_variant_get(a, '$.status', 'int'), 'error', try_variant_get(a, '$.error', 'string')))"
    return opened.select(*keys, F.expr(one).alias("attempts"))


def retries(calls: DataFrame, keys: list[str], attempts: str = "attempts") -> DataFrame:
    """(keys, status, error, retryable, n) over the recorded attempts: array of struct(index, status, error). A time-out, 429 and 5xx may be tried again."""
    a = calls.select(*keys, F.explode(attempts).alias("a")).select(*keys, "a.status", "a.error")
    again = F.when(F.col("error").isNull(), False).otherwise(F.coalesce((F.col("status") == 429) | (F.col("status") >= 500), F.col("error") == "request timed out"))
    return a.groupBy(*keys, "status", "error", again.alias("retryable")).agg(F.count("*").alias("n"))


def tool_round_faults(calls: Column) -> Column:
    """What is wrong with a round of tool calls (array of struct with id): its size, an id that is missing, ids that repeat."""
    ids = F.transform(calls, lambda c: c["id"])
    return violations({"round_size": F.size(calls).between(1, MOST_CALLS), "id_missing": F.forall(ids, lambda x: x.isNotNull()), "id_repeated": F.size(F.array_distinct(ids)) == F.size(ids)})


def transcript_budget(rounds: DataFrame, keys: list[str], order: str, size: str, budget: str) -> DataFrame:
    """Adds `omitted`: the round's output, with that of the rounds before it, is over the budget; a run has no output after the first such round."""
    by = Window.partitionBy(*keys).orderBy(order)
    return rounds.withColumn("omitted", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)) > F.col(budget))


#: What a letter after a backslash means in JSON (fixed values).
_JSON_LETTERS = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_JSON_ESCAPE = re.compile(r"""\\(?:u([0-9a-fA-F]{4})|(["\\/bfnrt]))""")


def _peeled(text: str, cuts: list[int]) -> tuple[str, list[int]]:
    """text with one layer of JSON escapes read, and where each of its characters begins in the original (cuts tells that of text; one more for the end)."""
    out, begins, at = [], [], 0
    for m in _JSON_ESCAPE.finditer(text):
        out += [text[at : m.start()], chr(int(m[1], 16)) if m[1] else _JSON_LETTERS[m[2]]]
        begins += [*cuts[at : m.start()], cuts[m.start()]]
        at = m.end()
    return "".join([*out, text[at:]]), begins + cuts[at:]


def credential_spans(text: str, secret: str) -> list[tuple[int, int]]:
    """Where a secret stands in a text, as it is or behind any number of layers of JSON escapes (JSON in strings of JSON)."""
    spans, layer, cuts = [], text, list(range(len(text) + 1))
    while True:
        at = layer.find(secret)
        while at >= 0:
            spans.append((cuts[at], cuts[at + len(secret)]))
            at = layer.find(secret, at + len(secret))
        if "\\" not in layer:
            return spans
        inner, cuts = _peeled(layer, cuts)
        if inner == layer:
            return spans
        layer = inner


def scrub_credential(text: Column, secret: str, mark: str = "[REDACTED CREDENTIAL]") -> Column:
    """Recorded bodies without a credential, plain or escaped, also inside JSON held in strings of JSON. All else in a body stays as it is."""
    if not secret:
        return text

    def clean(value: str) -> str:
        out, at = [], 0
        for a, b in sorted(credential_spans(value, secret)):
            if a >= at:
                out += [value[at:a], mark]
                at = b
        return "".join([*out, value[at:]])

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(clean, na_action="ignore")

    return run(text)
