"""Prompts for judges and rewriters, and what is read from their replies."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as X

from . import models

ANSWERED = "Does the answer state the facts that the question asks for? Reply with 1 or 0 only.\nQuestion: %s\nAnswer: %s"
REFERRED = "Does the answer agree with the reference in the facts that matter? Reply with 1 or 0 only.\nQuestion: %s\nReference: %s\nAnswer: %s"
REFUSED = (
    "The question below cannot be answered from the corpus. Classify the answer with one letter: R if it says that there is no basis, "
    "H if it states made-up facts, V if it does neither.\nQuestion: %s\nAnswer: %s"
)
GUARD = "\nSay that there is no basis for an answer if the excerpts do not hold one."
CASUAL = (
    "Rewrite the question as a private investor would put it in a chat. Keep the name %s letter by letter and ask for the same fact, period and item; "
    "add nothing. Reply with the question alone.\nQuestion: %s"
)


def _filled(template: str, *columns) -> Column:
    return F.format_string(template, *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def judged(items: DataFrame, factory: Callable, reference: str | None = None, **options) -> DataFrame:
    """``items`` (``question, answer``) with ``judge`` 1/0 and ``error``.

    With a reference column the judge sees it. A row whose answer failed before (``error``
    true) or whose judge fails counts 0 and keeps its error.
    """
    p = _filled(REFERRED, "question", reference, "answer") if reference else _filled(ANSWERED, "question", "answer")
    before = F.coalesce(F.col("error"), F.lit(False)) if "error" in items.columns else F.lit(False)
    asked = items.withColumn("__before", before).drop("error").withColumn("__prompt", p)
    said = models.generated(asked, "__prompt", factory, out="__said", error="__why", **options)
    wrong = F.col("__before") | F.col("__why").isNotNull()
    judge = F.when(wrong, 0).otherwise(F.coalesce(X.verdict(F.col("__said")), F.lit(0)))
    return said.withColumn("judge", judge).withColumn("error", wrong).drop("__before", "__prompt", "__said", "__why")


def triaged(items: DataFrame, factory: Callable, **options) -> DataFrame:
    """``items`` (``question, answer``) with ``label`` R, H or V; V where anything failed."""
    before = F.coalesce(F.col("error"), F.lit(False)) if "error" in items.columns else F.lit(False)
    asked = items.withColumn("__before", before).drop("error").withColumn("__prompt", _filled(REFUSED, "question", "answer"))
    said = models.generated(asked, "__prompt", factory, out="__said", error="__why", **options)
    wrong = F.col("__before") | F.col("__why").isNotNull()
    label = F.when(wrong, "V").otherwise(X.triage(F.coalesce("__said", F.lit(""))))
    return said.withColumn("label", label).withColumn("error", wrong).drop("__before", "__prompt", "__said", "__why")


def rewritten(questions: DataFrame, factory: Callable, **options) -> DataFrame:
    """``questions`` (``company, question``) with ``rewritten`` (one line) and ``company_kept``."""
    asked = questions.withColumn("__prompt", _filled(CASUAL, "company", "question"))
    said = models.generated(asked, "__prompt", factory, out="__said", **options)
    line = X.strip(F.element_at(F.split(X.strip(F.coalesce("__said", F.lit(""))), "\n"), 1))
    return said.withColumn("rewritten", line).withColumn("company_kept", F.contains(F.col("rewritten"), F.coalesce("company", F.lit("")))).drop("__prompt", "__said")


def _field(prompt: str, name: str) -> str:
    """The text after "name:" up to the next field."""
    m = re.search(rf"(?ms)^{name}: (.*?)(?=^(?:Question|Reference|Answer): |\Z)", prompt)
    return m[1].strip() if m else ""


def overlap_judge(least: float = 0.5) -> models.TextGenerator:
    """An offline judge: 1 if the answer holds that share of the reference's (else the question's) words."""

    def call(prompt: str) -> str:
        want = set((_field(prompt, "Reference") or _field(prompt, "Question")).lower().split())
        got = set(_field(prompt, "Answer").lower().split())
        return "1" if want and len(want & got) >= least * len(want) else "0"

    return call


def phrase_triage(phrases: tuple[str, ...] = ("no basis", "not stated", "cannot answer")) -> models.TextGenerator:
    """An offline triage: R at a refusing phrase, H if the answer has a digit, else V."""

    def call(prompt: str) -> str:
        answer = _field(prompt, "Answer").lower()
        return "R" if any(p in answer for p in phrases) else "H" if any(c.isdigit() for c in answer) else "V"

    return call
