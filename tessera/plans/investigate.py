"""The investigation as one plan over tables: request, evidence, facts,
hypotheses, root cause, questions, prompt. Each stage is a function that can be
replaced, and fails with an error of its own; results are kept in a session.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tessera.operators import analysis, prompts
from tessera.sources import projects


class InvestigationError(Exception):
    """Base of what an investigation raises."""


class InvalidRequest(InvestigationError):
    """The request is empty."""


class SessionFailed(InvestigationError):
    """A session can't be made or loaded."""


class PlanningFailed(InvestigationError):
    """Intent or evidence plan can't be made."""


class CollectionFailed(InvestigationError):
    """Evidence can't be gathered."""


class UnknownEvidence(CollectionFailed):
    """No source has the kind of evidence."""

    def __init__(self, kind: object) -> None:
        super().__init__(f"no source of evidence of kind {kind}")


class SourceIncomplete(CollectionFailed):
    """A source lacks what it needs."""


class AnalysisFailed(InvestigationError):
    """Facts, hypotheses or causes can't be made."""


class PromptFailed(InvestigationError):
    """The prompt can't be made."""


class AdaptionFailed(InvestigationError):
    """A table lacks the columns of the next stage."""


class StoringFailed(InvestigationError):
    """The session can't be written."""


@dataclass
class Stages:
    """The replaceable stages."""

    intent: Callable = analysis.intent
    plan: Callable = analysis.evidence_plan
    questions: Callable = projects.questions
    facts: Callable = analysis.facts
    hypotheses: Callable = analysis.hypotheses
    root_causes: Callable = analysis.root_causes


@dataclass
class Investigation:
    """Results as DataFrames; without a session nothing runs before one is read."""

    intent: DataFrame
    plan: DataFrame
    questions: DataFrame
    facts: DataFrame
    hypotheses: DataFrame
    root_causes: DataFrame
    prompt: DataFrame

    def summary(self) -> dict:
        """Counts, the best root cause and its confidence."""
        best = self.root_causes.orderBy("rank").take(1)
        return {
            "fact_count": self.facts.count(),
            "hypothesis_count": self.hypotheses.count(),
            "root_cause": best[0]["statement"] if best else None,
            "root_cause_confidence": best[0]["confidence"] if best else 0.0,
        }


def _stage(error: type[InvestigationError], step: Callable, *args, **kw):
    """Runs one stage; what it raises becomes the stage's error."""
    try:
        return step(*args, **kw)
    except InvestigationError:
        raise
    except Exception as e:  # noqa: BLE001
        raise error(str(e)) from e


def investigate(request: str, evidence: DataFrame, *, key: str = "evidence_id", text: str = "content", order: str = "collected_at", kind: str = "evidence_type", stages: Stages | None = None, sessions: projects.Sessions | None = None, session: str | None = None) -> Investigation:
    """One request over an evidence table. The request itself is evidence and
    comes first. Hypotheses are ranked before their status is updated, as the
    ranking starts from the same base score for all.

    With ``sessions`` and the name of a ``session`` the request, evidence, facts,
    hypotheses, best cause and prompt are written to it, in one write each."""
    if not request or not request.strip():
        raise InvalidRequest("the request is empty")
    lacks = [c for c in (key, text, order, kind) if c not in evidence.columns]
    if lacks:
        raise AdaptionFailed(f"evidence lacks {', '.join(lacks)}")
    s = stages or Stages()
    spark = evidence.sparkSession
    asked = spark.createDataFrame([("request", request.strip())], "request_id string, text string")
    intent = _stage(PlanningFailed, lambda: asked.select("request_id", "text", s.intent(F.col("text")).alias("i")).select("request_id", "text", "i.*"))
    have = evidence.select(F.lit("request").alias("request_id"), F.lower(kind).alias("evidence_type")).distinct()
    plan = _stage(PlanningFailed, s.plan, intent, have)
    asking = _stage(PlanningFailed, s.questions, plan)
    own = asked.select(F.lit("request").alias(key), F.col("text").alias(text), F.lit(0).alias("_first"), F.lit(None).cast("timestamp_ntz").alias(order))
    rows = own.unionByName(evidence.select(F.col(key).cast("string").alias(key), text, F.lit(1).alias("_first"), F.col(order).cast("timestamp_ntz").alias(order)))
    facts = _stage(AnalysisFailed, s.facts, rows.withColumn("_o", F.struct("_first", order)), key, text, "_o")
    found = _stage(AnalysisFailed, s.hypotheses, facts)
    causes = _stage(AnalysisFailed, s.root_causes, found)
    shown = facts.filter((F.length("statement") <= 350) & ~F.col("statement").startswith("[USER]:"))
    first = shown.orderBy("statement").limit(25).agg(F.array_sort(F.collect_list("statement")).alias("facts"))  # a prompt shows 25
    why = causes.orderBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "statement"))), lambda x: x["statement"]).alias("causes"))  # a row a rule
    joined = asked.select("text", F.lit(1).alias("k")).join(first.withColumn("k", F.lit(1)), "k").join(why.withColumn("k", F.lit(1)), "k")
    sections = F.array(prompts.text_section("current_issue", F.col("text")), prompts.list_section("facts", F.col("facts"), 25), prompts.list_section("hypotheses", F.col("causes"), 25))
    prompt = _stage(PromptFailed, lambda: joined.select(prompts.render(F.lit("Debug the issue with the verified evidence below."), sections).alias("prompt")))
    out = Investigation(intent, plan, asking, facts, found, causes, prompt)
    if sessions is not None and session:
        _stage(SessionFailed, sessions.resume, session)
        _stage(StoringFailed, _keep, out, request.strip(), evidence, kind, key, sessions, session)
    return out


def _keep(got: Investigation, request: str, evidence: DataFrame, kind: str, key: str, sessions: projects.Sessions, session: str) -> None:
    sessions.event(session, "user_request", request)
    where = F.col("path") if "path" in evidence.columns else F.col(key).cast("string")
    sessions.append("evidence", session, evidence.select(F.col(kind).alias("evidence_type"), where.alias("path"), F.lit(None).cast("string").alias("hash")))
    sessions.add_facts(session, got.facts.select("statement", F.array("evidence_id").alias("evidence")))
    sessions.add_hypotheses(session, got.hypotheses)
    best = got.root_causes.orderBy("rank").take(1)
    if best:
        sessions.remember(session, "root_cause", best[0]["statement"])
    sessions.event(session, "prompt_generated", f"Prompt generated for request: {request}")
    sessions.save(session)
