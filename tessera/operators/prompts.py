"""Prompts as ordered sections; rendering is string expressions.

A section is struct<section, items array<string>>; ``None`` alone stands for an
empty list. Null and empty parts of a built prompt are left out: ``concat_ws``
drops nulls, so a part is null when its value is null or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEPARATOR = "\n\n---\n\n"
# What the prompts of a task and of a target begin and end with.
INTROS = {"debug": "I have a bug I need help debugging."}
OUTROS = {"debug": "Please identify the root cause and provide a specific fix."}
TARGETS = {
    "claude": "You are conducting a structured software investigation.\n\nRules:\n- Separate facts from assumptions.\n- Identify missing evidence.\n- Explain reasoning.\n- State confidence levels.\n- Do not invent implementation details.\n\n",
    "gemini": "Analyze the investigation context below and produce the most accurate technical assessment possible.\n\nFocus on:\n1. Root cause analysis\n2. Missing evidence\n3. Recommended next investigation steps\n4. Architectural observations\n\n",
    "chatgpt": "Review the investigation package and provide a structured engineering analysis.\n\nPrioritize verified evidence over assumptions.\n\n",
    "local": "Task: Analyze the investigation.\n\n",
}


def list_section(name: str, items: Column, most: int | None = None) -> Column:
    """Items with dashes; an empty or null list is the one item None."""
    kept = F.coalesce(items, F.array().cast("array<string>"))
    kept = F.transform(F.slice(kept, 1, most) if most else kept, lambda i: F.concat(F.lit("- "), i))
    return F.struct(F.lit(name).alias("section"), F.when(F.size(kept) == 0, F.array(F.lit("None"))).otherwise(kept).alias("items"))


def text_section(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("section"), F.array(F.coalesce(value, F.lit("None"))).alias("items"))


def render(instructions: Column, sections: Column, *, markdown: bool = True) -> Column:
    """Titles over items; sections of the one item None are left out, while an
    empty text still gets its title."""
    shown = F.filter(sections, lambda s: ~((F.size(s["items"]) == 1) & (s["items"][0] == "None")))
    title = lambda n: F.upper(F.trim(F.replace(n, F.lit("_"), F.lit(" "))))
    if markdown:
        first = F.concat(F.lit("# SYSTEM INSTRUCTIONS\n\n"), instructions)
        part = lambda s: F.concat(F.lit("# "), title(s["section"]), F.lit("\n\n"), F.array_join(s["items"], "\n"))
    else:
        first = F.concat(F.lit("SYSTEM INSTRUCTIONS\n-------------------\n"), instructions)
        part = lambda s: F.concat(title(s["section"]), F.lit("\n"), F.repeat(F.lit("-"), F.length(title(s["section"]))), F.lit("\n"), F.array_join(s["items"], "\n"))
    return F.regexp_replace(F.concat_ws("\n\n", first, F.nullif(F.array_join(F.transform(shown, part), "\n\n"), F.lit(""))), r"^\s+|\s+$", "")


def for_target(instructions: Column, sections: Column, target: Column) -> Column:
    """The prompt as the target wants it; an unknown target fails the query."""
    t = F.lower(F.coalesce(target, F.lit("markdown")))
    plain, marked = render(instructions, sections, markdown=False), render(instructions, sections)
    out = F.when(t == "markdown", marked).when(t == "text", plain)
    for name, first in TARGETS.items():
        out = out.when(t == name, F.concat(F.lit(first), plain if name == "local" else marked))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown target: "), t)))


def _part(title: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(f"{title}:\n"), value))


def file_part(files: Column) -> Column:
    """=== FILE: path === blocks of array<struct<path, content>>; null if no
    file has a content."""
    none = F.array().cast("array<struct<path:string,content:string>>")
    shown = F.filter(F.coalesce(files, none), lambda f: f.isNotNull() & f["content"].isNotNull())
    joined = F.array_join(F.transform(shown, lambda f: F.concat(F.lit("=== FILE: "), F.coalesce(f["path"], F.lit("")), F.lit(" ===\n"), f["content"], F.lit("\n"))), "\n")
    return F.nullif(joined, F.lit(""))


def repository_part(repository: Column) -> Column:
    """The section of a struct<owner, repo, readme, file_tree>: the README's first
    1,500 characters and the file structure; null where the struct is."""
    text = lambda title, c: F.when(F.length(c) > 0, F.concat(F.lit(title), c)).otherwise("")
    name = F.concat(F.lit("GitHub Repository: "), F.coalesce(repository["owner"], F.lit("")), F.lit("/"), F.coalesce(repository["repo"], F.lit("")), F.lit("\n"))
    return F.when(repository.isNotNull(), F.concat(name, text("\nREADME:\n", F.substring(repository["readme"], 1, 1500)), text("\nFile structure:\n", repository["file_tree"])))


def build(requests: DataFrame, repository: Column | None = None) -> DataFrame:
    """(request_id, task_type, prompt) of build-prompt requests. The summary
    stands for the conversation, of which the first 4,000 characters are used
    otherwise. ``repository`` is the struct of :func:`repository_part`. Task
    types are compared as they are written."""
    task = F.col("task_type")
    pick = lambda m: F.coalesce(*[F.when(task == k, F.lit(v)) for k, v in m.items()])
    talk = F.when(F.length("conversation_summary") > 0, F.concat(F.lit("Context from our previous conversation:\n"), "conversation_summary"))
    talk = talk.when(F.length("conversation") > 0, F.concat(F.lit("Here is the conversation so far:\n\n"), F.substring("conversation", 1, 4000)))
    prompt = F.concat_ws(
        SEPARATOR,
        pick(INTROS),
        talk,
        F.lit(None).cast("string") if repository is None else repository_part(repository),
        F.when(F.length("intent") > 0, F.when(task == "debug", F.concat(F.lit("Bug description:\n"), "intent")).otherwise(F.col("intent"))),
        _part("Additional context", F.col("extra_context")),
        F.concat(F.lit("Relevant files:\n\n"), file_part(F.col("files"))),
        _part("Expected behavior", F.col("expected")),
        _part("Current behavior / what is going wrong", F.col("actual")),
        pick(OUTROS),
    )
    return requests.select("request_id", "task_type", prompt.alias("prompt"))


def build_short(intent: Column, files: Column, target: Column, expected: Column, actual: Column) -> Column:
    """The prompt of the command line."""
    return F.concat_ws(
        SEPARATOR,
        F.concat(F.lit("I am working on the following problem:\n"), F.coalesce(intent, F.lit(""))),
        F.concat(F.lit("Here are the relevant files:\n\n"), file_part(files)),
        _part("Expected behavior", expected),
        _part("Current behavior / what is going wrong", actual),
        F.concat(F.lit("Please help me fix this. I am sending this to "), target, F.lit(".")),
    )


def conversation_text(turns: DataFrame, key: str, order: str, role: str, text: str, least: int = 5) -> DataFrame:
    """(key, conversation): turns longer than ``least`` joined in order."""
    shown = turns.filter(F.length(text) > least)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit("["), F.upper(role), F.lit("]: "), F.col(text)).alias("t"))))
    return shown.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), SEPARATOR).alias("conversation"))


#: Least length of a turn by where the conversation stands (fixed values).
LEAST_TURN = {"claude": 5, "gemini": 5, "chatgpt": 10}


# Templates with their instructions and sections.
TEMPLATES = {
    "debugging": ("Act as a senior software engineer conducting a structured investigation. Prioritize verified facts over assumptions. Identify root causes, missing evidence, and next actions.", ("project", "current_issue", "verified_facts", "relevant_evidence", "timeline", "failed_attempts", "active_hypotheses", "likely_root_cause", "confidence", "alternatives", "reasoning", "open_questions", "task")),
    "code_review": ("Act as a senior reviewer. Evaluate correctness, architecture, maintainability, performance, security, and testing concerns.", ("project", "review_scope", "relevant_files", "architecture_context", "known_constraints", "observations", "risks", "task")),
    "feature_implementation": ("Act as a senior software architect. Produce an implementation plan that fits the existing codebase and constraints.", ("project", "feature_request", "requirements", "existing_architecture", "relevant_files", "constraints", "open_questions", "task")),
    "architecture_review": ("Act as a principal engineer. Evaluate scalability, maintainability, modularity, fault tolerance, and long-term system evolution.", ("project", "architecture_overview", "current_design", "constraints", "known_issues", "improvement_opportunities", "task")),
    "root_cause_analysis": ("Act as an incident investigator. Separate evidence from theory. Identify the most likely root causes and explain confidence levels.", ("project", "incident", "verified_facts", "evidence", "timeline", "hypotheses", "disproved_hypotheses", "missing_evidence", "task")),
}


def template(name: str | None) -> tuple[str, tuple[str, ...]]:
    """Instructions and sections; an unknown name means debugging."""
    return TEMPLATES.get(name or "debugging", TEMPLATES["debugging"])


def package(name: str | None, texts: dict[str, Column], lists: dict[str, Column]) -> tuple[Column, Column]:
    """(instructions, sections) to render: project, issue, the lists, task, and
    then what else is given, in order."""
    order = ("project", "current_issue", "verified_facts", "relevant_evidence", "active_hypotheses", "timeline", "failed_attempts", "open_questions", "task")
    names = [*order, *[k for k in (*texts, *lists) if k not in order]]
    none = F.array().cast("array<string>")
    parts = [text_section(n, texts.get(n, F.lit(""))) if n in texts or n in ("project", "current_issue", "task") else list_section(n, lists.get(n, none)) for n in names]
    return F.lit(template(name)[0]), F.array(*parts)
