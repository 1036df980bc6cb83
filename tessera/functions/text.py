"""Column expressions on text: all JVM-side, no Python per row.

``\\w`` is written out as ASCII classes, so that Spark and DuckDB agree. Null
texts give null scalars and empty arrays; empty texts give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VERBS = "GET|POST|PUT|PATCH|DELETE"

# Patterns of the task classifier, by task in order of ties.
TASKS = {
    "debug": (
        r"\b(error|bug|crash|exception|traceback|stack.?trace|not working|broken|fails?|failing|404|500|undefined|nan|null pointer|wrong output|unexpected)\b",
        r"\b(why (is|does|isn't|doesn't)|what went wrong|can't figure|investigate|diagnose)\b",
    ),
    "research": (
        r"\b(latest|current|today|2025|2026|news|recent|new version|release)\b",
        r"\b(best (library|tool|framework|approach)|compare|vs\.?|versus|which (is|should)|what.s (the )?best)\b",
        r"\b(search|look up|find information|what.s new|up.?to.?date)\b",
        r"\b(buy|purchase|price|cost|hire|find|recommend|where (can|do|should)|how much)\b",
    ),
    "code": (
        r"\b(implement|refactor|scaffold|add (a |the )?(function|method|class|component|endpoint|route))\b",
        r"\b(write (a |the )?(function|method|class|script|code|test|api|endpoint|component))\b",
        r"\b(generate (a |the )?(function|class|component|schema|migration|test))\b",
        r"\b(code for|how to (write|implement|code))\b",
    ),
    "explain": (r"\b(explain|what (is|are|does)|how (does|do|would|should)|understand|meaning|definition|walk me through)\b",),
    "design": (
        r"\b(architecture|design (a |the )?(system|schema|database|api)|structure|plan|diagram|flow)\b",
        r"\b(how (should|would) (i|we) (structure|organize|design|approach))\b",
        r"\b(best practice|design pattern|scalable|organize (the |my )?(code|project|codebase))\b",
    ),
}


#: Target and reason by task.
ROUTING = {
    "debug": ("claude", "Claude handles long-context debugging and tracing best"),
    "code": ("claude", "Claude is strongest at code generation and review"),
    "explain": ("claude", "Claude gives thorough, structured explanations"),
    "research": ("gemini", "Gemini has live web access for current information"),
    "design": ("claude", "Claude excels at architecture and system design"),
    "general": ("claude", "Claude handles complex open-ended tasks best"),
}
TARGET_NAMES = {"claude": "Claude", "chatgpt": "ChatGPT", "gemini": "Gemini"}
#: Patterns of names, routes and files in conversations.
FILE_NAME = r"\b([a-zA-Z0-9_/]+)(\.[a-zA-Z0-9_]{2,6})\b"
CAMEL = r"\b([A-Z][a-zA-Z]{2,})\b"
SNAKE = r"\b([a-z]+(?:_[a-z]+){1,})\b"
TICKED = r"`([^`\n]+)`"
TICKED_FILE = r"`([^`\n]+\.[a-zA-Z0-9_]{2,5})`"
ASKED_FILE = r"`([^`]+\.[a-zA-Z0-9_]{2,5})`"
MENTION = rf"(?i)\b({VERBS})\s+(/[/a-zA-Z0-9_\-]*)"
DISCUSSED = r"\b(GET|POST|PATCH|PUT|DELETE)\s+(/[a-zA-Z0-9_/.<>?=&\-]+)"
PLAIN_FILE = r"([a-zA-Z0-9_/]+\.[a-zA-Z0-9_]{2,5})"
#: Texts of the next-step rules: needles of which any will do (of a second set, too), action, step, suggestion.
NEXT_STEPS = (
    (("paste these files", "paste the files"), (), "AI requested specific files to be pasted", "Paste the requested files into the conversation", "Here are the requested files: {files}"),
    (("what i need next", "next step"), (), "AI outlined next steps", "Follow the AI's outlined next steps", ""),
    (("404",), ("missing", "not found"), "Identified missing route causing 404", "Implement missing {route} endpoint", "Implement {route} endpoint as discussed"),
    (("serialization", "contract", "tojson", "fromjson"), (), "Investigating JSON serialization contract mismatch", "Compare toJson/fromJson between server and client models", "Verify JSON contract between server and Flutter models"),
)
NO_STEP = ("Analyzed conversation", "Review conversation and continue debugging", "")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    """Lines of a text; a last line end opens no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def camel_to_snake(name: Column) -> Column:
    first = F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(first, "([a-z0-9])([A-Z])", "$1_$2"))


def tokens(text: Column) -> Column:
    """Sorted distinct identifiers in lower case."""
    return F.array_sort(F.array_distinct(F.transform(_all(text, "([a-zA-Z_][a-zA-Z0-9_]*)"), F.lower)))


def keywords(text: Column) -> Column:
    """File names with stems, CamelCase with snake form, snake_case and
    back-ticked words with their stems, of more than two characters; sorted,
    distinct."""
    stems, ends = _all(text, FILE_NAME), _all(text, FILE_NAME, 2)
    files = F.concat(F.zip_with(stems, ends, lambda a, b: F.lower(F.concat(a, b))), F.transform(stems, F.lower))
    camel, ticked = _all(text, CAMEL), _all(text, TICKED)
    stem = lambda t: F.regexp_replace(t, r"^((?:.*/)?\.*[^/.][^/]*)\.[^./]*$", "$1")  # noqa: E731  a leading dot begins no suffix
    words = F.concat(files, F.transform(camel, F.lower), F.transform(camel, camel_to_snake), _all(text, SNAKE), F.transform(ticked, lambda t: strip(F.lower(t))), F.transform(ticked, lambda t: strip(F.lower(stem(t)))))
    return F.array_sort(F.array_distinct(F.filter(words, lambda k: F.length(k) > 2)))


def path_parameters(path: Column) -> Column:
    """Names in <...> and after colons, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.concat(_all(path, "<([^>]+)>"), _all(path, ":([a-zA-Z_][a-zA-Z0-9_]*)"))))


def route_mentions(text: Column) -> Column:
    """METHOD:path of each mention, in order, duplicates kept."""
    return F.zip_with(_all(text, MENTION), _all(text, MENTION, 2), lambda m, r: F.concat(F.upper(m), F.lit(":"), r))


def extension(path: Column) -> Column:
    """The last suffix in lower case with its dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def task_type(text: Column) -> Column:
    """The task with most matches, the first in order on ties; general if none.
    Each pattern is counted once: the best of (matches, order, task) wins."""
    low = F.lower(text)
    count = lambda ps: sum((F.regexp_count(low, F.lit(p)) for p in ps[1:]), F.regexp_count(low, F.lit(ps[0])))
    ranked = [F.struct(F.coalesce(count(ps), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, ps) in enumerate(TASKS.items())]
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("o"), F.lit("general").alias("t"))
    return F.array_max(F.array(none, *ranked))["t"]


def task_routing(intent: Column, conversation: Column) -> Column:
    """struct<task_type, recommended, display, reason> of an intent with the
    first 2,000 characters of its conversation; null where both are blank."""
    text = F.concat(F.coalesce(intent, F.lit("")), F.lit(" "), F.coalesce(F.substring(conversation, 1, 2000), F.lit("")))
    table = F.create_map(*[x for t, (target, why) in ROUTING.items() for x in (F.lit(t), F.struct(F.lit(t).alias("task_type"), F.lit(target).alias("recommended"), F.lit(TARGET_NAMES[target]).alias("display"), F.lit(why).alias("reason")))])
    return F.when(strip(text) != "", F.element_at(table, task_type(text)))


def last(items: Column, n: int) -> Column:
    """The last ``n`` elements, in order."""
    return F.when(F.size(items) < n, items).otherwise(F.slice(items, -n, n))


def discussed(text: Column) -> Column:
    """``METHOD path`` of the routes of a conversation, in order."""
    return F.zip_with(_all(text, DISCUSSED), _all(text, DISCUSSED, 2), lambda m, r: F.concat_ws(" ", m, r))


def rule_summary(text: Column) -> Column:
    """Last routes, first files and the tail of a conversation."""
    routes = last(discussed(text), 3)
    files = F.slice(F.filter(F.array_distinct(_all(text, PLAIN_FILE)), lambda f: ~f.startswith("http")), 1, 5)
    tail = last(last(F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda x: x != ""), 30), 10)
    joined = F.concat_ws(" ", tail)
    parts = F.concat_ws(
        " ",
        F.when(F.size(routes) > 0, F.concat(F.lit("Routes discussed: "), F.concat_ws(", ", routes), F.lit("."))),
        F.when(F.size(files) > 0, F.concat(F.lit("Files involved: "), F.concat_ws(", ", files), F.lit("."))),
        F.when(joined != "", F.concat(F.lit("Last context: "), F.substring(joined, 1, 400))),
    )
    return F.when(parts == "", F.substring(text, 1, 600)).otherwise(parts)


def likely_files(text: Column) -> Column:
    """The first six distinct back-ticked file names."""
    return F.slice(F.array_distinct(_all(text, TICKED_FILE)), 1, 6)


def next_step(text: Column) -> Column:
    """struct<last_ai_action, next_step, suggested_intent, likely_files> of the
    first rule that holds. A rule about a route needs one, or its step is the
    usual one; asked files are the last four that are named."""
    low, routes, asked = F.lower(text), discussed(text), last(_all(text, ASKED_FILE), 4)

    def any_of(words) -> Column:
        out = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(low, F.lit(w))
        return out

    def filled(pattern: str, otherwise: str) -> Column:
        if "{route}" in pattern:
            return F.when(F.size(routes) > 0, F.replace(F.lit(pattern), F.lit("{route}"), F.element_at(routes, -1))).otherwise(F.lit(otherwise))
        if "{files}" in pattern:
            return F.when(F.size(asked) > 0, F.replace(F.lit(pattern), F.lit("{files}"), F.array_join(asked, ", "))).otherwise(F.lit(otherwise))
        return F.lit(pattern)

    value = lambda a, n, g: F.struct(F.lit(a).alias("last_ai_action"), n.alias("next_step"), g.alias("suggested_intent"), likely_files(text).alias("likely_files"))
    out = F.when(F.lit(False), value(NO_STEP[0], F.lit(NO_STEP[1]), F.lit(NO_STEP[2])))
    for words, more, action, step, suggestion in NEXT_STEPS:
        cond = any_of(words) & any_of(more) if more else any_of(words)
        out = out.when(cond, value(action, filled(step, NO_STEP[1]), filled(suggestion, "")))
    return out.otherwise(value(NO_STEP[0], F.lit(NO_STEP[1]), F.lit(NO_STEP[2])))
