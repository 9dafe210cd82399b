"""Quality rules of a generated search prompt: one boolean column for each, gathered in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan.functions.text import col, contains_any, let, prompt_payload, simplified, substring_count
from reelspan.operators.entities import mentions_a_name

#: Vocabularies, and the text of each finding.
METHOD = ("method", "routine", "daily loop", "framework", "process")
ROADMAP = ("roadmap", "8-week", "eight-week", "week-by-week", "progression")
TOOLS = ("tandem", "tool", "tools", "artificial intelligence", "gpt")
MOTIVATION = ("motivation", "why they started", "why the speaker started", "why she is starting", "why he is starting", "reason for learning", "reason for starting", "starting this challenge", "challenge")
ROUTINE = ("daily loop", "daily study loop", "study routine", "input", "spaced repetition", "vocabulary", "practice", "natives", "reason for learning", "starting this challenge", "challenge", "roadmap", "8-week", "plan")
GENDERED = r"(?i)\bspeaker\b[^.]{0,80}\b(his|her)\b"
EMPTY = "empty prompt"


def kinds(low: Column) -> Column:
    """Whether a lower-case text speaks of a method, a roadmap, and of tools or a motivation beside a method, as they count there
    only: looked for once, as several rules ask."""
    has = lambda phrases: contains_any(low, phrases, lowered=True)
    return let(has(METHOD), lambda m: F.struct(m.alias("method"), has(ROADMAP).alias("roadmap"), (m & has(TOOLS)).alias("tools"), (m & has(MOTIVATION)).alias("motivation")))


def more_than(text: Column, part: str, n: int) -> Column:
    """Whether a part occurs more than ``n`` times, overlaps counted; looked for up to there only."""
    return F.substring_index(text, part, n + 1) != text


def at_least(low: Column, part: str, n: int) -> Column:
    """Whether a part occurs at least ``n`` times without overlap; counted only where it does so with overlaps."""
    return more_than(low, part, n - 1) & (substring_count(low, part, lowered=True) >= n)


def rules(normalized: Column, lowered: Column, scope: Column, names: Column, pronoun_dependent: Column, unlock_method: Column, spoken: Column | None = None) -> list[tuple[str, Column]]:
    """(finding, condition) of all rules but the one for an empty prompt, in order; the text comes simplified,
    and in lower case, with its ``kinds`` where they are at hand."""
    spoken = kinds(lowered) if spoken is None else spoken
    method, roadmap, tools, motivation = (spoken[k] for k in ("method", "roadmap", "tools", "motivation"))
    low = lowered
    has = lambda *p: contains_any(low, p, lowered=True)
    return [
        ("prompt does not start with Find", ~F.startswith(low, F.lit("find "))),
        ("too verbose for a predictable ClipAnything search prompt", more_than(normalized, " ", 94)),
        ("does not follow the expected 3-sentence maximum", more_than(normalized, ". ", 2)),
        ("uses especially to append adjacent topics", has("especially")),
        ("uses a colon that may introduce a topic catalog", F.contains(normalized, F.lit(":"))),
        ("adds a second search target", has("also look for", "also find")),
        ("assumes the speaker's gender", F.contains(low, F.lit("speaker")) & F.regexp_like(normalized, F.lit(GENDERED))),
        ("uses broad alternative objectives", has("why it matters") & has("how it works", "what the plan")),
        ("uses too many OR alternatives", at_least(low, " or ", 2)),
        ("looks like a topic catalog", more_than(normalized, ",", 6)),
        ("mixes method/routine with roadmap/progression", method & roadmap),
        ("mixes method, tools, and roadmap in one target", method & tools & roadmap),
        ("mixes motivation/challenge with method/routine", method & motivation),
        ("mixes motivation, method, and roadmap", method & motivation & roadmap),
        ("mixes reference-backed unlock method with routine, motivation, roadmap, tools, or practice", unlock_method & contains_any(low, ROUTINE, lowered=True)),
        ("uses a meta-instruction instead of a ClipAnything search target", unlock_method & has("making sure", "make sure")),
        ("too broad for the short clip preset", (scope == "short_range_best_moment") & (roadmap | at_least(low, " and ", 5))),
        ("drops a named reference needed to resolve pronouns or indirect references", pronoun_dependent & ~mentions_a_name(low, names)),
        ("mentions duration or timestamps", has("duration", "seconds", "minutes", "timestamps")),
    ]


def issues(prompt: Column | str, scope: Column | str, names: Column | str, pronoun_dependent: Column | str, unlock_method: Column | str) -> Column:
    """The findings on a prompt, as an array in order of the rules; a blank prompt has only the one
    that it is empty. A null flag counts as false, null names as none."""
    text = simplified(prompt_payload(F.coalesce(col(prompt), F.lit(""))))
    flag = lambda c: F.coalesce(col(c), F.lit(False))
    known = F.coalesce(col(names), F.array().cast("array<string>"))

    def judged(t: Column) -> Column:
        tests = rules(t["text"], t["low"], col(scope), known, flag(pronoun_dependent), flag(unlock_method), t["spoken"])
        found = [F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests]
        return F.when(t["text"] == "", F.array(F.lit(EMPTY))).otherwise(F.array_compact(F.array(*found)))

    read = let(text, lambda t: F.struct(t.alias("text"), F.lower(t).alias("low")))
    return let(let(read, lambda t: F.struct(t["text"].alias("text"), t["low"].alias("low"), kinds(t["low"]).alias("spoken"))), judged)


def needs_repair(issues_: Column | str) -> Column:
    """Whether there is any finding."""
    return F.size(col(issues_)) > 0
