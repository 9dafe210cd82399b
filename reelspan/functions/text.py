"""Scalar functions over text, numbers of seconds and settings, as Spark columns.

All are built-in expressions, so they stay inside generated code and can be pushed below joins.
White space is what ``\\s`` matches. A null argument gives null unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: what ``\\s`` matches.
SPACES = " \t\n\x0b\f\r"
#: Fixed values of the data model.
GATE_PREFIX = "NO_STRONG_CLIP_FOUND:"
PROMPT_PREFIX = "OPUS_PROMPT:"
GATE_REASON = "No complete self-contained moment with a clear payoff was found in the selected range."
MOST_CONTEXT_CHARS, WINDOW_SEC, PREVIEW_CHARS = 60_000, 300.0, 520
PORTUGUESE, ENGLISH = ("pt", "pt-br", "portuguese"), ("en", "en-us", "english")
PRESET_BOUNDS = {"Short": (30.0, 60.0), "Medium": (60.0, 120.0), "Long": (120.0, 180.0)}
ARC_VERBS = {"advice_answer": "answers", "qa_answer": "answers", "story": "tells", "opinion": "argues", "comparison": "compares", "demo_or_walkthrough": "walks through", "tutorial_step": "walks through"}


def col(c: Column | str) -> Column:
    """A column, or the column of that name."""
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it; keeps expressions
    whose parts recur from growing with every level of nesting."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(c: Column | str) -> Column:
    """Without white space at both ends; only the ends are looked at."""
    return F.btrim(col(c), F.lit(SPACES))


def simplified(c: Column | str) -> Column:
    """Trimmed, with each run of white space as one space. Only what isn't one space already is replaced."""
    return F.trim(F.regexp_replace(col(c), r"\s{2,}|[^\S ]", " "))


def decimals(c: Column | str, places: int) -> Column:
    """Fixed decimals as C's printf rounds them (the exact binary value, half to even), no grouping."""
    return F.call_function("format_number", col(c).cast("double"), F.lit("0" + ("." + "0" * places if places else "")))


def words(c: Column | str) -> Column:
    """The words of a text."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """How many words a text has. Where single spaces part them, these are counted; else the text is split."""

    def counted(t: Column) -> Column:
        uneven = F.contains(t, F.lit("  "))
        for space in SPACES[1:]:
            uneven = uneven | F.contains(t, F.lit(space))
        single = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
        return F.when(t == "", 0).when(uneven, F.size(words(t))).otherwise(single).cast("long")

    return let(trimmed(c), counted)


def substring_count(c: Column | str, needle: str, lowered: bool = False) -> Column:
    """How often ``needle`` occurs, ignoring case, without overlap; 0 for an empty one. ``lowered``: the
    text is in lower case already, which spares a pass over it."""
    if not needle:
        return F.lit(0).cast("long")
    low, part = col(c) if lowered else F.lower(col(c)), needle.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(part), F.lit("")))) / len(part)).cast("long")


def contains_any(c: Column | str, phrases: Sequence[str], lowered: bool = False) -> Column:
    """Whether any of the phrases occurs, ignoring case. ``lowered``: the text is in lower case already,
    which spares a pass over it for each phrase."""
    low = col(c) if lowered else F.lower(col(c))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def starts_with_ignoring_case(c: Column | str, prefix: str) -> Column:
    """Whether a text begins with ``prefix`` in any case."""
    return F.startswith(F.lower(col(c)), F.lit(prefix.lower()))


def line_value(c: Column | str, prefix: str) -> Column:
    """What follows ``prefix`` on the first line that begins with it in any case, trimmed; empty
    when there is none."""
    lines = F.transform(F.split(col(c), "\n"), trimmed)
    hits = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(prefix.lower())))
    return F.coalesce(trimmed(F.substring(F.try_element_at(hits, F.lit(1)), len(prefix) + 1, 2**30)), F.lit(""))


def prompt_payload(c: Column | str) -> Column:
    """The value of the prompt line, or the whole text trimmed."""
    has = F.contains(col(c), F.lit("_")) & F.regexp_like(col(c), F.lit("(?i)" + PROMPT_PREFIX))  # most have no such line
    value = F.when(has, line_value(c, PROMPT_PREFIX)).otherwise("")
    return let(value, lambda v: F.when(v != "", v).otherwise(trimmed(c)))


def scope(duration: Column | str) -> Column:
    """The curation scope of a selected duration."""
    d = col(duration)
    return F.when(d >= 2400, "large_range_multiple_clips").when(d >= 600, "medium_range_one_or_more_clips").otherwise("short_range_best_moment")


def clean_phrase(c: Column | str) -> Column:
    """Simplified, without a prompt label, bullets in front and marks at the end."""
    bare = F.regexp_replace(simplified(c), r"(?i)^OPUS_PROMPT\s*:\s*", "")
    bare = F.regexp_replace(bare, "^[\\-–—•]+\\s*", "")
    return trimmed(F.regexp_replace(bare, r"[.;:]+$", ""))


#: Openers that a target loses, a fixed value.
FIND_OPENER = r"(?i)^find\s+(one\s+|multiple\s+|the\s+)?(clear\s+|strong\s+|self-contained\s+|strongest\s+)*(clip|clips|moment)s?\s+(where|about)\s+"
SPEAKER_OPENER = r"(?i)^the\s+speaker\s+(explains|answers|tells|argues|demonstrates|compares|walks through)\s+"


def bare_target(c: Column | str) -> Column:
    """A target without the search opener and the speaker opener."""
    return clean_phrase(F.regexp_replace(F.regexp_replace(clean_phrase(c), FIND_OPENER, ""), SPEAKER_OPENER, ""))


def arc_verb(c: Column | str) -> Column:
    """The verb of an arc type; unknown ones explain."""
    key, out = F.lower(trimmed(c)), F.lit("explains")
    for name, verb in ARC_VERBS.items():
        out = F.when(key == name, verb).otherwise(out)
    return out


def find_phrase(scope_: Column | str) -> Column:
    """The opener of a rendered prompt by scope."""
    s = col(scope_)
    return F.when(s == "large_range_multiple_clips", "Find multiple strong self-contained clips where").when(s == "short_range_best_moment", "Find the strongest self-contained moment where").otherwise("Find one or more strong self-contained clips where")


def language(c: Column | str, others: bool) -> Column:
    """pt or en for their aliases; other codes stay as they are where ``others``, else are auto, as
    is an empty one."""
    key = F.lower(trimmed(c))
    rest = F.when(key == "", "auto").otherwise(key) if others else F.lit("auto")
    return F.when(key.isin(*PORTUGUESE), "pt").when(key.isin(*ENGLISH), "en").otherwise(rest)


def first_filled(*columns: Column | str, default: str = "auto") -> Column:
    """The first that is neither null nor blank, else the default."""
    return F.coalesce(*(F.when(trimmed(c) != "", trimmed(c)) for c in columns), F.lit(default))


def preset(c: Column | str) -> Column:
    """The clip length preset by its names; Auto for all others."""
    key = F.lower(trimmed(F.coalesce(col(c), F.lit(""))))
    return F.when(key == "short", "Short").when(key == "long", "Long").when(key.isin("medium", "recommended", "complete"), "Medium").otherwise("Auto")


def preset_bound(c: Column | str, side: int) -> Column:
    """The lower (0) or upper (1) length of a preset in seconds; null for Auto."""
    p, out = preset(c), F.lit(None).cast("double")
    for name, bounds in PRESET_BOUNDS.items():
        out = F.when(p == name, F.lit(bounds[side])).otherwise(out)
    return out


def clock(c: Column | str, rounded: bool) -> Column:
    """HH:MM:SS of seconds, rounded or truncated; hours may have more digits, negatives count as 0."""
    s = F.greatest((F.round(col(c)) if rounded else F.floor(col(c))).cast("long"), F.lit(0).cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def time_token(c: Column | str) -> Column:
    """Rounded milliseconds, never negative."""
    return F.greatest(F.round(col(c) * 1000).cast("long"), F.lit(0).cast("long"))


def number_setting(c: Column | str, default: float, low: float, high: float) -> Column:
    """A number from a text setting: the default where it doesn't parse, else clamped."""
    v = F.try_cast(trimmed(c), "double") if hasattr(F, "try_cast") else col(c).try_cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(good, F.least(F.greatest(v, F.lit(low)), F.lit(high))).otherwise(F.lit(default))


def resample_threshold(c: Column | str) -> Column:
    """Percent of shrinking from which a video is cut: 60 unless set, within 0 and 100."""
    return number_setting(c, 60.0, 0.0, 100.0)


def context_padding(c: Column | str) -> Column:
    """Seconds around the ranges that count as context: 60 unless set, within 0 and 600."""
    return number_setting(c, 60.0, 0.0, 600.0)


def selected_ranges_text(ranges: Column | str, source_language: Column | str) -> Column:
    """A numbered list of an array of (start_sec, end_sec), in Portuguese or English."""
    r, pt = col(ranges), language(source_language, others=False) == "pt"
    head = F.when(pt, "Ranges/marcações escolhidos pelo usuário, em ordem de prioridade:").otherwise("User-selected ranges/markers, in priority order:")
    none = F.when(pt, "Não há ranges/marcações específicos escolhidos pelo usuário. Escolha os melhores trechos usando a transcrição.").otherwise("There are no specific user-selected ranges/markers. Choose the best moments using the transcript.")
    lines = F.transform(r, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), decimals(x["start_sec"], 3), F.lit("s-"), decimals(x["end_sec"], 3), F.lit("s")))
    return F.when(F.coalesce(F.size(r), F.lit(0)) > 0, F.concat(head, F.lit("\n"), F.array_join(lines, "\n"))).otherwise(none)


def keywords_text(keywords: Column | str, source_language: Column | str) -> Column:
    """Keywords joined, or the sentence that there are none."""
    none = F.when(language(source_language, others=False) == "pt", "Nenhuma keyword/tema específico foi informado pelo usuário.").otherwise("No specific keyword/topic was provided by the user.")
    return F.when(F.coalesce(F.size(col(keywords)), F.lit(0)) > 0, trimmed(F.array_join(col(keywords), ", "))).otherwise(none)


def first_keyword(keywords: Column | str) -> Column:
    """The first usable keyword, cut at a comma or `` and ``, at most 90 characters; else empty."""
    cut = F.transform(col(keywords), lambda k: trimmed(F.substring_index(F.substring_index(simplified(k), ",", 1), " and ", 1)))
    return F.coalesce(trimmed(F.left(F.try_element_at(F.filter(cut, lambda k: k != ""), F.lit(1)), F.lit(90))), F.lit(""))


def segment_line(start: Column | str, end: Column | str, text: Column | str, places: int = 2) -> Column:
    """``[start s-end s] text`` with fixed decimals."""
    return F.concat(F.lit("["), decimals(start, places), F.lit("s-"), decimals(end, places), F.lit("s] "), trimmed(text))


def ranges_log(ranges: Column | str, overall_start: Column | str, overall_end: Column | str) -> Column:
    """Ranges and their total length for a log line; the overall range where there are none."""
    overall = F.array(F.struct(col(overall_start).alias("start_sec"), col(overall_end).alias("end_sec")))
    r = F.when(F.coalesce(F.size(col(ranges)), F.lit(0)) > 0, col(ranges)).otherwise(overall)
    start = lambda x: F.greatest(x["start_sec"], F.lit(0.0))
    end = lambda x: F.greatest(x["end_sec"], start(x))
    parts = F.transform(r, lambda x: F.concat(decimals(start(x), 2), F.lit("-"), decimals(end(x), 2)))
    total = F.aggregate(r, F.lit(0.0), lambda t, x: t + end(x) - start(x))
    return F.concat(F.lit("ranges="), F.array_join(parts, ","), F.lit(" totalSelectedSec="), decimals(total, 2))


def unix_lines(c: Column | str) -> Column:
    """Line ends as single line feeds."""
    return F.regexp_replace(col(c), r"\r\n?", "\n")


def is_gate_failure(c: Column | str) -> Column:
    """Whether a prompt says that no strong clip was found."""
    return starts_with_ignoring_case(trimmed(c), GATE_PREFIX)


def gate_reason(c: Column | str) -> Column:
    """The reason of such a prompt, a fixed one where it gives none; empty for other prompts."""
    reason = trimmed(F.substring(trimmed(c), len(GATE_PREFIX) + 1, 2**30))
    return F.when(is_gate_failure(c), F.when(reason == "", GATE_REASON).otherwise(reason)).otherwise("")


def is_truthy(c: Column | str) -> Column:
    """Whether a setting is true, yes or 1."""
    return F.coalesce(F.lower(trimmed(c)).isin("true", "1", "yes"), F.lit(False))


def menu_title(c: Column | str) -> Column:
    """A menu title without mnemonics, for comparison."""
    return F.lower(trimmed(F.replace(col(c), F.lit("&"), F.lit(""))))


def position_to_x(sec: Column | str, duration: Column | str, width: Column | str) -> Column:
    """The pixel of a position on a time bar; 0 without a duration."""
    d = col(duration)
    return F.when(d > 0, F.least(F.greatest(col(sec), F.lit(0.0)), d) / d * col(width)).otherwise(0.0)


def x_to_position(x: Column | str, duration: Column | str, width: Column | str) -> Column:
    """The position of a pixel on a time bar, within the duration."""
    w = col(width)
    return F.when(w > 0, F.least(F.greatest(col(x) / w, F.lit(0.0)), F.lit(1.0)) * col(duration)).otherwise(0.0)


def credits(seconds: Column | str) -> Column:
    """Started minutes; 0 where the length isn't a positive number."""
    s = col(seconds)
    return F.when((s > 0) & ~F.isnan(s) & (s < float("inf")), F.ceil(s / 60).cast("long")).otherwise(F.lit(0).cast("long"))


def thread_count(cores: Column | str) -> Column:
    """Model threads for a number of cores: one less, 1 to 4."""
    return F.greatest(F.least(col(cores) - 1, F.lit(4)), F.lit(1))
