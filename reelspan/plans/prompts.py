"""Model replies, structured plans, rendered prompts and request bodies, as columns and DataFrames.

Network calls are not part of this library: replies come in as a table, requests go out as one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.rules import issues
from reelspan.functions.text import (
    GATE_PREFIX, GATE_REASON, PROMPT_PREFIX, arc_verb, bare_target, clean_phrase, col, contains_any, decimals, find_phrase,
    first_keyword, is_gate_failure, keywords_text, language, let, line_value, preset, preset_bound, prompt_payload, selected_ranges_text, simplified, trimmed,
)
from reelspan.operators.entities import names_text

#: The text fields of a plan, and what stands in for a missing one (fixed values).
PLAN_FIELDS = ("reason", "arc_type", "main_target", "context_phrase", "opening_criteria", "development_criteria", "ending_criteria", "boundary_criteria")
OPENING = "introduce the idea with enough local context for the first sentence to stand alone"
DEVELOPMENT = "develop one continuous local explanation or answer"
ENDING = "end after the local point is resolved"
BOUNDARY = "unfinished setup, list items, or mid-thought transitions"
CONTEXT_LEADS = ("with", "through", "using", "from", "about")
NO_TOPIC = "the strongest topics in the selected range"
RUBRIC = "Find self-contained clips within the selected range from one dominant sub-arc about {{topic_keywords}}. Prefer complete arcs with a natural start, focused development, clear payoff, and natural ending. Avoid isolated fragments, housekeeping, timestamps, visual effects, and duration requests."
LAST_SENTENCE = "Prefer clips that end after the local point is resolved, with clean natural boundaries and without unfinished setup, list items, and mid-thought transitions."
SEED, REPLY_TOKENS, REPAIR_TOKENS = 12345, 500, 350
#: Targets of prompts made without a model, and the words that lead to some of them.
TARGETS = {
    "unlock_german": "the unlock method for learning German through {name}'s language-learning approach", "unlock": "the unlock method through {name}'s language-learning approach", "pronoun": "the selected idea connected to {name}",
    "key": "the unlock-based method for learning German", "loop": "the daily German-learning loop", "plan": "one resolved part of the German-learning plan", "topic": "one clear idea about {topic}", "none": "one clear idea from the selected range",
}
TARGET_WORDS = {"key": ("unlock", "key clicks", "one key", "one logic"), "loop": ("daily loop", "routine", "spaced repetition", "practice with natives"), "plan": ("roadmap", "8-week", "eight-week", "week-by-week")}
#: First and second sentences of such prompts.
OPENERS = {
    "large_range_multiple_clips": "Find multiple strong self-contained clips where the speaker explains ", "short_range_best_moment": "Find the strongest self-contained moment where the speaker explains ",
    "other": "Find one clear self-contained clip where the speaker explains ",
}
MIDDLES = {
    "unlock": "Prioritize moments that introduce {name} or the key/unlock metaphor before later pronouns, then show how one piece of language logic becomes easier to understand.",
    "pronoun": "Prioritize moments that introduce {name} or the target idea before later pronouns and indirect references, then develop one continuous local explanation.",
    "short": "Prioritize moments that introduce the idea with enough local context and complete one resolved part of the explanation.",
    "other": "Prioritize moments that introduce the idea with enough local context and develop the same continuous explanation.",
}


def put(sentence: str, **values: Column) -> Column:
    """A sentence with values in the place of ``{name}``."""
    parts = re.split(r"\{(\w+)\}", sentence)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def reply_text(body: Column | str) -> Column:
    """The text of a reply: the first choice with a message that isn't blank, else output_text, else
    the texts of all output contents by lines; empty when there is none."""
    schema = "choices array<struct<message:struct<content:string>>>, output_text string, output array<struct<content:array<struct<text:string>>>>"
    full = lambda c: let(c, lambda t: F.when(trimmed(t) != "", trimmed(t)))

    def of(r: Column) -> Column:
        contents = F.filter(F.transform(r["choices"], lambda c: trimmed(c["message"]["content"])), lambda t: t.isNotNull() & (t != ""))
        parts = F.flatten(F.transform(r["output"], lambda o: F.coalesce(F.transform(o["content"], lambda c: c["text"]), F.array().cast("array<string>"))))
        parts = F.filter(parts, lambda t: t.isNotNull() & (trimmed(t) != ""))
        return F.coalesce(F.try_element_at(contents, F.lit(1)), full(r["output_text"]), full(F.array_join(parts, "\n")), F.lit(""))

    return let(F.from_json(col(body), schema), of)


def project_id(body: Column | str, fallback: Column | str) -> Column:
    """The project id of a response: id, projectId, project.id, else the fallback."""
    text = lambda path: F.try_variant_get(F.try_parse_json(col(body)), path, "string")
    return F.coalesce(*(F.when(trimmed(text(p)) != "", text(p)) for p in ("$.id", "$.projectId", "$.project.id")), col(fallback))


def plan_object(raw: Column | str) -> Column:
    """The JSON object in a reply as a variant: bare, fenced, or from the first to the last brace;
    unwrapped from ``plan`` where that is an object. Null when there is none or it is empty."""
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    fenced = lambda t: trimmed(F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    text = let(trimmed(raw), lambda t: F.when(F.startswith(t, F.lit("```")), fenced(t)).otherwise(t))

    def parsed(t: Column) -> Column:
        inner = F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")))
        return let(F.try_parse_json(t), lambda v: F.when(is_object(v), v).otherwise(let(inner, lambda w: F.when(is_object(w), w))))

    def unwrapped(v: Column) -> Column:
        return let(F.try_variant_get(v, "$.plan", "variant"), lambda p: F.when(is_object(p), p).otherwise(v))

    found = let(let(text, parsed), unwrapped)
    return let(found, lambda v: F.when(F.schema_of_variant(v) != "OBJECT<>", v))


def plan_text(plan: Column, field: str) -> Column:
    """A text field of a plan, simplified; empty where it is missing or no text."""
    is_text = F.schema_of_variant(F.try_variant_get(plan, f"$.{field}", "variant")) == "STRING"
    return F.coalesce(F.when(is_text, simplified(F.try_variant_get(plan, f"$.{field}", "string"))), F.lit(""))


def default_target(prompt: Column | str, text: Column | str, names: Column | str, pronoun_dependent: Column | str, unlock_method: Column | str, keywords: Column | str) -> Column:
    """The search target of a prompt that is made without a model: the first of eight that fits."""
    name = F.try_element_at(col(names), F.lit(1))
    unlock, pronoun = F.coalesce(col(unlock_method), F.lit(False)), F.coalesce(col(pronoun_dependent), F.lit(False))

    def chosen(both: Column) -> Column:
        has = lambda *p: F.exists(F.array(*map(F.lit, p)), lambda x: F.contains(both, x))
        german = has("german")
        topic = let(first_keyword(keywords), lambda k: F.when(k != "", put(TARGETS["topic"], topic=k)).otherwise(TARGETS["none"]))
        out = F.when(unlock & german, put(TARGETS["unlock_german"], name=name)).when(unlock, put(TARGETS["unlock"], name=name)).when(pronoun & name.isNotNull(), put(TARGETS["pronoun"], name=name))
        for kind, words in TARGET_WORDS.items():
            out = out.when(has(*words) & german, TARGETS[kind])
        return out.otherwise(topic)

    return let(F.lower(F.concat(prompt_payload(prompt), F.lit(" "), F.coalesce(col(text), F.lit("")))), chosen)


def rendered_plan(plan: Column, scope: Column | str, target: Column) -> Column:
    """A plan as a prompt of three sentences, or as a gate failure; ``target`` stands in for a missing
    one."""
    filled_or = lambda c, default: let(c, lambda t: F.when(t != "", t).otherwise(default))

    def context(c: Column) -> Column:
        led = F.exists(F.array(*map(F.lit, CONTEXT_LEADS)), lambda lead: F.startswith(F.lower(c), lead))
        return F.when(c == "", "").when(led, F.concat(F.lit(" "), c)).otherwise(F.concat(F.lit(" with context from "), c))

    def shown(p: Column) -> Column:
        get = lambda f, default: filled_or(clean_phrase(plan_text(p, f)), default)
        first = F.concat(find_phrase(scope), F.lit(" the speaker "), arc_verb(plan_text(p, "arc_type")), F.lit(" "), filled_or(bare_target(plan_text(p, "main_target")), target), let(clean_phrase(plan_text(p, "context_phrase")), context), F.lit("."))
        second = F.concat(F.lit("Prioritize moments that "), get("opening_criteria", OPENING), F.lit(", then "), get("development_criteria", DEVELOPMENT), F.lit("."))
        third = F.concat(F.lit("Prefer clips that "), get("ending_criteria", ENDING), F.lit(", with clean natural boundaries and without "), get("boundary_criteria", BOUNDARY), F.lit("."))
        is_flag = F.schema_of_variant(F.try_variant_get(p, "$.no_strong_clip_found", "variant")) == "BOOLEAN"
        none = F.coalesce(is_flag & F.try_variant_get(p, "$.no_strong_clip_found", "boolean"), F.lit(False))
        return F.when(none, F.concat(F.lit(GATE_PREFIX + " "), filled_or(plan_text(p, "reason"), GATE_REASON))).otherwise(simplified(F.concat_ws(" ", first, second, third)))

    return let(plan, lambda p: F.when(p.isNotNull(), shown(p)))


def rubric(keywords: Column | str, template: Column | str | None = None) -> Column:
    """The prompt that needs neither model nor transcript, from a template or the fixed one."""
    topic = trimmed(F.array_join(F.coalesce(col(keywords), F.array().cast("array<string>")), ", "))
    base = F.lit(RUBRIC) if template is None else F.when(trimmed(template) != "", col(template)).otherwise(RUBRIC)
    return trimmed(F.replace(base, F.lit("{{topic_keywords}}"), F.when(topic == "", NO_TOPIC).otherwise(topic)))


def normalized_reply(raw: Column | str, scope: Column | str, may_have_no_clip: Column | str, target: Column, keywords: Column | str) -> Column:
    """What a reply says: nothing; a gate failure, kept only where it is believable; a rendered plan;
    a labelled line; or the reply itself."""
    gated = lambda c: F.when(is_gate_failure(c) & ~col(may_have_no_clip), rubric(keywords)).otherwise(c)
    labelled = lambda t: let(line_value(t, PROMPT_PREFIX), lambda line: F.when(line != "", line).otherwise(t))

    def read(t: Column) -> Column:
        shown = rendered_plan(plan_object(t), scope, target)
        return F.when(t == "", "").when(is_gate_failure(t), gated(t)).otherwise(let(shown, lambda s: F.when(s.isNotNull(), gated(s)).otherwise(labelled(t))))

    return let(trimmed(raw), read)


def fallback_prompt(scope: Column | str, target: Column, names: Column | str, pronoun_dependent: Column | str, unlock_method: Column | str) -> Column:
    """A prompt made without a model."""
    s, name = col(scope), F.try_element_at(col(names), F.lit(1))
    unlock, pronoun = F.coalesce(col(unlock_method), F.lit(False)), F.coalesce(col(pronoun_dependent), F.lit(False)) & name.isNotNull()
    short = s == "short_range_best_moment"
    opener = F.when(s == "large_range_multiple_clips", OPENERS["large_range_multiple_clips"]).when(short, OPENERS["short_range_best_moment"]).otherwise(OPENERS["other"])
    middle = F.when(unlock, put(MIDDLES["unlock"], name=name)).when(pronoun, put(MIDDLES["pronoun"], name=name)).when(short, MIDDLES["short"]).otherwise(MIDDLES["other"])
    return F.concat(opener, target, F.lit(". "), middle, F.lit(" " + LAST_SENTENCE))


def put_in(template: Column | str, values: dict[str, Column]) -> Column:
    """Puts values in the place of ``{{name}}``, one name after another in the given order; a value
    that holds a later name has that filled too. The template is parted and joined by the value, as ``replace`` sets
    aside 16 times the value's size."""
    out = col(template)
    for name, value in values.items():
        out = F.call_function("array_join", F.split(out, re.escape("{{" + name + "}}")), F.coalesce(value, F.lit("")))
    return out


def filled(template: Column | str, values: dict[str, Column]) -> Column:
    """The same, trimmed."""
    return trimmed(put_in(template, values))


def input_values(lang: str = "source_language") -> dict[str, Column]:
    """The values of an input template, in order of filling, from columns: video_path,
    range_start_sec, range_end_sec, ranges, keywords, genre, names, source_language,
    clip_length_preset, selected_sec, scope, timeline, context, transcript."""
    return {
        "video_file": F.element_at(F.split("video_path", "/"), -1),
        "range_start_sec": decimals("range_start_sec", 3), "range_end_sec": decimals("range_end_sec", 3),
        "selected_ranges": selected_ranges_text("ranges", lang), "topic_keywords": keywords_text("keywords", lang),
        "genre": F.when(trimmed("genre") == "", "Auto").otherwise(trimmed("genre")),
        "named_references": names_text("names"), "source_language": language(lang, others=False),
        "clip_length_preset": trimmed("clip_length_preset"),
        "selected_duration_sec": decimals("selected_sec", 3), "selected_duration_min": decimals(F.col("selected_sec") / 60, 2),
        "curation_scope": F.col("scope"), "semantic_timeline": F.col("timeline"), "context_transcript": F.col("context"),
        "selected_range_transcript": F.col("transcript"), "transcript": F.col("transcript"),
    }


def repair_values(lang: str = "source_language") -> dict[str, Column]:
    """The values of a repair template, from the columns above and prompt and issues."""
    v = input_values(lang)
    return {"generated_opus_prompt": prompt_payload("prompt"), "issues": F.array_join("issues", "; ")} | {k: v[k] for k in ("curation_scope", "clip_length_preset", "selected_ranges", "topic_keywords", "named_references", "selected_range_transcript")}


def with_template(requests: DataFrame, templates: DataFrame, default: str, language: str = "language") -> DataFrame:
    """Adds the template of each request's language, else that of auto, else the default; ``templates`` (language, template) is one
    row a language, of several the greatest, and is broadcast, so requests stay where they are."""
    t = templates.where(trimmed("template") != "").groupBy(F.col("language").alias(language)).agg(F.max("template").alias("template"))
    auto = F.broadcast(templates.where("language = 'auto'").agg(F.max("template").alias("auto")))
    own = requests.join(F.broadcast(t), language, "left").crossJoin(auto)
    return own.withColumn("template", F.coalesce("template", F.when(trimmed("auto") != "", F.col("auto")), F.lit(default))).drop("auto")


def chosen_template(languages: DataFrame, templates: DataFrame, default: str) -> DataFrame:
    """Per request (request_id, language) its template (``with_template``)."""
    return with_template(languages, templates, default).select("request_id", "language", "template")


def chat_request(model: Column | str, text: Column | str, system: str, max_tokens: int = REPLY_TOKENS, json_mode: bool = True) -> Column:
    """The body of a model request; sampling is fixed."""
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), col(text).alias("content")))
    fields = [trimmed(model).alias("model"), F.lit(max_tokens).alias("max_completion_tokens"), F.lit(0.0).alias("temperature"), F.lit(1.0).alias("top_p"), F.lit(SEED).alias("seed")]
    if json_mode:
        fields.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    return F.to_json(F.struct(*fields, messages.alias("messages")))


def project_request(settings: DataFrame) -> DataFrame:
    """One request body for each range of (upload_id, start_sec, end_sec, skip_curate,
    clip_length_preset, keywords, model, genre, source_language, brand_template_id, ai_prompt): a
    fixed clip has its own start and length, else the preset's bounds unless it is Auto."""
    fixed, low, high = F.col("skip_curate"), preset_bound("clip_length_preset", 0), preset_bound("clip_length_preset", 1)
    length = F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0))
    durations = F.when(fixed, F.array(F.array("start_sec", "end_sec"))).when(low.isNotNull(), F.array(F.array(low, high)))
    prompt = F.when(trimmed("ai_prompt") != "", trimmed("ai_prompt"))
    filled_or = lambda c, default: F.when(trimmed(c) == "", default).otherwise(trimmed(c))
    curation = F.struct(
        F.struct(F.col("start_sec").alias("startSec"), F.col("end_sec").alias("endSec")).alias("range"), durations.alias("clipDurations"),
        F.when(fixed, F.array("start_sec")).alias("clip_start"), F.when(fixed, F.array(length)).alias("clip_duration"),
        filled_or("model", "ClipAnything").alias("model"), F.coalesce("keywords", F.array().cast("array<string>")).alias("topicKeywords"),
        F.when(trimmed("genre") == "", "Auto").otherwise(F.col("genre")).alias("genre"), F.col("skip_curate").alias("skipCurate"), prompt.alias("prompt"), prompt.alias("userPrompt"),
    )
    body = F.struct(F.col("upload_id").alias("videoUrl"), F.struct(filled_or("source_language", "auto").alias("sourceLang")).alias("importPref"), F.when(trimmed("brand_template_id") != "", trimmed("brand_template_id")).alias("brandTemplateId"), curation.alias("curationPref"))
    return settings.withColumn("clip_length", preset("clip_length_preset")).withColumn("body", F.to_json(body))


def is_usable(cached_prompt: Column | str) -> Column:
    """Whether a cached prompt settles a request (scope, names, pronoun_dependent, unlock_method): it is no gate failure, and
    no rule objects."""
    clean = F.size(issues(cached_prompt, "scope", "names", "pronoun_dependent", "unlock_method")) == 0
    return F.coalesce((trimmed(cached_prompt) != "") & ~is_gate_failure(cached_prompt) & clean, F.lit(False))


def asked_again(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """The ladder of requests that were asked before with nothing in the cache, once the cache holds what could be stored; ``rows`` are
    the ladder's own of that time. Where the cache doesn't settle a request, the same replies lead to the same row."""
    facts = requests.select("request_id", "scope", "names", "pronoun_dependent", "unlock_method")
    used = F.col("cacheable") & is_usable("prompt")
    found = rows.join(facts, "request_id").withColumn("used", used)
    return found.select("request_id", F.when(F.col("used"), "cache").otherwise(F.col("source")).alias("source"), "prompt", (F.col("cacheable") & ~F.col("used")).alias("cacheable"))


def prompt_ladder(requests: DataFrame, replies: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """The prompt of each request and where it came from. ``requests`` has request_id, cached_prompt,
    scope, may_have_no_clip, text, names, pronoun_dependent, unlock_method, keywords; ``replies`` and
    ``repairs`` have request_id and body. A cached prompt is used while no rule objects; else the
    reply is normalised and checked; one with findings is repaired once, where repairs are given,
    and otherwise replaced by the fallback. Gate failures pass unchecked and are never cacheable."""
    judged = lambda p: issues(p, "scope", "names", "pronoun_dependent", "unlock_method")
    clean = lambda p: F.size(judged(p)) == 0
    df = requests.join(replies.select("request_id", reply_text("body").alias("reply")), "request_id", "left")
    df = df.join(repairs.select("request_id", reply_text("body").alias("repair")), "request_id", "left") if repairs is not None else df.withColumn("repair", F.lit(None).cast("string"))
    target = lambda p: default_target(p, "text", "names", "pronoun_dependent", "unlock_method", "keywords")
    said = lambda c: normalized_reply(F.coalesce(c, F.lit("")), "scope", "may_have_no_clip", target(F.lit("")), "keywords")
    df = df.withColumn("said", said(F.col("reply"))).withColumn("mended", said(F.col("repair")))
    df = df.withColumn("fallback", fallback_prompt("scope", target("said"), "names", "pronoun_dependent", "unlock_method"))
    source = (
        F.when(is_usable("cached_prompt"), "cache").when(F.col("reply").isNull() | (F.col("said") == ""), "failed").when(is_gate_failure("said"), "gate")
        .when(clean("said"), "model").when(F.col("repair").isNotNull() & (F.col("mended") != "") & clean("mended"), "repair").otherwise("fallback")
    )
    df = df.withColumn("source", source)
    prompt = F.when(F.col("source") == "cache", F.col("cached_prompt")).when(F.col("source").isin("gate", "model"), F.col("said")).when(F.col("source") == "repair", F.col("mended")).when(F.col("source") == "fallback", F.col("fallback")).otherwise("")
    df = df.withColumn("prompt", prompt)
    keep = F.col("source").isin("model", "repair") | (F.col("source") == "fallback") & clean("fallback")
    return df.select("request_id", "source", "prompt", keep.alias("cacheable"))
