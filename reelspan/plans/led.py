"""Registered queries on prompts and transcripts that meet every rule.

The test tables' prose holds none of the rules' words. Here each document's text is led by one of some sentences, by the
length of the text, so that every finding, flag and step of the ladder occurs; the whole text follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions import rules
from reelspan.operators import aggregates as A
from reelspan.operators import entities as E
from reelspan.operators import intervals as I
from reelspan.plans import cases
from reelspan.plans import prompts as P
from reelspan.plans.catalogue import MARKERS, RANGES, SEGMENTS, markers_of, query
from reelspan.sources import derived

#: Sentences that lead the texts: names, pronouns and methods, and the words of the rules.
LEADS = (
    "Find the moment where Anna Berg shows the roadmap for her study routine.", "Find Anna Berg and the way she teaches one key.", "Find one clear idea; it doesn't need more.", "find words: first, second, third, fourth, fifth, sixth, seventh, eighth.",
    "Find the daily loop. Find the tools. Find the tandem partner. Find the progression. Also find more.", "Find why it matters and how it works, especially here.", "Find the speaker and his plan for thirty minutes.", "Find this or that or those or these.",
    "Find the challenge and the method that goes with it.", "Find motivation, then the framework, then the week-by-week steps.", "Otto Lang Weber says that this method can unlock words, making sure that practice helps.", "Maria Sol Prado thinks that approach is good.",
    "Find a and b and c and d and e and f and g.", "Find German and one key, as Otto Lang told Lang Weber.", "The German roadmap has eight-week steps.", "OPUS_PROMPT: Find the best explanation", "Max Challenge Plan has one key, the way she teaches it.",
)
LED_SQL = "opened AS (SELECT doc_id, lang, source, n_chars, ([" + ", ".join("'" + x.replace("'", "''") + "'" for x in LEADS) + f"])[length(text) % {len(LEADS)} + 1] AS lead, ([" + ", ".join("'" + x.replace("'", "''") + "'" for x in LEADS) + f"])[length(text) % {len(LEADS)} + 1] || chr(10) || text AS text FROM documents)"


def over_led(sql: str) -> str:
    """SQL on the documents, as SQL on the led ones."""
    return sql.replace("FROM documents", "FROM opened")


def led_of(spark: SparkSession, d: str) -> DataFrame:
    """The documents with their leads."""
    docs = derived.table(spark, d, "documents")
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.length("text") % len(LEADS) + 1).cast("int"))
    return docs.withColumn("lead", lead).withColumn("own", F.col("text")).withColumn("text", F.concat("lead", F.lit("\n"), "text"))


def requests_of(spark: SparkSession, d: str) -> DataFrame:
    """One request for each led document, with the facts of its transcript; worked out once."""
    return derived.held(spark, d, "led-requests", lambda: made_requests(spark, d))


def segments_of(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the led documents, derived once."""
    return derived.held(spark, d, "led-segments", lambda: derived.segments(led_of(spark, d)))


def made_requests(spark: SparkSession, d: str) -> DataFrame:
    """What ``requests_of`` holds."""
    docs, s = led_of(spark, d), segments_of(spark, d)
    r = I.marker_ranges(markers_of(spark, d), derived.durations(s))
    overall = docs.select(F.col("doc_id").alias("video_id"), F.lit(0.0).alias("range_start_sec"), F.lit(0.0).alias("range_end_sec"))
    facts = E.reference_facts(s).join(A.selected_duration(s, r, overall), "video_id")
    return facts.select(F.col("video_id").alias("request_id"), F.lit("").alias("cached_prompt"), "scope", "may_have_no_clip", "text", "names", "pronoun_dependent", "unlock_method", F.array(F.lit("topic, and more")).alias("keywords"))


FACTS_SQL = f"WITH {LED_SQL}, " + over_led(f"{SEGMENTS}, {cases.TOP}, {cases.FACTS}")
JUDGED_SQL = f"WITH {LED_SQL}, " + over_led(f"{SEGMENTS},{MARKERS},{RANGES}, {cases.TOP}, {cases.FACTS}, {cases.SCOPED}")


@query(f"{FACTS_SQL} SELECT video_id, array_to_string(names, ', ') AS names, pronoun AS pronoun_dependent, unlock_ AS unlock_method FROM facts")
def led_facts(spark: SparkSession, d: str) -> DataFrame:
    """Names, and whether transcripts depend on them, where some do."""
    return E.reference_facts(segments_of(spark, d)).select("video_id", F.array_join("names", ", ").alias("names"), "pronoun_dependent", "unlock_method")


LED_LOW = f"""{JUDGED_SQL}, prompts AS (SELECT doc_id AS video_id, 'whole' AS kind, text AS p FROM opened UNION ALL SELECT doc_id, 'lead', lead FROM opened UNION ALL SELECT doc_id, 'own', text FROM documents),
norms AS (SELECT p.video_id, kind, {cases.simple_sql(cases.PAYLOAD)} AS norm, coalesce(scope, '') AS scope, coalesce(names, []::VARCHAR[]) AS names, coalesce(pronoun, false) AS pronoun, coalesce(unlock_, false) AS unlock_ FROM prompts p LEFT JOIN facts USING (video_id) LEFT JOIN scoped USING (video_id)),
low AS (SELECT *, lower(norm) AS low FROM norms)"""


@query(f"{LED_LOW} SELECT video_id, kind, array_to_string({cases.rules_sql()}, '; ') AS issues FROM low")
def led_issues(spark: SparkSession, d: str) -> DataFrame:
    """Findings on led texts, whole, on their leads and on their own texts, every rule among them (section 2.9, E7)."""
    docs = led_of(spark, d)
    prompts = docs.select(F.col("doc_id").alias("video_id"), F.explode(F.array(F.struct(F.lit("whole").alias("kind"), F.col("text").alias("p")), F.struct(F.lit("lead").alias("kind"), F.col("lead").alias("p")), F.struct(F.lit("own").alias("kind"), F.col("own").alias("p")))).alias("x")).select("video_id", "x.kind", F.col("x.p").alias("prompt"))
    facts = requests_of(spark, d).select(F.col("request_id").alias("video_id"), "scope", "names", "pronoun_dependent", "unlock_method")
    return prompts.join(facts, "video_id", "left").select("video_id", "kind", F.array_join(rules.issues("prompt", "scope", "names", "pronoun_dependent", "unlock_method"), "; ").alias("issues"))


@query(f"""{JUDGED_SQL}, r AS (SELECT f.video_id, scope, may, t, names, names[1] AS name, pronoun, unlock_, 'topic' AS topic, lead FROM facts f JOIN scoped USING (video_id) JOIN opened ON doc_id = f.video_id),
said AS (SELECT *, regexp_replace(lead, '^\\s+|\\s+$', '', 'g') AS p FROM r), labelled AS (SELECT *, {cases.PAYLOAD} AS payload FROM said),
shown AS (SELECT *, CASE WHEN {cases.LABELLED} IS NOT NULL THEN payload ELSE p END AS reply FROM labelled), aimed AS (SELECT *, lower(payload || ' ' || t) AS h FROM shown), marked AS (SELECT *, contains(h, 'german') AS german FROM aimed),
targets AS (SELECT *, {cases.TARGET} AS target FROM marked), fall AS (SELECT *, {cases.FALLBACK} AS fallback, 'Find what ' || array_to_string(names, ' or ') || ' say.' AS repair FROM targets),
cand AS (SELECT video_id, scope, names, pronoun, unlock_, unnest(['model', 'repair', 'fallback']) AS kind, unnest([reply, repair, fallback]) AS prompt FROM fall),
normed AS (SELECT *, {cases.simple_sql("prompt")} AS norm, lower({cases.simple_sql("prompt")}) AS low FROM cand), judged AS (SELECT *, {cases.CLEAN} AS clean FROM normed),
one AS (SELECT video_id, bool_or(clean) FILTER (WHERE kind = 'model') AS m, bool_or(clean) FILTER (WHERE kind = 'repair') AS r, bool_or(clean) FILTER (WHERE kind = 'fallback') AS f, max(prompt) FILTER (WHERE kind = 'model') AS pm, max(prompt) FILTER (WHERE kind = 'repair') AS pr, max(prompt) FILTER (WHERE kind = 'fallback') AS pf FROM judged GROUP BY 1)
SELECT video_id AS request_id, CASE WHEN m THEN 'model' WHEN r THEN 'repair' ELSE 'fallback' END AS source, md5(CASE WHEN m THEN pm WHEN r THEN pr ELSE pf END) AS prompt, m OR r OR f AS cacheable FROM one""")
def led_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Prompts from the model, a repair or the fallback, where each occurs (J3, J5, J6, J12): replies are the leads, repairs
    name all names."""
    requests = requests_of(spark, d)
    said = lambda c: F.to_json(F.struct(c.alias("output_text"))).alias("body")
    replies = led_of(spark, d).select(F.col("doc_id").alias("request_id"), said(F.col("lead")))
    repairs = requests.select("request_id", said(F.concat(F.lit("Find what "), F.array_join("names", " or "), F.lit(" say."))))
    return P.prompt_ladder(requests, replies, repairs).withColumn("prompt", F.md5("prompt"))
