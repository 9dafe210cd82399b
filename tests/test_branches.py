"""The queries that exist so that every branch occurs: each does, in what is compared with SQL."""

from reelspan.plans import catalogue


def values(spark, small, name, *columns):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, small).select(*columns).collect()]


def test_every_finding_occurs(spark, small):
    from pyspark.sql import functions as F

    from reelspan.functions import rules

    flags = [F.lit(None)] * 5
    known = {name for name, _ in rules.rules(F.lit(""), F.lit(""), *flags[:1], F.array().cast("array<string>"), F.lit(True), F.lit(True))}
    found = {x for (issues,) in values(spark, small, "led_issues", "issues") for x in issues.split("; ")}
    assert known <= found and "" in found and len(known) == 19


def test_every_flag_and_step_occurs(spark, small):
    assert {(a, b) for a, b in values(spark, small, "led_facts", "pronoun_dependent", "unlock_method")} >= {(False, False), (True, True), (True, False)}
    steps = set(values(spark, small, "led_ladder", "source", "cacheable"))
    assert {("model", True), ("repair", True), ("fallback", True), ("fallback", False)} <= steps


def test_every_scope_level_cut_and_outcome_occurs(spark, small):
    assert {s for (s,) in values(spark, small, "whole_scopes", "scope")} >= {"medium_range_one_or_more_clips", "short_range_best_moment"}  # the third from sf0.01 on
    assert {a for (a,) in values(spark, small, "silent_streams", "audible")} == {True, False}
    assert {c for (c,) in values(spark, small, "channel_budget", "cut")} == {True, False}
    assert len({o for (o,) in values(spark, small, "batch_outcomes", "outcome")}) > 1  # all four from sf0.01 on
