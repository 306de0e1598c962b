"""Lexicon scores and rule-based classes, as column expressions over lower-cased or raw text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrove.functions import text as T
from quillgrove.functions.lexicon import any_of, count_of, lowered


def capped_relevance(text: Column, words: Iterable[str]) -> Column:
    """Different words present over three, at most 1."""
    return F.least(count_of(lowered(text), words) / F.lit(3.0), F.lit(1.0))


def weighted(text: Column, terms: Sequence[tuple[str, float]], digits: int | None = None) -> Column:
    """Weights of the terms present over all weights, at most 1."""
    low = lowered(text)
    total = F.lit(0.0)
    for term, w in terms:
        total = total + F.when(low.contains(term), F.lit(float(w))).otherwise(F.lit(0.0))
    score = F.least(total / F.lit(float(sum(w for _, w in terms))), F.lit(1.0))
    return score if digits is None else F.round(score, digits)


def tier(text: Column, high: Iterable[str], low: Iterable[str]) -> Column:
    t = lowered(text)
    return F.when(any_of(t, high), F.lit(0.8)).when(any_of(t, low), F.lit(0.3)).otherwise(F.lit(0.0))


def ladder(text: Column, rules: Sequence[tuple[str, Sequence[Sequence[str]]]], default: str) -> Column:
    """The first class of which every group of words has a hit."""
    low = lowered(text)
    out = None
    for label, groups in rules:
        ok = F.lit(True)
        for g in groups:
            ok = ok & any_of(low, g)
        out = F.when(ok, label) if out is None else out.when(ok, label)
    return out.otherwise(default)


CHUNK_TYPES = (
    ("methods", [["approach", "design", "method", "procedure"]]),
    ("results", [["data", "finding", "outcome", "result"]]),
    ("background", [["background", "rationale", "significance"]]),
    ("aims", [["aim", "goal", "objective", "purpose"]]),
    ("innovation", [["advance", "innovative", "novel", "unique"]]),
)
DOCUMENT_TYPES = (
    ("nih_grant", [["grant", "nih", "r01", "r21", "r34"]]),
    ("rfp", [["request for proposal", "rfp", "solicitation"]]),
    ("research_abstract", [["abstract", "background", "summary"]]),
    ("study_protocol", [["clinical", "protocol", "trial"]]),
)
STUDY_TYPES = (
    ("RCT", [["randomized controlled trial", "rct"]]),
    ("stepped_wedge", [["stepped-wedge"]]),
    ("cluster_RCT", [["cluster randomized"]]),
    ("pragmatic_trial", [["pragmatic"], ["trial"]]),
    ("implementation_science", [["implementation"], ["science"]]),
    ("qualitative", [["qualitative"]]),
    ("mixed_methods", [["mixed method"]]),
    ("observational", [["observational"]]),
)
TRANSITIONS = ("additionally", "conversely", "furthermore", "however", "therefore")
INCOMPLETE = ("e.g.", "i.e.", "etc.", "...", "•", "- ")
PRONOUNS = ("it", "they", "this", "that", "these", "those", "he", "she")
STOPWORDS = ("a", "an", "and", "at", "but", "by", "for", "in", "of", "on", "or", "the", "to", "with")


def coherence(text: Column, transitions: Iterable[str] = TRANSITIONS) -> Column:
    """0.5 for fewer than two sentences, 0.4 with one under five words, else 0.7 or 0.6 with and without a transition."""
    parts = F.filter(F.split(T.some(text), r"\."), lambda s: F.trim(s) != "")
    shortest = F.array_min(F.transform(parts, lambda s: F.size(T.words(s))))
    return F.when(F.size(parts) < 2, 0.5).when(shortest < 5, 0.4).when(any_of(lowered(text), transitions), 0.7).otherwise(0.6)


def completeness(text: Column) -> Column:
    """Mean of how the text ends and whether it has marks of something left out."""
    t = F.regexp_replace(T.some(text), r"^\s+|\s+$", "")
    end = F.when(t.rlike(r"[.!?]$"), 1.0).when(t.endswith(","), 0.5).otherwise(0.3)
    left = F.lit(False)
    for mark in INCOMPLETE:
        left = left | T.some(text).contains(mark)
    return (end + F.when(left, 0.5).otherwise(0.8)) / 2


def semantic(text: Column, transitions: Iterable[str] = TRANSITIONS) -> Column:
    return F.when((F.size(T.sentences(text)) < 2) | ~any_of(lowered(text), transitions), 0.5).otherwise(0.7)


def pronoun_coherence(text: Column, pronouns: Sequence[str] = PRONOUNS) -> Column:
    """Share of sentences with a pronoun; 0.3 for fewer than two sentences."""
    s = T.sentences(text)
    own = F.array(*[F.lit(p) for p in pronouns])
    hits = F.size(F.filter(s, lambda x: F.arrays_overlap(T.words(F.lower(x)), own)))
    return F.when(F.size(s) < 2, F.lit(0.3)).otherwise(hits / F.size(s))


def coverage(query: Column, chunk: Column) -> Column:
    """Share of the query's topics that the chunk has; 0 without topics."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, chunk)) / F.size(query))


def bucket(kind: Column, text: Column) -> Column:
    """The part of a proposal that a chunk belongs to."""
    low = lowered(text)
    return (
        F.when((kind == "methods") | any_of(low, ["approach", "method"]), "methods_approach")
        .when(kind == "background", "background_significance")
        .when((kind == "innovation") | low.contains("innovative"), "innovation")
        .when((kind == "results") | any_of(low, ["outcome", "result"]), "evaluation_outcomes")
        .when(any_of(low, ["implement", "plan", "schedule", "timeline"]), "implementation_plan")
        .when(any_of(low, ["budget", "cost", "funding", "resource"]), "budget_justification")
        .otherwise("methods_approach")
    )


def suggested_section(kind: Column, text: Column) -> Column:
    """The section that a chunk suggests; null for none."""
    low = lowered(text)
    return (
        F.when(kind.isin("methods", "approach"), "Methods and Approach")
        .when(kind == "background", "Background and Significance")
        .when(kind == "innovation", "Innovation")
        .when(kind == "results", "Evaluation and Outcomes")
        .when(low.contains("implementation"), "Implementation Plan")
        .when(low.contains("budget"), "Budget Justification")
    )


def explanation(query: Column, text: Column) -> Column:
    """Up to five shared words, in order, where more than three are shared."""
    both = F.array_sort(F.array_intersect(F.array_distinct(T.words(F.lower(query))), F.array_distinct(T.words(F.lower(text)))))
    return F.when(F.size(both) > 3, F.concat(F.lit("Shared terms: "), F.array_join(F.slice(both, 1, 5), ", "))).otherwise("Semantic similarity to requirement")
