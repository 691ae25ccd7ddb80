"""What a query asks for, and text and vector formulas, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import dot, l2_norm

#: Norm to which points of the ball are kept.
MAX_NORM = 1.0 - 1e-5

# Words that show which time a query means.
HISTORICAL = ("as of", "back in", "histor", "before", "during", "at that time")
RECENT = ("recent", "lately", "today", "yesterday", "last week", "this month")

# Phrases that show the kind of a query, in order of priority.
QUERY_KINDS = {
    "temporal": ("what changed", "what has changed", "what happened", "since ", "before ", "after ", "between ", "last week", "last month", "last year", "recently", "lately", "over time", "timeline", "history", "update", "updates", "different", "anymore", "still", "no longer", "used to", "originally", "previously", "evolution of", "progression", "changes"),
    "relationship": ("how does", "how do", "relates to", "relate to", "relationship between", "connection between", "connected to", "associated with", "linked to", "works with", "interact with", "interacts with", "knows", "collaborate", "partner"),
    "factual": ("what is", "what's", "who is", "who's", "where is", "when is", "when was", "which is", "how much is", "how many", "what does", "what did", "tell me the", "give me the", "find the", "what are the", "show me the"),
    "absent": ("does", "do we have", "is there", "are there", "any ", "anything about", "anything on", "have any", "has any", "know of", "know about", "aware of", "not sure if", "wondering if", "whether"),
}


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def temporal_intent(text: Column) -> Column:
    """historical, recent or current. A year 20xx as a word of its own means history."""
    low = F.lower(text)
    year = low.rlike(r"(^|[^0-9a-z])20[0-9]{2}([^0-9a-z]|$)")
    return F.when(year | _any(low, HISTORICAL), "historical").when(_any(low, RECENT), "recent").otherwise("current")


def query_type(text: Column) -> Column:
    """struct<kind, confidence>: the first kind with a phrase in the text; half for one phrase, more for further ones."""
    low = F.lower(text)
    scores = {k: F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))) for k, phrases in QUERY_KINDS.items()}
    none = F.struct(F.lit("summary").alias("kind"), F.lit(0.0).alias("confidence"))
    out = none
    for kind, n in reversed(scores.items()):
        out = F.when(n > 0, F.struct(F.lit(kind).alias("kind"), F.round(F.least(F.lit(1.0), 0.5 + 0.15 * (n - 1)), 6).alias("confidence"))).otherwise(out)
    return out


def episode_temporal_score(intent: str, age: Column) -> Column:
    return F.exp(-age / 180) if intent == "historical" else F.exp(-age / 21)


def quantize_int8(vector: Column) -> Column:
    """struct<low, step, codes>: 255 steps between the least and the largest value."""
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    step = F.when(high > low, (high - low) / 255).otherwise(1.0)
    return F.struct(low.alias("low"), step.alias("step"), F.transform(vector, lambda x: F.floor((x.cast("double") - low) / step + 0.5).cast("int")).alias("codes"))


def quantize_binary(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.when(x >= 0, "1").otherwise("0")), "")


def poincare_distance(a: Column, b: Column, c: float = 1.0) -> Column:
    """Distance of two points of the ball with curvature c."""
    gap = F.zip_with(a, b, lambda x, y: x - y)
    rest = (1 - c * dot(a, a)) * (1 - c * dot(b, b))
    return F.acosh(F.greatest(F.lit(1.0), 1 + 2 * c * dot(gap, gap) / F.greatest(rest, F.lit(1e-12)))) / c**0.5


def ball_factor(vector: Column, c: float = 1.0) -> Column:
    """What the exponential map at the origin multiplies a vector by, kept inside the ball. Compute it once a vector, before any lambda."""
    norm = l2_norm(vector) * c**0.5
    return F.when(norm > 0, F.least(F.tanh(norm / 2), F.lit(MAX_NORM * c**0.5)) / norm).otherwise(0.0)


def log_factor(point: Column, c: float = 1.0) -> Column:
    """What the logarithmic map at the origin multiplies a point of the ball by; it undoes ball_factor."""
    norm = l2_norm(point) * c**0.5
    return F.when(norm > 0, 2 * F.atanh(F.least(norm, F.lit(MAX_NORM))) / norm).otherwise(0.0)


def mobius_add(x: Column, y: Column, c: float = 1.0) -> Column:
    """The sum of two points of the ball, before it is clamped (see clamp_factor)."""
    xy, xx, yy = dot(x, y), dot(x, x), dot(y, y)
    below = F.greatest(1 + 2 * c * xy + c * c * xx * yy, F.lit(1e-7))
    return F.zip_with(x, y, lambda a, b: ((1 + 2 * c * xy + c * yy) * a + (1 - c * xx) * b) / below)


def clamp_factor(point: Column) -> Column:
    """What brings a point back into the ball: 1 for those inside."""
    norm = l2_norm(point)
    return F.when(norm >= MAX_NORM, MAX_NORM / norm).otherwise(1.0)


def hierarchy_depth(point: Column) -> Column:
    """How far down a hierarchy a point of the ball stands: its norm."""
    return l2_norm(point)


def clarification_question(entity: Column, label: Column, facts: Column) -> Column:
    """A question about facts (an array) that conflict: two, none, or a numbered list."""
    two = F.format_string("We have conflicting information about %s's %s. Is it \"%s\" or \"%s\"?", entity, label, F.try_element_at(facts, F.lit(1)), F.try_element_at(facts, F.lit(2)))
    none = F.format_string("Can you clarify the current status of %s's %s?", entity, label)
    listed = F.array_join(F.transform(facts, lambda f, i: F.concat((i + 1).cast("string"), F.lit('. "'), f, F.lit('"'))), ", ")
    many = F.format_string("We have %d conflicting facts about %s's %s: %s. Which is current?", F.size(facts), entity, label, listed)
    return F.when(F.size(facts) == 2, two).when(F.size(facts) == 0, none).otherwise(many)


def preview(text: Column, size: int = 200) -> Column:
    """The first characters of a text; an ellipsis stands for the rest."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def strip_tags(html: Column) -> Column:
    """Text of a page: tags go, six entities are read. The ampersand comes last, so nothing is read twice."""
    text = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def doc_title(html: Column) -> Column:
    """What the first title element holds; null without one."""
    found = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(found != "", found)


def first_sentence(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)^(.*?[.!?])(\s|$)", 1)
    return F.when(found != "", found).otherwise(text)
