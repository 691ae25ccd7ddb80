"""Normalised names and types, and what model output holds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of entity types.
ENTITY_TYPES = {"org": "organization", "company": "organization", "place": "location", "idea": "concept", "topic": "concept"}
# Classifications in their order.
CLASSIFICATIONS = ("public", "internal", "confidential", "restricted")
# Beginnings of MIME types by kind of attachment.
MIME_TYPES = (
    ("image", ("image/",)), ("audio", ("audio/",)), ("video", ("video/",)),
    ("document", ("application/pdf", "application/vnd.openxmlformats", "application/vnd.ms-", "application/msword", "text/")),
)
_BLANK = " \t\n\x0b\f\r"


def _trim(text: Column) -> Column:
    return F.call_function("btrim", text, F.lit(_BLANK))


def entity_type_norm(name: Column) -> Column:
    """The type's own name, in lower case; types that aren't known are kept as they are named."""
    low = F.lower(name)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])[low], low)


def classification_norm(name: Column) -> Column:
    """0 to 3; what is missing or not known is internal."""
    place = F.array_position(F.array(*map(F.lit, CLASSIFICATIONS)), F.lower(_trim(name)))
    return F.when(place > 0, place - 1).otherwise(1).cast("int")


def mime_to_type(mime: Column) -> Column:
    """The kind of an attachment; null for other types."""
    low, out = F.lower(mime), F.lit(None).cast("string")
    for kind, starts in reversed(MIME_TYPES):
        fits = F.lit(False)
        for start in starts:
            fits |= low.startswith(start)
        out = F.when(fits, kind).otherwise(out)
    return out


def _unfenced(text: Column) -> Column:
    """What a fenced block holds; other text as it is."""
    inner = F.regexp_replace(F.regexp_replace(text, r"^(?:```json)*(?:```)*", ""), r"(?:```)*$", "")
    return F.when(text.startswith("```"), _trim(inner)).otherwise(text)


def parse_digest(raw: Column) -> Column:
    """struct<summary, topics>: of JSON, fenced or not; else of a text with a TOPICS: list at its end; else the text itself. Six topics at most."""
    text = _trim(raw)
    parsed = F.from_json(_unfenced(text), "summary string, topics array<string>")

    def six(topics: Column) -> Column:
        return F.slice(F.filter(F.transform(topics, _trim), lambda t: t != ""), 1, 6)

    none = F.array().cast("array<string>")
    at = F.instr(raw, "TOPICS:")
    listed = F.struct(_trim(F.substring(raw, F.lit(1), at - 1)).alias("summary"), six(F.split(_trim(F.substring(raw, at + 7, F.length(raw))), ",")).alias("topics"))
    plain = F.when(at > 0, listed).otherwise(F.struct(text.alias("summary"), none.alias("topics")))
    summary = _trim(parsed["summary"])
    return F.when(summary != "", F.struct(summary.alias("summary"), F.coalesce(six(parsed["topics"]), none).alias("topics"))).otherwise(plain)


_NARRATIVE = "narrative_text string, chapters array<struct<title:string,content:string>>"


def parse_narrative(raw: Column) -> Column:
    """struct<narrative_text, chapters>: of JSON, a fenced block, or the outermost braces; else the text without chapters. Null for a blank text."""
    text = _trim(raw)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    found = [F.from_json(c, _NARRATIVE) for c in (raw, _unfenced(text), braces)]
    none = F.array().cast("array<struct<title:string,content:string>>")
    plain = F.when(text != "", F.struct(text.alias("narrative_text"), none.alias("chapters")))
    out = plain
    for one in reversed(found):
        out = F.when(one["narrative_text"].isNotNull(), F.struct(one["narrative_text"].alias("narrative_text"), F.coalesce(one["chapters"], none).alias("chapters"))).otherwise(out)
    return out
