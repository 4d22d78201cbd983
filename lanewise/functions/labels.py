"""Names, tags, ids and display forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAFFIC = ("bicycle", "bus", "car", "motorcycle", "truck")
#: Tags of rare contexts, words of titles that speak against and for road traffic (regular expressions, between word boundaries, in any case).
RARE_TAGS = ("PERSON_MOTORCYCLE", "PERSON_BICYCLE", "PERSON_BUS", "PERSON_TRUCK", "PERSON_MULTI_TRAFFIC")
OTHER_TITLE = (
    "race", "racing", "rally", "motorsport", "motor ?show", "car ?show", "auto ?show", "museum", "showroom", "stunt", "freestyle", "velodrome", "drag", "miniature", "toy", "exhibition",
    "championship", "autocross", "motocross", "speedway", "track day", "concept car", "classic car", "bike restoration", "air show",
)
TRAFFIC_TITLE = (
    "street", "traffic", "road", "city", "urban", "intersection", "bus station", "bus stop", "taxi", "market", "scooter", "police", "parking", "commute", "highway", "airport", "crosswalk", "downtown",
    "transit",
)


def title_pattern(words: tuple[str, ...]) -> str:
    return rf"(?i)\b({'|'.join(words)})\b"


def rare_tags(tags: Column) -> Column:
    """The rare ones, sorted, of tags joined by ``;``."""
    return F.array_sort(F.array_intersect(F.split(F.coalesce(tags, F.lit("")), ";"), F.array(*map(F.lit, RARE_TAGS))))


def map_class(column: Column, mapping: dict[str, str], strict: bool = False) -> Column:
    """Application class of a source class; null, or an error when strict, if it isn't mapped."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), column)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("missing application taxonomy mapping for "), column))) if strict else found


def sequence_group(name: Column) -> Column:
    """The part of a file name before its first underscore; a name without one is a group of its own."""
    return F.split_part(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(1))


def first_token(path: Column, tokens: dict[str, tuple[str, ...]], default: str = "unknown") -> Column:
    """The first name one of whose tokens the path contains, ignoring case."""
    low, out = F.lower(path), None
    for name, words in tokens.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def format_clock(seconds: Column) -> Column:
    """HH:MM:SS.ss, without hours below one hour; a dash for null, negative or non-finite."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds / 60) % 60
    rest = seconds - F.floor(seconds / 60) * 60
    text = F.when(hours > 0, F.format_string("%02d:%02d:%05.2f", hours, minutes, rest)).otherwise(F.format_string("%02d:%05.2f", minutes, rest))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf")), "—").otherwise(text)


def candidate_id(scene: Column, frame: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.trim(scene)), "[^a-z0-9]+", "_")
    return F.format_string("%s_frame_%06d", clean, frame)


def context_tags(classes: Column) -> Column:
    """PERSON_X for each traffic class seen with a person, PERSON_MULTI_TRAFFIC for several, PERSON_ONLY for none."""
    traffic = F.array_sort(F.array_intersect(classes, F.array(*map(F.lit, TRAFFIC))))
    tags = F.concat(
        F.transform(traffic, lambda c: F.concat(F.lit("PERSON_"), F.upper(c))),
        F.when(F.size(traffic) > 1, F.array(F.lit("PERSON_MULTI_TRAFFIC"))).when(F.size(traffic) == 0, F.array(F.lit("PERSON_ONLY"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.array_contains(classes, "person"), tags).otherwise(F.array().cast("array<string>"))


def license_status(original: Column, landing: Column, license_url: Column, profile: Column, author: Column) -> Column:
    """REQUIRES_REVIEW or REJECTED by an image's license metadata."""
    missing = F.lit(False)
    for c in (original, landing, license_url, profile, author):
        missing = missing | (F.trim(F.coalesce(c, F.lit(""))) == "")
    url = F.lower(F.rtrim(license_url, F.lit("/")))
    return F.when(missing, "REQUIRES_REVIEW").when(url.startswith("https://creativecommons.org/licenses/"), "REQUIRES_REVIEW").otherwise("REJECTED")


def event_label(kind: Column) -> Column:
    """LINE_CROSSING as Line crossing."""
    low = F.lower(F.replace(kind, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1000))


def event_interpretation(status: Column) -> Column:
    return F.when(status == "CONFIRMED", "Observed by the rule").when(status == "CANDIDATE", "Candidate for review").when(status == "REVIEW_REQUIRED", "Needs manual review").otherwise("Unknown status")
