"""Categorical vocabularies and ordinal encoders (E2-E10) as Column expressions.

All lookups are small fixed tables, so they are written as CASE chains that
stay inside whole-stage codegen instead of joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's vocabularies for equal results).
# ---------------------------------------------------------------------------
EXPERIENCE_LEVELS = ["noExperience", "between1And3", "between3And6", "moreThan6"]
EMPLOYMENT_LEVELS = ["full", "part", "project", "probation", "volunteer"]
SCHEDULE_LEVELS = ["fullDay", "shift", "remote", "flexible", "flyInFlyOut"]

# Experience rank used by the recommenders; anything else (null too) -> 1
EXPERIENCE_ORDINAL = {"moreThan6": 4, "between3And6": 3, "between1And3": 2}
# Employment rank; anything else -> 1
EMPLOYMENT_ORDINAL = {"full": 5, "part": 4, "project": 3, "probation": 2}
# Schedule rank; anything else -> 1
SCHEDULE_ORDINAL = {"fullDay": 5, "shift": 4, "remote": 3, "flexible": 2}
# E5: codes used to build clustering features; unknown -> null
CLUSTER_EXPERIENCE = {"noExperience": 0, "between3And6": 1, "between1And3": 2, "moreThan6": 3}
CLUSTER_SCHEDULE = {"fullDay": 0, "flyInFlyOut": 1, "flexible": 2, "shift": 3, "remote": 4}
CLUSTER_EMPLOYMENT = {"full": 4, "part": 3, "project": 2, "probation": 1, "volunteer": 0}
# Experience index for the similarity metrics
METRIC_EXPERIENCE = {"noExperience": 0, "between1And3": 1, "between3And6": 2, "moreThan6": 3}
# Numeric codes of the second job board
BOARD_EMPLOYMENT = {6: "full", 10: "part", 13: "part", 12: "full", 9: "full", 7: "project"}
BOARD_EMPLOYMENT_DEFAULT = "full"
BOARD_SCHEDULE = {6: "fullDay", 7: "fullDay", 10: "flexible", 13: "flexible", 12: "shift", 9: "flyInFlyOut"}
BOARD_SCHEDULE_DEFAULT = "fullDay"
BOARD_REMOTE_PLACE = 2
BOARD_EXPERIENCE = {1: "noExperience", 2: "between1And3", 3: "between3And6", 4: "moreThan6"}
BOARD_EXPERIENCE_DEFAULT = "noExperience"
# Resume wording -> vocabulary
RESUME_EMPLOYMENT = {
    "полная занятость": "full",
    "неполный день": "part",
    "частичная занятость": "part",
    "стажировка": "probation",
    "проектная работа": "project",
    "волонтерство": "volunteer",
}
RESUME_SCHEDULE = {
    "вахтовый метод": "flyInFlyOut",
    "удаленная работа": "remote",
    "гибкий график": "flexible",
    "сменный график": "shift",
    "полный день": "fullDay",
}
# action types of the interaction log
ACTION_RESPONSE, ACTION_VIEW, ACTION_FAVOURITE = 1, 2, 3
# ---------------------------------------------------------------------------


def lookup(c: Column | str, mapping: Mapping, default=None) -> Column:
    """CASE chain over a small fixed mapping; ``default`` for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for k, v in mapping.items():
        out = (F.when(c == F.lit(k), F.lit(v)) if out is None
               else out.when(c == F.lit(k), F.lit(v)))
    return out.otherwise(F.lit(default)) if default is not None else out


def experience_ordinal(c) -> Column:
    return lookup(c, EXPERIENCE_ORDINAL, 1)


def employment_ordinal(c) -> Column:
    return lookup(c, EMPLOYMENT_ORDINAL, 1)


def schedule_ordinal(c) -> Column:
    return lookup(c, SCHEDULE_ORDINAL, 1)


def cluster_codes(experience, schedule, employment) -> list[Column]:
    """E5: the three clustering codes; unknown categories give null (Q33)."""
    return [lookup(experience, CLUSTER_EXPERIENCE).alias("experience_code"),
            lookup(schedule, CLUSTER_SCHEDULE).alias("schedule_code"),
            lookup(employment, CLUSTER_EMPLOYMENT).alias("employment_code")]


def metric_experience(c) -> Column:
    return lookup(c, METRIC_EXPERIENCE)


def board_employment(code) -> Column:
    return lookup(code, BOARD_EMPLOYMENT, BOARD_EMPLOYMENT_DEFAULT)


def board_schedule(schedule_code, place_code) -> Column:
    place = F.col(place_code) if isinstance(place_code, str) else place_code
    return F.when(place == BOARD_REMOTE_PLACE, F.lit("remote")).otherwise(
        lookup(schedule_code, BOARD_SCHEDULE, BOARD_SCHEDULE_DEFAULT))


def board_experience(code) -> Column:
    return lookup(code, BOARD_EXPERIENCE, BOARD_EXPERIENCE_DEFAULT)


def map_multi(text, mapping: Mapping) -> Column:
    """Split on ', ', map every piece, drop unmapped pieces (order kept)."""
    text = F.col(text) if isinstance(text, str) else text
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    mapped = F.transform(F.split(text, ", "), lambda s: F.try_element_at(m, s))
    return F.filter(mapped, lambda x: x.isNotNull())


def experience_from_years(years) -> Column:
    """< 1, < 3, < 6, else."""
    y = F.col(years) if isinstance(years, str) else years
    return (F.when(y < 1, "noExperience").when(y < 3, "between1And3")
            .when(y < 6, "between3And6").otherwise("moreThan6"))


def experience_from_months(months) -> Column:
    """Whole years rounded up; null months stay null."""
    m = F.col(months) if isinstance(months, str) else months

    def cat(v):
        y = F.ceil(v / 12.0)
        return (F.when(v.isNull(), F.lit(None)).when(y == 0, "noExperience")
                .when(y < 3, "between1And3").when(y < 6, "between3And6").otherwise("moreThan6"))

    # bound once: ``months`` may be a large expression
    return F.element_at(F.transform(F.array(m), cat), 1)
