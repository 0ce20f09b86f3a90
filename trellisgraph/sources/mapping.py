"""Structured rows to entities and relations by column mappings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisgraph.functions.text import converted


@dataclass
class Rule:
    """columns: source column -> (target, kind). An entity rule has ``key``; a relation rule has both ends."""

    pattern: str
    type: str
    columns: dict[str, tuple[str, str]] = field(default_factory=dict)
    key: str = "name"
    src: tuple[str, str] | None = None  # (label, column)
    dst: tuple[str, str] | None = None


# Mappings of the known files.
RULES = [
    Rule(r"robots.*\.csv", "Robot", {"name": ("name", "string"), "model": ("model", "string"), "axes": ("axes", "int"), "payload_kg": ("payload", "float"), "reach_mm": ("reach", "float"), "repeatability_mm": ("repeatability", "float"), "weight_kg": ("weight", "float"), "protection_class": ("protection_class", "string"), "application_type": ("application_type", "string"), "description": ("description", "string")}),
    Rule(r"manufacturers.*\.csv", "Manufacturer", {"name": ("name", "string"), "country": ("country", "string"), "founded_year": ("founded_year", "int"), "headquarters": ("headquarters", "string"), "website": ("website", "string"), "description": ("description", "string")}),
    Rule(r"components.*\.csv", "Component", {"name": ("name", "string"), "category": ("category", "string"), "specification": ("specification", "string"), "description": ("description", "string")}),
    Rule(r"robot_components.*\.csv", "uses_component", {"quantity": ("quantity", "int"), "position": ("position", "string")}, src=("Robot", "robot_name"), dst=("Component", "component_name")),
]


def matching_rule(filename: str, rules: list[Rule] = RULES, first_match: bool = False) -> Rule | None:
    """The rule for a file. Patterns are anchored at the name's start; first_match searches anywhere, in order."""
    name = filename.replace("\\", "/").rsplit("/", 1)[-1]
    return next((r for r in rules if (re.search if first_match else re.match)(r.pattern, name)), None)


def props(df: DataFrame, columns: dict[str, tuple[str, str]]) -> Column:
    """Mapped and converted columns as a map without nulls; columns that ``df`` lacks are left out."""
    have = [(t, converted(F.col(c), k).cast("string")) for c, (t, k) in columns.items() if c in df.columns]
    if not have:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*[x for t, v in have for x in (F.lit(t), v)]), lambda k, v: v.isNotNull())


def to_entities(df: DataFrame, rule: Rule, confidence: float = 1.0) -> DataFrame:
    """(type, name, props, confidence) of the rows whose key is not empty."""
    key = F.col(rule.key).cast("string")
    return df.where(key.isNotNull() & (key != "")).select(F.lit(rule.type).alias("type"), key.alias("name"), props(df, rule.columns).alias("props"), F.lit(confidence).alias("confidence"))


def to_relations(df: DataFrame, rule: Rule, confidence: float = 1.0) -> DataFrame:
    """(type, src_type, src_name, dst_type, dst_name, props, confidence) of the rows with both keys."""
    a, b = F.col(rule.src[1]).cast("string"), F.col(rule.dst[1]).cast("string")
    rows = df.where(a.isNotNull() & (a != "") & b.isNotNull() & (b != ""))
    return rows.select(F.lit(rule.type).alias("type"), F.lit(rule.src[0]).alias("src_type"), a.alias("src_name"), F.lit(rule.dst[0]).alias("dst_type"), b.alias("dst_name"), props(df, rule.columns).alias("props"), F.lit(confidence).alias("confidence"))
