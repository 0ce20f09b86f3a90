"""Table functions for SQL: extractors and mappings that a statement calls laterally, a row's results as rows.

``register`` names them in a session. Each has a DataFrame form (``training.dictionary_spans``, ``training.prefiltered``,
``mapping.to_entities``) that gives the same rows without Python; these are for statements.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trellisgraph.operators.training import LABELS, NAME_PATTERNS
from trellisgraph.sources.mapping import RULES, matching_rule


def _get(row, name):
    return row[name] if row is not None else None


@F.udtf(returnType="place int, start int, end int, label string")
class DictionarySpans:
    """The spans of names (array of structs ord, name, type) in a text, in the order they are taken.

    Every place of every name counts, by ``ord`` and place; one that overlaps a span taken before does not. Null texts and
    names, names under two characters and types without a label give nothing.
    """

    def eval(self, text, names):
        if not text or not names:
            return
        taken: list[tuple[int, int]] = []
        for row in sorted((x for x in names if _get(x, "name")), key=lambda x: _get(x, "ord")):
            name, label = _get(row, "name"), LABELS.get(_get(row, "type"))
            if len(name) < 2 or label is None:
                continue
            start = text.find(name)
            while start >= 0:
                end = start + len(name)
                if all(end <= a or b <= start for a, b in taken):
                    yield len(taken), start, end, label
                    taken.append((start, end))
                start = text.find(name, start + 1)


@F.udtf(returnType="ord int, start int, name string, type string")
class PatternNames:
    """The names that the patterns for names find in a text, of two characters or more, with their place from 0."""

    def __init__(self):
        self.patterns = [(kind, re.compile(p, re.IGNORECASE)) for kind, p in NAME_PATTERNS]

    def eval(self, text):
        n = 0
        for kind, pattern in self.patterns if text else ():
            for found in pattern.finditer(text):
                if len(found["name"].strip()) >= 2:
                    yield n, found.start("name"), found["name"].strip(), kind
                    n += 1


def _value(raw: str | None, kind: str) -> str | None:
    """As ``text.converted`` says, written as text; null where there is no value."""
    raw = (raw or "").strip(" ")
    if not raw:
        return None
    if kind in ("bool", "boolean"):
        return str(raw.lower() in ("true", "1", "yes")).lower()
    if kind not in ("int", "integer", "float"):
        return raw
    try:
        number = float(raw)
    except ValueError:
        return None
    if kind == "float":
        return repr(number)
    return str(int(number)) if abs(number) < 2**31 else None


def mapped_entities(rules=RULES):
    """A table function of (file, row as a map of texts): type, name, props of the entity that the file's rule makes."""

    @F.udtf(returnType="type string, name string, props map<string,string>")
    class MappedEntities:
        def __init__(self):
            self.known = {}

        def eval(self, file, row):
            if not file or not row:
                return
            if file not in self.known:
                self.known[file] = matching_rule(file, rules)
            rule = self.known[file]
            if rule is None or rule.src or not row.get(rule.key):
                return
            props = {target: _value(row[c], kind) for c, (target, kind) in rule.columns.items() if c in row}
            yield rule.type, row[rule.key], {k: v for k, v in props.items() if v is not None}

    return MappedEntities


def register(spark: SparkSession, rules=RULES) -> None:
    """Names ``dictionary_spans``, ``pattern_names`` and ``mapped_entities`` in the session."""
    spark.udtf.register("dictionary_spans", DictionarySpans)
    spark.udtf.register("pattern_names", PatternNames)
    spark.udtf.register("mapped_entities", mapped_entities(rules))
