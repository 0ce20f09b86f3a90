"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Han characters, as a class that Java and RE2 read alike.
HAN = "[一-鿿]"


def token_estimate(text: Column) -> Column:
    """Han characters + 1.3 for each Latin word + a sixth of the length, cut to an integer."""
    han, latin = F.regexp_count(text, F.lit(HAN)), F.regexp_count(text, F.lit("[a-zA-Z]+"))
    return (han + latin * F.lit(1.3) + F.floor(F.length(text) / 6)).cast("int")


def chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters; a text no longer than that, the empty one included, is one piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def overlapping_chunks(text: Column, size: int = 1000, overlap: int = 200, look: int = 100) -> Column:
    """Pieces of about ``size`` characters, each starting ``overlap`` before the end of the one before.

    A piece ends at the last line break within its last ``look`` characters, if there is one. Pieces are trimmed, blank
    ones dropped; a text no longer than ``size`` is one piece, or none if it is blank.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    n = F.length(text)
    none = F.array().cast("array<string>")

    def step(acc: Column, _: Column) -> Column:
        start = acc["start"]
        full = start + size
        low = F.greatest(full - look, start)
        # the place (from 0) of the last line break in [low, full)
        tail = F.substring(text, low + 1, full - low)
        last = low + F.length(tail) - F.instr(F.reverse(tail), "\n")
        end = F.when((full < n) & F.contains(tail, F.lit("\n")) & (last > start), last).otherwise(full)
        piece = F.btrim(F.substring(text, start + 1, end - start), F.lit(" \t\n\r\x0b\x0c"))
        after = end - overlap
        after = F.when(after <= end - size, end).otherwise(after)
        grown = F.struct(F.when(piece != "", F.concat(acc["pieces"], F.array(piece))).otherwise(acc["pieces"]).alias("pieces"), F.greatest(after, start + 1).cast("int").alias("start"))
        return F.when(start >= n, acc).otherwise(grown)

    # a piece moves on by size - look - overlap characters at least, or by one
    most = F.ceil(n / F.lit(max(1, size - look - overlap))).cast("int") + 1
    whole = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    many = F.aggregate(F.sequence(F.lit(1), most), F.struct(none.alias("pieces"), F.lit(0).alias("start")), step, lambda acc: acc["pieces"])
    return F.when(n <= size, F.when(whole == "", none).otherwise(F.array(text))).otherwise(many)


#: What a read-only statement must not hold, as whole words in either case.
WRITES = [("CREATE", r"\bCREATE\b"), ("MERGE", r"\bMERGE\b"), ("DELETE", r"\bDELETE\b"), ("DETACH DELETE", r"\bDETACH\s+DELETE\b"), ("SET", r"\bSET\b"), ("REMOVE", r"\bREMOVE\b"), ("DROP", r"\bDROP\b"), ("LOAD CSV", r"\bLOAD\s+CSV\b"), ("CALL db.*", r"\bCALL\s+db\b"), ("CALL apoc.*", r"\bCALL\s+apoc\b")]


def write_operation(statement: Column) -> Column:
    """The first write operation that a statement holds, or null if it only reads."""
    return F.coalesce(*[F.when(statement.rlike(f"(?i){pattern}"), name) for name, pattern in WRITES])


def clean(text: Column) -> Column:
    """At most one empty line, single blanks, no white space at the ends."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def shortened(text: Column, most: int = 4000, keep: int = 3500, mark: str = "\n...[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(keep)), F.lit(mark))).otherwise(text)


def json_block(text: Column) -> Column:
    """The JSON in a model's answer: a fenced block, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))


def json_array(text: Column, schema: str) -> Column:
    """An array read from JSON text, also where it was cut off inside its last object."""
    body = F.regexp_extract(text, r"(?s)\[.*", 0)
    whole = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    cut = F.concat(F.regexp_extract(body, r"(?s)^(.*\})[^}]*$", 1), F.lit("]"))
    opts = {"mode": "PERMISSIVE"}
    return F.coalesce(F.from_json(F.nullif(whole, F.lit("")), schema, opts), F.from_json(cut, schema, opts))


def judged_score(text: Column) -> Column:
    """``"score": n`` of a judge's answer on a scale of ten, from 0 to 1; null without one."""
    return F.try_divide(F.regexp_extract(text, r'"score"\s*:\s*([0-9]+(?:\.[0-9]+)?)', 1).try_cast("double"), F.lit(10.0))


def citation_numbers(answer: Column) -> Column:
    """The distinct n of ``[Pn]`` in order of first mention; a number too long for an integer is the greatest one."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[P([0-9]+)\]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(2**31 - 1))))


def keywords(text: Column) -> Column:
    """Words of two or more characters that are not all digits."""
    found = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", " "), " ")
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))


def search_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of ASCII letters and digits, and single Han characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]+|{HAN}"), F.lit(0))


def converted(value: Column, kind: str) -> Column:
    """A text value as string, integer, float or boolean; blank or unreadable is null. Integers are cut to zero."""
    value = F.nullif(F.trim(value.cast("string")), F.lit(""))
    if kind in ("int", "integer"):
        return value.try_cast("double").try_cast("int")
    if kind == "float":
        return value.try_cast("double")
    if kind in ("bool", "boolean"):
        return F.lower(value).isin("true", "1", "yes")
    return value


def safe_name(name: Column) -> Column:
    """A file name without characters that paths or headers give a meaning to."""
    return F.regexp_replace(name, r'[\\/:*?"<>|\s]+', "_")
