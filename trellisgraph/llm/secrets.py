"""Secret scans through an incremental blob ledger, in DataFrame functions only.

Every text version is addressed by its SHA-256. The ledger is a table that only grows: one row for each (blob, kind,
version of the kind's rule) ever scanned, with what was found, also where that is nothing. A run scans only the pairs
the ledger lacks, each distinct blob once however many paths hold it, and appends them; rows of blobs that the run does
not see stay as they are. Findings of the rules in force are joined back to all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.llm.common import saved, small

#: Kind, version, pattern, group with the secret, least characters of that group.
BASE = [
    ("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24),
]
#: Rules added to the base ones: tokens of three parts, private keys, credentials in addresses.
ADDED = [
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("url", 1, r"[a-z][a-z0-9+.-]*://[^\s/:@]+:([^\s/@]+)@", 1, 6),
]
RULES = BASE + ADDED
LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


def addressed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (all columns of ``docs`` as a struct), text (null as empty) and blob, its content address."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """A ledger row for every blob and kind of ``todo``: leftmost matches that do not overlap, in code points.

    ``blobs`` has blob, text and ``todo``, the kinds to scan. A match's place follows from the lengths of what the
    pattern splits off before it and of the matches before it, summed in order.
    """
    found = []
    for kind, version, pattern, group, least in rules:
        hit = F.col("text").rlike(pattern)
        get = lambda g, p=pattern: F.regexp_extract_all("text", F.lit(p), F.lit(g))
        parts = F.arrays_zip(_lengths(F.split("text", pattern, -1)).alias("gap"), _lengths(get(0)).alias("all"), _lengths(get(group)).alias("core"))
        rule = F.struct(F.lit(kind).alias("kind"), F.lit(version).alias("version"), F.lit(least).alias("least"), F.when(hit, parts).alias("m"))
        found.append(F.when(F.array_contains("todo", kind), rule))
    rows = blobs.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r"))
    rows = rows.select("blob", "r.kind", "r.version", "r.least", F.posexplode_outer("r.m").alias("at", "m")).select("blob", "kind", "version", "least", "at", "m.gap", "m.all", "m.core")
    before = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("all", F.lit(0))).over(before)
    span = F.when(F.col("core") >= F.col("least"), F.struct((F.col("stop") - F.col("all")).cast("int").alias("start"), F.col("stop").cast("int").alias("end")))
    return rows.withColumn("stop", end).groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def unseen(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules=RULES) -> DataFrame:
    """The ledger rows that ``docs`` and ``rules`` call for and ``ledger`` lacks.

    Copies of a text meet by content address after each task has dropped its own, so an address that a third of all paths
    hold costs one text a task.
    """
    blobs = addressed(docs, text_col).groupBy("blob").agg(F.first("text").alias("text"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v, *_ in rules])
    if ledger is None:
        todo = pairs
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("known"))
        blobs = blobs.join(known, "blob", "left")
        todo = F.filter(pairs, lambda p: ~F.coalesce(F.exists("known", lambda k: (k["kind"] == p["kind"]) & (k["version"] == p["version"])), F.lit(False)))
    return scan(blobs.withColumn("todo", F.transform(todo, lambda p: p["kind"])).where(F.size("todo") > 0), rules)


def update(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules=RULES) -> DataFrame:
    """The ledger after a run over ``docs``: what it lacked is scanned and written to the shared folder; nothing goes."""
    new = saved(unseen(docs, ledger, text_col, rules))
    return new if ledger is None else ledger.unionByName(new)


def findings(docs: DataFrame, ledger: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """row (all columns of ``docs`` as a struct), text and spans: (start, kind number from 1, end) in order.

    A null text is empty. Rows whose blob has no finding under the rules in force get an empty array. Only blobs with
    findings join, broadcast while their count allows it; beyond, an address of very many paths is a skewed key
    whose other side has one row, which AQE splits.
    """
    kinds = F.array(*[F.lit(k) for k, *_ in rules])
    force = F.lit(False)
    for k, v, *_ in rules:
        force |= (F.col("kind") == k) & (F.col("version") == v)
    hits = ledger.where(force & (F.size("spans") > 0)).withColumn("number", F.array_position(kinds, F.col("kind")).cast("int"))
    hits = hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("number").alias("kind"), s["end"].alias("end")))))).alias("spans"))
    out = addressed(docs, text_col).join(small(hits, 256), "blob", "left")
    return out.select("row", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("spans"))


def digest(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    rows = findings(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ledger, rules=rules)
    name = F.array(*[F.lit(k) for k, *_ in rules])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"] - 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] <= len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return rows.select("row.doc_id", *[count(i + 1).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def history(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of two runs: first a half of all rows under the base rules, then all rows under all rules.

    The second run scans blobs it has not met under every rule, and known ones under the added rules alone.
    """
    early = docs.where(F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(2)) == 0, F.lit(False)))
    return update(docs, update(early, None, text_col, BASE), text_col, RULES)


def redacted(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; spans that overlap are replaced together.

    Scans what ``ledger`` lacks first. Null texts stay null. Any column names are allowed; repeated rows stay repeated.
    """
    rows = findings(docs, update(docs, ledger, text_col), text_col)
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["text"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("text"), s["end"].alias("at"))).otherwise(F.struct(acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at")))
    done = F.aggregate("spans", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["text"], F.substring("text", acc["at"] + 1, F.length("text"))))
    own = lambda c: F.col("row").getField(c)
    return rows.select(*[(F.when(F.size("spans") > 0, done).otherwise(own(c).cast("string")) if c == text_col else own(c)).alias(c) for c in docs.columns])
