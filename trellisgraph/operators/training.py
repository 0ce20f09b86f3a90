"""Labelled samples for training extractors: rule and dictionary spans, specification tables, export, counts and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisgraph.graph import Graph
from trellisgraph.operators.extract import hinted, java_pattern, matches, possible

# Fixed values: (type, pattern) of the regular expressions that find names before a model does.
NAME_PATTERNS = [
    ("Manufacturer", r"(?P<name>FANUC|ABB|KUKA|安川|Yaskawa|川崎|Kawasaki|爱普生|Epson|史陶比尔|Stäubli|柯马|Comau|那智不二越|Nachi|优傲|Universal\s*Robots|UR|埃斯顿|Estun|汇川|新松|发那科)"),
    ("Manufacturer", r"(?P<name>[一-鿿]{2,4}(?:公司|集团|股份|有限|机器人|智能|科技|机电|自动化|精密|机械|电气|电机|传动|控制|技术|装备|重工))"),
    ("Robot", r"(?P<name>[A-Z]{2,8}\s*[\w\-\+\.]+(?:机器人)?)\s*(?:是|为|是一款|是一台|是一型)"),
    ("Robot", r"(?P<name>[A-Z]{2,8}\s*[\w\-\+\.]+)\s*(?:负载|额定负载|有效负载|臂展|重复定位)"),
    ("Reducer", r"(?P<name>(?:RV|SHG|CSG|諧波|谐波|行星|摆线)[\-\d]*[A-Za-z]*(?:\s*(?:减速器|减速机))?)"),
    ("Reducer", r"(?P<name>(?:RV|SHG|CSG)[\-\d]+[A-Za-z]*)"),
    ("ServoMotor", r"(?P<name>[\w\-]+(?:伺服电机|伺服马达))"),
    ("ServoMotor", r"(?:伺服电机|伺服马达)\s*(?:型号|规格)[：:]?\s*(?P<name>[\w\-]+)"),
    ("Controller", r"(?P<name>R[\-\d]+[A-Za-z]*(?:\s*(?:控制器|控制系统|Plus|iB|Mate))?)"),
    ("Sensor", r"(?P<name>[一-鿿]{1,4}(?:力矩|力|视觉|碰撞|位置|安全|激光|超声波|红外|扭矩|温度|压力)传感器)"),
    ("EndEffector", r"(?P<name>[一-鿿]{1,4}(?:焊枪|夹爪|吸盘|喷枪|打磨头|切割头|夹具|抓手))"),
    ("ApplicationScenario", r"(?P<name>[一-鿿]{2,4}(?:焊接|搬运|装配|喷涂|打磨|抛光|码垛|切割|检测|包装|上下料|分拣|涂胶|冲压|注塑))"),
    ("Process", r"(?P<name>点焊|弧焊|激光焊|螺柱焊|涂胶|喷涂|搬运|码垛|装配|打磨|抛光|切割|冲压|注塑|机加工|检测|包装)"),
    ("Standard", r"(?P<name>(?:ISO|GB|IEC|EN|DIN|JIS)\s*[\d\-\.]+(?:\s*(?:标准|规范))?)"),
    ("Material", r"(?P<name>铝合金|不锈钢|碳钢|钛合金|铜合金|铸铁|铸钢|工程塑料|复合材料|陶瓷)"),
]
# Fixed values: (type, property, pattern, kind) of specification tables.
SPEC_PATTERNS = [
    ("Robot", "payload", r"负载[：:]?\s*([\d.]+)\s*kg", "double"),
    ("Robot", "reach", r"臂展[：:]?\s*([\d.]+)\s*mm", "double"),
    ("Robot", "repeatability", r"重复定位精度[：:]?\s*[±+]?\s*([\d.]+)\s*mm", "double"),
    ("Robot", "axes", r"(\d+)\s*轴", "int"),
    ("Robot", "weight", r"重量[：:]?\s*([\d.]+)\s*kg", "double"),
    ("Robot", "protection_class", r"防护等级[：:]?\s*(IP\d+)", "string"),
    ("Reducer", "reduction_ratio", r"减速比[：:]?\s*([\d:]+)", "string"),
    ("Reducer", "rated_torque", r"额定扭矩[：:]?\s*([\d.]+)\s*N·?m", "double"),
    ("Reducer", "backlash", r"回程间隙[：:]?\s*([\d.]+)\s*arcmin", "double"),
    ("ServoMotor", "rated_power", r"额定功率[：:]?\s*([\d.]+)\s*kW", "double"),
    ("ServoMotor", "rated_torque", r"额定扭矩[：:]?\s*([\d.]+)\s*N·?m", "double"),
    ("ServoMotor", "rated_speed", r"额定转速[：:]?\s*([\d.]+)\s*r/min", "double"),
]
# Entity types and the labels of their spans.
LABELS = {
    "Robot": "ROBOT", "Manufacturer": "MANUF", "Component": "COMP", "Reducer": "REDUCER", "ServoMotor": "SERVO", "Controller": "CTRL",
    "Sensor": "SENSOR", "ApplicationScenario": "APP", "Process": "PROC", "EndEffector": "EFFECTOR", "Standard": "STANDARD",
    "Material": "MATERIAL", "Software": "SOFTWARE", "Drawing": "DRAWING", "Part": "PART", "Assembly": "ASSY", "Dimension": "DIM", "CADLayer": "LAYER",
}
_SPANS = "array<struct<start:int,end:int,label:string>>"


def label(type_: Column) -> Column:
    """The span label of an entity type, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), type_)


def _named(text: Column, kind: str, pattern: str, number: int, han: Column, low: Column) -> Column:
    """array<struct<ord, start, name, type>> of a pattern's names, start from 0; ord says which pattern and match.

    A name starts after the gaps and matches before it and what its own match has in front of the name.
    """
    head = pattern.index("(?P<name>")
    java, groups = java_pattern(f"({pattern[:head]})" + pattern[head:] if head else pattern)
    get = lambda g: F.regexp_extract_all(text, F.lit(java), F.lit(g))
    rows = F.arrays_zip(F.split(text, java, -1).alias("gap"), get(0).alias("all"), (get(1) if head else F.transform(get(0), lambda x: F.lit(""))).alias("front"), get(groups["name"]).alias("name"))
    placed = F.aggregate(
        F.filter(rows, lambda m: m["all"].isNotNull()),
        F.struct(F.array().cast("array<struct<ord:int,start:int,name:string,type:string>>").alias("out"), F.lit(0).alias("at")),
        lambda acc, m: F.struct(
            F.concat(acc["out"], F.array(F.struct((F.size(acc["out"]) + number * 1000000).alias("ord"), (acc["at"] + F.length(m["gap"]) + F.length(m["front"])).alias("start"), m["name"].alias("name"), F.lit(kind).alias("type")))).alias("out"),
            (acc["at"] + F.length(m["gap"]) + F.length(m["all"])).alias("at"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(possible(pattern, han, low) & text.rlike(java), placed).otherwise(F.array().cast("array<struct<ord:int,start:int,name:string,type:string>>"))


def _names(text: Column, patterns, han: Column, low: Column) -> Column:
    return F.filter(F.concat(*[_named(text, kind, p, i, han, low) for i, (kind, p) in enumerate(patterns)]), lambda m: F.length(F.trim(m["name"])) >= 2)


def prefiltered(docs: DataFrame, patterns=NAME_PATTERNS, confidence: float = 0.90, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, type, name, confidence, ord): one row a (text, type, name) of two characters or more, in either case."""
    docs = hinted(docs, id_col, text)
    found = lambda kind, p, n: F.transform(matches(F.col("text"), p, F.col("han"), F.col("low")), lambda m, i: F.struct(F.lit(kind).alias("type"), m["name"].alias("name"), (i + n * 1000000).alias("ord")))
    rows = docs.select("doc_id", F.inline(F.concat(*[found(kind, p, n) for n, (kind, p) in enumerate(patterns)]))).where(F.length(F.trim("name")) >= 2)
    rows = rows.select("doc_id", "type", F.trim("name").alias("name"), "ord").groupBy("doc_id", "type", "name").agg(F.min("ord").alias("ord"))
    return rows.select("doc_id", "type", "name", F.lit(confidence).alias("confidence"), "ord")


def spec_tables(docs: DataFrame, patterns=SPEC_PATTERNS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, type, props): for each type the first match of each of its properties; types without any are left out."""
    kinds: dict[str, list] = {}
    for kind, prop, pattern, how in patterns:
        found = F.nullif(F.regexp_extract(F.col(text), pattern, 1), F.lit(""))
        kinds.setdefault(kind, []).extend([F.lit(prop), found if how == "string" else found.try_cast(how).cast("string")])
    rows = [F.struct(F.lit(kind).alias("type"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("props")) for kind, pairs in kinds.items()]
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(*rows))).where("size(props) > 0")


def _apart(candidates: Column) -> Column:
    """Of (start, end, label) in order those that overlap none taken before."""
    return F.aggregate(candidates, F.array().cast(_SPANS), lambda kept, c: F.when(F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(c))))


def dictionary_spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, text, spans) of texts (text_id, text) in which names (text_id, ord, name, type) occur.

    Every place of every name counts, in the order of ``ord`` and of places; a place that overlaps one taken before does
    not. Names under two characters and types without a label are left out, as are texts without spans.
    """
    rows = names.withColumn("label", label(F.col("type"))).where("length(name) >= 2 and label is not null").join(texts, "text_id")
    n = F.length("name")
    places = F.when(F.length("text") >= n, F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda p: F.when(F.substring("text", p, n) == F.col("name"), p - 1)), lambda p: p.isNotNull()))
    each = rows.where(F.contains("text", F.col("name"))).select("text_id", "text", "ord", "label", n.alias("n"), F.explode(places).alias("start"))
    found = each.groupBy("text_id", "text").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "n", "label"))).alias("c"))
    spans = _apart(F.transform("c", lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["n"]).alias("end"), c["label"].alias("label"))))
    return found.select("text_id", "text", spans.alias("spans"))


def pattern_spans(docs: DataFrame, patterns=NAME_PATTERNS, least: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, line, text, spans) of every trimmed line of ``least`` characters or more in which a pattern finds a name."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("text", F.btrim("text", F.lit(" \t\r\x0b\x0c"))).where(F.length("text") >= least)
    lines = lines.withColumn("han", F.col("text").rlike("[一-鿿]")).withColumn("low", F.lower("text"))
    found = F.filter(_names(F.col("text"), patterns, F.col("han"), F.col("low")), lambda m: label(m["type"]).isNotNull())
    spans = _apart(F.transform(F.array_sort(found), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["name"])).alias("end"), label(m["type"]).alias("label"))))
    # a filter on the spans would work them out a second time
    return lines.select("doc_id", "line", "text", F.explode(F.filter(F.array(spans), lambda s: F.size(s) > 0)).alias("spans"))


def training_set(*sources: DataFrame) -> DataFrame:
    """(text, spans) of all sources (text, spans), the first of each text with the same labels."""
    every = None
    for n, source in enumerate(sources):
        rows = source.select("text", "spans", F.lit(n).alias("_n"))
        every = rows if every is None else every.unionByName(rows)
    labels = F.array_join(F.array_sort(F.col("spans")["label"]), ",")
    return every.groupBy("text", labels.alias("_l")).agg(F.min_by("spans", "_n").alias("spans")).select("text", "spans")


def from_templates(names: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(text, spans): every name (name, type) put for ``{}`` in the templates (type, text) of its type."""
    spark = names.sparkSession
    known = F.broadcast(spark.createDataFrame(templates, "type string, template string"))  # a literal list
    rows = names.where("length(name) >= 2").join(known, "type")
    at = F.instr("template", "{}") - 1
    span = F.struct(at.alias("start"), (at + F.length("name")).cast("int").alias("end"), label(F.col("type")).alias("label"))
    return rows.where(at >= 0).select(F.replace("template", F.lit("{}"), F.col("name")).alias("text"), F.array(span).cast(_SPANS).alias("spans"))


def label_counts(samples: DataFrame) -> DataFrame:
    """(label, n) over the spans of all samples."""
    return samples.select(F.explode("spans").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def split(rows: DataFrame, key: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with ``part``, train or test: shuffled by a hash of the key, the same on every run, wherever rows lie."""
    share = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn("part", F.when(share < test, "test").otherwise("train"))


def exported(g: Graph, files: int = 20, instruction: str = "") -> DataFrame:
    """(file, instruction, input, output): for each of the first ``files`` files its entities and relations as JSON."""
    own = g.nodes.where(F.coalesce(F.col("props")["file"], F.lit("")) != "").select("node_id", F.col("props")["file"].alias("file"), "name", F.col("label").alias("type"))
    first = own.select("file").distinct().orderBy("file").limit(files)
    own = own.join(F.broadcast(first), "file")  # at most ``files`` rows
    entities = own.groupBy("file").agg(F.array_sort(F.collect_set(F.struct("name", "type"))).alias("entities"))
    end = lambda p: own.select(F.col("node_id").alias(p), "file", F.struct("name", "type").alias("source" if p == "src" else "target"))
    e = g.edges.select("src", "dst", F.col("type").alias("relation_type")).join(end("src"), "src").join(end("dst"), ["dst", "file"])
    relations = e.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("source", "target", "relation_type"))).alias("relations"))
    rows = entities.join(relations, "file", "left")
    none = F.array().cast("array<struct<source:struct<name:string,type:string>,target:struct<name:string,type:string>,relation_type:string>>")
    return rows.select("file", F.lit(instruction).alias("instruction"), F.concat(F.lit("Entities of the file "), "file").alias("input"), F.to_json(F.struct("entities", F.coalesce("relations", none).alias("relations"))).alias("output"))


def prompt_rows(samples: DataFrame) -> DataFrame:
    """prompt, query, response, system, history of samples (instruction, input, output): one turn each, no system text."""
    return samples.select(F.col("instruction").alias("prompt"), F.col("input").alias("query"), F.col("output").alias("response"), F.lit("").alias("system"), F.array().cast("array<array<string>>").alias("history"))


def concatenated(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, those of ``first`` before the others by (part, ord); nothing is dropped."""
    return first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)), allowMissingColumns=True)
