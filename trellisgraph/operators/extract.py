"""Rule-based extraction of entities and relations from texts, the confidence funnel, and label cleaning.

Patterns run as ``regexp_extract_all``, one call a group, zipped by match number, in the JVM. Models (NER,
language models) plug in as functions from a DataFrame of texts to rows of the same shape.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.functions.text import json_block
from trellisgraph.lineage import stored

# Fixed values: (type, pattern, {group name: number}); groups are numbered, as Java names allow no underscore.
ENTITY_PATTERNS = [
    ("Robot", r"(?P<name>[A-Z][\w\-]+\s+[\w\-]+(?:机器人)?)\s*(?:是|为|是一款|是一台|是一型)\s*(?P<axes>\d+)\s*轴"),
    ("Robot", r"(?P<name>[A-Z][\w\-]+\s*[\w\-]*)\s*(?:负载|额定负载|有效负载)[：:]?\s*(?P<payload>[\d.]+)\s*kg"),
    ("Robot", r"(?P<name>[A-Z][\w\-]+\s*[\w\-]*)\s*(?:臂展|最大臂展|工作半径|reach)[：:]?\s*(?P<reach>[\d.]+)\s*mm"),
    ("Manufacturer", r"(?P<name>FANUC|ABB|KUKA|安川|Yaskawa|川崎|Kawasaki|爱普生|Epson|史陶比尔|Stäubli|柯马|Comau|那智不二越|Nachi|优傲|Universal Robots|UR|埃斯顿|Estun|汇川|新松)"),
    ("Manufacturer", r"(?P<name>[一-鿿]+(?:公司|集团|股份|有限))\s*(?:推出|发布|研制|生产|制造)"),
    ("Reducer", r"(?P<name>RV[\-]?\d+[A-Z]*)\s*(?:减速器|RV减速器)"),
    ("Reducer", r"(?P<name>谐波减速器|SHG[\-]?\d+[A-Z]*)"),
    ("Reducer", r"(?P<reducer_type>RV减速器|谐波减速器|行星减速器)\s*(?:型号|规格)[：:]?\s*(?P<name>[\w\-]+)"),
    ("ServoMotor", r"(?P<name>[\w\-]+(?:伺服电机|伺服马达))"),
    ("ServoMotor", r"(?:伺服电机|伺服马达)\s*(?:型号|规格)[：:]?\s*(?P<name>[\w\-]+)"),
    ("Controller", r"(?P<name>R[\-]?\d+[a-zA-Z]*\s*(?:Plus|iB|Mate)?)\s*(?:控制器|控制系统)"),
    ("Controller", r"(?:控制器|控制系统)\s*(?:型号)[：:]?\s*(?P<name>[\w\-]+)"),
    ("ApplicationScenario", r"(?:应用于|用于|适用|广泛应用于)\s*(?P<name>[一-鿿]+(?:焊接|搬运|装配|喷涂|打磨|抛光|码垛|切割|检测|包装|上下料))"),
    ("Process", r"(?P<name>点焊|弧焊|激光焊|螺柱焊|涂胶|喷涂|搬运|码垛|装配|打磨|抛光|切割|冲压|注塑|机加工|检测|包装)"),
    ("EndEffector", r"(?P<name>[一-鿿]*(?:焊枪|夹爪|吸盘|喷枪|打磨头|切割头|夹具|抓手))"),
    ("EndEffector", r"(?:末端执行器|末端工具|末端夹具)\s*(?:型号|类型)[：:]?\s*(?P<name>[\w\-]+)"),
    ("Sensor", r"(?P<name>[一-鿿]*(?:力矩传感器|力传感器|视觉传感器|碰撞传感器|位置传感器|安全传感器|2D视觉|3D视觉))"),
    ("Sensor", r"(?P<sensor_type>力矩|力|视觉|碰撞|位置|安全)\s*传感器\s*(?:型号)[：:]?\s*(?P<name>[\w\-]+)"),
    ("Standard", r"(?P<name>(?:ISO|GB|IEC|EN|DIN|JIS)\s*[\d\-\.]+(?:[一-鿿\w]*))"),
]
# Fixed values: (relation type, source type, target type, pattern).
RELATION_PATTERNS = [
    ("manufactures", "Manufacturer", "Robot", r"(?P<source_name>FANUC|ABB|KUKA|安川|Yaskawa|川崎|爱普生|埃斯顿|汇川|新松|[一-鿿]+(?:公司|集团))\s*(?:推出|发布|生产|制造|研制)\s*(?:了?\s*)?(?P<target_name>[\w\-]+(?:机器人)?)"),
    ("uses_reducer", "Robot", "Reducer", r"(?P<source_name>[\w\-]+(?:机器人)?)\s*(?:采用|使用|配备|搭载)\s*(?P<target_name>[\w\-]*(?:RV|谐波)?减速器[\w\-]*)"),
    ("uses_servo", "Robot", "ServoMotor", r"(?P<source_name>[\w\-]+(?:机器人)?)\s*(?:采用|使用|配备|搭载)\s*(?P<target_name>[\w\-]*(?:伺服电机|伺服马达))"),
    ("uses_controller", "Robot", "Controller", r"(?P<source_name>[\w\-]+(?:机器人)?)\s*(?:搭配|配合|使用|配备)\s*(?P<target_name>[\w\-]*(?:控制器|控制系统))"),
    ("applied_in", "Robot", "ApplicationScenario", r"(?P<source_name>[\w\-]+(?:机器人)?)\s*(?:应用于|用于|适用|广泛应用于)\s*(?P<target_name>[一-鿿]+(?:焊接|搬运|装配|喷涂|打磨|检测|包装|上下料))"),
    ("uses_sensor", "Robot", "Sensor", r"(?P<source_name>[\w\-]+(?:机器人)?)\s*(?:配备|搭载|集成)\s*(?P<target_name>[一-鿿]*(?:传感器|视觉))"),
    ("uses_end_effector", "Robot", "EndEffector", r"(?P<source_name>[\w\-]+(?:机器人)?)\s*(?:配备|搭配|使用)\s*(?P<target_name>[一-鿿]*(?:焊枪|夹爪|吸盘|喷枪|打磨头|切割头|夹具|抓手))"),
    ("complies_with", "Robot", "Standard", r"(?P<source_name>[\w\-]+(?:机器人)?)\s*(?:符合|满足|通过|获得)\s*(?P<target_name>(?:ISO|GB|IEC|EN|DIN|JIS)\s*[\d\-\.]+(?:[一-鿿\w]*))"),
]
NUMBERS = {"axes": "int", "payload": "double", "reach": "double"}


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python pattern with named groups as a Java one with numbered groups, Unicode classes, case aside."""
    names, first = re.compile(pattern).groupindex, first_letters(pattern)
    # places where no alternative starts are passed over by one look at a set
    ahead = f"(?=[{''.join(sorted(first))}])" if first and all(x.isalnum() for x in first) else ""
    return "(?iuU)" + ahead + re.sub(r"\(\?P<\w+>", "(", pattern), dict(names)


def _parts(items, best: Callable) -> object:
    """What ``best`` makes of the parts of a parsed pattern: (literal text, None) or (None, list of parsed alternatives)."""
    out, run = [], ""
    for op, arg in items:
        if op is _parser.LITERAL:
            run += chr(arg)
            continue
        out, run = out + ([(run, None)] if run else []), ""
        if op is _parser.SUBPATTERN:
            out.append((None, [arg[3]]))
        elif op is _parser.BRANCH:
            out.append((None, arg[1]))
        elif op is _parser.IN:
            out.append((None, [[x] for x in arg]))
        elif op is _parser.MAX_REPEAT:
            out.append((None, [arg[2]]) if arg[0] else (None, None))
        else:
            out.append((None, None))
    return best(out + ([(run, None)] if run else []))


def needed(pattern: str) -> list[set[str]]:
    """Sets of texts; every match of a pattern, in lower case, holds one of each set.

    Only Han characters and Latin letters count that have no third form in another case (as i, k and s have).
    """

    def best(parts) -> list[set[str]]:
        found = []
        for literal, choices in parts:
            if literal is not None:
                found += [{x} for x in re.findall("[一-鿿]+|[a-hjl-rt-z]{2,}", literal.lower())]
            elif choices and len(choices) == 1:
                found += _parts(choices[0], best)
            elif choices:
                each = [max(_parts(c, best), key=lambda x: min(map(len, x)), default=None) for c in choices]
                found += [set().union(*each)] if all(each) else []
        return found

    return _parts(_parser.parse(pattern), best)


def first_letters(pattern: str) -> set[str] | None:
    """The characters that a match of a pattern can start with, in either case, or None if they are not listed in it."""

    def best(parts) -> set[str] | None:
        literal, choices = parts[0] if parts else (None, None)
        if literal is not None:
            return {literal[0]}
        each = [_parts(c, best) for c in choices or []]
        return set().union(*each) if each and all(each) else None

    return _parts(_parser.parse(pattern), best)


def hinted(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, text, han, low): whether a text has Han characters, and its lower case, for ``possible``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(text).rlike("[一-鿿]").alias("han"), F.lower(text).alias("low"))


def possible(pattern: str, han: Column, low: Column) -> Column:
    """False where a text (see ``hinted``) lacks what a pattern needs."""

    def one(x: set[str]) -> Column:
        held = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in sorted(x)])
        return han & held if all("一" <= c <= "鿿" for w in x for c in w) else held

    return reduce(Column.__and__, map(one, needed(pattern)), F.lit(True))


def matches(text: Column, pattern: str, han: Column | None = None, low: Column | None = None) -> Column:
    """array<struct> of all matches, a string field for each named group. With ``han`` and ``low`` (see ``hinted``) texts
    that cannot match are passed over."""
    java, groups = java_pattern(pattern)
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(java), F.lit(i)).alias(name) for name, i in groups.items()])
    if low is None:
        return found
    none = F.array().cast(f"array<struct<{','.join(f'{name}:string' for name in groups)}>>")
    return F.when(text.isNull() | possible(pattern, han, low), found).otherwise(none)


def _entity(kind: str, pattern: str, number: int) -> Callable[[Column, Column], Column]:
    """From a match and its place to an entity struct."""
    _, groups = java_pattern(pattern)

    def value(m: Column, n: str) -> Column:
        v = F.nullif(m[n], F.lit(""))
        return F.coalesce(v.try_cast(NUMBERS[n]).cast("string"), v) if n in NUMBERS else v

    def make(m: Column, at: Column) -> Column:
        pairs = [x for n in groups if n != "name" for x in (F.lit(n), value(m, n))]
        props = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        return F.struct(F.lit(kind).alias("type"), F.trim(m["name"]).alias("name"), props.alias("props"), (F.lit(number * 100000) + at).alias("ord"))

    return make


def _relation(kind: str, src: str, dst: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(kind).alias("type"), F.lit(src).alias("src_type"), F.trim(m["source_name"]).alias("src_name"), F.lit(dst).alias("dst_type"), F.trim(m["target_name"]).alias("dst_name"))


def entities(docs: DataFrame, patterns=ENTITY_PATTERNS, confidence: float = 0.95, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, type, name, props, confidence, ord): one row a (text, type, name); of each property the first match."""
    docs = hinted(docs, id_col, text)
    every = [F.transform(matches(F.col("text"), pattern, F.col("han"), F.col("low")), _entity(kind, pattern, i)) for i, (kind, pattern) in enumerate(patterns)]
    rows = docs.select("doc_id", F.inline(F.concat(*every))).where("name <> ''")
    return merged(rows.withColumn("confidence", F.lit(confidence)), first=True)


def merged(rows: DataFrame, first: bool = True) -> DataFrame:
    """One row a (doc_id, type, name): the highest confidence; of each property the first (or last) value by ord."""
    key = ["doc_id", "type", "name"]
    pick = F.min_by if first else F.max_by
    v = F.col("v").isNotNull()
    # one row a property, one for a name without any: the names are worked out once
    p = rows.select(*key, "ord", "confidence", F.explode_outer("props").alias("k", "v")).groupBy(*key, "k")
    p = p.agg(F.max("confidence").alias("confidence"), F.min("ord").alias("ord"), pick("v", F.when(v, F.col("ord"))).alias("v"))
    props = F.map_from_entries(F.array_sort(F.collect_list(F.when(v, F.struct("k", "v")))))
    return p.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.min("ord").alias("ord"), props.alias("props"))


def relations(docs: DataFrame, patterns=RELATION_PATTERNS, confidence: float = 0.95, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, type, src_type, src_name, dst_type, dst_name, confidence): every match, repeats included."""
    every = [F.transform(matches(F.col(text), p), _relation(kind, a, b)) for kind, a, b, p in patterns]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.concat(*every))).where("src_name <> '' and dst_name <> ''")
    return rows.withColumn("confidence", F.lit(confidence))


def merge_relations(rows: DataFrame) -> DataFrame:
    """The first of each (doc_id, src_name, type, dst_name) by confidence."""
    w = Window.partitionBy("doc_id", "src_name", "type", "dst_name").orderBy(F.desc("confidence"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def funnel(docs: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, floor: float = 0.70, gate: float = 0.7, least: int = 3, tagger: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Entities by rules, then by ``tagger`` (see ``tagged``), merged by type and name with the higher confidence; texts
    with a weak entity or fewer than ``least`` go to ``model``, whose unseen keys are added with at least the floor
    confidence. Each is a function from documents to rows; without them, rules only."""
    found = entities(docs)
    if tagger is not None:
        # properties of rules come first
        more = tagger(docs).withColumn("ord", F.col("ord") + (1 << 40))
        found = merged(found.unionByName(more.select(*found.columns)), first=True).select(*found.columns)
    if model is None:
        return found
    found = stored(found)  # read three times below
    state = found.groupBy("doc_id").agg(F.min("confidence").alias("weak"), F.count("*").alias("n"))
    weak = docs.join(state, "doc_id", "left").where((F.coalesce("n", F.lit(0)) < least) | (F.col("weak") < gate)).drop("weak", "n")
    more = model(weak).join(found.select("doc_id", "type", "name"), ["doc_id", "type", "name"], "left_anti")
    more = more.withColumn("confidence", F.greatest("confidence", F.lit(floor)))
    return found.unionByName(more.select(*found.columns))


def _touching(names: list[str]) -> list[set[int]]:
    """For each of some different names the numbers of those that hold it or that it holds, by one automaton."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, name in enumerate(names):
        made.add_word(name, i)
    made.make_automaton()
    out: list[set[int]] = [set() for _ in names]
    for i, name in enumerate(names):
        for _, j in made.iter(name):
            if j != i:
                out[i].add(j)
                out[j].add(i)
    return out


def _one_of_overlapping(table: pa.Table) -> pa.Table:
    """The rows of one text and type, first-tier rows before others, in order: see ``tagged``."""
    order = np.lexsort((table.column("ord").to_numpy(), table.column("tier").to_numpy()))
    names, sure = table.column("name").to_pylist(), table.column("confidence").to_pylist()
    listed = list(dict.fromkeys(names))
    number = {name: i for i, name in enumerate(listed)}
    near, kept, since = _touching(listed), {}, 0  # kept: name number -> (place, row, confidence)
    for row in order.tolist():
        own, c, since = number[names[row]], sure[row], since + 1
        if own in kept:
            place, old, best = kept[own]
            kept[own] = (place, old, max(best, c))
            continue
        mates = [m for m in near[own] if m in kept] if table.column("tier")[row].as_py() else []
        first = min(mates, key=lambda m: kept[m][0], default=None)
        if first is None:
            kept[own] = (since, row, c)
        elif len(names[row]) > len(listed[first]):
            kept.pop(first)
            kept[own] = (since, row, c)
        else:
            place, old, best = kept[first]
            kept[first] = (place, old, max(best, c))
    rows = table.take(pa.array([r for _, r, _ in kept.values()], pa.int64()))
    return rows.set_column(rows.schema.get_field_index("confidence"), "confidence", pa.array([c for *_, c in kept.values()], pa.float64()))


def tagged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Names found by patterns (``first``) and by a recogniser (``second``), both (doc_id, type, name, props, confidence,
    ord), as one list.

    A name of the second list that is in the first raises its confidence. One that is part of a name kept before it, or
    holds one, of its text and type does not stand beside it: of the two the longer stays, with the higher confidence where
    the one before stays. Order decides among several. The names of one text and type meet in a task; what touches what
    is found by one automaton, so memory follows from the names and not from their pairs.
    """
    columns = ["doc_id", "type", "name", "props", "confidence", "ord"]
    part = lambda df, tier: df.select(*columns[:4], F.col("confidence").cast("double").alias("confidence"), F.col("ord").cast("long").alias("ord"), F.lit(tier).alias("tier"))
    rows = part(first, 0).unionByName(part(second, 1)).where("name <> ''")
    return rows.groupBy("doc_id", "type").applyInArrow(_one_of_overlapping, rows.schema).select(*columns)


def parsed_model_output(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``entities`` and ``relations`` read from a model's JSON answer; unreadable answers give null."""
    schema = "entities array<struct<name:string,type:string,properties:map<string,string>,confidence:double>>, relations array<struct<source:struct<name:string,type:string>,target:struct<name:string,type:string>,relation_type:string,confidence:double>>"
    return rows.withColumn("_p", F.from_json(json_block(F.col(text)), schema)).withColumn("entities", F.col("_p.entities")).withColumn("relations", F.col("_p.relations")).drop("_p")


def co_occurrences(docs: DataFrame, found: DataFrame, verbs: list[str]) -> DataFrame:
    """(doc_id, src_name, dst_name, verb): two entities of one sentence with a verb between them."""
    s = docs.select("doc_id", F.posexplode(F.split("text", r"[。！？.!?\n]+")).alias("sentence_no", "sentence"))
    at = s.join(found.select("doc_id", "name"), "doc_id").withColumn("at", F.expr("locate(name, sentence)")).where(F.col("at") > 0)
    a = at.select("doc_id", "sentence_no", "sentence", F.col("name").alias("src_name"), F.col("at").alias("a"))
    b = at.select("doc_id", "sentence_no", F.col("name").alias("dst_name"), F.col("at").alias("b"))
    pairs = a.join(b, ["doc_id", "sentence_no"]).where("a + length(src_name) <= b")
    between = F.expr("substring(sentence, a + length(src_name), b - a - length(src_name))")
    return pairs.withColumn("verb", F.regexp_extract(between, "|".join(map(re.escape, verbs)), 0)).where("verb <> ''").select("doc_id", "src_name", "dst_name", "verb").distinct()


def longer_of_overlapping(rows: DataFrame) -> DataFrame:
    """Without names that are part of a longer name of the same text and type."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("name").to_pylist()
        listed = list(dict.fromkeys(names))
        inside = {n for n, near in zip(listed, _touching(listed)) if any(len(listed[m]) > len(n) for m in near)}
        return table.filter(pa.array([n not in inside for n in names], pa.bool_()))

    return rows.where("name <> ''").groupBy("doc_id", "type").applyInArrow(run, rows.schema)


# Label cleaning ------------------------------------------------------------------------------------------------

# Names of drawing primitives, of vague materials and of processes that are none.
PRIMITIVES = ["圆", "圆弧", "线段", "多段线", "椭圆", "样条曲线", "点", "图块/组件", "图块", "组件", "标注文字", "尺寸标注", "注释", "中心线", "中心标记", "中心标记符号", "剖面线"]
VAGUE_MATERIALS = ["标准材料", "标准件", "金属", "钢材", "非金属"]
NOISE_PROCESSES = ["中心标记", "中心标记符号", "尺寸信息", "尺寸标注", "标注文字", "注释", "图块", "图层"]
# The word for a threaded hole; words of large components, which contain and are not contained.
THREADED_HOLE = "螺纹孔"
LARGE = ["法兰", "涡轮箱", "底板", "底座", "手臂", "机身"]
# Types and relations of labelled samples, and types that stand for a component.
SAMPLE_RELATIONS = ["manufactures", "uses_reducer", "uses_servo", "uses_controller", "uses_component", "applied_in", "contains", "complies_with", "performs_process", "process_material"]
AS_COMPONENT = ["Part", "Assembly", "零件", "组件", "部件", "法兰", "箱体", "盖板"]


def clean_name(name: Column) -> Column:
    """``6-M14`` is the hole M14, ``4-M`` the hole M4; blanks at the ends go."""
    name = F.regexp_replace(name, r"^(\d+)-M(\d+)$", f"M$2{THREADED_HOLE}")
    name = F.regexp_replace(name, r"^(\d+)-M$", f"M$1{THREADED_HOLE}")
    return F.regexp_replace(name, r"^\s+|\s+$", "")


def clean_entity_names(rows: DataFrame) -> DataFrame:
    """Names normalised; primitives, vague materials, false processes and empty names removed; one row a (sample, name)."""
    rows = rows.withColumn("name", clean_name(F.col("name"))).where("name <> ''")
    noise = F.col("name").isin(PRIMITIVES) | ((F.col("type") == "Material") & F.col("name").isin(VAGUE_MATERIALS)) | ((F.col("type") == "Process") & F.col("name").isin(NOISE_PROCESSES))
    return rows.where(~noise).dropDuplicates(["sample_id", "type", "name"])


def turned(type_: Column, src_type: Column, src: Column, dst_type: Column, dst: Column) -> Column:
    """Whether a relation points the wrong way: a small thing contains a large one, or a process performs a component."""
    small = src.rlike(r"[M\d]") | (F.length(src) <= 6)
    large = dst.rlike("|".join(LARGE))
    return ((type_ == "contains") & small & large) | ((type_ == "performs_process") & (dst_type == "Component") & (src_type == "Process"))


def clean_relations(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Relations between kept names, turned where they point the wrong way, reversed repeats removed."""
    ids = kept.select("sample_id", "name").distinct()
    rows = rows.join(ids.withColumnRenamed("name", "src_name"), ["sample_id", "src_name"], "left_semi").join(ids.withColumnRenamed("name", "dst_name"), ["sample_id", "dst_name"], "left_semi")
    turn = F.coalesce(turned(*[F.col(c) for c in ("type", "src_type", "src_name", "dst_type", "dst_name")]), F.lit(False))
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    rows = rows.select("sample_id", "type", swap("src_type", "dst_type").alias("src_type"), swap("src_name", "dst_name").alias("src_name"), swap("dst_type", "src_type").alias("dst_type"), swap("dst_name", "src_name").alias("dst_name"), "ord")
    w = Window.partitionBy("sample_id", "type", F.least("src_name", "dst_name"), F.greatest("src_name", "dst_name")).orderBy("ord")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def listed_entities(rows: DataFrame, types: list[str]) -> DataFrame:
    """``rows`` with a name and a type of ``types``; types that stand for a component become one, others go."""
    kind = F.when(F.col("type").isin(types), F.col("type")).when(F.col("type").isin(AS_COMPONENT), "Component")
    return rows.withColumn("type", kind).where("type is not null and coalesce(name, '') <> ''")


def listed_relations(rows: DataFrame, entities: DataFrame, types: list[str] = SAMPLE_RELATIONS) -> DataFrame:
    """Relations of ``types`` whose ends are both among the sample's entities."""
    names = entities.select("sample_id", "name").distinct()
    rows = rows.where(F.col("type").isin(types))
    for end in ("src_name", "dst_name"):
        rows = rows.join(names.withColumnRenamed("name", end), ["sample_id", end], "left_semi")
    return rows


def grade(entities_: Column, relations_: Column) -> Column:
    return F.when((entities_ >= 3) & (relations_ >= 2), "good").when(entities_ >= 1, "ok").otherwise("review")
