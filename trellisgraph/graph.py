"""The property graph as two DataFrames, and its ontology as three small ones."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "node_id string, label string, labels array<string>, name string, domain string, props map<string,string>, source string, confidence double, valid_from string, valid_to string, embedding array<float>, ord bigint"
EDGE_SCHEMA = "edge_id string, src string, dst string, type string, domain string, props map<string,string>, source string, confidence double, valid_from string, valid_to string, inferred boolean, ord bigint"

# Entity types with their properties; "!" marks required ones, the type is string unless given.
ENTITY_TYPES = {
    "Robot": "name!,model,axes:integer,payload:float,reach:float,repeatability:float,weight:float,protection_class,application_type,description",
    "Manufacturer": "name!,country,founded_year:integer,headquarters,website,description",
    "Component": "name!,category,specification,description",
    "Reducer": "name!,reducer_type,reduction_ratio,rated_torque:float,backlash:float,weight:float,description",
    "ServoMotor": "name!,rated_power:float,rated_torque:float,rated_speed:float,encoder_resolution:integer,description",
    "Controller": "name!,control_axes:integer,programming_language,communication_protocol,description",
    "Sensor": "name!,sensor_type,measurement_range,accuracy,description",
    "ApplicationScenario": "name!,industry,description",
    "Process": "name!,process_type,requirements,description",
    "EndEffector": "name!,effector_type,weight:float,description",
    "Standard": "name!,standard_type,version,release_date,description",
    "Material": "name!,material_type,properties,description",
    "Software": "name!,software_type,version,description",
    "Drawing": "name!,drawing_type,file_format,version,author,page_count:integer,description",
    "Part": "name!,part_number,material,weight:float,quantity:integer,description",
    "Assembly": "name!,assembly_type,level:integer,description",
    "Dimension": "name!,dimension_type,value:float,unit,tolerance_upper:float,tolerance_lower:float,description",
    "CADLayer": "name!,entity_count:integer,layer_color,line_type,description",
}
# Relation types with their end labels.
RELATION_TYPES = {
    "manufactures": ("Manufacturer", "Robot"),
    "supplies_component": ("Manufacturer", "Component"),
    "uses_component": ("Robot", "Component"),
    "uses_reducer": ("Robot", "Reducer"),
    "uses_servo": ("Robot", "ServoMotor"),
    "uses_controller": ("Robot", "Controller"),
    "uses_sensor": ("Robot", "Sensor"),
    "uses_end_effector": ("Robot", "EndEffector"),
    "applied_in": ("Robot", "ApplicationScenario"),
    "performs_process": ("Robot", "Process"),
    "process_requires": ("Process", "EndEffector"),
    "process_material": ("Process", "Material"),
    "scenario_includes": ("ApplicationScenario", "Process"),
    "complies_with": ("Robot", "Standard"),
    "uses_software": ("Robot", "Software"),
    "component_compatible": ("Component", "Component"),
    "contains": ("Component", "Component"),
    "competitor_of": ("Manufacturer", "Manufacturer"),
    "subsidiary_of": ("Manufacturer", "Manufacturer"),
    "drawing_defines": ("Drawing", "Part"),
    "drawing_defines_assembly": ("Drawing", "Assembly"),
    "assembly_contains_part": ("Assembly", "Part"),
    "assembly_contains_sub": ("Assembly", "Assembly"),
    "part_has_dimension": ("Part", "Dimension"),
    "drawing_has_layer": ("Drawing", "CADLayer"),
    "part_made_of": ("Part", "Material"),
    "robot_has_part": ("Robot", "Part"),
}
# Inference rules.
SUBCLASS_OF = {"ServoMotor": "Component", "Reducer": "Component", "Controller": "Component", "Sensor": "Component", "EndEffector": "Component", "Drawing": "Entity", "Part": "Entity", "Assembly": "Entity", "Dimension": "Entity", "CADLayer": "Entity"}
TRANSITIVE = ["contains", "assembly_contains_sub", "subsidiary_of"]
SYMMETRIC = ["competitor_of", "component_compatible"]
INVERSE = {"manufactures": "manufactured_by", "assembly_contains_part": "part_of_assembly"}


@dataclass
class Ontology:
    """Entity types (name -> property text), relation types (name -> ends) and inference rules."""

    entity_types: dict[str, str] = field(default_factory=lambda: dict(ENTITY_TYPES))
    relation_types: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(RELATION_TYPES))
    subclass_of: dict[str, str] = field(default_factory=lambda: dict(SUBCLASS_OF))
    transitive: list[str] = field(default_factory=lambda: list(TRANSITIVE))
    symmetric: list[str] = field(default_factory=lambda: list(SYMMETRIC))
    inverse: dict[str, str] = field(default_factory=lambda: dict(INVERSE))

    @classmethod
    def from_dict(cls, data: dict) -> Ontology:
        """From the mapping that an ontology file holds."""
        kinds = {}
        for name, spec in (data.get("entity_types") or {}).items():
            props = (spec.get("properties") or {}).items()
            kinds[name] = ",".join(p + ("" if v.get("type", "string") == "string" else f":{v['type']}") + ("!" if v.get("required") else "") for p, v in props)
        ends = {k: (v["source"], v["target"]) for k, v in (data.get("relation_types") or {}).items()}
        rules = data.get("semantics") or {}
        return cls(kinds, ends, dict(rules.get("subclass_of") or {}), list(rules.get("transitive_relations") or []), list(rules.get("symmetric_relations") or []), {a: b for a, b in rules.get("inverse_pairs") or []})

    @classmethod
    def from_yaml(cls, text: str) -> Ontology:
        import yaml

        return cls.from_dict(yaml.safe_load(text))

    def entities(self, spark: SparkSession) -> DataFrame:
        """(label, prop, kind, required, ord): one row a property."""
        rows = []
        for label, text in self.entity_types.items():
            for i, p in enumerate(x for x in text.split(",") if x):
                name, _, kind = p.replace("!", "").partition(":")
                rows.append((label, name, kind or "string", "!" in p, i))
        return spark.createDataFrame(rows, "label string, prop string, kind string, required boolean, ord int")

    def relations(self, spark: SparkSession) -> DataFrame:
        """(type, src_label, dst_label), at most a few hundred rows."""
        return spark.createDataFrame([(k, a, b) for k, (a, b) in self.relation_types.items()], "type string, src_label string, dst_label string")

    def rules(self, spark: SparkSession) -> DataFrame:
        """(family, type, other, src_label, dst_label)."""
        end = lambda t: self.relation_types.get(t, (None, None))
        rows = [("symmetric", t, t, *end(t)) for t in self.symmetric] + [("transitive", t, t, *end(t)) for t in self.transitive] + [("inverse", t, o, *end(t)) for t, o in self.inverse.items()] + [("subclass", c, p, None, None) for c, p in self.subclass_of.items()]
        return spark.createDataFrame(rows, "family string, type string, other string, src_label string, dst_label string")

    def prompt_context(self) -> str:
        """The ontology as lines of text for a prompt."""
        kinds = [f"{k}: {', '.join(p.replace('!', '') for p in v.split(','))}" for k, v in self.entity_types.items()]
        ends = [f"{k}: {a} -> {b}" for k, (a, b) in self.relation_types.items()]
        return "\n".join(["Entity types:", *kinds, "Relation types:", *ends])


@dataclass
class Graph:
    """Nodes, edges and what they may be."""

    nodes: DataFrame
    edges: DataFrame
    ontology: Ontology = field(default_factory=Ontology)

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    def both_ways(self) -> DataFrame:
        """Edges seen from either end: edge_id, type, a, b, direction (a self-loop once, as ``out``)."""
        out = self.edges.select("edge_id", "type", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("out").alias("direction"))
        back = self.edges.where("src <> dst").select("edge_id", "type", F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("in").alias("direction"))
        return out.unionAll(back)


def nodes_from(df: DataFrame) -> DataFrame:
    """``df`` with every column of NODE_SCHEMA, nulls where it has none."""
    return _filled(df, NODE_SCHEMA)


def edges_from(df: DataFrame) -> DataFrame:
    return _filled(df, EDGE_SCHEMA)


def _filled(df: DataFrame, schema: str) -> DataFrame:
    wanted = [c.strip().split(" ", 1) for c in _split(schema)]
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted])


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def sample(spark: SparkSession) -> Graph:
    """The literal sample graph: 11 nodes and 8 edges."""
    # Fixed values.
    nodes = [
        ("Manufacturer", "FANUC", {"country": "日本", "founded_year": "1956"}),
        ("Manufacturer", "ABB", {"country": "瑞士", "founded_year": "1988"}),
        ("Manufacturer", "KUKA", {"country": "德国"}),
        ("Manufacturer", "安川电机", {"country": "日本"}),
        ("Robot", "FANUC M-20iA", {"axes": "6", "payload": "20", "reach": "1853", "repeatability": "0.02"}),
        ("Robot", "ABB IRB 6700", {"axes": "6", "payload": "200", "reach": "2650", "repeatability": "0.05"}),
        ("Reducer", "RV-40E", {}),
        ("ServoMotor", "αiF 8/4000", {}),
        ("ApplicationScenario", "汽车白车身焊接", {}),
        ("Process", "点焊", {}),
        ("EndEffector", "伺服焊枪", {}),
    ]
    label = {n: k for k, n, _ in nodes}
    edges = [
        ("manufactures", "FANUC", "FANUC M-20iA"),
        ("manufactures", "ABB", "ABB IRB 6700"),
        ("uses_reducer", "FANUC M-20iA", "RV-40E"),
        ("uses_servo", "FANUC M-20iA", "αiF 8/4000"),
        ("applied_in", "ABB IRB 6700", "汽车白车身焊接"),
        ("performs_process", "ABB IRB 6700", "点焊"),
        ("process_requires", "点焊", "伺服焊枪"),
        ("competitor_of", "FANUC", "ABB"),
    ]
    key = lambda n: f"{label[n]}::{n}"
    a = spark.createDataFrame([(key(n), k, [k], n, "industrial_robot", p, i) for i, (k, n, p) in enumerate(nodes)], "node_id string, label string, labels array<string>, name string, domain string, props map<string,string>, ord bigint")
    b = spark.createDataFrame([(f"{t}|{key(s)}|{key(d)}", key(s), key(d), t, "industrial_robot", i) for i, (t, s, d) in enumerate(edges)], "edge_id string, src string, dst string, type string, domain string, ord bigint")
    return Graph(nodes_from(a), edges_from(b))
