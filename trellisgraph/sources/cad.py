"""CAD files: DXF, STEP and DWG contents as DataFrames, and their mapping to entities and relations.

Files are read as rows (path, text or content). A file's tokens are exploded and everything else is grouping and joining,
so a large drawing is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellisgraph.sources.files import wide_text

# Prefixes of internal annotation blocks.
ANNOTATION_PREFIXES = [
    "SW_CENTERMARK", "SW_NOTE", "SW_SFSYMBOL", "SW_DATUMTAG", "SW_TABLEANN", "SW_CHAMFER", "SW_DIMENSION", "SW_BOM", "SW_VIEWLABEL", "SW_HATCH",
    "SW_BALLOON", "SW_GTOL", "SW_REVISION", "SW_SECTION", "SW_DETAIL", "SW_AUX", "ACAD_", "AECC_", "A$C", "DimensionTick",
]
# Keywords of materials, and of assemblies.
MATERIALS = [
    "钢", "铁", "铝", "铜", "不锈钢", "合金", "铸铁", "STEEL", "ALUMINUM", "ALUMINIUM", "COPPER", "IRON",
    "BRASS", "TITANIUM", "PLASTIC", "NYLON", "RUBBER", "Q235", "45#", "40Cr", "6061", "7075", "SUS304", "SUS316",
]
ASSEMBLY_WORDS = ["asm", "assy", "assembly", "装配", "总成", "subasm", "subassembly"]
# Drawing types, by their inserts and blocks.
DRAWING_TYPES = {"assembly": "装配图", "part": "零件图", "electrical": "电气图"}


def internal_symbol(name: Column) -> Column:
    """Empty, anonymous (``*...``) or annotation blocks."""
    plain = F.trim(name)
    own = F.lit(False)
    for prefix in ANNOTATION_PREFIXES:
        own |= F.startswith(F.upper(plain), F.lit(prefix.upper()))
    return F.coalesce((plain == "") | F.startswith(plain, F.lit("*")) | own, F.lit(True))


def valid_name(name: Column) -> Column:
    return F.coalesce((F.trim(name) != "") & ~F.startswith(name, F.lit("*")) & (name != "_None"), F.lit(False))


def dxf_pairs(files: DataFrame) -> DataFrame:
    """(path, at, code, value): the group codes of ASCII DXF texts, in order."""
    lines = F.split(F.regexp_replace("text", "\r", ""), "\n")
    rows = files.select("path", lines.alias("l")).select("path", F.posexplode(F.expr("if(size(l) >= 2, transform(sequence(0, cast(floor(size(l) / 2) as int) - 1), i -> struct(get(l, 2 * i) as c, get(l, 2 * i + 1) as v)), array())")).alias("at", "p"))
    return rows.select("path", "at", F.trim("p.c").try_cast("int").alias("code"), F.trim("p.v").alias("value"))


def dxf_entities(pairs: DataFrame) -> DataFrame:
    """(path, entity, kind, section, values): one row a DXF entity; values maps code -> first value.

    An entity starts at every code 0; numbering runs inside a file, so a window is as long as one drawing.
    """
    w = Window.partitionBy("path").orderBy("at")
    rows = pairs.withColumn("entity", F.sum(F.when(F.col("code") == 0, 1).otherwise(0)).over(w))
    first = rows.groupBy("path", "entity", "code").agg(F.min_by("value", "at").alias("v"), F.min("at").alias("at"))
    out = first.groupBy("path", "entity").agg(F.max(F.when(F.col("code") == 0, F.col("v"))).alias("kind"), F.map_from_entries(F.collect_list(F.struct("code", "v"))).alias("values"), F.min("at").alias("at"))
    section = F.last(F.when(F.col("kind") == "SECTION", F.col("values")[2]), ignorenulls=True).over(Window.partitionBy("path").orderBy("entity"))
    return out.withColumn("section", section)


def dxf_metadata(files: DataFrame) -> dict[str, DataFrame]:
    """layers, blocks, inserts, texts, dimensions, shapes and extents of DXF texts (path, text)."""
    e = dxf_entities(dxf_pairs(files))
    value = lambda c: F.col("values")[c]
    plain = F.regexp_replace(F.regexp_replace(value(1), r"\\[A-Za-z][^;\\{}]*;", ""), r"[{}]", "")
    named = lambda kind, section: e.where((F.col("kind") == kind) & (F.col("section") == section)).select("path", value(2).alias("name"), "at").where(F.col("name").isNotNull())
    drawn = e.where(F.col("section") == "ENTITIES")
    inserts = drawn.where("kind = 'INSERT'").select("path", value(2).alias("name")).where(~internal_symbol(F.col("name")))
    point = drawn.select("path", value(10).try_cast("double").alias("x"), value(20).try_cast("double").alias("y"))
    return {
        "layers": named("LAYER", "TABLES"),
        "blocks": named("BLOCK", "BLOCKS").where(~internal_symbol(F.col("name"))),
        "inserts": inserts.groupBy("path", "name").agg(F.count("*").alias("n")),
        "texts": drawn.where("kind in ('TEXT', 'MTEXT', 'ATTRIB')").select("path", plain.alias("text"), "at").where("trim(text) <> ''"),
        "dimensions": drawn.where("kind = 'DIMENSION'").select("path", F.coalesce(F.nullif(value(1), F.lit("")), value(42)).alias("text"), "at"),
        "shapes": drawn.groupBy("path", "kind").agg(F.count("*").alias("n")),
        "extents": point.groupBy("path").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y")),
    }


def dxf_summary(meta: dict[str, DataFrame]) -> DataFrame:
    """(path, summary): the first layers, blocks, most used inserts and texts of each drawing as lines."""

    def part(df: DataFrame, title: str, order: list[Column], item: Column, most: int, n: int) -> DataFrame:
        r = F.row_number().over(Window.partitionBy("path").orderBy(*order))
        rows = df.select("path", *[c for c in df.columns if c != "path"]).withColumn("_r", r).where(F.col("_r") <= most)
        rows = rows.groupBy("path").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_r", item.alias("i")))), lambda x: x["i"])).alias("items"))
        return rows.select("path", F.lit(n).alias("n"), F.concat(F.lit(f"{title}: "), F.array_join("items", ", ")).alias("line"))

    name = F.col("name")
    rows = part(meta["layers"], "Layers", [F.col("at")], name, 20, 0)
    rows = rows.unionByName(part(meta["blocks"], "Blocks", [F.col("at")], name, 30, 1))
    rows = rows.unionByName(part(meta["inserts"], "Inserts", [F.desc("n"), name], F.concat(name, F.lit(" x"), F.col("n").cast("string")), 15, 2))
    rows = rows.unionByName(part(meta["texts"], "Texts", [F.col("at")], F.col("text"), 40, 3))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def dimension(text: Column) -> Column:
    """struct(kind, value, unit) of a dimension text: diameter, radius, thread or a plain number with a unit."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    pick = lambda p, g=1: F.regexp_extract(text, p, g).try_cast("double")
    kind = F.when(text.rlike("[Ø⌀φΦ]"), "diameter").when(text.rlike(r"^\s*R\s*[0-9]"), "radius").when(text.rlike(r"^\s*M[0-9]"), "thread").when(text.rlike("[0-9]"), "linear")
    value = F.when(kind == "diameter", pick(rf"[Ø⌀φΦ]\s*{number}")).when(kind == "radius", pick(rf"R\s*{number}")).when(kind == "thread", pick(rf"M{number}")).otherwise(pick(number))
    unit = F.coalesce(F.nullif(F.regexp_extract(text, r"(mm|cm|inch|°|deg|m)\b", 1), F.lit("")), F.lit("mm"))
    return F.struct(kind.alias("kind"), value.alias("value"), unit.alias("unit"))


def assembly_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(ASSEMBLY_WORDS))


def drawing_type(inserts: Column, blocks: Column) -> Column:
    """Of the numbers of inserts and blocks: many are an assembly, none an electrical drawing."""
    return F.when((inserts > 2) | (blocks > 3), DRAWING_TYPES["assembly"]).when(blocks > 0, DRAWING_TYPES["part"]).otherwise(DRAWING_TYPES["electrical"])


def sanitized(name: Column) -> Column:
    """Trimmed, blanks as underscores, slashes as hyphens."""
    return F.replace(F.replace(F.trim(name), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-"))


def dimension_name(text: Column, number: Column) -> Column:
    """The first 40 characters with underscores for blanks, or a numbered name."""
    short = F.replace(F.trim(F.left(text, F.lit(40))), F.lit(" "), F.lit("_"))
    return F.when(F.coalesce(short, F.lit("")) != "", short).otherwise(F.concat(F.lit("dim_"), number.cast("string")))


def inserted_blocks(inserts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, name, n): the blocks of a drawing that it inserts, and how often; anonymous ones (``*...``) are left out."""
    named = inserts.where(~F.startswith("name", F.lit("*"))).groupBy("path", "name").agg(F.count("*").alias("n"))
    return named.join(blocks.select("path", "name").distinct(), ["path", "name"])


def materials(texts: DataFrame) -> DataFrame:
    """(path, material, at): material keywords in a drawing's texts, A-Z in either case, by first place."""
    words = F.array(*[F.lit(m) for m in MATERIALS])
    hits = texts.select("path", "at", F.explode(F.filter(words, lambda m: F.contains(F.upper("text"), F.upper(m)))).alias("material"))
    return hits.groupBy("path", "material").agg(F.min("at").alias("at"))


def dxf_graph(meta: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entities: path, type, name, confidence; relations: path, type, src_type, src_name, dst_type, dst_name)."""
    file = F.regexp_extract("path", r"[^/\\]+$", 0)
    ent = lambda df, kind, name, c: df.select("path", kind.alias("type"), name.alias("name"), F.lit(c).alias("confidence"))
    block = F.when(assembly_name(F.col("name")), "Assembly").otherwise("Part")
    drawings = meta["shapes"].select("path").distinct()
    dims = meta["dimensions"].withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("at"))).where("r <= 50")
    found = materials(meta["texts"])
    ents = ent(drawings, F.lit("Drawing"), file, 0.95).unionByName(ent(meta["layers"], F.lit("CADLayer"), F.col("name"), 0.95)).unionByName(ent(meta["blocks"], block, F.col("name"), 0.9))
    ents = ents.unionByName(ent(dims, F.lit("Dimension"), F.trim("text"), 0.8)).unionByName(ent(found, F.lit("Material"), F.col("material"), 0.6))
    ents = ents.where(valid_name(F.col("name"))).dropDuplicates(["path", "type", "name"])
    first = meta["blocks"].withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("at"))).where("r = 1").select("path", F.col("name").alias("part"))
    rel = lambda df, t, a, an, b, bn: df.select("path", F.lit(t).alias("type"), a.alias("src_type"), an.alias("src_name"), b.alias("dst_type"), bn.alias("dst_name"))
    kind = lambda k: meta["blocks"].where(assembly_name(F.col("name")) if k == "Assembly" else ~assembly_name(F.col("name")))
    rels = rel(meta["layers"], "drawing_has_layer", F.lit("Drawing"), file, F.lit("CADLayer"), F.col("name"))
    rels = rels.unionByName(rel(kind("Part"), "drawing_defines", F.lit("Drawing"), file, F.lit("Part"), F.col("name"))).unionByName(rel(kind("Assembly"), "drawing_defines_assembly", F.lit("Drawing"), file, F.lit("Assembly"), F.col("name")))
    rels = rels.unionByName(rel(dims.join(first, "path"), "part_has_dimension", F.lit("Part"), F.col("part"), F.lit("Dimension"), F.trim("text"))).unionByName(rel(found.join(first, "path"), "part_made_of", F.lit("Part"), F.col("part"), F.lit("Material"), F.col("material")))
    return ents, with_both_ends(rels.distinct(), ents)


def with_both_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose ends are both among the entities of the same file."""
    keys = entities.select("path", "type", "name").distinct()
    for end in ("src", "dst"):
        relations = relations.join(keys.toDF("path", f"{end}_type", f"{end}_name"), ["path", f"{end}_type", f"{end}_name"], "left_semi")
    return relations.select("path", "type", "src_type", "src_name", "dst_type", "dst_name")


def step_metadata(files: DataFrame) -> DataFrame:
    """(path, products, part_numbers, assemblies, measures, box) of STEP texts: arrays read by pattern.

    products and part_numbers are zipped by position by the caller; box has least and greatest coordinates.
    """
    t = F.regexp_replace("text", r"\s*\n\s*", "")
    every = lambda p, g: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    product = r"PRODUCT\s*\(\s*'([^']*)'\s*,\s*'([^']*)'"
    number = r"(-?[0-9.]+(?:E[-+]?[0-9]+)?)"
    point = rf"CARTESIAN_POINT\s*\(\s*'[^']*'\s*,\s*\(\s*{number}\s*,\s*{number}\s*,\s*{number}\s*\)"
    axis = lambda g: F.filter(F.transform(every(point, g), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    measure = rf"(LENGTH_MEASURE|PLANE_ANGLE_MEASURE|MASS_MEASURE|AREA_MEASURE|VOLUME_MEASURE)\s*\(\s*{number}\s*\)"
    box = F.struct(*[f(axis(g)).alias(f"{n}_{a}") for g, a in ((1, "x"), (2, "y"), (3, "z")) for n, f in (("min", F.array_min), ("max", F.array_max))])
    return files.select("path", every(product, 2).alias("products"), every(product, 1).alias("part_numbers"), every(r"NEXT_ASSEMBLY_USAGE_OCCURRENCE\s*\(\s*'([^']*)'", 1).alias("assemblies"), F.arrays_zip(every(measure, 1).alias("kind"), F.transform(every(measure, 2), lambda v: v.try_cast("double")).alias("value")).alias("measures"), box.alias("box"))


def step_products(meta: DataFrame) -> DataFrame:
    """(path, at, product, part_number): products with the number at the same position."""
    a = meta.select("path", F.posexplode("products").alias("at", "product"))
    b = meta.select("path", F.posexplode("part_numbers").alias("at", "part_number"))
    return a.join(b, ["path", "at"], "left").where(valid_name(F.col("product")))


def dwg_strings(files: DataFrame, most: int = 60) -> DataFrame:
    """(path, version, strings): readable runs of DWG bytes, 4 to 80 printable characters with 30 % letters, and Han
    runs of 2 to 30, the first ``most`` distinct ones."""
    raw = F.decode("content", "ISO-8859-1")
    runs = F.filter(F.regexp_extract_all(raw, F.lit(r"[\x20-\x7E]{4,80}"), F.lit(0)), lambda s: F.regexp_count(s, F.lit("[A-Za-z]")) >= 0.3 * F.length(s))
    wide = F.regexp_extract_all(wide_text("content"), F.lit("[一-鿿]{2,30}"), F.lit(0))
    return files.select("path", F.regexp_extract(raw, r"^(AC10\d\d)", 1).alias("version"), F.slice(F.array_distinct(F.concat(runs, wide)), 1, most).alias("strings"))


def step_graph(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities: path, type, name, confidence, props; relations: path, type, src_type, src_name, dst_type, dst_name,
    confidence) of STEP files: a drawing defines its products; assemblies contain their references; the first product is
    made of the drawing's materials; measures become dimensions."""
    stem = sanitized(F.regexp_replace(F.regexp_extract("path", r"[^/\\]+$", 0), r"\.[^.]*$", ""))
    rows = meta.withColumn("drawing", F.when(stem == "", "unnamed").otherwise(stem))
    none = F.create_map().cast("map<string,string>")

    def ent(df, kind, name, confidence, **props):
        m = F.map_filter(F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull()) if props else none
        return df.select("path", F.lit(kind).alias("type"), name.alias("name"), F.lit(confidence).alias("confidence"), m.alias("props"))

    def rel(df, kind, a, an, b, bn, confidence):
        return df.select("path", F.lit(kind).alias("type"), F.lit(a).alias("src_type"), an.alias("src_name"), F.lit(b).alias("dst_type"), bn.alias("dst_name"), F.lit(confidence).alias("confidence"))

    drawing, name = F.col("drawing"), F.col("name")
    products = rows.join(step_products(meta), "path").select("path", "drawing", "at", F.col("product").alias("name"), F.coalesce(F.nullif("part_number", F.lit("")), "product").alias("number"))
    refs = rows.select("path", "drawing", F.explode("assemblies").alias("name")).where("name <> ''")
    found = materials(rows.select("path", F.lit(0).alias("at"), F.array_join("products", " ").alias("text"))).select("path", F.col("material").alias("name"))
    sizes = rows.select("path", F.explode("measures").alias("m")).select("path", F.col("m.kind").alias("name"), F.col("m.value").alias("value"))
    kind = F.when(F.size("assemblies") > 0, DRAWING_TYPES["assembly"]).otherwise(DRAWING_TYPES["part"])
    ents = [
        ent(rows, "Drawing", drawing, 0.95, file_format=F.lit("STEP"), drawing_type=kind),
        ent(products, "Part", name, 0.9, part_number=F.col("number")),
        ent(rows.where(F.size("assemblies") > 0), "Assembly", drawing, 0.9, assembly_type=F.lit("总成"), level=F.lit(0)),
        ent(refs, "Part", name, 0.85, part_number=name),
        ent(found, "Material", name, 0.85),
        ent(sizes, "Dimension", sanitized(name), 0.8, dimension_type=F.lit("linear"), value=F.col("value")),
    ]
    first = products.groupBy("path").agg(F.min_by("name", "at").alias("part"))
    rels = [
        rel(products, "drawing_defines", "Drawing", drawing, "Part", name, 0.9),
        rel(rows.where(F.size("assemblies") > 0), "drawing_defines_assembly", "Drawing", drawing, "Assembly", drawing, 0.9),
        rel(refs, "assembly_contains_part", "Assembly", drawing, "Part", name, 0.85),
        rel(found.join(first, "path"), "part_made_of", "Part", F.col("part"), "Material", name, 0.8),
    ]
    every, links = ents[0], rels[0]
    for x in ents[1:]:
        every = every.unionByName(x)
    for x in rels[1:]:
        links = links.unionByName(x)
    # the surest of equal entities stays, its properties with it
    best = every.where(valid_name(name)).groupBy("path", "type", "name").agg(F.max_by(F.struct("confidence", "props"), "confidence").alias("b"))
    return best.select("path", "type", "name", "b.confidence", "b.props"), links.distinct()


def step_text(meta: DataFrame) -> DataFrame:
    """(path, text): products, assemblies, measures and the bounding box of a STEP file in words."""
    listed = lambda head, parts: F.when(F.size(parts) > 0, F.concat(F.lit(head), F.array_join(parts, ", ")))
    box = F.when(F.col("box.min_x").isNotNull(), F.concat(F.lit("Bounding box: "), F.array_join(F.array(*[F.format_string("%s %.3f to %.3f", F.lit(a), F.col(f"box.min_{a}"), F.col(f"box.max_{a}")) for a in "xyz"]), ", ")))
    sizes = F.transform("measures", lambda m: F.concat_ws("=", m["kind"], m["value"].cast("string")))
    return meta.select("path", F.concat_ws("\n", listed("Products: ", F.array_distinct("products")), listed("Assemblies: ", F.array_distinct("assemblies")), listed("Measures: ", F.slice(sizes, 1, 20)), box).alias("text"))
