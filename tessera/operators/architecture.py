"""Folders, layers, component topology and Mermaid text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_path, mermaid_id, reading_order, top_folder

# What folders of these names do.
RESPONSIBILITIES = {
    "app": "应用入口与路由层",
    "pages": "页面层",
    "views": "页面层",
    "features": "业务功能层",
    "components": "通用组件层",
    "hooks": "React Hooks / 可复用逻辑",
    "composables": "Vue Composables",
    "stores": "状态管理层",
    "services": "服务访问层",
    "api": "接口访问层",
    "utils": "通用工具层",
    "lib": "基础设施层",
    "config": "工程配置层",
}
UNKNOWN = "待识别模块"
# The layers, in order.
LAYERS = ("pages", "features", "components", "hooks", "stores", "services", "utils")


def responsibility(folder: Column, names: dict[str, str] = RESPONSIBILITIES) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), folder), F.lit(UNKNOWN))


def placed_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges with the folders of both ends; null for an end that isn't a file. files: repo_id, id, folder."""
    a = files.select("repo_id", F.col("id").alias("src"), F.col("folder").alias("src_folder"))
    b = files.select("repo_id", F.col("id").alias("dst"), F.col("folder").alias("dst_folder"))
    return edges.join(a, ["repo_id", "src"], "left").join(b, ["repo_id", "dst"], "left")


def directories(files: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, path, responsibility, files, inbound, outbound, ordinal; by number of files, ties by the first file.
    Edges of every kind count where they cross folders. files: repo_id, id, path."""
    f = files.withColumn("folder", top_folder(F.col("path")))
    sizes = f.groupBy("repo_id", "folder").agg(F.count("*").alias("files"), first_path(F.col("path")).alias("first"))
    cross = placed_edges(edges, f).where(~F.col("src_folder").eqNullSafe(F.col("dst_folder")))
    ins = cross.groupBy("repo_id", F.col("dst_folder").alias("folder")).agg(F.count("*").alias("inbound"))
    outs = cross.groupBy("repo_id", F.col("src_folder").alias("folder")).agg(F.count("*").alias("outbound"))
    t = sizes.join(ins, ["repo_id", "folder"], "left").join(outs, ["repo_id", "folder"], "left")
    w = Window.partitionBy("repo_id").orderBy(F.desc("files"), *reading_order(F.col("first")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return t.select("repo_id", F.col("folder").alias("path"), responsibility(F.col("folder")).alias("responsibility"), "files", zero("inbound"), zero("outbound"), F.row_number().over(w).alias("ordinal"))


def layers(files: DataFrame, edges: DataFrame, names: tuple[str, ...] = LAYERS) -> DataFrame:
    """repo_id, name, ordinal and depends_on: other folders that the layer imports from, in the order first seen."""
    f = files.withColumn("folder", top_folder(F.col("path")))
    order = F.array_position(F.array(*map(F.lit, names)), F.col("folder"))
    present = f.where(F.col("folder").isin(*names)).select("repo_id", F.col("folder").alias("name"), order.alias("ordinal")).distinct()
    pairs = placed_edges(edges.where("kind = 'import'"), f).where("src_folder <> dst_folder").where(F.col("src_folder").isin(*names))
    seen = pairs.groupBy("repo_id", F.col("src_folder").alias("name"), "dst_folder").agg(F.min("ordinal").alias("first"))
    deps = seen.groupBy("repo_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "dst_folder"))), lambda x: x["dst_folder"]).alias("depends_on"))
    return present.join(deps, ["repo_id", "name"], "left").select("repo_id", "name", "ordinal", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def component_topology(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of every kind, repeats kept, between files that declare components: repo_id, src, dst (paths), ordinal."""
    own = symbols.where("kind = 'component'").select("repo_id", F.col("file_id").alias("src")).distinct()
    kept = edges.join(own, ["repo_id", "src"], "left_semi").join(own.withColumnRenamed("src", "dst"), ["repo_id", "dst"], "left_semi")
    return edge_paths(kept, files).select("repo_id", F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), "ordinal")


def edge_paths(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges with src_path and dst_path; an end that isn't a file keeps its id."""
    a = files.select("repo_id", F.col("id").alias("src"), F.col("path").alias("a_path"))
    b = files.select("repo_id", F.col("id").alias("dst"), F.col("path").alias("b_path"))
    out = edges.join(a, ["repo_id", "src"], "left").join(b, ["repo_id", "dst"], "left")
    return out.withColumns({"src_path": F.coalesce("a_path", "src"), "dst_path": F.coalesce("b_path", "dst")}).drop("a_path", "b_path")


def layer_mermaid(layer_rows: DataFrame) -> DataFrame:
    """repo_id, section, line_no, line: header, a node per name met, an edge per dependency."""
    met = layer_rows.select("repo_id", "ordinal", F.posexplode(F.concat(F.array("name"), "depends_on")).alias("pos", "name"))
    nodes = met.groupBy("repo_id", "name").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    node = nodes.select("repo_id", F.lit(1).alias("section"), "at", F.concat(F.lit("  "), mermaid_id(F.col("name")), F.lit('["'), "name", F.lit('"]')).alias("line"))
    deps = layer_rows.select("repo_id", "name", "ordinal", F.posexplode("depends_on").alias("pos", "target"))
    edge = deps.select("repo_id", F.lit(2).alias("section"), F.struct("ordinal", F.col("pos").alias("pos")).alias("at"), F.concat(F.lit("  "), mermaid_id(F.col("name")), F.lit(" --> "), mermaid_id(F.col("target"))).alias("line"))
    head = layer_rows.select("repo_id").distinct().select("repo_id", F.lit(0).alias("section"), F.struct(F.lit(0).cast("int").alias("ordinal"), F.lit(0).alias("pos")).alias("at"), F.lit("graph TD").alias("line"))
    cast = lambda df: df.select("repo_id", "section", F.struct(F.col("at.ordinal").cast("long").alias("ordinal"), F.col("at.pos").cast("long").alias("pos")).alias("at"), "line")
    w = Window.partitionBy("repo_id").orderBy("section", "at")
    return cast(head).unionByName(cast(node)).unionByName(cast(edge)).select("repo_id", F.row_number().over(w).alias("line_no"), "section", "line")


def file_mermaid(files: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, section, ordinal, line: a node per file and an arrow per import."""
    node = files.select("repo_id", F.lit(1).alias("section"), F.col("path").alias("a"), F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit("  "), mermaid_id(F.col("path")), F.lit('["'), "path", F.lit('"]')).alias("line"))
    imports = edge_paths(edges.where("kind = 'import'"), files)
    arrow = imports.select("repo_id", F.lit(2).alias("section"), F.lit("").alias("a"), "ordinal", F.concat(F.lit("  "), mermaid_id(F.col("src_path")), F.lit(" --> "), mermaid_id(F.col("dst_path"))).alias("line"))
    return node.unionByName(arrow)
