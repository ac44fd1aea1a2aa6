"""A corpus of section files: registry, walk, bundles."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.session import fs_of, ship

FRONT = (
    "id string, node string, source string, title string, level string, kind string, parent string, order bigint, effective date, retired date, published date, supersedes string, superseded_by string, "
    "amended_by array<string>, overrides array<string>, narrows array<struct<id:string,anchor:string>>, defines array<string>, definition_scope string, authority string, citation string, tags array<string>, "
    "context string, context_kind string, retrieval_role string, provenance struct<checks:map<string,string>,raw:string,raw_sha256:string,legal_status:string,ingest_run string,confidence:double>, "
    "actions array<struct<action_id:string,notice:string,target_id:string,target_anchor:string,kind:string,effective:string,text:string>>"
).replace("ingest_run string", "ingest_run:string")
REQUIRED = ["id", "source", "title", "level", "parent", "effective", "provenance"]


def _yaml(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import yaml

    def one(x: str | None) -> str | None:
        if not isinstance(x, str):
            return None
        try:
            data = yaml.safe_load(x)
        except yaml.YAMLError as e:
            return json.dumps({"__error": str(e)[:200]})
        return json.dumps(data if isinstance(data, dict) else {"__error": "no mapping"}, default=str, ensure_ascii=False)

    for s in batches:
        yield s.map(one)


def with_yaml(df: DataFrame, column: str, out: str) -> DataFrame:
    """A YAML column as a JSON string (null for null; ``__error`` for what cannot be read)."""
    ship(df.sparkSession)
    return df.withColumn(out, _yaml_udf()(F.col(column)))


def _yaml_udf():
    @F.pandas_udf("string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _yaml(batches)

    return parse


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Sources: one row per direct subfolder with a ``_source.yaml``."""
    # Spark's listing hides names that begin with an underscore; the registry has one small file per source.
    fs, pattern = fs_of(spark, f"{root.rstrip('/')}/*/_source.yaml")
    rows = []
    for s in fs.globStatus(pattern) or []:
        stream = fs.open(s.getPath())
        try:
            rows.append((s.getPath().getParent().getName(), spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
    files = spark.createDataFrame(rows, "folder string, value string")
    schema = "name string, input_mode string, kind string, title string, publisher string, precedence bigint, id_prefix string, id_pattern string, id_template string, anchor_template string, legal_status string, version string"
    rows = with_yaml(files, "value", "j").select("folder", F.from_json("j", schema).alias("s"))
    return rows.select("folder", "s.*")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(rel, text) of every markdown file below the root, without hidden ones, in no order (sort where order matters)."""
    base = root.rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(base, wholetext=True).withColumn("path", F.url_decode(F.regexp_replace(F.input_file_name(), r"\+", "%2B")))
    plain = base.removeprefix("file://")
    rel = F.substring_index("path", plain + "/", -1)
    return files.select(rel.alias("rel"), F.col("value").alias("text")).where(~F.col("rel").rlike(r"(^|/)\."))


def documents(files: DataFrame) -> DataFrame:
    """(rel, keys, front fields, body, error) of section files; keys are the front-matter keys that are present, so that
    ``parent: null`` and no parent can be told apart."""
    block, body = T.front_matter("text")
    rows = with_yaml(files.select("rel", block.alias("block"), body.alias("body")), "block", "j")
    front = F.from_json("j", FRONT)
    return rows.select("rel", F.json_object_keys("j").alias("keys"), front.alias("f"), "body", F.get_json_object("j", "$.__error").alias("error")).select("rel", "keys", "f.*", "body", "error")


def missing_keys(docs: DataFrame) -> DataFrame:
    """(rel, key): required front-matter keys that are absent."""
    gone = F.array_except(F.array(*(F.lit(k) for k in REQUIRED)), F.coalesce("keys", F.array().cast("array<string>")))
    return docs.select("rel", F.explode(gone).alias("key"))


# ---- bundles: many section files in one JSON


def packed(files: DataFrame, group: str) -> DataFrame:
    """(document, bundle): the files of each group as one JSON with their texts and sha256 digests."""
    text = F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "text"))))
    digest = F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", F.sha2("text", 256)))))
    g = files.groupBy(F.col(group).alias("document")).agg(text.alias("sections"), digest.alias("artifacts"))
    return g.select("document", F.to_json(F.struct(F.lit(1).alias("schema_version"), "document", "artifacts", "sections")).alias("bundle"))


def unpacked(bundles: DataFrame, column: str = "bundle") -> DataFrame:
    """(document, rel, text, intact): the files of bundles; intact tells whether the text has the recorded digest."""
    b = F.from_json(column, "schema_version int, document string, artifacts map<string,string>, sections map<string,string>")
    rows = bundles.select(b.alias("b")).select("b.document", "b.artifacts", F.explode("b.sections").alias("rel", "text"))
    return rows.select("document", "rel", "text", F.coalesce(F.sha2("text", 256) == F.element_at("artifacts", F.col("rel")), F.lit(False)).alias("intact"))


def all_files(physical: DataFrame, bundles: DataFrame) -> DataFrame:
    """Real files and those of bundles; a real one wins over a bundled one of the same name."""
    virtual = unpacked(bundles).select("rel", "text").join(physical.select("rel"), "rel", "left_anti")
    return physical.select("rel", "text").unionByName(virtual)
