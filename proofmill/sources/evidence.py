"""Saved evidence: shards behind a manifest, record folders, result maps, pages, snapshots and external artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, schemas: dict[tuple[str, int], str]) -> dict[tuple[str, int], DataFrame]:
    """A folder of JSON records of many kinds, split by (schema_name, schema_version) and parsed by each kind's schema.

    One record per line or file. Unknown kinds and records that their schema does not parse, because a field has another
    type or the JSON is broken, are under ("", 0).
    """
    raw = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"), F.get_json_object("value", "$.schema_name").alias("name"), F.get_json_object("value", "$.schema_version").cast("int").alias("version"))
    found, rest = {}, F.lit(True)
    for (name, version), schema in schemas.items():
        mine = (F.col("name") == name) & (F.col("version") == version)
        columns = [f.name for f in T._parse_datatype_string(schema)] if isinstance(schema, str) else schema.names
        record = F.from_json("value", f"{schema}, _unparsed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unparsed"})
        whole = F.coalesce(mine & record["_unparsed"].isNull(), F.lit(False))
        found[name, version] = raw.where(whole).withColumn("r", record).select("path", *[F.col("r").getField(c).alias(c) for c in columns])
        rest = rest & ~whole
    found["", 0] = raw.where(rest)
    return found


def read_shards(spark: SparkSession, manifest_path: str, root: str, schema: T.StructType | str) -> DataFrame:
    """Gzipped JSON-lines shards that a manifest names, with the manifest's facts beside each record.

    ``mismatch`` marks records of a shard whose count or SHA-256 is not the manifest's. The manifest has a row per file.
    """
    manifest = spark.read.schema("file string, sha256 string, count long, arm string, dataset string").json(manifest_path)
    digests = spark.read.format("binaryFile").load(f"{root}/*.json.gz").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("actual"))
    records = spark.read.schema(schema).json(f"{root}/*.json.gz").withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    counts = records.groupBy("file").agg(F.count("*").alias("n"))
    checked = manifest.join(digests, "file", "left").join(counts, "file", "left").withColumn("mismatch", ~F.coalesce((F.col("actual") == F.col("sha256")) & (F.col("n") == F.col("count")), F.lit(False)))
    return records.join(checked.select("file", "arm", "dataset", "mismatch"), "file")


def read_result_map(spark: SparkSession, path: str, value_schema: str, manifest: DataFrame, key: str, ordinal: str) -> DataFrame:
    """An object keyed by id, exploded and put into the manifest's order; ids that the manifest lacks are flagged."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias(key, "result"))
    m = manifest.select(F.col(key).alias("_k"), F.col(ordinal))
    return rows.join(m, F.col(key) == F.col("_k"), "left").withColumn("unknown", F.col("_k").isNull()).drop("_k")


def concatenate_pages(pages: DataFrame, points: str, total: str, cursor: str, identity: str) -> tuple[DataFrame, DataFrame]:
    """The points of paged responses, and what is wrong: totals that drift, repeated ids, not exactly one last page."""
    rows = pages.select("page", F.posexplode(points).alias("place", "p")).select("page", "place", "p.*")
    totals = pages.agg(F.count_distinct(total).alias("t"), F.count_if(F.col(cursor).isNull()).alias("ends"), F.count_if(F.col(cursor).isNotNull() & (F.size(points) == 0)).alias("empty"), F.max(total).alias("declared"))
    unique = rows.agg(F.count("*").alias("n"), F.count_distinct(identity).alias("u"))
    facts = totals.withColumn("_j", F.lit(1)).join(unique.withColumn("_j", F.lit(1)), "_j")
    checks = {"count_drift": F.col("t") != 1, "terminal_pages": F.col("ends") != 1, "empty_page": F.col("empty") > 0, "duplicate_id": F.col("n") != F.col("u"), "count": F.col("n") != F.col("declared")}
    return rows, facts.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("code"))


def discover_snapshots(spark: SparkSession, root: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(directory, provider) of saved snapshots, and the providers that are missing or there more than once."""
    found = spark.read.text(f"{root}/*/snapshot.json", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("directory"), F.get_json_object("value", "$.provider").alias("provider"))
    wanted = spark.createDataFrame([(r,) for r in required], "provider string")
    counts = wanted.join(found.groupBy("provider").count(), "provider", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    return found, counts.where("n <> 1").select("provider", F.col("n").cast("long").alias("n"))


EXTERNAL_CASE = "struct<case_id:string,category:string,verdict:boolean,context_tokens:long,retrieval_time_ms:decimal(20,6)>"


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an external result file; numbers are exact decimals."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<cases:array<{EXTERNAL_CASE}>>").getField("cases")).alias("c")).select("c.*")


#: The fields that an external result file may have at its top and in a case.
EXTERNAL_FIELDS = ("cases", "total_cases", "correct_cases", "context_tokens_total", "retrieval_time_ms_total")
EXTERNAL_CASE_FIELDS = ("case_id", "category", "verdict", "context_tokens", "retrieval_time_ms")


def external_issues(spark: SparkSession, path: str) -> DataFrame:
    """(path, code, ref) of external result files that are not closed: ``unparsable``, ``field`` for one that is not
    allowed at the top, ``case_field`` for one in a case, ``case`` for a case of the wrong type, ``duplicate``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    names = F.json_object_keys("value")
    cases = F.from_json(F.get_json_object("value", "$.cases"), "array<string>")
    each = files.select("path", F.explode(cases).alias("case"))
    bad = names.isNull() | cases.isNull()
    listed = lambda allowed: F.array(*[F.lit(a) for a in allowed])
    parsed = F.from_json("case", f"{EXTERNAL_CASE[7:-1].replace(':', ' ').replace(',', ', ').replace('20, 6', '20,6')}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    ident = F.get_json_object("case", "$.case_id")
    return (
        files.where(bad).select("path", F.lit("unparsable").alias("code"), F.lit(None).cast("string").alias("ref"))
        .unionByName(files.where(~bad).select("path", F.lit("field").alias("code"), F.explode(F.array_except(names, listed(EXTERNAL_FIELDS))).alias("ref")))
        .unionByName(each.select("path", F.lit("case_field").alias("code"), F.explode(F.array_except(F.json_object_keys("case"), listed(EXTERNAL_CASE_FIELDS))).alias("ref")))
        .unionByName(each.where(parsed["_bad"].isNotNull() | ident.isNull()).select("path", F.lit("case").alias("code"), ident.alias("ref")))
        .unionByName(each.groupBy("path", ident.alias("ref")).count().where("count > 1 and ref is not null").select("path", F.lit("duplicate").alias("code"), "ref"))
    )


def concatenate_offset_pages(pages: DataFrame, items: str, offset: str, limit: str, total: str, identity: str) -> tuple[DataFrame, DataFrame]:
    """The items of pages by offset, and what is wrong: totals that drift, offsets that do not follow on each other,
    pages under their limit before the last, repeated ids, another number of items than the total."""
    rows = pages.select(offset, F.posexplode(items).alias("place", "i")).select((F.col(offset) + F.col("place")).alias("place"), "i.*")
    w = Window.orderBy(offset)  # one row per page
    placed = pages.withColumn("_n", F.size(items)).withColumn("_next", F.lead(offset).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    gap = F.coalesce(F.col("_next") != F.col(offset) + F.col("_n"), F.lit(False)) | (F.col("_first") & (F.col(offset) != 0))
    short = F.col("_next").isNotNull() & (F.col("_n") < F.col(limit))
    facts = placed.agg(F.count_distinct(total).alias("t"), F.bool_or(gap).alias("gap"), F.bool_or(short).alias("short"), F.sum("_n").alias("n"), F.max(total).alias("declared"), F.size(F.array_distinct(F.flatten(F.collect_list(F.transform(items, lambda x: x[identity]))))).alias("u"))
    checks = {"count_drift": F.col("t") != 1, "offsets": F.col("gap"), "short_page": F.col("short"), "duplicate_id": F.col("n") != F.col("u"), "count": F.col("n") != F.col("declared")}
    return rows, facts.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("code"))


def read_projection(spark: SparkSession, url: str, relation: str, run_column: str, run_id: str, **options: str) -> DataFrame:
    """A provider's table over JDBC; the predicate goes to the database, and Spark splits the read instead of paging."""
    quoted = run_id.replace("'", "''")
    return spark.read.format("jdbc").options(url=url, query=f"SELECT * FROM {relation} WHERE {run_column} = '{quoted}'", **options).load()
