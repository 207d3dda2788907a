"""Readers with an explicit schema and a policy for bad rows, checks of returned tables, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

#: What to do with a malformed row.
POLICIES = {"skip": "DROPMALFORMED", "raise": "FAILFAST", "keep": "PERMISSIVE"}
# Columns of the returned tables by task.
RETURNS = {
    "QAQUESTION": ("id", "category", "query", "keywords", "expect_graph_terms", "requires_guardrail", "submitted_by", "notes"),
    "ALIAS": ("entity_name", "entity_type", "alias", "language", "source", "student_id", "notes"),
}


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set on the context so that checkpoint() works.

    Only a local session, as in tests, gets a folder of its own where that is unset; a cluster must name a shared one.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not at:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            import tempfile

            at = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(at)
    return (at or context.getCheckpointDir()).rstrip("/")


def read_jsonl(spark: SparkSession, path: str, schema: str | ty.StructType, policy: str = "skip") -> DataFrame:
    return spark.read.schema(schema).option("mode", POLICIES[policy]).json(path)


def read_documents(spark: SparkSession, path: str, schema: str | ty.StructType) -> DataFrame:
    """One JSON object for each file, files in all folders below."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def read_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    """Strings by an explicit schema; a byte-order mark is skipped, cells may hold line feeds."""
    schema = ty.StructType([ty.StructField(c, ty.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("encoding", "UTF-8").option("enforceSchema", False).csv(path)


def read_files(spark: SparkSession, path: str, suffixes=(".pdf", ".docx"), only: str | None = None, limit: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of files with the suffixes, in any case; `limit` takes the first by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ends = "|".join(s.lower().replace(".", r"\.") for s in suffixes)
    files = files.where(F.lower("path").rlike(f"({ends})$"))
    if only:
        files = files.where(F.col("path").rlike(only))
    return files.orderBy("path").limit(limit) if limit is not None else files


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_id, text: the pages of a text parted by [PAGE n] marks; without a mark one page."""
    cut = F.split(F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))), r"(?=\n\[PAGE \d+\])")
    each = docs.select("doc_id", F.explode(F.filter(cut, lambda p: p.rlike(r"\S"))).alias("part"))
    number = F.regexp_extract("part", r"^\n\[PAGE (\d+)\]", 1)
    return each.select("doc_id", F.when(number == "", 1).otherwise(number.try_cast("int")).alias("page_id"), F.regexp_replace("part", r"^\n(\[PAGE \d+\])?\s*|\s+$", "").alias("text"))


def violations(rows: DataFrame, required) -> DataFrame:
    """row, column: cells of required columns that are null or blank; row is the hash of the row's required cells."""
    key = F.xxhash64(*required).alias("row")
    blank = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(c)) for c in required]))
    return rows.select(key, F.explode(blank).alias("column"))


def check_header(found: list[str], task: str) -> None:
    """Raises if the columns of a returned table aren't those of its task."""
    if list(found) != list(RETURNS[task]):
        raise ValueError(f"{task}: expected {','.join(RETURNS[task])}, found {','.join(found)}")


def merged_questions(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, and of new the ids that aren't in old, each once (the smallest row of an id)."""
    fresh = new.groupBy("id").agg(F.min(F.struct(*[c for c in new.columns if c != "id"])).alias("r")).select("id", "r.*")
    return old.unionByName(fresh.join(old.select("id"), "id", "left_anti").select(*old.columns))


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in the order of a range-partitioned sort: files in order, rows in order, and no single writer."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """CSV with a header in each file; arrays are joined by | ."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    (df.orderBy(*order) if order else df).select(*flat).write.mode("overwrite").option("header", True).csv(path)


def alias_groups(groups: DataFrame) -> DataFrame:
    """type, group_id, alias of groups (type, group_id, aliases); raises if an alias of a type is in two groups."""
    from skein.functions import text as T

    each = groups.select("type", "group_id", F.explode("aliases").alias("alias")).withColumn("alias", T.space_key(F.col("alias"))).distinct()
    twice = each.groupBy("type", "alias").agg(F.count_distinct("group_id").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError("aliases in several groups: " + ", ".join(f"{r['type']} {r['alias']}" for r in twice))
    return each


def alias_candidates(old: DataFrame, rows: DataFrame, student: str) -> DataFrame:
    """old and new alias candidates (entity_name, student_id, aliases): of rows (row, entity_name, aliases split by ;).

    The entity's name leads its aliases unless it is among them; an entity that a student has already named is left out, and
    of several rows for one entity the first stays.
    """
    first = rows.groupBy(F.coalesce("entity_name", F.lit("")).alias("entity_name")).agg(F.min_by("aliases", "row").alias("raw"))
    parts = F.filter(F.transform(F.split(F.coalesce("raw", F.lit("")), ";"), lambda a: F.trim(a)), lambda a: a != "")
    name = F.col("entity_name")
    listed = F.when((name == "") | F.array_contains(parts, name), parts).otherwise(F.concat(F.array(name), parts))
    new = first.select("entity_name", F.lit(student).alias("student_id"), listed.alias("aliases"))
    return old.unionByName(new.join(old.select("entity_name", "student_id"), ["entity_name", "student_id"], "left_anti"))


def summary_json(df: DataFrame, path: str) -> None:
    """The one row of a global aggregate as a line of JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
