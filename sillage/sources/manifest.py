"""Lists of files and deliveries: what is new, what is gone, what is wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.functions.text import extract_bimester, extract_year
from sillage.session import stage


def split_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path (as ``_metadata`` names it) and 128-bit digest of every file below a folder, made of its splits.

    The digest is the exclusive or of the hashes of all (line number, line): each task adds up the lines of its splits
    and no file is held by any, however long it is. Line numbers come from the line counts of the splits before, so
    the digest is the same however a file is split. Files that Spark decompresses are digested as they read.
    """
    read = spark.read.text(path, recursiveFileLookup="true", lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_n"), "value"
    )
    sizes = read.groupBy("path", "_start").agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))
    before = W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    # one row per split of the listing
    splits = stage(sizes.select("path", "_start", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "splits")
    numbered = read.join(splits, ["path", "_start"]).withColumn("_number", F.col("_n") + F.col("_shift"))
    lanes = [F.bit_xor(F.xxhash64(F.lit(seed), "_number", "value")) for seed in (1, 2)]
    return numbered.groupBy("path").agg(F.concat_ws("", *(F.lpad(F.hex(x), 16, "0") for x in lanes)).alias("digest"))


def file_manifest(spark: SparkSession, path: str, by: str = "content") -> DataFrame:
    """Path and hash of every file below a folder.

    ``content`` hashes the bytes of a file in one task, up to the 2 GB of a value; ``splits`` hashes length and
    ``split_digests``, for files of any size; ``stat`` hashes length and time of change and opens no file.
    Empty files are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if by == "splits":
        listed = files.select(F.col("_metadata.file_path").alias("_path"), "path", "length")
        digests = split_digests(spark, path).withColumnRenamed("path", "_path")
        told = F.sha2(F.concat_ws("|", F.col("length").cast("string"), F.coalesce("digest", F.lit(""))).cast("binary"), 256)
        return listed.join(digests, "_path", "left").select("path", told.alias("hash"), "length")
    told = F.sha2("content", 256) if by == "content" else F.sha2(
        F.concat_ws("|", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).cast("binary"), 256
    )
    return files.select("path", told.alias("hash"), "length")


def changed_files(current: DataFrame, processed: DataFrame) -> DataFrame:
    """Files that are new or whose content differs from what was processed."""
    return current.join(processed.select("path", "hash"), ["path", "hash"], "left_anti")


def removed_files(current: DataFrame, processed: DataFrame) -> DataFrame:
    return processed.select("path").join(current.select("path"), "path", "left_anti")


def needs_rebuild(current: DataFrame, processed: DataFrame) -> DataFrame:
    """One row telling whether a processed file has gone, which calls for a full rebuild."""
    return removed_files(current, processed).agg(
        (F.count(F.lit(1)) > 0).alias("reconstruire"), F.count(F.lit(1)).alias("disparus")
    )


def manifest_reason(
    name: Column, modified: Column | None = None, year: int | None = None,
    images: bool = True, pdfs: bool = True, maps: bool = True, geospatial: bool = True, prefixes: bool = True,
) -> Column:
    """Why a delivery is left out, ``OK`` if it is wanted. Rules apply in this order:
    year, images, prefixes, PDF, maps, geospatial."""
    low = F.lower(name)
    out = F.when(name.isNull(), "SANS_NOM")
    if year is not None:
        told = extract_year(name) if modified is None else F.coalesce(
            F.substring(modified, 1, 4).try_cast("int"), extract_year(name)
        )
        out = out.when(told != year, "ANNEE")
    if images:
        out = out.when(low.rlike("(" + "|".join(s.replace(".", r"\.") for s in fv.IMAGE_SUFFIXES) + ")$"), "IMAGE")
    if prefixes:
        for prefix, reason in fv.EXCLUDED_PREFIXES.items():
            out = out.when(name.startswith(prefix), reason)
    if pdfs:
        out = out.when(low.endswith(".pdf"), "PDF")
    if maps:
        out = out.when(low.contains("carte") | low.contains("map"), "CARTE")
    if geospatial:
        out = out.when(low.contains("geojson") | low.contains("kml"), "GEOSPATIAL")
    return out.otherwise("OK")


def filter_manifest(df: DataFrame, name: str = "file_name", **options) -> DataFrame:
    return df.withColumn("raison", manifest_reason(F.col(name), **options))


def exclusion_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("raison").agg(F.count(F.lit(1)).alias("fichiers"))


def rank_deliveries(df: DataFrame, study: str, year: int) -> DataFrame:
    """ZIP deliveries of a study and year: latest bimester first, then latest change."""
    wanted = (
        F.lower("file_name").endswith(".zip") & (F.col("study_code_ref") == study)
        & F.col("delivery_name").rlike(rf"(?i)B\d+\s+{year}")
    )
    local = F.regexp_replace("file_last_modified_date", r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", "")
    return df.where(wanted).select(
        "*", extract_bimester(F.col("delivery_name")).alias("bimestre"),
        F.try_to_timestamp(F.replace(local, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("modifie"),
    ).orderBy(F.desc("bimestre"), F.desc("modifie"), "file_name")


def expected_files(spark: SparkSession, names: Sequence[str] = tuple(fv.STAGING_FILES)) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("fichier"))
