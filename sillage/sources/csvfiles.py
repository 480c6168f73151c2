"""Delimited deliveries: reading, cleaning up headers, telling families apart."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.functions.dates import parse_iso
from sillage.functions.text import numeric_flag
from sillage.session import stage
from sillage.sources.records import DELIMITERS, survey

_FLAGS = {"VacancesA": "vacances_a", "VacancesB": "vacances_b", "VacancesC": "vacances_c", "Ferie": "ferie"}


def keep_useful(df: DataFrame, cols: Iterable[str] = fv.DELIVERY_COLUMNS) -> DataFrame:
    """Useful columns that exist, typed: bad volumes are 0, bad dates null, bad flags 0."""
    typed = {
        "Volume": lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint")).alias("Volume"),
        "Date": lambda c: parse_iso(c).alias("date"),
        "JourDeLaSemaine": lambda c: c.alias("jour_semaine"),
        **{source: lambda c, name=name: numeric_flag(c).alias(name) for source, name in _FLAGS.items()},
    }
    return df.select(*[typed.get(c, lambda c: c)(F.col(c)) for c in cols if c in df.columns])


def read_useful(spark: SparkSession, path: str | Sequence[str], cols: Iterable[str] = fv.DELIVERY_COLUMNS, sep: str = ";") -> DataFrame:
    """Delivery files of any charset, each read by its own header and typed by ``keep_useful``."""
    return keep_useful(read_named(spark, path, sep), cols)


def lines_of(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw lines with their file; the bytes are untouched, whatever the charset."""
    return spark.read.text(path, recursiveFileLookup="true").select(
        F.col("_metadata.file_path").alias("fichier"), "value"
    )


def _fields(line: Column, sep: Column, quoted: Column, width: Column, kinds: Sequence[tuple[str, bool, int]]) -> Column:
    """Values of a record (v) and whether it has as many as the header (ok), by Spark's own CSV parsing.

    One parser for each dialect and number of columns that occurs.
    """
    out = None
    for delimiter, quotes, n in kinds:
        schema = ", ".join([*(f"c{i} STRING" for i in range(n)), "_bad STRING"])
        options = {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "quote": '"' if quotes else "", "escape": '"' if quotes else "\0"}
        row = F.from_csv(line, schema, options)
        cell = F.struct(F.array(*[row[f"c{i}"] for i in range(n)]).alias("v"), row["_bad"].isNull().alias("ok"))
        hit = (sep == delimiter) & (quoted == quotes) & (width == n)
        out = F.when(hit, cell) if out is None else out.when(hit, cell)
    return out


def _parsed(records: DataFrame, by_file: DataFrame, master: Sequence[str], kinds: Sequence[tuple[str, bool, int]]) -> DataFrame:
    """Records as rows with the columns ``master`` and ``_arity_ok``, each by the names of its own file.

    ``by_file`` (fichier, entete, sep, quoted, noms) has a row per file and is staged, so its size is known to the join.
    Blank lines and lines that repeat their file's header are left out.
    """
    rows = records.join(by_file, "fichier").where((F.trim("ligne") != "") & (F.col("entete").isNull() | (F.col("ligne") != F.col("entete"))))
    read = rows.select("fichier", "noms", _fields(F.col("ligne"), F.col("sep"), F.col("quoted"), F.size("noms"), kinds).alias("f"))
    named = read.select("fichier", F.map_from_arrays("noms", "f.v").alias("m"), F.col("f.ok").alias("_arity_ok"))
    return named.select("fichier", *[F.col("m")[c].alias(c) for c in master], "_arity_ok")


def read_csv_lenient(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """Rows of files of unknown charset, with ``_arity_ok`` telling rows of the right width.

    A file whose first record holds only names of ``columns`` is read by that record, whatever
    its order and however many it has; a file without such a record has all columns in order.
    Blank lines and header lines are left out. Quoted fields may hold delimiters and line feeds, unless the
    records of a file agree more without quotes; quoting is Spark's own CSV parsing.
    """
    rows, files = survey(spark, path, [sep])
    names = F.transform(F.split("entete", re.escape(sep)), lambda n: F.trim(F.regexp_replace(n, '^"|"$', "")))
    known = F.forall(names, lambda n: n.isin(*columns)) & (F.size(F.array_distinct(names)) == F.size(names))
    by_file = files.select(
        "fichier", F.when(known, F.col("entete")).alias("entete"), "sep", "quoted",
        F.when(known, names).otherwise(F.array(*[F.lit(c) for c in columns])).alias("noms"),
    )
    return _parsed(rows, by_file, columns, [(sep, q, n) for q in (True, False) for n in range(1, len(columns) + 1)])


def arity_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("lignes"), F.count_if(~F.col("_arity_ok")).alias("rejetees"))


def detect_delimiters(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Dialect of every file that has a record: its header, delimiter, whether it quotes, the number of fields most of its
    records have and their share of all."""
    return survey(spark, path)[1].withColumnRenamed("sep", "delimiteur")


def _by_header(spark: SparkSession, path: str | Sequence[str], delimiters: Sequence[str], named: Callable[[list[str]], list[str]]) -> DataFrame:
    """Files as one frame, each read by its own header; the columns are the union of all names.

    The driver learns the distinct headers, which name the columns of the result; the rows
    are read once, each by the header of its file, however many headers there are.
    """
    rows, files = survey(spark, path, delimiters)
    # in order of the headers, so that the columns come out the same every time
    kept = ["entete", "sep", "quoted"]
    variants = sorted(tuple(r) for r in files.select(*kept).distinct().collect())
    names = [named(next(csv.reader(io.StringIO(e, newline=""), delimiter=s, quoting=csv.QUOTE_MINIMAL if q else csv.QUOTE_NONE), [])) for e, s, q in variants]
    listed = spark.createDataFrame([(*v, n) for v, n in zip(variants, names)], "entete string, sep string, quoted boolean, noms array<string>")
    by_file = stage(files.join(listed, kept).select("fichier", *kept, "noms"), "headers")
    kinds = sorted({(s, q, len(n)) for (_, s, q), n in zip(variants, names)})
    return _parsed(rows, by_file, master_schema(names), kinds).drop("fichier", "_arity_ok")


def read_mixed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Files of several dialects and headers as one frame under normalised names."""
    return _by_header(spark, path, DELIMITERS, normal_names)


def read_named(spark: SparkSession, path: str | Sequence[str], sep: str = ";") -> DataFrame:
    """Files of one delimiter and several headers and charsets as one frame under the names they carry."""
    return _by_header(spark, path, [sep], lambda names: unique_names([n.strip() for n in names]))


def normal_name(name: str, position: int) -> str:
    """Lower case, blanks and dashes as underscores, other signs dropped, no leading digit."""
    out = re.sub(r"[^\w]", "", re.sub(r"[ \-]", "_", name.strip().lower()))
    if not out:
        return f"col_{position}"
    return f"col_{out}" if out[0].isdigit() else out


def unique_names(names: Sequence[str]) -> list[str]:
    """Names without repeats: the second ``x`` is ``x_1``."""
    taken: list[str] = []
    for wanted in names:
        candidate, suffix = wanted, 0
        while candidate in taken:
            suffix += 1
            candidate = f"{wanted}_{suffix}"
        taken.append(candidate)
    return taken


def normal_names(names: Sequence[str]) -> list[str]:
    return unique_names([normal_name(name, position) for position, name in enumerate(names)])


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normal_names(df.columns))


def master_schema(column_lists: Iterable[Sequence[str]]) -> list[str]:
    """Union of the columns in the order in which they were first seen."""
    return list(dict.fromkeys(c for columns in column_lists for c in columns))


def align(df: DataFrame, master: Sequence[str]) -> DataFrame:
    """Frame with the master columns first (null where missing) and its extras last."""
    have = set(df.columns)
    extras = [c for c in df.columns if c not in set(master)]
    return df.select(
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in master], *extras
    )


def align_all(frames: Sequence[DataFrame]) -> DataFrame:
    master = master_schema(f.columns for f in frames)
    out = align(frames[0], master)
    for frame in frames[1:]:
        out = out.unionByName(align(frame, master))
    return out


def merge_deliveries(frames: Sequence[DataFrame], existing: DataFrame | None = None) -> DataFrame:
    """Deliveries of a family in one table without repeated rows, on top of what was merged before."""
    parts = ([existing] if existing is not None else []) + list(frames)
    relaxed = [p.select(*[F.col(c).cast("string").alias(c) for c in p.columns]) for p in parts]
    return align_all(relaxed).dropDuplicates()


def merge_to_parquet(frames: Sequence[DataFrame], path: str) -> None:
    merge_deliveries(frames).write.mode("overwrite").option("compression", "zstd").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


# --- families --------------------------------------------------------------------------
_BIMESTER = r"20\d{2}B\d+"


def _history_patterns() -> list[tuple[str, str]]:
    """(pattern over the name without suffix, family). Plain night and day files carry
    exactly one more part after the bimester, the others any rest."""
    out = []
    for family in fv.HISTORY_FAMILIES:
        anycase = family.startswith("SejourDuree") or family.endswith("Departement")
        rest = "_[^_]+$" if family in ("Nuitee", "Diurne") else ""
        out.append((f"{'(?i)' if anycase else ''}^{family}_{_BIMESTER}{rest}", family))
    return out


def classify(name: Column) -> Column:
    """Family of a delivered file; null for weekly, regional and unknown files."""
    base = F.regexp_replace(name, r"(?i)\.csv$", "")
    prefix = F.regexp_extract(base, r"^(.*?)_20\d{2}B", 1)
    out = F.when(name.rlike("(?i)semaine"), F.lit(None).cast("string"))
    for pattern, family in _history_patterns():
        out = out.when(base.rlike(pattern), family)
    return out.when(prefix.isin(*fv.MOBILITY_FAMILIES), prefix)


def table_for(df: DataFrame, name: str = "fichier", prefixes: Mapping[str, str] = fv.PREFIX_TABLES) -> DataFrame:
    """Target table by the longest prefix that fits; null for files not on the list."""
    out = None
    for prefix in sorted(prefixes, key=len, reverse=True):
        hit = F.col(name).startswith(prefix)
        out = F.when(hit, prefixes[prefix]) if out is None else out.when(hit, prefixes[prefix])
    csv = F.lower(F.col(name)).endswith(".csv")
    return df.withColumn("table", F.when(csv, out))


def family(name: Column) -> Column:
    """Name parts before the first part that holds a ``B`` and a digit."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.split(name, "_")
    positions = F.filter(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.element_at(parts, i).contains("B") & F.element_at(parts, i).rlike(r"\d"),
    )
    token = F.get(positions, F.lit(0))
    return F.when(token.isNull(), stem).otherwise(F.array_join(F.slice(parts, F.lit(1), token - 1), "_"))


def delivery_name(path: Column) -> Column:
    """Name of the delivered file in a path, also where Spark wrote it as a folder."""
    return F.regexp_extract(F.url_decode(path), r"([^/=]+\.csv)(/part-[^/]*)?$", 1)
