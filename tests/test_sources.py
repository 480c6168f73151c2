"""Real files: charsets, delimiters, archives, manifests, streams."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from rows import rows
from pyspark.sql import functions as F

from sillage.catalog import base, scans
from sillage.session import shared_dir
from sillage.sources import archives, csvfiles, history, json_rows, manifest, records
from sillage.sources.records import DELIMITERS
from sillage.streaming import ingest


def put(folder, name: str, data: bytes) -> None:
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)


def test_unknown_charsets_and_widths(spark, tmp_path):
    put(tmp_path, "utf8.csv", "Date;Zone\n2024-01-01;Châtaigneraie\n\n2024-01-02\n".encode())
    put(tmp_path, "bom.csv", "﻿Date;Zone\n2024-01-03;é;trop\n".encode())
    put(tmp_path, "latin.csv", "Date;Zone\n2024-01-04;Val Truyère\n2024-01-05;sans accent\n".encode("iso-8859-1"))
    got = csvfiles.read_csv_lenient(spark, str(tmp_path), ["Date", "Zone"])
    assert rows(got.where("_arity_ok").select("Date", "Zone")) == [
        ("2024-01-01", "Châtaigneraie"), ("2024-01-04", "Val Truyère"), ("2024-01-05", "sans accent"),
    ]
    assert tuple(csvfiles.arity_report(got).first()) == (5, 2)


def test_delimiters_and_headers_are_joined(spark, tmp_path):
    put(tmp_path, "a.csv", "Zone Obs;Volume\nx;1\n".encode())
    put(tmp_path, "b.csv", "zone-obs,Pays\ny,FR\n".encode())
    put(tmp_path, "c.csv", "zone_obs|Volume\nz|3\n".encode())
    put(tmp_path, "d.csv", "ZONE OBS\tVolume\nw\t4\n".encode())
    got = csvfiles.read_mixed(spark, str(tmp_path))
    assert rows(got.select("zone_obs", "volume", "pays")) == [("w", "4", None), ("x", "1", None), ("y", None, "FR"), ("z", "3", None)]


def test_synthetic_merge_set(spark, tmp_path):
    for i in range(15):
        lines = ["id;nom;age;ville;score"] + [f"{i * 50 + j};n{j};{j};v;{j / 2}" for j in range(50)]
        put(tmp_path, f"Nuitee_2025B{i}_x.csv", "\n".join(lines).encode())
    merged = csvfiles.merge_deliveries([csvfiles.read_mixed(spark, str(tmp_path))])
    assert merged.count() == 750
    assert csvfiles.merge_deliveries([merged], existing=merged.limit(100)).count() == 750


def test_names():
    assert csvfiles.normal_names(["Zone Obs", "zone-obs", "2025", "", "Vol.(m)"]) == ["zone_obs", "zone_obs_1", "col_2025", "col_3", "volm"]
    assert csvfiles.master_schema([["a", "b"], ["c", "a"]]) == ["a", "b", "c"]


def test_written_name_of_a_delivery(spark):
    path = shared_dir(spark, "named")
    df = spark.createDataFrame([("Nuitee_2025B1_CABA.csv", "x"), ("SejourDuree_Pays_2025B2.csv", "y")], "livraison string, v string")
    df.write.partitionBy("livraison").csv(path)
    names = csvfiles.lines_of(spark, path).select(csvfiles.delivery_name(F.col("fichier")).alias("n"))
    assert rows(names.select(csvfiles.classify(F.col("n")))) == [("Nuitee",), ("SejourDuree_Pays",)]


def test_nested_and_broken_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/b.csv", "3\n4")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.csv", "1\r\n2\r\n")
        z.writestr("lot/in.ZIP", inner.getvalue())
        z.writestr("bad.zip", b"nope")
        z.writestr("readme.txt", "x")
    put(tmp_path, "sub/one.zip", outer.getvalue())
    put(tmp_path, "broken.zip", b"PK broken")
    every = archives.read_zip_tree(spark, str(tmp_path))
    got = every.where("rejet IS NULL").select("membre", "numero", F.decode("ligne", "UTF-8"))
    assert rows(got) == [("a.csv", 0, "1"), ("a.csv", 1, "2"), ("deep/b.csv", 0, "3"), ("deep/b.csv", 1, "4")]
    skipped = [(r["archive"].rsplit("/", 1)[-1], r["rejet"]) for r in every.where("rejet IS NOT NULL").collect()]
    assert sorted(skipped) == [("bad.zip", "archive"), ("broken.zip", "archive")]


def test_members_of_one_archive_are_planned_apart(spark, tmp_path):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/b.csv", "3\n4")
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(12):
            z.writestr(f"m{i}.CSV", "".join(f"{i};{j}\r\n" for j in range(2000 * (i == 4) + 3)))
        z.writestr("lot/in.ZIP", inner.getvalue())
        z.writestr("bad.zip", b"nope")
        z.writestr("folder/", "")
        z.writestr("readme.txt", "x")
    blob = bytearray(outer.getvalue())
    with zipfile.ZipFile(io.BytesIO(bytes(blob))) as z:
        info = z.getinfo("m7.CSV")
        blob[info.header_offset + 30 + len(info.filename) + 2] ^= 255
    put(tmp_path, "sub/one.zip", bytes(blob))
    put(tmp_path, "sub/no.txt", b"x")
    put(tmp_path, "broken.zip", b"PK broken")
    every = archives.read_zip_members(spark, str(tmp_path), 40)
    tasks = every.where("membre like 'm%' and rejet is null").select("membre", F.spark_partition_id().alias("p")).distinct()
    assert tasks.count() == 11 and tasks.select("p").distinct().count() > 4
    assert archives.read_zip_members(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() == 2
    same = archives.read_zip_tree(spark, str(tmp_path))
    bare = F.regexp_replace("archive", "^file:/*", "/").alias("archive")
    columns = [bare, "membre", "numero", F.decode("ligne", "UTF-8"), "rejet"]
    assert rows(every.select(*columns)) == rows(same.select(*columns))
    assert sorted((r["membre"], r["rejet"]) for r in every.where("rejet is not null").collect() if r["membre"]) == [("m7.CSV", "membre")]
    assert archives.read_zip_members(spark, f"file://{tmp_path}/sub/one.zip").where("rejet is null").count() == 2003 + 10 * 3 + 2
    put(tmp_path, "none/a.txt", b"x")
    assert archives.read_zip_members(spark, str(tmp_path / "none")).count() == 0


def test_many_packs_share_tasks(spark, tmp_path):
    """Sixty archives of ten packs each, one of them broken, are read by no more tasks than are asked for."""
    for number in range(60):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for member in range(10):
                z.writestr(f"{member}.csv", f"{number};{member}\n" * (member + 1))
        put(tmp_path, f"{number}.zip", b"broken" if number == 7 else out.getvalue())
    every = archives.read_zip_members(spark, str(tmp_path), 1)
    assert every.rdd.getNumPartitions() <= archives._TASKS_PER_CORE * spark.sparkContext.defaultParallelism < 600
    lines = every.where("rejet is null").select(F.decode("ligne", "UTF-8").alias("l"), "numero").collect()
    assert sorted((r["l"], r["numero"]) for r in lines) == sorted((f"{n};{m}", i) for n in range(60) if n != 7 for m in range(10) for i in range(m + 1))
    assert every.where("rejet = 'archive'").count() == 1


def test_batches_of_lines_are_bounded_by_bytes():
    lines = [("a", "m", i, b"x" * (1 << 20), None) for i in range(20)] + [("a", None, None, None, "archive")]
    batches = list(archives._batched(iter(lines)))
    assert max(b.nbytes for b in batches) < (archives._CHUNK_BYTES + (2 << 20)) and sum(b.num_rows for b in batches) == 21


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_a_damaged_member_leaves_no_lines(spark, tmp_path, method):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("bad.csv", "".join(f"{i};{i * 7919 % 10007}\n" for i in range(20_000)))
        z.writestr("good.csv", "1\n2\n")
    blob = bytearray(out.getvalue())
    blob[blob.index(b"PK\x03\x04", 4) // 2] ^= 1
    put(tmp_path, "one.zip", bytes(blob))
    found = archives.read_zip_tree(spark, str(tmp_path)).groupBy("membre", "rejet").count()
    assert rows(found.select("membre", "rejet", "count")) == [("bad.csv", "membre", 1), ("good.csv", None, 2)]


def test_manifest_sees_changes_and_removals(spark, tmp_path):
    put(tmp_path, "a.csv", b"1")
    put(tmp_path, "b.csv", b"2")
    before = spark.createDataFrame(manifest.file_manifest(spark, str(tmp_path)).collect())
    put(tmp_path, "b.csv", b"22")
    put(tmp_path, "c.csv", b"3")
    after = manifest.file_manifest(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in manifest.changed_files(after, before).collect()) == ["b.csv", "c.csv"]
    assert manifest.needs_rebuild(after, before).first()["reconstruire"] is False
    assert manifest.needs_rebuild(after.where("path not like '%a.csv'"), before).first()["disparus"] == 1


def test_json_spellings(spark):
    texts = [
        '{"date": "2024-01-01", "nom_zone": "caba", "nom_provenance": "local", "nom_categorie": "touriste", "volume": 3}',
        '{"Date": "2024-01-06", "ZoneObservation": "HTC", "Provenance": "x", "CategorieVisiteur": "y", "Volume": "4", "CodeINSEE": "15001"}',
        '{"date": "2024-02-30", "nom_zone": "z", "volume": 1}', "pas du json",
    ]
    got = json_rows.rows_from_json(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert json_rows.usable(got).count() == 2
    second = got.where("zone = 'HTC'").first()
    assert (second["jour_semaine"], second["code_insee"], second["volume"]) == ("SAMEDI", "15001", 4)
    payload = spark.createDataFrame([('{"table": "fact_nuitees", "rows": [' + texts[0] + "," + texts[1] + "]}",)], "value string")
    assert json_rows.usable(json_rows.rows_from_json(json_rows.payload_rows(payload), "value", "table")).count() == 2


def test_deliveries_are_ranked(spark):
    df = spark.createDataFrame([
        ("a.zip", "E", "Lot B2 2024", "2024-05-27T11:26:48.864911+02:00"), ("b.zip", "E", "Lot B10 2024", None),
        ("c.zip", "E", "Lot B2 2024", "2024-05-28T11:26:48Z"), ("d.csv", "E", "B3 2024", None), ("e.zip", "X", "B3 2024", None), ("f.zip", "E", "B3 2023", None),
    ], "file_name string, study_code_ref string, delivery_name string, file_last_modified_date string")
    assert [r["file_name"] for r in manifest.rank_deliveries(df, "E", 2024).collect()] == ["b.zip", "c.zip", "a.zip"]


@pytest.fixture()
def inbox(spark):
    return [shared_dir(spark, n) for n in ("inbox", "lots", "checkpoint")]


def _deliver(spark, path: str, data: list[tuple]) -> None:
    spark.createDataFrame(data, "date date, zone string, volume bigint, livraison int").coalesce(1).write.mode("append").parquet(path)


def _run(spark, inbox) -> None:
    path, lots, checkpoint = inbox
    schema = spark.read.parquet(path).schema
    ingest.ingest(ingest.read_new_files(spark, path, schema, max_files=1), lots, checkpoint)


def test_stream_sees_each_file_once_and_corrections_win(spark, inbox):
    import datetime as dt

    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    _deliver(spark, inbox[0], [(d1, "a", 1, 1), (d1, "b", 2, 1), (d2, "a", 3, 1)])
    _run(spark, inbox)
    _deliver(spark, inbox[0], [(d1, "a", 10, 2)])
    _run(spark, inbox)
    _run(spark, inbox)
    lots = ingest.read_lots(spark, inbox[1], spark.read.parquet(inbox[0]).schema)
    assert lots.count() == 4
    key = ["date", "zone"]
    assert rows(ingest.latest(lots, key, "livraison")) == [(d1, "a", 10), (d1, "b", 2), (d2, "a", 3)]
    assert rows(ingest.latest_dates(lots, key, "livraison")) == [(d1, "a", 10), (d2, "a", 3)]


def test_a_repeated_batch_counts_once(spark, inbox):
    import datetime as dt

    rows_ = [(dt.date(2024, 1, 1), "a", 1, 1)]
    df = spark.createDataFrame(rows_, "date date, zone string, volume bigint, livraison int")
    write = ingest.append_lot(inbox[1], inbox[2], lambda b: b)
    write(df, 0)
    write(df, 0)
    assert ingest.read_lots(spark, inbox[1], df.schema).count() == 1
    ingest.append_lot(inbox[1], inbox[2] + "-other", lambda b: b)(df, 0)
    assert ingest.read_lots(spark, inbox[1], df.schema).count() == 2


def test_a_merged_fact_is_written_by_tasks_of_so_many_rows(spark, inbox, monkeypatch):
    monkeypatch.setattr(ingest, "TASK_ROWS", 100)
    path = shared_dir(spark, "fact")
    write = ingest.merge_into(path, "c", ingest.upsert(["date", "id"], "v"), lambda df: df)
    days = spark.range(1000).select(F.make_date(F.lit(2024), F.lit(1), F.lit(1)).alias("date"), "id", F.lit(1).alias("v"), (F.col("id") % 7).alias("volume"))
    write(days, 0)
    write(days.where("id < 10").withColumn("v", F.lit(2)).withColumn("volume", F.lit(100).cast("long")), 1)
    fact = spark.read.parquet(path)
    assert fact.select(F.input_file_name()).distinct().count() > 5
    assert sorted((r["id"], r["volume"]) for r in fact.collect()) == [(i, 100 if i < 10 else i % 7) for i in range(1000)]


def test_files_of_split_digests_have_a_task_each(spark, tmp_path, monkeypatch):
    orders = [(i, f"{i % 3 + 1}-P", "O") for i in range(3000)] + [(5000, None, "O"), (5001, "", "F"), (5002, None, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    folders = []
    monkeypatch.setattr(scans, "shared_dir", lambda s, n: folders.append(shared_dir(s, n)) or folders[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = rows(base.QUERIES["S12_split_digests"](spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == [("1-P", True), ("2-P", True), ("3-P", False), ("__HIVE_DEFAULT_PARTITION__", False)]
    files = spark.read.text(folders[0]).select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task"), "o_orderpriority").distinct().collect()
    assert len(files) == 4 and len({r["task"] for r in files}) > 2


def test_work_folder_is_the_one_the_session_names(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first != second
    if base:
        assert first.startswith(base.rstrip("/") + "/")


def test_task_functions_travel_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark.cloudpickle import cloudpickle

    for function in (archives._expand,):
        load = "import pickle, sys; print(pickle.load(sys.stdin.buffer).__name__); assert 'sillage' not in sys.modules"
        done = subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(function), capture_output=True, cwd=tmp_path, timeout=60)
        assert done.returncode == 0, done.stderr


def test_five_hundred_headers(spark, tmp_path):
    for i in range(500):
        sep = ";,|\t"[i % 4]
        put(tmp_path, f"f{i}.csv", f"id{sep}col {i}\n{i}{sep}\"v{sep}{i}\"\n\n".encode())
    df = csvfiles.read_mixed(spark, str(tmp_path))
    assert df.columns[0] == "id" and len(df.columns) == 501
    got = {r["id"]: r[f"col_{r['id']}"] for r in df.collect()}
    assert got == {str(i): f"v{';,|' [i % 4] if i % 4 < 3 else chr(9)}{i}" for i in range(500)}


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    put(tmp_path, "a.csv", b"id;zone\n1;A\n2\n3;B;x\n")
    put(tmp_path, "b.csv", "\ufeffzone;id\r\nÉ;4\r\n".encode())
    put(tmp_path, "c.csv", "Ü;5\n".encode("iso-8859-1"))
    put(tmp_path, "d.csv", b"zone\nD\n")
    df = csvfiles.read_csv_lenient(spark, str(tmp_path), ["id", "zone"])
    good = rows(df.where("_arity_ok").select("id", "zone"))
    assert good == sorted([("1", "A"), ("4", "É"), ("Ü", "5"), (None, "D")], key=repr)
    assert df.where("NOT _arity_ok").count() == 2


@pytest.fixture()
def small_splits(spark):
    """Splits of some bytes, so that files of a few lines lie in many."""
    sizes = {"spark.sql.files.maxPartitionBytes": "61", "spark.sql.files.openCostInBytes": "7", "spark.sql.files.minPartitionNum": "64"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    yield
    for key in sizes:
        spark.conf.unset(key)


def _as_written(fields: list[list[str]], sep: str, rng, end: str) -> str:
    def cell(v):
        return '"' + v.replace('"', '""') + '"' if rng.random() < 0.2 or any(c in v for c in f'";,|\t\r\n{sep}') else v

    return end.join(sep.join(cell(v) for v in row) for row in fields)


@pytest.mark.parametrize("seed", range(4))
def test_records_across_splits(spark, tmp_path, small_splits, seed):
    """Quoted fields with line feeds, delimiters and quotes come out as they went in, wherever the splits cut them."""
    rng = random.Random(seed)
    bits = ["a", "é", "12", " ", '"', '""', ";", ",", "|", "\n", "\r\n", "\n\n", "x" * 90, "\t"]
    want = []
    for k in range(5):
        sep, end = DELIMITERS[(k + seed) % 4], "\r\n" if k % 2 else "\n"
        fields = [[f"{k}-{i}", *("".join(rng.choice(bits) for _ in range(rng.randrange(5))).strip(" \t") for _ in range(2)), "z"] for i in range(40)]
        want += [tuple(v.replace("\r\n", "\n") or None for v in row) for row in fields]
        put(tmp_path, f"f{k}.csv", ("\ufeff" * (k == 1) + _as_written([["id", "one\nline", "two", "end"], *fields], sep, rng, end) + end * (k != 2)).encode())
    told = {r["fichier"].rsplit("/", 1)[1]: (r["sep"], r["entete"].count("\n")) for r in records.survey(spark, str(tmp_path))[1].collect()}
    assert told == {f"f{k}.csv": (DELIMITERS[(k + seed) % 4], 1) for k in range(5)}
    got = csvfiles.read_mixed(spark, str(tmp_path))
    assert got.columns == ["id", "oneline", "two", "end"]
    # a quoted empty field is read as an empty text
    assert sorted(tuple((v or "").replace("\r\n", "\n") or None for v in r) for r in got.collect()) == sorted(want)


def test_a_quote_that_nothing_closes(spark, tmp_path, small_splits):
    """Such a quote ends no file: where records agree better without quotes, there are none."""
    put(tmp_path, "a.csv", b"id;size\n" + b"".join(b'%d;"%d in\n' % (i, i) for i in range(50)))
    put(tmp_path, "b.csv", b'id;size\n1;x\n2;"open\n3;y\n')
    got = csvfiles.read_csv_lenient(spark, str(tmp_path), ["id", "size"])
    assert rows(got.where("fichier like '%a.csv'").select("id", "size")) == sorted([(str(i), f'"{i} in') for i in range(50)], key=repr)
    assert rows(got.where("fichier like '%b.csv' and _arity_ok").select("id"))[0] == ("1",)


def test_lines_without_open_quotes_do_not_move(spark, tmp_path):
    put(tmp_path, "a.csv", b'id;zone\n1;"a;b"\n2;c\n')
    plan = csvfiles.read_csv_lenient(spark, str(tmp_path), ["id", "zone"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_columns_keep_their_names_whatever_their_order(spark, tmp_path):
    put(tmp_path, "a.csv", "Date;ZoneObservation;Provenance;CategorieVisiteur;Volume\n2024-01-01;Châtaigneraie;LOCAL;TOURISTE;5\n".encode())
    put(tmp_path, "b.csv", "Volume;CategorieVisiteur;Provenance;ZoneObservation;Date\n7;TOURISTE;ETRANGER;Val Truyère;2024-01-02\n".encode("iso-8859-1"))
    put(tmp_path, "c.csv", "Volume;Date;Inconnue\nx;2024-01-03;?\n".encode())
    got = csvfiles.read_useful(spark, str(tmp_path))
    assert rows(got.select(F.col("date").cast("string"), "ZoneObservation", "Provenance", "CategorieVisiteur", "Volume")) == [
        ("2024-01-01", "Châtaigneraie", "LOCAL", "TOURISTE", 5), ("2024-01-02", "Val Truyère", "ETRANGER", "TOURISTE", 7), ("2024-01-03", None, None, None, 0),
    ]
    assert "Inconnue" not in got.columns


def test_no_files_with_records(spark, tmp_path):
    put(tmp_path, "a.csv", b"\n\n")
    assert csvfiles.read_csv_lenient(spark, str(tmp_path), ["id"]).count() == 0


def test_digests_do_not_depend_on_splits(spark, tmp_path):
    text = "".join(f"line {i * i};é\n" for i in range(300)).encode()
    put(tmp_path, "a b.csv", text)
    put(tmp_path, "swapped.csv", b"line 1;\xc3\xa9\nline 0;\xc3\xa9\n" + text.split(b"\n", 2)[2])
    put(tmp_path, "no end.csv", text[:-1])
    put(tmp_path, "empty.csv", b"")
    put(tmp_path, "copy/a.csv", text)

    def digests():
        return {r["path"].rsplit("/", 2)[-1 if "copy" not in r["path"] else 2] + ("2" if "copy" in r["path"] else ""): r["hash"] for r in manifest.file_manifest(spark, str(tmp_path), by="splits").collect()}

    whole = digests()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "251")
    spark.conf.set("spark.sql.files.openCostInBytes", "7")
    try:
        split = digests()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # a file without a byte is in no listing
    assert split == whole and len(whole) == 4
    assert len(set(whole.values())) == 3 and whole["a b.csv"] == whole["a.csv2"]


def test_history_takes_what_is_new(spark, tmp_path):
    path = str(tmp_path / "history")
    first = spark.createDataFrame([("2023", "a", "1"), ("2023", "a", "1"), ("2024", None, "2"), (None, "n", "3")], "an string, x string, y string")
    wider = spark.createDataFrame([("2024", None, "2", None), ("2024", "b", None, "z"), ("2024", "b", None, "z"), (None, "n", "3", None)], "an string, x string, y string, w string")
    swapped = spark.createDataFrame([("1", "a", "2023"), ("2", "a", "2025")], "y string, x string, an string")
    for delivery in (first, wider, first, swapped, wider):
        history.append_new([delivery], path, by=F.col("an"))
    want = csvfiles.merge_deliveries([first, wider, swapped])
    assert rows(history.rows_of(spark, path).select(*want.columns)) == rows(want)


def test_a_delivery_reads_its_own_places(spark, tmp_path):
    path = tmp_path / "history"
    both = spark.createDataFrame([("2023", "a"), ("2024", "b")], "an string, x string")
    history.append_new([both], str(path), by=F.col("an"))
    for part in (path / "_place=2023").glob("*.parquet"):
        part.write_bytes(b"not read")
    history.append_new([both.where("an = '2024'"), spark.createDataFrame([("2024", "c")], both.schema)], str(path), by=F.col("an"))
    assert rows(spark.read.schema("an string, x string").parquet(str(path / "_place=2024"))) == [("2024", "b"), ("2024", "c")]


def test_counts_of_a_load_are_those_of_its_reject_report(spark, tmp_path):
    from sillage.operators.zones import alias_frame
    from sillage.plans import load

    head = "Date;ZoneObservation;Provenance;CategorieVisiteur;Volume\n"
    lines = ["2024-01-01;CABA;LOCAL;TOURISTE;5", "2024-02-31;CABA;LOCAL;TOURISTE;5", "2024-01-01;;LOCAL;;5", "2024-01-01;CABA;LOCAL;TOURISTE;0", "2024-01-01;CABA;LOCAL;TOURISTE;7"]
    put(tmp_path, "a.csv", (head + "\n".join(lines) + "\n").encode())
    facts, stats = load.load_families(spark, {"Nuitee": str(tmp_path)}, alias_frame(spark))
    got = stats.first().asDict()
    assert (got["lues"], got["gardees"], got["sans_volume"], got["rejetees"], got["volume"], got["taux_succes"]) == (5, 2, 1, 2, 12, 40.0)
    assert got["manquants"] == {"date": 1, "zone": 1, "provenance": 0, "categorie": 1}
    assert [r["volume"] for r in facts["Nuitee"].collect()] == [12]
