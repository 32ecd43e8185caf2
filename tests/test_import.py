"""From a sheet of 5,000 people to verdicts and statistics."""

import time

from pyspark.sql import functions as F

from rollcall.operators import answers, store
from rollcall.plans import importing


def people(n):
    return [(f"{chr(65 + i % 26)}{i // 26 % 10}{chr(65 + i // 260 % 26)}{i // 6760 % 10}A1B2", f"24ABC{i:05d}", f"Person {chr(65 + i % 26)}{'abcdefghij'[i // 26 % 10]}{'klmnopqrst'[i // 260 % 10]}{'uvwxyzabcd'[i // 2600]} Name") for i in range(n)]


def sheet(rows, heading):
    grid = [[heading], [], ["S.No", "Name", "Neo ID", "Registration Number"], *([str(i + 1), name, neo, reg] for i, (neo, reg, name) in enumerate(rows))]
    return [(r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row) if t]


def test_import_and_answer(spark):
    everyone = people(5000)
    files = {"acme_test_list.xlsx": sheet(everyone, "Acme test list"), "acme final.xlsx": sheet(everyone[:400], "Acme final list"), "copy of acme final.xlsx": sheet(everyone[:400], "x"), "notes.xlsx": [(0, 0, "hello")]}
    cells = spark.createDataFrame([(f, 0, "S", *x) for f, grid in files.items() for x in grid], "file_id string, sheet_idx int, sheet string, row int, col int, text string").cache()
    stored = spark.createDataFrame([], "content_hash string")
    start = time.time()
    got = importing.import_lists(cells, stored, 1, F.concat(F.lit("2026-01-0"), F.col("drive_id").cast("string")))
    drives = got.drives.cache()
    # the smaller list came first by name; as imported later it is the second round
    rows = {r.filename: r for r in drives.collect()}
    assert set(rows) == {"acme final.xlsx", "acme_test_list.xlsx"} and {r.company for r in rows.values()} == {"Acme"}
    assert rows["acme_test_list.xlsx"].total_students == 5000 and rows["acme final.xlsx"].round_label == "Final"
    assert {r.file_id for r in got.skipped.collect()} == {"copy of acme final.xlsx", "notes.xlsx"}
    late = drives.withColumn("imported_at", F.when(F.col("total_students") == 400, "2026-02-01").otherwise("2026-01-01"))
    academics = spark.createDataFrame([(reg, 6.0 + i % 400 / 100, "cse") for i, (_, reg, _) in enumerate(everyone)], "reg_no string, cgpa double, branch string")
    subjects = spark.createDataFrame([(1, everyone[0][0], None), (2, everyone[4999][0], None), (3, None, everyone[0][1])], "subject_id long, neo_id string, reg_no string")
    told, stats = importing.outcomes(subjects, late, got.members, got.edges, academics, academics.withColumn("cohort", F.lit("24")))
    small = rows["acme final.xlsx"].drive_id
    verdicts = {(r.subject_id, r.drive_id == small): (r.status, r.label) for r in told.collect()}
    assert verdicts[1, True] == ("shortlisted", "Final") and verdicts[2, True] == ("not_shortlisted", "Final") and verdicts[2, False] == ("shortlisted", "Test")
    assert verdicts[3, True][0] == "undetermined"
    assert {r.drive_id == small: (r.matched, r.sufficient, r.kind) for r in stats.collect()} == {True: (400, True, "no_cgpa_filter"), False: (5000, True, "no_cgpa_filter")}
    print(f"import and answer: {time.time() - start:.1f} s")


def test_pasted_and_reference(spark):
    files, members = importing.import_pasted(spark.createDataFrame([("p", "Acme round 2\nA1B2C3D4 and 24ABC1234\nB1B2C3D4")], "file_id string, text string"))
    f = files.first()
    assert (f.n_neo, f.n_reg, f.shape, f.primary_key, f.unread_lines) == (2, 1, "neo_id_only", "neo_id", 1) and members.count() == 3
    cells = spark.createDataFrame([("a", 0, "S", r, c, t) for r, row in enumerate([["Reg", "CGPA"], ["24ABC1234", "8.1"], ["24ABC1235", "x"]]) for c, t in enumerate(row)] + [("b", 0, "S", 0, 0, "A1B2C3D4")], "file_id string, sheet_idx int, sheet string, row int, col int, text string")
    rows, rest = importing.route_reference(cells)
    assert rows.count() == 2 and {r.file_id for r in rest.collect()} == {"b"}


def test_older_names_are_upgraded(spark):
    d = spark.createDataFrame([("acme_shortlist.xlsx", "acme", None), ("acme_shortlist_round_2.xlsx", "My own", None), ("x_final.xlsx", "X", "R1")], "filename string, company string, round_label string")
    meta = spark.createDataFrame([], "key string, value string")
    assert [tuple(r)[1:] for r in answers.upgrade_names(d, meta).collect()] == [("Acme", None), ("My own", "R2"), ("X", "R1")]
    done = answers.set_meta(meta, answers.NAMES_UPGRADED, "1")
    assert answers.upgrade_names(d, done).first().company == "acme" and answers.set_meta(done, answers.NAMES_UPGRADED, None).isEmpty()


def test_numbers_follow_the_order_of_keys(spark):
    rows = spark.range(2000).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("file_id"), "id").repartition(7)
    assert all(r.number == 10 + r.id for r in store.numbered(rows, "file_id", 10).collect())
    assert store.numbered(rows.limit(0), "file_id", 1).count() == 0


def test_places_are_filled_in_where_a_subject_is_listed(spark):
    drives = spark.createDataFrame([(1, "neo_id"), (2, "neo_id"), (3, "reg_no")], "drive_id long, primary_key string")
    members = spark.createDataFrame([(1, "neo_id", "A"), (2, "neo_id", "A"), (3, "neo_id", "A")], "drive_id long, kind string, value string")
    origin = "drive_id long, kind string, value string, sheet string, row long"
    origins = spark.createDataFrame([(2, "neo_id", "A", "S", 4)], origin)
    found = spark.createDataFrame([(d, "neo_id", v, "S", r) for d in (1, 2, 3) for v, r in (("A", 4), ("B", 5))], origin)
    new = answers.backfill_origins(drives, members, origins, spark.createDataFrame([("neo_id", "A")], "kind string, value string"), found)
    assert sorted((r.drive_id, r.value) for r in new.collect()) == [(1, "A"), (1, "B")]


def test_rounds_are_linked_once(spark):
    d = spark.createDataFrame([(1, "Acme", "2026-01-01", None), (2, "Acme", "2026-01-02", None)], "drive_id long, company string, imported_at string, parent_drive_id long")
    m = spark.createDataFrame([(k, "neo_id", f"A{x}") for k in (1, 2) for x in range(5)], "drive_id long, kind string, value string")
    meta = spark.createDataFrame([], "key string, value string")
    assert {r.drive_id: r.parent_drive_id for r in answers.link_existing_rounds(d, m, meta).collect()} == {1: None, 2: 1}
    assert {r.parent_drive_id for r in answers.link_existing_rounds(d, m, answers.set_meta(meta, answers.ROUNDS_LINKED, "1")).collect()} == {None}


def test_a_pack_is_loaded_once_a_version(spark):
    pack = {
        "edges": spark.createDataFrame([("A1B2C3D4", "23ABC1234", 3), ("A1B2C3D4", "23ABC1234", 1), ("B1B2C3D4", None, 3)], "neo_id string, reg_no string, confidence int"),
        "names": spark.createDataFrame([("ann lee", "Ann Lee"), ("bob ray", "Bob Ray")], "name_key string, display string"),
        "academics": spark.createDataFrame([("23ABC1234", 8.5, "cse")], "reg_no string, cgpa double, branch string"),
        "baseline": spark.createDataFrame([(7.5, "it")], "cgpa double, branch string"),
    }
    tables = {"edges": spark.createDataFrame([], "a_kind string, a_value string, b_kind string, b_value string, source string"), "spellings": spark.createDataFrame([("bob ray",)], "name_key string")}
    meta = spark.createDataFrame([], "key string, value string")
    got = answers.seed(meta, 4, pack, tables)
    assert [tuple(r)[-1] for r in got["edges"].collect()] == [3] and [r.display for r in got["spellings"].collect()] == ["Ann Lee"]
    assert got["baseline"].first().cohort == "23" and answers.seed_report(got) == {"students": 1, "academics": 1, "already_seeded": False}
    assert answers.seed(got["meta"], 4, pack, tables) is None and answers.seed(got["meta"], 5, pack, tables) is not None
    assert answers.seed_report(None)["already_seeded"]


def test_snapshots_are_moved_into_place(spark, tmp_path):
    for text in ("one", "two"):
        answers.write_snapshot(spark.createDataFrame([(text,)], "document string"), str(tmp_path))
        assert (tmp_path / "snapshot.json").read_text() == text + "\n"
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["snapshot.json"]


def test_a_pack_is_built_and_links_names(spark):
    """A sheet with grades knows names of registration numbers, a roster those of primary identifiers."""
    from rollcall.plans import importing

    grades = [["Reg No", "Student Name", "CGPA", "Branch"], ["24ABC1001", "Ravi Shah", "8.1", "CSE"], ["24ABC1002", "Anita Rao", "7.5", "ECE"], ["24ABC1003", "Meera Iyer", "x", ""], ["24ABC1004", "Asha Nair", "9.0", "IT"], ["24ABC1005", "Asha Nair", "6.0", "IT"]]
    roster = [["Neo ID", "Student Name"], ["A1B2C3D4", "Shah Ravi"], ["B1B2C3D4", "Anitha Rao"], ["C1B2C3D4", "Asha Nair"], ["D1B2C3D4", "Nobody Known"]]
    linked = [["Neo ID", "Reg No", "Name"], ["E1B2C3D4", "24ABC1003", "Meera Iyer"], ["F1B2C3D4", "24ABC1009", "Zoya Khan"]]
    files = {"grades.xlsx": grades, "roster.xlsx": roster, "linked.xlsx": linked, "notes.txt": [["nothing here"]]}
    cells = spark.createDataFrame([(f, 0, "S", r, c, t) for f, grid in files.items() for r, row in enumerate(grid) for c, t in enumerate(row) if t], "file_id string, sheet_idx int, sheet string, row int, col int, text string")
    made = importing.build_reference(cells)
    edges = {(r.neo_id, r.reg_no, r.confidence) for r in made.pack["edges"].collect()}
    assert {e[:2] for e in edges} == {("A1B2C3D4", "24ABC1001"), ("B1B2C3D4", "24ABC1002"), ("E1B2C3D4", "24ABC1003"), ("F1B2C3D4", "24ABC1009")}
    assert {e[2] for e in edges if e[0] in ("E1B2C3D4", "F1B2C3D4")} == {"verified"} and ("A1B2C3D4", "24ABC1001", "high") in edges and ("B1B2C3D4", "24ABC1002", "probable") in edges
    assert tuple(made.report.first()) == (1, 1, 1, 1)
    assert {(r.file_id, r.kind) for r in made.sources.collect()} == {("grades.xlsx", "academics"), ("roster.xlsx", "list"), ("linked.xlsx", "list")}
    assert {(r.reg_no, r.cgpa) for r in made.pack["academics"].collect()} == {("24ABC1001", 8.1), ("24ABC1002", 7.5), ("24ABC1003", None), ("24ABC1004", 9.0), ("24ABC1005", 6.0)}
    assert {r.name_key for r in made.pack["names"].collect()} >= {"ravi shah", "anita rao", "asha nair"} and made.pack["baseline"].count() == 5


def test_packs_are_opened(spark):
    import json
    import zlib

    from rollcall.sources import sheets

    body = {"version": 1, "sources": ["a"], "edges": [["A1B2C3D4", "24ABC1001", "verified"]], "name_edges": [["A1B2C3D4", "ravi shah", "high"]], "names": {"ravi shah": "Ravi Shah"}, "academics": [["24ABC1001", 8.1, "CSE"], ["24ABC1002", None, None]], "baseline_cgpa": [7.5, 8.0], "baseline_branch": ["IT"]}

    def packed(value, seed=None, magic=b"PK01"):
        press = zlib.compressobj(9, zlib.DEFLATED, -15)
        raw = press.compress(value.encode() if isinstance(value, str) else json.dumps(value).encode()) + press.flush()
        return bytearray(magic + (sheets._unmasked(raw, seed) if seed else raw))

    plain = packed(body)
    files = {"good": plain, "cut": plain[:-6], "other": packed(body, magic=b"XX00"), "later": packed(body | {"version": 2}), "text": packed("not json"), "bare": packed({"edges": []}), "empty": bytearray(), "bomb": packed("0" * ((64 << 20) + 5))}
    got = {r.path: (r.value is not None, r.error) for r in sheets.open_packs(spark.createDataFrame(list(files.items()), "path string, content binary"), b"PK01").collect()}
    assert got == {"good": (True, None), "cut": (False, "a damaged reference pack"), "other": (False, "not a reference pack"), "later": (False, "unknown version 2"), "text": (False, "not JSON"), "bare": (False, "no version"), "empty": (False, "not a reference pack"), "bomb": (False, "too large")}
    hidden = sheets.open_packs(spark.createDataFrame([("m", packed(body, 99)), ("plain", plain)], "path string, content binary"), b"PK01", 99)
    assert {r.path for r in hidden.collect() if r.error is None} == {"m"}
    tables = sheets.read_pack(hidden)
    assert [tuple(r) for r in tables["edges"].collect()] == [("A1B2C3D4", "24ABC1001", "verified", 0)] and tables["name_edges"].count() == 1
    assert [(r.reg_no, r.cgpa) for r in tables["academics"].orderBy("seq").collect()] == [("24ABC1001", 8.1), ("24ABC1002", None)]
    assert [(r.cgpa, r.branch) for r in tables["baseline"].orderBy("seq").collect()] == [(7.5, "IT"), (8.0, None)]
