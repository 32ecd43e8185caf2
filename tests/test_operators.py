"""Set-based operators on small tables: the traps of the data model, each named after its number."""

import random
import zipfile

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.operators import analytics as A
from rollcall.operators import documents as D
from rollcall.operators import identity as I
from rollcall.operators import ingest as G
from rollcall.operators import matching as M
from rollcall.operators import rounds as R
from rollcall.operators import store as S
from rollcall.operators import verdicts as W
from rollcall.operators.components import connected_components
from rollcall.session import saved
from rollcall.sources import sheets

N1, N2, N3 = "A1B2C3D4", "B1B2C3D4", "C1B2C3D4"
R1, R2 = "24ABC1234", "24ABC1235"
DRIVES = "drive_id long, company string, imported_at string, shape string, primary_key string, total_students long, round_label string, parent_drive_id long"


def test_t1_verdicts(spark):
    subjects = spark.createDataFrame([(1, N1, None), (2, None, R1), (3, None, None), (4, " a1b2c3d4 ", "bad")], "subject_id long, neo_id string, reg_no string")
    drives = spark.createDataFrame([(1, "c", "t", "neo_id_only", "neo_id", 1, None, None), (2, "c", "t", "reg_no_only", "reg_no", 1, None, None), (3, "c", "t", "unrecognised", "neo_id", 0, None, None), (4, "c", "t", "linked", None, 0, None, None)], DRIVES)
    members = spark.createDataFrame([(1, "neo_id", N1), (1, "neo_id", N1), (2, "reg_no", R2)], "drive_id long, kind string, value string")
    got = {(r.subject_id, r.drive_id): (r.status, r.reason) for r in W.membership(subjects, drives, members).collect()}
    assert len(got) == 16
    assert got[1, 1] == got[4, 1] == (W.IN, None)
    assert got[2, 2] == (W.OUT, None)
    assert got[1, 2] == got[4, 2] == got[2, 1] == (W.UNKNOWN, "key_kind_not_configured")
    assert got[3, 1] == (W.UNKNOWN, "no_identity_configured")
    assert got[1, 3] == got[3, 4] == (W.UNKNOWN, "file_not_understood")
    count = lambda key, at: {s: sum(v[0] == s for k, v in got.items() if k[at] == key) for s in (W.IN, W.OUT, W.UNKNOWN)}
    for r in W.season(subjects, drives, members).collect():
        assert {W.IN: r.shortlisted, W.OUT: r.not_shortlisted, W.UNKNOWN: r.undetermined} == count(r.subject_id, 0)
    people = subjects.withColumn("label", F.concat(F.lit("p"), 9 - F.col("subject_id")))
    order = {W.IN: 0, W.UNKNOWN: 1, W.OUT: 2}
    for r in W.circle(people, drives, members, top=2).collect():
        assert (r.total, {W.IN: r.shortlisted, W.OUT: r.not_shortlisted, W.UNKNOWN: r.undetermined}) == (4, count(r.drive_id, 1))
        shown = sorted((order[v[0]], f"p{9 - s}", v[0]) for (s, d), v in got.items() if d == r.drive_id)[:2]
        assert r.members == ";".join(f"{label}={status}" for _, label, status in shown)


def batch():
    blocks = ((40, 6.6, 14, 0.1), (460, 8.0, 50, 0.01), (760, 8.5, 50, 0.01), (620, 9.0, 50, 0.01), (120, 9.5, 45, 0.01))
    return [base + (i % m) * step for n, base, m, step in blocks for i in range(n)]


def drive(spark, values, number=1):
    return spark.createDataFrame([(number, float(x)) for x in values], "drive_id long, cgpa double")


def test_t2_t3_t4_distribution_of_a_batch(spark):
    rows = drive(spark, batch())
    d = A.distribution(rows, ["drive_id"]).first()
    assert (d.n, d.min, d.max) == (2000, 6.6, pytest.approx(9.94))
    assert (d.mean, d.std_dev) == (pytest.approx(8.808375), pytest.approx(0.50520947))
    assert [d.p5, d.p25, d.median, d.p75] == [pytest.approx(x) for x in (8.06, 8.5, 8.82, 9.18)]
    counts = [r["count"] for r in A.histogram(rows, ["drive_id"]).orderBy("bucket").collect()]
    assert counts == [0, 0, 6, 6, 9, 6, 9, 4, 235, 225, 385, 375, 320, 300, 75, 45]
    assert A.trimmed(A.histogram(rows, ["drive_id"]), ["drive_id"]).count() == 14


def test_t2_is_no_library_percentile(spark):
    d = A.distribution(drive(spark, range(1, 11)), ["drive_id"]).first()
    assert (d.p25, d.median, d.std_dev) == (3.0, 6.0, pytest.approx(2.8722813))


def test_t6_batch_floor(spark):
    assert A.floor_of(drive(spark, batch()), []).first()[0] == pytest.approx(8.05)


@pytest.mark.parametrize("values,kind,threshold", [
    ([8.94] + [9.0 + (i % 8) * 0.08 for i in range(24)], "hard_cutoff", 9.0),
    ([9.0 + (i % 20) * 0.04 for i in range(60)], "hard_cutoff", 9.0),
    (batch(), "no_cgpa_filter", None),
    ([8.94] + [9.0 + (i % 40) * 0.02 for i in range(818)], "hard_cutoff", 9.0),
])
def test_cutoffs(spark, values, kind, threshold):
    got = A.cutoff(drive(spark, values), drive(spark, batch())).first()
    assert (got.kind, got.threshold) == (kind, threshold)


def test_branch_lift(spark):
    ours = spark.createDataFrame([(1, "ece")] * 8 + [(1, "cse")] * 16 + [(1, None)], "drive_id long, branch string")
    base = spark.createDataFrame([("ece",)] * 75 + [("cse",)] * 925 + [(None,)], "branch string")
    rows = {r.branch: r for r in A.branch_lift(ours, base).collect()}
    assert rows["ECE"].lift > 3 and rows["Unknown"].baseline_share == 0 and rows["Unknown"].lift is None
    assert A.over_represented(A.branch_lift(ours, base)).first().statement == "ECE is over-represented against the batch."


def test_t20_coverage_may_exceed_one(spark):
    members = spark.createDataFrame([(1, "neo_id", N1), (1, "reg_no", R2)], "drive_id long, kind string, value string")
    links = spark.createDataFrame([(N1, R1, 3)], "neo_id string, reg_no string, confidence int")
    facts = spark.createDataFrame([(R1, 8.0, "cse"), (R2, 9.0, "cse")], "reg_no string, cgpa double, branch string")
    g = A.gate(members, A.matched(members, links, facts)).first()
    assert (g.matched, g.total, g.coverage, g.sufficient) == (2, 1, 2.0, False)


def test_rounds_chain_and_cycle(spark):
    people = [f"{chr(65 + i % 26)}{i % 10}B{i // 10 % 10}C1D1" for i in range(40)]
    drives = spark.createDataFrame([(1, "Acme", "2026-01-01", "neo_id_only", "neo_id", 40, None, None), (2, "acme!", "2026-02-01", "neo_id_only", "neo_id", 20, None, None), (3, "Acme", "2026-03-01", "neo_id_only", "neo_id", 8, "Final", None), (4, "Other", "2026-03-01", "neo_id_only", "neo_id", 8, None, None), (5, "Acme", "2026-04-01", "neo_id_only", "neo_id", 8, None, None)], DRIVES)
    new = [f"Z9Z9Z{i}Z9" for i in range(8)]
    members = spark.createDataFrame([(1, "neo_id", p) for p in people] + [(2, "neo_id", p) for p in people[:20]] + [(d, "neo_id", p) for d in (3, 4) for p in people[:8]] + [(5, "neo_id", p) for p in people[:2] + new[:6]], "drive_id long, kind string, value string")
    linked = R.link_rounds(drives, members)
    assert {r.drive_id: r.parent_drive_id for r in linked.collect()} == {1: None, 2: 1, 3: 2, 4: None, 5: None}
    assert {r.drive_id: r.label for r in R.round_labels(linked).collect()} == {1: "R1", 2: "R2", 3: "Final"}
    verdicts = spark.createDataFrame([(9, d, "shortlisted") for d in range(1, 6)], "subject_id long, drive_id long, status string")
    got = {r.drive_id: (r.steps, r.next_pending) for r in R.progression(linked, verdicts).collect()}
    assert got[2] == got[1] == ("R1=shortlisted>R2=shortlisted>Final=shortlisted", False) and 5 not in got
    ring = spark.createDataFrame([(1, "a", "t1", "", "", 1, None, 2), (2, "a", "t2", "", "", 1, None, 1)], DRIVES)
    assert {r.label for r in R.round_labels(ring).collect()} == {"R2"}
    pairs = spark.createDataFrame([(1, 2)], "from_id long, to_id long")
    assert {r.change: r["count"] for r in R.compare_rounds(pairs, members).groupBy("change").count().collect()} == {"advanced": 20, "dropped": 20}


EDGES = "a_kind string, a_value string, b_kind string, b_value string, confidence int, source string, seq long"


def test_t7_t8_t9_t10_components(spark):
    rows = [("neo_id", N1, "reg_no", R1, 3, "a", 1), ("neo_id", N1, "reg_no", R1, 1, "b", 2), ("neo_id", N2, "reg_no", R2, 0, "a", 3), ("neo_id", N2, "name", "x y", 2, "a", 4), ("neo_id", N3, "name", "x y", 2, "a", 5), ("neo_id", N1, "reg_no", R1, 0, "a", 6)]
    edges = I.dedup_edges(spark.createDataFrame(rows, EDGES))
    assert edges.count() == 5
    got = {r.node: (r.component, r.confidence, r.conflicted) for r in I.components(edges).collect()}
    assert got[f"neo_id:{N1}"] == got[f"reg_no:{R1}"] == (f"neo_id:{N1}", 1, False)
    assert got[f"neo_id:{N2}"] == (f"neo_id:{N2}", 3, False) and got[f"neo_id:{N3}"][0] == f"neo_id:{N3}"
    two = spark.createDataFrame([("neo_id", N1, "reg_no", R1, 3, "a", 1), ("neo_id", N1, "reg_no", R2, 3, "a", 2)], EDGES)
    assert all(r.conflicted for r in I.components(two).collect()) and I.resolve(two).count() == 0


def test_t11_best_name_takes_the_greatest_key(spark):
    rows = [("neo_id", N1, "name", k, c, "a", i) for i, (k, c) in enumerate([("ann b", 2), ("zoe c", 2), ("zzz z", 1)])]
    assert I.resolve(spark.createDataFrame(rows, EDGES)).first().name_key == "zoe c"


def test_components_of_long_chains_and_crowds(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1001 + i) for i in range(300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + star + [(5, 5), (None, 3)], "src long, dst long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1001 + i] for i in range(300)} == {1000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pairs_are_made_after_the_joins(spark):
    """Subjects meet the lists that have them before they meet all lists, so no join carries a row for each pair."""
    subjects = spark.createDataFrame([(1, N1, None), (2, None, R1), (3, N2, R2), (4, None, None)], "subject_id long, neo_id string, reg_no string")
    drives = spark.createDataFrame([(1, "c", "t", "neo_id_only", "neo_id", 1, None, None), (2, "c", "t", "reg_no_only", "reg_no", 1, None, None)], DRIVES)
    members = spark.createDataFrame([(1, "neo_id", N1), (1, "neo_id", N1), (1, "reg_no", R2), (2, "reg_no", R2), (2, "reg_no", None)], "drive_id long, kind string, value string")
    told = W.membership(subjects, drives, members)
    joins = [line for line in told._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "Cross" in joins[0] and len(joins) == 3
    got = {(r.subject_id, r.drive_id): (r.status, r.reason) for r in told.collect()}
    lacks, none = ("undetermined", "key_kind_not_configured"), ("undetermined", "no_identity_configured")
    assert got == {(1, 1): ("shortlisted", None), (1, 2): lacks, (2, 1): lacks, (2, 2): ("not_shortlisted", None), (3, 1): ("not_shortlisted", None), (3, 2): ("shortlisted", None), (4, 1): none, (4, 2): none}


def test_edges_are_thinned_before_the_rounds(spark, monkeypatch):
    """What the rounds carry is bounded by the nodes that a task reads, not by its edges; components stay the same."""
    from rollcall.operators import components as C

    sizes, keep = [], C.saved

    def spy(df, name):
        out = keep(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(C, "saved", spy)
    rng = random.Random(3)
    rows = [(f"P{rng.randrange(60) + 100 * k}", f"S{rng.randrange(40) + 100 * k}") for k in range(3) for _ in range(4_000)] + [("S1", "S1"), (None, "S2")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src string, dst string").coalesce(2)).collect()}
    assert sizes[0] < 2 * len(got) == 600
    for k in range(3):
        nodes = {n for n in got if int(n[1:]) // 100 == k}
        assert len(nodes) == 100 and {got[n] for n in nodes} == {min(nodes)}
    thinned = list(C._thinned(iter([pa.record_batch([pa.array([1, 2, 3, 7], pa.int64()), pa.array([2, 3, 1, 8], pa.int64())], ["u", "v"])])))
    assert sorted(map(tuple, (r.values() for b in thinned for r in b.to_pylist()))) == [(2, 1), (3, 1), (8, 7)]


CORPUS = "payload string, display string"


def test_matching_gate(spark):
    corpus = spark.createDataFrame([("1", "Ravi Kumar Shah"), ("2", "Anita Rao"), ("3", "Anita Rao"), ("4", "Soham Sinha"), ("5", "Meera Iyer"), ("5", "Meera S Iyer")], CORPUS)
    asked = spark.createDataFrame([(1, "Shah Ravi"), (2, "Anita Rao"), (3, "Akash Sinha"), (4, "Iyer Meera"), (5, "Ravvi Kumar Shah"), (6, "")], "query_id long, query string")
    got = {r.query_id: (r.outcome, r.payload, r.confidence) for r in M.match(asked, corpus).collect()}
    assert got == {1: ("matched", "1", 1), 2: ("ambiguous", None, 0), 3: ("no_match", None, 0), 4: ("matched", "5", 2), 5: ("matched", "1", 1), 6: ("no_match", None, 0)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abcdefghij", min_size=3, max_size=8), st.text("klmnopqrst", min_size=3, max_size=8)), min_size=1, max_size=6, unique=True))
def test_a_unique_exact_name_matches_and_a_repeated_one_is_ambiguous(spark, people):
    corpus = spark.createDataFrame([(str(i), f"{a} {b}") for i, (a, b) in enumerate(people)] + [("twin", " ".join(people[0]))], CORPUS)
    asked = spark.createDataFrame([(i, f"{b.upper()},  {a}") for i, (a, b) in enumerate(people)], "query_id long, query string")
    got = {r.query_id: (r.outcome, r.confidence) for r in M.match(asked, corpus).collect()}
    assert got.pop(0)[0] == "ambiguous" and all(v == ("matched", 2) for v in got.values())


CELLS = "file_id string, sheet_idx int, sheet string, row int, col int, text string"


def cells(spark, grid, file_id="f"):
    return spark.createDataFrame([(file_id, 0, "Sheet1", r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row) if t], CELLS)


GRID = [["Acme list of candidates"], [], ["S.No", "NEO ID", "Register Number", "Name", "Venue"], ["1", N1, R1, "Ravi Shah", "Main Hall"], ["2", N2, R2, "Anita Rao", "Main Hall"], ["3", N3, "", "Meera Iyer", "Main Hall"], ["4", "x", "", "Zed Who", "Main Hall"]]


def test_election_and_parsing(spark):
    c = cells(spark, GRID)
    layout = G.elect(G.column_stats(c))
    assert layout.select("neo_col", "reg_col", "name_col").first()[:] == (1, 2, 3)
    parsed = G.extract(c, layout)
    assert parsed.count() == 3
    f = G.files(parsed).first()
    assert (f.n_neo, f.n_reg, f.shape, f.primary_key, f.student_count) == (3, 2, "linked", "neo_id", 3)
    assert [r.title for r in G.titles(c, layout).collect()] == ["Acme list of candidates"]
    at = {r.value: (r.row, r.column, r.header) for r in G.origins(parsed, layout, c).collect()}
    assert at[N1] == (4, "B", "NEO ID") and at[R2] == (5, "C", "Register Number")


def test_t11_the_rightmost_column_wins_a_tie(spark):
    grid = [[N1, N2], [N2, N1]]
    assert G.elect(G.column_stats(cells(spark, grid))).first().neo_col == 1


def test_academic_sheet(spark):
    grid = [["Reg No", "Name", "Gender", "CGPA", "Brach"], [R1, "Ravi Shah", "Male", "8.5", "CSE"], [R2, "Anita Rao", "Male", "87.0", ""]]
    got = {r.reg_no: (r.name, r.cgpa, r.branch) for r in G.academic_rows(cells(spark, grid)).collect()}
    assert got == {R1: ("Ravi Shah", 8.5, "CSE"), R2: ("Anita Rao", None, None)}
    assert G.academic_rows(cells(spark, [["Reg No"], [R1], [R2]])).count() == 0


def test_pasted_text(spark):
    text = f"Shortlist for Acme\n1. {N1.lower()}\n2) {N2} and {R1}\n{N1}\nsee you\n--"
    t = spark.createDataFrame([("p", text)], "file_id string, text string")
    rows = G.pasted_rows(t).orderBy("line", "at").collect()
    assert [(r.line, r.kind, r.value) for r in rows] == [(2, "neo_id", N1), (3, "neo_id", N2), (3, "reg_no", R1), (4, "neo_id", N1)]
    assert G.pasted_titles(t).first()[1:] == (2, ["Shortlist for Acme", "see you"])


def test_csv_grids():
    assert sheets.csv_grid('a,"b,c","d ""x"""\r\n1, 2 ,3') == [["a", "b,c", 'd "x"'], ["1", "2", "3"]]
    assert sheets.delimiter("a;b;c\n1,2") == ";" and sheets.delimiter("a\tb;c") == "\t" and sheets.delimiter("abc") == "\t"


def test_long_sheets_say_what_was_left_out(spark):
    rows = [("a.csv", bytearray(b"\n".join(b"a,b,c,d" for _ in range(9)))), ("b.csv", bytearray(b'x,"' + b'" "" ' * 50_000 + b'"'))]
    got = sheets.cells_of(spark.createDataFrame(rows, "path string, content binary"), max_rows=5, max_cols=3).collect()
    of = [r for r in got if r.file_id == "a.csv"]
    assert sum(r.error is None for r in of) == 15 and {r.error for r in of if r.error} == {"4 rows beyond the first 5 left out", "1 columns beyond the first 3 left out"}
    assert sheets._letters(0) == "A" and sheets._letters(25) == "Z" and sheets._letters(26) == "AA" and sheets._letters(701) == "ZZ" and sheets._letters(702) == "AAA"


def test_pastes_without_identifiers_are_refused(spark):
    t = spark.createDataFrame([(1, "A1B2C3D4"), (2, "nothing"), (3, None), (4, "A1B2C3D4 " * 200_000)], "file_id long, text string")
    assert {r.file_id: r.error for r in G.pasted_errors(t).collect()} == {2: "no_identifiers", 3: "no_identifiers", 4: "too_large"}


def test_workbooks_go_round(spark, tmp_path):
    sheets.write_xlsx(str(tmp_path / "a.xlsx"), "A & B", iter([["Neo ID", "Name"], [N1, "Ravi <Shah>"]]))
    (tmp_path / "b.csv").write_text(f"id;name\n{N2};Anita")
    (tmp_path / "c.xlsx").write_bytes(b"not a zip")
    (tmp_path / ".hidden.csv").write_text("x")
    got = sheets.read_folder(spark, str(tmp_path)).collect()
    cells_ = {(r.file_id.rpartition("/")[2], r.row, r.col): r.text for r in got if r.error is None}
    assert cells_[("a.xlsx", 1, 1)] == "Ravi <Shah>" and cells_[("b.csv", 1, 0)] == N2 and len(cells_) == 8
    assert [r.file_id.rpartition("/")[2] for r in got if r.error] == ["c.xlsx"]
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert b"autoFilter" in z.read("xl/worksheets/sheet1.xml")


def test_numbers_and_shared_strings(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="/xl/worksheets/s.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>he</t><r><t>llo</t></r></si></sst>")
        z.writestr("xl/worksheets/s.xml", '<w><sheetData><row><c r="C5" t="s"><v>0</v></c><c r="AA5"><v>12.0</v></c><c r="AB5"><v>8.25</v></c><c r="AC5" t="e"><v>#N/A</v></c></row></sheetData></w>')
    assert list(sheets.xlsx_cells((tmp_path / "x.xlsx").read_bytes())) == [(0, "S", 4, 2, "hello"), (0, "S", 4, 26, "12"), (0, "S", 4, 27, "8.25")]


def test_upserts_and_deletes(spark):
    schema = "reg_no string, cgpa double, branch string, cohort string, source string, seq long"
    old = spark.createDataFrame([(R1, 8.0, None, "24", "a", 1)], schema)
    new = spark.createDataFrame([(R1, None, "CSE", "25", "b", 2), (R1, 9.0, None, "25", "b", 3), (R2, None, None, "24", "b", 4)], schema)
    got = {r.reg_no: (r.cgpa, r.branch, r.cohort, r.source) for r in S.upsert_academics(old, new).collect()}
    assert got == {R1: (9.0, "CSE", "24", "a"), R2: (None, None, "24", "b")}
    drives = spark.createDataFrame([(1, None), (2, 1)], "drive_id long, parent_drive_id long")
    members = spark.createDataFrame([(1, "x"), (2, "y")], "drive_id long, value string")
    left, children = S.delete_drives(drives, {"members": members}, spark.createDataFrame([(1,)], "drive_id long"))
    assert left.collect()[0][:] == (2, None) and children["members"].count() == 1


def test_long_chains_are_doubled(spark, monkeypatch):
    """A chain of 1,000 lists, a tree and rings: few rounds, and the paths of a plain walk."""
    n = 1_000
    rows = [(k, k - 1 if k > 1 else None) for k in range(1, n + 1)]
    rows += [(2_000, None), (2_001, 2_000), (2_002, 2_000), (2_003, 2_002), (2_004, 2_001), (2_005, 9_999)]
    rows += [(3_000, 3_002), (3_001, 3_000), (3_002, 3_001), (3_003, 3_001), (3_004, 3_003), (3_005, 3_005)]
    drives = spark.createDataFrame([(k, f"2026-{k:06d}", p, "Final" if k == 500 else None) for k, p in rows], "drive_id long, imported_at string, parent_drive_id long, round_label string").repartition(4)
    parent = dict(rows)
    writes = []
    monkeypatch.setattr(R, "saved", lambda df, name, *a: writes.append(name) or saved(df, name, *a))

    def up(k):
        path = [k]
        while parent.get(path[-1]) in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        return path

    def down(k):
        path = up(k)[::-1]
        while kids := [c for c, p in rows if p == path[-1] and c not in path]:
            path.append(max(kids))
        return path

    got = {r.drive_id: r.path for r in R._ancestors(drives).collect()}
    assert got == {k: up(k) for k in parent} and len(writes) <= 12
    labels = {r.drive_id: r.label for r in R.round_labels(drives).collect()}
    assert labels[1] == "R1" and labels[999] == "R999" and labels[500] == "Final" and 2_005 not in labels or labels[2_005]
    few = drives.where("drive_id > 1500")
    verdicts = spark.createDataFrame([(1, k, "shortlisted") for k in parent], "subject_id long, drive_id long, status string")
    steps = {r.drive_id: r.steps.count(">") + 1 for r in R.progression(few, verdicts).collect()}
    assert steps == {k: len(down(k)) for k in parent if k > 1500 and len(down(k)) > 1}


def test_friends_and_profile(spark):
    friends = spark.createDataFrame([(1, "Ann", N1, None, None), (2, "Bob", None, R1, "g")], "friend_id long, label string, neo_id string, reg_no string, group_tag string")
    batch_ = spark.createDataFrame([(1, "Annie", N1, R2, None), (2, "Cy", N3, None, None)], "seq long, label string, neo_id string, reg_no string, group_tag string")
    got = {r.label: (r.neo_id, r.reg_no) for r in S.add_friends(friends, batch_).collect()}
    assert got == {"Annie": (N1, R2), "Bob": (None, R1), "Cy": (N3, None)}
    old = spark.createDataFrame([(8.0, "then")], "cgpa double, cgpa_updated_at string")
    schema = "neo_id string, reg_no string, display_name string, cohort string, cgpa double, now string"
    same = S.save_profile(old, spark.createDataFrame([(N1, R1, "x", None, 8.0, "now")], schema)).first()
    assert (same.cohort, same.cgpa_updated_at) == ("24", "then")
    assert S.save_profile(old, spark.createDataFrame([(N1, R1, "x", None, None, "now")], schema)).first().cgpa_updated_at is None
    assert S.save_profile(old, spark.createDataFrame([(N1, R1, "x", "23", 8.5, "now")], schema)).first().cgpa_updated_at == "now"
    first = S.save_profile(old.limit(0), spark.createDataFrame([(N1, R1, "x", None, 8.0, "now")], schema)).collect()
    assert [(r.cohort, r.cgpa, r.cgpa_updated_at) for r in first] == [("24", 8.0, "now")]


def test_friends_are_taken_row_by_row(spark):
    """Against a plain loop over the rows in order, with chains of identifiers within one batch."""
    rng = random.Random(4)
    some = lambda kind, n: rng.choice([None, *(f"{kind}{k}" for k in range(n))])
    for _ in range(2):
        neos, regs = rng.sample(range(30), 12), rng.sample(range(30), 12)
        there = [(k, f"f{k}", f"n{a}" if k % 3 else None, f"r{b}" if k % 4 else None, "t") for k, (a, b) in enumerate(zip(neos, regs), 1)]
        batch_ = [(k, f"b{k}", some("n", 30), some("r", 30), rng.choice([None, "u"])) for k in range(1, 60)]
        plain = {f[0]: list(f[1:]) for f in there}
        for seq, label, neo, reg, tag in batch_:
            hits = sorted(k for k, f in plain.items() if neo and f[1] == neo or reg and f[2] == reg)
            if hits:
                others = [plain[k] for k in hits[1:]]
                f = plain[hits[0]]
                f[0], f[3] = label, tag
                f[1] = neo if neo and neo not in [x[1] for x in others] else f[1]
                f[2] = reg if reg and reg not in [x[2] for x in others] else f[2]
            else:
                plain[12 + seq] = [label, neo, reg, tag]
        got = S.add_friends(spark.createDataFrame(there, "friend_id long, label string, neo_id string, reg_no string, group_tag string"), spark.createDataFrame(batch_, "seq long, label string, neo_id string, reg_no string, group_tag string").repartition(5))
        assert sorted(map(tuple, got.collect())) == sorted((k, *f) for k, f in plain.items())


def test_t21_excerpts(spark):
    rows = [(1, "neo_id", "v%d" % r, "S", r) for r in (2, 3, 4, 6, 7, 8, 9)] + [(1, "neo_id", "same", "S", 6), (1, "neo_id", "else", "T", 5)]
    o = spark.createDataFrame(rows, "drive_id long, kind string, value string, sheet string, row long")
    at = lambda v: sorted((r.row, r.value) for r in W.excerpt_around(o.where(F.col("value") == v), o).collect())
    assert at("v6") == [(3, "v3"), (4, "v4"), (6, "v6"), (7, "v7"), (8, "v8")]
    assert at("v2") == [(2, "v2"), (3, "v3"), (4, "v4")]


def test_snapshots_read(spark):
    docs = spark.createDataFrame([('{"schema":1}',), ('{"schema":2}',), ("nonsense",), (None,)], "document string")
    assert [r.state for r in D.read_snapshots(docs).collect()] == ["current", "stale", "stale", "missing"]


def test_csv_files_are_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, "B2", None, "Not identified"), (1, "A1", "zoe", "Identified"), (1, "C3", "Ann, A", "Identified"), (1, "A2", None, "Not identified"), (2, "D4", "=cmd", "Identified")], "drive_id long, identifier string, name string, status string")
    D.write_csv(rows, str(tmp_path / "out"))
    text = lambda d: b"".join(p.read_bytes() for p in sorted((tmp_path / "out" / f"drive_id={d}").glob("part-*"))).decode()
    assert text(1).split("\r\n")[:-1] == ["\ufeffNeo ID,Name,Status", 'C3,"Ann, A",Identified', "A1,zoe,Identified", "A2,,Not identified", "B2,,Not identified"]
    assert text(2).count("\r\n") == 2 and "'=cmd" in text(2)


def test_unknown_verdicts_are_no_answers(spark):
    docs = ['{"schema":1,"drives":[{"drive_id":1,"company":"A","verdict":{"status":"shortlisted"}},{"drive_id":2,"company":"B","verdict":{"status":"waitlisted"}}]}', '{"schema":2,"drives":[{"drive_id":3}]}', None]
    got = D.snapshot_verdicts(spark.createDataFrame([(x,) for x in docs], "document string"))
    assert {(r.drive_id, r.status) for r in got.collect()} == {(1, "shortlisted"), (2, "unknown")}


def test_pseudonyms(spark):
    ids = spark.createDataFrame([(N1,), (N2,), (N1,)], "value string")
    got = {r.value: r.alias for r in D.pseudonyms(ids, "k").collect()}
    assert len(set(got.values())) == 2 and got == {r.value: r.alias for r in D.pseudonyms(ids, "k").collect()}
    assert D.leaks(ids, spark.createDataFrame([(N2,)], "value string")).count() == 1


def test_pseudonyms_keep_their_shape_and_stay(spark):
    import re

    ids = [f"{chr(65 + k % 26)}{k % 10}B{k // 10 % 10}C{k // 100 % 10}D{k // 1000 % 10}" for k in range(6_000)] + [f"{20 + k % 7}ABC{k:0{4 + k % 3}d}" for k in range(6_000)] + ["Ravi Shah", ""]
    made = {r.value: r.alias for r in D.pseudonyms(spark.createDataFrame([(x,) for x in ids], "value string"), "k").collect()}
    assert len(set(made.values())) == len(made) == len(set(ids))
    for value, alias in made.items():
        if re.fullmatch("([A-Z][0-9]){4}", value):
            assert re.fullmatch("([A-Z][0-9]){4}", alias)
        elif re.fullmatch("[0-9]{2}[A-Z]{3}[0-9]{4,6}", value):
            assert re.fullmatch("[0-9]{2}[A-Z]{3}[0-9]{4,6}", alias) and alias[:2] == value[:2] and len(alias) == len(value)
        else:
            assert re.fullmatch("[0-9a-f]{64}", alias)
    alone = D.pseudonyms(spark.createDataFrame([(ids[5],), (ids[7_000],)], "value string"), "k").collect()
    assert all(r.alias == made[r.value] for r in alone)  # whatever else is in the table
    other = D.pseudonyms(spark.createDataFrame([(ids[5],)], "value string"), "another key").first().alias
    assert other != made[ids[5]]
    back = spark.createDataFrame([(v, a) for v, a in made.items() if v[:1].isalnum() and " " not in v], "value string, alias string")
    assert back.where(D.shaped_alias(F.col("alias"), "k", back=True) != F.col("value")).count() == 0


def test_a_small_space_is_permuted_whole(spark):
    """All 10,000 numbers of one programme's letters and year: no two share an alias."""
    pairs = spark.range(26 * 40).select((F.col("id") % 26).alias("l"), F.floor(F.col("id") / 26).alias("r"))
    mixed = pairs.select(D._mixed(F.col("l"), F.col("r"), 26, 40, "k", F.lit("t"), False).alias("p")).select("p.*")
    assert mixed.distinct().count() == 26 * 40 and mixed.where("l between 0 and 25 and r between 0 and 39").count() == 26 * 40


def test_documents_of_other_versions_are_read_as_far_as_they_go(spark):
    docs = [
        '{"schema":1,"drives":[{"drive_id":1,"company":"A","verdict":{"status":"shortlisted"},"analysis":{"status":"ready","cutoff":"hard_cutoff","threshold":7.5},"new":{"x":1}}]}',
        '{"schema":1,"drives":[{"drive_id":"two","company":"B","verdict":7,"analysis":{"status":"later","cutoff":"new_kind"}},{"company":"C","verdict":{"status":null,"reason":"r"}},5]}',
        '{"schema":1,"drives":[{"drive_id":3', '{"schema":1,"drives":7}', '{"schema":1}', '{"schema":3,"drives":[{"drive_id":9}]}', "", None,
    ]
    table = spark.createDataFrame([(x,) for x in docs], "document string")
    assert [r.state for r in D.read_snapshots(table).collect()] == ["current", "current", "stale", "current", "current", "stale", "stale", "missing"]
    got = sorted((tuple(r) for r in D.snapshot_verdicts(table).collect()), key=str)
    assert got == sorted([(1, "A", "shortlisted", None, "ready", "hard_cutoff", 7.5), (None, "B", "unknown", None, "unknown", "unknown", None), (None, "C", "unknown", "r", None, None, None), (None, None, "unknown", None, None, None, None)], key=str)


def test_long_chains_of_rounds_are_walked_to_their_end(spark):
    n = 19
    rows = [(k, "c", f"2026-01-{k:02d}", None, k - 1 or None) for k in range(1, n + 1)] + [(50, "c", "2026-02-01", None, 51), (51, "c", "2026-02-02", None, 50)]
    drives = spark.createDataFrame(rows, "drive_id long, company string, imported_at string, round_label string, parent_drive_id long")
    labels = {r.drive_id: r.label for r in R.round_labels(drives).collect()}
    assert labels == {k: f"R{k}" for k in range(1, n + 1)} | {50: "R2", 51: "R2"}
    verdicts = drives.select(F.lit(7).alias("subject_id"), "drive_id", F.when(F.col("drive_id") == n, "not_shortlisted").otherwise("shortlisted").alias("status"))
    told = {r.drive_id: (r.steps, r.next_pending) for r in R.progression(drives, verdicts).collect()}
    line = ">".join(f"R{k}={'not_' if k == n else ''}shortlisted" for k in range(1, n + 1))
    assert all(told[k] == (line, False) for k in range(1, n + 1))
    assert len(told[50][0].split(">")) == 2


@settings(max_examples=400, deadline=None)
@given(st.text("abcde", min_size=1, max_size=15), st.text("abcde", min_size=1, max_size=15), st.integers(0, 6))
def test_similar_tokens_share_a_block(a, b, same):
    b = (a[:same] + b)[:16]
    for x, y in ((a, b), (a, a[:-1] or "a"), (a, a[1:] + a[:1]), (a, a + "e")):
        if max(N.jaro_winkler(x, y), N.jaro_winkler(y, x)) >= N.SIMILAR:
            assert set(N.token_blocks(x)) & set(N.token_blocks(y)), (x, y)


def _brute_match(spark, q, c):
    left, right = M.keyed(q, "query").alias("l"), M.keyed(c, "display").alias("r")
    near = (F.col("l.name_key") == F.col("r.name_key")) | (F.col("l.phonetic") == F.col("r.phonetic")) | F.arrays_overlap("l.tokens", "r.tokens")
    scored = left.crossJoin(right).where(near).withColumn("relation", N.relation(F.col("l.name_key"), F.col("r.name_key"))).where("relation > 0")
    out = {r.query_id: ("no_match", None, 0) for r in q.select("query_id").collect()}
    for r in scored.groupBy("query_id").agg(F.collect_set(F.struct("relation", "payload")).alias("x")).collect():
        top = max(x.relation for x in r.x)
        best = {x.payload for x in r.x if x.relation == top}
        out[r.query_id] = ("ambiguous", None, 0) if len(best) > 1 else ("matched", *best, 2 if top == N.EXACT else 1)
    return out


def test_names_match_under_a_hot_token(spark):
    """A third of all people share a token: the same answers as by brute force, from few pairs."""
    rng = random.Random(9)
    part = lambda: rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") + rng.choice("bdgklmnrst") + rng.choice(["a", "i", "esh", "avi", "un"])
    words = [part() + part() for _ in range(400)]

    def typo(w):
        k = rng.randrange(len(w) - 1)
        return rng.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w])

    people = [("kumar " if k % 3 == 0 else rng.choice(words) + " ") + rng.choice(words) + (" " + rng.choice(words) if k % 5 == 0 else "") for k in range(900)]
    corpus = spark.createDataFrame([(str(k), p) for k, p in enumerate(people)], CORPUS)
    asks = [" ".join(typo(w) if rng.random() < 0.5 else w for w in reversed(rng.choice(people).split())) for _ in range(150)] + [" ".join(rng.choice(people).split()[:2]) for _ in range(30)] + ["kumar", "kumar kumar", "kumar " + words[0] + " " + words[1] + " " + words[2]]
    asked = spark.createDataFrame(list(enumerate(asks)), "query_id long, query string")
    expected = _brute_match(spark, asked, corpus)
    assert {r.query_id: (r.outcome, r.payload, r.confidence) for r in M.match(asked, corpus).collect()} == expected
    assert {x[0] for x in expected.values()} == {"matched", "ambiguous", "no_match"} and sum(x[2] == 1 for x in expected.values()) > 20
    known = M.keyed(corpus, "display").select("name_key", "tokens").distinct()
    mine = M.keyed(asked, "query").select("name_key", "tokens").distinct()
    similar = M.similar_tokens(mine.select(F.explode("tokens").alias("t")).distinct(), known.select(F.explode("tokens").alias("t")).distinct())
    assert similar.where("a = 'kumar'").count() >= 1
    hot = [("kumar " + part() + part()) for _ in range(3_000)]
    many = M.keyed(spark.createDataFrame([(str(k), p) for k, p in enumerate(hot)], CORPUS), "display").select("name_key", "tokens").distinct()
    few = many.limit(300)
    assert M.subset_pairs(few, many).count() == 0 and M.alike_pairs(few, many).count() < 3 * 300


def test_names_match_as_by_brute_force(spark):
    """Every query against every name: exact, subset and fuzzy answers, ambiguous and repeated names."""
    corpus = [("1", "Ravi Kumar Shah"), ("2", "Shah Ravi"), ("3", "Anita Rao"), ("4", "Anita Rao"), ("5", "Anitha Rao"), ("6", "Stephen Lee"), ("6", "Lee Stephen"), ("7", "Steven Li"), ("8", "Meera"), ("9", "Priya Nair"), ("10", "Priya Nayar"), ("11", ""), ("12", "Nair Priya Devi")]
    asked = [(k, q) for k, q in enumerate(["Ravi Shah", "Kumar Ravi Shah", "Anita Rao", "Anitha Rao", "Anitta Rao", "Stephen Lee", "Stefen Lee", "Meera", "Mira", "Priya Nair", "Priya", "Nobody Here", "", "Nayar Priya", "Devi Nair"])]
    q, c = spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(corpus, "payload string, display string")
    left, right = M.keyed(q, "query").alias("l"), M.keyed(c, "display").alias("r")
    near = (F.col("l.name_key") == F.col("r.name_key")) | (F.col("l.phonetic") == F.col("r.phonetic")) | F.arrays_overlap("l.tokens", "r.tokens")
    scored = left.crossJoin(right).where(near).withColumn("relation", N.relation(F.col("l.name_key"), F.col("r.name_key"))).collect()
    expected = {}
    for k, _ in asked:
        mine = [(r.relation, r.payload) for r in scored if r.query_id == k and r.relation > 0]
        best = {p for rel, p in mine if rel == max(mine)[0]}
        expected[k] = ("no_match", None) if not best else ("ambiguous", None) if len(best) > 1 else ("matched", *best)
    assert {r.query_id: (r.outcome, r.payload) for r in M.match(q, c).collect()} == expected
    assert {x[0] for x in expected.values()} == {"matched", "ambiguous", "no_match"}
    links = spark.createDataFrame([("A1", "rao anita"), ("B1", "anita rao"), ("C1", "lee stephen")], "neo_id string, name_key string")
    index = M.student_index(links.withColumn("name_key", F.array_join(F.array_sort(F.split("name_key", " ")), " ")), spark.createDataFrame([("anita rao", "Anita Rao"), ("lee stephen", "Stephen Lee")], "name_key string, display string"))
    found = {r.query_id: (r.outcome, r.neo_id) for r in M.search(spark.createDataFrame([(1, "Anita Rao"), (2, "stephen lee"), (3, "Xq Zw")], "query_id long, query string"), index).collect()}
    assert found == {1: ("ambiguous", None), 2: ("found", "C1"), 3: ("not_found", None)}


def test_names_that_the_corpus_has_are_compared_with_no_others(spark, monkeypatch):
    """A weaker relation is looked for only where there is no stronger one: of names that are all alike, only
    those that the corpus does not have are paired."""
    seen = {}

    def spied(name):
        real = getattr(M, name)

        def spy(asked, known):
            seen[name] = sorted(r.name_key for r in asked.select("name_key").collect())
            return real(asked, known)

        monkeypatch.setattr(M, name, spy)

    spied("subset_pairs")
    spied("alike_pairs")
    names = [f"anabel{c} karimo{d}" for c in "abcdefgh" for d in "abcdefgh"]
    corpus = spark.createDataFrame([(str(k), n) for k, n in enumerate(names)] + [("more", "bob anabelz dorn")], CORPUS)
    asks = [*names, "bob dorn", "anabelb karimoxa"]
    got = {r.query_id: (r.outcome, r.payload, r.confidence) for r in M.match(spark.createDataFrame(list(enumerate(asks)), "query_id long, query string"), corpus).collect()}
    assert all(got[k] == ("matched", str(k), 2) for k in range(len(names)))
    assert got[len(names)] == ("matched", "more", 1) and got[len(names) + 1][0] == "ambiguous"
    assert seen == {"subset_pairs": ["anabelb karimoxa", "bob dorn"], "alike_pairs": ["anabelb karimoxa"]}


def test_name_links_skip_what_is_resolved(spark):
    corpus = spark.createDataFrame([("R1", "Ravi Shah"), ("R2", "Anita Rao"), ("R3", "Anita Rao"), ("R4", "Stephen Lee")], "payload string, display string")
    asked = spark.createDataFrame([("N1", "Ravi Shah", 3), ("N2", "Anita Rao", 3), ("N3", "Stephen Lee", 1), ("N4", "Ravi Shah", 2), ("N5", "Qq Zz", 2), ("N6", "Ravi Shah", 0)], "payload string, name string, confidence int")
    resolved = spark.createDataFrame([("N4",)], "neo_id string")
    assert {(r.payload, r.matched, r.confidence) for r in I.link_by_name(asked, corpus, resolved).collect()} == {("N1", "R1", 2), ("N3", "R4", 1)}
    assert tuple(I.name_link_report(asked, corpus, resolved).first()) == (1, 1, 1, 1)
