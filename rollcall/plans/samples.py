"""Registered queries of text rules: every row of a table carries one of a list of samples, by its key, and
the SQL says what each should give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.functions import naming
from rollcall.functions import values as V
from rollcall.plans import relations as T
from rollcall.plans.catalogue import query

Samples = tuple[tuple[str | None, str | None], ...]


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sampled(table: str, key: str, samples: Samples, out: str) -> Callable:
    """A query over a table: (key, out), where out is a function of the sample number key mod their count."""
    told = ", ".join(_quoted(expected) for _, expected in samples)
    sql = f"SELECT {key}, ([{told}])[1 + {key} % {len(samples)}] AS {out} FROM {table}"

    def register(f: Callable[[Column], Column]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            texts = F.array(*[F.lit(text).cast("string") for text, _ in samples])
            rows = T.read(spark, sf, table).select(key, F.get(texts, (F.col(key) % len(samples)).cast("int")).alias("_text"))
            return rows.select(key, f(F.col("_text")).alias(out))

        run.__name__ = f.__name__
        return query(sql, base=False)(run)

    return register


BRANCHES = (
    ("B.Tech CSE with AI and ML", "CSE (AI & ML)"), ("AI & Machine Learning", "CSE (AI & ML)"), ("Artificial Intelligence", "CSE (AI & ML)"), ("Data Sciences", "CSE (Data Science)"),
    ("CSE Big Data", "CSE (Data Science)"), ("Cyber Physical", "CSE (Cyber Security)"), ("Blockchain technology", "CSE (Cyber Security)"), ("Internet of Things", "CSE (IoT)"),
    ("Computer Science, Business Systems", "CSE (Business Systems)"), ("Information Technology", "IT"), (" it ", "IT"), ("Electronics and Communication", "ECE"), ("ece", "ECE"),
    ("Electronics and Computer", "ECM"), ("Electronics (VLSI)", "ECM"), ("Electrical", "EEE"), ("EEE", "EEE"), ("Mechanical", "MECH"), ("Civil", "CIVIL"), ("Chemical", "CHEM"),
    ("Biomedical", "BIO"), ("CSE core", "CSE"), ("Computer Science", "CSE"), ("  ", "Unknown"), (None, "Unknown"), ("Law", "Other"), ("ecex", "Other"),
)


@sampled("part", "p_partkey", BRANCHES, "label")
def branch_labels(text):
    return V.branch_label(text)


ROUNDS = (
    ("Acme round 2", "R2"), ("acme_r-3_list", "R3"), ("ROUND1 final", "R1"), ("acme final list", "Final"), ("Acme offers", "Final"), ("test and interview", "Interview"), ("hr and gd", "HR"),
    ("group-discussion", "GD"), ("online assessment", "Test"), ("OA list", "Test"), ("coding round", "Test"), ("ppt of acme", "PPT"), ("batch 3 of acme", "Batch 3"), ("batch 3 ppt", "PPT"),
    ("round 22", None), ("finalists", None), ("acme", None), (None, None),
)


@sampled("pages", "page_id", ROUNDS, "round")
def round_of(text):
    return naming.round_of(text)


ESCAPED = (("a%20b", "a b"), ("100%", "100%"), ("a+b%2B", "a+b+"), ("%zz%41", "%zzA"), ("%é%C3%A9", "%éé"), ("%E2%82%AC.csv", "€.csv"), ("plain", "plain"), (None, None), ("", ""))


@sampled("pages", "page_id", ESCAPED, "text")
def percent_decode(text):
    return naming.percent_decode(text)


FILES = (
    ("acme_shortlist_28-07-26.xlsx", "Acme|28-07-26|-"), ("HPX%20Interview%20Shortlist.csv", "HPX|-|Interview"), ("GREEN FIELD ENERGY ROUND 2 LIST.xlsx", "Green Field Energy|-|R2"),
    ("list.xlsx", "Unnamed drive|-|-"), ("results batch 2 of the initech drive.xlsx", "Initech|-|Batch 2"), ("ppt 20_42_02 umbrella.xlsx", "Umbrella|-|PPT"), ("Book1.xlsx", "Unnamed drive|-|-"),
    ("johnson & johnson offers.csv", "Johnson & Johnson|-|Final"), ("eBay OA 5 Sept 2026.csv", "eBay|5-Sept-2026|Test"), ("p&g test.ods", "P&G|-|Test"),
)


@sampled("orders", "o_orderkey", FILES, "named")
def infer_names(text):
    none = F.array().cast("array<string>")
    i = naming.infer(text, none, none)
    return F.concat_ws("|", i["company"], F.coalesce(i["date"], F.lit("-")), F.coalesce(i["round"], F.lit("-")))


OLD = (("acme_shortlisted list_1-9-26.xlsx", "acme"), ("Acme Test (2).csv", "Acme"), ("with neo id.xlsx", "Unnamed drive"), ("blue-rock interview.xlsx", "blue rock"))


@sampled("part", "p_partkey", OLD, "name")
def legacy_names(text):
    return naming.legacy_name(text)


FIELDS = (("a", "a"), ("=1+1", "'=1+1"), ("a,b", '"a,b"'), ('say "x"', '"say ""x"""'), ("-1", "'-1"), ("+49", "'+49"), ("@x", "'@x"), ("two\nlines", '"two\nlines"'))


@sampled("customer", "c_custkey", FIELDS, "field")
def csv_fields(text):
    return V.csv_field(text)


DAYS = (("16-09-26", "16 Sep"), ("6/9/2026", "6 Sep"), ("2026-09-16", "16 Sep"), ("25-Sep-2026", "25-Sep-2026"), ("05 Oct", "05 Oct"), ("45-09-26", "45-09-26"))


@sampled("orders", "o_orderkey", DAYS, "day")
def day_texts(text):
    return V.day(text)


#: Published double metaphone codes (primary).
SOUNDS = (("smith", "SM0"), ("knight", "NT"), ("philip", "FLP"), ("thomas", "TMS"), ("jackson", "JKSN"), ("smith knight", "NT SM0"), ("o1", "A"), ("ümit", "ümit"))


@sampled("supplier", "s_suppkey", SOUNDS, "sound")
def phonetic_keys(text):
    return N.phonetic_key(text)


CGPAS = (("8.42", "8.42"), ("10", "10.0"), ("0", None), ("11", None), ("8.425", None), (" 7.5 ", "7.5"), ("x", None), (None, None))


@sampled("part", "p_partkey", CGPAS, "cgpa")
def typed_grades(text):
    return V.typed_cgpa(text).cast("string")
