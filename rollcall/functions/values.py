"""Column functions over identifiers, confidence, samples and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence labels from weakest to strongest, held as 0 to 3.
CONFIDENCE = ("unresolved", "probable", "high", "verified")
MIN_MATCHED, MIN_COVERAGE = 20, 0.08
MIN_CGPA, MAX_CGPA = 4.0, 10.0
NEO, REG = "neo_id", "reg_no"

#: What a header cell says, so no name.
HEADER_WORDS = ("name", "full name", "candidate name", "student name", "venue", "remarks", "role", "batch", "gender", "degree", "branch", "campus")


def neo_id(raw: Column) -> Column:
    """The primary identifier (letter, digit, four times) in upper case, or null."""
    x = F.upper(F.trim(raw))
    return F.when(x.rlike("^([A-Z][0-9]){4}$"), x)


def reg_no(raw: Column) -> Column:
    """The secondary identifier (two digits, three letters, four to six digits), or null."""
    x = F.upper(F.trim(raw))
    return F.when(x.rlike("^[0-9]{2}[A-Z]{3}[0-9]{4,6}$"), x)


def identifier_kind(raw: Column) -> Column:
    return F.when(neo_id(raw).isNotNull(), NEO).when(reg_no(raw).isNotNull(), REG)


def might_be_list(text: Column) -> Column:
    """Whether a pasted text could list identifiers at all: a gate before it is read, narrower than the
    reading itself (four digits only)."""
    ways = ("[A-Za-z][0-9]" * 4, "[0-9]{2}[A-Za-z]{3}[0-9]{4}")
    out = F.lit(False)
    for way in ways:
        out = out | text.rlike(f"(?<![A-Za-z0-9]){way}(?![A-Za-z0-9])")
    return F.coalesce(out, F.lit(False))


def profile_error(neo: Column, reg: Column, cgpa: Column) -> Column:
    """The code of the first thing wrong with a profile, or null. Blank identifiers are none."""
    given = lambda x: x.isNotNull() & (F.trim(x) != "")
    return (
        F.when(given(neo) & neo_id(neo).isNull(), "bad_neo_id")
        .when(cgpa.isNotNull() & sane_cgpa(cgpa).isNull(), "bad_cgpa")
        .when(given(reg) & reg_no(reg).isNull(), "bad_reg_no")
    )


def friend_error(neo: Column, reg: Column) -> Column:
    """no_identifier where neither identifier reads as one, or null: a name alone cannot be checked."""
    return F.when(neo_id(neo).isNull() & reg_no(reg).isNull(), "no_identifier")


def lookup_error(query: Column) -> Column:
    """bad_identifier where the text is neither kind of identifier, or null."""
    return F.when(identifier_kind(query).isNull(), "bad_identifier")


def admission_year(reg: Column) -> Column:
    return F.substring(reg, 1, 2)


def confidence_rank(label: Column) -> Column:
    """0 to 3; an unknown label counts as unresolved."""
    out = F.lit(0)
    for k, name in enumerate(CONFIDENCE):
        out = F.when(label == name, k).otherwise(out)
    return out


def confidence_label(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), rank.cast("int") + 1)


def can_name(rank: Column) -> Column:
    return rank >= 2


def can_aggregate(rank: Column) -> Column:
    return rank >= 1


def coverage(matched: Column, total: Column) -> Column:
    return F.when(total > 0, matched / total).otherwise(0.0)


def sufficient(matched: Column, total: Column) -> Column:
    return (total > 0) & (matched >= MIN_MATCHED) & (coverage(matched, total) >= MIN_COVERAGE)


def coverage_tier(share: Column) -> Column:
    return F.when(share >= 0.4, "good").when(share >= 0.15, "partial").otherwise("thin")


def tolerance(n: Column) -> Column:
    """Share of a sample that may lie below a floor: 1.5 / n held to 0.01..0.06; 0 for none."""
    return F.when(n > 0, F.greatest(F.lit(0.01), F.least(F.lit(0.06), F.lit(1.5) / n))).otherwise(0.0)


def sane_cgpa(x: Column) -> Column:
    return F.when(~F.isnan(x) & x.between(MIN_CGPA, MAX_CGPA), x)


def typed_cgpa(text: Column) -> Column:
    """A grade as typed: one or two digits, up to two decimals, above 0 and at most 10."""
    x = F.when(F.trim(text).rlike(r"^\d{1,2}(\.\d{1,2})?$"), F.trim(text).try_cast("double"))
    return F.when((x > 0) & (x <= 10), x)


def looks_like_name(s: Column) -> Column:
    """Whether a cell reads as a person's name."""
    t = F.trim(s)
    letters = F.length(F.regexp_replace(t, r"[^\p{IsAlphabetic}]", ""))
    return (
        F.octet_length(t).between(3, 60)
        & ~t.contains("@") & ~t.contains("://") & ~t.rlike("[0-9]")
        & (letters >= 3) & ~F.lower(t).isin(*HEADER_WORDS)
        & (letters / F.length(t) > 0.7)
    )


def display_label(rank: Column, name: Column, neo: Column, reg: Column) -> Column:
    return F.coalesce(F.when(can_name(rank), name), neo, reg, F.lit("Unknown student"))


#: Branch labels in the order in which they are tried. Each test is a list of ways; a
#: way holds if the lower-cased text contains all of its parts.
BRANCHES = (
    ("CSE (AI & ML)", (("ai", "ml"), ("ai", "machine"), ("artificial intelligence",))),
    ("CSE (Data Science)", (("data sci",), ("big data",), ("data analytics",))),
    ("CSE (Cyber Security)", (("cyber",), ("information security",), ("block chain",), ("blockchain",))),
    ("CSE (IoT)", (("internet of things",), ("iot",))),
    ("CSE (Business Systems)", (("business system",),)),
    ("IT", (("information tech",), ("=it",))),
    ("ECE", (("electronics", "comm"), ("=ece",))),
    ("ECM", (("electronics", "computer"), ("electronics", "vlsi"))),
    ("EEE", (("electrical",), ("=eee",))),
    ("MECH", (("mech",),)),
    ("CIVIL", (("civil",),)),
    ("CHEM", (("chemical",),)),
    ("BIO", (("bio",),)),
    ("CSE", (("cse",), ("computer sci",), ("computer engineering",))),
)


def branch_label(raw: Column) -> Column:
    """One of the labels above; Unknown for an empty text, else Other. "=x" asks for the whole text."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    out = F.when(F.trim(s) == "", "Unknown").otherwise("Other")
    for label, ways in reversed(BRANCHES):
        test = F.lit(False)
        for way in ways:
            both = F.lit(True)
            for part in way:
                both = both & ((F.trim(s) == part[1:]) if part[0] == "=" else s.contains(part))
            test = test | both
        out = F.when(test, label).otherwise(out)
    return out


def column_letter(index: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA; up to three letters."""
    letter = lambda k: F.char(65 + k)
    one, two = index % 26, F.floor(index / 26)
    return (
        F.when(index < 26, letter(one))
        .when(two <= 26, F.concat(letter(two - 1), letter(one)))
        .otherwise(F.concat(letter(F.floor((two - 1) / 26) - 1), letter((two - 1) % 26), letter(one)))
    )


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def day(raw: Column) -> Column:
    """16-09-26, 16/9/2026 or 2026-09-16 as 16 Sep; anything else unchanged but trimmed."""
    t = F.trim(raw)
    p = F.split(t, "[-/.]", -1)
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))
    year_first = (F.length(F.get(p, 0)) == 4) & number(F.get(p, 0)).isNotNull()
    d = F.when(year_first, number(F.get(p, 2))).when(number(F.get(p, 2)).isNotNull(), number(F.get(p, 0)))
    m = number(F.get(p, 1))
    fits = (F.size(p) == 3) & d.between(1, 31) & m.between(1, 12)
    return F.when(F.coalesce(fits, F.lit(False)), F.concat_ws(" ", d.cast("string"), F.get(F.array(*map(F.lit, MONTHS)), m - 1))).otherwise(t)


def rfc3339(stamp: Column) -> Column:
    """2026-09-16 10:11:12 (UTC) as 2026-09-16T10:11:12Z; a text with a T already is kept."""
    return F.when(stamp.contains("T"), stamp).otherwise(F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit("Z")))


def relative_day(stamp: Column, now: Column) -> Column:
    n = F.datediff(now, stamp)
    return F.when(n <= 0, "Today").when(n == 1, "Yesterday").when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(stamp, "d MMM"))


def csv_field(value: Column) -> Column:
    """A field that a spreadsheet cannot read as a formula, quoted where needed."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def sheet_name(company: Column) -> Column:
    """A worksheet name: the seven reserved characters as spaces, at most 31 characters."""
    x = F.regexp_replace(F.trim(F.regexp_replace(company, r"[\[\]:*?/\\\\]", " ")), "^'+|'+$", "")
    x = F.trim(F.substring(x, 1, 31))
    return F.when(x == "", "Shortlist").otherwise(x)


def safe_filename(raw: Column) -> Column:
    """The last part of a path without control characters and colons, at most 200 characters."""
    x = F.trim(F.regexp_extract(raw, r"([^/\\\\]*)$", 1))
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[\x00-\x1F:]", ""), r"^\.+|\.+$", ""))
    return F.when(x == "", "shortlist.xlsx").otherwise(F.substring(x, 1, 200))


def with_extension(path: Column, extension: str) -> Column:
    return F.when(F.lower(path).endswith("." + extension), path).otherwise(F.concat(F.regexp_replace(path, r"\.[^./\\\\]*$", ""), F.lit("." + extension)))
