from pyspark.sql import functions as F

from citeloom.operators import sections as S

ENTRY = "doc string, ord int, section string, title string, status string, deleted_by string, later boolean"


def statute(spark, lines, *entries):
    rows = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines, 1)], "doc string, line_no int, line string")
    expected = spark.createDataFrame([("d", k, *(e + (None,) * (3 - len(e)))[:2], "deleted" if len(e) > 2 and e[2] else "listed", e[2] if len(e) > 2 else None, len(e) > 3) for k, e in enumerate(entries)], ENTRY)
    return rows, expected


def found(spark, lines, *entries):
    rows, expected = statute(spark, lines, *entries)
    out = S.chunks(rows, expected, ["doc"]).collect()
    return sorted(((r.ord, r.label or "", r.part), r.section, r.label, r.kind, r.rule, r.status, r.deleted_by, r.term, r.title, r.text) for r in out)


def test_chunks_of_sections(spark):
    lines = [
        "PART I", "PRELIMINARY", "Short title", "1. This is the Act.", "_____",
        "Meaning of words", "2. (1) In this Act—", "“wages” means", "money;", "“day” includes a night.", "(2) Nothing else.", "[Am. Act A1.]",
        "34-36. (Deleted by Act A9).",
        "CHAPTER 2", "Rest day", "37. Every employee rests.", "(b) keep", "and goes on.", "FIRST SCHEDULE", "1. not a section",
    ]
    got = found(spark, lines, ("1", "Short title"), ("2", "Meaning of words"), ("34", None, "Act A9"), ("35", None), ("36", None), ("37", "Rest day", None, True))
    assert [x[1:] for x in got] == [
        ("1", None, "provision", "section_undivided", "in_force", None, None, "Short title", "This is the Act."),
        ("2", "(1)", "definition", "definition", "in_force", None, "wages", "Meaning of words", "“wages” means money;"),
        ("2", "(1)", "definition", "definition", "in_force", None, "day", "Meaning of words", "“day” includes a night."),
        ("2", "(2)", "provision", "subsection", "in_force", None, None, "Meaning of words", "Nothing else."),
        ("34", None, "provision", "range_placeholder", "deleted", "Act A9", None, None, "(Deleted by Act A9)."),
        ("35", None, "provision", "range_placeholder", "deleted", "Act A9", None, None, "(Deleted by Act A9)."),
        ("36", None, "provision", "range_placeholder", "deleted", "Act A9", None, None, "(Deleted by Act A9)."),
        ("37", None, "provision", "section_undivided", "not_yet_in_force", None, None, "Rest day", "Every employee rests.\n(b) keep and goes on."),
    ]
    rows, expected = statute(spark, lines, ("1", "Short title"), ("2", "Meaning of words"), ("37", "Rest day"))
    scopes = {r.term: (r.scope, r.annotations) for r in S.chunks(rows, expected, ["doc"]).filter("term IS NOT NULL").collect()}
    assert scopes == {"wages": ("In this Act—", ["[Am. Act A1.]"]), "day": ("In this Act—", ["[Am. Act A1.]"])}


def test_missing_and_titles(spark):
    lines = ["1. One.", "Old title of it", "2. [Deleted by AA1238]", "4. Four.", "Powers of inspection", "5. Five", "5.", "Text here", "6A. Six."]
    rows, expected = statute(spark, lines, ("1", None), ("2", None), ("3", "Lost"), ("4", "Other"), ("5", "Government inspections"), ("6A", "Six"))
    r = S.report(rows, expected, ["doc"]).first()
    assert (r.expected, r.located, r.missing) == (6, 5, ["3"])
    assert r.titles_inferred == ["2", "5"] and r.titles_unmatched == ["4", "6A"]
    texts = {r.section: r.text for r in S.chunks(rows, expected, ["doc"]).collect()}
    assert texts["1"] == "One." and texts["4"] == "Four." and texts["5"] == "Five 5. Text here" and texts["2"] == "[Deleted by AA1238]"


def test_range_holds_lettered_sections(spark):
    lines = ["74. Before.", "Section 75 — 82", "[Deleted by AA1]", "83. After."]
    got = found(spark, lines, ("74", None), ("75", None), ("78A", None), ("82", None), ("83", None))
    assert [(x[1], x[5]) for x in got] == [("74", "in_force"), ("75", "deleted"), ("78A", "deleted"), ("82", "deleted"), ("83", "in_force")]


def test_empty_documents(spark):
    rows, expected = statute(spark, ["x"], ("1", None))
    assert S.chunks(rows.limit(0), expected, ["doc"]).count() == 0 and S.chunks(rows, expected.limit(0), ["doc"]).count() == 0
    assert S.chunks(rows.withColumn("line", F.lit(None).cast("string")), expected, ["doc"]).count() == 0
    assert S.report(rows, expected, ["doc"]).first().missing == ["1"]


def test_references(spark):
    rows, expected = statute(spark, ["1. Under section 2 of this Act.", "2. See the Trade Unions Act 1959."], ("1", None), ("2", None))
    got = S.references(S.chunks(rows, expected, ["doc"]), expected, ["doc"], F.lit("Employment Act 1955")).orderBy("ord").collect()
    assert [(r.internal, r.external) for r in got] == [(["s. 2"], []), ([], ["Trade Unions Act 1959"])]
