import pytest
from pyspark.sql import functions as F

from citeloom.functions import legal
from citeloom.operators import lines as L


def table(spark, **documents):
    """A line table: doc, line_no and line of each document's lines."""
    rows = [(doc, k, x) for doc, lines in documents.items() for k, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "doc string, line_no int, line string")


def texts(df, *names):
    return {tuple(r[c] for c in names) if len(names) > 1 else r[names[0]]: r.text for r in df.collect()}


def value(spark, column, **inputs):
    return spark.range(1).select(column.alias("x")).first().x


def parts(spark, lines):
    found = {}
    for r in L.subsections(table(spark, d=lines), ["doc"]).orderBy("line_no").collect():
        found[r.label] = found.get(r.label, 0) + 1
    return list(found.items())


def test_subsections(spark):
    lines = ["(1) An employer shall pay", "under subsection", "(3) of section 18;", "and more.", "(1A) Nothing here.", "(2) Any person", "(a) one"]
    assert parts(spark, lines) == [("(1)", 4), ("(1A)", 1), ("(2)", 2)]
    assert parts(spark, ["No marker", "(2) x"]) == [(None, 2)]
    assert parts(spark, ["(1) of good quality", "(2) Any employer"]) == [("(1)", 1), ("(2)", 1)]
    assert parts(spark, ["(1) one", "(2) of no one", "(2) Two", "(4) Four", "(3) Three", "(3B) Three", "(3A) lower", "(4) last"]) == [("(1)", 2), ("(2)", 2), ("(3)", 1), ("(3B)", 3)]
    assert parts(spark, ["(1)", None, "(2) x."]) == [("(1)", 2), ("(2)", 1)]
    assert L.subsections(table(spark, d=["x"]).limit(0), ["doc"]).count() == 0


def defined(spark, lines):
    return [(r.part, r.term) for r in L.definitions(table(spark, d=lines), ["doc"]).orderBy("line_no").collect()]


def test_definitions(spark):
    assert defined(spark, ["In this Act—", "“wages” means", "money;", "“day” includes", "a night."]) == [(0, None), (1, "wages"), (1, "wages"), (2, "day"), (2, "day")]
    assert defined(spark, ["For this section, “children” means", "persons under 15."]) == [(1, "children"), (1, "children")]
    assert defined(spark, ["nothing"]) == [(0, None)]
    assert defined(spark, ["“x” shall be construed as", "it means"]) == [(0, None), (0, None)]


def statute(spark, *lines):
    return texts(L.statute_text(table(spark, d=lines), ["doc"]), "doc").get("d")


def award(spark, *lines):
    return texts(L.award_text(table(spark, d=lines), ["doc"]), "doc").get("d")


def test_text(spark):
    assert statute(spark, "An em-", "ployer shall", "(a)", "pay *wages;", "(b) keep", "Provided that") == "An em-ployer shall\n(a) pay wages;\n(b) keep\nProvided that"
    assert statute(spark, "(a)", "(i)", "(A)", "(B)", " ", "end", "“x” is") == "(a) (i)\n(A) (B) end\n“x” is"
    assert statute(spark, "(1)", "(a)", "(b)", None) == "(1) (a)\n(b)"
    assert statute(spark, "", None) is None
    assert award(spark, "post-", "termination of", "", "the claimant are:-", "next") == "post-termination of\nthe claimant are:- next"
    assert award(spark, "", "a", "", "", " b  c ") == "a\nb c"
    spaced = lambda tokens, gaps: value(spark, legal.spaced_words(F.array(*map(F.lit, tokens)).cast("array<string>"), F.array(*map(F.lit, gaps)).cast("array<double>")))
    assert spaced(list("hehas"), [1.9, 12.4, 1.9, 1.9]) == "he has"
    assert spaced(list("has"), [2.0, 2.0]) == "has" and spaced([], []) == ""


def test_pages(spark):
    page = lambda *lines: value(spark, legal.printed_page(F.array(*map(F.lit, lines))))
    assert page("Laws of Malaysia", "12") == 12
    assert page("14 Laws of Malaysia ACT 265") == 14
    assert page("Laws of Malaysia ACT 265") is None
    assert page("Employment 15") == 15
    assert page("x 3", "7 y", "9") == 9 and page("x 3", "7 y") == 7

    def notes(*lines):
        body, found = L.notes_apart(table(spark, d=lines), ["doc"])
        return [r.line for r in body.orderBy("line_no").collect()], [r.text for r in found.orderBy("note").collect()]

    assert notes("a", "*NOTE one", "goes on", "**NOTE two") == (["a"], ["*NOTE one goes on", "**NOTE two"])
    assert notes("a", "—————", "see x") == (["a"], ["see x"])
    assert notes("a", "*NOTE b", "——————", "c", "", "d") == (["a", "*NOTE b"], ["c d"])
    assert notes("a") == (["a"], [])


def test_fractions(spark):
    def written(lines, *pairs):
        asked = spark.createDataFrame([("d", a, b) for a, b in pairs], "doc string, upper string, lower string")
        return [r.line for r in L.fraction_lines(table(spark, d=lines), asked, ["doc"]).orderBy("line_no").collect()]

    assert written(["rate:", "monthly pay", ".", "26"], ("monthly pay", "26")) == ["rate:", "monthly pay / 26."]
    assert written(["A", "wages", "X", "12", "days"], ("wages", "days")) == ["A", "wages / days X 12"]
    assert written(["A", "wages", "12", "X", "days", ";", "more"], ("wages", "days")) == ["A", "wages / days X 12;", "more"]
    assert written(["the pay of one", "whole month", "26"], ("the pay of one whole month", "26")) == ["(the pay of one whole month) / (26)"]
    assert written(["x"], ("y", "z")) == ["x"]
    assert written(["a", "b", "c", "d"], ("a", "b"), ("c", "d")) == ["a / b", "c / d"]
    assert written(["a", *"123456789", "b"], ("a", "b")) == ["a", *"123456789", "b"]


def test_references(spark):
    text = F.lit("under sections 29(2), 30 and 99; also section 4 of the Trade Unions Act 1959 and regulation 30")
    known = F.array(*map(F.lit, ("29", "30", "4")))
    assert value(spark, legal.own_references(text, known)) == ["s. 29(2)", "s. 30"]
    assert value(spark, legal.own_references(text, known, "reg.")) == ["reg. 30"]
    both = F.lit("see the Trade Unions Act 1959 and the Trade Unions Act 1959 and the Employment Act 1955, under the Wages Order 2020")
    assert value(spark, legal.other_statutes(both, F.lit("Employment Act 1955"))) == ["Trade Unions Act 1959", "Wages Order 2020"]


@pytest.mark.parametrize(
    "title, action, targets",
    [
        ("Amendment of section 2", "amend", ["2"]),
        ("Deletion of sections 71, 72 and 73a.", "delete", ["71", "72", "73A"]),
        ("Deletion of Chapter XIa", "delete_chapter", ["Chapter XIA"]),
        ("New Part IIb", "insert_part", ["Part IIB"]),
        ("Substitution of Schedule", "substitute_schedule", ["SCHEDULE"]),
        ("New First and Second Schedules", "insert_schedule", []),
        ("General amendments", "general", []),
        ("Savings", "other", []),
    ],
)
def test_titles(spark, title, action, targets):
    assert tuple(value(spark, legal.amendment(F.lit(title)))) == (action, targets)


def test_targets(spark):
    target = lambda line: tuple(value(spark, legal.amendment_target(F.lit(line))))
    assert target("Subsection 60a(1) is amended") == ("60A", "(1)", None)
    assert target("(c) in subsection (4), by") == (None, "(4)", None)
    assert target("(a) in the definition of “wages”, by") == (None, None, "wages")
    assert target("(a) by inserting after the definition of “wages”") == (None, None, None)
    whole = lambda line: value(spark, legal.removes_whole(F.lit(line)))
    assert whole("(a) by deleting the definition of “x”") and not whole("(a) by deleting the words")


def test_contents(spark):
    page = "Act title\nARRANGEMENT OF SECTIONS\nPART I — PRELIMINARY\nSection\n1. Short title\nand start\n2-3. (Deleted by Act A1)\nCHAPTER 1\nWages\n4A. Pay\nFIRST SCHEDULE\nPART II\n5. Last"
    rows = L.contents(table(spark, d=page.split("\n")), ["doc"]).orderBy("line_no", "at").collect()
    assert [(r.section, r.title, r.part, r.chapter, r.status, r.deleted_by) for r in rows] == [
        ("1", "Short title and start", "Part I", None, "listed", None),
        ("2", None, "Part I", None, "deleted", "Act A1"),
        ("3", None, "Part I", None, "deleted", "Act A1"),
        ("4A", "Pay", "Part I", "Chapter 1", "listed", None),
        ("FIRST SCHEDULE", None, "Part I", "Chapter 1", "listed", None),
        ("5", "Last", "Part II", None, "listed", None),
    ]
    assert rows[3].chapter_title == "Wages" and rows[3].part_title == "PRELIMINARY"
    later = table(spark, d="(NOT YET IN FORCE) (Section 5 — 6)\n5. A\n6. B\n7. C".split("\n"))
    assert [r.not_yet_in_force for r in L.contents(later, ["doc"]).orderBy("line_no").collect()] == [True, True, False]
    assert L.contents_problems(later, ["doc"]).count() == 0 and L.contents_problems(table(spark, d=page.split("\n")), ["doc"]).count() == 0
    wrong = {"1. A\n1. B": "listed twice", "2. A\n1. B": "after a higher number", "stray": "no place", "1. A\n2 b": "no place", "(NOT YET IN FORCE) (Section 5 — 6)\n5. A": "never ends", "(NOT YET IN FORCE) (Section 5 — 6)\n4. A\n6. B": "begins elsewhere"}
    for text, problem in wrong.items():
        assert problem in [r.problem for r in L.contents_problems(table(spark, d=text.split("\n")), ["doc"]).collect()], text


def test_table_rows(spark):
    cells = [(0, 10, "left", "1. Manual work"), (0, 30, "left", "(1) by hand"), (0, 26, "right", "sections 60"), (0, 36, "right", "and 61"), (0, 80, "left", "2. Other"), (0, 76, "right", "section 9"), (1, 10, "left", "goes on")]
    rows, applies = L.table_rows(spark.createDataFrame([("t", *c) for c in cells], "t string, page int, y int, side string, text string"), ["t"])
    assert [(r.id, r.text, r.pages) for r in rows.orderBy("row").collect()] == [("1", "Manual work\n(1) by hand".replace("\n", " "), [0]), ("2", "Other goes on", [0, 1])]
    assert [(r.row, r.applies_to, r.provisions) for r in applies.orderBy("row").collect()] == [(1, "(1)", "sections 60 and 61"), (2, "2", "section 9")]


def paragraphs(spark, pages, numbering, skips=()):
    rows = [("d", k, page, x) for k, (page, x) in enumerate((p, x) for p, lines in enumerate(pages, 1) for x in lines)]
    return L.award_paragraphs(spark.createDataFrame(rows, "doc string, line_no int, page int, line string"), ["doc"], numbering, skips).orderBy("number")


def test_awards(spark):
    pages = [["Header", "[1] The claimant said.", "[7] no", "BACKGROUND", "[2] He worked"], ["until then.", "[3] Done.", "HANDED DOWN on", "x"]]
    found = paragraphs(spark, pages, "bracket").collect()
    assert [(r.number, r.text, r.first_page, r.last_page, r.heading) for r in found] == [(1, "The claimant said. [7] no BACKGROUND", 1, 1, None), (2, "He worked until then.", 1, 2, None), (3, "Done.", 2, 2, None)]
    pages[0][2] = "He left."
    assert [(r.text, r.heading) for r in paragraphs(spark, pages, "bracket").collect()] == [("The claimant said. He left.", None), ("He worked until then.", "BACKGROUND"), ("Done.", "BACKGROUND")]
    assert [r.number for r in paragraphs(spark, [["1. a", "3. b"]], "dot", [2]).collect()] == [1, 3]


def test_award_problems(spark):
    def problems(rows, first, last, least=5):
        df = spark.createDataFrame([("d", n, t) for n, t in rows], "doc string, number int, text string")
        return [r.problem for r in L.award_problems(df, ["doc"], F.array(F.struct(F.lit(first).alias("first"), F.lit(last).alias("last"))), least=least).collect()]

    assert problems([(1, "a"), (2, "")], 1, 2, least=1) == ["para 2 is empty"]
    assert problems([(1, "a"), (3, "b")], 1, 10**6) == ["paragraphs not consecutive", "only 2 reasoning paragraphs"]
    assert problems([(1, "a HANDED DOWN b")], 2, 4, 0) == ["range 2..4 outside 1..1", "para 1 contains signature text"]


def test_headings(spark):
    part = lambda x: value(spark, legal.heading_part(F.lit(x)))
    assert [part(x) for x in ("(a)", "Issues:", "the end", "A. Facts", "RM 5", "Ali v Abu", "A B C D E F G H I J K L M", "ii)", "", "1 Facts")] == [True, True, False, False, False, False, False, True, False, False]
    heading = lambda x: value(spark, legal.whole_heading(F.lit(x)))
    assert [heading(x) for x in ("DECISION", "Costs", "Facts of the case", "of the", "(a) REMEDY", " ".join(["word"] * 15))] == [True, False, True, False, True, False]


def test_word_budget(spark):
    def runs(lines, budget=50):
        return [r.run for r in L.word_budget(table(spark, d=lines), ["doc"], budget).orderBy("line_no").collect()]

    lines = [f"{k}. " + "w " * 9 if k % 2 == 0 else "w " * 10 for k in range(40)]
    found = runs(lines)
    assert all(lines[k].startswith(tuple("0123456789")) for k in range(40) if k == 0 or found[k] != found[k - 1])
    assert [runs(["w " * 10] * 20).count(k) for k in (1, 2, 3)] == [7, 7, 6] and runs([]) == []
