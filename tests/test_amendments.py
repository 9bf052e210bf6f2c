from citeloom.operators import amendments as A
from citeloom.operators import links


def parts(spark, lines, most=A.MOST_WORDS):
    rows = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines, 1)], "doc string, line_no int, line string")
    return A.parts(rows, ["doc"], most).orderBy("number", "part").collect()


def test_short_sections_are_whole(spark):
    lines = ["An Act to amend", "Short title", "1. (1) This is the Act.", "(2) It begins.", "Amendment of section 2", "2. Subsection 2(1) is amended by", "deleting the words.", "Deletion of sections 71, 72", "3. The Ordinance is amended", "by deleting them.", "New section 9a", "4. x"]
    found = parts(spark, lines)
    assert [(r.number, r.title, r.action, r.targets, r.label, r.section, r.subsection, r.new_section) for r in found] == [
        (1, "Short title", "other", [], None, None, None, []),
        (2, "Amendment of section 2", "amend", ["2"], None, "2", "(1)", []),
        (3, "Deletion of sections 71, 72", "delete", ["71", "72"], None, None, None, []),
        (4, "New section 9a", "insert", ["9A"], None, None, None, ["9A"]),
    ]
    assert found[0].text == "(1) This is the Act. (2) It begins." and found[1].text == "Subsection 2(1) is amended by deleting the words."


def test_paragraphs_in_sequence(spark):
    lines = ["Amendment of section 2", "1. Section 2 is amended—", "(a) in subsection (1)—", "(i) by inserting after the definition of", "“constructor” a thing of many words that goes on", "(ii) by deleting the definition of “family”;", "(iii) in the definition of", "“wages”, by words and words and more words than that;", "(c) by not being the next letter", "(b) in subsection (6), by all the words that there are to be."]
    found = parts(spark, lines, 12)
    assert [(r.label, r.subsection, r.term, r.inserts, r.removes) for r in found] == [
        ("(a)(i)", "(1)", None, True, False),
        ("(a)(ii)", "(1)", "family", False, True),
        ("(a)(iii)", "(1)", "wages", False, False),
        ("(b)", "(6)", None, False, False),
    ]
    assert found[0].text.startswith("Section 2 is amended—\n(a) in subsection (1)—") and found[2].text.endswith("(c) by not being the next letter")


def test_inserted_sections(spark):
    lines = ["New sections", "1. The Act is amended by inserting after section 60P the following sections:", "SPECIAL PROVISIONS", "Application for", "flexible working", "‘60q. (1) An employee may apply for it in writing to them.", "Reply to", "it", "60r. The employer replies within sixty days of that."]
    found = parts(spark, lines, 12)
    assert [(r.label, r.new_section) for r in found] == [("new 60Q", ["60Q"]), ("new 60R", ["60R"])]
    assert "following sections: SPECIAL PROVISIONS Application for flexible working ‘60q." in found[0].text and found[1].text.startswith("Reply to it 60r.")
    lines[1] += " and there are other words too."
    found = parts(spark, lines, 12)
    assert [r.label for r in found] == [None, "new 60Q", "new 60R"] and found[1].text.startswith("SPECIAL PROVISIONS Application")


def test_roman_only_and_empty(spark):
    lines = ["General amendments", "1. The Act is amended in the following way and no other way—", "(i) by substituting for the word the words that are here;", "(ii) by deleting other words."]
    assert [r.label for r in parts(spark, lines, 12)] == ["(i)", "(ii)"]
    assert parts(spark, ["no sections", "here"]) == [] and parts(spark, ["x"], 1) == []


def test_parts_link(spark):
    lines = ["Amendment of section 2", "1. Section 2 is amended—", "(a) by deleting the definition of “family”; and so on and on and on", "(b) in subsection (6), by inserting all the words that there are to be."]
    rows = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines, 1)], "doc string, line_no int, line string")
    found = A.parts(rows, ["doc"], 12).selectExpr("number * 100L + part AS src_id", "CAST(part AS int) AS ord", "action", "targets", "section", "subsection", "term", "inserts", "removes")
    principal = spark.createDataFrame([(1, "2", "(1)", "family", None), (2, "2", "(6)", None, None), (3, "2", "(7)", None, None)], "chunk_id long, section string, subsection string, term string, chapter string")
    edges, lost = links.from_amendments(principal, found)
    assert {r.chunk_id: r.status for r in links.status(edges).collect()} == {1: "deleted", 2: "superseded"} and lost.count() == 0
