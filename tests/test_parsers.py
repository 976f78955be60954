from veriref.sources import parsers as p


def test_bibtex():
    found = p.bibtex('@article{a, title={The {\\"O}de}, author={M{\\"u}ller, Anna and Bob Roe}, year=2019, journal={Nature}}\n@misc{c, author={X}}\n@book{b, title="Zwei", year={2001}}')
    assert [x["ref_id"] for x in found] == ["a", "b"]  # no title, no reference
    assert found[0]["title"] == "The Öde" and found[0]["authors"] == ["Anna Müller", "Bob Roe"] and found[0]["year"] == 2019


def test_plain_references_count_before_short_ones_go():
    found = p.plain_references('Body.\nReferences\n[1] Smith, J. and Lee, K. (2019). A fine title. Journal.\n[2] x\n[3] Roe, B. "Another title here." 2020. 10.1234/ab.')
    assert [x["ref_id"] for x in found] == ["1", "3"]
    assert found[0]["title"] == "A fine title" and found[1]["doi"] == "10.1234/ab"
    assert p.plain_references("no list") == []


def test_markers():
    found = p.markers("As shown in [1, 3-5] and (Smith et al., 2020; Jones, 2019). Table [2] not, [0] not, Doe (2018a) said.")
    assert [x["keys"] for x in found] == [["1", "3", "4", "5"], ["smithetal2020", "jones2019"], ["doe2018a"]]
    assert p.numbers("5-3") == [] and p.numbers("1-500") == ["1"]


def test_authors():
    assert {p.canonical_author(x) for x in ("Huang, H.", "Huang H", "H. Huang", "Hai Huang")} == {("huang", "h")}
    assert p.match_authors(["Huang, H.", "Bob Roe", "Nobody"], ["Roe B", "Hai Huang"]) == [1, 0, -1]


def test_latex_citations():
    found = p.latex_citations("Intro one. We use \\cite{a,b} here. Then more.")
    assert [x["ref_id"] for x in found] == ["a", "b"]
    assert found[0]["context_before"] == "Intro one." and found[0]["context_after"] == "Then more."


def test_tei():
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><back><listBibl><biblStruct><analytic><title level="a">A fine title arXiv preprint 1</title><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author></analytic><monogr><title level="j">Nature</title><imprint><date when="2019-01"/></imprint></monogr></biblStruct><biblStruct><monogr><title>x</title></monogr></biblStruct></listBibl></back></text></TEI>'
    (found,) = p.tei_references(xml)
    assert found["title"] == "A fine title" and found["authors"] == ["Ann Lee"] and found["year"] == 2019 and found["venue"] == "Nature"


def test_readers(spark, tmp_path):
    from veriref.sources import readers

    (tmp_path / "a.bib").write_text("@article{k1, title={One fine title}, year={2019}}")
    (tmp_path / "a.tex").write_text("We use \\cite{k1,zz} here.")
    (tmp_path / "b.doc").write_text("?")
    taken, rejects = readers.routed(readers.files(spark, str(tmp_path)))
    assert [r["reason"] for r in rejects.collect()] == ["unknown extension"]
    refs, cited = readers.references(taken), readers.citations(taken)
    assert [r["title"] for r in refs.collect()] == ["One fine title"]
    assert {r["ref_id"] for r in cited.collect()} == {"k1", "zz"}
    assert readers.stubs(cited, refs).count() == 2  # the .bib is another paper_id here
