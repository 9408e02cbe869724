from pagewright.llm.scans import repaired_scans, scan_noise


def test_running_line_at_a_page_change_without_number_or_gap(make_chunks, lexicon):
    prose = ["the robust beam is measured at the lens,", "while the signal shows that the filter", "exceeds the result of the thermal detector,", "which improves the closed loop in that", "section with the described compressor and"]
    head = "JOURNAL OF THERMAL BEAMS"
    pages = [(f"c{i}", "\n".join([head, *prose]), {"page": i}) for i in (1, 2, 3)]
    inside = ("c4", "\n".join([*prose, head + " 12", *prose]), {"page": 4})
    rows = make_chunks([*pages, inside, ("c5", "\n".join([*prose, "OTHER LINE OF ITS OWN", *prose]), {"page": 5})], conf=90.0)
    found = {(r.chunk_id, r.item) for r in scan_noise(rows, lexicon).where("kind = 'running_header'").collect()}
    assert found == {("c1", head), ("c2", head), ("c3", head), ("c4", head + " 12")}
    assert head not in {r.chunk_id: r.content for r in repaired_scans(rows, lexicon).collect()}["c4"]


PROSE = ["the robust beam is measured at the lens,", "while the signal shows that the filter", "exceeds the result of the thermal detector,", "which improves the closed loop in that", "section with the described compressor and"]


def test_page_numbers_that_keep_their_distance_to_the_page(make_chunks, lexicon):
    body = "\n".join(PROSE)
    rows = [(f"a{p}", f"{body}\n{p + 20}", {"page": p}) for p in (1, 4, 9)] + [("a12", f"33\n{body}", {"page": 12})]  # a12 holds the next page's number
    rows += [(f"b{p}", f"{body}\n{n}", {"page": p, "doc_id": "d2"}) for p, n in ((1, 50), (2, 77), (3, 12), (4, 90))]  # numbers of no sequence
    rows += [(f"c{p}", f"{body}\n{p + 20}", {"page": p, "doc_id": "d3"}) for p in (1, 2)] + [("c9", f"{PROSE[0]}\n{PROSE[1]}\n29\n{PROSE[2]}\n{PROSE[3]}", {"page": 9, "doc_id": "d3"})]  # on two pages only
    chunks = make_chunks(rows, conf=90.0)
    assert {tuple(r) for r in scan_noise(chunks, lexicon).collect()} == {("a1", "page_number", "21"), ("a4", "page_number", "24"), ("a9", "page_number", "29"), ("a12", "page_number", "33")}
    assert not any(w.isdigit() for r in repaired_scans(chunks, lexicon).where("chunk_id like 'a%'").collect() for w in r.content.split())


def test_running_lines_with_dropped_and_added_characters(make_chunks, lexicon):
    heads = ["JOURNAL OF THERMAL BEAMS", "JOURNAL OF THERMAL BEAMS", "JOURNL OF THERMAL BEAMS", "JOURNAL OF THERMAL  BEAMMS 7", "J0URNAL OF THERMAL BEAMS"]
    rows = [(f"c{i}", "\n".join([h, *PROSE]), {"page": i}) for i, h in enumerate(heads)]
    rows += [("o1", "\n".join(["JOURNAL OF THERMAL LENSES", *PROSE]), {"page": 20}), ("o2", "\n".join(["SHORT A", *PROSE]), {"page": 21}), ("o3", "\n".join(["SHORT A", *PROSE]), {"page": 22}), ("o4", "\n".join(["SHORT B", *PROSE]), {"page": 23})]
    found = {r.chunk_id for r in scan_noise(make_chunks(rows, conf=90.0), lexicon).where("kind = 'running_header'").collect()}
    assert found == {f"c{i}" for i in range(5)}


def test_fragments_of_torn_words_are_no_words(make_chunks, lexicon):
    torn = [(f"t{i}", "the rob ust beam is meas- ured at the lens and the self- tuning of the rob", {"page": i}) for i in range(30)]
    long = ("x", "the " + "q" * 60 + "-\n" + "z" * 60 + " is robust", {"page": 99})
    known = ("k", "a self with tuning or self of tuning and self by tuning of it", {"conf": None})
    found = {tuple(r) for r in scan_noise(make_chunks([*torn, long, known], conf=90.0), lexicon).collect()}
    assert found == {(f"t{i}", "hyphen_break", w) for i in range(30) for w in ("robust", "measured")} | {("x", "hyphen_break", "q" * 60 + "z" * 60)}
