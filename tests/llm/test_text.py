import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.llm.pairs import LanguageModel, defective_pairs, ending, is_refusal, shortened_versions
from pagewright.llm.pieces import oversized, split_oversized, split_text, words_within
from pagewright.llm.pii import Finder, iso7064_key, luhn, mod97_key, pension_key, personal_items, redacted, taxpayer_key, weighted_key
from pagewright.llm.quality import FEATURES, chunk_kinds, induce_rules, not_prose, rules_to_sql, seed_label, text_statistics
from pagewright.llm.scans import Corrector, is_page_number, repaired_scans, running_key, scan_noise


# --- pieces --------------------------------------------------------------------------------------


def test_boundaries_and_pieces(make_chunks):
    sentence = "one two three four five six seven eight nine ten. "
    rows = [
        ("p", "\n \n".join([sentence * 20, sentence * 20])), ("l", "\n".join([sentence * 25, sentence * 25])), ("s", sentence * 50), ("w", "word " * 500), ("short", sentence), ("null", None), ("blank", "  "),
        ("p", "\n \n".join([sentence * 20, sentence * 20])), ("edge", "w " * 308), ("over", "w " * 309), ("huge", "x" * 40_000 + " y" * 400),
    ]
    got = {r.chunk_id: r.boundary for r in oversized(make_chunks(rows)).collect()}
    assert got == {"p": "paragraph", "l": "line", "s": "sentence", "w": "word", "over": "word", "huge": "word"}
    pieces = split_oversized(make_chunks(rows)).collect()
    texts = dict(r[:2] for r in rows)
    for cid in got:
        ps = sorted((p for p in pieces if p.chunk_id == cid), key=lambda p: p.piece_no)
        assert [p.piece_id for p in ps] == [f"{cid}_s{i}" for i in range(len(ps))]
        assert "".join("".join(p.content[p.overlap_chars :].split()) for p in ps) == "".join(texts[cid].split())
        assert all(int(len(p.content.split()) * 1.3) <= 400 for p in ps)
        if cid != "huge":
            # The overlap is as long as asked for, or as the first whole unit leaves room for.
            first = {"p": 200, "l": 250, "s": 10}.get(cid, 1)
            assert all(len(p.content[: p.overlap_chars].split()) == min(words_within(50), 308 - first) for p in ps[1:])
    assert split_oversized(make_chunks(rows).where("false")).collect() == []


def test_split_keeps_whole_units_that_fit():
    paragraphs = [" ".join(f"p{k}w{i}" for i in range(n)) for k, n in enumerate((280, 300, 290, 308, 20))]
    text = "\n\n".join(paragraphs)
    pieces = split_text(text)
    assert [text[core:end] for _, core, end in pieces] == paragraphs
    assert [len(text[begin:core].split()) for begin, core, _ in pieces] == [0, 8, 18, 0, 39] and all(len(text[b:e].split()) <= 308 for b, _, e in pieces)
    assert split_text("   ") == [] and split_text("") == []


def test_boundary_is_what_the_splitter_needed():
    from pagewright.llm.pieces import boundary_of

    w = lambda n: " ".join(["word"] * n)
    assert boundary_of(f"{w(300)}\n \n{w(300)}", 308) == "paragraph" and boundary_of(f"{w(300)}\n{w(300)}", 308) == "line" and boundary_of(f"{w(300)}. {w(300)}", 308) == "sentence" and boundary_of(w(600), 308) == "word"
    assert boundary_of(f"{w(300)}\n2 Results of it\n{w(300)}", 308) == "line"  # a section that begins inside a paragraph
    assert boundary_of(f"{w(100)}\n\n{w(5)} {'x' * 50_000} {w(5)}\n\n{w(300)}", 308) == "paragraph"  # a long word alone is no reason


# --- pairs ---------------------------------------------------------------------------------------


def test_refusals_and_lures(spark):
    refused = ["I'm afraid that I cannot answer this from the pages provided.", "ICH WEIß ES NICHT.", "Désolé. Je ne sais pas.", "Не знаю.", "Sorry, sorry, but I can’t\nanswer."]
    lures = ["The load cannot be used above 163 GHz.", "No answer signal was recorded above 314 mg.", "Le coupleur ne peut pas répondre en moins de 225 ms.", "Недостаточно мощности: фильтр защищает образец.", "I don't know. But the lens is robust.", "Sorry.", "", None]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in refused + lures], "t string").select("t", is_refusal(F.col("t")).alias("x")).collect()}
    assert got == {t: t in refused for t in refused + lures}


def test_endings(spark):
    want = {
        'The lens ("': (True, None), "The lens,": (True, None), "the sig…": (True, None), "The lens (of": (True, None), "The lens is robust": (False, "robust"), "12 mW.": (False, None), "": (False, None), None: (False, None),
        "Die «Linse": (True, None), "12…": (False, None), "The lens is robust. ": (False, None), "The lens...": (True, None), "(1) is it": (False, "it"),
    }
    got = {r.t: tuple(r.e) for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", ending(F.col("t")).alias("e")).collect()}
    assert got == want


def test_defects(spark, lexicon):
    full = "The measured signal shows that the detector exceeds the thermal filter."
    rows = [
        (1, "What is the result of the lens?", True, None), (2, "What is the result?", True, " n/a "), (3, "What is the result?", True, "—"), (4, "When is the robust lens measured?", True, "the robust lens measured."),
        (5, "When is the robust lens measured?", True, "Question: When is the robust lens measured?"), (6, "When is the lens measured?", True, "The measured signal shows that the detector exceeds the therm"), (7, "When?", True, full),
        (8, "What is the signal?", True, "I cannot answer this from the pages provided."), (9, "What is the beam of the lens with the filter?", True, "Измеренный датчик и фильтр не может быть показано."), (10, "What?", False, None),
        (11, None, True, "The lens of the"), (12, "What is the beam?", True, 'The beam is robust ("измеренный датчик").'), (1, "What is the result of the lens?", True, None), (13, "What?", None, None),
    ] + [(100 + i, "What is the filter?", True, f"The signal of the lens {i} is robust. The {w} is thermal.") for i, w in enumerate(["beam", "lens", "filter"] * 12)]
    df = spark.createDataFrame(rows, "entry_id bigint, question string, has_answer boolean, expected_answer string").selectExpr("*", "'x' as answer", "1 as n")
    got = {(r.entry_id, r.defect) for r in defective_pairs(df, lexicon).collect()}
    assert got == {(1, "empty_answer"), (2, "empty_answer"), (3, "empty_answer"), (4, "copied_question"), (5, "copied_question"), (6, "truncated_answer"), (8, "refusal"), (9, "other_language"), (11, "truncated_answer")}
    assert defective_pairs(df.where("false"), lexicon).collect() == []


def test_shortened_versions_across_partitions(spark):
    texts = [f"sentence number {i} ends here" for i in range(300)]
    short = {t[: 14 + len(t) // 4] for t in texts[::7]}
    every = set(texts) | short | {""}
    # Some are no whole texts, so what they go on from is no shortened version of them.
    parts = {t[:12] + "zz" + c for t in texts[:1] for c in ("", "a", "ab")}
    rows = [(t, True, True) for t in sorted(every)] + [(t, False, True) for t in sorted(parts)] + [("sentence number whole only", True, False), (None, True, True)]
    want = {t for t in every | parts if any(o != t and o.startswith(t) for o in every | {"sentence number whole only"})}
    for n in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found = shortened_versions(spark.createDataFrame(rows, "text string, whole boolean, candidate boolean")).collect()
        assert {r.text for r in found} == want and len(found) == len(want)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r.text: r.inside_word for r in found}[texts[0][:20]] and not {r.text: r.inside_word for r in found}[""]


def test_language_model(lexicon):
    m = LanguageModel([(r.word, r.lang) for r in lexicon.collect()])
    assert m.languages(pd.Series(["der robuste Druck wird gemessen", "при измеренный сигнал", "12 mW", None, ""], index=[3, 1, 7, 9, 2]), 3.0).to_dict() == {3: "de", 1: "ru", 7: None, 9: None, 2: None}
    assert m.languages(pd.Series([], dtype=object), 3.0).empty


def test_named_steps_decide_rows(spark, lexicon, monkeypatch):
    from pagewright.llm import pairs

    full = "The measured signal shows that the detector exceeds the result"
    filler = [(200 + i, "q", True, f"The lens {i} is robust with signal {'x' * i} and thermal filter of the beam.") for i in range(30)]
    rows = [(1, "What is it?", True, full[:-3]), (2, "What?", True, full + "."), (3, "What is it?", True, "The lens is robus"), (4, "Which?", True, "The beam of vqxz"), (5, "Which?", True, "The beam of vqxz shows that the lens is robust.")]
    spike = [(100 + i, "What is it?", True, (f"the beam is robust {i:02d} " + "with the lens " * 5)[:60] + " zq" + chr(97 + i)) for i in range(24)]
    df = spark.createDataFrame(rows + spike + filler, "entry_id long, question string, has_answer boolean, expected_answer string")
    found = lambda: {r.entry_id for r in pairs.defective_pairs(df, lexicon).where("defect = 'truncated_answer'").collect()}
    at_limit = {r[0] for r in spike}
    assert found() == {1, 3, 4} | at_limit
    whole = pairs.shortened_versions
    monkeypatch.setattr(pairs, "shortened_versions", lambda t: whole(t).where("false"))
    assert found() == at_limit
    monkeypatch.setattr(pairs, "shortened_versions", whole)
    spikes = pairs.length_spikes
    monkeypatch.setattr(pairs, "length_spikes", lambda t: spikes(t).where("false"))
    assert found() == {1, 3, 4}


# --- quality -------------------------------------------------------------------------------------

PROSE = "The measured signal shows that the detector exceeds the filter. When the lens is thermal, the beam is robust with the result."
TABLE = "| Lens | Beam |\n| --- | --- |\n| lens 1 | 3.5 |\n| beam 2 | 7 |\n| filter | 9.1 |"
LIST = "- Thermal lens with robust beam\n- Measured filter with closed loop\n- Robust signal with thermal section\n- Thermal detector with table"
JUNK = "zxk qwrt plmn bvcx zsdf ghjk lmnp qrst vwxz bcdf"


def test_kinds(make_chunks, lexicon):
    rows = []
    for i in range(60):
        rows += [(f"p{i}", f"{PROSE} The result {i} is measured."), (f"t{i}", TABLE + f"\n| loop | {i} |"), (f"l{i}", LIST + f"\n- Robust beam with result {'x' * (i % 9)}"), (f"j{i}", JUNK + " " + "xq" * (i % 7 + 1))]
    rows += [("null", None), ("blank", " \n"), ("t0", TABLE + "\n| loop | 0 |"), ("long", PROSE * 2000)]
    got = {r.chunk_id: r.kind for r in not_prose(make_chunks(rows), lexicon).collect()}
    assert {k[0] for k in got} == {"t", "l", "j"} and len(got) == 180
    assert all({"t": "table", "l": "list", "j": "junk"}[k[0]] == v for k, v in got.items())
    kinds = chunk_kinds(make_chunks(rows), lexicon, "'prose'").collect()
    assert len(kinds) == 241 and set(FEATURES) <= set(kinds[0].asDict())
    assert not_prose(make_chunks(rows).where("false"), lexicon).collect() == []


def test_statistics_are_computed_once(make_chunks, lexicon):
    rows = [(f"{k}{i}", f"{text} {i}") for i in range(30) for k, text in (("p", PROSE), ("t", TABLE), ("l", LIST), ("j", JUNK))]
    plan = not_prose(make_chunks(rows), lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1  # the words, which several statistics count
    assert not [line for line in plan.splitlines() if "Filter " in line and ("split(" in line or "regexp_replace(" in line)]


def test_spared_searches_miss_nothing(spark):
    rows = [("a | b | c", 1, 2 / 5), ("a\tb\tc\r\nplain", 5 / 10, 2 / 4), ("<td>a</td>", 1, 2 / 1), ("a  b   c", 1, 2 / 3), ("a  b", 0, 1 / 2), ("a < b", 0, 0), ("a|b|c", 0, 0)]
    got = {r.content: r for r in text_statistics(spark.createDataFrame([(x,) for x, *_ in rows], "content string"), "content", [], []).collect()}
    for text, in_lines, per_token in rows:
        assert (got[text].cell_share, got[text].cells_per_token) == (pytest.approx(in_lines), pytest.approx(per_token))
    leaders = text_statistics(spark.createDataFrame([("Lens .... 12\rBeam … 3 \nLoop 4\n5 .... x",)], "content string"), "content", [], []).first()
    assert leaders.leader_share == pytest.approx((12 + 9) / (12 + 9 + 6 + 8))


def test_statistics_of_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a"), ("Ab 12.", "b")], "content string, n_lines string")
    rows = text_statistics(df, "content", ["ab"], ["ab"]).orderBy("n_lines").collect()
    assert rows[0].n_tokens == 0 and rows[1].n_tokens == 2 and rows[1].digit_ratio == pytest.approx(2 / 5) and rows[1].line_end_punctuation == 1


def test_rules_are_found_and_exported():
    import numpy as np

    rng = np.random.default_rng(1)
    x = {f: rng.random(400) for f in FEATURES}
    labels = np.where(x["known_share"] < 0.2, "junk", np.where(x["number_share"] > 0.7, "table", np.where(x["marker_share"] > 0.6, "list", "prose"))).astype(object)
    rules = induce_rules(x, labels)
    kind = np.full(400, "prose", object)
    for r in reversed(rules):
        kind[r.holds(x)] = r.kind
    assert (kind == labels).mean() > 0.95
    assert rules_to_sql(rules).startswith("CASE WHEN ") and rules_to_sql([]) == "'prose'"


def test_seed_labels():
    known, common = set("the lens with and robust beam thermal".split()), {"the", "with", "and", "is", "of"}
    assert seed_label(TABLE, known, common) == "table" and seed_label(LIST, known, common) == "list" and seed_label(JUNK, known, common) == "junk"


# --- scans ---------------------------------------------------------------------------------------


def scans():
    body = "The meas-\nured signal shows that the detector exceeds the filter. The rob\nust beam is therrnal and the closed-\nloop filter is measurcd."
    rows = [(f"s{p}", f"Robust lens with thermal beam   {p}\n{body}\n- {p} -", {"page": p, "conf": 80.0, "type": "image_ocr"}) for p in (1, 2)]
    rows.append(("s3", f"R0bust lens with thermal beam\n{body}\nPage 3 of 9", {"page": 3, "conf": 80.0}))
    rows += [("low", "12\nthe sig-\nnal", {"conf": 20.0, "page": 12}), ("none", "the sig-\nnal"), ("null", None, {"conf": 90.0}), ("fail", "the sig-\nnal", {"conf": 90.0, "status": "failed"}), ("v1", "a measured robust signal is measured robust signal by measured robust signal in it")]
    return rows


def test_scan_findings(make_chunks, lexicon):
    rows = scans()
    got = {tuple(r) for r in scan_noise(make_chunks(rows + rows[:1]), lexicon).collect()}
    for p, head, foot in ((1, "Robust lens with thermal beam 1", "- 1 -"), (2, "Robust lens with thermal beam 2", "- 2 -"), (3, "R0bust lens with thermal beam", "Page 3 of 9")):
        want = {("running_header", head), ("page_number", foot), ("hyphen_break", "measured"), ("hyphen_break", "robust"), ("misread", "thermal"), ("misread", "measured")}
        assert {(k, i) for c, k, i in got if c == f"s{p}"} == want
    assert {c for c, _, _ in got} == {"s1", "s2", "s3"}
    assert scan_noise(make_chunks(rows).where("false"), lexicon).collect() == []
    fixed = {r.chunk_id: r.content for r in repaired_scans(make_chunks(rows), lexicon).collect()}
    assert fixed["s3"] == "The measured signal shows that the detector exceeds the filter. The robust beam is thermal and the closed- loop filter is measured." and set(fixed) == {"s1", "s2", "s3"}


def test_scan_parts():
    c = Corrector(["modern", "damps", "result", "датчик"])
    assert c.intended("rnodern") == "modern" and c.intended("clamps") == "damps" and c.intended("rcsu1t") == "result" and c.intended("дaтчнк") == "датчик" and c.intended("result") is None and c.intended("other") is None
    assert is_page_number(" - 7 -", 7) and is_page_number("стр. 3", 3) and not is_page_number("7", 40) and not is_page_number("7 rows", 7) and is_page_number("Page 4 of 9", None) and not is_page_number("4", None)
    assert running_key("12  R0bust Lens") == running_key("robust  lens 4")


# --- personal information ------------------------------------------------------------------------


def test_checksums():
    assert luhn("79927398713") and not luhn("79927398710")
    assert mod97_key("255081416802538") and not mod97_key("255081416802539")
    assert weighted_key("11223344595") and not weighted_key("11223344596")
    assert iso7064_key("86095742719") and not iso7064_key("86095742718")
    corsica = lambda d: f"2550{8}{d}168025" + f"{97 - int(f'25508{dict(A='19', B='18')[d[1]]}168025') % 97:02d}"
    assert mod97_key(corsica("2A")) and mod97_key(corsica("2B")) and not mod97_key(corsica("2A").replace("2A", "2B")) and not mod97_key("2550AA416802538")
    assert pension_key("15070649C103") and not pension_key("15070649C104") and taxpayer_key("500100732259") and not taxpayer_key("500100732258") and not taxpayer_key("5001")


CASES = [
    ("Write to a.b+c@mail.example or x [at] works.test.", {("email", "a.b+c@mail.example"), ("email", "x [at] works.test")}),
    ("cc: q.w at optics dot example", {("email", "q.w at optics dot example")}),
    ("Recall reached 0.4 (precision@21 and hit@20). The annotation @cached wraps it.", set()),
    ("Call +1 (474) 555-0186 before. Tel. 0199005448", {("phone", "+1 (474) 555-0186"), ("phone", "0199005448")}),
    ("The lens has serial 428-44-8350. Order code 1484-34-510, lot 596261. Timestamp 2031-02-17 08:24:47, run 89804573.", set()),
    ("Operator Ada Skelgard, SSN: 666-36-7238, signed.", {("name", "Ada Skelgard"), ("id_number", "666-36-7238")}),
    ("Оператор: Назар Орлухин, паспорт серии 0000 № 874615.", {("name", "Назар Орлухин"), ("id_number", "0000 № 874615")}),
    ("Opérateur : Cora Perruvel, passeport n° 00XX75381.", {("name", "Cora Perruvel"), ("id_number", "00XX75381")}),
    ("Prepared by Skelgard, Ada, Flat 24, 96 Quillmore Lane, Tarnside.", {("name", "Skelgard, Ada"), ("address", "Flat 24, 96 Quillmore Lane, Tarnside")}),
    ("Erstellt von ADA DORNFELD, Kornmarktstr. 192, 00119 Ellerstätt.", {("name", "ADA DORNFELD"), ("address", "Kornmarktstr. 192, 00119 Ellerstätt")}),
    ("Adresse : 145 bis rue des Orbelles, Montarvel", {("address", "145 bis rue des Orbelles, Montarvel")}),
    ("Адрес: 000243, г. Новоречинск, ул. Малая Тростниковая, д. 202", {("address", "000243, г. Новоречинск, ул. Малая Тростниковая, д. 202")}),
    ("According to Dr. Ruthcroft, the beam drifted. The Ruthcroft method needs 3 steps.", {("name", "Ruthcroft")}),
    ("Supplied by Gladcroft Instruments GmbH under contract 6340/36.", set()),
    ("The request names Zorvin Tarleth with SSN 666-36-7238, who was asked for by Q. Umberane. Laut Frau Dr. Voglreich ist es so. Herr Tannau hat den Lens.", {("name", "Zorvin Tarleth"), ("id_number", "666-36-7238"), ("name", "Q. Umberane"), ("name", "Voglreich"), ("name", "Tannau")}),
    ("The interview with J. Holmgard was at 90.0 °C. Deliveries ended. M. Estremont a validé le lens.", {("name", "J. Holmgard"), ("name", "Estremont")}),
    ("Der Versand an Zilda Grauau (z.g@mail.example) kostet nichts.", {("name", "Zilda Grauau"), ("email", "z.g@mail.example")}),
    ("x" * 300 + ".long@" + "d" * 150 + ".example", {("email", "x" * 300 + ".long@" + "d" * 150 + ".example")}),
    ("Passport no." + " " * 90 + "XK6394451, tel." + " " * 60 + "0199005448", {("id_number", "XK6394451"), ("phone", "0199005448")}),
    ("| bearing 11 | the lens 2) Serial 428-44-8350 ships to 12 Long Beacon Hill Close, Tarnside.", {("address", "12 Long Beacon Hill Close, Tarnside")}),
    ("", set()),
]


def test_checksums_decide(monkeypatch):
    from pagewright.llm import pii

    f = Finder(["dossier", "la", "note"], ["Cora"])
    found = lambda text: {text[b:e] for b, e, k in f.find(text) if k == "id_number"}
    right, wrong = "255081416802538", "255081416802539"
    assert found(f"dossier {right} la note") == {right} and found(f"dossier {wrong} la note") == set()
    assert found(f"NIR: {right}") == {right} and found(f"NIR: {wrong}") == set() and found(f"Cora Perruvel, NIR: {wrong}") == {wrong}
    assert found("112-233-445 95") == {"112-233-445 95"} and found("112-233-445 96") == set() and found("serial 112-233-445 95") == set()
    monkeypatch.setattr(pii, "checked", lambda value, key: 0.0)
    assert found(f"dossier {right} la note") == set() and found(f"NIR: {wrong}") == {wrong}


@pytest.mark.parametrize(("text", "want"), CASES)
def test_items(text, want):
    f = Finder(["the", "lens", "beam"], ["Ada", "Cora"])
    assert {(k, " ".join(text[b:e].split())) for b, e, k in f.find(text.replace("р", "р"))} == {(k, v) for k, v in want}


def test_items_of_tables(spark, lexicon):
    names = spark.createDataFrame([("Ada", "en"), (None, "en")], "given_name string, lang string")
    docs = spark.createDataFrame([(1, CASES[0][0]), (1, CASES[0][0]), (2, None), (3, ""), (4, CASES[8][0] * 3)], "doc_id bigint, text string").selectExpr("*", "'x' as kind", "'y' as value")
    got = [tuple(r) for r in personal_items(docs, lexicon, names).collect()]
    assert len(got) == len(set(got)) == 4
    out = {r.doc_id: r.text for r in redacted(docs, lexicon, names).collect()}
    assert out[1] == "Write to [EMAIL] or [EMAIL]." and out[2] is None and out[3] == "" and out[4].count("[ADDRESS]") == 3
    assert personal_items(docs.where("false"), lexicon, names).collect() == []


def test_queries_have_their_columns():
    from pagewright.llm.queries import oracle_sql, queries

    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_token_budget", "p6_found", "p7_ids", "p8_mix", "p9_found"} <= set(queries()) and set(oracle_sql()) <= set(queries())
    assert pd is not None
