from pyspark.sql import functions as F

from pagewright.functions import predicates as P
from pagewright.functions import text as X


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in row.items()))
    return df.select(column.alias("x")).first().x


def test_normalize(spark):
    cases = {
        "": "", "a-\nb-\nc": "abc", "a-\nB": "a- B", "слово-\nсочетание x9y": "словосочетание x 9 y", "camelCase\n\n \nnext\tline  end": "camel Case\n\nnext line end",
        "MixedText12abc\nq": "Mixed Text 12 abc q", "  one\ntwo\n\n\nthree  ": "one two\n\nthree", "plain \\ t": "plain \\ t",
    }
    for t, want in cases.items():
        assert one(spark, X.normalize_text(F.col("t")), t=t) == want
    assert one(spark, X.normalize_text(F.col("t"), True), t="that is\\it at") == "ha is i a"
    assert one(spark, X.normalize_text(F.col("t")), t=None) is None


def test_small_functions(spark):
    assert one(spark, X.duration_label(F.col("s")), s=125.9) == "2:05"
    assert one(spark, X.html_escape(F.col("t")), t="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    assert one(spark, X.redact_secrets(F.col("t")), t="use sk-proj-abcdefghij_12 now") == "use sk-*** now"
    assert one(spark, X.preview(F.col("t")), t=" ".join(map(str, range(21)))).endswith("19...") and one(spark, X.preview(F.col("t")), t="a b") == "a b"
    assert one(spark, X.alnum_ratio(F.col("t")), t=None) == 0.0 and one(spark, X.word_count(F.col("t")), t=None) == 0
    assert one(spark, X.flattened_table(F.col("t")), t="| A |  B |") == "table a b"


def test_anchor_span(spark):
    cases = {
        "The lens moved. A thermal detector of 120GHz exceeded the limit of the beam line in every run we made. End here.": ("120GHz", "A thermal detector of 120GHz exceeded the limit of the beam line in every run we made."),
        "short": None,
        "x " * 50: None,
        "A line first that is long enough to be one of its own kind here\nBEAM9 in it and the rest of the line goes on and on here.\nAnother line.": ("BEAM9", "BEAM9 in it and the rest of the line goes on and on here."),
        "Figure this that with from were have using used into between within their table chart: no anchor is in it.": None,
        "Some plain words go here to fill the line up and then. V2 of AB12 is it. And some more words come after that one.": ("AB12", "ome plain words go here to fill the line up and then. V2 of AB12 is it. And some more words come after that one."),
    }
    for t, want in cases.items():
        got = one(spark, X.anchor_span(F.col("t")), t=t)
        assert (got and tuple(got)) == want, t


def test_image_anchor_span(spark):
    cases = {
        "axis of time\nPower 120kW at start. End": ("Power", "Power 120kW at start"), "no strong token": None, "": None, "Fig. one": None, "a. size of 1200 nm": ("1200", "size of 1200 nm"),
        "word " * 60 + "Label9 " + "word " * 60: ("Label9", ("word " * 12 + "Label9 " + "word " * 12).strip()),
    }
    for t, want in cases.items():
        got = one(spark, X.image_anchor_span(F.col("t")), t=t)
        assert (got and tuple(got)) == want, t


def test_predicates(spark):
    assert one(spark, P.table_question(F.col("q")), q="is it suitable?") is True
    assert one(spark, P.table_question(F.col("q")), q="recall of 5 %") is True and one(spark, P.table_question(F.col("q")), q="recall of it") is False
    assert one(spark, P.image_question(F.col("q")), q="the paragraph") is True
    assert one(spark, P.no_answer(F.col("q")), q="Answer NOT FOUND here") is True
    assert one(spark, P.usable_caption(F.col("q")), q="Sorry,  I cannot") is None and one(spark, P.usable_caption(F.col("q")), q="It cannot be used") == "It cannot be used"
    assert one(spark, P.low_information_caption(F.col("q")), q="unreadable") is True and one(spark, P.low_information_caption(F.col("q")), q="chart 12") is False
    assert one(spark, P.ocr_failed(F.col("c"), F.col("n"), F.col("w"), F.col("a")), c=60.0, n=50, w=10, a=0.4) is False
    assert one(spark, P.answer_in_content(F.col("e"), F.col("c"), False), e="beam beam", c="a beam") is True and one(spark, P.answer_in_content(F.col("e"), F.col("c"), True), e="beam beam", c="a beam") is False
    assert one(spark, X.failure_reason(F.col("c"), F.col("n"), F.col("w"), F.col("a")), c=59.9, n=50, w=9, a=0.5) == "confidence=59.9<60; tokens=9<10"
