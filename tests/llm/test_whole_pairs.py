from pagewright.llm.pairs import defective_pairs


def test_a_length_spike_decides_on_unknown_stumps(spark, lexicon):
    pad = lambda i, size: f"the beam is robust x{i} at the lens and the filter with the signal of the sensor"[:size]
    tails = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(30)]
    cut = [(i, "What is measured?", True, (pad(i + 10, 50) + " zq" + t)) for i, t in enumerate(tails)]
    assert len({len(r[3]) for r in cut}) == 1
    known = "the beam is robust at the lens and the filter"
    known = known + " " * (len(cut[0][3]) - len(known) - 7) + " signal"  # as long as the others, but its last word is one
    whole = [(100, "What is measured?", True, known), (101, "What is measured?", True, "the beam at the zqx")]
    assert len(known) == len(cut[0][3])
    rows = spark.createDataFrame(cut + whole, "entry_id long, question string, has_answer boolean, expected_answer string")
    found = {r.entry_id for r in defective_pairs(rows, lexicon).where("defect = 'truncated_answer'").collect()}
    assert found == set(range(30))
