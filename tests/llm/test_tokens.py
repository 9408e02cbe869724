import random

import pyarrow as pa
import pytest

from pagewright.llm.budget import signed_deltas, snapshot, token_budget
from pagewright.llm.encoding import encode_corpus
from pagewright.llm.mixing import mix_documents, water_fill
from pagewright.llm.tokenizer import Tokenizer, encoder

PARTS = ["a", "b ", " ", "  ", "\n", "\n\n", "\t", " ", "　", "'", "'s", "'ll", "!", "..", "é", "я", "9", "12", "字", "👍🏽", "\r\n", "jq", "zx", "<|endoftext|>", "_", "-", "\x85", "​", "word"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_fragments_encode_as_the_whole(name):
    e = encoder(Tokenizer(name))
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["x" * 20_000, "word " * 5000]
    got = e.encode(pa.array(texts)).to_pylist()
    assert got == [e._encoding.encode_ordinary(t) for t in texts]
    assert e.count(pa.array(texts)).tolist() == [len(x) for x in got]


def test_encode_null_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello wor ld", "x"), (3, "hello wor ld", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(rows).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) == 4
    assert encode_corpus(rows.where("false")).collect() == []


def cells(df):
    return sorted((r.type, r.source, r.lang, r.domain, r.n_chunks, r.n_tokens) for r in df.collect())


def test_budget_by_deltas_equals_budget_from_scratch(spark, make_chunks, tmp_path, monkeypatch):
    from pagewright.llm import budget

    catalog = lambda rows: spark.createDataFrame(rows, "doc_id string, source string, lang string, domain string")
    first = catalog([("d1", "s1", "EN_en", "x"), ("d1", "s1", "EN_en", "x"), ("d2", None, "", None), ("d4", "s4", "de", "y")])
    second = catalog([("d1", "s9", "en", "x"), ("d2", "s2", "fr", None)])
    old = make_chunks([("c1", "one two"), ("c1", "one two"), ("c2", "gone soon"), ("c3", "same"), ("c4", None), ("c5", "  "), ("c6", "failed", {"status": "failed"}), ("g1", "of a removed document", {"doc_id": "d4"})])
    new = make_chunks([("c1", "one two three"), ("c3", "same"), ("c7", "added text", {"doc_id": "d2", "type": "Image-OCR "}), ("c8", "same", {"doc_id": "d3"}), ("c9", "added text"), ("c9", "added text")])
    folder = f"file://{tmp_path}/state"
    assert cells(budget.snapshot(old, first).cube) == [("text", "s1", "en", "x", 3, 5), ("text", "s4", "de", "y", 1, 4)]
    token_budget(old, first, folder)
    before = budget.read_state(spark, folder)
    encoded, count = [], budget.with_token_count
    monkeypatch.setattr(budget, "with_token_count", lambda rows, *a, **k: encoded.extend(r.content for r in rows.collect()) or count(rows, *a, **k))
    after = snapshot(new, second, before=before)
    assert sorted(encoded) == ["added text", "one two three"]  # unseen contents only, each once
    assert cells(after.cube) == cells(snapshot(new, second).cube) == cells(budget.cube_of(after.units))
    deltas = signed_deltas(before.units, after.units)
    assert {r.doc_id for r in deltas.where("n_chunks < 0").collect()} == {"d1", "d4"}
    report = token_budget(new, second, folder).collect()
    total = next(r for r in report if r.by == "all")
    assert total.n_chunks == 5 and total.n_tokens == sum(r.n_tokens for r in report if r.by == "type")
    assert {r.source for r in report if r.by == "source"} == {"s9", "s2", "unknown"}
    assert sorted(map(str, token_budget(new, second, folder).collect())) == sorted(map(str, report))  # nothing changed
    with pytest.raises(ValueError):
        budget.read_state(spark, folder, Tokenizer("byte_bpe_multi_50k"))
    assert token_budget(new.where("false"), second, folder).collect() == [] and token_budget(new.where("false"), second, folder + "2").collect() == []


def plain_water_fill(shares, caps, total):
    given, free = {}, dict(shares)
    left = total
    while free:
        weight = sum(free.values())
        over = [s for s in free if left * free[s] / weight >= caps[s]]
        if not over:
            return given | {s: left * w / weight for s, w in free.items()}
        for s in over:
            given[s] = caps[s]
            del free[s]
        left = total - sum(given.values())
    return given


def test_water_filling_against_plain_rounds(spark):
    rng = random.Random(3)
    targets, sizes, want = [], {}, {}
    for m in range(12):
        names = [f"s{i}" for i in range(6)]
        w = [rng.random() for _ in names]
        reps = [rng.randint(1, 4) for _ in names]
        targets += [(m, n, x / sum(w), r) for n, x, r in zip(names, w, reps)]
    sizes = {f"s{i}": rng.choice([0, 10, 50, 300, 2000]) for i in range(6)}
    for m in range(12):
        ts = [t for t in targets if t[0] == m]
        want |= {(m, n): v for n, v in plain_water_fill({t[1]: t[2] for t in ts}, {t[1]: t[3] * sizes[t[1]] for t in ts}, 1000.0).items()}
    from pyspark.sql import functions as F

    plan = water_fill(spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int"), spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, n_tokens bigint, n_docs bigint"), F.lit(1000))
    got = {(r.mix_id, r.source): r.planned for r in plan.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6), k


def test_mix_repeats_and_shares(spark):
    docs = spark.createDataFrame([(i, "tok " * 10, "big" if i < 90 else "small") for i in range(100)] + [(200, None, "big"), (201, "x", None), (0, "tok " * 10, "big")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([(1, "big", 0.5, 1), (1, "small", 0.5, 3), (1, "none", 0.0, 2)], "mix_id int, source string, target_share double, max_repeats int")
    chosen, report = mix_documents(docs, targets)
    rows = chosen.collect()
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)
    assert all(r.repeats == 3 for r in rows if r.source == "small") and all(r.repeats == 1 for r in rows if r.source == "big")
    r = {x.source: x for x in report.collect()}
    assert r["small"].epochs == 3.0 and r["none"].used_tokens == 0 and r["big"].actual_share == pytest.approx(r["big"].planned_share, abs=0.02)
    assert sorted(map(tuple, mix_documents(docs, targets)[0].collect())) == sorted(map(tuple, rows))
    assert mix_documents(docs.where("false"), targets)[0].collect() == []
