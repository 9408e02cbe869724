"""Question sets, judgments, metrics by slice and reports."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions.predicates import NO_ANSWER_PHRASE, clean_text, judged_well
from pagewright.functions.sql import is_blank
from pagewright.functions.text import anchor_span, image_anchor_span

SCORE_COLUMNS = ["faithfulness", "relevancy", "context_precision", "context_recall"]
#: Questions that no document answers.
UNANSWERABLE = [
    "What is the current stock price of Apple?", "Who won the FIFA World Cup in 2030?", "What is the weather forecast for tomorrow in Tokyo?", "How many employees does Google have as of today?", "What is the recipe for tiramisu?",
    "Who is the current president of Mars colony?", "What time does the next train to London depart?", "How much does a Tesla Model S cost in 2025?", "What is the population of Antarctica?", "Who invented the time machine?",
    "What are the symptoms of a fictional disease XYZ?", "How do you fix a broken quantum entanglement?", "What is the GDP of Atlantis?", "How many stars are visible from Proxima Centauri?", "What is the speed limit on Mars highways?",
]


def slice_metrics(judgments: DataFrame) -> DataFrame:
    """Mean scores per slice and over all; accuracy and false positives of the no-answer slice alone.

    Input: slice, the four scores, no_answer_correct (NULL where it does not apply), notes.
    Judgments with an error in their notes do not count; an unknown slice counts as overall.
    ``scope`` tells the row over all judgments from that of the slice named overall.
    """
    known = F.when(F.col("slice").isin("table", "image", "no-answer"), F.col("slice")).otherwise("overall")
    good = judgments.where(judged_well(F.col("notes"))).withColumn("slice", known)
    right, wrong = F.count_if(F.col("no_answer_correct")), F.count_if(~F.col("no_answer_correct"))
    rows = good.groupingSets([["slice"], []], "slice").agg(F.grouping("slice").alias("all_rows"), F.count("*").alias("count"), *(F.avg(c).alias(c) for c in SCORE_COLUMNS), right.alias("right"), wrong.alias("wrong"))
    ask = (F.col("all_rows") == 0) & (F.col("slice") == "no-answer")
    rate = lambda c: F.when(ask, F.try_divide(F.col(c).cast("double"), (F.col("right") + F.col("wrong")).cast("double")))
    return rows.select(
        F.when(F.col("all_rows") == 1, "overall").otherwise(F.col("slice")).alias("slice"), F.when(F.col("all_rows") == 1, "all").otherwise("slice").alias("scope"), "count",
        *(F.round(c, 3).alias(c) for c in SCORE_COLUMNS), F.round(rate("right"), 3).alias("no_answer_accuracy"), F.round(rate("wrong"), 3).alias("false_positive_rate"),
    )


def with_expected(predictions: DataFrame, dataset: DataFrame) -> DataFrame:
    """Adds the expected answer and the slice of each question; of repeated questions the last entry counts, unknown ones are overall."""
    last = dataset.groupBy("question").agg(F.max_by(F.struct("expected_answer", "slice"), "entry_id").alias("e"))
    return predictions.join(last, "question", "left").select(*predictions.columns, F.col("e.expected_answer").alias("expected_answer"), F.coalesce("e.slice", F.lit("overall")).alias("slice"))


def report_examples(judgments: DataFrame, order: str, most: int = 3) -> DataFrame:
    """The first examples of each report section: low faithfulness, and failures on unanswerable questions."""
    sections = F.array_compact(F.array(F.when(F.col("faithfulness") < 0.5, "low_faithfulness"), F.when(~F.col("no_answer_correct"), "no_answer_failure")))
    rows = judgments.withColumn("section", F.explode(sections))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("section").orderBy(order))).where(F.col("n") <= most)


def markdown_report(metrics: DataFrame, examples: DataFrame | None = None) -> str:
    """The report as text: a summary, a table of slices and the examples. Both inputs have a few rows by construction."""
    columns = ["slice", "scope", "count", *SCORE_COLUMNS, "no_answer_accuracy", "false_positive_rate"]
    lines = ["# Evaluation report", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    for r in sorted(metrics.select(*columns).collect(), key=lambda r: (r.scope != "all", r.slice)):
        lines.append("| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |")
    for section in ("low_faithfulness", "no_answer_failure") if examples is not None else ():
        lines += ["", f"## {section.replace('_', ' ').capitalize()}", ""]
        lines += [f"{r.n}. {r.question}" for r in sorted(examples.where(F.col("section") == section).collect(), key=lambda r: r.n)]
    return "\n".join(lines) + "\n"


def parse_scores(reply: Column, no_answer_case: Column) -> Column:
    """struct of scores from a judge's reply, in a code fence or bare; missing scores are 0, unreadable replies and scores beyond 0..1 give zeros and a note."""
    body = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    parsed = F.from_json(F.when(body != "", body).otherwise(reply), "faithfulness double, relevancy double, context_precision double, context_recall double, no_answer_correct boolean, notes string", {"mode": "PERMISSIVE"})
    scores = [F.coalesce(parsed[c], F.lit(0.0)) for c in SCORE_COLUMNS]
    readable = F.coalesce(reply.rlike(r"(?s)\{.*\}"), F.lit(False)) & parsed.isNotNull()
    ok = readable & (F.array_min(F.array(*scores)) >= 0) & (F.array_max(F.array(*scores)) <= 1)
    note = F.when(ok, F.coalesce(parsed["notes"], F.lit(""))).when(readable, "Error: score out of range").otherwise("Error: unreadable reply")
    return F.struct(*(F.when(ok, s).otherwise(0.0).alias(c) for s, c in zip(scores, SCORE_COLUMNS)), F.when(ok & no_answer_case, parsed["no_answer_correct"]).alias("no_answer_correct"), note.alias("notes"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed: the least by a hash of seed and key."""
    return rows.withColumn("_order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_order", key).limit(n).drop("_order")


def anchored_questions(chunks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Question set rows of the overall slice, each asking for a span of a clean text chunk by its anchor."""
    usable = chunks.where(clean_text(F.col("content"), F.col("metadata.processing_status"), F.col("type"))).withColumn("a", anchor_span(F.col("content"))).where("a is not null")
    taken = seeded_sample(usable, "chunk_id", n, seed)
    question = F.concat(F.lit('What does the document say in the sentence whose phrase includes "'), F.col("a.anchor"), F.lit('"?'))
    return taken.select(question.alias("question"), F.lit("overall").alias("slice"), F.lit(True).alias("has_answer"), F.col("a.span").alias("expected_answer"), "doc_id")


def image_questions(chunks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Question set rows of the image slice: a phrase in an image by its anchor; a repeated question comes once."""
    usable = usable_rows(chunks, ["image_ocr", "image_caption"]).withColumn("a", image_anchor_span(F.col("content"))).where("a is not null")
    question = F.concat(F.lit('In the image, what phrase includes "'), F.col("a.anchor"), F.lit('"?'))
    once = usable.withColumn("question", question).groupBy("question").agg(F.min_by(F.struct("chunk_id", "doc_id", "a"), "chunk_id").alias("c"))
    taken = seeded_sample(once.select("question", "c.chunk_id", "c.doc_id", "c.a"), "chunk_id", n, seed)
    return taken.select("question", F.lit("image").alias("slice"), F.lit(True).alias("has_answer"), F.col("a.span").alias("expected_answer"), "doc_id")


def unanswerable_questions(spark_df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to n of the fixed questions that no document answers; ``spark_df`` only lends its session."""
    rows = spark_df.sparkSession.createDataFrame([(q,) for q in UNANSWERABLE], "question string")
    return seeded_sample(rows, "question", n, seed).select("question", F.lit("no-answer").alias("slice"), F.lit(False).alias("has_answer"), F.lit(NO_ANSWER_PHRASE).alias("expected_answer"), F.lit(None).cast("string").alias("doc_id"))


def slice_shortfall(dataset: DataFrame, targets: dict[str, int], min_ratio: float = 0.8) -> DataFrame:
    """(slice, n, target, short): whether a slice has fewer questions than its share of the target."""
    wanted = dataset.sparkSession.createDataFrame(sorted(targets.items()), "slice string, target int")
    counted = dataset.groupBy("slice").agg(F.count("*").alias("n"))
    return wanted.join(counted, "slice", "left").select("slice", F.coalesce("n", F.lit(0)).alias("n"), "target", (F.coalesce("n", F.lit(0)) < min_ratio * F.col("target")).alias("short"))


def distinct_questions(dataset: DataFrame, order: str) -> DataFrame:
    """The first entry of each question of the image slice; other slices are kept whole."""
    first = F.row_number().over(W.partitionBy("slice", "question").orderBy(order)) == 1
    return dataset.withColumn("_first", first).where(F.col("_first") | (F.col("slice") != "image")).drop("_first")


def usable_rows(chunks: DataFrame, types: list[str]) -> DataFrame:
    """Successful chunks of the types with text: the ground of a slice."""
    return chunks.where(F.col("type").isin(types) & (F.col("metadata.processing_status") == "success") & ~is_blank(F.col("content")))


# --- answers in contents -------------------------------------------------------------------------

#: Answers and contents of one document that are held against each other at a time.
ANSWER_BLOCK, CONTENT_BLOCK = 8_192, 2_048
#: Characters that are in no token, whatever the engine's notion of a letter.
_NO_TOKEN = re.compile(r"[\s!-/:-@\[-^`{-~]+")


def _containing(contents: list[str]) -> Callable[[str], int]:
    """From a token without blanks or marks to the contents that have it anywhere, as a bit set."""
    of_word: dict[str, int] = {}
    for i, text in enumerate(contents):
        for w in set(_NO_TOKEN.split(text)):
            of_word[w] = of_word.get(w, 0) | 1 << i
    of_gram: dict[str, set[str]] = {}
    for w in of_word:
        for n in range(1, 5):
            for j in range(len(w) - n + 1):
                of_gram.setdefault(w[j : j + n], set()).add(w)

    @cache
    def find(token: str) -> int:
        grams = [token[j : j + 4] for j in range(max(1, len(token) - 3))]
        bits = 0
        for w in min((of_gram.get(g, ()) for g in grams), key=len):
            if token in w:
                bits |= of_word[w]
        return bits

    return find


def _matches(answers: list[tuple[str, list[str]]], contents: list[str]) -> list[tuple[int, int]]:
    """(strict, loose) of each answer: contents that have it verbatim, and those that have it so or two of its long tokens."""
    find, everything = _containing(contents), (1 << len(contents)) - 1

    @cache
    def hits(text: str, tokens: tuple[str, ...]) -> tuple[int, int]:
        verbatim, one, two = everything if text else 0, 0, 0
        for t in tokens:
            bits = find(t) if t else everything
            verbatim &= bits
            if len(t) > 3:
                two |= one & bits
                one |= bits
        left = verbatim
        if tokens != (text,):
            while left:
                low = left & -left
                if text not in contents[low.bit_length() - 1]:
                    verbatim ^= low
                left ^= low
        return verbatim.bit_count(), (verbatim | two).bit_count()

    return [hits(text, tuple(tokens)) for text, tokens in answers]


def answers_in_contents(answers: DataFrame, contents: DataFrame) -> DataFrame:
    """(entry_id, strict, loose): in how many contents of its document each answer is found.

    Counts what ``predicates.answer_in_content`` says of every answer (entry_id, doc_id,
    answer) and every content (chunk_id, doc_id, content) of the same document; entries without a
    content are left out. Blocks of answers meet blocks of contents, so no task holds a
    document; in a block each token is looked up once and the answers combine bit sets.
    """
    a = answers.select("entry_id", "doc_id", F.trim("answer").alias("text")).where("doc_id is not null and text is not null").distinct()
    c = contents.select("chunk_id", "doc_id", "content").where("doc_id is not null and content is not null")
    # Documents of more than one block: at most one per so many rows, so they are broadcast and the texts are shuffled once.
    blocks = lambda rows, name, size: F.broadcast(rows.groupBy("doc_id").agg(F.ceil(F.count("*") / size).cast("int").alias(name)).where(F.col(name) > 1))
    large = blocks(a, "answer_blocks", ANSWER_BLOCK), blocks(c, "content_blocks", CONTENT_BLOCK)
    number = lambda rows, blocks: F.pmod(F.xxhash64(*rows.columns), F.coalesce(blocks, F.lit(1))).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1))
    keys = ["doc_id", "answer_block", "content_block"]
    placed = lambda rows: rows.join(large[0], "doc_id", "left").join(large[1], "doc_id", "left")
    a = placed(a).withColumn("answer_block", number(a, F.col("answer_blocks"))).withColumn("content_block", every(F.col("content_blocks")))
    c = placed(c).withColumn("content_block", number(c, F.col("content_blocks"))).withColumn("answer_block", every(F.col("answer_blocks")))
    a = a.withColumn("text", F.lower("text")).select(*keys, "entry_id", "text", F.split("text", r"(?U)\W+").alias("tokens"))
    c = c.select(*keys, F.lower("content").alias("content"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _matches(list(zip(left["text"].to_pylist(), left["tokens"].to_pylist())), right["content"].to_pylist()) if left.num_rows and right.num_rows else []
        return pa.table({"entry_id": left["entry_id"] if found else pa.array([], pa.int64()), "strict": pa.array([x for x, _ in found], pa.int64()), "loose": pa.array([x for _, x in found], pa.int64())})

    parts = a.groupBy(keys).cogroup(c.groupBy(keys)).applyInArrow(run, "entry_id bigint, strict bigint, loose bigint")
    return parts.groupBy("entry_id").agg(F.sum("strict").alias("strict"), F.sum("loose").alias("loose"))
