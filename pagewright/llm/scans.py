"""Problem 4: repairing text read from scanned pages.

Running lines are lines at page edges that recur, up to misread, dropped or added characters
and an added page number, on several pages of their document. Page numbers are lines that
only number their page: with its own number, or one of a sequence that keeps its distance to
the pages of the document. What remains is joined to paragraphs; words torn at line ends are
put together by the vocabulary of the lexicon and the whole corpus; words outside running
lines whose misread form maps to one word of the lexicon are corrected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pagewright.llm.quality import lexicon_words
from pagewright.plans.lineage import materialize

LEAST_CONFIDENCE = 60.0
#: Pages of a document that a line must recur on.
LEAST_PAGES = 3
#: Times, and share of all words, that a word must occur inside lines to belong to the corpus vocabulary: fragments of torn words grow in number with the corpus, but not in share.
LEAST_COUNT, LEAST_SHARE = 3, 5e-6
#: Lines at either end of a chunk that witness recurrence; others count where a page ends inside the chunk.
EDGE_LINES = 2
#: Characters by which the keys of a running line may differ, of keys at least so long; and length of the ends of which one must be equal.
EDITS, LONG_KEY, KEY_END = 2, 12, 6
#: Rows of text in one task of the passes in Python.
ROWS_IN_PART = 8_000

#: Characters that recognition confuses, as known from the literature on scanning. Each row is a class; several letters come first.
LATIN_CLASSES = ["rn m", "cl d", "vv w", "ii n", "c e é è ê", "f t", "i í ì ï 1 l | !", "o ö 0", "s 5 $", "g 9 q", "u n ü", "h b 6 8", "z 2", "a à ä"]
CYRILLIC_CLASSES = ["ьг ы", "ь1 ы", "о o 0", "а a", "е e с c", "р p", "х x", "у y", "к k", "м m", "т t г", "в b 8", "б 6", "з 3", "ч 4", "н h п и л"]
#: Marks left by hyphenation, as printed or as misread.
BREAK_MARKS = "-‐‑–_~¬\xad"
#: How pages are numbered, in the languages of the corpus.
PAGE_LINE = re.compile(r"^[\W_]*(?:(?:pa[g9]e|pa[g9]|seite|страница|стр|p|pp|s|с)\b\.?\s*)?(\d{1,4})(?:\s*(?:/|of|von|sur|из|de)\s*(\d{1,4}))?\s*(?:(?:pa[g9]e|seite|стр|с)\b\.?)?[\W_]*$", re.IGNORECASE)
_DECORATED = re.compile(r"[^\W\d_]|/|^[\W_]+\d+[\W_]+$")

_LETTERS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"(?<![\w|!$])(?=[\w|!$]*[^\W\d_])[\w|!$]+(?![\w$])")
_GAP = re.compile(rf"(?<=[^\W_|!$])([{BREAK_MARKS}])?[ \t]*\n\s*(?=[^\W_]|[|!$])|(?<=[|!$])([{BREAK_MARKS}])?[ \t]*\n\s*(?=[^\W_])|(?<=[^\W_])([{BREAK_MARKS}]) (?=[^\W_])")
_RIGHT = re.compile(r"(?:[^\W_]|[|!$])+")


def _folder(classes: list[str]) -> tuple[list[tuple[str, str]], dict[int, str]]:
    rows = [c.split(" ") for c in classes]
    return [(a, r[-1]) for r in rows for a in r if len(a) > 1], {ord(a): r[0] for r in rows if len(r[0]) == 1 for a in r}


_LATIN, _CYRILLIC = _folder(LATIN_CLASSES), _folder(CYRILLIC_CLASSES)


def skeleton(text: str, with_pairs: bool = True) -> str:
    """Classes of characters that recognition confuses; equal for a text and its misread forms."""
    text = text.lower()
    several, single = _CYRILLIC if any("а" <= c <= "я" for c in text) else _LATIN
    for a, b in several if with_pairs else ():
        text = text.replace(a, b)
    return text.translate(single)


def running_key(line: str) -> str:
    """What recurs of a running line: no added page number, case, spacing or misread character."""
    return " ".join(skeleton(_without_number(line)).split())


def _without_number(line: str) -> str:
    return re.sub(r"^[\W_]*\d{1,4}[\W_]*(?=\s)|(?<=\s)[\W_]*\d{1,4}[\W_]*$", "", line.strip()).strip()


class Corrector:
    """Maps misread words to words of a lexicon, through their common skeleton."""

    def __init__(self, lexicon: list[str]):
        self.words = frozenset(lexicon)
        self._of: dict[str, list[str]] = {}
        for word in sorted(self.words):
            for key in {skeleton(word), skeleton(word, False)}:
                self._of.setdefault(key, []).append(word)
        self.intended = lru_cache(maxsize=200_000)(self._intended)

    def _intended(self, word: str) -> str | None:
        """The word of the lexicon with the same skeleton, the nearest if there are several; None for words of the lexicon."""
        if word in self.words or len(word) < 3:
            return None
        like = self._of.get(skeleton(word)) or self._of.get(skeleton(word, False))
        return min(like, key=lambda w: (_edits(word, w), w)) if like else None


def _edits(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def is_page_number(line: str, page: int | None) -> bool:
    """A line that only numbers the page: near its own number, or with a label or dashes when the page is unknown."""
    m = PAGE_LINE.match(line.strip())
    if not m:
        return False
    return abs(int(m.group(1)) - page) <= 1 if page is not None else bool(_DECORATED.search(line.strip()))


def page_distance(line: str, page: int | None) -> int | None:
    """How far the number of a line that only has a number is from its page; None for other lines and an unknown page."""
    m = PAGE_LINE.match(line.strip())
    return int(m.group(1)) - page if m and page is not None else None


def candidate_lines(text: str, page: int | None, common: frozenset[str]) -> list[tuple[int, int, str, bool]]:
    """(line number, pages after the chunk's own, line, at an edge) that may be running lines: not part of a sentence."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip() and not is_page_number(x, page)]
    numbered = [i for i, x in enumerate(lines) if is_page_number(x, page)]
    at = set(filled[:EDGE_LINES]) | set(filled[-EDGE_LINES:])
    for i in filled:
        # Inside a chunk a page ends where a number or a gap is.
        if any(0 < abs(i - n) <= 2 for n in numbered) or (i and not lines[i - 1].strip()) or (i + 1 < len(lines) and not lines[i + 1].strip()):
            at.add(i)
    out = []
    for i in filled:
        line, bare = lines[i].strip(), _without_number(lines[i])
        words = _LETTERS.findall(line.lower())
        if not words or not bare or bare[-1] in ".,;:!?" + BREAK_MARKS or line[0] in "|•▪" or "\t" in line or len({w for w in words if w in common}) > 2:
            continue
        if words and line.count("|") < 2 and not line[0].islower():
            out.append((i, sum(filled[0] < n < i for n in numbered), line, i in at))
    return out


def _unknown(body: str, corrector: Corrector) -> tuple[list[tuple[re.Match[str], str]], list[tuple[re.Match[str], re.Match[str], str]]]:
    """Words outside the lexicon with their lower-cased form, and neighbours in a line that make one word of it without the space."""
    words, before, before_known, before_word = corrector.words, None, True, ""
    unknown, spaced = [], []
    for m in _TOKEN.finditer(body):
        word = m.group().lower()
        known = word in words
        if not known:
            unknown.append((m, word.strip("_")))
        if not (known and before_known) and before is not None and len(word) + len(before_word) >= 5 and before.end() + 1 == m.start() and body[before.end()] == " " and before_word + word in words:
            spaced.append((before, m, before_word + word))
        before, before_known, before_word = m, known, word
    return unknown, spaced


def _misread(unknown: list[tuple[re.Match[str], str]], corrector: Corrector, covered: list[tuple[int, int]]) -> Iterator[tuple[re.Match[str], str]]:
    for m, word in unknown:
        if (meant := corrector.intended(word)) and not any(a <= m.start() < b for a, b in covered):
            yield m, meant


# --- operators -----------------------------------------------------------------------------------


def scanned(chunks: DataFrame) -> DataFrame:
    """Distinct chunks whose content was recognised well enough: the cases that are repaired.

    The texts are shuffled once, into parts of ``ROWS_IN_PART`` rows; joins by chunk and content need no other shuffle of them.
    """
    good = (F.col("metadata.ocr_confidence") >= LEAST_CONFIDENCE) & (F.col("metadata.processing_status") == "success") & F.col("content").isNotNull() & F.col("chunk_id").isNotNull()
    rows = chunks.where(good)
    n_parts = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_IN_PART))
    placed = rows.select("chunk_id", "doc_id", "page", "content", F.xxhash64("content").alias("content_hash")).repartition(n_parts, "chunk_id", "content_hash")
    return placed.groupBy("chunk_id", "content_hash").agg(F.first("doc_id").alias("doc_id"), F.first("page").alias("page"), F.first("content").alias("content"))


def corpus_vocabulary(chunks: DataFrame) -> DataFrame:
    """(word) that occurs at least ``LEAST_COUNT`` times, and as ``LEAST_SHARE`` of all words, inside lines; words next to a line end may be halves and do not count."""
    torn = rf"\p{{L}}*[{BREAK_MARKS.replace('-', chr(92) + '-')}]?[ \t]*[\r\n]+\s*\p{{L}}*|\p{{L}}+[{BREAK_MARKS.replace('-', chr(92) + '-')}] \p{{L}}+"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = pc.replace_substring_regex(pc.utf8_lower(batch.column(0).cast(pa.large_string())), torn, " ")
            counted = pc.value_counts(pc.split_pattern_regex(inner, r"[^\p{L}]+").flatten())
            yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1)], ["word", "n"])

    words = chunks.where("content is not null").select("content").mapInArrow(run, "word string, n bigint").where("word <> ''")
    counts = materialize(words.groupBy("word").agg(F.sum("n").alias("n")), "scan-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(LEAST_COUNT, LEAST_SHARE * total)).select("word")


def marked_lines(chunks: DataFrame, common: list[str]) -> DataFrame:
    """(chunk_id, content_hash, running, numbers): line numbers of running lines, and of page numbers that only their sequence shows.

    All recognised chunks of a document count as witnesses, whatever their confidence. Lines
    at the edges are the witnesses of recurrence; every line like one that recurs there is
    marked, as a page may change anywhere inside a chunk. The lines are found in one pass and
    written once.
    """
    witnesses = chunks.where("metadata.ocr_confidence is not null and content is not null and chunk_id is not null").select("doc_id", "page", "chunk_id", "content")
    common_set = frozenset(common)
    names = ["doc_id", "page", "chunk_id", "line_no", "running_key", "content_hash", "edge", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, page, chunk, text, h in zip(*(batch.column(i).to_pylist() for i in range(5))):
                rows += [(doc, None if page is None else page + later, chunk, no, running_key(line), h, edge, None) for no, later, line, edge in candidate_lines(text, page, common_set)]
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                filled = [i for i, x in enumerate(lines) if x.strip()]
                rows += [(doc, page, chunk, no, None, h, no in filled[:EDGE_LINES] + filled[-EDGE_LINES:], d) for no in filled if (d := page_distance(lines[no], page)) is not None and not is_page_number(lines[no], page)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int32()))], names)

    schema = "doc_id string, page int, chunk_id string, line_no int, running_key string, content_hash bigint, edge boolean, distance int"
    lines = materialize(witnesses.withColumn("content_hash", F.xxhash64("content")).mapInArrow(run, schema).where("distance is not null or length(running_key) >= 4"), "scan-lines")
    at = ["chunk_id", "content_hash", "line_no"]
    running = recurring_lines(lines.where("running_key is not null")).select(*at, F.lit(True).alias("is_running"))
    numbers = numbered_lines(lines.where("distance is not null")).select(*at, F.lit(False).alias("is_running"))
    both = running.unionByName(numbers).distinct()
    of = lambda yes: F.collect_set(F.when(F.col("is_running") == yes, F.col("line_no")))
    return both.groupBy("chunk_id", "content_hash").agg(of(True).alias("running"), of(False).alias("numbers"))


def recurring_lines(lines: DataFrame) -> DataFrame:
    """The lines like one that recurs on at least ``LEAST_PAGES`` pages of its document.

    A key on two pages and more is a centre; with it go keys of its document within ``EDITS``
    edits, which share its first or last characters. The pages of all of them count.
    """
    ends = lambda rows: rows.withColumn("end", F.explode(F.array(F.concat(F.lit("<"), F.substring("running_key", 1, KEY_END)), F.concat(F.lit(">"), F.expr(f"right(running_key, {KEY_END})")))))
    witnessed = lines.where("edge").select("doc_id", "running_key", "page").distinct()
    centres = witnessed.groupBy("doc_id", "running_key").agg(F.count("page").alias("pages")).where("pages >= 2").select("doc_id", "running_key")
    every = lines.select("doc_id", "running_key").distinct()
    long = F.length("running_key") >= LONG_KEY
    left, right = ends(every.where(long)), ends(centres.where(long)).select("doc_id", "end", F.col("running_key").alias("centre"))
    near = left.join(right, ["doc_id", "end"]).where((F.abs(F.length("running_key") - F.length("centre")) <= EDITS) & (F.levenshtein("running_key", "centre", EDITS) >= 0)).select("doc_id", "running_key", "centre")
    near = near.unionByName(centres.select("doc_id", "running_key", F.col("running_key").alias("centre"))).distinct()
    recurring = witnessed.join(near, ["doc_id", "running_key"]).groupBy("doc_id", "centre").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    keys = near.join(recurring, ["doc_id", "centre"], "left_semi").select("doc_id", "running_key").distinct()
    return lines.join(keys, ["doc_id", "running_key"], "left_semi")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """The lines with nothing but a number that keep one distance to the page, at the edges of at least ``LEAST_PAGES`` pages and of half of the pages that have such a line.

    A chunk may hold a page change, so the distance next above counts with it.
    """
    edge = lines.where("edge").select("doc_id", "page", "distance").distinct()
    pages = edge.groupBy("doc_id").agg(F.count_distinct("page").alias("all_pages"))
    with_next = edge.unionByName(edge.withColumn("distance", F.col("distance") - 1))
    kept = with_next.groupBy("doc_id", "distance").agg(F.count_distinct("page").alias("pages")).join(pages, "doc_id").where((F.col("pages") >= LEAST_PAGES) & (2 * F.col("pages") >= F.col("all_pages")))
    kept = kept.select("doc_id", F.explode(F.array(F.col("distance"), F.col("distance") + 1)).alias("distance")).distinct()
    return lines.where("edge").join(kept, ["doc_id", "distance"], "left_semi")


def _body(text: str, page: int | None, running: set[int], numbers: set[int]) -> tuple[list[tuple[str, str]], str]:
    """Running lines and page numbers as (kind, item), and the text without them."""
    items, kept, dropped = [], [], False
    for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        if i in running or i in numbers or is_page_number(line, page):
            items.append(("running_header" if i in running else "page_number", " ".join(line.split())))
            dropped = True
        elif line.strip() or not dropped:
            kept.append(line)
            dropped = False
    return items, "\n".join(kept)


def _torn(body: str, corrector: Corrector, is_table: bool) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(begin, end, left, right, whole, evidence) of words that may be torn. evidence: ``mark`` at a line end or inside a line, else ``none``."""
    if is_table:
        return
    for gap in _GAP.finditer(body):
        begin = gap.start()
        while begin and (body[begin - 1].isalnum() or body[begin - 1] in "|!$"):
            begin -= 1
        left, right = _RIGHT.match(body, begin, gap.start()), _RIGHT.match(body, gap.end())
        if not left or not right or not _LETTERS.search(left.group()):
            continue
        before, after = body[left.start() - 1 : left.start()], body[right.end() : right.end() + 1]
        if before and before in BREAK_MARKS or not (right.group()[0].islower() or right.group()[0].isdigit() or right.group().isupper()):
            continue
        if after and after in BREAK_MARKS and body[right.end() + 1 : right.end() + 2].isalnum():
            continue
        mark = gap.group(1) or gap.group(2) or gap.group(3)
        a, b = left.group().lower(), right.group().lower()
        yield left.start(), right.end(), a, b, a + b, "mark" if mark else "none"


def scan_rows(chunks: DataFrame, common: list[str]) -> DataFrame:
    """(chunk_id, content_hash, page, content, running, numbers) of the cases; the marked lines are written once."""
    marked = materialize(marked_lines(chunks, common), "scan-marked")
    return scanned(chunks).join(marked, ["chunk_id", "content_hash"], "left").select("chunk_id", "content_hash", "page", "content", "running", "numbers")


def scan_findings(rows: DataFrame, known: list[str]) -> DataFrame:
    """(chunk_id, content_hash, kind, item, left, right, evidence): all findings, torn words not yet decided."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corrector = _corrector(tuple(known))
        for batch in batches:
            out = []
            for chunk, h, page, text, marked, numbers in zip(*(batch.column(i).to_pylist() for i in range(6))):
                items, body = _body(text, page, set(marked or ()), set(numbers or ()))
                out += [(chunk, h, kind, item, None, None, None) for kind, item in items]
                table = body.count("|") > 4 or body.count("\t") > 3
                covered = []
                for begin, end, left, right, whole, evidence in _torn(body, corrector, table):
                    meant = corrector.intended(whole) if whole not in corrector.words else whole
                    if meant is not None and meant != whole and not (left in corrector.words and right in corrector.words):
                        out.append((chunk, h, "misread", meant, None, None, None))
                    out.append((chunk, h, "hyphen_break", meant or whole, left, right, evidence))
                    if meant is not None:
                        covered.append((begin, end))
                unknown, spaced = _unknown(body, corrector)
                for left, right, whole in spaced:
                    out.append((chunk, h, "hyphen_break", whole, left.group().lower(), right.group().lower(), "none"))
                    covered.append((left.start(), right.end()))
                out += [(chunk, h, "misread", meant, None, None, None) for _, meant in _misread(unknown, corrector, covered)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, (pa.string(), pa.int64(), *[pa.string()] * 5))], names)

    names = ["chunk_id", "content_hash", "kind", "item", "left", "right", "evidence"]
    found = rows.mapInArrow(run, "chunk_id string, content_hash bigint, kind string, item string, left string, right string, evidence string")
    return materialize(found, "scan-findings")  # several steps read it; the texts are gone through once


@lru_cache(maxsize=2)
def _corrector(known: tuple[str, ...]) -> Corrector:
    return Corrector(list(known))


def decided_breaks(torn: DataFrame, vocabulary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(left, right, item, evidence) that are one word: dehyphenation by the lexicon and the vocabulary of the corpus.

    With a mark the whole must be known, or a half must be unknown (two known halves of an
    unknown whole are a compound broken at its own hyphen). Without a mark the whole must be
    known and a half unknown; the corpus, which has fragments of torn words too, speaks for a
    half only where the whole is no word of the lexicon.
    """
    cases = torn.select("left", "right", "item", "evidence").distinct()
    needed = cases.select(F.explode(F.array("left", "right", "item")).alias("word")).distinct()
    of_lexicon = lexicon.where("word is not null").select(F.lower("word").alias("word"), F.lit(True).alias("in_lexicon"))
    words = vocabulary.select("word", F.lit(False).alias("in_lexicon")).unionByName(of_lexicon).join(needed, "word", "left_semi").groupBy("word").agg(F.bool_or("in_lexicon").alias("in_lexicon"))
    for c in ("left", "right", "item"):
        cases = cases.join(words.select(F.col("word").alias(c), F.col("in_lexicon").alias(f"{c}_known")), c, "left")  # NULL where neither knows it
    halves = F.col("left_known").isNotNull() & F.col("right_known").isNotNull()
    sure_halves = F.coalesce(F.col("left_known") & F.col("right_known"), F.lit(False))
    whole = F.col("item_known").isNotNull()
    unmarked = whole & F.when(F.col("item_known"), ~sure_halves).otherwise(~halves)
    return cases.where(F.when(F.col("evidence") == "mark", whole | ~halves).otherwise(unmarked)).select("left", "right", "item", "evidence")


def scan_noise(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(chunk_id, kind, item) of what is repaired in well-recognised chunks.

    NULL content, NULL or low confidence and failed chunks are no case; a NULL page takes no
    part in recurrence or sequences and its page numbers need a label. Repeated rows count once; empty
    tables give no rows. Texts are read whole.
    """
    known, common = lexicon_words(lexicon)
    found = scan_findings(scan_rows(chunks, common), known)
    sure = found.where("kind <> 'hyphen_break'").select("chunk_id", "kind", "item")
    torn = found.where("kind = 'hyphen_break'").select("chunk_id", "kind", "item", "left", "right", "evidence").distinct()
    joined = torn.join(decided_breaks(torn, corpus_vocabulary(chunks), lexicon), ["left", "right", "item", "evidence"], "left_semi")
    return sure.unionByName(joined.select("chunk_id", "kind", "item")).distinct()


def _like(word: str, meant: str) -> str:
    """``meant`` in the case of ``word``."""
    return meant.upper() if word.isupper() and len(word) > 1 else meant.capitalize() if word[:1].isupper() else meant


def _repaired(body: str, corrector: Corrector, joined: set[tuple[str, str]]) -> str:
    """Paragraphs without torn words and misread characters."""
    table = body.count("|") > 4 or body.count("\t") > 3
    edits = [(b, e, body[b : b + len(left)] + body[e - len(right) : e]) for b, e, left, right, _, _ in _torn(body, corrector, table) if (left, right) in joined]
    edits += [(a.start(), b.end(), a.group() + b.group()) for a, b, _ in _unknown(body, corrector)[1] if (a.group().lower(), b.group().lower()) in joined]
    out, at = [], 0
    for begin, end, text in sorted(edits):
        if begin >= at:
            out += [body[at:begin], text]
            at = end
    body = "".join(out) + body[at:]
    out, at = [], 0
    for m, meant in _misread(_unknown(body, corrector)[0], corrector, []):
        out += [body[at : m.start()], _like(m.group(), meant)]
        at = m.end()
    body = "".join(out) + body[at:]
    if table:
        return body.strip()
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[^\S\n]*\n", body) if p.strip())


def repaired_scans(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(chunk_id, content, n_repairs): continuous paragraphs of every well-recognised chunk.

    Rules and undefined cases as in ``scan_noise``; tables keep their lines. Several contents
    of one chunk_id give a row each.
    """
    known, common = lexicon_words(lexicon)
    rows = scan_rows(chunks, common)
    found = scan_findings(rows, known)
    torn = found.where("kind = 'hyphen_break'").select("chunk_id", "content_hash", "item", "left", "right", "evidence").distinct()
    joined = torn.join(decided_breaks(torn, corpus_vocabulary(chunks), lexicon), ["left", "right", "item", "evidence"], "left_semi")
    keys = ["chunk_id", "content_hash"]
    joined = joined.groupBy(*keys).agg(F.collect_set(F.concat_ws(" ", "left", "right")).alias("joined"))
    rows = rows.join(joined, keys, "left").select("chunk_id", "page", "content", "running", "numbers", "joined")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corrector = _corrector(tuple(known))
        for batch in batches:
            out = []
            for chunk, page, text, marked, numbers, pairs in zip(*(batch.column(i).to_pylist() for i in range(6))):
                items, body = _body(text, page, set(marked or ()), set(numbers or ()))
                repairs = len(items) + len(pairs or ()) + sum(1 for _ in _misread(_unknown(body, corrector)[0], corrector, []))
                out.append((chunk, _repaired(body, corrector, {tuple(x.split(" ")) for x in pairs or ()}), repairs))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.string(), pa.int32()))], ["chunk_id", "content", "n_repairs"])

    return rows.mapInArrow(run, "chunk_id string, content string, n_repairs int")
