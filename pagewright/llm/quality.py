"""Problem 1: text statistics per document, and an ordered rule list learned over them.

The statistics are Catalyst expressions. Rules are induced by incremental reduced-error
pruning on a bounded sample whose labels come from labelling functions: each names only
the plain cases of its kind and is silent otherwise. The learned thresholds are exported
to one SQL CASE expression, which is applied to all rows natively.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions.sql import blanks_split, is_blank

#: Rows that are labelled and fitted on, within a factor of two; chosen by the hash of their content over the whole table.
SAMPLE_ROWS = 9_000
#: Kinds in the order in which their rules are tried; the last is what no rule claims.
KINDS = ["junk", "table", "list", "prose"]
#: Largest lexicon that is turned into literals of an expression.
LEXICON_WORDS = 50_000

#: How a line of an enumeration begins.
MARKER = r"^\s*(?:[-–—•▪◦●■*·o]\s+|\(?\d{1,3}[.)]\s|\(\p{L}\)\s|\p{L}\)\s|\[\d{1,4}\]\s|\d{1,3}\s+[-–—]\s|\d{1,2}(?:\.\d{1,2}){1,3}\.?\s|\p{Lu}{2,}\d+\s*[-–—:=]\s)"
#: A table-of-contents line ends in leaders and a page number.
LEADERS = r"(?:\.\s?|…\s?|·\s?){4,}\s*\d+\s*$|…+\s*\d+\s*$"
#: What every match of LEADERS ends in, which is soon looked up.
LAST_NUMBER = r"\d\s*$"
CELL_GAP = r"(?:(?<=\s)|^)\|(?=\s|$)|\t|</?t[dhr]\b|\S {2,}(?=\S)"
#: Every match of CELL_GAP has one of these.
CELL_SIGNS = ["|", "\t", "<", "  "]
TIGHT_COMMA = r"\S[;,](?=\S)"
SENTENCE_END = r"[\p{Ll}\p{Lu}%°)\]»”\"][.!?…][»”\")]*(?=\s|$)"
#: A short segment that begins like a heading, maybe after a marker, and does not end like a sentence.
ITEM = r"^\s*(?:\P{L}{0,8}\s*)(?:\p{Lu}{2,}\d+\s*\S\s*)?\p{Lu}\S*(?:\s+\S+){0,10}(?<![.!?:])\s*$"
NUMBER_CELL = r"^[±+−-]?\d[\d.,]*%?$|^n/a$|^[-–—]$"
VOWEL = r"[aeiouyäöüàâéèêëîïôùûœæаеёиоуыэюя]"
LINE_BREAK = r"\r\n|[\n\r]"

FEATURES = [
    "n_tokens", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_punctuation", "common_share", "common_kinds", "known_share", "distinct_share", "number_share",
    "marker_share", "leader_share", "cell_share", "cells_per_token", "tight_commas", "sentence_rate", "high_latin_share", "replacement_share", "vowelless_share", "lower_line_share", "segment_tokens", "item_share", "letter_share",
]

#: The statistics that rules of a kind may use: those that speak of it in any language.
FEATURES_OF = {
    "junk": ["known_share", "distinct_share", "vowelless_share", "replacement_share", "high_latin_share", "letter_share", "symbol_ratio", "common_share"],
    "table": ["number_share", "cells_per_token", "cell_share", "tight_commas", "sentence_rate", "digit_ratio", "line_end_punctuation"],
    "list": ["marker_share", "leader_share", "item_share", "sentence_rate", "common_kinds", "common_share", "line_end_punctuation", "lower_line_share", "segment_tokens"],
}


def lexicon_words(lexicon: DataFrame) -> tuple[list[str], list[str]]:
    """All words and the common words of a lexicon of at most ``LEXICON_WORDS`` rows (a fixed table; more is an error, not a cut)."""
    rows = lexicon.where("word is not null").select(F.lower("word").alias("word"), "is_common").distinct().limit(LEXICON_WORDS + 1).collect()
    if len(rows) > LEXICON_WORDS:
        raise ValueError(f"the lexicon has over {LEXICON_WORDS} words")
    return sorted({r.word for r in rows}), sorted({r.word for r in rows if r.is_common})


def text_statistics(rows: DataFrame, text_column: str, known: list[str], common: list[str]) -> DataFrame:
    """``rows`` with the columns of ``FEATURES`` after the text; NULL and blank text gives zeros.

    Whole texts are measured, whatever their length. Where a slow pattern needs some character,
    texts and lines without it are spared the search.
    """
    t = F.coalesce(F.col(text_column), F.lit(""))
    share = lambda n, of: F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    may_have_cells = lambda x: reduce(or_, [x.contains(sign) for sign in CELL_SIGNS])
    base = rows.withColumns({
        "_lines": F.filter(F.split(F.replace(t, F.lit("\r"), F.lit("\n")), "\n"), lambda x: x.rlike(r"\S")),
        "_tokens": blanks_split(t),
        "_segments": F.filter(F.split(t, r"[\n\r;]+"), lambda x: x.rlike(r"\S")),
        "_alpha": F.filter(F.split(F.lower(F.when(t.contains("<"), F.regexp_replace(t, r"<[^<>]{1,40}>", " ")).otherwise(t)), r"[^\p{L}]+"), lambda w: w != ""),
        "_visible": left(r"(?U)\s+"),
        "_letters": left(r"[^\p{L}]+"),
        "_digits": left(r"[^\p{N}]+"),
    })
    base = base.withColumns({"_common": F.filter("_alpha", lambda w: w.isin(common)), "_long": F.filter("_alpha", lambda w: F.length(w) >= 3), "_n_alpha": F.size("_alpha"), "_n_tokens": F.size("_tokens"), "_line_chars": chars(F.col("_lines"))})
    lines, tokens, alpha, n_alpha, n_tokens, visible = (F.col(c) for c in ("_lines", "_tokens", "_alpha", "_n_alpha", "_n_tokens", "_visible"))
    in_lines = lambda pattern, first=lambda x: F.lit(True): share(chars(F.filter(lines, lambda x: first(x) & x.rlike(pattern))), F.col("_line_chars"))
    of_lines = lambda pattern: share(F.size(F.filter(lines, lambda x: x.rlike(pattern))), F.size(lines))
    return base.withColumns({
        "n_tokens": n_tokens.cast("double"),
        "mean_word_length": share(F.col("_letters"), n_alpha),
        "symbol_ratio": share(visible - F.col("_letters") - F.col("_digits"), visible),
        "digit_ratio": share(F.col("_digits"), visible),
        "line_end_punctuation": of_lines(r"[.!?…][»”\")]*\s*$"),
        "common_share": share(F.size("_common"), n_alpha),
        "common_kinds": F.size(F.array_distinct("_common")).cast("double"),
        "known_share": share(F.size(F.filter("_long", lambda w: w.isin(known))), F.size("_long")),
        "distinct_share": share(F.size(F.array_distinct(alpha)), n_alpha),
        "number_share": share(F.size(F.filter(tokens, lambda w: w.rlike(NUMBER_CELL))), n_tokens),
        "marker_share": in_lines(MARKER),
        "leader_share": in_lines(LEADERS, lambda x: x.rlike(LAST_NUMBER)),
        "cell_share": in_lines(rf"(?:(?:{CELL_GAP}).*?){{2,}}", may_have_cells),
        "cells_per_token": share(F.when(may_have_cells(t), count(CELL_GAP)).otherwise(0), n_tokens),
        "tight_commas": share(count(TIGHT_COMMA), n_tokens),
        "sentence_rate": share(count(SENTENCE_END), n_tokens),
        "high_latin_share": share(visible - left(r"[\u0080-ÿ\s]+"), visible),
        "replacement_share": share(visible - left(r"[�\s]+"), visible),
        "vowelless_share": share(F.size(F.filter(alpha, lambda w: (F.length(w) >= 3) & ~w.rlike(VOWEL))), n_alpha),
        "lower_line_share": of_lines(r"^\s*\p{Ll}"),
        "segment_tokens": share(n_tokens, F.size(F.col("_segments"))),
        "item_share": share(F.size(F.filter("_segments", lambda x: x.rlike(ITEM))), F.size("_segments")),
        "letter_share": share(F.col("_letters"), visible),
    }).drop("_lines", "_segments", "_long", "_tokens", "_alpha", "_visible", "_letters", "_digits", "_common", "_n_alpha", "_n_tokens", "_line_chars")


# --- labelling functions -------------------------------------------------------------------------

_PY_MARKER = re.compile(MARKER.replace(r"\p{L}\)", r"[^\W\d_]\)").replace(r"\(\p{L}\)", r"\([^\W\d_]\)").replace(r"\p{Lu}", "[A-ZÄÖÜÀ-ÞА-ЯЁ]"))
_PY_LEADERS = re.compile(LEADERS)
_PY_END = re.compile(r"[^\W_%°)\]»”\"]?[^\W\d_%°)\]»”\"][.!?…][»”\")]*(?=\s|$)")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(NUMBER_CELL)
_VOWEL = re.compile(VOWEL)


def _junk(text: str, words: list[str], known: set[str]) -> bool:
    visible = max(1, sum(not c.isspace() for c in text))
    if text.count("�") / visible > 0.05 or sum("\x80" <= c <= "\xff" for c in text) / visible > 0.45:
        return True
    if sum(len(x) for x in re.findall(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|&#?\w{1,7};", text)) / visible > 0.5:
        return True
    if sum(len(x) for x in re.findall(r"\b(?=[0-9a-zA-Z+/]*\d)(?=[0-9a-zA-Z+/]*[a-zA-Z])[0-9a-zA-Z+/]{16,}", text)) / visible > 0.5:
        return True
    known_share = sum(w in known for w in words) / max(1, len(words))
    if sum(c.isalnum() for c in text) / visible < 0.4 and known_share < 0.2:
        return True
    if len(words) < 4:
        return False
    if len(set(words)) / len(words) <= 0.15 and len(words) < 200 and known_share < 0.5:
        return True
    if sum(len(w) > 2 and not _VOWEL.search(w) for w in words) / len(words) > 0.5:
        return True
    return len(words) >= 8 and known_share < 0.12 and not re.search(r"\d", text)


def _table(text: str, lines: list[str]) -> bool:
    if re.search(r"<t[dr]\b", text):
        return True
    for mark, least in (("|", 2), ("\t", 2)):
        if len(lines) >= 2 and sum(x.count(mark) >= least for x in lines) / len(lines) > 0.6:
            return True
    cells = text.replace("|", " ").split()
    numbers = sum(bool(_NUMBER.match(x)) for x in cells) / max(1, len(cells))
    if len(lines) >= 3 and sum(len(re.findall(r"[;,](?=\S)", x)) >= 2 for x in lines) / len(lines) > 0.8 and not _PY_END.search(text):
        return True
    if len(lines) >= 3 and sum(bool(re.search(r"\S {2,}\S", x)) for x in lines) / len(lines) > 0.7 and len(re.findall(r"\d", text)) > 0.08 * len(text):
        return True
    return numbers > 0.3 and not _PY_END.search(text)


def _list(text: str, lines: list[str]) -> bool:
    chars = sum(map(len, lines))
    if len(lines) >= 3 and sum(len(x) for x in lines if _PY_MARKER.match(x) or _PY_LEADERS.search(x)) / chars > 0.85:
        return True
    parts = [x.strip() for x in re.split(r"[\n\r;]+", text) if x.strip()]
    bare = [x for x in parts if len(x.split()) <= 9 and x[:1].isupper() and not re.search(r"[.!?…]$", x)]
    return len(parts) >= 3 and len(bare) == len(parts)


def _prose(text: str, lines: list[str], words: list[str], common: set[str]) -> bool:
    """Running sentences: with sentence ends, or with the many function words that lists of headings lack."""
    ends = len(_PY_END.findall(text))
    tokens = text.split()
    marked = sum(len(x) for x in lines if _PY_MARKER.match(x)) / max(1, sum(map(len, lines)))
    numbers = sum(bool(_NUMBER.match(x)) for x in tokens) / max(1, len(tokens))
    used = [w for w in words if w in common]
    if marked >= 0.5 or numbers >= 0.2 or len(words) < 5 or len(re.findall(r"(?:^|\s)\|(?=\s|$)|\t", text)) >= 3:
        return False
    if ends and len(words) / ends >= 5 and (len(set(used)) >= 2 or not marked):
        return True
    return len(set(used)) >= 4 and len(used) / len(words) >= 0.22


def seed_label(text: str, known: set[str], common: set[str]) -> str | None:
    """The kind of a plain case; None where the functions are silent or disagree."""
    lines = [x for x in re.split(LINE_BREAK, text) if x.strip()]
    words = _WORD.findall(re.sub(r"<[^<>]{1,40}>", " ", text).lower())
    if _junk(text, words, known):
        return "junk"
    said = [k for k, yes in (("table", _table(text, lines)), ("list", _list(text, lines)), ("prose", _prose(text, lines, words, common))) if yes]
    return said[0] if len(said) == 1 else None


# --- incremental reduced-error pruning -----------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] <= self.value

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value!r}D"


@dataclass(frozen=True)
class Rule:
    kind: str
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out


def _best_cut(values: np.ndarray, positive: np.ndarray, most: int = 400) -> tuple[float, float, bool] | None:
    """(gain, cut, at_least) of the best cut through a feature; of cuts of nearly that gain the middle one, which leaves the widest margin.

    Cuts are midpoints of neighbouring values, thinned to quantiles, and an even grid that reaches into gaps.
    """
    distinct = np.unique(values)
    if len(distinct) < 2:
        return None
    mids = (distinct[1:] + distinct[:-1]) / 2
    if len(mids) > most:
        mids = np.quantile(mids, np.linspace(0, 1, most), method="nearest")
    cuts = np.unique(np.concatenate([mids, np.linspace(distinct[0], distinct[-1], 52)[1:-1]]))
    order = np.argsort(values, kind="stable")
    below = np.searchsorted(values[order], cuts, side="left")
    p_below = np.concatenate([[0], np.cumsum(positive[order])])[below]
    p, n = positive.sum(), len(values)
    base, best = np.log2(p / n), None
    for at_least, pp, all_ in ((True, p - p_below, n - below), (False, p_below, below)):
        gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(all_, 1)) - base), 0)
        if gain.max() > (best[0] if best else 1e-9):
            near = np.flatnonzero(gain >= 0.995 * gain.max())
            near = near[np.isin(near, np.arange(gain.argmax() - len(near), gain.argmax() + len(near)))]
            best = (float(gain.max()), float((cuts[near[0]] + cuts[near[-1]]) / 2), at_least)
    return best


def _grow(x: dict[str, np.ndarray], positive: np.ndarray, most_conditions: int = 5) -> list[Condition]:
    """Adds the condition of the highest information gain until no negative is left."""
    covered = np.ones(len(positive), bool)
    out: list[Condition] = []
    while len(out) < most_conditions and (covered & ~positive).any():
        best = max(((cut, f) for f, v in x.items() if (cut := _best_cut(v[covered], positive[covered]))), default=None)
        if best is None:
            break
        (_, value, at_least), feature = best
        out.append(Condition(feature, at_least, value))
        covered &= out[-1].holds(x)
    return out


def _prune(conditions: list[Condition], x: dict[str, np.ndarray], positive: np.ndarray) -> list[Condition]:
    """Drops final conditions while that raises (p - n) / (p + n) on the pruning part; a tie keeps the stricter rule."""
    def worth(cs: list[Condition]) -> float:
        hit = Rule("", tuple(cs)).holds(x)
        return (2 * (hit & positive).sum() - hit.sum()) / max(1, hit.sum())

    while len(conditions) > 1 and worth(conditions[:-1]) > worth(conditions):
        conditions = conditions[:-1]
    return conditions


def induce_rules(x: dict[str, np.ndarray], labels: np.ndarray, least_precision: float = 0.97, seed: int = 7, most_rules: int = 16, tries: int = 8) -> list[Rule]:
    """An ordered rule list: rules of each kind in turn, against all kinds after it.

    Two thirds of what is left grow a rule, one third prunes it. A kind ends when, after
    some splits, no further rule is precise enough on the pruning part.
    """
    rng = np.random.default_rng(seed)
    left = np.ones(len(labels), bool)
    rules: list[Rule] = []
    for kind in KINDS[:-1]:
        failed = 0
        while failed < tries and len(rules) < most_rules * len(KINDS):
            rows = rng.permutation(np.flatnonzero(left))
            grow, prune = np.split(rows, [2 * len(rows) // 3])
            if not (labels[grow] == kind).any() or not (labels[prune] == kind).any():
                break
            part = lambda at: ({f: x[f][at] for f in FEATURES_OF[kind]}, labels[at] == kind)  # noqa: B023, E731
            conditions = _grow(*part(grow))
            rule = Rule(kind, tuple(_prune(conditions, *part(prune)))) if conditions else None
            hit = rule.holds(x)[prune] if rule else np.zeros(len(prune), bool)
            if not hit.any() or (hit & (labels[prune] == kind)).sum() / hit.sum() < least_precision:
                failed += 1
                continue
            rules.append(rule)
            left &= ~(rule.holds(x) & (labels == kind))
        left &= labels != kind
    return rules


def rules_to_sql(rules: list[Rule]) -> str:
    """One CASE expression over the statistics; what no rule claims is prose."""
    arms = " ".join(f"WHEN {' AND '.join(c.sql() for c in r.conditions)} THEN '{r.kind}'" for r in rules)
    return f"CASE {arms} ELSE '{KINDS[-1]}' END" if rules else f"'{KINDS[-1]}'"


# --- operators -----------------------------------------------------------------------------------


def learned_kind(chunks: DataFrame, known: list[str], common: list[str], sample_rows: int = SAMPLE_ROWS) -> str:
    """The CASE expression learned on a sample of about ``sample_rows`` distinct contents, at most twice as many, taken by hash from the whole table."""
    n = chunks.count()
    share = min(1.0, sample_rows / max(n, 1))
    # A share of the hash values, not the least hashes: nothing but the sample leaves the tasks. Repeated contents come together and count once.
    taken = chunks.where((F.xxhash64(F.lit("quality"), "content") / 2.0**64 + 0.5) < share).where(~is_blank(F.col("content"))).select("content").distinct().limit(2 * sample_rows)
    sample = chunks.sparkSession.createDataFrame([(r.content,) for r in taken.collect()], "content string")
    rows = text_statistics(sample, "content", known, common).toPandas().sort_values("content", ignore_index=True)
    known_set, common_set = set(known), set(common)
    labels = np.array([seed_label(t, known_set, common_set) for t in rows["content"]], object)
    named = np.array([x is not None for x in labels], bool)
    if not named.any():
        return f"'{KINDS[-1]}'"
    return rules_to_sql(induce_rules({f: rows[f].to_numpy(float)[named] for f in FEATURES}, labels[named]))


def _with_kind(chunks: DataFrame, lexicon: DataFrame, case: str | None) -> DataFrame:
    known, common = lexicon_words(lexicon)
    case = case or learned_kind(chunks, known, common)
    rows = chunks.where(~is_blank(F.col("content"))).select("chunk_id", "content")
    return text_statistics(rows, "content", known, common).withColumn("kind", F.expr(case)).drop("content")


def chunk_kinds(chunks: DataFrame, lexicon: DataFrame, case: str | None = None) -> DataFrame:
    """(chunk_id, statistics, kind) of every distinct chunk with text.

    NULL and blank content is left out; repeated rows come out once; one chunk_id with
    several contents has a row for each. ``type`` is not looked at. Empty tables give no rows.
    """
    return _with_kind(chunks, lexicon, case).distinct()


def not_prose(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(chunk_id, kind) of the chunks whose content is a table, a list or junk.

    Only the statistics that the learned rules use are computed for all rows, each once: a filter
    on ``kind`` itself would be pushed below the statistics, with a copy of them for every
    mention in the rules, and they would be computed again for the rows it leaves. It does not
    pass a generator.
    """
    kinds = _with_kind(chunks, lexicon, None).select("chunk_id", F.stack(F.lit(1), "kind").alias("kind"))
    return kinds.where(F.col("kind") != "prose").distinct()
