"""Problem 2: defective question-answer pairs, each with its defects."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from pagewright.functions.sql import is_blank, words
from pagewright.llm.quality import lexicon_words
from pagewright.plans.lineage import materialize

#: Words that stand for nothing when an answer has no other.
NOTHING = ["none", "null", "nil", "nan", "n/a", "na", "n.a.", "tbd", "tba", "undefined", "empty", "blank", "nothing", "keine", "leer", "k. a.", "k.a.", "entfällt", "aucun", "aucune", "néant", "vide", "s.o.", "s/o", "нет", "н/д", "пусто", "нет данных", "ничего"]
#: What may come before a refusal.
APOLOGY = r"^(?:(?:i'm|i am|we're) (?:sorry|afraid)(?: that)?|sorry|unfortunately|regrettably|after (?:reading|checking|reviewing) [^:.,]{1,40}:|leider|es tut mir leid|tut mir leid|désolée?|je regrette|malheureusement|извините|простите|к сожалению)[\s,.:!]*(?:but|aber|mais|но)?\s*"
_SOURCE_EN = r"(?:pages?|text|passages?|excerpts?|context|documents?|materials?|sources?|information|content)"
#: Sentences that only say that no answer can be given, lower-cased, apology removed.
REFUSALS = [
    r"(?:i|we)(?: am|'m| are|'re) (?:not able|unable) to (?:determine|answer|say|view|tell|find|help|see|provide|confirm)\b.*",
    r"(?:i|we) (?:cannot|can not|can't|could not|couldn't|do not|don't|won't|will not) (?:answer|say|tell|know|find|determine|help|provide|have (?:enough|sufficient|the))\b.*",
    r"as an? (?:ai|assistant|language model)\b.*(?:not|n't|unable)\b.*",
    rf"(?:(?:the|my|this|these|your) )?(?:\w+ )?{_SOURCE_EN} (?:\w+ )?(?:do not|does not|don't|doesn't|did not|never|lacks?|ends? before|says? nothing|contains? no|gives? no|offers? no|(?:is|are) (?:not|insufficient))\b.*",
    rf"(?:nothing|nowhere) in (?:the|this|these|my) (?:\w+ )?{_SOURCE_EN}\b.*",
    r"(?:there (?:is|was) )?(?:no|not enough|insufficient) (?:answer|information|material|data|context|evidence)(?: (?:here|there|was|is|could be|can be|found|available|given|provided|possible|to (?:answer|tell|say)|in the \w+(?: \w+)?))*",
    r"(?:the )?(?:answer|information) (?:is |was )?not (?:available|given|provided|stated|found|contained)\b.*",
    r"(?:it|this|that) (?:is not possible|is impossible|cannot|can't|can not|could not) (?:to (?:answer|say|tell|determine)|be (?:answered|determined|established|told))\b.*",
    r"you (?:would need|will need|'d need|should|have) to consult\b.*",
    r"(?:das|dies|die frage) (?:lässt sich|kann) .*nicht .*(?:beantworten|beantwortet|sagen|feststellen|bestimmen|ermitteln).*",
    r"(?:dazu|hierzu|darüber|dafür) (?:kann|können) (?:ich|wir) (?:leider )?(?:keine|nichts|nicht)\b.*",
    r"ich (?:kann|könnte) .*(?:nicht|keine) .*(?:beantworten|sagen|geben|antworten|helfen|finden).*",
    r"ich weiß (?:es |das )?nicht",
    r"(?:der|die|das|dieser|diese) (?:\w+ )?(?:text|unterlagen|seiten?|dokumente?|auszug|abschnitt|quellen?|kontext|material) .*(?:an keiner stelle|keine (?:angaben?|auskunft|informationen|antwort)|nichts|nicht)\b.*",
    r"(?:hierfür|dafür|dazu) (?:fehlen|fehlt|gibt es|liegen) .*(?:informationen|angaben|daten|keine|information).*",
    r"keine (?:antwort|angaben?|informationen?|auskunft)(?: (?:gefunden|vorhanden|verfügbar|möglich|im text|in den \w+))*",
    r"aucune (?:réponse|information|donnée)\b(?!.*\d).*",
    r"impossible de (?:répondre|déterminer|dire|le savoir)\b(?!.*\d).*",
    r"(?:il est|c'est) impossible de (?:répondre|déterminer|dire)\b(?!.*\d).*",
    r"(?:les|ces|cette|la|le|ce) (?:\w+ )?(?:pages?|textes?|documents?|passages?|extraits?|contexte|sources?)(?: \w+)? n(?:e |')\w+ (?:pas|rien|aucune?|nulle part)\b.*",
    r"je (?:ne (?:sais|peux|trouve|puis|dispose|suis)|n'ai) pas?\b.*",
    r"(?:недостаточно|не хватает|нет) (?:сведений|данных|информации|материала)(?: (?:для|чтобы) .*)?",
    r"не удалось (?:найти|определить|установить) .*(?:информаци|ответ|сведени|данны).*",
    r"(?:я )?не (?:могу|смогу|удаётся|получится) (?:ответить|сказать|определить|помочь|найти).*",
    r"(?:я )?(?:этого )?не знаю",
    r"(?:ответ|информация|сведения)(?: об этом)? (?:в|на|из) (?:\w+ )?(?:материалах|тексте|документе|страницах|отрывке|фрагменте) (?:отсутству\w+|не \w+|нет)",
    r"(?:ответ|информация|сведения|данные) (?:отсутству\w+|не найден\w*|недоступн\w*)",
    r"в (?:\w+ )?(?:страницах|тексте|документе|материалах|отрывке|фрагменте|контексте) (?:этого |об этом |такого |ничего |ответа |нет|не |ни слова).*",
    r"(?:текст|документ|отрывок|фрагмент|материал)\w* (?:ничего )?не (?:\w+).*",
    r"по (?:этому|этим|данному|приведённ\w+|предоставленн\w+) (?:фрагменту|тексту|страницам|отрывку|документу|материалам) (?:нельзя|невозможно|не).*",
    r"(?:на этот вопрос )?(?:ответить )?(?:нельзя|невозможно) (?:ответить|сказать|определить).*",
    r"на этот вопрос (?:ответить )?(?:нельзя|невозможно|не).*",
]
#: Names of the fields that may stand before a copied question.
LABEL = r"^\s*[\"«„“]?\s*\p{L}{1,12}\s?:\s+"
LANGUAGES = ["de", "en", "fr", "ru"]
#: Words whose scores a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 200_000
#: Least uses of a word, and most of them before a final stop, for it to never or seldom end a sentence.
NEVER, SELDOM = (20, 0.004), (5, 0.05)
QUOTED = r"\"[^\"]{1,80}\"|«[^»]{1,80}»|„[^“”]{1,80}[“”]|“[^”]{1,80}”"


def _plain(text: Column) -> Column:
    """Words with case folded both ways, so that ß and SS agree."""
    return words(F.lower(F.upper(text)))


def empty_answer(answer: Column) -> Column:
    """NULL, blank, only marks, or only a word that stands for nothing."""
    bare = F.regexp_replace(F.lower(F.trim(answer)), r"^[\s\[(<{\"'«.-]+|[\s\])>}\"'».!-]+$", "")
    return is_blank(answer) | ~answer.rlike(r"[\p{L}\p{N}]") | bare.isin(NOTHING) | F.lower(F.trim(answer)).isin(NOTHING)


def copied_question(question: Column, answer: Column) -> Column:
    """The question's words in order, at most the first three left out, perhaps twice or after a label."""
    def same(text: Column) -> Column:
        a, q, out = _plain(text), _plain(question), F.lit(False)
        for skip in range(4):
            rest = F.slice(q, skip + 1, F.greatest(F.size(q) - skip, F.lit(0)))
            out = out | ((F.size(rest) > 0) & ((a == rest) | (a == F.concat(rest, rest)) | (a == F.concat(q, rest))))
        return out

    # One- and two-word rests are ordinary short answers.
    enough = F.size(_plain(answer)) >= 3
    return F.coalesce(enough & (same(answer) | (answer.rlike(LABEL) & same(F.regexp_replace(answer, LABEL, "")))), F.lit(False))


# --- rules on the text of an answer --------------------------------------------------------------

_REFUSED = "(?U)^(?:" + "|".join(f"(?:{p})" for p in REFUSALS) + ")$"
_APOLOGIES = f"(?U)^(?:{APOLOGY.removeprefix('^')})+"


def is_refusal(answer: Column) -> Column:
    """Every sentence is a refusal or an apology, and one is a refusal."""
    text = F.regexp_replace(F.regexp_replace(F.replace(F.lower(answer), F.lit("’"), F.lit("'")), r"(?U)\s+", " "), r'^[ "«»„“”]+|[ "«»„“”]+$', "")
    told = F.transform(F.split(text, r"(?<=[.!?]) +(?=\S)"), lambda x: F.regexp_replace(F.regexp_replace(x, _APOLOGIES, ""), "[ .!?…]+$", ""))
    told = F.filter(told, lambda x: x != "")
    return F.coalesce((F.size(told) > 0) & F.forall(told, lambda x: x.rlike(_REFUSED)), F.lit(False))


def ending(answer: Column) -> Column:
    """struct(broken, last_word): broken off by its marks for certain; else the last word where no mark follows it."""
    text = F.regexp_replace(answer, r"(?U)\s+$", "")
    body = F.regexp_replace(F.regexp_replace(text, r"(?:\.{2,}|…)+$", ""), r"(?U)\s+$", "")
    count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    cut, last = body != text, F.lower(F.regexp_extract(body, r"(\p{L}+)$", 1))
    opened = body.rlike(r"[,;:(\[{«„“‘–—-]$") | (count('"') % 2 == 1)
    for left, right in ("()", "[]", "«»", "{}"):
        opened = opened | (count(left) > count(right))
    broken = body.rlike(r"\p{L}") & (opened | (cut & ~body.rlike(r"[.!?]$")))
    return F.struct(F.coalesce(broken, F.lit(False)).alias("broken"), F.when(~broken & ~cut & (last != ""), last).alias("last_word"))


class LanguageModel:
    """Naive Bayes over character trigrams of words, fitted on a lexicon whose words carry a language."""

    def __init__(self, rows: list[tuple[str, str]]):
        grams: dict[str, Counter[str]] = {lang: Counter() for lang in LANGUAGES}
        self._words: dict[str, set[str]] = {}
        for word, lang in rows:
            if lang in grams and word:
                grams[lang].update(self._of(word))
                self._words.setdefault(word, set()).add(lang)
        kinds = len(set().union(*grams.values())) + 1
        self._log = {lang: ({g: math.log((n + 0.3) / (sum(c.values()) + 0.3 * kinds)) for g, n in c.items()}, math.log(0.3 / (sum(c.values()) + 0.3 * kinds))) for lang, c in grams.items()}

        self._known: dict[str, np.ndarray] = {}

    @staticmethod
    def _of(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def _word(self, word: str) -> np.ndarray:
        """Log-likelihood of a word per language; a word of the lexicon speaks against the languages that lack it."""
        found = self._known.get(word)
        if found is None:
            of = self._words.get(word)
            if of is not None:
                found = np.array([0.0 if lang in of else -6.0 for lang in LANGUAGES])
            elif len(word) > 2:
                found = np.array([max(-6.0, sum(table.get(g, rare) for g in self._of(word)) / len(word)) for table, rare in (self._log[lang] for lang in LANGUAGES)])
            else:
                found = np.zeros(len(LANGUAGES))
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[word] = found
        return found

    def languages(self, texts: pd.Series, margin: float) -> pd.Series:
        """The likeliest language of each text by the words that speak for one: no numbers, units after numbers or quoted terms. None if another comes within the margin."""
        plain = pc.utf8_lower(pa.array(texts.fillna(""), pa.large_string()))
        for pattern in (QUOTED, r"\p{Nd}[\p{Nd}.,]*\s?\p{L}{1,3}\b|\p{Nd}[\p{Nd}.,]*\s?[%°µ]\p{L}?"):
            plain = pc.replace_substring_regex(plain, pattern, " ")
        lists = pc.split_pattern_regex(plain, r"[^\p{L}]+")
        coded = lists.flatten().dictionary_encode()
        table = np.array([self._word(w) if len(w) >= 2 else np.zeros(len(LANGUAGES)) for w in coded.dictionary.to_pylist()]).reshape(-1, len(LANGUAGES))
        sums = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(table[coded.indices.to_numpy()], axis=0)])
        bounds = lists.offsets.to_numpy()
        scores = sums[bounds[1:]] - sums[bounds[:-1]]
        ranked = np.sort(scores, axis=1)
        sure = ranked[:, -1] - ranked[:, -2] >= margin
        return pd.Series(np.where(sure, np.array(LANGUAGES, object)[scores.argmax(axis=1)], None), index=texts.index, dtype=object)


# --- operators -----------------------------------------------------------------------------------


def shortened_versions(texts: DataFrame) -> DataFrame:
    """(text, inside_word) of the candidates that are a proper prefix of a whole text; (text, whole, candidate) are distinct by text.

    Texts are range-partitioned and sorted: the whole texts that continue a candidate follow
    it without a gap, so the next whole text decides. Each partition streams through in order
    and holds only candidates that are prefixes of one another; what is still open at a
    partition's end meets the first whole text after it, a row per partition.
    """
    ordered = texts.select("text", "whole", "candidate").where("text is not null").repartitionByRange("text").sortWithinPartitions("text").withColumn("part", F.spark_partition_id())
    columns = ["text", "inside_word", "part", "first", "open"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, part, open_ = None, None, []
        for frame in frames:
            rows = []
            for text, whole, candidate, part in zip(frame["text"], frame["whole"], frame["candidate"], frame["part"]):  # noqa: B007
                while open_ and not text.startswith(open_[-1]):
                    open_.pop()
                if whole:
                    first = text if first is None else first
                    rows += [(x, x[-1:].isalnum() and text[len(x)].isalnum(), None, None, None) for x in open_]
                    open_ = []
                if candidate:
                    open_.append(text)
            yield pd.DataFrame(rows, columns=columns, dtype=object)
        if part is not None:
            yield pd.DataFrame([(None, None, int(part), first, open_)], columns=columns, dtype=object)

    # Written once: both readers below must see the same partitions.
    out = materialize(ordered.mapInPandas(run, "text string, inside_word boolean, part int, first string, open array<string>"), "shortened")
    following = F.first("first", ignorenulls=True).over(W.orderBy("part").rowsBetween(1, W.unboundedFollowing))
    edges = out.where("part is not null").withColumn("following", following).select("following", F.explode("open").alias("text")).where(F.col("following").startswith(F.col("text")))
    edges = edges.select("text", (F.substring(F.col("following"), F.length("text") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]") & F.col("text").rlike(r"[\p{L}\p{N}]$")).alias("inside_word"))
    return out.where("text is not null").select("text", "inside_word").unionByName(edges)


def length_spikes(answers: DataFrame, reach: int = 4, factor: float = 6.0, least: int = 20) -> DataFrame:
    """(n_chars) at which far more answers without a final stop end than at the lengths around: a length limit at work.

    ``answers`` has n_chars. The histogram has one row per length, whatever the number of answers.
    """
    lengths = answers.groupBy("n_chars").agg(F.count("*").alias("n"))
    near = W.orderBy("n_chars").rangeBetween(-reach, reach)
    around = (F.sum("n").over(near) - F.col("n")) / (2.0 * reach)
    return lengths.withColumn("around", around).where((F.col("n") >= least) & (F.col("n") >= factor * F.greatest("around", F.lit(1.0)))).select("n_chars")


def word_endings(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n, ends): how often each word is used, and how often a final stop follows it, counted over all texts."""
    used = texts.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ended = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+)[.!?](?:\s|$)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("ends"))
    return used.join(ended, "word", "left").fillna(0, ["ends"])


def known_words(texts: DataFrame, lexicon: DataFrame, column: str = "text") -> DataFrame:
    """(word) of the lexicon, or used twice elsewhere than as the last word of a text."""
    inner = texts.select(F.explode(F.split(F.regexp_replace(F.lower(column), r"\p{L}+[^\p{L}]*$", ""), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where("n >= 2").select("word")
    return inner.unionByName(lexicon.where("word is not null").select(F.lower("word").alias("word"))).distinct()


def defective_pairs(dataset: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(entry_id, defect) of entries with has_answer true; an entry with two defects has two rows.

    An answer is truncated where its marks say so; where it or its last word is a shortened
    version, broken off inside a word, of another answer or of a known word; where its last
    word practically never ends a sentence; and, where another answer goes on after it or its
    length is at a limit, already if that word is unknown or seldom ends one (refusals, which
    often lack a stop, aside).

    Repeated rows count once. NULL has_answer is no case; a NULL question cannot be copied
    and has no language; NULL and blank answers are ``empty_answer`` and nothing else. An
    empty table gives no rows. The lexicon is a bounded table (see ``quality``).
    """
    lexicon_words(lexicon)  # raises if it is not bounded
    model = LanguageModel(sorted({(r.word, r.lang) for r in lexicon.where("word is not null").select(F.lower("word").alias("word"), "lang").distinct().collect()}))
    spoken = lambda margin: pandas_udf(lambda texts: model.languages(texts, margin), "string")
    rows = dataset.where("has_answer").select("entry_id", "question", F.col("expected_answer").alias("answer")).distinct()
    rows = rows.withColumn("empty", empty_answer(F.col("answer"))).withColumn("copied", ~F.col("empty") & copied_question(F.col("question"), F.col("answer")))
    told = rows.where(~F.col("empty")).withColumn("e", ending(F.col("answer")))
    told = told.withColumns({"refusal": is_refusal(F.col("answer")), "asked": spoken(4.0)("question"), "spoken": spoken(5.0)("answer"), "text": F.regexp_replace(F.regexp_replace("answer", r"(?:\.{2,}|…)+\s*$", ""), r"(?U)\s+$", "")})
    # Written once, as every step below reads it.
    told = materialize(told.select("entry_id", "copied", "refusal", "e.broken", "e.last_word", (F.col("asked") != F.col("spoken")).alias("foreign"), "text", F.length("answer").alias("n_chars"), (~F.col("answer").rlike(r"(?U)[.!?»”\")]\s*$")).alias("open_end")), "pairs")
    every = dataset.select(F.col("question").alias("text")).unionByName(dataset.select(F.col("expected_answer").alias("text"))).where("text is not null").distinct()

    last = told.where("last_word is not null").select(F.col("last_word").alias("word")).distinct()
    common = lexicon.where("word is not null and is_common").select(F.lower("word").alias("word")).distinct().withColumn("common", F.lit(True))
    share = lambda n, at_most: (F.col("n") >= n) & (F.col("ends") <= at_most * F.col("n"))
    endings = word_endings(every).join(last, "word", "left_semi").join(common, "word", "left").select("word", (F.col("common").isNotNull() & share(NEVER[0], NEVER[1])).alias("never_last"), share(SELDOM[0], SELDOM[1]).alias("seldom_last"))
    vocabulary = known_words(every, lexicon).withColumn("known", F.lit(True))
    # Words and answers are sorted together, told apart by a mark in front.
    marked = lambda mark, c: F.concat(F.lit(mark), F.col(c)).alias("text")
    stumps = last.join(vocabulary, "word", "full").select(marked("w", "word"), F.coalesce("known", F.lit(False)).alias("whole"), F.col("known").isNull().alias("candidate"))
    answers = told.groupBy("text").agg(F.bool_or("open_end").alias("candidate")).select(marked("a", "text"), F.lit(True).alias("whole"), "candidate")
    shortened = shortened_versions(stumps.unionByName(answers)).select(F.substring("text", 1, 1).alias("mark"), F.expr("substring(text, 2)").alias("text"), "inside_word")
    versions = shortened.where("mark = 'a'").select("text", "inside_word")
    stumps = shortened.where("mark = 'w'").select(F.col("text").alias("word"), F.lit(True).alias("stump"))
    facts = last.join(endings, "word", "left").join(vocabulary, "word", "left").join(stumps, "word", "left").withColumnRenamed("word", "last_word")
    spikes = length_spikes(told.where("open_end")).withColumn("spike", F.lit(True))
    judged = told.join(facts, "last_word", "left").join(versions, "text", "left").join(spikes, "n_chars", "left")
    yes = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False))
    evidence = F.col("open_end") & ~F.col("refusal") & (F.col("inside_word").isNotNull() | yes("spike"))
    weak_end = F.col("last_word").isNotNull() & (F.col("known").isNull() | yes("seldom_last"))
    inside = yes("stump") | (yes("inside_word") & F.col("open_end"))
    truncated = ~F.col("copied") & (F.col("broken") | yes("never_last") | inside | (evidence & weak_end))
    defects = F.array_compact(F.array(F.when(F.col("copied"), "copied_question"), F.when(F.col("refusal"), "refusal"), F.when(truncated, "truncated_answer"), F.when(F.col("foreign"), "other_language")))
    found = judged.select("entry_id", F.explode(defects).alias("defect"))
    return rows.where("empty").select("entry_id", F.lit("empty_answer").alias("defect")).unionByName(found).distinct()
