"""Queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm.budget import token_budget
from pagewright.llm.encoding import encode_corpus
from pagewright.llm.mixing import mix_documents
from pagewright.llm.neardup import similar_groups, similar_pairs
from pagewright.llm.pairs import defective_pairs
from pagewright.llm.pieces import oversized, split_oversized
from pagewright.llm.pii import personal_items, redacted
from pagewright.llm.quality import chunk_kinds, not_prose
from pagewright.llm.scans import repaired_scans, scan_noise
from pagewright.plans.lineage import shared_folder
from pagewright.sources.tables import table

#: Day before which the earlier snapshot of the incremental budget ends.
SNAPSHOT_DAY = "2026-01-01"


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return not_prose(table(spark, sf, "chunks"), table(spark, sf, "lexicon"))


def p1_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_kinds(table(spark, sf, "chunks"), table(spark, sf, "lexicon"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return defective_pairs(table(spark, sf, "dataset"), table(spark, sf, "lexicon"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_pairs(table(spark, sf, "chunks"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return similar_groups(table(spark, sf, "chunks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise(table(spark, sf, "chunks"), table(spark, sf, "lexicon"))


def p4_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return repaired_scans(table(spark, sf, "chunks"), table(spark, sf, "lexicon"))


def _state(spark: SparkSession) -> str:
    """A folder of its own for each run, in the shared folder; a deployment names a lasting one."""
    return f"{shared_folder(spark).rstrip('/')}/budget-{uuid.uuid4().hex}"


def p5_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return token_budget(table(spark, sf, "chunks"), table(spark, sf, "doc_catalog"), _state(spark))


def p5_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The same totals from an earlier state and signed deltas.

    The earlier state has what was ingested before a day, with text that was changed later in
    every seventh chunk (by hash), documents that were removed later, and another catalog: the
    languages as sources. All of that has to go again.
    """
    chunks, catalog, folder = table(spark, sf, "chunks"), table(spark, sf, "doc_catalog"), _state(spark)
    early = chunks.where(F.col("metadata.ingest_ts") < SNAPSHOT_DAY)
    changed = early.withColumn("content", F.when(F.pmod(F.xxhash64("chunk_id"), F.lit(7)) == 0, F.concat("content", F.lit(" (draft)"))).otherwise(F.col("content")))
    removed = early.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).withColumns({"doc_id": F.concat(F.lit("gone-"), "doc_id"), "chunk_id": F.concat(F.lit("gone-"), "chunk_id")})
    token_budget(changed.unionByName(removed), catalog.withColumn("source", F.col("lang")), folder)
    return token_budget(chunks, catalog, folder)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return oversized(table(spark, sf, "chunks"))


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "chunks"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal_items(table(spark, sf, "documents"), table(spark, sf, "lexicon"), table(spark, sf, "given_names"))


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(table(spark, sf, "documents"), table(spark, sf, "lexicon"), table(spark, sf, "given_names"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p3_found, p3_groups, p4_found, p4_repaired, p5_token_budget, p5_incremental, p6_found, p6_pieces, p7_ids, p8_mix, p8_shares, p9_found, p9_redacted)}


#: Unicode whitespace, line breaks and whitespace within a line, for an engine whose \s is ASCII and that has no look-behind.
_S = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BREAK = r"(?:\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}])"
_INLINE = r"[\t \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _words(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '{_S}+'), lambda w: w <> ''))"


def _fits(units: str) -> str:
    return f"list_max(list_transform({units}, lambda u: {_words('u')})) <= 308"


P3_SQL = r"""WITH t AS (SELECT DISTINCT chunk_id, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM chunks WHERE metadata.processing_status = 'success' AND chunk_id IS NOT NULL AND content IS NOT NULL),
s AS (SELECT DISTINCT chunk_id, array_to_string(w[i:i + 2], ' ') AS sequence FROM t, unnest(range(1, len(w) - 1)) r(i) WHERE len(w) >= 20), n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM s a JOIN s b ON a.sequence = b.sequence AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9"""

P6_SQL = rf"""SELECT DISTINCT chunk_id, CASE WHEN {_fits(f"string_split_regex(content, '{_BREAK}(?:{_INLINE}*{_BREAK})+')")} THEN 'paragraph' WHEN {_fits(f"string_split_regex(content, '{_BREAK}')")} THEN 'line'
WHEN {_fits(f"string_split_regex(regexp_replace(content, '([.!?]){_S}+', chr(92) || '1' || chr(10), 'g'), '{_BREAK}')")} THEN 'sentence' ELSE 'word' END AS boundary FROM chunks WHERE floor({_words('content')} * 1.3::double) > 400"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say on whole tables; the others are tested against brute force, round trips or labelled cases."""
    return {"p3_found": P3_SQL, "p6_found": P6_SQL}
