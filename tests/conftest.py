import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from pagewright.plans.shipping import ship

    ship(s)
    s.conf.set("spark.sql.unionOutputPartitioning", "false")
    yield s
    s.stop()


META = "struct<processing_status: string, ocr_confidence: double, image_type: string, ingest_ts: string>"


@pytest.fixture(scope="session")
def make_chunks(spark):
    """Chunks from (chunk_id, content) with further fields by name."""
    def make(rows, **common):
        full = []
        for r in rows:
            d = {"doc_id": "d1", "page": 1, "type": "text", "status": "success", "conf": None, "image_type": None, **common, **(r[2] if len(r) > 2 else {})}
            full.append((d["doc_id"], d["page"], r[0], d["type"], r[1], (d["status"], d["conf"], d["image_type"], "2026-01-01T00:00:00Z")))
        return spark.createDataFrame(full, f"doc_id string, page int, chunk_id string, type string, content string, metadata {META}")

    return make


@pytest.fixture(scope="session")
def lexicon(spark):
    words = {
        "en": "the a of is with and that for in was at robust beam lens signal shows exceeds when result measured filter thermal detector section described compressor improves closed loop while which table",
        "de": "der die das und ist wird sensor druck filter messung gemessen robuste nicht kann werden",
        "fr": "le la les et est avec capteur signal mesuré robuste filtre dans",
        "ru": "и в на не датчик сигнал фильтр измеренный показано что при может быть рисунке",
    }
    common = set("the a of is with and that for in was at when while which der die das und ist wird nicht kann werden le la les et est avec dans и в на не что при может быть".split())
    return spark.createDataFrame([(w, lang, w in common) for lang, ws in words.items() for w in ws.split()], "word string, lang string, is_common boolean")
