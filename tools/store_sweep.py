"""Store-size sweep: one ingest micro-batch against stores of 1x, 10x, 100x
the batch (SURVEY section 6: the lookup against a growing store is the only
cost that grows).

usage: python tools/store_sweep.py [SF_DIR] [multipliers, e.g. 1,10,100]

The store is built from ``documents``: copy k of a document gets id
``pulselive_<doc_id>`` for k = 0 (the ids the batch will meet) and
``pulselive_<doc_id>-<k>`` otherwise.  The batch is the second crawl of
the documents.  Prints one JSON line per store size with the batch time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import functions as F

    from articleflow import schema as S
    from articleflow.operators.changes import with_content_hash
    from articleflow.operators.store import ArticleStore
    from articleflow.plans import fixtures as FX
    from articleflow.session import build_session, scratch_path
    from articleflow.streaming.ingest import ingest_batch

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    mults = [int(x) for x in (sys.argv[2] if len(sys.argv) > 2 else "1,10,100").split(",")]
    spark = build_session("local[8]")
    arts = with_content_hash(FX.articles_from_documents(spark, sf, 0).filter(F.col("ord") < 10**12))
    raw = FX.document_pages(spark, sf, 1)
    raw.write.mode("overwrite").parquet(batch_path := scratch_path(spark, "sweep-batch"))
    raw = spark.read.parquet(batch_path)
    reg = FX.registry_from_documents(spark, sf)
    n = arts.count()
    for m in mults:
        store = ArticleStore(spark, scratch_path(spark, f"sweep-store-{m}"), 8)
        copies = arts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        copies = copies.withColumn("id", F.when(F.col("_k") == 0, F.col("id"))
                                          .otherwise(F.concat("id", F.lit("-"), F.col("_k").cast("string"))))
        store.write_batch(0, copies.select(*S.ARTICLE_COLS))
        t0 = time.perf_counter()
        ingest_batch(raw, 1, reg, store, scratch_path(spark, f"sweep-changes-{m}"))
        dt = time.perf_counter() - t0
        print(json.dumps({"store_rows": n * m, "batch_rows": n, "multiplier": m, "batch_sec": round(dt, 3)}),
              flush=True)


if __name__ == "__main__":
    main()
