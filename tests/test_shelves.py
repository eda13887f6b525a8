"""Files of pages lie on shelves, so that the driver neither moves nor lists a folder a page."""

import hashlib
import os

from assayer.plans import QUERIES, documents


def test_pages_lie_on_shelves(spark, tmp_path):
    pages = [(k, f"https://x/{k}", f"<p>{k}</p>\nä") for k in range(7, 157)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    got = sorted((r.page_id, r.bytes, r.h, r.place) for r in QUERIES["src_folder"](spark, str(tmp_path)).collect())
    assert got == [(k, len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), i) for i, (k, _, t) in enumerate(pages, 1)]
    new = [x for x in set(os.listdir(shared)) - before if x.startswith("folder-")]
    assert len(new) == 1 and 0 < sum(x.startswith("shelf=") for x in os.listdir(f"{shared}/{new[0]}")) <= documents.SHELVES
