import hashlib

import pytest
from pyspark.sql import functions as F

from carpalake.llm.exact_dedup import _sha256, drop_exact, exact_groups

SCHEMA = "doc_id long, text string, digest string, id int, size long"
ROWS = [(i, f"text {i % 7}" if i % 5 else None, "x", i % 3, 1) for i in range(60)] + [(99, "", "x", 1, 1), (None, "text 3", "x", 1, 1), (None, "only null ids", None, None, None), (42, "text 0", "x", 0, 1), (42, "text 0", "x", 0, 1), (200, "long " * 100_000, "x", 1, 1), (201, "long " * 100_000, "x", 1, 1), (202, "Text 1", "x", 1, 1), (203, "text 1 ", "x", 1, 1)]


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((str(r[0]), keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [_sha256, lambda t: F.crc32(t.cast("binary")) % 3])
def test_groups(spark, digest):
    """Also with a digest that collides all the time."""
    got = exact_groups(spark.createDataFrame(ROWS, SCHEMA).repartition(5), salts=3, digest=digest).collect()
    assert sorted(((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == plain(ROWS)


def test_drop_keeps_whole_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = drop_exact(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len({r[1] or "" for r in ROWS})
    best = {}
    for r in ROWS:
        key = r[1] or ""
        best[key] = max(best.get(key, -1), -1 if r[0] is None else r[0])
    assert {(r.text or ""): (-1 if r.doc_id is None else r.doc_id) for r in got} == best
    for r in got:
        assert (r.doc_id, r.text, r.digest, r.id, r.size) in ROWS


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).count() == 0 and drop_exact(empty).count() == 0
