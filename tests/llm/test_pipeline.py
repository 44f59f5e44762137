import random
import zlib

import numpy as np
import pytest
from test_decontamination import plain_score
from test_similar import plain_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from carpalake.llm.decontamination import words_of  # noqa: E402
from carpalake.llm.queries import word_tokenizer  # noqa: E402
from carpalake.llm.toxicity import judge_toxicity  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ru") for b in ("ra", "so", "ti", "vu", "wy", "xe")]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(6)]
    docs, labels = [], []
    for i in range(150):
        text = rng.choices(words, k=rng.randrange(20, 400))
        toxic = rng.random() < 0.2
        if toxic:
            text += ["grotz", "flemp", "grotz"]
        if i % 11 == 3:
            text += items[i % 6][1].split()
        docs.append((i, " ".join(text), "xx", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(200 + i, docs[i][1], "xx", "s", 1) for i in range(0, 60, 4)]
    docs += [(300 + i, docs[i][1].replace(" ", "\n", 3), "xx", "s", 1) for i in range(1, 60, 5)]
    docs += [(400, None, None, None, None), (401, "", "xx", "s", 0), (402, "", "xx", "s", 0), (403, " ", "xx", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    return path


def test_run_against_plain_stages(spark, folder):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    judged = judge_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    bad = {r.doc_id for r in judged if r.toxic}
    assert bad == {i for i, r in docs.items() if "grotz" in (r.text or "")}
    left = {i: r.text or "" for i, r in docs.items() if i not in bad}
    newest = {}
    for i, t in left.items():
        newest[t] = max(i, newest.get(t, -1))
    left = {i: t for t, i in newest.items()}
    least = plain_components([(i, t, 1) for i, t in sorted(left.items())])  # the stage's own rule
    left = {i: t for i, t in left.items() if least[i] == i}
    items = [words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(plain_score(w, words_of(t)) >= 3.2 * len(w) for w in items)}
    t = Tokenizer.from_file(word_tokenizer())
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in left.items()}
    pieces = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: [*range(len(x))] for i, x in ids.items()}


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_take_repeated_rows_null_ids_and_other_columns(spark, folder):
    """Repeated rows leave exact dedup as one; columns with names that the stages use go through."""
    from pyspark.sql import functions as F

    one = "kara loso miti nuvu pewy ruxe karo loti mivu nuwy " * 3
    new = [(1001, one), (1001, one), (None, one + "kara"), (None, None), (1005, ""), (1006, one + "loso kara"), (1007, "grotz flemp grotz " + one), (1007, "grotz flemp grotz " + one)]
    old = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 150").select("doc_id", "text")
    docs = old.unionByName(spark.createDataFrame(new, "doc_id long, text string")).select("*", *[F.lit(c).alias(c) for c in ("__id", "__tag", "id", "tag", "node", "kept", "key", "docs")])
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept[name] = [(r.doc_id, r.text) for r in out.collect() if r.doc_id is None or r.doc_id > 1000]
        assert set(kept[name]) <= set(new)
    assert sorted(i or 0 for i, _ in kept["toxicity"]) == [0, 0, 1001, 1001, 1005, 1006]
    assert sorted(i or 0 for i, _ in kept["exact_dedup"]) == [0, 1001, 1005, 1006, 1007] and (None, None) not in kept["exact_dedup"]
    assert sorted(i or 0 for i, _ in kept["near_dedup"]) == [1001, 1001, 1005, 1007, 1007]
    assert len(kept["decontamination"]) == len(new)
    assert corpus_pipeline.packing(spark, docs, folder).filter("doc_id > 1000 OR doc_id IS NULL").count() >= len(new)
