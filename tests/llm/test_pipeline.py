from collections import Counter

import corpus_pipeline
from test_exact import normal
from test_minhash import brute_force, variants

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, documents):
    """Each stage on what its predecessor kept, against plain Python where it is plain."""
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == documents.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["exact_dedup"]) <= set(kept["quality_rules"]) < {r.doc_id for r in documents.collect()}
    best = {}
    for doc_id, text in kept["quality_rules"].items():
        best[normal(text)] = min(best.get(normal(text), (0, 10**9)), (-len(text), doc_id))
    assert set(kept["exact_dedup"]) == {doc_id for _, doc_id in best.values()}
    near = brute_force(list(kept["exact_dedup"].items()), percent=80)
    assert set(kept["near_dedup"]) == {doc_id for doc_id, _, _, stays in near if stays}
    assert set(kept["secret_scan"]) == set(kept["near_dedup"])
    pieces = stage_pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    tokens = Counter()
    for r in stage_pieces:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in pieces) and set(tokens) == set(kept["secret_scan"])


def test_run(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() > 0


def test_near_copies_from_80_percent_go(spark):
    words = [f"w{i}" for i in range(300)]

    def changed(*places):
        return " ".join("x" if i in places else w for i, w in enumerate(words))

    # 5 of 296 shingles change with each word: 266 of 326 are 81.6 %, 261 of 331 are 78.9 %.
    rows = [(1, changed()), (2, changed(*range(20, 140, 20))), (3, changed(*range(150, 290, 20)))]
    rows += [(4, " ".join(f"v{i}" for i in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = brute_force(rows, percent=80)
    assert [doc_id for doc_id, _, _, stays in near if stays] == [1, 3, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SMALL).collect()) == [1, 3, 4]
    assert len([stays for *_, stays in brute_force(rows) if stays]) == 4


def test_near_dedup_equals_brute_force_at_80_percent(spark):
    rows = variants(5, groups=8, copies=12, length=120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = brute_force(rows, percent=80)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SMALL).collect())
    assert kept == sorted(doc_id for doc_id, _, _, stays in near if stays)
