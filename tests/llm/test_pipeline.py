import corpus_pipeline
from plumbline.llm.near_dedup import near_duplicates

from tests.llm.test_packing import check_packed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = source = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == source.columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        rows = [r.doc_id for r in after.select("doc_id").collect()]
        assert set(rows) <= ids and rows, name
        if name == "near_dedup":
            classes = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
            assert sorted(rows) == sorted(set(classes.values()))
        elif name != "mixing":
            assert len(rows) == len(set(rows))
        kept.append(len(rows))
        docs = after
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1}
    after_quality = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, source, SF).select("doc_id").collect()}
    assert len(good & after_quality) >= 0.97 * len(good)
    assert len(after_quality & (set(labels) - good)) <= 0.4 * (len(labels) - len(good)) + 1
    check_packed(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)


def odd(spark):
    """Odd rows and three sound documents, with columns whose names the stages use inside."""
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").collect()
    sound = [(r.doc_id, r.text) for r in docs if r.doc_id in labels and len(r.text.split()) > 80][:3]
    rows = [(1001, None), (1002, ""), (1003, "12 34 !"), (None, sound[0][1]), (1004, sound[1][1]), (1004, sound[1][1]), *sound]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _id string, rate int, component_id long, y int, p double"
    return spark.createDataFrame([(i, t, "en", None, 0, 0.5, f"row {k}", 1, 7, 0, 0.1) for k, (i, t) in enumerate(rows)], schema), rows, sound


def test_odd_documents(spark):
    frame, rows, sound = odd(spark)
    whole = {r._id: r for r in frame.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, SF)
        assert after.columns == frame.columns, name
        out[name] = after.collect()
        assert all(r == whole[r._id] for r in out[name]), name
    ids = [f"row {k}" for k in range(len(rows))]
    # rows without a letter go, all others are English
    assert sorted(r._id for r in out["language_id"]) == ids[3:]
    # a null text is judged as an empty one; good documents stay, with a repeated and without an id
    kept = {r._id for r in out["quality_classifier"]}
    assert kept >= set(ids[3:]) and ("row 0" in kept) == ("row 1" in kept)
    # of the repeated id and its original the smaller id stays; texts without words and rows without an id stay
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in out["near_dedup"])
    assert kept == sorted([-1, 1001, 1002, 1003, *(i for i, _ in sound)])
    # one language: its rate is its target, which none of its documents exceeds
    times = [sum(r._id == k for r in out["mixing"]) for k in ids]
    assert set(times) <= {0, 1} and sum(times) >= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    check_packed(packed, rows, 4096)


def test_empty_table(spark):
    frame = odd(spark)[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, frame, SF)
        assert after.count() == 0 and (name == "packing" or after.columns == frame.columns), name
