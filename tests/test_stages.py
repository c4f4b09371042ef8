from pyspark.sql import functions as F

from logfault.plans import stages as S
from logfault.sources import standin


def test_logs_to_answers(spark, small):
    logs = standin.logs(spark, small).select("sn", "time", "server_model", "row_id", F.col("msg_lower").alias("msg"))
    log, templates = S.template_logs(logs)
    assert log.count() == logs.count()
    assert log.filter("template_id = 'None' OR msg_id IS NULL").count() == 0
    labels = standin.faults(spark, small).select("sn", "fault_time", "label")
    submit = standin.submit(spark, small).select("sn", "fault_time")
    crash = standin.crashdump(spark, small).select("sn", F.col("time").alias("fault_time"))
    venus = standin.venus(spark, small).select("sn", F.col("time").alias("fault_time"), "module")
    faults = S.prepare_faults(labels.unionByName(labels), submit, log)
    assert faults.count() == labels.count() + submit.count()
    text = S.fit_text(log, size=8, components=4)
    features = S.build_features(log, faults, crash, venus, text, size=8, components=4)
    features = S.materialise(features, "features")
    assert features.count() == faults.count()
    # keys, counts, times, frequencies, vectors, shares, last template, context and the row number
    assert len(features.columns) == 5 + 16 + 11 + 14 + 8 + 4 + 4 + 2 + 2 + 1 + 1
    answers, held, importance = S.train_and_predict(features, n_folds=2, trees=3, depth=3, rounds=2)
    assert answers.count() == submit.count()
    assert answers.filter("label NOT IN (0, 1, 2, 3)").count() == 0
    assert held.count() == labels.count()


def test_svd_and_vectors(spark, small):
    from logfault.operators import documents as D, factors as X
    docs = standin.table(spark, small, "documents").select("doc_id", "text")
    counts = D.term_counts(docs, ["doc_id"], "text", 1, 1)
    vocab = S.materialise(D.vocabulary(counts, docs.count(), 5, 200), "vocabulary")
    components, singular = X.fit_svd(counts, vocab, ["doc_id"], 4, rounds=40)
    assert singular == sorted(singular, reverse=True)
    v = [r["v"] for r in components.collect()]
    for i in range(4):
        for j in range(4):
            got = sum(row[i] * row[j] for row in v)
            assert abs(got - (i == j)) < 1e-6
    placed = X.project(counts, components, docs.select("doc_id"), ["doc_id"], 4)
    assert placed.count() == docs.count()
    # The exact decomposition of the same rows.
    import numpy as np
    terms = [r["term"] for r in vocab.orderBy("term").collect()]
    rows = X.unit_rows(counts, terms, vocab, ["doc_id"]).collect()
    matrix = np.zeros((len(rows), len(terms)))
    for i, r in enumerate(rows):
        matrix[i, r.ids] = r.weights
    _, exact, axes = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(singular, exact[:4], rtol=1e-6)
    loadings = np.array([r["v"] for r in components.orderBy("term").collect()])
    assert np.allclose(abs((axes[:4] * loadings.T).sum(axis=1)), 1, atol=1e-3)


def test_uncut_vocabulary_is_refused(spark, monkeypatch):
    import pytest
    from logfault.operators import factors as X
    monkeypatch.setattr(X, "MAX_TERMS", 3)
    vocab = spark.createDataFrame([(f"t{i}", 1.0) for i in range(4)], "term string, idf double")
    with pytest.raises(ValueError, match="max_features"):
        X._vocabulary_list(vocab)


def test_vocabulary_cut(spark):
    from logfault.operators import documents as D
    rows = [(d, f"t{i:02d}", 1 + i % 4) for i in range(40) for d in range(1 + i % 3)]
    counts = spark.createDataFrame(rows, "doc int, term string, tf bigint")
    totals = {}
    for _, term, tf in rows:
        totals[term] = totals.get(term, 0) + tf
    for keep in (1, 7, 20, 100):
        want = sorted(totals, key=lambda t: (-totals[t], t))[:keep]
        got = [r["term"] for r in D.vocabulary(counts, 3, 1, keep).collect()]
        assert sorted(got) == sorted(want)


def test_word_vectors_of_a_planted_corpus(spark):
    """Words in equal surroundings get close vectors; the vocabulary cut bounds the contexts, not the words."""
    import random
    import numpy as np
    from logfault.operators import embeddings as E
    from logfault.functions.cleaning import words
    rng = random.Random(5)
    topics = [[f"{t}{i}" for i in range(8)] for t in "abc"]
    rows = [(" ".join(rng.choices(topics[i % 3], k=10) + ["the", f"once{i}"]),) for i in range(600)]
    docs = spark.createDataFrame(rows, "text string").repartition(4)
    vectors = {r.word: np.array(r.vector) for r in E.fit_word_vectors(docs, words("text"), size=8).collect()}
    assert set(vectors) == {w for t in topics for w in t} | {"the"}
    unit = {w: v / np.linalg.norm(v) for w, v in vectors.items()}
    for topic in topics:
        for word in topic:
            near = sorted((w for w in unit if w not in (word, "the")), key=lambda w: -(unit[w] @ unit[word]))[:7]
            assert set(near) == set(topic) - {word}
    few = {r.word: r.vector for r in E.fit_word_vectors(docs, words("text"), size=8, max_features=5).collect()}
    assert set(few) == set(vectors) and all(len(v) == 8 for v in few.values())
    assert E.fit_word_vectors(docs.filter("false"), words("text")).count() == 0


def test_means_by_message_equal_means_by_word(spark):
    from logfault.operators import embeddings as E
    rows = [(i, [{"msg_lower": m} for m in msgs]) for i, msgs in enumerate([["a b", "a b", "c"], ["x"], [], ["b a a", "x c", ""]])]
    tails = spark.createDataFrame(rows, "fault_id int, tail array<struct<msg_lower string>>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 3.0])], "word string, vector array<double>")
    one = {r.fault_id: r.vector for r in E.mean_vectors(tails, ["fault_id"], E.tail_tokens(), vectors, 2).collect()}
    for most in (20_000, 1):
        E.MAX_MESSAGES, old = most, E.MAX_MESSAGES
        try:
            two = {r.fault_id: r.vector for r in E.tail_mean_vectors(tails, ["fault_id"], vectors, 2).collect()}
        finally:
            E.MAX_MESSAGES = old
        assert set(one) == set(two) and all(abs(a - b) < 1e-12 for i in one for a, b in zip(one[i], two[i]))


def test_clusters_are_nearest_centres(spark):
    import numpy as np
    from logfault.operators import factors as X
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in 10 * np.eye(4)[i % 4] + rng.normal(0, 0.3, 4)]) for i in range(200)]
    found = X.cluster_distances(spark.createDataFrame(rows, "i int, v array<double>"), "v").collect()
    means = {c: np.mean([r.v for r in found if r.cluster == c], axis=0) for c in range(4)}
    for r in found:
        for c in range(4):
            want = 1 - np.dot(r.v, means[c]) / np.linalg.norm(r.v) / np.linalg.norm(means[c])
            assert abs(r[f"cluster_dist_{c}"] - want) < 1e-6
        assert r.cluster == min(range(4), key=lambda c: np.linalg.norm(np.array(r.v) - means[c]))
    assert all(len({r.i % 4 for r in found if r.cluster == c}) == 1 for c in range(4))


def test_topics_of_a_planted_corpus(spark):
    import random
    from logfault.operators import documents as D, factors as X
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices([f"{'xy'[i % 2]}{j}word" for j in range(10)], k=30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    vocab = D.vocabulary(D.term_counts(docs, ["doc_id"], "text", 1, 1), 120, 1, 100)
    mixed = X.topic_mixture(X.tfidf_vectors(docs, vocab, high=1), k=2, max_iter=20).collect()
    top = {r.doc_id: max(range(2), key=lambda k: r.topics[k]) for r in mixed}
    assert all(abs(sum(r.topics) - 1) < 1e-6 for r in mixed)
    agree = sum(top[i] == i % 2 for i in top)
    assert max(agree, 120 - agree) >= 114


def test_probabilities_beat_a_uniform_model(spark):
    """Both stages and both learners: the held-out log loss is far below that of equal probabilities."""
    import math
    import random
    from logfault.learning import folds, two_stage as TS
    rng = random.Random(8)
    rows = [(i, i % 4, (i % 4) + rng.gauss(0, 0.25), f"m{rng.randrange(5)}") for i in range(400)]
    df = folds.stratified_folds(spark.createDataFrame(rows, "fault_id bigint, label int, x double, m string"), "label", "fault_id", 3)
    for options in ({}, {"use_stage_one": False, "row_share": 0.8, "column_share": "0.8"}):
        settings = TS.Settings(["x"], ["m"], trees=10, depth=4, rounds=10, stage_two_depth=3, **options)
        held = TS.cross_train(df, None, settings, ["fault_id"], 3)[0].collect()
        assert len(held) == 400
        loss1 = sum(-math.log(max(r.p1[max(0, r.label - 1)], 1e-9)) for r in held) / 400
        cpu = [r for r in held if r.label <= 1]
        loss2 = sum(-math.log(max(r.p2[r.label], 1e-9)) for r in cpu) / len(cpu)
        assert loss1 < 0.5 * math.log(3) and loss2 < 0.6 * math.log(2)
        for r in held:
            first = max(range(3), key=lambda i: (r.p1[i], -i))
            assert r.guess == (first + 1 if first else (0 if r.p2[0] >= r.p2[1] else 1))


def test_from_folder_to_folder(spark, small, tmp_path):
    from logfault.sources import readers as R
    logs = standin.logs(spark, small).select("sn", "time", F.col("msg_lower").alias("msg"), "server_model")
    tables = {"logs": [logs.filter("sn % 3 = 0"), logs.filter("sn % 3 = 1"), logs.filter("sn % 3 = 2")],
              "labels": [standin.faults(spark, small).select("sn", "fault_time", "label")] * 2,
              "submit": [standin.submit(spark, small).select("sn", "fault_time")],
              "crashdump": [standin.crashdump(spark, small).select("sn", F.col("time").alias("fault_time"))],
              "venus": [standin.venus(spark, small).select("sn", F.col("time").alias("fault_time"), "module")]}
    names = R.stage_sources(None)
    for kind, frames in tables.items():
        for name, frame in zip(names[kind], frames):
            R.write_table(frame, f"{tmp_path}/in/{name}.csv", "csv")
    answers = S.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", size=8, components=4, n_folds=2, trees=3, depth=3, rounds=2,
                    blocks=("keywords", "shape"), horizon=S.SHORT, fold_kinds=("stratified", "sn"))
    assert answers.count() == tables["submit"][0].count()
    back = R.read_csv(spark, f"{tmp_path}/out/answers", "sn string, fault_time timestamp, label int")
    assert back.count() == answers.count() and back.filter("label NOT IN (0, 1, 2, 3)").count() == 0
    features = spark.read.parquet(f"{tmp_path}/out/features")
    assert features.filter("first_time_span_tail20 > 14400").count() == 0 and "memory_span_time" in features.columns
    held = spark.read.parquet(f"{tmp_path}/out/out_of_fold")
    assert {r.run: r["count"] for r in held.groupBy("run").count().collect()}.keys() == {"stratified", "sn"}


def test_a_run_from_another_folder(tmp_path):
    """Python workers find the library when the job starts elsewhere."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from logfault.session import build_session\nfrom logfault.operators.templates import mine_templates\n"
            "spark = build_session('elsewhere', 'local[2]', 2)\n"
            "log = spark.createDataFrame([(1, 'a b c'), (2, 'a b d')], 'row_id bigint, msg_lower string')\n"
            "print('templates', mine_templates(log).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "templates 1" in done.stdout, done.stderr[-2000:]
