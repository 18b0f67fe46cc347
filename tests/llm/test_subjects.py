import numpy as np

from headwater.llm import subjects


def test_thresholds_are_set_on_whole_documents_and_by_folds(monkeypatch):
    seen = []
    monkeypatch.setattr(subjects, "calibrate", lambda m, top, count, truth: seen.append((top, count, truth)) or m)
    areas = {"rail": "tram line", "sea": "ship harbour"}
    docs = [("\n".join(["tram line track" if k % 2 else "ship harbour quay"] * 100), {"rail" if k % 2 else "sea": 1}) for k in range(30)]
    subjects.fit(docs, areas)
    _, count, truth = seen[0]
    assert truth.shape == (30, 2) and truth.sum() == 30  # 6 are kept out at a time, too few
    assert np.array_equal(count.max(axis=1), np.full(30, 100))


def test_titles_are_weak_labels():
    areas = {"rail": "tram line", "sea": "ship harbour"}
    hand = [("\n".join(["tram line"] * 6 if k % 2 else ["ship harbour"] * 6), {"rail" if k % 2 else "sea": 1}) for k in range(60)]
    titled = [(f"# {'tram line' if k % 2 else 'ship harbour'} / day\n" + "\n".join(["wagon coupler"] * 6 if k % 2 else ["anchor keel"] * 6)) for k in range(60)]
    assert subjects._titles(subjects.fit(hand, areas), titled[1]) == {"rail": 1}
    model, _ = subjects._calibrated(hand, [(t, {"rail" if k % 2 else "sea": 1}) for k, t in enumerate(titled)], areas, 7)
    row = np.fromiter(subjects.Words().row("wagon coupler\nwagon coupler"), dtype=np.int64)
    _, found = subjects.subjects_of(model, row, [len(row)])
    assert [model.subjects[k] for k in found] == ["rail"]


def test_subjects_have_their_own_thresholds():
    model = subjects.Model(["a", "b"], np.zeros((2, subjects.DIM), np.float32), np.zeros(2, np.float32))
    top = np.array([[5.5, 1.2]] * 50 + [[4.5, -3.0]] * 50, np.float32)
    truth = np.array([[True, True]] * 50 + [[False, False]] * 50)
    subjects.calibrate(model, top, np.ones(top.shape, np.int32), truth)
    assert model.single[0] == 5.0 and model.single[1] == 1.0 and (model.decide(top, np.ones(top.shape)) == truth).all()


def test_sample_is_chosen_before_texts_are_read(spark, monkeypatch):
    monkeypatch.setattr(subjects, "MAX_DOCS", 3)
    monkeypatch.setattr(subjects, "MAX_TITLED", 2)
    docs = [(i, f"# title {i}\ntext" if i % 2 else f"text {i}", "x") for i in range(20)] + [(20, "", "x"), (21, None, "x"), (22, "x" * 30_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    labels = spark.createDataFrame([(i, "a", "r") for i in range(0, 8)] + [(0, "a", "s"), (0, "b", "s"), (None, "a", "r"), (1, None, "r"), (99, "a", "r")], "doc_id long, subject string, text string")
    hand, titled = subjects.labelled_sample(df, labels, "doc_id", "text")
    assert len(hand) <= 3 and all(g in ({"a": 1}, {"a": 2, "b": 1}) for _, g in hand) and len(titled) == 2 and all(int(t.split()[2]) > 8 for t in titled)
    assert subjects.labelled_sample(df, labels.limit(0), "doc_id", "text")[0] == [] and subjects.labelled_sample(df.limit(0), labels, "doc_id", "text") == ([], [])
