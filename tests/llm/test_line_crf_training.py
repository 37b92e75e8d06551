"""Training of the line CRF uses all lines of its documents."""

from chronospan.llm import line_crf


def test_training_sees_every_line(spark, monkeypatch):
    tail = "#### MENU 12345 ####"
    docs = spark.createDataFrame([(0, "\n".join(["A sentence of plain words."] * 900 + [tail] * 150)), (1, "\n\n".join(["Some other sentence, too."] * 30))], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    seen, fit = [], line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda features, doc, label: seen.append((features, doc, label)) or fit(features, doc, label))
    line_crf.train(docs, labels)
    features, doc, label = seen[0]
    assert (label == 0).sum() == 1050 and (label == 1).sum() == 30 and (features[:, 2] > 0.2).sum() == 150
    assert len(set(doc.tolist())) == 4
