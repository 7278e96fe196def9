"""The registered classifier query fits both models over the whole grid."""

from stemwise.operators import classifier
from stemwise.plans import registry


def test_both_models_over_the_grid(spark, sf_dir, monkeypatch):
    fitted, tried, fit, regression = [], [], classifier.OptionClassifier.fit, classifier.LogisticRegression
    monkeypatch.setattr(classifier, "LogisticRegression", lambda **o: tried.append(o["regParam"]) or regression(**o))
    monkeypatch.setattr(classifier.OptionClassifier, "fit", lambda self, rows: fitted.append(self.use_text) or fit(self, rows))
    out = registry.QUERIES["l4_l8_option_classifier"](spark, sf_dir)
    assert fitted == [False, True]
    assert len(tried) == 6 and len(set(tried)) == 3
    got = out.collect()
    assert got and out.columns == ["item_pos", "bank", "gold", "surface_pick", "text_pick"]
    assert len({r.item_pos for r in got}) == len(got)
    assert all(r[c] in set("ABCDE") for r in got for c in ("gold", "surface_pick", "text_pick"))


def test_features_are_made_once_for_all_of_the_grid(spark, sf_dir, monkeypatch):
    made, features = [], classifier.OptionClassifier._features
    monkeypatch.setattr(classifier.OptionClassifier, "_features", lambda self, df: made.append(self.use_text) or features(self, df))
    registry.QUERIES["l4_l8_option_classifier"](spark, sf_dir)
    assert made == [False] * 3 + [True] * 3
