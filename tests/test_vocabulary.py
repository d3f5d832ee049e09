"""The vocabulary follows its files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import vocabulary
from vitrine.operators.encoders import HashEncoder
from vitrine.operators.vocabulary import Vocabulary


class Refusing(HashEncoder):
    """Encodes nothing, and says so."""

    def texts(self, texts):
        raise RuntimeError(f"asked for {texts}")


def test_refresh(spark, tmp_path):
    base, learned = tmp_path / "vocab.yaml", tmp_path / "learned"
    base.write_text("- wide legs\n- Linen.\n- cottagecore\n- linen\n")
    v = Vocabulary(spark, f"{tmp_path}/table", str(base), str(learned))
    assert v.refresh(HashEncoder(8)) == vocabulary.Refresh(1, 2, 0, True)
    # unchanged files encode nothing
    assert v.refresh(Refusing()) == vocabulary.Refresh(1, 0, 0, False)
    old = {r["phrase"]: r["q"] for r in v.vectors().collect()}
    assert sorted(old) == ["linen", "wide legs"] and np.allclose(old["linen"], HashEncoder(8).texts(["linen"])[0])
    # one phrase goes, one comes: only that is encoded
    base.write_text("- linen\n- puff sleeves\n")

    class One(HashEncoder):
        def texts(self, texts):
            assert texts == ["puff sleeves"]
            return super().texts(texts)

    assert v.refresh(One(8)) == vocabulary.Refresh(2, 1, 1, True)
    now = {r["phrase"]: r["q"] for r in v.vectors().collect()}
    assert sorted(now) == ["linen", "puff sleeves"] and now["linen"] == old["linen"]
    # what a reader learned joins in
    assert vocabulary.learn(str(learned), v.vectors(), spark.createDataFrame([("Linen",), ("soft knits",), ("boho",), ("soft knits.",)], "phrase string")) == 1
    assert vocabulary.learn(str(learned), spark.createDataFrame([("soft knits",)], "phrase string"), spark.createDataFrame([("soft knits",)], "phrase string")) == 0
    assert v.refresh(HashEncoder(8)).encoded == 1 and sorted(r["phrase"] for r in v.vectors().collect()) == ["linen", "puff sleeves", "soft knits"]
    # a touched file is read again, and still nothing is encoded
    base.write_text(base.read_text() + "\n")
    assert v.refresh(Refusing(8)) == vocabulary.Refresh(4, 0, 0, True)
    images = spark.createDataFrame([(1, HashEncoder(8).texts(["soft knits"])[0].tolist())], "id long, vec array<float>")
    assert v.read(images).collect() == [] or v.read(images).first()["phrase"] == "soft knits"


def test_files_that_are_no_lists(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps(["one", 2]))
    assert sorted(r["phrase"] for r in vocabulary.phrases(spark, str(tmp_path / "a.json"), str(tmp_path / "none.yaml")).collect()) == ["2", "one"]
    (tmp_path / "b.json").write_text("")
    assert vocabulary.phrases(spark, str(tmp_path / "b.json")).count() == 0
    (tmp_path / "c.json").write_text("{not json")
    with pytest.raises(Exception, match="Expecting|JSON"):
        vocabulary.phrases(spark, str(tmp_path / "c.json")).collect()
    with pytest.raises(ValueError):
        monkeypatch.setattr(vocabulary, "MAX_LIST", 3)
        vocabulary._listed("d.json", b"[1, 2]")
    assert F
