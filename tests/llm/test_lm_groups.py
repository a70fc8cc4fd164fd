import numpy as np
import pyarrow as pa

from codequarry.llm import lm


class Held:
    def __init__(self, value):
        self.value = value


def test_texts_are_scored_in_groups_by_their_characters(monkeypatch):
    """Short texts are scored together, long ones in groups no longer than one text more than SCORED; scores are the same."""
    texts = [None, "", "a b c"] * 60 + ["b " * 40_000] * 3 + ["c d"]
    words = lm.Lexicon(*np.unique(np.concatenate([np.append(lm.word_hashes(t), lm.END) for t in texts]), return_counts=True), 1000, 5)
    monkeypatch.setattr(lm, "SCORED", 50_000)
    assert list(lm._groups(texts)) == [(0, 181), (181, 182), (182, 183), (183, 184)] and list(lm._groups([])) == []
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["uid", "doc_id", "text"])
    found = {}
    for n in (1, 50_000, 10**9):
        monkeypatch.setattr(lm, "SCORED", n)
        rows = pa.Table.from_batches(lm._score_task(Held(words), Held(lm.LogBilinear.fresh(words)))(iter([batch])))
        assert rows["uid"].to_pylist() == ids.to_pylist()
        found[n] = rows["score"].to_numpy()
    assert np.allclose(found[1], found[50_000], rtol=1e-6) and np.allclose(found[1], found[10**9], rtol=1e-6)
