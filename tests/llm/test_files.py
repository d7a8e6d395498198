"""What a worker holds open is bounded, and results do not depend on it."""

import pickle

import numpy as np
import pytest

from featstab.llm import files
from featstab.llm.queries import QUERIES


def test_few_arrays_stay_open(tmp_path, monkeypatch):
    uris = [f"file://{tmp_path}/a-{i}.npy" for i in range(10)]
    for i, uri in enumerate(uris):
        files.put_array(uri, np.full(100, i))
    few = files.OpenArrays(most=4)
    for order in (range(10), (3, 3, 9, 0), reversed(range(10))):
        for i in order:
            assert few(uris[i])[7] == i and len(few.held) <= 4
    assert list(few.held) == [uris[i] for i in (3, 2, 1, 0)]
    again = pickle.loads(pickle.dumps(few))
    assert not again.held and again.most == 4 and again(uris[5])[0] == 5
    monkeypatch.setattr(files, "get_array", lambda uri: np.zeros(100))  # read, not mapped: 800 bytes each
    read = files.OpenArrays(most=100, most_bytes=2000)
    for uri in uris * 2:
        read(uri)
        assert len(read.held) <= 2 and read.bytes == 800 * len(read.held)
    assert len(files.OpenArrays(most=0).held) == 0 and files.OpenArrays(most=0, most_bytes=0)(uris[0]) is not None


@pytest.mark.parametrize("name", ["op4_run_length_index", "op10_kneser_ney"])
def test_results_do_not_depend_on_what_is_held(spark, sf, monkeypatch, name):
    shown = lambda: sorted(map(str, QUERIES[name](spark, sf).collect()))
    whole = shown()
    monkeypatch.setattr(files, "MOST_OPEN", 1)
    assert shown() == whole
