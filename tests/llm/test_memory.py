"""What tasks on texts need at once and what they leave in a worker."""

from __future__ import annotations

import subprocess
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from proofmill.llm import idstore, jaccard


def _batches(docs: int, words: int, three: bool):
    """Texts of words that are all different, made one batch at a time."""
    for k in range(0, docs, 256):
        texts = pa.array([" ".join(f"{i:x}q{j:x}" for j in range(words)) for i in range(k, k + 256)])
        ids = pa.array(range(k, k + 256))
        yield pa.RecordBatch.from_arrays([ids, ids, texts] if three else [texts], names=["doc_id", "text_key", "text"] if three else ["text"])


def _peak(task) -> float:
    """MB that Python and numpy hold at most while the task runs, for each million of n-grams or entries."""
    tracemalloc.start()
    try:
        for _ in task:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_count_needs_little_beside_its_grams(monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 1_000_000)
    # 8 MB of n-grams, once in the run and once in one array, and a batch of texts on its way
    assert _peak(jaccard._profile(_batches(2048, 600, True))) < 55


def test_index_needs_little_beside_its_entries(monkeypatch):
    monkeypatch.setattr(jaccard, "RUN", 1_000_000)
    task = jaccard._index(_batches(7168, 600, False), frequent=np.zeros(0, np.uint64), rank=np.zeros(0, np.int64), buckets=31)
    assert _peak(task) < 85


@pytest.mark.parametrize("values", [[], [5], [5, 5], [1, 2, 3], [3, 1, 3, 2, 2, 3], [7, 7, 1, 1]])
def test_repeated(values):
    grams, times = np.unique(np.array(values, np.uint64), return_counts=True)
    found, often = jaccard.repeated(np.array(values, np.uint64))
    assert found.tolist() == grams[times > 1].tolist() and often.tolist() == times[times > 1].tolist()


def test_tokenizer_goes_when_a_worker_turns_to_sets():
    path = public_tokenizers.path("word_bpe_49k.json")
    before = idstore.encode_texts([b"some words here"], path)
    assert idstore._young and idstore._tokenizers
    assert sum(b.num_rows for b in jaccard._profile(_batches(256, 9, True))) == 256
    assert not idstore._young and not idstore._old and not idstore._tokenizers and not idstore._plain
    assert idstore.encode_texts([b"some words here"], path) == before


_LEFT = """
import gc, re
import numpy as np, pyarrow as pa
from proofmill.llm import jaccard
from tests.llm.test_memory import _batches

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

for _ in jaccard._profile(_batches(256, 9, True)):
    pass
before = held()
for task in (jaccard._profile(_batches(5120, 600, True)), jaccard._index(_batches(5120, 600, False), frequent=np.zeros(0, np.uint64), rank=np.zeros(0, np.int64), buckets=31)):
    for _ in task:
        pass
del task, _
print(held() - before)
"""


def test_tasks_leave_a_worker_small():
    got = subprocess.run([sys.executable, "-c", _LEFT], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    assert float(got.stdout.split()[-1]) < 20
