"""What a Python worker holds between tasks."""

import subprocess
import sys

import pytest

from quizlens.llm import dedup

# batches as Spark sends them, out of a stream; prints by how many MB the process grew
GROWTH = """
import re
import pyarrow as pa
from quizlens.llm.common import sliced, tidied

def held():
    rollup = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", rollup))) / 1024

def sent(n):
    sink = pa.BufferOutputStream()
    texts = pa.record_batch({"text": [str(i) + "x" * 3000 for i in range(5000)]})
    with pa.ipc.new_stream(sink, texts.schema) as out:
        for _ in range(n):
            out.write_batch(texts)
    return sink.getvalue().to_pybytes()

def run(batches):
    for batch in sliced(batches):
        yield pa.record_batch({"text": [t.upper() for t in batch.column(0).to_pylist()]})

stream = sent(3)
list(run([]))
pa.default_memory_pool().release_unused()
before = held()
for out in (tidied(run) if WITH else run)(iter(pa.ipc.open_stream(pa.py_buffer(stream)))):
    out = out.slice(0, 1).to_pylist()
print(held() - before)
"""


def growth(tidy):
    code = f"WITH = {tidy}\n{GROWTH}"
    return float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_task_gives_its_room_back():
    assert growth(True) < growth(False) - 5


def test_the_words_that_a_worker_remembers_are_bounded():
    hashes = dedup.WordHashes()
    for at in range(0, 500_000, 1000):
        hashes.shingles(" ".join(map(str, range(at, at + 1000))))
    assert len(hashes) <= 201_000
