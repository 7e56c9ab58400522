"""Workers give freed memory back when a task is done: between tasks they wait beside the executor's other workers."""

import re
from pathlib import Path

import pyarrow as pa

from strataflow.llm.common import lean


def _held_mb():
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024


def test_lean_gives_memory_back():
    def grows(batches):
        for batch in batches:
            parts = []
            for i in range(4000):
                parts.append(bytes([65 + i % 26]) * 60_000)  # below malloc's limit for mappings of their own
                kept.append(bytes([65 + i % 26]) * 2000)  # what stays lies between what goes
            yield batch
            del parts

    kept, batch = [], pa.RecordBatch.from_pydict({"x": [1, 2]})
    before, most = _held_mb(), 0
    out = []
    for got in lean(grows)([batch] * 2):
        most = max(most, _held_mb())
        out.append(got)
    assert out == [batch] * 2
    assert most - before > 200 and _held_mb() - before < 60
