import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from tensorframe.llm.common import lean


def resident() -> int:
    """MB of this process."""
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024


def test_a_lean_step_gives_memory_back():
    def step(batches):
        for batch in batches:
            held = [np.ones(1000) for _ in range(25_000)]  # 200 MB below the size that the C library maps by itself
            pins.append(np.ones(1000))  # at the end of the heap
            del held
            yield batch

    pins: list[np.ndarray] = []
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    list(step(iter([batch])))
    plain = resident()
    assert list(lean(step)(iter([batch]))) == [batch]
    assert resident() < plain - 150
