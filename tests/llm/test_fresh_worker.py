"""Code of the tasks in a process that has run nothing else: no table of powers is there yet."""

import subprocess
import sys
from pathlib import Path

CODE = """
import numpy as np, pyarrow as pa
from trackloom.llm import suffixes as S
rng = np.random.default_rng(3)
text = rng.integers(97, 100, 120, dtype=np.uint8)
segments = [text[:60], text[:60], text[5:65]]
raw = np.array([9, 0, 0], np.uint64).tobytes() + np.array([4, 2, 7], np.int64).tobytes() + np.full(3, 11, np.uint8).tobytes() + np.concatenate(segments).tobytes()
t = pa.table({"chunk": [1], "q": [0], "n": [3], "n_bytes": [len(raw)], "packed": [pa.Codec("zstd").compress(raw, asbytes=True)]})
out = S._settle(("chunk", "q"))(t)
runs = np.frombuffer(out.column("runs")[0].as_py(), np.uint8).tolist()
ids = np.frombuffer(out.column("run_ids")[0].as_py(), np.int64).tolist()
# the third segment's first six windows are the others' last six
assert (runs, ids) == ([11, 11, 6, 5], [2, 2, 2, 7]), (runs, ids)
"""


def test_settle_in_a_fresh_process():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
