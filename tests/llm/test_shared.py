"""Arrays in part files: mapped by few maps, missing parts told."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from veiltrack.llm import shared

MANY = """
import resource, sys
import numpy as np
from veiltrack.llm import shared
resource.setrlimit(resource.RLIMIT_NOFILE, (40, 40))
shared.MOST_MAPPED = int(sys.argv[2])
tables = [shared.Mapped(sys.argv[1], f"a{k}", 200, np.uint64) for k in range(3)]
for _ in range(2):
    for p in range(200):
        for k, t in enumerate(tables):
            assert t[p].tolist() == [p * 10 + k, p * 10 + k + 1]
assert len(shared._maps) <= shared.MOST_MAPPED
"""


@pytest.mark.parametrize("most", [8192, 20, 1])
def test_few_files_stay_open(tmp_path, most):
    """600 parts under a limit of 40 files; where a map costs a descriptor, few maps are kept."""
    for k in range(3):
        for p in range(200):
            shared.save(str(tmp_path), f"a{k}", p, np.array([p * 10 + k, p * 10 + k + 1], np.uint64))
        shared.seal(str(tmp_path), f"a{k}")
    if most > 20 and not shared._UNTRACKED:
        most = 20
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", MANY, str(tmp_path), str(most)], env={**os.environ, "PYTHONPATH": root, "OPENBLAS_NUM_THREADS": "1"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_lookups_and_missing_parts(tmp_path):
    parts = 16
    keys = np.sort(shared.np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    keys = np.unique(keys)
    part = shared.part_of(keys, parts)
    for p in range(parts):
        shared.save(str(tmp_path), "k", p, keys[part == p])
    shared.seal(str(tmp_path), "k")
    table = shared.Mapped(str(tmp_path), "k", parts, np.uint64)
    asked = np.sort(np.concatenate((keys[::3], keys[::5] + np.uint64(1))))
    assert (shared.find(asked, table)[1] >= 0).tolist() == np.isin(asked, keys).tolist()
    os.remove(tmp_path / "k.3")
    shared._maps.clear()
    with pytest.raises(FileNotFoundError):
        table[3]
    with pytest.raises(FileNotFoundError):
        shared.Mapped(str(tmp_path), "unsealed", parts, np.uint64)[0]


def test_sums_that_wrap_around():
    for counts in ([1, -5], [0, 255], [-1], [1 << 62, 3], []):
        assert shared.spread(shared.squeeze(np.array(counts, np.int64))).tolist() == counts
