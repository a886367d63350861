"""Functions sent to workers must not need this package there."""

import subprocess
import sys

from pyspark import cloudpickle

from stayrate.functions.significance import t_tail
from stayrate.operators import neighbours, synthesis


def test_worker_functions_carry_their_code(tmp_path):
    path = tmp_path / "functions.bin"
    functions = (t_tail, neighbours._distances, synthesis._local_centres)
    path.write_bytes(cloudpickle.dumps(functions))
    script = (
        "import numpy as np; from pyspark import cloudpickle\n"
        f"t, d, c = cloudpickle.loads(open({str(path)!r}, 'rb').read())\n"
        "assert abs(t(1.0, 1) - 0.5) < 1e-9\n"
        "x = np.arange(12.0).reshape(6, 2)\n"
        "assert d(x, x).shape == (6, 6) and len(c(x, 2, 1)) == 2\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr
