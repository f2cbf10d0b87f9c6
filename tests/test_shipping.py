"""Functions that run in tasks must not need the package on the workers."""
import subprocess
import sys
import tempfile

from pyspark import cloudpickle

from tapeloom.functions import columns
from tapeloom.operators import accumulation, adjust, chips, cross_section, outcomes, right_side
from tapeloom.streaming import live


def test_task_functions_travel_by_value():
    fns = (accumulation._scan, adjust._plateaus_of(0.001), chips.replay, cross_section._timing(2, 0.0), outcomes._first_below, right_side._scan, live._advance,
           live._Falsification, columns._finder(["a"], "", None))
    with tempfile.NamedTemporaryFile(suffix=".pkl", delete=False) as f:
        f.write(cloudpickle.dumps(fns))
    code = f"import pickle, sys; fs = pickle.load(open({f.name!r}, 'rb')); assert not any(m.startswith('tapeloom') for m in sys.modules); print(len(fs))"
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True, text=True)
    assert out.stdout.strip() == str(len(fns)), out.stderr[-500:]
