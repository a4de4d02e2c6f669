import subprocess
import sys
from pathlib import Path

OWN = """
import gc
import random
import pyarrow as pa
from meterlake.llm.quality_cnn import Network, scored

def mb(name):
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(name)) / 1024

rng = random.Random(1)
texts = pa.array(["".join(rng.choices("abcdefgh ", k=20)) * rng.randint(50, 250) for _ in range(30_000)])
batch = pa.RecordBatch.from_arrays([pa.array(range(30_000)), texts], names=["doc_id", "text"])
net = Network()
Network.scores = lambda self, texts: [len(x) / 5000 for x in texts]
gc.collect()
before, rows = mb("RssAnon"), 0
open("/proc/self/clear_refs", "w").write("5")
for x in scored(iter([batch]), net.p, ("doc_id",)):
    rows += len(x)
print(rows, mb("VmHWM") - mb("RssFile") - before, mb("RssAnon") - before)
"""


def test_a_batch_is_never_whole_in_python():
    """90 MB of text in one batch took twice that as strings and bytes, of which idle workers kept a part beside the next stage."""
    out = subprocess.run([sys.executable, "-c", OWN], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True).stdout
    rows, most, left = map(float, out.split())
    assert rows == 30_000 and most < 60 and left < 30, out
