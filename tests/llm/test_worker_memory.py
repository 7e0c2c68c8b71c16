import subprocess
import sys
from pathlib import Path

WORKER = """
import random, re
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from quern.llm import bpe, jaccard_dedup


class Docs:
    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", f.read())[1]) / 1024


rng = random.Random(5)
texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)) for _ in range(4000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
near = jaccard_dedup._prepared(Docs(), 5, 0.8, (np.zeros(0, np.uint64), np.zeros(0, np.int64))).run
sum(1 for _ in near(iter([batch])))
before = held()
bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_all(batch.column("text"))
assert bpe._LOADED
sum(1 for _ in near(iter([batch])))
print(len(bpe._LOADED), held() - before)
"""


def test_near_dedup_does_not_hold_the_tokenizer_of_an_earlier_stage():
    made = subprocess.run([sys.executable, "-c", WORKER], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert not made.returncode, made.stderr
    kept, more = made.stdout.split()
    assert kept == "0" and float(more) < 60, made.stdout


def test_a_worker_keeps_the_tables_of_one_operator_only():
    from quern.llm import common

    first, second = common.keeps(), common.keeps()
    try:
        first["a"] = 1
        common.only(first)
        assert first == {"a": 1}
        second["b"] = 2
        common.only(second)
        assert not first and second == {"b": 2}
        assert list(common.lean(iter, alone=False)([3])) == [3] and second
        assert list(common.lean(iter)([3])) == [3] and not second
    finally:
        common._KEPT[:] = [x for x in common._KEPT if x is not first and x is not second]
