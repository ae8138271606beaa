"""What Python workers and batches of whole texts hold."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from packlens.llm import common

KEPT = """
import re, pyarrow as pa
from packlens.llm import common
def held():
    with open("/proc/self/smaps_rollup") as file:
        return sum(map(int, re.findall(r"Pss_Anon: +(\\d+)", file.read()))) / 1024
def batches():
    for _ in range(3):
        yield pa.RecordBatch.from_pydict({"text": [str(i) * 1000 for i in range(20_000)]})
source, sizes = batches(), []
before = held()
for part in common.in_parts(source):
    sizes.append(len(part))
    texts = part.column("text").to_pylist()
part = texts = None
print(held() - before, max(sizes), sum(sizes))
"""


def test_a_worker_hands_back_what_it_has_freed():
    kept, most, rows = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert float(kept) < 30 and int(most) == 512 and int(rows) == 60_000


@pytest.mark.parametrize("before, after", [(10_000, 1000), (0, 1000), (200, 200)])
def test_the_pipeline_sends_texts_in_small_batches(spark, odd, sf, before, after):
    try:
        spark.conf.set(common.ARROW_ROWS, before)
        corpus_pipeline.quality_rules(spark, odd, sf)
        assert int(spark.conf.get(common.ARROW_ROWS)) == after
    finally:
        spark.conf.unset(common.ARROW_ROWS)
