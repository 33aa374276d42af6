"""Workers give memory back: they outlive their tasks and share an executor's memory with later stages."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import shared, token_records


def test_lean_gives_back_after_each_result(monkeypatch):
    seen = []
    monkeypatch.setattr(shared, "give_back", lambda: seen.append("back"))
    run = shared.lean(lambda batches: (seen.append(b) or b for b in batches))
    assert list(run(iter([1, 2]))) == [1, 2]
    assert seen == [1, "back", 2, "back", "back"]


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_memory_goes_back():
    """Freed memory between what stays is kept by malloc, until it is given back."""

    def held():
        line = next(x for x in Path("/proc/self/smaps_rollup").read_text().split("\n") if x.startswith("Pss_Anon"))
        return int(line.split()[1]) / 1024

    many = [np.ones(8000, np.uint8) for _ in range(20_000)]
    full, many = held(), many[::2000]
    shared.give_back()
    assert full - held() > 100
    assert len(many) == 10


def test_records_are_read_without_a_tokenizer(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    path = token_records.default_tokenizer()
    index = token_records.write_records(docs, path).orderBy("part", "offset").toArrow().combine_chunks()
    token_records.encoder(path, 10)

    def load(*_):
        raise AssertionError("loaded")

    load.cache_clear = token_records.encoder.cache_clear
    monkeypatch.setattr(token_records, "encoder", load)
    base = shared.scratch_dir(spark, "")
    for forget in (False, True):
        found = list(token_records._reader(base, forget)(iter(index.to_batches())))
        assert pa.Table.from_batches(found).column("n_tokens").to_pylist() == index.column("n_tokens").to_pylist()
        sizes = [len(x) for b in found for x in b.column("ids").to_pylist()]
        assert sizes == [4 * n for n in index.column("n_tokens").to_pylist()]
        # A batch has the ids of a request of 1 MB, twice as wide as in the file, and of one more record.
        assert max(b.column("ids").nbytes for b in found) < 3 << 20 < sum(sizes)
    monkeypatch.undo()
    assert token_records.encoder.cache_info().currsize == 0


def test_tables_leave_no_shuffle_files(spark, tmp_path):
    """Files of the shuffles behind a table go when it is written, not when the driver collects garbage."""
    import time

    from pyspark.sql import functions as F

    from strandlake.llm.shared import materialise

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [Path(f.getPath()) for f in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for d in folders for f in d.rglob("shuffle_*")}
    rows = spark.range(20000).repartition(7, "id").groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    before, conf = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = materialise(rows, "counts", f"file://{tmp_path}")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == conf
