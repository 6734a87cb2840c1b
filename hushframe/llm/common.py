"""What the training-data operators share: shared-folder tables, text access, row hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines share. Where it is unset, one of our own if all runs on this machine (tests); else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="hushframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Tables written inside a stage that are still there, by their paths; None outside of stages.
_of_stages: dict[str, DataFrame] = {}
_inside = False


@contextmanager
def stage(spark: SparkSession) -> Iterator[None]:
    """Around the call of a pipeline's stage: deletes what the session's stages before it have written, as their results are stored by now, and notes what this one writes."""
    global _inside
    discard(*[t for t in _of_stages.values() if t.sparkSession is spark])
    _inside = True
    try:
        yield
    finally:
        _inside = False


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back. A lost executor costs only its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # Spark drops the shuffle files of the finished lineage once the driver has collected its garbage
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _inside:
        _of_stages[path] = out
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        _of_stages.pop(table.written_to, None)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch. A batch too large for one go is handed over in slices of at most about SLICE bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


#: Bytes of a batch that are handled at once; a single longer row still goes whole.
SLICE = 16 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * SLICE / max(batch.nbytes, 1))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; null text counts as empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_caches: list[tuple[str, Callable]] = []
_owner = ""


def worker_cache(most: int = 1) -> Callable[[Callable], Callable]:
    """Keep a function's last values in a worker, until a function of another module is asked: workers outlive an operator, its tables don't."""

    def of(make: Callable) -> Callable:
        kept = lru_cache(maxsize=most)(make)
        _caches.append((make.__module__, kept))

        @wraps(make)
        def get(*args):
            global _owner
            if _owner != make.__module__:
                for module, other in _caches:
                    if module != make.__module__:
                        other.cache_clear()
                _owner = make.__module__
            return kept(*args)

        return get

    return of


class Kept(dict):
    """A table of a function's values for short texts, filled on demand up to a bound. A full table stays as it is, as frequent texts came
    first, until four times as many texts were not found in it; then it starts anew."""

    def __init__(self, make: Callable[[str], object], most: int = 250_000, short: int = 48):
        super().__init__()
        self.make, self.most, self.short, self.missed = make, most, short, 0

    def __missing__(self, text: str):
        value = self.make(text)
        if len(self) < self.most:
            if len(text) <= self.short:
                self[text] = value
        else:
            self.missed += 1
            if self.missed > 4 * self.most:
                self.clear()
                self.missed = 0
        return value
