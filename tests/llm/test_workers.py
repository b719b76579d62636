"""Tasks on workers that cannot import this package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spark.conf.set("attesta.work.dir", {work!r})

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        found = importlib.util.find_spec("attesta") is not None
        yield pa.RecordBatch.from_arrays([pa.array([found] * len(batch))], names=["found"])

assert not spark.range(1).mapInArrow(importable, "found boolean").first()[0]
from pyspark.sql import functions as F
from attesta.llm import alignment, decontaminate, langid, licences, lm, negatives
from attesta.operators import match
texts = [(i, "alpha beta gamma delta " * 3 if i % 2 else "uno dos tres cuatro " * 3,
          "en" if i % 2 else "es") for i in range(30)]
docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
assert langid.predict(docs, langid.fit(docs, F.lit(True))).count() == 30
assert lm.score(docs, F.col("doc_id") % 10 == 0).count() == 30
items = docs.filter("doc_id < 3").select(F.col("doc_id").alias("item_id"), "text")
assert decontaminate.find_leaks(docs, items).count() > 0
assert licences.scan(docs).count() == 30
vectors = spark.createDataFrame([(i, [0.1 * i, 0.3], i % 2) for i in range(30)],
                                "vec_id long, embedding array<double>, label int")
assert negatives.mine(vectors, F.col("vec_id") % 10 == 0).count() > 0
names = spark.createDataFrame([("alpha beta", "a")], "text string, slug string")
assert match.did_you_mean(names.withColumnRenamed("text", "query"), names, ["text"]).count() == 1
print("all ran")
"""


def test_operators_need_no_installed_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = RUN.format(root=ROOT, work=str(tmp_path / "work"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, text=True,
                          capture_output=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
