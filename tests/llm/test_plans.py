"""The mixture is DataFrame code only, and the texts of the substring removal are shuffled once."""

import re

from curatrix.llm import queries


def test_mixture_runs_no_python(spark, awkward):
    text = queries.QUERIES["op10_source_mix"](spark, awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_texts_are_shuffled_once(spark, awkward):
    df = queries.QUERIES["op9_substring_dedup"](spark, awkward)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    texts = [x for x in re.findall(r"(ReusedExchange|Exchange hashpartitioning)[^\n]*text#", text)]
    assert len(re.findall(r"FileScan parquet", text)) == 1 or texts.count("ReusedExchange") >= 2
