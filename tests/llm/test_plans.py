"""Physical plans of the operators."""

import re

from ratelake.llm import queries as Q


def test_mixing_is_native_and_reads_what_it_needs(spark, sf):
    plan = Q.op5_mix_sources(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert "doc_id:bigint,text:string,source:string" in reads
    joined = plan[plan.index("BroadcastHashJoin") :].splitlines()[1]
    assert "struct(doc_id, doc_id" in joined and "text, text" not in joined
