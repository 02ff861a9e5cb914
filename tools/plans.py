"""List registered queries whose plan holds a nested-loop or Cartesian join or
an exchange of unaggregated rows to a single partition."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from trailgraph.plans import catalog  # noqa: E402
from trailgraph.session import get_spark  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark("plans", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in catalog.QUERIES.items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        notes = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin|Exchange SinglePartition|BatchEvalPython|ArrowEvalPython", plan)
        if notes:
            print(f"PLAN {name}: {', '.join(sorted(set(notes)))}", flush=True)
