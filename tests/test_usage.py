"""The README workflow: a delivered cube read from Parquet, a YAML codebook,
decode, crosstab outputs and a batch report written to disk."""

import os
import tempfile

from statcube.operators.decode import decode_cube
from statcube.plans import Crosstab, CrosstabSpec, ReportBatch
from statcube.plans import orders_cube as oc
from statcube.sources.codebook import Codebook, codebook_section, load_codebook
from statcube.sources.specs import specs_frame
from statcube.sources.tables import read_parquet


def test_readme_workflow(spark):
    root = tempfile.mkdtemp(prefix="statcube-usage-")
    delivered = os.path.join(root, "orders_coded_260101.parquet")
    oc.coded_cube(spark, "/root/testdata/sf0.001").write.parquet(delivered)

    cube = read_parquet(spark, delivered)
    cb = Codebook(codebook_section(load_codebook(oc.CONFIG), "orders"))
    decoded = decode_cube(cube, cb)
    xt = Crosstab(decoded, CrosstabSpec.of("DATA_YR", ["SEG"], ["PRI"], "CNT", {}), cb)
    cells = xt.cells()
    assert cells.count() > 0
    assert xt.averages().count() > 0 and xt.growth("rows").count() > 0 and xt.mix().count() > 0

    specs = specs_frame(spark, [
        {"chapter": "1-2", "name": "Orders", "unit": "", "description": "", "focus_tab": "", "data_source": "d",
         "filters": "{}", "pivot_row": ["SEG"], "pivot_col": ["PRI"], "pivot_tab": "DATA_YR", "pivot_sum": "CNT"},
        {"chapter": "1-1", "name": "Broken", "unit": "", "description": "", "focus_tab": "", "data_source": "nope",
         "filters": "{}", "pivot_row": ["SEG"], "pivot_col": ["PRI"], "pivot_tab": "DATA_YR", "pivot_sum": "CNT"},
    ])
    out = os.path.join(root, "report")
    ReportBatch(specs, {"d": lambda: (decoded, cb)}).write(out)
    written = spark.read.parquet(os.path.join(out, "cells"))
    assert {r["sheet"] for r in written.select("sheet").distinct().collect()} == {"1-2"}
    errors = spark.read.parquet(os.path.join(out, "errors")).collect()
    assert [e["Chapter"] for e in errors] == ["1-1"] and "not found" in errors[0]["Error"]
    assert spark.read.parquet(os.path.join(out, "toc")).count() == 2
