"""Each query on PDF files deals them over all cores and runs Python once: files neither lie in one task nor go from worker to worker."""

import pytest

from quirefold.plans import registry

NAMES = [
    "pdf_headings",
    "pdf_redact_phrase",
    "pdf_paragraphs",
    "pdf_redact",
    "pdf_running",
    "pdf_markdown",
    "pdf_body_size",
    "pdf_fonts",
    "pdf_operators",
    "pdf_recovered",
    "pdf_revision",
    "pdf_lines",
    "pdf_words",
]


@pytest.mark.parametrize("name", NAMES)
def test_files_are_dealt_and_stay_in_their_task(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan and "Repartition " in plan
