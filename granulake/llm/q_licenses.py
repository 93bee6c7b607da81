"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.llm import licenses
from granulake.llm.registry import query, table


@query("op2_license_scan")
def op2(spark, sf_dir):
    """Licence families that every document names."""
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs), [F.col("doc_id")])
    named = F.filter(F.col("found.family"), lambda f: f != licenses.UNKNOWN)
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("bigint").alias("n_marked"),
        F.size(named).cast("bigint").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("licenses"),
    )
