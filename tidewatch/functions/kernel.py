"""Policy tables as column expressions over probabilities in hundredths. The three tables differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kernel_action(conf_min: int = 90, page_h: int = 30, uncertain_h: int = 50, queue_h: int = 70, suppress: bool = True) -> Column:
    conf = F.col("conf_h")
    out = F.when(F.col("q3_choice") == "cannot_determine", "passthrough")
    if suppress:
        out = out.when((F.col("p1_h") == 0) & (conf >= conf_min) & F.col("allowed"), "suppress")
    return out.when((F.col("p1_h") + F.col("p2_h") > page_h) | conf.isNull() | (conf < uncertain_h), "page_now").when((F.col("p3_h") + F.col("p4_h") >= 50) & (conf >= queue_h), "page_business_hours").otherwise("passthrough")


def kernel_reason(action: str = "action") -> Column:
    return F.when(F.col("q3_choice") == "cannot_determine", "uncertain").when(F.col(action) == "suppress", "allowlist").when(F.col(action).isin("page_now", "page_business_hours"), "threshold").otherwise("uncertain")


def tuner_bucket(c_fp: int = 100, c_fn: int = 50_000, conf_min: Column | int = 90, page_h: int = 30, queue_h: int = 70) -> Column:
    """Continuous p1 below the break-even share, no uncertainty branch; queue if p3 + p4 is at least p1 + p2."""
    low = F.col("p1_h") * (c_fp + c_fn) < 100 * c_fp
    conf = F.col("conf_h")
    return F.when(low & (conf >= conf_min) & F.col("allowed"), "suppress").when(F.col("p1_h") + F.col("p2_h") > page_h, "page_now").when((F.col("p3_h") + F.col("p4_h") >= F.col("p1_h") + F.col("p2_h")) & (conf >= queue_h), "queue").otherwise("baseline")


def mock_action(conf_min: int = 90, page_h: int = 30) -> Column:
    """No allowlist, and the paging bound is inclusive."""
    return F.when((F.col("p1_h") == 0) & (F.col("conf_h") >= conf_min), "suppress").when(F.col("p1_h") + F.col("p2_h") >= page_h, "page_now").otherwise("page_business_hours")
