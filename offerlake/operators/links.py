"""Dead-offer handling over a supplied link-status table ``(job_id, status)``.

Live HTTP checks are not part of this library; whoever probes the links writes their outcome as rows.
Status rule: '200' is alive; 'timeout' and 'error' count as alive (a slow site is not a dead offer);
'exception' (the check itself failed) follows a policy: search drops the offer, cleanup keeps it;
a missing status was not checked and is alive; any other code is dead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.operators.tables import cascade_delete, delete_keys

# The statuses treated as alive.
ALIVE_STATUSES = ("200", "timeout", "error")
EXCEPTION_STATUS = "exception"


def link_alive(status: Column | str, on_exception: str = "keep") -> Column:
    s = (F.col(status) if isinstance(status, str) else status).cast("string")
    exc = F.lit(on_exception == "keep")
    return (F.when(s.isNull() | s.isin(*ALIVE_STATUSES), F.lit(True))
            .when(s == F.lit(EXCEPTION_STATUS), exc)
            .otherwise(F.lit(False)))


def link_classify(status: DataFrame, key: str = "job_id", on_exception: str = "keep") -> DataFrame:
    return status.select(key, "status", link_alive("status", on_exception).alias("alive"))


def dead_keys(status: DataFrame, key: str = "job_id", on_exception: str = "keep") -> DataFrame:
    return link_classify(status, key, on_exception).filter(~F.col("alive")).select(key)


def dead_offer_filter(results: DataFrame, status: DataFrame, key: str = "job_id") -> DataFrame:
    """Search results without dead offers (search policy: a failed check drops the offer; an offer
    with no status row was not checked and stays)."""
    return delete_keys(results, dead_keys(status, key, on_exception="drop"), key)


def delete_dead(silver: DataFrame, gold: DataFrame, status: DataFrame, key: str = "job_id",
                gold_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Remaining (silver, gold) after deleting dead offers, cascading to gold (cleanup policy: a failed
    check keeps the offer)."""
    dead = dead_keys(status, key, on_exception="keep")
    silver_kept = delete_keys(silver, dead, key)
    gk = gold_key or key
    gold_kept = cascade_delete(gold, silver_kept.select(F.col(key).alias(gk)), gk)
    return silver_kept, gold_kept
