"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import OP8_SQL, op8_decontam
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html import op10_html
from .langid import op1_langid
from .licenses import OP9_SQL, op9_licenses
from .mixing import OP4_SQL, op4_mixing
from .quality import op5_quality
from .secrets import op7_secrets
from .simhash import op2_simhash
from .tokens import op3_token_counts

ALL = (
    op1_langid, op2_simhash, op3_token_counts, op4_mixing, op5_quality, op6_exact_dedup, op7_secrets, op8_decontam, op9_licenses, op10_html,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op8_decontam": OP8_SQL, "op9_licenses": OP9_SQL}
