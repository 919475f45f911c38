"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op8_bpe
from .common import ship
from .decontaminate import OP7_SQL, op7_decontaminate
from .hnsw import op9_hnsw
from .langid import op2_langid
from .licenses import OP10_SQL, op10_licenses
from .line_dedup import OP6_SQL, op6_line_dedup
from .quality import op3_quality
from .simhash import op4_simhash
from .urlfilter import OP1_SQL, op1_urlfilter
from .warc import OP5_SQL, op5_warc

_OPERATORS = {
    "op1_urlfilter": op1_urlfilter,
    "op2_langid": op2_langid,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_hnsw": op9_hnsw,
    "op10_licenses": op10_licenses,
    "pipeline": corpus_pipeline.run,
}


def _shipped(run):
    """run, after the workers have been handed this package."""

    def inner(spark, sf_dir):
        ship(spark)
        return run(spark, sf_dir)

    return inner


QUERIES = {name: _shipped(run) for name, run in _OPERATORS.items()}
#: The others' methods have no SQL: models, fingerprints, merges by rank, graph walks.
SQL = {"op1_urlfilter": OP1_SQL, "op5_warc": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_decontaminate": OP7_SQL, "op10_licenses": OP10_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
