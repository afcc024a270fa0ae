"""The queries of this subpackage and the SQL that each must equal, where SQL can say it."""

from . import (
    op1_mixing,
    op2_hosts,
    op3_toxicity,
    op4_warc,
    op5_superminhash,
    op6_language,
    op7_media,
    op8_pii,
    op9_packing,
    op10_licenses,
)

_MODULES = (
    op1_mixing,
    op2_hosts,
    op3_toxicity,
    op4_warc,
    op5_superminhash,
    op6_language,
    op7_media,
    op8_pii,
    op9_packing,
    op10_licenses,
)

QUERIES = {name: getattr(m, name) for m in _MODULES for name in (m.__name__.rpartition(".")[2],)}
ORACLE_SQL = {m.__name__.rpartition(".")[2]: m.ORACLE_SQL for m in _MODULES if getattr(m, "ORACLE_SQL", None)}
