"""The registered queries of the corpus operators."""

from __future__ import annotations

from . import op1_quality_rules as op1
from . import op2_sentencepiece as op2
from . import op3_html as op3
from . import op4_minhash as op4
from . import op5_pii as op5
from . import op6_packing as op6
from . import op7_exact_dedup as op7
from . import op8_quality_classifier as op8
from . import op9_line_dedup as op9
from . import op10_license_scan as op10
from . import op11_periodic_runs as op11
from . import op12_ranked_search as op12
from . import op13_language_id as op13


def queries() -> dict:
    return {
        "op1_quality_rules": op1.op1_quality_rules,
        "op2_sentencepiece": op2.op2_sentencepiece,
        "op3_html": op3.op3_html,
        "op4_minhash": op4.op4_minhash,
        "op5_pii": op5.op5_pii,
        "op6_packing": op6.op6_packing,
        "op7_exact_dedup": op7.op7_exact_dedup,
        "op8_quality_classifier": op8.op8_quality_classifier,
        "op9_line_dedup": op9.op9_line_dedup,
        "op10_license_scan": op10.op10_license_scan,
        "op11_periodic_runs": op11.op11_periodic_runs,
        "op12_ranked_search": op12.op12_ranked_search,
        "op13_language_id": op13.op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": op7.ORACLE, "op12_ranked_search": op12.ORACLE}
