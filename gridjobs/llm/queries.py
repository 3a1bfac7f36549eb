"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from gridjobs.llm.alignment import op13_alignment
from gridjobs.llm.audit import OP12_SQL, op12_filter_audit
from gridjobs.llm.jaccard import op9_jaccard
from gridjobs.llm.merkle import op5_merkle
from gridjobs.llm.mixing import OP3_SQL, op3_mixing
from gridjobs.llm.packing import op6_packing
from gridjobs.llm.prefix_counts import op10_prefix_counts
from gridjobs.llm.quality import op7_quality
from gridjobs.llm.repair import op4_repair
from gridjobs.llm.secrets import OP8_SQL, op8_secrets
from gridjobs.llm.sharding import op2_sharding
from gridjobs.llm.simhash import op11_simhash
from gridjobs.llm.topk import OP1_SQL, op1_topk


def queries() -> dict:
    return {
        "op1_topk": op1_topk,
        "op2_sharding": op2_sharding,
        "op3_mixing": op3_mixing,
        "op4_repair": op4_repair,
        "op5_merkle": op5_merkle,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_secrets": op8_secrets,
        "op9_jaccard": op9_jaccard,
        "op10_prefix_counts": op10_prefix_counts,
        "op11_simhash": op11_simhash,
        "op12_filter_audit": op12_filter_audit,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op3_mixing": OP3_SQL, "op8_secrets": OP8_SQL, "op12_filter_audit": OP12_SQL}
