"""Queries and SQL oracles of the corpus operators."""

from __future__ import annotations

from ledgerlens.llm.ann import op7_cross_polytope
from ledgerlens.llm.jaccard import DEN, GRAM, NUM, op1_ngram_jaccard
from ledgerlens.llm.line_dedup import OP8_SQL, op8_line_dedup
from ledgerlens.llm.minhash import OP11_SQL, components_sql, op11_minhash
from ledgerlens.llm.mixing import OP2_SQL, op2_mixing
from ledgerlens.llm.pieces import op10_sentencepiece
from ledgerlens.llm.quality import op5_quality
from ledgerlens.llm.spelling import OP12_SQL, op12_spelling
from ledgerlens.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from ledgerlens.llm.toxicity import op3_toxicity
from ledgerlens.llm.url_filter import OP4_SQL, op4_url_filter
from ledgerlens.llm.vector_codes import OP13_SQL, op13_vector_codes
from ledgerlens.llm.winnow import op9_winnowing


def queries() -> dict:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_mixing": op2_mixing,
        "op3_toxicity": op3_toxicity,
        "op4_url_filter": op4_url_filter,
        "op5_quality": op5_quality,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_cross_polytope": op7_cross_polytope,
        "op8_line_dedup": op8_line_dedup,
        "op9_winnowing": op9_winnowing,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_minhash": op11_minhash,
        "op12_spelling": op12_spelling,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": components_sql(GRAM, NUM, DEN), "op2_mixing": OP2_SQL, "op4_url_filter": OP4_SQL,
            "op6_substring_dedup": OP6_SQL, "op8_line_dedup": OP8_SQL, "op11_minhash": OP11_SQL, "op12_spelling": OP12_SQL, "op13_vector_codes": OP13_SQL}
