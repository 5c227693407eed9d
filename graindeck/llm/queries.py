"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name: module that has it as a function of the same name's prefix.
MODULES = {
    "op1_quality_classifier": "quality",
    "op2_source_mixing": "mixing",
    "op3_merkle_fixity": "fixity",
    "op4_line_dedup": "linededup",
    "op5_ngram_jaccard": "sigtree",
    "op6_pii": "pii",
    "op7_bpe": "bpe",
    "op8_lm_scoring": "lm",
    "op9_quality_rules": "rules",
    "op10_ann": "ann",
}


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"{__package__}.{MODULES[name]}"), name.partition("_")[0])(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {"op3_merkle_fixity": importlib.import_module(f"{__package__}.fixity").ORACLE}
