"""The corpus operators' queries by name, and DuckDB twins where SQL can express them."""

from kindred.llm.classifier import op9_quality_classifier
from kindred.llm.decontaminate import op2_decontamination
from kindred.llm.filteraudit import ORACLE as AUDIT_SQL
from kindred.llm.filteraudit import op13_filter_audit
from kindred.llm.fim import ORACLE as FIM_SQL
from kindred.llm.fim import op12_fill_in_middle
from kindred.llm.packing import op1_packing
from kindred.llm.rules import ORACLE as RULES_SQL
from kindred.llm.rules import op4_quality_rules
from kindred.llm.secretscan import op11_secret_scan
from kindred.llm.simhash import op7_simhash
from kindred.llm.sitetree import op8_site_tree
from kindred.llm.suffixes import op10_suffix_dedup
from kindred.llm.tokencounts import op5_token_counts
from kindred.llm.tokenfiles import op6_token_files
from kindred.llm.warc import ORACLE as WARC_SQL
from kindred.llm.warc import op3_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_site_tree": op8_site_tree,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": WARC_SQL,
    "op4_quality_rules": RULES_SQL,
    "op12_fill_in_middle": FIM_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
