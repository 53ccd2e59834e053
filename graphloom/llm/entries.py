"""Queries of this subpackage, and their SQL where SQL can express them."""

from . import sql
from .decontaminate import op8_suffix_decontamination
from .langid import op6_byte_bigru
from .licences import OP7_SQL, op7_dice_licences
from .linededup import OP5_SQL, op5_line_windows
from .lmscore import op9_attention_scores
from .neardup import op2_probminhash_classes
from .packing import op4_shortest_pack_first
from .quality import op1_quality_ledger, quality_ablations
from .secrets import op3_entropy_secrets
from .sharding import op10_virtual_slots

QUERIES = {
    "op1_quality_ledger": op1_quality_ledger,
    "op2_probminhash_classes": op2_probminhash_classes,
    "op3_entropy_secrets": op3_entropy_secrets,
    "op4_shortest_pack_first": op4_shortest_pack_first,
    "op5_line_windows": op5_line_windows,
    "op6_byte_bigru": op6_byte_bigru,
    "op7_dice_licences": op7_dice_licences,
    "op8_suffix_decontamination": op8_suffix_decontamination,
    "op9_attention_scores": op9_attention_scores,
    "op10_virtual_slots": op10_virtual_slots,
    "quality_ablations": quality_ablations,
}
SQL: dict[str, str] = {
    "op1_quality_ledger": sql.OP1,
    "quality_ablations": sql.ABLATIONS,
    "op3_entropy_secrets": sql.OP3,
    "op5_line_windows": OP5_SQL,
    "op7_dice_licences": OP7_SQL,
    "op8_suffix_decontamination": sql.OP8,
}
