"""The ten queries of this subpackage, and SQL where SQL can give the same rows."""

from .byte_bpe import op7_byte_bpe
from .decontamination import OP6_SQL, op6_decontamination
from .embedding_dedup import op5_embedding_dedup
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .language_id import op2_language_id
from .personal_data import op4_personal_data
from .secrets import op8_secret_scan
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .token_counts import op1_token_counts
from .url_filter import op9_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_personal_data": op4_personal_data,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_url_filter": op9_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": OP3_SQL,
    "op6_decontamination": OP6_SQL,
    "op10_substring_dedup": OP10_SQL,
}
