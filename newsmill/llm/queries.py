"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from .decontamination import OP4_SQL, op4_decontamination
from .lm_scoring import op5_lm_scoring
from .ngram_join import OP3_SQL, op3_ngram_join
from .packing import op7_packing
from .quality_rules import OP6_SQL, op6_quality_rules
from .resampling import op13_resampling
from .secret_scan import op8_secret_scan
from .sentencepieces import op12_sentencepiece
from .sharding import op1_sharding
from .token_counts import op9_token_counts
from .url_filters import OP2_SQL, op2_url_filters
from .warc import OP10_SQL, op10_warc
from .whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_url_filters, op3_ngram_join, op4_decontamination, op5_lm_scoring, op6_quality_rules, op7_packing, op8_secret_scan, op9_token_counts, op10_warc,
        op11_whitening, op12_sentencepiece, op13_resampling,
    )
}
SQL = {"op2_url_filters": OP2_SQL, "op3_ngram_join": OP3_SQL, "op6_quality_rules": OP6_SQL, "op4_decontamination": OP4_SQL, "op10_warc": OP10_SQL}
