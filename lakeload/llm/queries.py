"""The queries of this subpackage and, where SQL can say the same, the SQL they must agree with."""

from lakeload.llm.chat import SQL7, op7_chat_rotation
from lakeload.llm.clustering import SQL13, op13_centroid_clusters
from lakeload.llm.decontaminate import op5_decontamination
from lakeload.llm.language import op9_language_id
from lakeload.llm.mixing import op1_source_mix
from lakeload.llm.quality import SQL3, op3_quality_rules
from lakeload.llm.simhash import op6_simhash
from lakeload.llm.substring import op8_substring_dedup
from lakeload.llm.token_counts import op2_token_counts
from lakeload.llm.toxicity import op11_toxicity
from lakeload.llm.url_filter import SQL10, op10_url_filter
from lakeload.llm.warc import SQL4, op4_revisits
from lakeload.llm.whitening import op12_whitening

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_revisits": op4_revisits,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_chat_rotation": op7_chat_rotation,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_toxicity": op11_toxicity,
    "op12_whitening": op12_whitening,
    "op13_centroid_clusters": op13_centroid_clusters,
}
ORACLE = {
    "op3_quality_rules": SQL3,
    "op4_revisits": SQL4,
    "op7_chat_rotation": SQL7,
    "op10_url_filter": SQL10,
    "op13_centroid_clusters": SQL13,
}
