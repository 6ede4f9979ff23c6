"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.decontaminate import OP11_SQL, op11_decontaminate
from tidewell.llm.lexical import OP13_SQL, op13_lexical
from tidewell.llm.line_chunks import OP7_SQL, op7_line_dedup
from tidewell.llm.main_text import op8_html
from tidewell.llm.media import op6_media
from tidewell.llm.mixing import OP5_SQL, op5_mixing
from tidewell.llm.neighbours import op10_neighbours
from tidewell.llm.periodic_runs import op12_periodic
from tidewell.llm.pieces import op4_sentencepiece
from tidewell.llm.simhash import op2_simhash
from tidewell.llm.token_shards import op9_token_ids
from tidewell.llm.toxicity import op3_toxicity
from tidewell.llm.warc import OP1_SQL, op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op10_neighbours": op10_neighbours,
    "op11_decontaminate": op11_decontaminate,
    "op12_periodic": op12_periodic,
    "op13_lexical": op13_lexical,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_media": op6_media,
    "op7_line_dedup": op7_line_dedup,
    "op8_html": op8_html,
    "op9_token_ids": op9_token_ids,
}

ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op11_decontaminate": OP11_SQL, "op13_lexical": OP13_SQL, "op5_mixing": OP5_SQL, "op7_line_dedup": OP7_SQL}
