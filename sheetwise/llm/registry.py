"""Queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op1_bpe
from .collocations import ORACLE as PHRASES
from .collocations import op13_collocations
from .hmm import op4_hmm
from .infill import ORACLE as INFILL
from .infill import op12_infill
from .linededup import ORACLE as LINES
from .linededup import op7_line_dedup
from .mixing import op2_mixing
from .vectors import op10_top_k
from .warc import ORACLE as ARCHIVES
from .warc import op9_warc
from .quality import op6_classifier
from .substrings import op3_substrings
from .rules import op5_rules
from .simhash import op8_simhash
from .tokendfa import op11_token_automaton

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_substrings": op3_substrings,
    "op4_hmm": op4_hmm,
    "op5_rules": op5_rules,
    "op6_classifier": op6_classifier,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_top_k": op10_top_k,
    "op11_token_automaton": op11_token_automaton,
    "op12_infill": op12_infill,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": LINES,
    "op9_warc": ARCHIVES,
    "op12_infill": INFILL,
    "op13_collocations": PHRASES,
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
