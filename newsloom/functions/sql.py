"""The article functions as SQL functions of a session."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from newsloom.functions.rouge import _metric, common_length, token_list
from newsloom.functions.text import CHUNK_CHARS, WHITESPACE

_BLANKS = "concat(" + ", ".join(f"char({ord(c)})" if ord(c) < 256 else f"decode(unhex('{c.encode('utf-8').hex()}'), 'utf-8')" for c in WHITESPACE) + ")"

_SENTENCES = r"filter(split(body, '\\.'), p -> length(p) > 0)"


def _chunks(parts: str, size: str) -> str:
    """The fold of `greedy_chunks` over an array that a SQL text gives."""
    return f"""aggregate(transform({parts}, p -> btrim(p, {_BLANKS})),
              named_struct('done', CAST(array() AS ARRAY<STRING>), 'open', '', 'started', false),
              (s, p) -> CASE
                WHEN length(s.open) + length(p) >= {size}
                  THEN named_struct('done', array_append(s.done, s.open), 'open', p, 'started', true)
                WHEN s.started THEN named_struct('done', s.done, 'open', s.open || '. ' || p, 'started', true)
                ELSE named_struct('done', s.done, 'open', p, 'started', true) END,
              s -> CASE WHEN s.started THEN array_append(s.done, s.open) ELSE s.done END)"""


#: Name, parameters, what it returns, and its body.
FUNCTIONS = (
    ("link_sha256", "link STRING", "STRING", "sha2(link, 256)"),
    ("link_md5", "link STRING, size INT DEFAULT 32", "STRING", "substring(md5(link), 1, size)"),
    ("article_sentences", "body STRING", "ARRAY<STRING>", _SENTENCES),
    (
        "article_chunks",
        f"body STRING, size INT DEFAULT {CHUNK_CHARS}",
        "ARRAY<STRING>",
        _chunks("article_sentences(body)", "size"),
    ),
    ("rouge_tokens", "text STRING", "ARRAY<STRING>", "filter(split(lower(text), '[^a-z0-9]+'), t -> length(t) > 0)"),
)

#: Name, parameters, columns, and the query. A generator over the parameter itself: it then stays in the rows of
#: the lateral join. Any other query is joined back to them by the text, after a shuffle of all the texts.
TABLE_FUNCTIONS = (
    ("chunk_rows", "body STRING", "pos INT, chunk STRING", f"SELECT pos, chunk FROM posexplode({_chunks(_SENTENCES, str(CHUNK_CHARS))}) AS c(pos, chunk)"),
)


@udtf(returnType="metric string, n_ref int, n_sum int, hits int, precision double, recall double, fmeasure double")
class RougeRows:
    """Two rows per pair of texts, for ROUGE-1 and ROUGE-L without stems."""

    def eval(self, reference: str, summary: str) -> Iterator[tuple]:
        ref, hyp = token_list(reference, None), token_list(summary, None)
        shared = (Counter(ref) & Counter(hyp)).total()
        for metric, hits in (("rouge1", shared), ("rougeL", common_length(ref, hyp))):
            scores = _metric(hits, len(ref), len(hyp))
            yield metric, len(ref), len(hyp), hits, scores["precision"], scores["recall"], scores["fmeasure"]


def register(spark: SparkSession) -> SparkSession:
    """Makes the functions known to the SQL of a session, until it ends.

    `link_sha256`, `link_md5`, `article_sentences`, `article_chunks` and
    `rouge_tokens` are SQL and run inside the JVM; `chunk_rows` is a table of
    chunks for a lateral join; `rouge_rows` a table of scores.
    """
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, parameters, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    spark.udtf.register("rouge_rows", RougeRows)
    return spark
