"""Queries: context windows, prompts, summaries, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.plans import prompts as P
from docflow.plans import summarize as S
from docflow.plans.embed import embed_chunks, embed_texts
from docflow.plans.models import ColumnModel, digest_model, letter_frequencies
from docflow.workload.inputs import SQL_LINES, documents, lines, sql_tokens
from docflow.workload.registry import query, table

_NL = "chr(10)"


def _q(text: str) -> str:
    """A Python text as an SQL string expression."""
    return "'" + text.replace("'", "''") + "'"


# The texts that prompts must have, written out apart from the code under test.
_SUMMARISE, _GUIDED = "You summarise documents.", "Follow this guidance:\n<guidance>\n{}\n</guidance>"
_SYSTEM = {
    "full": f"{_SUMMARISE} The user provides a whole document; summarise it.\n\n{_GUIDED}",
    "map": f"{_SUMMARISE} The document comes in chunks. Summarise exactly the current chunk; neighbouring chunks may be given as context. "
           f"Obey <constraint> elements of the prompt.\n\n{_GUIDED}",
    "fold": f"{_SUMMARISE} You get one chunk and the summary so far. Return the summary in the same form, extended by what is new in the "
            f"chunk, without losing what matters in it.\n\n{_GUIDED}",
    "delta-fold": f"{_SUMMARISE} You get one chunk and the list of summaries so far. Return only what is new in this chunk, as valid JSON; "
                  f"it is appended to the list.\n\n{_GUIDED}",
    "merge": f"{_SUMMARISE} You get two partial summaries. Merge them into one by the guidance given. Return only the merged summary.",
}


def _system(mode: str, guidance: str = "") -> str:
    return _SYSTEM[mode].format(guidance)


def _reply(system: str, user: str) -> str:
    return f"substr(sha256({_q(system)} || chr(10) || {user}), 1, 16)"


def _wrapped(i: str = "idx", t: str = "txt") -> str:
    return f"'<chunk id=\"' || doc_id || '/lines@' || {i} || '\">' || chr(10) || {t} || chr(10) || '</chunk>'"


# Each line with its neighbours' texts and the parts of its prompt around the summary so far.
def _sql_prompts(before: int, after: int, wrap: bool = True) -> str:
    text = _wrapped() if wrap else "txt"
    join = lambda lo, hi: (f"coalesce(string_agg(w, chr(10) || chr(10)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN {lo} AND {hi}), '')")
    pre = join(f"{before} PRECEDING", "1 PRECEDING") if before else "''"
    post = join("1 FOLLOWING", f"{after} FOLLOWING") if after else "''"
    rule = "chr(10) || chr(10)"
    return f"""{SQL_LINES},
ctx AS (SELECT *, {pre} AS pre, {post} AS post FROM (SELECT *, {text} AS w FROM lines)),
pr AS MATERIALIZED (SELECT doc_id, idx, n, txt, pre, post, '[document] ' || doc_id || chr(10) AS head,
  CASE WHEN pre <> '' THEN '[before]' || chr(10) || pre || {rule} ELSE '' END
  || '[metadata]' || chr(10) || '{{}}' || chr(10) || chr(10) || '[chunk]' || chr(10) || w
  || CASE WHEN post <> '' THEN {rule} || '[after]' || chr(10) || post ELSE '' END AS body FROM ctx)"""


@query("context_windows", f"""WITH {_sql_prompts(2, 1)}
SELECT doc_id, CAST(idx AS BIGINT) AS chunk_idx, sha256(pre) AS pre_hash, sha256(post) AS post_hash FROM pr""")
def _(spark, sf):
    return P.with_context(lines(spark, sf), 2, 1).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"),
                                                         F.sha2("preceding", 256).alias("pre_hash"), F.sha2("succeeding", 256).alias("post_hash"))


@query("prompts", f"""WITH {_sql_prompts(1, 1)}
SELECT doc_id, CAST(idx AS BIGINT) AS chunk_idx, sha256({_q(_system('map', 'Be brief.'))} || head || body) AS prompt_hash FROM pr""")
def _(spark, sf):
    rows = P.with_context(lines(spark, sf), 1, 1)
    return rows.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"),
                       F.sha2(F.concat(F.lit(P.system_prompt("map", "Be brief.")), P.chunk_prompt()), 256).alias("prompt_hash"))


@query("summarize_full", f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_reply(_system('full', 'Be brief.'),
  "'[document] ' || doc_id || chr(10) || '[metadata]' || chr(10) || '{}' || chr(10) || chr(10) || '[text]' || chr(10) || text")}
  AS summary FROM documents""")
def _(spark, sf):
    return S.summarize_full(documents(spark, sf), digest_model(), "Be brief.").select("doc_id", "summary")


@query("summarize_map", f"""WITH {_sql_prompts(1, 1)}
SELECT doc_id, CAST(idx AS BIGINT) AS chunk_idx, {_reply(_system('map', 'Be brief.'), 'head || body')} AS summary FROM pr""")
def _(spark, sf):
    out = S.summarize_map(lines(spark, sf), digest_model(), "lines", "Be brief.", before=1, after=1)
    return out.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "summary")


@query("summarize_fold", f"""WITH RECURSIVE {_sql_prompts(1, 0)},
f AS (SELECT doc_id, CAST(-1 AS BIGINT) AS i, CAST('' AS VARCHAR) AS acc, max(n) AS n FROM pr GROUP BY doc_id
  UNION ALL SELECT f.doc_id, i + 1, {_reply(_system('fold'), f"head || CASE WHEN acc = '' THEN '' ELSE '[summary so far]' || chr(10) || '\"' || acc || '\"' || chr(10) || chr(10) END || body")}, f.n
  FROM f JOIN pr ON pr.doc_id = f.doc_id AND pr.idx = f.i + 1)
SELECT doc_id, acc AS summary FROM f WHERE i = n - 1""")
def _(spark, sf):
    return S.summarize_fold(lines(spark, sf), digest_model(), "lines", before=1).select("doc_id", "summary")


_DELTA = f"""f AS (SELECT doc_id, CAST(-1 AS BIGINT) AS i, CAST('' AS VARCHAR) AS deltas, max(n) AS n FROM pr GROUP BY doc_id
  UNION ALL SELECT f.doc_id, i + 1, deltas || CASE WHEN deltas = '' THEN '' ELSE ',' END || '"' ||
    {_reply(_system('delta-fold'), "head || '[summaries so far]' || chr(10) || '[' || deltas || ']' || chr(10) || chr(10) || body")} || '"', f.n
  FROM f JOIN pr ON pr.doc_id = f.doc_id AND pr.idx = f.i + 1)"""


@query("summarize_delta_fold", f"""WITH RECURSIVE {_sql_prompts(0, 0)}, {_DELTA}
SELECT doc_id, sha256('[' || deltas || ']') AS summary_hash, CAST(n AS BIGINT) AS n_deltas FROM f WHERE i = n - 1""")
def _(spark, sf):
    whole, _ = S.summarize_delta_fold(lines(spark, sf), digest_model(), "lines")
    return whole.select("doc_id", F.sha2("summary", 256).alias("summary_hash"), F.size(F.from_json("summary", "array<string>")).cast("long").alias("n_deltas"))


def budget_model() -> ColumnModel:
    """Replies with as many tokens of its prompt's chunk as its limit allows."""
    def fn(_system, user, limit):
        chunk = F.regexp_extract(user, r'(?s)<chunk id="[^"]*">\n(.*?)\n</chunk>\z', 1)
        words = F.regexp_extract_all(chunk, F.lit(r"[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+\z"), F.lit(0))
        return F.array_join(F.slice(words, F.lit(1), limit.cast("int")), "")
    return ColumnModel("budget", fn)


_BUDGET = 60
_SQL_BUDGET = f"""WITH RECURSIVE {SQL_LINES}, t AS MATERIALIZED (SELECT doc_id, idx, n, {sql_tokens('txt')} AS toks FROM lines),
b AS (SELECT doc_id, CAST(-1 AS BIGINT) AS i, CAST({_BUDGET} AS BIGINT) AS remaining, max(n) AS chunks_left, CAST(0.75 AS DOUBLE) AS words, CAST(1 AS DOUBLE) AS seen,
    CAST(0 AS BIGINT) AS target, CAST(0 AS DOUBLE) AS words_target, CAST(0 AS BIGINT) AS actual, CAST(0 AS BIGINT) AS before_it FROM t GROUP BY doc_id
  UNION ALL
  SELECT doc_id, idx, greatest(remaining - actual, 0), chunks_left - 1, words + words_target, seen + actual, target, words_target, actual, remaining FROM (
    SELECT *, len(regexp_extract_all(regexp_replace(array_to_string(toks[1:target], ''), '^\\s+|\\s+$', '', 'g'), '[ \\t\\n\\r\\f]*[^ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$')) AS actual,
      words / seen * target AS words_target FROM (
      SELECT b.doc_id, t.idx, remaining, chunks_left, words, seen, toks, greatest(remaining // chunks_left, 0) AS target
      FROM b JOIN t ON t.doc_id = b.doc_id AND t.idx = b.i + 1)))"""


@query("summarize_map_budget", f"""{_SQL_BUDGET}
SELECT doc_id, CAST(i AS BIGINT) AS chunk_idx, CAST(target AS BIGINT) AS tokens_target, round(words_target, 6) AS words_target,
  CAST(actual AS BIGINT) AS tokens_actual, CAST(before_it AS BIGINT) AS budget_remaining FROM b WHERE i >= 0""")
def _(spark, sf):
    out = S.summarize_map_budget(lines(spark, sf), budget_model(), "lines", _BUDGET)
    return out.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "tokens_target", F.round("words_target", 6).alias("words_target"),
                      "tokens_actual", "budget_remaining")


@query("budget_stats", f"""{_SQL_BUDGET}
SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(target) AS BIGINT) AS tokens_target, CAST(sum(actual) AS BIGINT) AS tokens_actual,
  CAST(min(before_it) AS BIGINT) AS least_budget FROM b WHERE i >= 0 GROUP BY doc_id""")
def _(spark, sf):
    out = S.budget_stats(S.summarize_map_budget(lines(spark, sf), budget_model(), "lines", _BUDGET))
    return out.drop("tokens_input")


def bracket_model() -> ColumnModel:
    """Shows the shape of a merge: the two parts of the prompt between brackets."""
    def fn(_system, user, _limit):
        part = lambda name: F.regexp_extract(user, rf'(?s)\[{name}\]\n"(.*?)"\n\n', 1)
        return F.concat(F.lit("("), part("first"), F.lit("+"), part("second"), F.lit(")"))
    return ColumnModel("bracket", fn)


def _parts(spark, sf):
    return lines(spark, sf).select("doc_id", "chunk_idx", F.col("chunk_idx").cast("string").alias("summary"))


@query("merge_ltr", f"""WITH {SQL_LINES}
SELECT doc_id, repeat('(', max(n) - 1) || '0' || coalesce(string_agg('+' || idx || ')', '' ORDER BY idx) FILTER (WHERE idx > 0), '') AS summary
FROM lines GROUP BY doc_id""")
def _(spark, sf):
    return S.merge_left_to_right(_parts(spark, sf), bracket_model()).select("doc_id", "summary")


# Trees of every size up to the longest document, built bottom-up from their halves.
@query("merge_tree", f"""WITH RECURSIVE {SQL_LINES}, sizes AS (SELECT doc_id, max(n) AS n FROM lines GROUP BY doc_id),
nodes AS (SELECT doc_id, CAST(0 AS BIGINT) AS lo, n, '' AS path FROM sizes
  UNION ALL SELECT doc_id, CASE WHEN side = 0 THEN lo ELSE lo + n // 2 END, CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END, path || side
  FROM nodes, (VALUES (0), (1)) s(side) WHERE n > 1),
marks AS (SELECT doc_id, lo, n, length(path) AS d FROM nodes),
opens AS (SELECT doc_id, lo AS at, repeat('(', CAST(count(*) AS BIGINT)) AS o FROM marks WHERE n > 1 GROUP BY ALL),
closes AS (SELECT doc_id, lo + n - 1 AS at, repeat(')', CAST(count(*) AS BIGINT)) AS c FROM marks WHERE n > 1 GROUP BY ALL)
SELECT l.doc_id, string_agg(coalesce(o, '') || l.idx || coalesce(c, ''), '+' ORDER BY l.idx) AS summary FROM lines l
LEFT JOIN opens ON opens.doc_id = l.doc_id AND opens.at = l.idx LEFT JOIN closes ON closes.doc_id = l.doc_id AND closes.at = l.idx GROUP BY l.doc_id""")
def _(spark, sf):
    return S.merge_tree(_parts(spark, sf), bracket_model()).select("doc_id", "summary")


_MERGE_USER = ("'Merge the two.' || chr(10) || chr(10) || '[first]' || chr(10) || '\"' || acc || '\"' || chr(10) || chr(10) || "
               "'[second]' || chr(10) || '\"' || s || '\"' || chr(10) || chr(10) || '[guidance]' || chr(10) || 'Short.' || chr(10) || chr(10) || "
               "'Return one merged summary.' || chr(10)")


@query("summarize_map_merge", f"""WITH RECURSIVE {_sql_prompts(1, 0, wrap=False)},
s AS MATERIALIZED (SELECT doc_id, idx, n, {_reply(_system('map'), 'head || body')} AS s FROM pr),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, s AS acc, n FROM s WHERE idx = 0
  UNION ALL SELECT f.doc_id, i + 1, {_reply(_system('merge', 'Short.'), _MERGE_USER)}, f.n FROM f JOIN s ON s.doc_id = f.doc_id AND s.idx = f.i + 1)
SELECT doc_id, acc AS summary FROM f WHERE i = n - 1""")
def _(spark, sf):
    merged, _ = S.summarize_map_merge(lines(spark, sf), digest_model(), "lines", merge_guidance="Short.", before=1)
    return merged.select("doc_id", "summary")


def _sql_letters(text: str) -> str:
    """Millionths of all 26 letters, joined by commas."""
    of = lambda c: f"CAST((length({text}) - length(replace(lower({text}), '{c}', ''))) / CAST(greatest(length({text}), 1) AS DOUBLE) AS FLOAT)"
    return " || ',' || ".join(f"CAST(CAST(round(CAST({of(chr(97 + i))} AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)" for i in range(26))


def _millionths():
    return F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ",")


@query("embed_chunks", f"""WITH {SQL_LINES}
SELECT doc_id, CAST(idx AS BIGINT) AS chunk_idx, 'letters' AS model, {_sql_letters('txt')} AS vector FROM lines""")
def _(spark, sf):
    out = embed_chunks(lines(spark, sf), letter_frequencies(), "lines")
    return out.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "model", _millionths().alias("vector"))


@query("embed_texts", f"""SELECT item_id, {_sql_letters('text')} AS vector FROM benchmark""")
def _(spark, sf):
    return embed_texts(table(spark, sf, "benchmark"), letter_frequencies()).select("item_id", _millionths().alias("vector"))
