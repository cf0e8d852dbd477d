"""DuckDB SQL for every registered query (the driver's correctness oracle).

The cascade here is the rule table read verbatim (one ``regexp_replace``
per rule, RE2 dialect), not the fused/literal plan Spark runs.
"""

from __future__ import annotations

from ..functions.duck import cascade_ctes, rule_expr, token_list
from ..operators.compare import LOOKAHEAD, STOP_CONTEXT
from ..operators.tokens import PREVIEW_FIRST, PREVIEW_GAP, PREVIEW_LAST, RETAIN_K
from ..operators.speedup import ENGINES, SIZES_MB
from .queries import BATCH_LIMIT, CAP, RULE_QUERY_IDS, TURN_LIMIT
from .tables import stress_text_sql

ORACLE: dict[str, str] = {}

STRESS = stress_text_sql("text", "doc_id")


def _tokenised(source: str, keys: list[str], text_expr: str, name: str = "c") -> tuple[str, str]:
    """CTEs ending in ``{name}_t(keys, tl)``: the token list of every row."""
    ctes, last = cascade_ctes(source, keys, text_expr, name)
    k = ", ".join(keys)
    ctes += f",\n{name}_t AS (SELECT {k}, {token_list('x')} AS tl FROM {last})"
    return ctes, f"{name}_t"


def _summary(source: str, keys: list[str], text_expr: str) -> str:
    ctes, t = _tokenised(source, keys, text_expr)
    k = ", ".join(keys)
    return (f"WITH {ctes}\nSELECT {k}, len(tl)::BIGINT AS n_tokens, array_to_string(tl, ' ') AS tokens "
            f"FROM {t}")


ORACLE["ptb_tokens"] = _summary("documents", ["doc_id"], "text")
ORACLE["ptb_stress"] = _summary("documents", ["doc_id"], STRESS)
ORACLE["ptb_tokens_conversations"] = _summary("conversations", ["conv_id", "turn"], "text")
ORACLE["ptb_tokens_pages"] = _summary("pages", ["page_id"], "html")
ORACLE["ptb_tokens_benchmark"] = _summary("benchmark", ["item_id"], "text")
ORACLE["sql_ptb_tokens"] = ORACLE["ptb_tokens"]

for _rid in RULE_QUERY_IDS:
    ORACLE[f"ptb_rule_{_rid}"] = f"SELECT doc_id, {rule_expr(_rid, STRESS)} AS out_text FROM documents"

ORACLE["whitespace_tokens"] = (
    f"SELECT doc_id, len({token_list('text')})::BIGINT AS n_tokens, "
    f"array_to_string({token_list('text')}, ' ') AS tokens FROM documents")

_lines_ctes, _lines_t = _tokenised("lines", ["doc_id", "ln"], "line", "l")
ORACLE["ptb_line_tokens"] = f"""
WITH docs AS (SELECT doc_id, string_split({STRESS}, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM docs),
{_lines_ctes},
per_doc AS (SELECT doc_id, flatten(list(tl ORDER BY ln)) AS t FROM {_lines_t} GROUP BY doc_id)
SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM per_doc"""


def _token_rows(source: str, keys: list[str], text_expr: str, name: str = "c") -> tuple[str, str]:
    ctes, t = _tokenised(source, keys, text_expr, name)
    k = ", ".join(keys)
    ctes += (f",\n{name}_rows AS (SELECT {k}, unnest(range(len(tl)))::BIGINT AS pos, unnest(tl) AS token "
             f"FROM {t})")
    return ctes, f"{name}_rows"


_ctes, _rows = _token_rows("documents", ["doc_id"], STRESS)
ORACLE["token_table"] = f"WITH {_ctes}\nSELECT doc_id, pos, token FROM {_rows}"

_ctes, _rows = _token_rows("conversations", ["conv_id", "turn"], "text")
ORACLE["sql_token_rows"] = f"WITH {_ctes}\nSELECT conv_id, turn, pos, token FROM {_rows}"

_ctes, _t = _tokenised("conversations", ["conv_id", "turn", "role"], "text")
ORACLE["token_text"] = f"""WITH {_ctes},
turns AS (SELECT conv_id, turn, role, len(tl)::BIGINT AS n_tokens, array_to_string(tl, ' ') AS text FROM {_t})
SELECT conv_id, turn, role, n_tokens, text,
       count(*) OVER (PARTITION BY conv_id)::BIGINT AS conv_turns,
       sum(n_tokens) OVER (PARTITION BY conv_id)::BIGINT AS conv_tokens
FROM turns"""

_norm = "replace(replace(html, '...', ' ... '), '--', ' -- ')"
ORACLE["normalise_marks"] = (
    f"SELECT page_id, len({token_list(_norm)})::BIGINT AS n_tokens, "
    f"array_to_string({token_list(_norm)}, ' ') AS tokens FROM pages")


def _totals(source: str, keys: list[str], extra: list[str], group: str = "", select_keys: str = "") -> str:
    ctes, t = _tokenised(source, keys + extra, "text")
    measures = "count(*)::BIGINT AS files, sum(strlen(text))::BIGINT AS bytes, sum(len(tl))::BIGINT AS tokens"
    ctes += f",\nwith_text AS (SELECT t.*, s.text FROM {t} t JOIN {source} s USING ({', '.join(keys)}))"
    return f"WITH {ctes}\nSELECT {select_keys}{measures} FROM with_text {group}"


ORACLE["corpus_totals"] = _totals("documents", ["doc_id"], [])
ORACLE["corpus_totals_by_lang"] = _totals("documents", ["doc_id"], ["lang"], "GROUP BY lang", "lang, ")
ORACLE["corpus_totals_by_source"] = _totals("documents", ["doc_id"], ["source"], "GROUP BY source", "source, ")
ORACLE["corpus_rollup"] = _totals(
    "documents", ["doc_id"], ["lang", "source"], "GROUP BY ROLLUP (lang, source)",
    "lang, source, grouping(lang, source)::BIGINT AS level, ")
ORACLE["conversation_totals"] = _totals("conversations", ["conv_id", "turn"], ["role"], "GROUP BY role", "role, ")

_WALK = f"""items AS (SELECT doc_id, strlen(text)::BIGINT AS bytes,
                  (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS rank FROM documents),
walk AS (
  SELECT doc_id, bytes, rank, bytes AS fill, 0::BIGINT AS batch_id FROM items WHERE rank = 0
  UNION ALL
  SELECT i.doc_id, i.bytes, i.rank,
         CASE WHEN w.fill + i.bytes < {BATCH_LIMIT} THEN w.fill + i.bytes ELSE i.bytes END,
         CASE WHEN w.fill + i.bytes < {BATCH_LIMIT} THEN w.batch_id ELSE w.batch_id + 1 END
  FROM walk w JOIN items i ON i.rank = w.rank + 1)"""

ORACLE["batch_manifest"] = f"WITH RECURSIVE {_WALK}\nSELECT doc_id, bytes, rank, batch_id FROM walk"
ORACLE["batch_manifest_distributed"] = ORACLE["batch_manifest"]

ORACLE["batch_manifest_turns"] = f"""WITH RECURSIVE items AS (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE strlen(text)::BIGINT END AS bytes,
         (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS rank FROM conversations),
walk AS (
  SELECT conv_id, turn, bytes, rank, coalesce(bytes, 0) AS fill, 0::BIGINT AS batch_id FROM items WHERE rank = 0
  UNION ALL
  SELECT i.conv_id, i.turn, i.bytes, i.rank,
         CASE WHEN w.fill + coalesce(i.bytes, 0) < {TURN_LIMIT} THEN w.fill + coalesce(i.bytes, 0) ELSE coalesce(i.bytes, 0) END,
         CASE WHEN w.fill + coalesce(i.bytes, 0) < {TURN_LIMIT} THEN w.batch_id ELSE w.batch_id + 1 END
  FROM walk w JOIN items i ON i.rank = w.rank + 1)
SELECT conv_id, turn, bytes, rank, batch_id FROM walk"""

_ctes, _t = _tokenised("documents", ["doc_id"], "text")
ORACLE["run_totals"] = f"""WITH {_ctes}
SELECT count(*)::BIGINT AS files, sum(strlen(d.text))::BIGINT AS bytes, sum(len(t.tl))::BIGINT AS tokens
FROM {_t} t JOIN documents d USING (doc_id)"""
ORACLE["batch_previews"] = f"""WITH RECURSIVE {_WALK},
{_ctes},
whole AS (SELECT w.batch_id, flatten(list(t.tl ORDER BY doc_id)) AS tl FROM walk w JOIN {_t} t USING (doc_id) GROUP BY w.batch_id)
SELECT batch_id, len(tl)::BIGINT AS n_tokens, array_to_string(tl[1:50], ' ') AS first_tokens,
       array_to_string(tl[greatest(len(tl) - 9, 1):len(tl)], ' ') AS last_tokens,
       array_to_string(tl[1:50], ',') || ',' || '{PREVIEW_GAP}' || array_to_string(tl[greatest(len(tl) - 9, 1):len(tl)], ',')
       || ',(' || len(tl) || ' tokens)' AS preview
FROM whole"""
ORACLE["batch_totals"] = f"""WITH RECURSIVE {_WALK},
{_ctes}
SELECT w.batch_id, count(*)::BIGINT AS files, sum(w.bytes)::BIGINT AS bytes, sum(len(t.tl))::BIGINT AS tokens
FROM walk w JOIN {_t} t USING (doc_id) GROUP BY w.batch_id"""

_ctes, _rows = _token_rows("documents", ["doc_id"], "text")
ORACLE["output_cap"] = f"""WITH RECURSIVE {_WALK},
{_ctes},
per_doc AS (SELECT w.batch_id, r.doc_id, count(*) AS n FROM {_rows} r JOIN walk w USING (doc_id)
            GROUP BY w.batch_id, r.doc_id),
offs AS (SELECT batch_id, doc_id, coalesce(sum(n) OVER (PARTITION BY batch_id ORDER BY doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM per_doc)
SELECT o.batch_id, r.doc_id, r.pos, r.token FROM {_rows} r JOIN offs o USING (doc_id)
WHERE o.off + r.pos < {CAP}"""

ORACLE["preview_first"] = f"WITH {_ctes}\nSELECT doc_id, pos, token FROM {_rows} ORDER BY doc_id, pos LIMIT {PREVIEW_FIRST}"
ORACLE["preview_last"] = (f"WITH {_ctes}\nSELECT doc_id, pos, token FROM {_rows} "
                          f"ORDER BY doc_id DESC, pos DESC LIMIT {PREVIEW_LAST}")

_ctes, _t = _tokenised("documents", ["doc_id"], STRESS)
_first = f"tl[1:{PREVIEW_FIRST}]"
_last = f"tl[greatest(len(tl) - {PREVIEW_LAST - 1}, 1):len(tl)]"
ORACLE["previews"] = f"""WITH {_ctes}
SELECT doc_id, len(tl)::BIGINT AS n_tokens,
       array_to_string({_first}, ' ') AS first_tokens,
       array_to_string({_last}, ' ') AS last_tokens,
       array_to_string(list_transform({_first}, lambda t: t || ','), '') || '{PREVIEW_GAP}'
         || array_to_string(list_transform({_last}, lambda t: t || ','), '')
         || '(' || len(tl)::VARCHAR || ' tokens)' AS preview
FROM {_t}"""

_ctes, _t = _tokenised("documents", ["doc_id"], "text")
ORACLE["retain_k"] = (f"WITH {_ctes}\nSELECT doc_id, len(tl)::BIGINT AS n_tokens, "
                      f"array_to_string(tl[1:{RETAIN_K}], ' ') AS kept FROM {_t}")


# -- J2 / J3: the greedy walk as list_reduce over range(n + 1) ---------------

def _walk_step(with_events: bool) -> str:
    def st(i, j, c, s, ev="acc.ev"):
        e = f", 'ev': {ev}" if with_events else ""
        return f"{{'i': {i}, 'j': {j}, 'c': {c}, 's': {s}{e}}}"

    def event(kind, cost, width):
        return (f"list_append(acc.ev, {{'seq': len(acc.ev)::BIGINT, 'i': acc.i, 'j': acc.j, "
                f"'kind': '{kind}', 'cost': {cost}::BIGINT, 'width': {width}::BIGINT}})")

    branches = [f"WHEN acc.s OR NOT (acc.i < p.n - 1 AND acc.j < p.n - 1) THEN {st('acc.i', 'acc.j', 'acc.c', 'true')}",
                f"WHEN p.a[acc.i + 1] = p.b[acc.j + 1] THEN {st('acc.i + 1', 'acc.j + 1', 'acc.c', 'false')}"]
    for kind, da, db, mi, mj, cost, width in LOOKAHEAD:
        ev = event(kind, cost, width) if with_events else "acc.ev"
        branches.append(f"WHEN coalesce(p.a[acc.i + {da + 1}] = p.b[acc.j + {db + 1}], false) "
                        f"THEN {st(f'acc.i + {mi}', f'acc.j + {mj}', f'acc.c + {cost}', 'false', ev)}")
    stop_ev = event("stop", 0, STOP_CONTEXT) if with_events else "acc.ev"
    branches.append(f"ELSE {st('acc.i', 'acc.j', 'acc.c', 'true', stop_ev)}")
    return "CASE " + "\n  ".join(branches) + " END"


_EV_TYPE = "STRUCT(seq BIGINT, i BIGINT, j BIGINT, kind VARCHAR, cost BIGINT, width BIGINT)[]"


def _walk(pairs: str, with_events: bool) -> str:
    init_ev = f", 'ev': []::{_EV_TYPE}" if with_events else ""
    init = f"{{'i': 0::BIGINT, 'j': 0::BIGINT, 'c': 0::BIGINT, 's': false{init_ev}}}"
    return (f"SELECT p.*, list_reduce(range(greatest(p.n, 0) + 1), lambda acc, x: {_walk_step(with_events)}, "
            f"{init}) AS r FROM (SELECT *, least(len(a), len(b)) AS n FROM {pairs}) p")


def _pairs_ptb_ws(extra: list[str] | None = None, text_expr: str = "text") -> str:
    keys = ["doc_id"] + (extra or [])
    ctes, t = _tokenised("documents", keys, text_expr)
    k = ", ".join(f"t.{c}" for c in keys)
    return (f"{ctes},\npairs AS (SELECT {k}, t.tl AS a, {token_list('d.text')} AS b "
            f"FROM {t} t JOIN documents d USING (doc_id))")


_DIFF_COLS = "doc_id, r.c AS mismatched, r.i AS compared, len(a)::BIGINT AS len_a, len(b)::BIGINT AS len_b"
ORACLE["token_diff"] = f"WITH {_pairs_ptb_ws()},\nw AS ({_walk('pairs', False)})\nSELECT {_DIFF_COLS} FROM w"
ORACLE["token_diff_join"] = ORACLE["token_diff"]

_ctes_a, _ta = _tokenised("documents", ["doc_id"], STRESS, "c")
_ctes_l, _tl = _tokenised("lines", ["doc_id", "ln"], "line", "l")
ORACLE["token_diff_lines"] = f"""WITH {_ctes_a},
docs AS (SELECT doc_id, string_split({STRESS}, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM docs),
{_ctes_l},
per_doc AS (SELECT doc_id, flatten(list(tl ORDER BY ln)) AS b FROM {_tl} GROUP BY doc_id),
pairs AS (SELECT doc_id, x.tl AS a, y.b AS b FROM {_ta} x JOIN per_doc y USING (doc_id)),
w AS ({_walk('pairs', False)})
SELECT {_DIFF_COLS} FROM w"""

ORACLE["token_diff_rows"] = f"""WITH {_pairs_ptb_ws()},
w AS ({_walk('pairs', True)}),
ev AS (SELECT doc_id, a, b, unnest(r.ev) AS e FROM w)
SELECT doc_id, e.seq AS seq, e.i AS i, e.j AS j, e.kind AS kind, e.cost AS cost,
       array_to_string(a[greatest(e.i - 2, 0) + 1 : e.i + e.width - 2], ' ') AS a_context,
       array_to_string(b[greatest(e.j - 2, 0) + 1 : e.j + e.width - 2], ' ') AS b_context
FROM ev"""

_ROLL = ("count(*)::BIGINT AS files, sum(r.c)::BIGINT AS mismatched, sum(r.i)::BIGINT AS compared, "
         "round(CASE WHEN sum(r.i) > 0 THEN sum(r.c) / sum(r.i) END, 6) AS rate")
ORACLE["mismatch_rollup"] = f"WITH {_pairs_ptb_ws()},\nw AS ({_walk('pairs', False)})\nSELECT {_ROLL} FROM w"
ORACLE["mismatch_rollup_by_lang"] = (
    f"WITH {_pairs_ptb_ws(['lang'])},\nw AS ({_walk('pairs', False)})\nSELECT lang, {_ROLL} FROM w GROUP BY lang")


# -- Files derived from the tables ---------------------------------------------
from .derived import FILE_TEXT_SQL, LONG_LINE_SQL  # noqa: E402

_ctes, _t = _tokenised("files", ["file"], "text")
ORACLE["file_corpus"] = f"""WITH {FILE_TEXT_SQL},
{_ctes}
SELECT f.file, strlen(f.text)::BIGINT AS bytes, strlen(f.text)::BIGINT AS text_bytes, len(t.tl)::BIGINT AS n_tokens
FROM files f JOIN {_t} t USING (file)"""

_ctes, _rows = _token_rows("files", ["file"], "text")
ORACLE["large_file_tokens"] = f"WITH {FILE_TEXT_SQL},\n{_ctes}\nSELECT file, pos, token FROM {_rows}"

_ctes, _rows = _token_rows("documents", ["doc_id"], "text")
ORACLE["token_parts"] = f"""WITH RECURSIVE {_WALK},
{_ctes}
SELECT w.batch_id, count(*)::BIGINT AS n_tokens, string_agg(r.token, ' ' ORDER BY r.doc_id, r.pos) AS tokens
FROM {_rows} r JOIN walk w USING (doc_id) GROUP BY w.batch_id"""

_ctes, _t = _tokenised("files", ["file"], "text")
ORACLE["stream_totals"] = f"""WITH {FILE_TEXT_SQL},
{_ctes}
SELECT count(*)::BIGINT AS files, sum(strlen(f.text))::BIGINT AS bytes, sum(len(t.tl))::BIGINT AS tokens
FROM files f JOIN {_t} t USING (file)"""

_ctes, _rows = _token_rows("files", ["file"], "text")
ORACLE["stream_parts"] = f"""WITH {FILE_TEXT_SQL},
{_ctes}
SELECT token, count(*)::BIGINT AS n FROM {_rows} GROUP BY token"""

ORACLE["file_lines"] = f"""WITH {FILE_TEXT_SQL},
parts AS (SELECT file, string_split(text, chr(10)) AS ls FROM files),
lines AS (SELECT file, len(ls) AS k, unnest(ls) AS line, unnest(range(len(ls)))::BIGINT AS line_no FROM parts)
SELECT file, line_no, line FROM lines WHERE line_no < k - 1"""

_ctes_a, _ta = _tokenised("files", ["file"], "text", "c")
_ctes_l, _tl = _tokenised("flines", ["file", "ln"], "line", "l")
ORACLE["file_compare"] = f"""WITH {FILE_TEXT_SQL},
{_ctes_a},
fparts AS (SELECT file, string_split(text, chr(10)) AS ls FROM files),
flines AS (SELECT file, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM fparts),
{_ctes_l},
per_file AS (SELECT file, flatten(list(tl ORDER BY ln)) AS b FROM {_tl} GROUP BY file),
pairs AS (SELECT file, x.tl AS a, y.b AS b FROM {_ta} x JOIN per_file y USING (file)),
w AS ({_walk('pairs', False)})
SELECT file, r.c AS mismatched, r.i AS compared, len(a)::BIGINT AS len_a, len(b)::BIGINT AS len_b FROM w"""

_ctes, _t = _tokenised("conversations", ["conv_id", "turn", "role"], "text")
ORACLE["mismatch_rollup_by_role"] = f"""WITH {_ctes},
pairs AS (SELECT t.conv_id, t.turn, t.role, t.tl AS a, {token_list('c.text')} AS b
          FROM {_t} t JOIN conversations c USING (conv_id, turn)),
w AS ({_walk('pairs', False)})
SELECT role, {_ROLL} FROM w GROUP BY role"""


ORACLE["file_diff_rows"] = ORACLE["file_compare"][:ORACLE["file_compare"].rindex("w AS (")] + f"""w AS ({_walk('pairs', True)}),
ev AS (SELECT file, a, b, unnest(r.ev) AS e FROM w)
SELECT file, e.seq AS seq, e.i AS i, e.j AS j, e.kind AS kind, e.cost AS cost,
       array_to_string(a[greatest(e.i - 2, 0) + 1 : e.i + e.width - 2], ' ') AS a_context,
       array_to_string(b[greatest(e.j - 2, 0) + 1 : e.j + e.width - 2], ' ') AS b_context
FROM ev"""

_ctes, _t = _tokenised("documents", ["doc_id"], "text")
_spaced = "replace(replace({}, '...', ' ... '), '--', ' -- ')"
ORACLE["compare_parts"] = f"""WITH RECURSIVE {_WALK},
{_ctes},
texts AS (SELECT w.batch_id, string_agg(array_to_string(t.tl, ' '), ' ' ORDER BY doc_id) AS x,
                 string_agg(d.text, ' ' ORDER BY doc_id) AS y
          FROM walk w JOIN {_t} t USING (doc_id) JOIN documents d USING (doc_id) GROUP BY w.batch_id),
pairs AS (SELECT batch_id, {token_list(_spaced.format('x'))} AS a, {token_list(_spaced.format('y'))} AS b FROM texts),
w AS ({_walk('pairs', False)})
SELECT batch_id, r.c AS mismatched, r.i AS compared, len(a)::BIGINT AS len_a, len(b)::BIGINT AS len_b FROM w"""

# The same answers from chunks, pieces and chunk manifests.
ORACLE["token_diff_chunks"] = ORACLE["token_diff"]
ORACLE["token_diff_rows_chunks"] = ORACLE["token_diff_rows"]
ORACLE["large_file_compare"] = ORACLE["file_compare"]
ORACLE["large_file_diff_rows"] = ORACLE["file_diff_rows"]
ORACLE["stream_part_tokens"] = ORACLE["large_file_tokens"]
ORACLE["stream_manifest"] = ORACLE["file_corpus"].replace(
    "strlen(f.text)::BIGINT AS text_bytes, len(t.tl)::BIGINT AS n_tokens", "len(t.tl)::BIGINT AS n_tokens, true AS within_limit")
_ctes, _rows = _token_rows("files", ["file"], "text")
ORACLE["long_line_tokens"] = f"WITH {LONG_LINE_SQL},\n{_ctes}\nSELECT file, pos, token FROM {_rows}"

_LINES = """g AS (SELECT lang, source, sum(strlen(text))::BIGINT AS bytes, count(*) AS n, sum(length(text))::BIGINT AS tokens
      FROM documents GROUP BY lang, source),
lines AS (SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY source) - 1)::BIGINT AS k,
                 round(n + (bytes % 1000) / 1000.0, 3)::DOUBLE AS secs, bytes, tokens FROM g)"""
ORACLE["timing_lines"] = f"WITH {_LINES}\nSELECT lang, k, secs, bytes, tokens FROM lines"
_RUNS = f"""{_LINES},
sized AS (SELECT *, count(*) OVER (PARTITION BY lang) // {len(ENGINES)} AS per FROM lines),
runs AS (SELECT lang, {ENGINES}[(k // per) + 1] AS engine, (k % per)::INTEGER AS size_idx, {SIZES_MB}[(k % per) + 1]::INTEGER AS size_mb, secs
         FROM sized WHERE per > 0 AND k < per * {len(ENGINES)})"""
ORACLE["run_matrix"] = f"WITH {_RUNS}\nSELECT lang, engine, size_idx, size_mb, secs FROM runs"
ORACLE["speedup_report"] = f"""WITH {_RUNS}
SELECT r.lang, r.engine, r.size_idx, r.size_mb, r.secs, b.secs AS baseline_secs,
       round(CASE WHEN r.secs > 0 THEN b.secs / r.secs END, 6) AS speedup
FROM runs r JOIN runs b ON r.lang = b.lang AND r.size_idx = b.size_idx AND b.engine = '{ENGINES[0]}'
WHERE r.engine <> '{ENGINES[0]}'"""
