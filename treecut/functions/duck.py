"""DuckDB (RE2) rendering of the rule cascade, for the oracle queries.

The oracle runs the rule table verbatim - one ``regexp_replace`` per rule,
as a chain of CTEs - so it checks the Spark plan (fused, literal replaces)
against the plain reading of the rules in a second regex engine.
"""

from __future__ import annotations

from .rules import RE2, RULES, render_pattern, render_replacement

WS_RUN_RE2 = r"[ \t\n\x0B\f\r]+"


def sql_str(s: str) -> str:
    """A DuckDB string literal; plain text only (no newline or tab)."""
    return "'" + s.replace("'", "''") + "'"


def sql_estr(s: str) -> str:
    """A DuckDB string expression for any text (escape strings for newline,
    tab and CR; ``chr()`` for vertical tab and form feed)."""
    def lit(part: str) -> str:
        body = (part.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
                .replace("\t", "\\t").replace("\r", "\\r"))
        return "E'" + body + "'"
    out, cur = [], ""
    for ch in s:
        if ch in "\x0b\x0c":
            out += [lit(cur), f"chr({ord(ch)})"]
            cur = ""
        else:
            cur += ch
    out.append(lit(cur))
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def rule_expr(rule_id: str, x: str) -> str:
    for rid, pat, rep in RULES:
        if rid == rule_id:
            if rid == "T12":
                return f"(' ' || {x} || ' ')"
            return (f"regexp_replace({x}, {sql_str(render_pattern(pat, RE2))}, "
                    f"{sql_str(render_replacement(rep, RE2))}, 'g')")
    raise KeyError(rule_id)


def cascade_ctes(source: str, keys: list[str], text_expr: str, name: str = "c",
                 upto: str | None = None, only: list[str] | None = None) -> tuple[str, str]:
    """CTE list that tokenises ``text_expr`` of ``source``; returns (ctes, last name).

    The last CTE has ``keys`` and ``x`` (the tokenised text).  ``upto`` stops
    after a rule; ``only`` runs just the given rules.
    """
    k = ", ".join(keys)
    parts = [f"{name}0 AS (SELECT {k}, {text_expr} AS x FROM {source})"]
    step = 0
    for rid, _p, _r in RULES:
        if only is not None and rid not in only:
            continue
        parts.append(f"{name}{step + 1} AS (SELECT {k}, {rule_expr(rid, 'x')} AS x FROM {name}{step})")
        step += 1
        if upto is not None and rid == upto:
            break
    return ",\n".join(parts), f"{name}{step}"


def token_list(x: str) -> str:
    """T26 + T25 in DuckDB."""
    return f"list_filter(regexp_split_to_array({x}, {sql_str(WS_RUN_RE2)}), lambda t: t <> '')"
