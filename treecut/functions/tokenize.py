"""Tokenisers as pure Catalyst expressions (no Python per row).

``ptb_tokens(col)`` is the whole Treebank cascade (T1-T26) as one nested
column expression.  Every step references its input exactly once, so the
expression stays linear in size even when Catalyst inlines it (for example
when a filter is pushed below the projection that defines it).

Two plans compute the same function:

* ``canonical`` - the rule table verbatim, one ``regexp_replace`` per rule;
* ``fast`` (default) - rules whose regex only ever matches a fixed string are
  run as ``replace`` (a byte search on UTF8String that returns its input
  untouched when there is no match, with no UTF-16 round trip), and T18-T22
  run as one alternation.  ``tests/test_rules_property.py`` checks that the two
  plans agree on random adversarial text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import JAVA, RULES, render_pattern, render_replacement

WS_CLASS = JAVA.W
WS_RUN = WS_CLASS + "+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rx(x: Column, rule_id: str) -> Column:
    for rid, pat, rep in RULES:
        if rid == rule_id:
            return F.regexp_replace(x, render_pattern(pat, JAVA), render_replacement(rep, JAVA))
    raise KeyError(rule_id)


def _lit_replace(x: Column, search: str, replacement: str) -> Column:
    return F.replace(x, F.lit(search), F.lit(replacement))


def _pad(x: Column) -> Column:
    return F.concat(F.lit(" "), x, F.lit(" "))


def _fused(first: str, last: str) -> tuple[str, str]:
    """The rules from ``first`` to ``last``, each a (head)(tail) between word
    boundaries, as one alternation.  Only one can match at a place; Java skips
    groups that did not take part.  The blank that T22 wants behind it is looked
    at, not taken (blanks are where tokens are split, be there one or two)."""
    ids = [rid for rid, _, _ in RULES]
    own = [pat.removeprefix("(?i){L}") for _, pat, _ in RULES[ids.index(first) : ids.index(last) + 1]]
    words = [p.replace("{R}", JAVA.R) if p.endswith("{R}") else p.removesuffix(" ") + "(?= )" for p in own]
    starts = "".join(sorted({w[1] for w in words}))
    heads, tails = ("".join(f"${2 * i + k}" for i in range(len(words))) for k in (1, 2))
    return f"(?i)(?=[{starts}]){JAVA.L}(?:{'|'.join(words)})", f" {heads} {tails} "


_FUSED_T18_T22, _FUSED_T18_T22_REP = _fused("T18", "T22")


def _canonical_steps(x: Column, upto: str | None) -> Column:
    for rid, _pat, _rep in RULES:
        x = _pad(x) if rid == "T12" else _rx(x, rid)
        if upto is not None and rid == upto:
            break
    return x


def _hinted(rule_id: str, hint: str) -> tuple:
    """A rule with a look-ahead ``hint`` in front that only restates what the
    pattern itself requires at its first characters.  The matches are the
    same; Java's matcher just rejects most positions after one or two char
    tests instead of entering groups and alternations."""
    pat, rep = next((p, r) for rid, p, r in RULES if rid == rule_id)
    java = render_pattern(pat, JAVA)
    flags = "(?i)" if java.startswith("(?i)") else ""
    return ("regex", flags + "(?=" + hint + ")" + java[len(flags):], render_replacement(rep, JAVA), rule_id)


def _fast_plan() -> list[tuple]:
    """The fast plan as data: ("first_quote",), ("replace", s, r), ("regex", p, r[, rule]), ("pad",).

    Rendered both as a Column (``_apply``) and as Spark SQL text (``sqlfuncs``).
    Every step equals its rule(s) of the table, in the same order, except:

    * T3 matches the quote and looks behind for its opener: the opener a
      match consumed can never be part of an earlier match (it is not a
      quote), so consuming it or not gives the same result;
    * T6 and T8 run as one class, before T7: none of ``;@#$%&?!`` is a
      closing mark or a blank, so they commute with the final-period rule;
    * T18-T22 run as one alternation (only one pair can match at a place).
    """
    def rx(rule_id):
        pat, rep = next((p, r) for rid, p, r in RULES if rid == rule_id)
        return ("regex", render_pattern(pat, JAVA), render_replacement(rep, JAVA), rule_id)

    ws = JAVA.W[1:-1]
    steps: list[tuple] = [("first_quote",)]                    # T1
    steps.append(("replace", "``", " `` "))                   # T2
    steps.append(("regex", r'"(?<=[ (\[{<]")', " `` ", "T3"))  # T3
    steps.append(_hinted("T4", "[:,]"))
    steps.append(("replace", "...", " ... "))                 # T5
    steps.append(("regex", r"[;@#$%&?!]", " $0 ", "T6+T8"))    # T6, T8
    steps.append(_hinted("T7", r"[^.]\."))
    steps.append(rx("T9"))
    steps.append(("regex", r"[\]\[(){}<>]", " $0 ", "T10"))   # T10
    steps.append(("replace", "--", " -- "))                   # T11
    steps.append(("pad",))                                     # T12
    steps.append(("replace", '"', " '' "))                    # T13
    steps.append(_hinted("T14", "[^" + ws + "]''"))
    steps.append(_hinted("T15", "[^' ]'"))
    steps.append(_hinted("T16", "[^' ]['nN]"))                # T16 holds T17
    steps.append(("regex", _FUSED_T18_T22, _FUSED_T18_T22_REP, "T18-T22"))
    steps += [rx("T23"), rx("T24")]
    return steps


FAST_PLAN = _fast_plan()


#: A text without any of these is plain: the rules that need a quote (T1, T3, T9,
#: T13-T17, T19, T21, T23, T24) or a contraction (T18, T20, T22) cannot match, for
#: no other rule makes one; and no comma or colon follows another (T4 takes the
#: character behind a match with it, so of two only the first is spaced).
SPECIAL = r"""(?i)['"]|(?=[cglw])(?:cannot|gimme|gonna|gotta|lemme|wanna)|[:,][:,]"""


def _plain_plan() -> list[tuple]:
    """The fast plan for a plain text, in two passes: the final period (T7), which
    sees no mark that another rule could have spaced before it, for those are
    no closing marks or stand behind the period's own; then every other mark in
    one alternation, since no match of a rule holds a character of another's."""
    fast = {step[3]: step for step in FAST_PLAN if len(step) > 3}
    marks = r"``|\.\.\.|--|[;@#$%&?!\]\[(){}<>]|[:,](?![0-9])"
    return [fast["T7"], ("regex", marks, " $0 ", "T2+T4+T5+T6+T8+T10+T11"), ("pad",)]


PLAIN_PLAN = _plain_plan()


# A Java pattern that never matches: a rule switched off for a row.
_NEVER = "(?!)"


def _apply(x: Column, steps: list[tuple], final_period: Column | None = None) -> Column:
    for step in steps:
        kind = step[0]
        rule_id = step[3] if len(step) > 3 else None
        if kind == "regex" and final_period is not None and rule_id == "T7":
            # Per row on or off: the pattern becomes a column, and Spark
            # recompiles it where neighbouring rows differ (one line of a file).
            x = F.regexp_replace(x, F.when(final_period, F.lit(step[1])).otherwise(F.lit(_NEVER)), F.lit(step[2]))
            continue
        if kind == "first_quote":
            # A quote that opens the text.  Only this first step looks at its
            # input more than once, and the input is normally a plain column.
            x = F.when(x.startswith('"'), F.concat(F.lit("``"), F.substring(x, 2, 2**31 - 1))).otherwise(x)
        elif kind == "replace":
            x = _lit_replace(x, step[1], step[2])
        elif kind == "regex":
            x = F.regexp_replace(x, step[1], step[2])
        elif kind == "pad":
            x = _pad(x)
        else:
            raise ValueError(kind)
    return x


def _fast_steps(x: Column, final_period: Column | None = None) -> Column:
    # Two whole expressions with constant patterns, chosen by a look at the input.
    return F.when(x.rlike(SPECIAL), _apply(x, FAST_PLAN, final_period)).otherwise(_apply(x, PLAIN_PLAN, final_period))


def ptb_text(col: Column | str, plan: str = "fast", upto: str | None = None,
             final_period: Column | None = None) -> Column:
    """The text after the cascade: tokens separated by whitespace.

    ``upto`` stops after the named rule (canonical plan only) - used by the
    per-rule queries and tests.  ``final_period`` (a boolean column) switches
    T7 - the period at the end of the text - on or off per row; the
    large-file reader sets it only on the last non-blank line of a file.
    """
    x = _col(col)
    if plan == "canonical" or upto is not None:
        if final_period is not None:
            raise ValueError("final_period needs the fast plan")
        return _canonical_steps(x, upto)
    if plan != "fast":
        raise ValueError(f"unknown plan {plan!r}")
    return _fast_steps(x, final_period)


def split_tokens(spaced: Column | str) -> Column:
    """T26 + T25: split on whitespace runs and drop empty strings.

    Leading/trailing whitespace yields one empty piece at each end;
    ``array_remove`` drops them (codegen'd, unlike a ``filter`` lambda, and
    it reads its input once).  NULL stays NULL.
    """
    return F.array_remove(F.split(_col(spaced), WS_RUN), "")


def ptb_tokens(col: Column | str, plan: str = "fast", final_period: Column | None = None) -> Column:
    """Treebank tokens of a text column, ARRAY<STRING>."""
    return split_tokens(ptb_text(col, plan, final_period=final_period))


def ptb_token_count(col: Column | str, plan: str = "fast") -> Column:
    """Number of Treebank tokens.

    The cascade pads the text with a space at both ends (T12) and no later
    rule removes them, so the whitespace split always has exactly one empty
    piece at each end: the count is ``size - 2``, with no filtering pass.
    """
    c = _col(col)
    return F.when(c.isNotNull(), F.size(F.split(ptb_text(c, plan), WS_RUN)) - F.lit(2))


def whitespace_tokens(col: Column | str) -> Column:
    """T26 alone: the plain whitespace tokeniser."""
    return split_tokens(col)


def ptb_line_tokens(col: Column | str, plan: str = "fast") -> Column:
    """Naive per-line tokenising: each line of the text is tokenised on its own.

    A second tokenisation to compare against (it differs at line-start quotes,
    line-end periods and contractions before a newline).
    """
    lines = F.split(_col(col), "\n")
    per_line = F.transform(lines, lambda ln: ptb_tokens(ln, plan))
    return F.flatten(per_line)


TOKENISERS = ("ptb", "whitespace", "ptb_lines")


def tokens(col: Column | str, method: str = "ptb") -> Column:
    """choose a tokeniser by name."""
    if method == "ptb":
        return ptb_tokens(col)
    if method == "whitespace":
        return whitespace_tokens(col)
    if method == "ptb_lines":
        return ptb_line_tokens(col)
    raise ValueError(f"unknown tokeniser {method!r}; choose one of {TOKENISERS}")


def token_text(arr: Column | str, sep: str = " ") -> Column:
    """tokens joined by one space (lossless: tokens hold no whitespace)."""
    return F.concat_ws(sep, _col(arr))


def normalise_marks(col: Column | str) -> Column:
    """put spaces around every ``...`` and ``--`` of ready text."""
    return _lit_replace(_lit_replace(_col(col), "...", " ... "), "--", " -- ")


def byte_length(col: Column | str) -> Column:
    """UTF-8 byte length (what the reference counts), not characters."""
    return F.octet_length(_col(col))
