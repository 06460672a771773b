"""SQL twins of the text views and flags, in the oracle's dialect (RE2: no lookaround, ASCII classes)."""

from __future__ import annotations

from sievelight.functions import quality as Q
from sievelight.functions import text as T


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def canonical(x: str) -> str:
    x = f"replace(lower(replace(nfc_normalize(replace({sub(x, chr(13) + chr(10) + '?', chr(10))}, chr(160), ' ')), 'ß', 'ss')), 'ß', 'ss')"
    for a, b in (("−", "-"), ("–", "-"), ("—", "-"), ("÷", "/"), ("×", r"\times")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    x = sub(x, r"\\(?:dfrac|tfrac)([^A-Za-z]|$)", r"\\frac\1")
    x = sub(x, r"\\(?:left|right)([^A-Za-z]|$)", r"\1")
    for mark in T.DELIMITERS:
        x = f"replace({x}, {lit(mark)}, '')"
    x = sub(x, T.SPACING, "")
    return sub(strip(sub(x, r"\s+", " ")), f" ?({T.EDGES}) ?", r"\1")


def source_text(canonical_sql: str) -> str:
    x = f"regexp_replace({canonical_sql}, {lit('(?i)' + T.EXERCISE_NUMBER.replace('(?=', '(').replace(')' + chr(92) + 'b)', ')' + chr(92) + 'b)'))}, {lit(chr(92) + '1')})"
    x = sub(x, r"\s*#\s*$", "")
    return strip(sub(x, r"\s+([?.!])", r"\1"))


def masked(canonical_sql: str) -> str:
    return sub(canonical_sql, r"(\B[+-]|\b)(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?\b", r"\1<num>")


#: Records with the text views and fingerprints.
def views(records: str) -> str:
    return (
        f"SELECT *, sha256(canonical) AS canonical_fp, sha256(source_text) AS source_fp, sha256(masked_text) AS masked_fp FROM (SELECT *, {source_text('canonical')} AS source_text, {masked('canonical')} AS masked_text "
        f"FROM (SELECT *, {canonical('question_raw')} AS canonical FROM ({records})))"
    )


def flags(t: str) -> dict[str, str]:
    """A condition for each flag, over a stripped text."""
    words = f"len(regexp_extract_all({t}, {lit(Q.FRAGMENT_WORD)}))"
    return {
        "fragment": f"({t} = '' OR {has(t, Q.FRAGMENT_NUMBER)} OR (length({t}) <= 20 AND {words} <= 3 AND NOT {has(t, '[?=]')}) OR (length({t}) <= 48 AND {has(t, Q.FRAGMENT_END)} AND NOT {has(t, Q.QUESTION_WORD)}))",
        "answer_or_solution_cue": has(t, Q.ANSWER_CUE),
        "numeric_boxed": has(t, Q.NUMERIC_BOXED),
        "url_or_image": has(t, Q.URL_OR_IMAGE),
        "missing_visual": f"({has(t, Q.VISUAL)} AND NOT {has(t, Q.ASYMPTOTE)})",
        "asymptote": has(t, Q.ASYMPTOTE),
        "multi_part": f"(len(regexp_extract_all({t}, {lit(Q.PART_MARKER)})) >= 2 OR {has(t, Q.MULTIPART)})",
        "non_ascii": has(t, r"[^\x00-\x7F]"),
        "multilingual": has(t, Q.SCRIPTS),
        "latex_proxy": has(t, Q.LATEX),
    }


def flagged(records: str) -> str:
    """Records with a boolean for each flag."""
    own = ", ".join(f"{v} AS {k}" for k, v in flags("q").items())
    return f"SELECT *, {own} FROM (SELECT *, {strip('question_raw')} AS q FROM ({records}))"


QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def distribution(x: str, prefix: str = "", names: tuple[str, ...] = ("p50", "p75", "p90", "p95", "p99")) -> str:
    mid = ", ".join(f"round(quantile_cont(CAST({x} AS DOUBLE), {QUANTILES[k]}), 6) AS {prefix}{k}" for k in names)
    return f"min({x}) AS {prefix}min, {mid}, max({x}) AS {prefix}max"


def stable_rank(namespace: str, seed: int, version: str, x: str) -> str:
    return f"sha256('{namespace}' || chr(0) || '{seed}' || chr(0) || '{version}' || chr(0) || CAST({x} AS VARCHAR))"
