"""Review flags of a question. They inform; nothing is dropped by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions import text as T

# ---- fixed values: the flags in their order, and their patterns (the same in every regex dialect used) ----
FLAGS = ("fragment", "answer_or_solution_cue", "numeric_boxed", "url_or_image", "missing_visual", "asymptote", "multi_part", "non_ascii", "multilingual", "latex_proxy")
ANSWER_CUE = r"(?im)(?:^|[\n.!?]\s*)(?:final\s+)?(?:answer|solution)\s*(?:is\b|[:=])|####\s*[+-]?\d+"
NUMERIC_BOXED = r"\\(?:boxed|fbox)\s*\{\s*[+-]?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?\s*\}"
URL_OR_IMAGE = r"(?i)(?:https?://|www\.|<img\b|!\[[^\]]*\]\([^)]*\)|\b[^\s]+\.(?:png|jpe?g|gif|svg|webp)\b)"
VISUAL = (
    r"(?i)\b(?:shown|pictured|illustrated|displayed)\s+(?:above|below)\b|"
    r"\b(?:above|below|following|given)\s+(?:figure|diagram|graph|image|picture)\b|"
    r"\b(?:figure|diagram|graph|image|picture)\s+(?:above|below)\b|"
    r"\baccording\s+to\s+(?:the\s+)?(?:figure|diagram|graph|image|picture)\b|"
    r"\bfrom\s+(?:the\s+)?(?:figure|diagram|graph|image|picture)\b"
)
ASYMPTOTE = r"(?i)(?:\[asy\]|\[/asy\]|\bimport\s+(?:graph|geometry|three)\s*;|\b(?:draw|dot|label|fill|size)\s*\([^\n;]*\)\s*;)"
PART_MARKER = r"(?im)(?:^|[\s;])\((?:[a-z]|[ivx]{1,5}|\d+)\)\s*|(?:^|\n)\s*(?:part\s+)?(?:[a-z]|[ivx]{1,5}|\d+)[.):]\s+"
MULTIPART = r"(?i)\b(?:answer|solve|find)\s+(?:both|all)\b|\bparts?\s+\(?[a-z]\)?\s+(?:and|through)\s+\(?[a-z]\)?"
SCRIPTS = r"[\x{0400}-\x{052f}\x{0600}-\x{06ff}\x{0900}-\x{097f}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
LATEX = r"(?:\$[^$]+\$|\\\(|\\\)|\\\[|\\\]|\\(?:frac|dfrac|tfrac|sqrt|sum|prod|int|begin|end|overline|underline|mathbf|mathbb|mathrm|text|boxed|left|right)\b)"
FRAGMENT_NUMBER = r"^\d+\s*[.)]?$"
FRAGMENT_WORD = r"[A-Za-z]+|\d+"
FRAGMENT_END = r"(?:[=?]|[:#])\s*$"
QUESTION_WORD = r"(?i)\b(?:what|which|find|solve|compute|determine|how)\b"
# ---- end of fixed values ---------------------------------------------------------------------------------


#: What a text that matches must hold, in lower case; a text without any of them is spared the pattern.
NEEDS = {
    ANSWER_CUE: ("answer", "solution", "####"), NUMERIC_BOXED: ("boxed", "fbox"), URL_OR_IMAGE: ("://", "www.", "<img", "![", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp"), VISUAL: ("above", "below", "figure", "diagram", "graph", "image", "picture"),
    ASYMPTOTE: ("asy]", "import", "draw", "dot", "label", "fill", "size"), MULTIPART: ("answer", "solve", "find", "part"), LATEX: ("$", "\\"),
}


def _has(t: Column, pattern: str) -> Column:
    found = t.rlike("(?Ud)" + pattern)
    if pattern not in NEEDS:
        return found
    low = F.lower(F.translate(t, "ıİſ", "iis"))  # as matching without case takes them
    some = low.contains(NEEDS[pattern][0])
    for x in NEEDS[pattern][1:]:
        some |= low.contains(x)
    return some & found


def stripped(question: Column) -> Column:
    """What the flags look at."""
    return T.strip(T.normalize_question(question))


def flag_columns(t: Column) -> dict[str, Column]:
    """A boolean for each flag, of a text from ``stripped``."""
    words = F.regexp_count(t, F.lit("(?U)" + FRAGMENT_WORD))
    fragment = (t == "") | _has(t, FRAGMENT_NUMBER) | ((F.length(t) <= 20) & (words <= 3) & ~t.rlike("[?=]")) | ((F.length(t) <= 48) & _has(t, FRAGMENT_END) & ~_has(t, QUESTION_WORD))
    return {
        "fragment": fragment,
        "answer_or_solution_cue": _has(t, ANSWER_CUE),
        "numeric_boxed": _has(t, NUMERIC_BOXED),
        "url_or_image": _has(t, URL_OR_IMAGE),
        "missing_visual": _has(t, VISUAL) & ~_has(t, ASYMPTOTE),
        "asymptote": _has(t, ASYMPTOTE),
        "multi_part": (F.regexp_count(t, F.lit("(?Ud)" + PART_MARKER)) >= 2) | _has(t, MULTIPART),
        "non_ascii": T.is_non_ascii(t),
        "multilingual": T.is_non_ascii(t) & t.rlike(SCRIPTS),
        "latex_proxy": _has(t, LATEX),
    }


def assess(df, question: str = "question_raw"):
    """``df`` with a boolean for each flag and ``flags``, the names that hold, in order; a null question has none."""
    columns = [c for c in df.columns if c not in FLAGS and c != "flags"]
    seen = df.select(*columns, stripped(F.col(question)).alias("__q"))
    seen = seen.select(*columns, *(F.coalesce(v, F.lit(False)).alias(k) for k, v in flag_columns(F.col("__q")).items()))
    # Spark compiles array_except, unlike array_compact, so the parts that the flags share are computed once.
    return seen.withColumn("flags", F.array_except(F.array(*(F.when(F.col(k), F.lit(k)) for k in FLAGS)), F.array(F.lit(None).cast("string"))))
