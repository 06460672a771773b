"""Text views of questions, their fingerprints, and other scalar columns.

All of it is native Spark expressions but NFKC and full case folding, which Spark lacks. Texts made only of characters
that both leave alone (``INERT``, nearly all texts in Latin script) stay native; only others go through an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values: patterns and marks of the text views -------------------------------------------------
#: All that counts as white space, in regular expressions and as characters.
WS = r"[\s\x1c-\x1f]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space below U+0100, as a class that Java tells by one bit (``(?U)\\s`` looks up properties), and the rest of it.
SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0]"
WIDE_SPACE = r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DASHES = "\u2212\u2013\u2014"
TIMES, DIVIDE = "\u00d7", "\u00f7"
FRACTIONS = r"\\(?:dfrac|tfrac)(?![A-Za-z])"
SIZING = r"\\(?:left|right)(?![A-Za-z])"
DELIMITERS = ("$", r"\(", r"\)", r"\[", r"\]")
SPACING = r"\\(?:,|;|:|!|quad\b|qquad\b|enspace\b|thinspace\b)"
EDGES = r"[{}()\[\]^_=+\-*/<>|,;:]"
EXERCISE_NUMBER = r"^\d+(?:\.\d+)*[.)]?\s+(?=(?:what|which|find|if|how|determine|compute|solve)\b)"
NUMBER = r"(?<![A-Za-z0-9_])([+-]?)(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![A-Za-z0-9_])"
CANONICAL_INTEGER = r"^(?:0|-?[1-9][0-9]*)\z"
SECRETS = {
    "named-access-token": r"""(?i)(?:KAGGLE_API_TOKEN|HF_TOKEN|HUGGINGFACE_HUB_TOKEN|GITHUB_TOKEN)\s*[:=]\s*["']?[A-Za-z0-9_-]{12,}""",
    "github-token": r"(?:ghp|github_pat)_[A-Za-z0-9_-]{20,}",
    "huggingface-token": r"hf_[A-Za-z0-9_-]{20,}",
    "aws-access-key": r"AKIA[0-9A-Z]{16}",
    "private-key": r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----",
}
PRIVATE_FOLDERS = (".gstack", ".kaggle", ".venv", "artifacts", "cache", "checkpoints", "data", "datasets", "downloads", "env", "mlruns", "models", "outputs", "predictions", "runs", "submissions", "wandb")
PRIVATE_NAMES = ("NUL", "NU_", "access_token", "adapter_model.bin", "credentials", "id_ed25519", "id_rsa", "kaggle.json", "submission.csv")
PRIVATE_SUFFIXES = (".bin", ".ckpt", ".csv", ".gz", ".jsonl", ".kdbx", ".key", ".npy", ".npz", ".onnx", ".parquet", ".pickle", ".pkl", ".p12", ".pfx", ".pem", ".pth", ".pt", ".safetensors", ".tar", ".tsv", ".xz", ".zip")
PRIVATE_STARTS = (("reports", "generated"),)
ENV_FILE = ".env"
# ---- end of fixed values ---------------------------------------------------------------------------------


def _inert_class() -> str:
    """Characters below U+0250 that NFKC keeps, that compose with nothing, and whose folding is their lower case (but for ß)."""
    ok = [c for c in map(chr, range(0x250)) if unicodedata.normalize("NFKC", c) == c and (c.casefold() == c.lower() or c == "ß") and c != "\r"]
    runs: list[list[int]] = []
    for c in map(ord, ok):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{z:x}}}" for a, z in runs)


#: What isn't inert. ASCII but for the carriage return is told first: a class of so many ranges takes long for every character.
INERT = rf"[\r\x{{80}}-\x{{10ffff}}&&[^{_inert_class()}]]"


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_folded(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def _newlines(c: Column) -> Column:
    return F.when(c.contains("\r"), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)


def normalize_question(c: Column) -> Column:
    """Line ends as LF, no-break spaces as spaces, NFKC; nothing is stripped or collapsed. Null stays null."""
    x = F.replace(_newlines(c), F.lit("\u00a0"), F.lit(" "))
    return F.coalesce(_nfkc(F.when(_changeable(x), x)), x)


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.btrim(c, F.lit(SPACES))


def _changeable(x: Column) -> Column:
    """True where NFKC or folding may do more than lower-casing; ASCII is told by its length alone."""
    return (F.octet_length(x) != F.length(x)) & x.rlike(INERT)


def _holds(x: Column, marks: Iterable[str]) -> Column:
    """True where a text has one of the marks; a plain search takes far less time than a replacement that finds nothing."""
    return reduce(Column.__or__, map(x.contains, marks))


def canonical_text(c: Column) -> Column:
    """The comparison form: normalised, case-folded, without TeX delimiters, spacing and sizing, spaces collapsed.

    Steps are kept from texts that lack the characters they need. What decides is looked for in ``c`` itself, so that no
    step is written out, or computed, once for each of its tests: folding alone makes such characters of others.
    """
    x = F.when(_holds(c, "\r\u00a0"), F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("\u00a0"), F.lit(" "))).otherwise(c)
    folded = _nfkc_folded(F.when(_changeable(x), x))
    x = F.coalesce(folded, F.replace(F.lower(x), F.lit("ß"), F.lit("ss")))
    signs = F.replace(F.translate(x, DASHES + DIVIDE, "-" * len(DASHES) + "/"), F.lit(TIMES), F.lit(r"\times"))
    signs = F.regexp_replace(signs, WIDE_SPACE, " ")  # never inert
    x = F.when(folded.isNotNull() | _holds(c, DASHES + DIVIDE + TIMES), signs).otherwise(x)
    tex = F.regexp_replace(F.regexp_replace(x, FRACTIONS, r"\\frac"), SIZING, "")
    for mark in DELIMITERS:
        tex = F.replace(tex, F.lit(mark), F.lit(""))
    x = F.when(folded.isNotNull() | _holds(c, "\\$"), F.regexp_replace(tex, "(?U)" + SPACING, "")).otherwise(x)
    x = F.trim(F.regexp_replace(x, f"{SPACE}(?:{SPACE}+|(?<! ))", " "))  # a lone space stays
    return F.regexp_replace(x, f" (?:(?<={EDGES} )|(?={EDGES}))", "")


def source_format_text(c: Column, canonical: Column | None = None) -> Column:
    """The comparison form without a leading exercise number, a trailing ``#`` and spaces before sentence marks."""
    whole = canonical_text(c) if canonical is None else canonical
    x = F.regexp_replace(whole, "(?iU)" + EXERCISE_NUMBER, "")
    x = F.when(x.endswith("#"), F.regexp_replace(x, rf"(?U){WS}*#{WS}*\z", "")).otherwise(x)
    for mark in "?.!":
        x = F.replace(x, F.lit(f" {mark}"), F.lit(mark))  # the comparison form has single spaces only
    some = F.substring(whole, 1, 1).rlike(r"(?U)\d") | whole.endswith("#") | _holds(whole, (" ?", " .", " !"))
    return F.trim(F.when(some, x).otherwise(whole))


def masked_template_text(c: Column, canonical: Column | None = None) -> Column:
    """The comparison form with the magnitude of every number masked; signs stay."""
    x = canonical_text(c) if canonical is None else canonical
    return F.when(x.rlike("[0-9]"), F.regexp_replace(x, NUMBER, "$1<num>")).otherwise(x)


def packed_hex(c: Column) -> Column:
    """Lower-case hex digits as bytes, half as many to move and to settle; any other text as it is. ``unpacked_hex`` turns it back."""
    is_hex = c.rlike(r"^(?:[0-9a-f]{2})+\z")
    return F.struct(F.when(is_hex, F.unhex(c)).alias("bytes"), F.when(~is_hex, c).alias("text"))


def unpacked_hex(c: Column) -> Column:
    return F.coalesce(F.lower(F.hex(c["bytes"])), c["text"])


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("string").cast("binary"), 256)


def fingerprints(c: Column) -> dict[str, Column]:
    """canonical, source_format and masked fingerprints of a text column (canonicalise once: see ``with_views``)."""
    return {"canonical": sha256(canonical_text(c)), "source_format": sha256(source_format_text(c)), "masked": sha256(masked_template_text(c))}


def with_views(df, text: str = "question_raw"):
    """``df`` with canonical, source_text, masked_text and their three fingerprints; the chain runs once for all of them."""
    out = df.withColumn("canonical", canonical_text(F.col(text)))
    out = out.withColumns({"source_text": source_format_text(F.col(text), F.col("canonical")), "masked_text": masked_template_text(F.col(text), F.col("canonical"))})
    return out.withColumns({"canonical_fp": sha256(F.col("canonical")), "source_fp": sha256(F.col("source_text")), "masked_fp": sha256(F.col("masked_text"))})


def is_canonical_integer(c: Column) -> Column:
    """True for 0 or an integer without plus sign and leading zeros; null counts as false."""
    return F.coalesce(c.rlike(CANONICAL_INTEGER), F.lit(False))


def integer_text(text: Column, kind: Column) -> Column:
    """The canonical text of a JSON value given as text with the name of its type; null unless an integer or canonical text."""
    number = F.when(text.rlike(r"^-?0\z"), F.lit("0")).when(text.rlike(CANONICAL_INTEGER), text)
    return F.when(kind == "STRING", F.when(is_canonical_integer(text), text)).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), number)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"(?U)[^\s\x1c-\x1f]+"))


def is_multiline(c: Column) -> Column:
    return c.rlike(r"[\r\n]")


def is_non_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def has_control(c: Column) -> Column:
    """A control character other than tab and line feed."""
    return c.rlike(r"[\x00-\x08\x0B-\x1F]")


def stable_rank(namespace: str, seed: int, version: str, c: Column) -> Column:
    """A pseudo-random order key: SHA-256 of the NUL-joined parts."""
    return sha256(F.concat_ws("\u0000", F.lit(namespace), F.lit(str(seed)), F.lit(version), c.cast("string")))


def deterministic_seed(problem_id: Column, sample_index: Column, salt: str) -> Column:
    """A 63-bit generation seed that depends on nothing but its arguments."""
    digest = sha256(F.concat_ws("\u0000", F.lit("seed-v1"), F.lit(salt), problem_id.cast("string"), sample_index.cast("string")))
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def answer_sign(a: Column) -> Column:
    return F.when(a < 0, "negative").when(a > 0, "positive").when(a == 0, "zero")


def answer_bucket(a: Column) -> Column:
    m = F.abs(a)
    return F.when(m == 0, "0").when(m <= 10, "1_to_10").when(m <= 100, "11_to_100").when(m <= 1000, "101_to_1000").when(m < 1_000_000, "1001_to_999999").when(m >= 1_000_000, "ge_1e6")


def secret_markers(c: Column) -> Column:
    """Names of the credential patterns that a text holds, in listed order; never what matched."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, p in SECRETS.items())))


def is_forbidden_path(c: Column, folders: tuple[str, ...] = PRIVATE_FOLDERS, names: tuple[str, ...] = PRIVATE_NAMES, suffixes: tuple[str, ...] = PRIVATE_SUFFIXES) -> Column:
    """True for a path that must not be published: absolute, empty or null, with "..", or of a private folder, name or suffix.

    Empty parts and "." don't count. A leading dot makes no suffix, and suffixes are compared in lower case. Names that
    only one project keeps private go into the arguments.
    """
    parts = F.filter(F.split(c, "/"), lambda x: ~x.isin("", "."))
    name = F.try_element_at(parts, F.lit(-1))
    suffix = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))
    listed = lambda xs: F.array(*map(F.lit, xs))
    bad = c.startswith("/") | (F.size(parts) == 0) | F.array_contains(parts, "..") | F.arrays_overlap(parts, listed(folders)) | name.isin(*names) | name.startswith(ENV_FILE) | suffix.isin(*suffixes)
    for start in PRIVATE_STARTS:
        bad |= F.slice(parts, 1, len(start)) == listed(start)
    return F.coalesce(bad, F.lit(True))


def canonical_json(**columns: Column) -> Column:
    """Compact JSON of the named columns with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def ids_sha256(ids: Column) -> Column:
    """Digest of an array of ids in the given order, as compact JSON."""
    return sha256(F.to_json(ids))
