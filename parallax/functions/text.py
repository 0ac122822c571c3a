"""Column -> Column text functions.

Everything here is a built-in Spark expression, so it stays inside
whole-stage code generation and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col

# Python's str.strip()/str.split() whitespace: every code point for which
# str.isspace() is true (29 characters, all in the BMP).
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# The same set as a regex character class usable by both Java regex and RE2
# (used for the SQL oracle; slow in Java, which tests each member in turn).
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in PY_WHITESPACE) + "]"

# The same set for Spark (Java regex): Unicode \s plus U+001C..U+001F.
JAVA_WS_CLASS = "(?U)[\\s\\x{1c}-\\x{1f}]"

# ASCII whitespace as Perl/Moses sees it in byte mode.
ASCII_WS_CLASS = "[ \\t\\n\\r\\f\\x0B]"


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove all Unicode whitespace at both ends."""
    return F.trim(as_col(c), F.lit(PY_WHITESPACE))


def strip_bom(c) -> Column:
    """Remove every U+FEFF (a BOM that ``cat`` moved into the middle of a file)."""
    return F.replace(as_col(c), F.lit("﻿"), F.lit(""))


def lower(c) -> Column:
    """Lower case (used before similarity only)."""
    return F.lower(as_col(c))


def add_source_prefix(c, prefix: str = "") -> Column:
    """A fixed string before every source sentence."""
    return F.concat(F.lit(prefix), as_col(c))


def tag_target(c, tag, enabled: bool = True) -> Column:
    """``tag + ' ' + target`` (only for tokenizers that need it)."""
    c = as_col(c)
    if not enabled:
        return c
    return F.concat(as_col(tag) if not isinstance(tag, str) else F.lit(tag), F.lit(" "), c)


def restore_final_period(src, tgt) -> Column:
    """Add '.' to the target when the source ends with '.' and it does not."""
    src, tgt = as_col(src), as_col(tgt)
    return F.when(src.endswith(".") & ~tgt.endswith("."), F.concat(tgt, F.lit("."))).otherwise(tgt)


def drop_unknown_marks(c) -> Column:
    """Delete every '*' (unknown-word marker of rule-based output)."""
    return F.replace(as_col(c), F.lit("*"), F.lit(""))


def flatten_newlines(c) -> Column:
    """Newline inside generated text -> space."""
    return F.replace(as_col(c), F.lit("\n"), F.lit(" "))


def first_words(c, i) -> Column:
    """``' '.join(s.split(' ')[:i])`` -- single-space split, empty items kept."""
    n = i if isinstance(i, Column) else F.lit(int(i))
    return F.array_join(F.slice(F.split(as_col(c), " ", -1), F.lit(1), n), " ")


def language_name_key(c) -> Column:
    """Remove '_' from a language tag to form an artefact name."""
    return F.replace(as_col(c), F.lit("_"), F.lit(""))


def words(c) -> Column:
    """Whitespace words, as Python ``s.split()`` gives them: every whitespace
    character becomes ' ' (``translate``, no regex), split on ' ', empty
    items removed."""
    spaced = F.translate(as_col(c), PY_WHITESPACE, " " * len(PY_WHITESPACE))
    return F.array_remove(F.split(spaced, " ", -1), "")


def remove_whitespace(c) -> Column:
    """``''.join(s.split())``: delete every whitespace character."""
    return F.translate(as_col(c), PY_WHITESPACE, "")


def squeeze_spaces(c) -> Column:
    """Perl ``s/\\s+/ /g; s/^ //; s/ $//`` on ASCII whitespace."""
    s = F.regexp_replace(as_col(c), ASCII_WS_CLASS + "+", " ")
    return F.regexp_replace(s, "^ | $", "")


def alnum_tokens(c) -> Column:
    """Maximal runs of letters and digits (the ``tr -cs '[:alnum:]'`` split)."""
    return F.regexp_extract_all(as_col(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


# ---------------------------------------------------------------------------
# Punctuation normalisation and word tokenisation.
# These follow the public Moses scripts; we implement a documented subset and
# claim no byte parity with the Perl originals.
# Fixed values: (pattern, replacement) in Java-regex syntax, applied in order.
# Replacement group references are written $1; the SQL oracle converts them.
# ---------------------------------------------------------------------------
NORMALIZE_PUNCT_COMMON = [
    ("\r", ""),
    (r"\(", " ("),
    (r"\)", ") "),
    (" +", " "),
    (r"\) ([.!:?;,])", ")$1"),
    (r"\( ", "("),
    (r" \)", ")"),
    (r"([0-9]) %", "$1%"),
    (" :", ":"),
    (" ;", ";"),
    ("`", "'"),
    ("''", ' " '),
    ("„", '"'),
    ("“", '"'),
    ("”", '"'),
    ("–", "-"),
    ("—", " - "),
    (" +", " "),
    ("´", "'"),
    ("([a-zA-Z])‘([a-zA-Z])", "$1'$2"),
    ("([a-zA-Z])’([a-zA-Z])", "$1'$2"),
    ("‘", "'"),
    ("‚", "'"),
    ("’", '"'),
    ("''", '"'),
    ("´´", '"'),
    ("…", "..."),
    (" « ", ' "'),
    ("« ", '"'),
    ("«", '"'),
    (" » ", '" '),
    (" »", '"'),
    ("»", '"'),
    (" %", "%"),
    (" \\?", "?"),
    (" !", "!"),
    (" ;", ";"),
    (" +", " "),
]
NORMALIZE_PUNCT_EN = [(r'"([,.]+)', '$1"')]
NORMALIZE_PUNCT_OTHER = [(',"', '",'), (r'(\.+)"(\s*[^<])', '"$1$2')]
NUMBER_COMMA_LANGS = ("de", "es", "cz", "cs", "fr")


def normalize_punct_tail(lang: str) -> list[tuple[str, str]]:
    """The language-dependent rules applied after the common ones."""
    rules: list[tuple[str, str]] = []
    if lang == "en":
        rules += NORMALIZE_PUNCT_EN
    elif lang not in ("cs", "cz"):
        rules += NORMALIZE_PUNCT_OTHER
    if lang in NUMBER_COMMA_LANGS:
        rules.append((r"([0-9]) ([0-9])", "$1,$2"))
    else:
        rules.append((r"([0-9]) ([0-9])", "$1.$2"))
    return rules


def normalize_punct_rules(lang: str) -> list[tuple[str, str]]:
    return list(NORMALIZE_PUNCT_COMMON) + normalize_punct_tail(lang)


_REGEX_META = set(".^$*+?()[]{}|\\")


def _apply_rules(out: Column, rules) -> Column:
    """Apply (pattern, replacement) rules in order; literal patterns use the
    plain ``replace`` (no regex engine), the rest ``regexp_replace``."""
    for pat, rep in rules:
        if not (set(pat) & _REGEX_META) and "$" not in rep and "\\" not in rep:
            out = F.replace(out, F.lit(pat), F.lit(rep))
        else:
            out = F.regexp_replace(out, pat, rep)
    return out


def normalize_punct(c, lang: str = "en") -> Column:
    """P10: Moses-style punctuation normalisation (documented subset)."""
    return _apply_rules(as_col(c), normalize_punct_rules(lang))


def normalize_punct_by(c, lang_col, langs=("en", "es", "fr", "de")) -> Column:
    """P10 with a per-row language: the common rules once, then only the
    short language-dependent tail is chosen per row."""
    common = _apply_rules(as_col(c), NORMALIZE_PUNCT_COMMON)
    lang = as_col(lang_col)
    out = None
    for l in langs:
        branch = _apply_rules(common, normalize_punct_tail(l))
        out = F.when(lang == l, branch) if out is None else out.when(lang == l, branch)
    return out.otherwise(_apply_rules(common, normalize_punct_tail("xx")))


# Fixed values for the word tokenizer subset (Java-regex syntax, in order).
WORD_TOKENIZE_RULES = [
    (r"[\x00-\x1f]", " "),
    (r"([^\p{L}\p{N}\s.'`,\-])", " $1 "),
    (r"([^0-9]),", "$1 , "),
    (r",([^0-9])", " , $1"),
    (r"([0-9]),$", "$1 ,"),
    (r"\.\s*$", " ."),
    (r"\s+", " "),
    (r"^ | $", ""),
]


def word_tokenize(c) -> Column:
    """Moses-style word tokenizer (documented subset): split off
    punctuation and symbols, commas not inside numbers, and the sentence-final
    period; returns the space-joined tokens."""
    return _apply_rules(as_col(c), WORD_TOKENIZE_RULES)
