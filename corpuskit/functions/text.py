"""Column -> Column text cleaners.

Every function here is a composition of built-in Spark SQL expressions, so it
runs inside whole-stage codegen and needs no Python worker.  Patterns are Java
regular expressions; the data-facing ones were written so that the same text
also works for RE2 (DuckDB), which is what the oracles use.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions import arrow_udfs as A


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


NL = "\n"

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Article cleaning (whole-line category, tail sections, list titles, disambiguation):
CATEGORY_LINE = r"\ACategory:[\S ]+\z"
TAIL_SECTION = r"\n(References|See also|External Links)\s?\n"
LIST_TITLE_PREFIX = "List of"
DISAMBIGUATION_SUFFIX = " may refer to:"
# Dialog speaker tokens that get a trailing space:
SPEAKER_TOKENS = ("<speaker1>", "<speaker2>")
# Generated-text markers removed before scoring:
PREDICTION_MARKERS = ("<pad>", "</s>")
# Word pieces dropped when decoding ids back to text:
DECODE_SKIP_PIECES = ("[PAD]", "[CLS]")
# Articles removed by answer normalisation:
ANSWER_ARTICLES = ("a", "an", "the")
# Detokenisation clean-up, applied in this order (from, to):
TIDY_REPLACEMENTS = (
    (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"),
    (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"),
)
# CJK code point ranges padded with spaces before word splitting:
CJK_RANGES = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
# ASCII punctuation for word splitting: 33-47, 58-64, 91-96, 123-126, plus \p{P}.
PUNCT_CLASS = r"[!-/:-@\[-`{-~\p{P}]"
# Python's string.punctuation, removed by answer normalisation:
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# ---------------------------------------------------------------------------

CJK_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"


# What Python's str.strip and str.split take for white space (Java and RE2 read the class alike).
WS = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Letters, digits and the underscore: what a word border separates from all else.
WORD = r"[\p{L}\p{N}_]"


# The same class as a string of its characters.
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip_ws(c) -> Column:
    """Python ``str.strip()``; both ends only, where a pattern would try every run of white space."""
    return F.trim(_c(c), F.lit(WS_CHARS))


# --- articles (B1-B5) -------------------------------------------------------

def title_of(text) -> Column:
    """B1: the first line."""
    return F.substring_index(_c(text), NL, 1)


def body_of(text) -> Column:
    """B1: everything after the first line ('' when there is none)."""
    t = _c(text)
    pos = F.instr(t, NL)
    return F.when(pos > 0, t.substr(pos + 1, F.lit(2147483647))).otherwise(F.lit(""))


def drop_category_lines(body) -> Column:
    """B2: drop whole lines matching ``Category:...``."""
    lines = F.split(_c(body), NL, -1)
    return F.array_join(F.filter(lines, lambda ln: ~ln.rlike(CATEGORY_LINE)), NL)


def cut_at_tail_section(body) -> Column:
    """Cut at the first References / See also / External Links heading, then strip.

    Case-sensitive, as in the reference: ``External links`` is not cut.
    """
    b = _c(body)
    pos = F.regexp_instr(b, F.lit(TAIL_SECTION))
    cut = F.when(pos > 0, F.substring(b, F.lit(1), pos - 1)).otherwise(b)
    return strip_ws(cut)


def is_list_title(title) -> Column:
    """B4."""
    return _c(title).startswith(LIST_TITLE_PREFIX)


def is_disambiguation(title, body) -> Column:
    """Cleaned body contains ``"{title} may refer to:"``."""
    return F.instr(_c(body), F.concat(_c(title), F.lit(DISAMBIGUATION_SUFFIX))) > 0


# --- dialogs (B8) ------------------------------------------------------------

def space_speakers(text) -> Column:
    out = _c(text)
    for tok in SPEAKER_TOKENS:
        out = F.replace(out, F.lit(tok), F.lit(tok + " "))
    return out


# --- tokenizer-side cleaning (B10-B13) -------------------------------------

def clean_text(c) -> Column:
    """Whitespace (tab, CR, LF, Zs) to space; drop NUL, U+FFFD, Cc and Cf."""
    t = F.regexp_replace(_c(c), r"[\t\n\r\p{Zs}]", " ")
    return F.regexp_replace(t, r"[\x{0}\x{FFFD}\p{Cc}\p{Cf}]", "")


def space_cjk(c) -> Column:
    """A space on each side of every CJK ideograph."""
    return F.regexp_replace(_c(c), "(" + CJK_CLASS + ")", " $1 ")


# Hangul syllables are arithmetic: first code point, and the leading, middle and trailing letters they decompose to.
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, dict[str, str]]:
    """NFD without marks (Mn) of every character that it changes, by rule from ``unicodedata``.

    Two strings for ``translate``, characters with a base of one character first and dropped ones behind, and the
    few that become several characters; Hangul syllables are left out.
    """
    src, dst, drop, several = [], [], [], {}
    for cp in range(0x80, 0x110000):
        if HANGUL <= cp < HANGUL + 11172 or 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        stripped = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if stripped == ch:
            continue
        if not stripped:
            drop.append(ch)
        elif len(stripped) == 1:
            src.append(ch)
            dst.append(stripped)
        else:
            several[ch] = stripped
    return "".join(src) + "".join(drop), "".join(dst), several


def _hangul_letters(ch: Column) -> Column:
    at = F.ascii(ch) - HANGUL
    letters = [("".join(map(chr, LEADS)), F.floor(at / 588)), ("".join(map(chr, VOWELS)), F.floor(at % 588 / 28)), ("".join(map(chr, TAILS)), at % 28 - 1)]
    return F.concat(*[F.when(i >= 0, F.lit(table).substr((i + 1).cast("int"), F.lit(1))).otherwise(F.lit("")) for table, i in letters])


def strip_accents(c, seen=None) -> Column:
    """NFD, then drop combining marks (Mn), for every script; ``translate`` in the JVM, and character by character
    only for texts that hold Hangul syllables or another character that becomes several.  ``seen`` is a cheaper
    column that holds such a character whenever ``c`` does."""
    src, dst, several = _accent_table()
    t = F.translate(_c(c), src, dst)
    pairs = F.create_map(*[F.lit(x) for kv in several.items() for x in kv]) if several else None

    def letters(ch):
        code = F.ascii(ch)
        whole = F.when((code >= HANGUL) & (code < HANGUL + 11172), _hangul_letters(ch))
        return (whole.otherwise(F.coalesce(F.try_element_at(pairs, ch), ch)) if several else whole.otherwise(ch))

    special = "[" + "".join(several) + "\uac00-\ud7a3]"
    # most texts have no character from the first special one on, and a plain range is much faster to look for
    high = rf"[^\x00-\x{{{min(map(ord, several), default=HANGUL) - 1:X}}}]"
    own = _c(c if seen is None else seen)
    return F.when(own.rlike(high) & own.rlike(special), F.array_join(F.transform(F.split(t, ""), letters), "")).otherwise(t)


def pad_punctuation(c) -> Column:
    """Every punctuation character becomes its own token."""
    return F.regexp_replace(_c(c), "(" + PUNCT_CLASS + ")", " $1 ")


def split_ws(c) -> Column:
    """Whitespace split with empties removed (Python ``str.split()``)."""
    return F.filter(F.split(_c(c), WS + "+"), lambda w: w != "")


# Texts of these characters alone are never changed by ``clean_text`` but for tab, CR and LF, nor by ``space_cjk``, and
# no character of them decomposes to several: ASCII, Latin letters, the usual quotes, dashes and currency signs.
PLAIN = r"\A[\t\n\r\x20-\x7E\x{A1}-\x{AC}\x{AE}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}]*+\z"
ASCII_PUNCT_CLASS = r"[!-/:-@\[-`{-~]"


def basic_tokens(c, lower: bool = True) -> Column:
    """C4: clean -> CJK spacing -> lower/strip accents -> punctuation split -> words.

    Every step is a pass over the text, and most change nothing in most texts: plain ones take the passes they need.
    """
    own = _c(c)
    t = space_cjk(clean_text(own))
    if not lower:
        return split_ws(pad_punctuation(t))
    low, (src, dst, _) = F.lower(own), _accent_table()
    plain = own.rlike(PLAIN)
    ascii_text = F.regexp_replace(low, "(" + ASCII_PUNCT_CLASS + ")", " $1 ")
    plain_text = pad_punctuation(F.translate(low, src, dst))
    other = F.split(pad_punctuation(strip_accents(F.lower(t), own)), WS + "+")
    words = F.when(plain & (F.octet_length(own) == F.length(own)), F.split(ascii_text, r"[ \t\n\r]+")).when(plain, F.split(plain_text, r"[ \t\n\r]+")).otherwise(other)
    return F.filter(words, lambda w: w != "")


@lru_cache(maxsize=1)
def plain_table() -> tuple[np.ndarray, np.ndarray]:
    """What ``basic_tokens`` makes of each character of ``PLAIN`` texts, by code point: the lower one without accent,
    and its kind for ``arrow_udfs.plain_lines``.  The last entry stands for all characters beyond."""
    src, dst, _ = _accent_table()
    top, accents = 0x20C1, str.maketrans(src[:len(dst)], dst, src[len(dst):])
    lower, kind = np.full(top, ord("?"), np.uint32), np.full(top, A.OTHER, np.uint8)
    plain = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", PLAIN.removeprefix(r"\A").removesuffix(r"*+\z")))
    for cp in range(top - 1):
        ch = chr(cp)
        if plain.fullmatch(ch):
            low = ch.lower().translate(accents)
            lower[cp] = ord(low)
            mark = unicodedata.category(low)[0] == "P" or low in ASCII_PUNCTUATION
            kind[cp] = A.SPACE if ch in "\t\n\r " else A.MARK if mark else A.WORD
    return lower, kind


# --- evaluation-side normalisation (B14-B22) --------------------------------

def normalize_answer(c) -> Column:
    """Lower -> drop ASCII punctuation -> drop articles between word borders -> collapse whitespace."""
    t = F.translate(F.lower(_c(c)), ASCII_PUNCTUATION, "")
    t = F.regexp_replace(t, rf"(?<!{WORD})({'|'.join(ANSWER_ARTICLES)})(?!{WORD})", " ")
    return F.array_join(split_ws(t), " ")


def clean_prediction(c) -> Column:
    """Remove generation markers, strip."""
    t = _c(c)
    for m in PREDICTION_MARKERS:
        t = F.replace(t, F.lit(m), F.lit(""))
    return strip_ws(t)


def detokenize_pieces(pieces) -> Column:
    """Drop [PAD]/[CLS]; '##x' glued to the previous piece, others after a space."""
    kept = F.filter(_c(pieces), lambda p: ~p.isin(*DECODE_SKIP_PIECES))
    parts = F.transform(kept, lambda p: F.when(p.startswith("##"), F.substring(p, 3, 2147483647)).otherwise(F.concat(F.lit(" "), p)))
    return F.array_join(parts, "")


def tidy_spaces(pieces) -> Column:
    """Join with spaces, glue '##' pieces, strip, then the fixed clean-up replacements."""
    t = strip_ws(F.replace(F.array_join(_c(pieces), " "), F.lit(" ##"), F.lit("")))
    for a, b in TIDY_REPLACEMENTS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def add_prefix(c, prefix: str) -> Column:
    """B19."""
    return F.concat(F.lit(prefix), _c(c))


def precut(c, max_tokens: int, chars_per_token: int = 10) -> Column:
    """Cheap character cut before an expensive tokeniser (the reference's own step)."""
    return F.substring(_c(c), 1, max_tokens * chars_per_token)


def cut_at_eod(tokens, prompt_len, eod: int) -> Column:
    """Keep up to and including the first EOD at or after the prompt; all if none."""
    t = _c(tokens)
    pl = _c(prompt_len) if not isinstance(prompt_len, int) else F.lit(prompt_len)
    tail = F.slice(t, pl + 1, F.greatest(F.size(t) - pl, F.lit(0)))
    p = F.array_position(tail, eod)
    return F.when(p > 0, F.slice(t, 1, pl + p)).otherwise(t)


def trim_padding(tokens, pad) -> Column:
    """Items before the first pad."""
    t = _c(tokens)
    p = F.array_position(t, pad)
    return F.when(p > 0, F.slice(t, 1, p - 1)).otherwise(t)
